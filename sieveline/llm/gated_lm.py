"""A gated recurrent language model in NumPy: one GRU layer, a softmax over classes of words and one over the words of a class, and
truncated backpropagation through windows of steps, across which the state is carried.

Documents run in lanes side by side. A lane works off whole documents one after the other, and its state starts anew with each. Words
outside the model's vocabulary share the last class, inside which their share is fixed; the caller adds it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

WIDTH, EMBEDDED, STEPS, LANES, SEGMENT = 16, 12, 32, 256, 2048
_RATE, _CLIP = 0.01, 1.0


class Shape(NamedTuple):
    """bounds: first word of each class of known words, and their number; end: the id of the token that ends a document."""

    bounds: tuple[int, ...]
    end: int

    @property
    def words(self) -> int:
        return self.bounds[-1]

    @property
    def classes(self) -> int:
        return len(self.bounds)  # the last one is that of all other words


def shape_of(counts: np.ndarray, end: int, classes: int) -> Shape:
    """Classes of near equal sums of square roots of counts; counts fall from word to word."""
    if not len(counts):
        return Shape((0,), end)
    at = np.cumsum(np.sqrt(counts))
    of = np.minimum((classes * at / at[-1]).astype(np.int64), classes - 1)
    return Shape((*np.flatnonzero(np.diff(of, prepend=-1)).tolist(), len(counts)), end)


class Model:
    """Parameters as views of one vector of 32-bit floats."""

    def __init__(self, shape: Shape, vector: np.ndarray | None = None):
        self.shape, k, c = shape, shape.words, shape.classes
        sizes = {
            "embed": (k + 1, EMBEDDED), "enter": (EMBEDDED, 3 * WIDTH), "bias": (3 * WIDTH,), "again": (WIDTH, 3 * WIDTH),
            "to_class": (c, WIDTH), "class_bias": (c,), "to_word": (k, WIDTH), "word_bias": (k,),
        }
        n = sum(int(np.prod(s)) for s in sizes.values())
        self.vector = np.zeros(n, np.float32) if vector is None else vector
        at, self.parts = 0, {}
        for name, size in sizes.items():
            self.parts[name] = self.vector[at : at + int(np.prod(size))].reshape(size)
            at += int(np.prod(size))
        words = np.arange(k + 1)
        self.class_of = (np.searchsorted(np.array(shape.bounds), words, "right") - 1).astype(np.int16)

    def start(self, counts: np.ndarray, other: float) -> Model:
        """Small weights, and the shares of words and classes as biases: the untrained model is a unigram model. other: the mass of
        all other words together."""
        rng, b = np.random.default_rng(2024), self.shape.bounds
        for name in ("embed", "enter", "again", "to_class", "to_word"):
            p = self.parts[name]
            p[...] = rng.normal(0, 0.1 if name in ("embed", "to_class", "to_word") else p.shape[0] ** -0.5, p.shape)
        mass = [*np.add.reduceat(counts, b[:-1]), other] if len(counts) else [other]
        self.parts["class_bias"][:] = np.log(mass)
        self.parts["word_bias"][:] = np.log(counts)
        return self

    def run(self, ids: np.ndarray, fresh: np.ndarray, state: np.ndarray):
        """Hidden vectors [steps, lanes, WIDTH] after each input of ids [steps, lanes], and what the way back needs. fresh [steps, lanes]:
        where a document begins."""
        p, w = self.parts, WIDTH
        steps, lanes = ids.shape
        embedded = p["embed"][ids.ravel()]
        gates = (embedded @ p["enter"] + p["bias"]).reshape(steps, lanes, 3 * w)
        keep = (~fresh).astype(np.float32)[:, :, None]
        before, zr = np.empty((steps, lanes, w), np.float32), np.empty((steps, lanes, 2 * w), np.float32)
        back, new, out = np.empty_like(before), np.empty_like(before), np.empty_like(before)
        for t in range(steps):
            h = np.multiply(state, keep[t], out=before[t])
            a = h @ p["again"]
            s = np.add(gates[t, :, : 2 * w], a[:, : 2 * w], out=zr[t])
            np.negative(s, out=s)
            np.exp(s, out=s)
            s += 1
            np.reciprocal(s, out=s)
            back[t] = a[:, 2 * w :]
            n = np.multiply(s[:, w:], back[t], out=new[t])
            n += gates[t, :, 2 * w :]
            np.tanh(n, out=n)
            state = np.subtract(h, n, out=out[t])
            state *= s[:, :w]
            state += n
        return out, (ids, embedded, keep, before, zr, back, new)

    def logs(self, hidden: np.ndarray, target: np.ndarray, grads: Model | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each target (a row each), up to the share inside the last class; with grads, also the gradient of the
        sum's negative, for hidden and, added to grads, for the parameters."""
        p, b = self.parts, self.shape.bounds
        of = self.class_of[target]
        back = None

        def softmax(x, weights, bias, at):
            scores = x @ weights.T + bias
            scores -= scores.max(1, keepdims=True)
            i = np.arange(len(at))
            picked = scores[i, at]
            np.exp(scores, out=scores)
            total = scores.sum(1, keepdims=True)
            if grads is not None:
                scores /= total
                scores[i, at] -= 1
            return picked - np.log(total[:, 0]), scores

        out, d = softmax(hidden, p["to_class"], p["class_bias"], of)
        if grads is not None:
            back = d @ p["to_class"]
            grads.parts["to_class"] += d.T @ hidden
            grads.parts["class_bias"] += d.sum(0)
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(self.shape.classes))
        for c, (lo, hi) in enumerate(zip(b, b[1:])):
            at = order[ends[c] : ends[c + 1]]
            if hi - lo < 2 or not len(at):
                continue
            x = hidden[at]
            log, d = softmax(x, p["to_word"][lo:hi], p["word_bias"][lo:hi], target[at] - lo)
            out[at] += log
            if grads is not None:
                back[at] += d @ p["to_word"][lo:hi]
                grads.parts["to_word"][lo:hi] += d.T @ x
                grads.parts["word_bias"][lo:hi] += d.sum(0)
        return out, back

    def go_back(self, kept, d_out: np.ndarray, grads: Model) -> None:
        """Backpropagation through the window that ``run`` kept."""
        p, g, w = self.parts, grads.parts, WIDTH
        ids, embedded, keep, before, zr, back, new = kept
        steps, lanes = ids.shape
        d_gates, d_again = np.empty((steps, lanes, 3 * w), np.float32), np.empty((steps, lanes, 3 * w), np.float32)
        slope_zr, slope_n, again = zr * (1 - zr), 1 - new * new, p["again"].T.copy()
        carry = np.zeros((lanes, w), np.float32)
        for t in range(steps - 1, -1, -1):
            d = d_out[t] + carry
            z, r = zr[t, :, :w], zr[t, :, w:]
            d_n = d * (1 - z)
            d_n *= slope_n[t]
            d_gates[t, :, :w] = d * (before[t] - new[t]) * slope_zr[t, :, :w]
            d_gates[t, :, w : 2 * w] = d_n * back[t] * slope_zr[t, :, w:]
            d_gates[t, :, 2 * w :] = d_n
            d_again[t, :, : 2 * w] = d_gates[t, :, : 2 * w]
            np.multiply(d_n, r, out=d_again[t, :, 2 * w :])
            carry = d_again[t] @ again
            d *= z
            carry += d
            carry *= keep[t]
        flat = d_gates.reshape(-1, 3 * w)
        g["again"] += before.reshape(-1, w).T @ d_again.reshape(-1, 3 * w)
        g["enter"] += embedded.T @ flat
        g["bias"] += flat.sum(0)
        d_embedded, of = flat @ p["enter"].T, ids.ravel()
        order = np.argsort(of, kind="stable")
        first = np.flatnonzero(np.diff(of[order], prepend=-1))
        g["embed"][of[order][first]] += np.add.reduceat(d_embedded[order], first, axis=0)


class Lanes(NamedTuple):
    """Documents dealt to lanes: tokens, inputs, fresh and document, each [steps, lanes]; document is -1 where a lane has run out.
    Lanes become shorter from left to right."""

    tokens: np.ndarray
    inputs: np.ndarray
    fresh: np.ndarray
    document: np.ndarray
    lengths: np.ndarray


def deal(ids: np.ndarray, bounds: np.ndarray, end: int) -> Lanes:
    """Longest document first, each to the lane with least to do."""
    sizes = np.diff(bounds)
    n = min(LANES, len(sizes))
    heap, lane_of, at = [(0, i) for i in range(n)], np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for d in np.argsort(-sizes, kind="stable").tolist():
        load, lane = heap[0]
        lane_of[d], at[d] = lane, load
        heapq.heapreplace(heap, (load + int(sizes[d]), lane))
    lengths = np.bincount(lane_of, sizes, n).astype(np.int64)
    rank = np.argsort(np.argsort(-lengths, kind="stable"))
    steps = -(-int(lengths.max()) // STEPS) * STEPS
    place = (np.repeat(at, sizes) + np.arange(len(ids)) - np.repeat(bounds[:-1], sizes)) * n + np.repeat(rank[lane_of], sizes)
    tokens, document = np.zeros(steps * n, np.int32), np.full(steps * n, -1, np.int32)
    tokens[place], document[place] = ids, np.repeat(np.arange(len(sizes)), sizes)
    tokens, document = tokens.reshape(steps, n), document.reshape(steps, n)
    fresh = np.diff(document, axis=0, prepend=np.full((1, n), -2)) != 0
    inputs = np.where(fresh, end, np.concatenate([tokens[:1], tokens[:-1]]))
    return Lanes(tokens, inputs, fresh, document, -np.sort(-lengths))


def windows(lanes: Lanes) -> Iterator[tuple[slice, int]]:
    """Steps of each window, and how many lanes still run."""
    for t in range(0, len(lanes.tokens), STEPS):
        yield slice(t, t + STEPS), int((lanes.lengths > t).sum())


def score(model: Model, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The natural log of the probability of each whole document, up to the shares inside the last class."""
    if len(bounds) < 2:
        return np.zeros(0)
    lanes = deal(ids, bounds, model.shape.end)
    out, state = np.zeros(len(bounds) - 1), np.zeros((lanes.tokens.shape[1], WIDTH), np.float32)
    waiting, rows = [], 0

    def add_logs():
        hidden, target, document = (np.concatenate(x) for x in zip(*waiting))
        out[:] += np.bincount(document, model.logs(hidden, target)[0], len(out))
        waiting.clear()

    for w, n in windows(lanes):
        hidden, _ = model.run(lanes.inputs[w, :n], lanes.fresh[w, :n], state[:n])
        state = hidden[-1].copy()
        document = lanes.document[w, :n].ravel()
        at = np.flatnonzero(document >= 0)
        waiting.append((hidden.reshape(-1, WIDTH)[at], lanes.tokens[w, :n].ravel()[at], document[at]))
        rows += len(at)
        if rows >= STEPS * LANES:  # the softmax takes many rows at once, also where few lanes still run
            add_logs()
            rows = 0
    if waiting:
        add_logs()
    return out


class Trainer:
    """Adam over windows; the moments stay with the task."""

    def __init__(self, model: Model):
        self.model, self.grads = model, Model(model.shape)
        self.m, self.v, self.updates, self.tokens = np.zeros_like(model.vector), np.zeros_like(model.vector), 0, 0

    def learn(self, ids: np.ndarray, bounds: np.ndarray) -> None:
        """One pass over all tokens of the documents, with an update for each window. Parts of SEGMENT tokens of a longer document
        run side by side, so the state is carried through the windows of such a part."""
        cuts = [np.arange(a, b, SEGMENT) for a, b in zip(bounds[:-1], bounds[1:])]
        bounds = np.append(np.concatenate([np.zeros(0, np.int64), *cuts]), bounds[-1])
        lanes = deal(ids, bounds, self.model.shape.end)
        state = np.zeros((lanes.tokens.shape[1], WIDTH), np.float32)
        for w, n in windows(lanes):
            hidden, kept = self.model.run(lanes.inputs[w, :n], lanes.fresh[w, :n], state[:n])
            state = hidden[-1].copy()
            at = np.flatnonzero(lanes.document[w, :n].ravel() >= 0)
            self.grads.vector[:] = 0
            _, back = self.model.logs(hidden.reshape(-1, WIDTH)[at], lanes.tokens[w, :n].ravel()[at], self.grads)
            d = np.zeros((hidden.shape[0] * n, WIDTH), np.float32)
            d[at] = back
            self.model.go_back(kept, d.reshape(hidden.shape), self.grads)
            self._update(len(at))
        self.tokens += len(ids)

    def _update(self, n: int) -> None:
        g = self.grads.vector
        g /= n
        norm = float(np.sqrt(g @ g))
        if norm > _CLIP:
            g *= _CLIP / norm
        self.updates += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        fix = np.sqrt(1 - 0.999**self.updates) / (1 - 0.9**self.updates)
        self.model.vector -= _RATE * fix * min(1.0, (n / (STEPS * LANES)) ** 0.5) * self.m / (np.sqrt(self.v) + 1e-8)
