import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sieveline.llm import gated_lm as G
from sieveline.llm import lm_scoring
from sieveline.llm.lm_scoring import likelihood, vocabulary, word_counts
from sieveline.llm.tables import table

WORD = re.compile("[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


def held_out(i):
    return zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1


def brute(docs):
    c = Counter(w for i, t in docs if not held_out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, held_out(i), len(w := tokens(t)), sum(x in c for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, t in docs]


def same(got, want):
    key = lambda r: repr(tuple(r)[:5]) + f"{r[5]:.6f}"
    assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.mark.parametrize("known, words", [(1 << 19, 2000), (9, 5), (0, 5)])
def test_counts_and_base_score_equal_brute_force(spark, table_of, odd_rows, monkeypatch, known, words):
    monkeypatch.setattr(lm_scoring.vocabulary, "__defaults__", (words, 4, known))
    rows = odd_rows * 2 + [(i, f"only in {i} and the river") for i in range(20, 40)]
    got = likelihood(table_of(rows))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.collect()
    same(got, brute(rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got) and {r.held_out for r in got} == {True, False}


def test_without_training_rows_and_without_rows(spark, table_of):
    rows = [(i, "some words here") for i in range(200) if held_out(i)][:5]
    got = likelihood(table_of(rows)).collect()
    same(got, brute(rows))
    assert all(abs(r.score) < 1e-9 and r.n_known == 0 for r in got)
    assert likelihood(table_of(rows).limit(0)).count() == 0


def test_held_out_documents_are_better_predicted_than_by_counts(spark):
    rows = [r for r in likelihood(table(spark, "/root/testdata/sf0.1", "documents")).collect() if r.held_out]
    tokens, base, model = (sum(r[k] for r in rows) for k in ("n_tokens", "base_score", "score"))
    assert (model - base) / tokens > 0.15  # log10 a token
    assert sum(r.score > r.base_score for r in rows) > 0.9 * len(rows)


def test_shares_of_all_events_add_up(spark):
    docs = spark.createDataFrame([(f"a a b b c d e f g h{i}",) for i in range(9)], "text string")
    v = vocabulary(word_counts(docs), 5, 3, 100)
    model = G.Model(v.shape).start(v.top, v.other)
    model.vector += np.random.default_rng(0).normal(0, 0.5, model.vector.shape).astype(np.float32)
    hidden = np.random.default_rng(1).normal(size=(1, G.WIDTH)).astype(np.float32)
    logs = model.logs(np.repeat(hidden, 6, 0), np.arange(6))[0]
    assert abs(np.exp(logs).sum() - 1) < 1e-5 and v.n_words == 17 and v.n_tokens == 99
    inside = [n + 0.5 for n in sorted(Counter(w for i in range(9) for w in tokens(f"a a b b c d e f g h{i}")).values())[: 17 - 5]] + [0.5]
    assert abs(sum(inside) - v.other) < 1e-9


def small():
    rng = np.random.default_rng(3)
    shape = G.shape_of(np.array([40.0, 30, 20, 9, 8, 7, 3]), 1, 3)
    model = G.Model(shape)
    model.vector[:] = rng.normal(0, 0.4, model.vector.shape)
    sizes = [50, 3, 1, 90, 17]
    return model, rng.integers(0, 8, sum(sizes)), np.concatenate([[0], np.cumsum(sizes)])


def plain(model, ids):
    """The same model in a loop over tokens, in double precision."""
    p = {k: v.astype(float) for k, v in model.parts.items()}
    w, b, h, before, out = G.WIDTH, model.shape.bounds, np.zeros(G.WIDTH), model.shape.end, 0.0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for i in ids:
        g, a = p["embed"][before] @ p["enter"] + p["bias"], h @ p["again"]
        z, r = sigmoid(g[:w] + a[:w]), sigmoid(g[w : 2 * w] + a[w : 2 * w])
        n = np.tanh(g[2 * w :] + r * a[2 * w :])
        h, before = (1 - z) * n + z * h, i
        s = p["to_class"] @ h + p["class_bias"]
        c = next(c for c in range(len(b)) if c == len(b) - 1 or b[c] <= i < b[c + 1])
        out += s[c] - np.log(np.exp(s).sum())
        if c < len(b) - 1:
            s = p["to_word"][b[c] : b[c + 1]] @ h + p["word_bias"][b[c] : b[c + 1]]
            out += s[i - b[c]] - np.log(np.exp(s).sum())
    return out


def test_lanes_and_windows_score_as_a_plain_loop(monkeypatch):
    model, ids, bounds = small()
    want = [plain(model, ids[a:b]) for a, b in zip(bounds, bounds[1:])]
    for lanes, steps in ((256, 32), (2, 7), (1, 1)):
        monkeypatch.setattr(G, "LANES", lanes)
        monkeypatch.setattr(G, "STEPS", steps)
        assert np.allclose(G.score(model, ids, bounds), want, rtol=1e-4, atol=1e-3)


def test_gradient_is_that_of_the_loss(monkeypatch):
    monkeypatch.setattr(G, "STEPS", 100)  # one window: truncation cuts nothing
    model, ids, bounds = small()
    trainer = G.Trainer(model)
    monkeypatch.setattr(trainer, "_update", lambda n: None)
    trainer.learn(ids, bounds)
    rng, x = np.random.default_rng(4), model.vector
    at = rng.choice(len(x), 60, replace=False)
    for i in at:
        old, x[i] = x[i], x[i] + 1e-2
        up = sum(plain(model, ids[a:b]) for a, b in zip(bounds, bounds[1:]))
        x[i] = old - 1e-2
        down = sum(plain(model, ids[a:b]) for a, b in zip(bounds, bounds[1:]))
        x[i] = old
        assert abs((down - up) / 2e-2 - trainer.grads.vector[i]) < 0.02 + 0.01 * abs(trainer.grads.vector[i])
