import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sieveline.llm.bpe import vocabulary
from sieveline.llm.bpe_codec import decode, encode, guessed_or_merged, joined_otherwise
from sieveline.llm.encoding import Encoder
from sieveline.llm.packing import Piece, fill_windows, last_windows, pack
from sieveline.llm.token_counts import count_tokens, whole_or_merged

BYTES, LOWER = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
RAW = {p: open(p, "rb").read() for p in (BYTES, LOWER)}
LIBRARY = {p: Tokenizer.from_file(p) for p in RAW}
ENCODERS = [(BYTES, Encoder(RAW[BYTES], True, whole_or_merged)), (BYTES, Encoder(RAW[BYTES], True, guessed_or_merged)), (LOWER, Encoder(RAW[LOWER], False))]


def ids_of(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sretvlmd.,!-aéÉΣßİ1²<|>"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=4))
def test_ids_are_the_librarys(texts):
    texts = [*texts, "<|endoftext|>" + texts[0] + "<|startoftext|>"]
    for path, own in ENCODERS:
        ids, bounds = own.ids(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [ids_of(path, t) for t in texts]
        assert own.counts(texts).tolist() == [len(ids_of(path, t)) for t in texts]


def test_every_code_point_has_the_librarys_class():
    texts = [f"{chr(c)}a {chr(c)}1{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    for path, own in ENCODERS[1:]:
        own.store.clear()
        ids, bounds = own.ids(texts)
        want = [e.ids for e in LIBRARY[path].encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want


def test_seam_check_agrees_with_merging():
    v, rng = vocabulary(RAW[BYTES]), np.random.default_rng(3)
    whole = np.array(sorted(v.whole_tokens().values()))
    a, b = rng.choice(whole, 20_000), rng.choice(whole, 20_000)
    tokens, counts = v.merge([v.bytes[x] + v.bytes[y] for x, y in zip(a, b)])
    first = np.cumsum(counts) - counts
    apart = (counts == 2) & (tokens[first] == a)
    assert (joined_otherwise(v, a, b) == ~apart).all()


def test_long_words_merge_exactly():
    for word in ("a" * 3000, "ab" * 700, "-" * 999, "the" * 400):
        for path, own in ENCODERS:
            assert own.ids([word])[0].tolist() == ids_of(path, word)


def test_counts_codec_and_nulls(table_of, odd_rows):
    docs = table_of(odd_rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(((i, len((t or "").encode()), len(ids_of(BYTES, t)), len(ids_of(BYTES, t)) > 1024) for i, t in odd_rows), key=key)
    assert sorted(map(tuple, count_tokens(docs).collect()), key=key) == want
    coded = encode(docs, decode_too=True)
    got = sorted((r.doc_id or 0, list(np.frombuffer(r.ids, "<u4")), r.decoded) for r in coded.collect())
    assert got == sorted((i or 0, ids_of(BYTES, t), t or "") for i, t in odd_rows)
    assert sorted((r.doc_id or 0, r.text) for r in decode(coded).collect()) == sorted((i or 0, t or "") for i, t in odd_rows)
    assert count_tokens(docs.limit(0)).count() == encode(docs.limit(0)).count() == 0


def test_packing_holds_every_id_once(table_of, odd_rows):
    docs = table_of(odd_rows)
    for sizes in ({}, {"tiers": (64, 32, 16), "block_tokens": 500, "step_tokens": 256}):
        rows = pack(docs, **sizes).collect()
        windows, found = {}, {}
        for r in rows:
            windows.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier))
            assert len(r.ids) == 4 * r.length > 0
        for parts in windows.values():
            ends = [o + n for o, n, _ in sorted(parts)]
            assert [o for o, _, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] == parts[0][2] and ends[-1].bit_count() == 1
        for r in rows:
            found.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
        held = sorted(hashlib.sha256(b"".join(x for _, x in sorted(set(p)))).hexdigest() for (i, _), p in found.items())
        want = {(i, len(ids_of(LOWER, t)) + 1): np.array([*ids_of(LOWER, t), 1], "<u4").tobytes() for i, t in odd_rows if i != 6}
        assert set(hashlib.sha256(x).hexdigest() for x in want.values()) <= set(held)
        assert sum(r.length for r in rows) == sum(len(ids_of(LOWER, t)) + 1 for _, t in odd_rows)
    assert pack(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_windows_are_full(lengths):
    pieces = [Piece(n, i, 0) for i, n in enumerate(lengths)]
    windows, rest = fill_windows(pieces, (64, 32, 16, 8))
    assert all(sum(p.length for p in w) == t for t, w in windows) and sum(p.length for p in rest) < 64
    tail = last_windows(rest)
    assert all(sum(p.length for p in w) == t and t.bit_count() == 1 for t, w in tail)
    spans = sorted((p.doc, p.start, p.length) for _, w in windows + tail for p in w)
    assert sum(n for *_, n in spans) == sum(lengths) and all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spans, spans[1:]))
