import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from sieveline.llm.resampling import Grams, grams, intern, resample


def features(text, longest):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent, buckets, longest, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, longest)[1]) for texts in ([x for _, x in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets))))
    rows = []
    for i, text in docs:
        n, fs = features(text, longest)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain(bucket(f)) for f in fs)
        rows.append((i, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = able[: percent * len(able) // 100]
    out = [(*(r[j] for j in (0, 2, 3, 4)), k) for k, r in enumerate(drawn, 1)]
    rest = able[len(drawn) :] + [r for r in rows if r[1] < least]
    return out + [(*(r[j] for j in (0, 2, 3, 4)), None) for r in rest]


def same(got, want):
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


def test_resampling_equals_brute_force(spark, table_of, odd_rows):
    docs = table_of(odd_rows * 2)
    target = ["the river runs past old mills", None, "", "again and again we go on", "Ünï çødé"]
    for longest, percent, buckets, least in ((1, 30, 10_000, 20), (3, 50, 97, 3)):
        frame = spark.createDataFrame([(t,) for t in target], "text string")
        got = resample(docs, frame, percent, buckets, longest, least)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        same(got.collect(), brute(odd_rows * 2, target, percent, buckets, longest, least))


def test_resampling_without_target_and_without_rows(spark, table_of, odd_rows):
    docs, none = table_of(odd_rows), spark.createDataFrame([], "text string")
    same(resample(docs, none).collect(), brute(odd_rows, [], 10, 10_000, 1, 20))
    assert resample(docs.limit(0), none).count() == 0


def test_table_tells_grams_apart_where_keys_meet(monkeypatch):
    """All keys equal: only the comparison of bytes can tell the n-grams apart."""
    monkeypatch.setattr("sieveline.llm.resampling.xxh64_intdigest", lambda b: 7)
    words = ("ab", "b", "abc", "ab", "a", "b", "ab")
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    found = intern(Grams(raw, starts, ends, np.zeros(7, int), np.array([7])), 1000)
    assert len({(w, s) for w, s in zip(words, found.slot.tolist())}) == 4 == len(set(found.slot.tolist()))
    assert [found.count[s] for s in found.slot] == [3, 2, 1, 3, 1, 2, 3]
    assert [found.bucket[s] for s in found.slot] == [zlib.crc32(w.encode()) % 1000 for w in words]


def test_words_end_with_their_document():
    data = np.frombuffer("ab".encode() + b"c d" + b"" + b"E1 f", np.uint8)
    g = grams(data, np.array([0, 2, 5, 5, 9]), 2)
    assert [g.data[a:b].tobytes() for a, b in zip(g.starts, g.ends)] == [b"ab", b"c", b"d", b"e1", b"f", b"c d", b"e1 f"]
    assert g.document.tolist() == [0, 1, 1, 3, 3, 1, 3] and g.n_words.tolist() == [1, 2, 0, 2]
