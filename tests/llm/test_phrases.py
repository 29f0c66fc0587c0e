import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sieveline.llm.phrases import LONGEST, best_phrases, collocations, dictionary, parse



def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 300)


def pieces(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split("[.,;:!?\x0A-\x0D]", text) if (w := re.findall("[^\x20\x09]+", p))]


def counts(rows):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, LONGEST + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def brute(f, n, least, top, percent):
    out = []
    for lang, of in f.items():
        frequent = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + m] for q, a in frequent.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * a >= percent * of[q[i : i + m]]}
        rows = []
        for p, a in frequent.items():
            if p not in gone:
                score, k = min((2000000 * a // (of[p[:k]] + of[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), p, k))
        for rank, (score, a, _, p, k) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, " ".join(p), -a, of[p[:k]], of[p[k:]], n[lang], -score))
    return out


def same(got, want):
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


def test_collocations_equal_brute_force(spark, table_of, odd_rows):
    docs = table_of(odd_rows * 3).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "ünd"))
    rows = [(None if i is None or i % 3 == 2 else "en" if i % 3 == 0 else "ünd", t) for i, t in odd_rows * 3]
    f, n = counts(rows)
    for least, top, one_in in ((3, 2000, 16), (9, 7, 1), (6, 50, 10**6)):
        got = collocations(docs, least, top, one_in)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        want = brute(f, n, least, top, 80)
        assert want
        same(got.collect(), want)
    assert collocations(docs.limit(0)).count() == 0


def test_a_run_of_one_word_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "so " * 500 + "\x0b" + "so it is. " * 40, 1, "x")], "lang string, text string, n long, chunk string")
    f, n = counts([(None, r.text) for r in docs.collect()])
    same(collocations(docs).collect(), brute(f, n, 30, 2000, 80))


def test_chunks_own_each_position_once(spark):
    texts = [prose(s, 400).replace("7 ", "7, ") for s in range(5)] + ["", ". , !", "a\tb  c.d"]
    rows = [("en", t) for t in texts] * 3
    f, n = counts(rows)
    found, words = Counter(), 0
    for r in dictionary(spark.createDataFrame(rows, "lang string, text string"), 4).collect():
        w = r.chunk.split(" ")
        assert r.owned == len(w) or r.owned == len(w) - 3
        words += r.n * r.owned
        for k in range(1, 5):
            for i in range(min(r.owned, len(w) - k + 1)):
                found[tuple(w[i : i + k])] += r.n
    assert found == f["en"] and words == n["en"]


def test_neighbours_share_a_trigger():
    raw = " ".join(f"w{i * i % 31}" for i in range(300)).encode()
    document, chunks, owned = parse(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 5)
    texts = [c.split() for c in chunks.to_pylist()]
    assert len(texts) > 5 and not document.any() and owned.sum() == 300
    assert all(a[-3:] == b[:3] for a, b in zip(texts, texts[1:]))


def test_products_past_64_bits_stay_exact(spark):
    big = 9 * 10**15 + 1
    counted = [("en", "a", 1, big + 7), ("en", "b", 1, big + 9), ("en", "c", 1, big), ("en", "a b", 2, big - 1), ("en", "b c", 2, big), ("en", "a b c", 3, big * 8 // 10)]
    frame = spark.createDataFrame(counted, "lang string, phrase string, size int, a long")
    got = best_phrases(frame, spark.createDataFrame([("en", 4 * big)], "lang string, n long"), 10, 80).collect()
    of = {tuple(p.split()): a for _, p, _, a in counted}
    same(got, brute({"en": of}, {"en": 4 * big}, 30, 10, 80))
    assert sorted(r.phrase for r in got) == ["a b c", "b c"]  # 80 % of "a b" to the unit, just less of "b c"


def test_a_full_bit_table_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr("sieveline.llm.phrases._LEAST_BITS", 15)
    monkeypatch.setattr("sieveline.llm.phrases._MOST_BITS", 15)
    rows = [("en", prose(s, 3000)) for s in range(4)]
    f, n = counts(rows)
    same(collocations(spark.createDataFrame(rows, "lang string, text string"), 2).collect(), brute(f, n, 2, 2000, 80))
