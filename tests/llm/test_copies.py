import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm.components import components
from sieveline.llm.fm_dedup import WaveletMatrix, dedup_substrings
from sieveline.llm.fm_dedup import repeated_spans as by_index
from sieveline.llm.ngram_join import jaccard_classes
from sieveline.llm.set_trie import jaccard_components
from sieveline.llm.suffix_dedup import dedup_suffixes
from sieveline.llm.tables import table

WORD = re.compile("[^\x20\x09-\x0D]+")


def classes(rows):
    """Brute force over all pairs of rows that share a shingle."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = [WORD.findall(lower(t)) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set() for w in words]
    at = list(range(len(rows)))

    def top(i):
        return i if at[i] == i else top(at[i])

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                at[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(top(i), []).append(doc)
    out = [(d, len(s), min((x for x in least[top(i)] if x is not None), default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    return sorted(map(repr, out))


@pytest.mark.parametrize("sizes", [{}, {"per_bucket": 300, "per_group": 150}, {"per_bucket": 300, "per_group": 150, "rounds": 0}])
def test_jaccard_classes_of_odd_rows(table_of, odd_rows, sizes):
    docs = table_of(odd_rows)
    assert sorted(repr(tuple(r)) for r in jaccard_classes(docs, **sizes).collect()) == classes(odd_rows)
    assert jaccard_classes(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 11), min_size=1), min_size=1, max_size=14, unique=True), st.sampled_from([50, 75, 90]))
def test_trie_finds_all_links(sets, percent):
    found = jaccard_components([np.array(sorted(s), np.uint64) for s in sets], percent)
    at = list(range(len(sets)))
    for _ in sets:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if 100 * len(x & y) >= percent * len(x | y):
                    at[i] = at[j] = min(at[i], at[j])
    assert all((found[i] == found[j]) == (at[i] == at[j]) for i in range(len(sets)) for j in range(i))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (-5, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, -5: -5, 300: -5}


def without_repeats(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append(repr((doc, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(out)


@pytest.mark.parametrize("dedup", [dedup_substrings, dedup_suffixes])
def test_repeats_of_odd_rows(spark, table_of, odd_rows, dedup):
    docs = table_of(odd_rows)
    for window in (12, 35):
        for sizes in ({}, {"per_shard": 50, "per_anchor": 1}):
            got = dedup(docs, window=window, **sizes).select("doc_id", "n_words", "n_removed", "kept").collect()
            assert sorted(repr(tuple(r)) for r in got) == without_repeats(odd_rows, window)
    assert dedup(docs.limit(0)).count() == 0
    plain = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    got = dedup(spark.createDataFrame(plain, "doc_id long, text string"), window=20).select("doc_id", "n_words", "n_removed", "kept")
    assert sorted(repr(tuple(r)) for r in got.collect()) == without_repeats(plain, 20)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=4, max_size=16), st.integers(1, 3)), min_size=1, max_size=6, unique_by=lambda x: tuple(x[0])))
def test_index_finds_what_occurs_twice(segments):
    pieces, copies = [np.array(p, np.int32) for p, _ in segments], np.array([c for _, c in segments])
    seen = Counter()
    for p, c in segments:
        for i in range(len(p) - 3):
            seen[tuple(p[i : i + 4])] += c
    for (p, _), spans in zip(segments, by_index(pieces, copies, np.zeros(len(pieces)), 4, 3)):
        got = {j for a, b in spans for j in range(a, b)}
        assert got == {j for i in range(len(p) - 3) if seen[tuple(p[i : i + 4])] > 1 for j in range(i, i + 4)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=300))
def test_wavelet_ranks(values):
    matrix, at = WaveletMatrix(np.array(values), 9), np.arange(len(values) + 1)
    for symbol in set(values):
        assert matrix.rank(np.full(len(at), symbol), at).tolist() == [values[:i].count(symbol) for i in at]


@pytest.mark.parametrize("dedup", [dedup_substrings, dedup_suffixes])
def test_many_equal_rows_take_linear_work(spark, dedup):
    """2,000 rows equal in text, half of them in doc_id too, and as many without any: work grows with their number, not its square."""
    text = " ".join(f"w{i * 7919 % 1500}" for i in range(1500))
    n = spark.range(2000)
    docs = n.select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.lit(text).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(1, "x " + text[:2000] + " y"), (2, "nothing here repeats")], "doc_id long, text string"))
    began = time.time()
    rows = dedup(docs).select("doc_id", "n_words", "n_removed").collect()
    assert time.time() - began < 90
    assert len(rows) == 2002 and all(r.n_removed == r.n_words for r in rows if r.doc_id in (None, 7))
    assert [r.n_removed for r in rows if r.doc_id == 2] == [0] and all(0 < r.n_words - r.n_removed < 5 for r in rows if r.doc_id == 1)
