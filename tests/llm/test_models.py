import re
from collections import Counter

import numpy as np
import pytest

from sieveline.llm.html_text import extract, main_text
from sieveline.llm.quality import RULES, fit, quality
from sieveline.llm.tables import table
from sieveline.llm.toxicity import fit_ordinal, toxicity
from sieveline.llm.vector_tree import nearest

WORD = re.compile("[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality_measures_and_votes(table_of, odd_rows):
    docs = table_of(odd_rows)
    got = quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = [(i, *(b := base(t)), b[0] < 20 or 100 * b[4] > 30 * b[0]) for i, t in odd_rows]
    assert sorted(repr(tuple(r)[:7]) for r in got) == sorted(map(repr, want))
    assert not any(r.kept and r.base_failed for r in got)
    assert quality(docs.limit(0)).count() == 0


def test_posterior_agrees_with_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    rows = quality(docs).where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.98 * len(rows)


def test_estimates_find_the_good_rule():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.7
    right, noise = np.where(rng.random(4000) < 0.95, truth, ~truth), rng.random(4000) < 0.5
    also = np.where(rng.random(4000) < 0.9, truth, ~truth)
    counts = Counter(tuple(2 * int(x) - 1 for x in v) for v in zip(right, noise, also))
    model = fit(sorted(counts.items()), 3)
    assert model.good[0] > 1.5 and model.bad[0] < -1.5 and model.good[1] < 0.5 and model.bad[1] > -0.5
    assert fit([], len(RULES)).good == (0.0,) * len(RULES)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    scored = toxicity(docs, labels.where("doc_id % 2 = 0"))
    rows = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").select("rejected", "toxic", "expected_severity", "grade").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.rejected for r in toxic) >= 0.9 * len(toxic) and sum(r.rejected for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.expected_severity <= 3 for r in rows) and len({r.grade for r in toxic}) > 2


def test_toxicity_of_odd_rows(spark, table_of, odd_rows):
    docs, schema = table_of(odd_rows), "doc_id long, toxic int"
    none = spark.createDataFrame([], schema)
    some = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (5, 0), (7, 0), (None, 1), (99, 1), (8, None)], schema)
    for labels in (none, some):
        rows = toxicity(docs, labels).collect()
        assert len(rows) == len(odd_rows) and all(r.expected_severity is not None for r in rows)
    assert not any(r.rejected for r in toxicity(docs, none).collect())
    assert toxicity(docs.limit(0), some).count() == 0


def test_ordinal_thresholds_share_weights():
    rng = np.random.default_rng(2)
    x = rng.normal(size=600)
    grades = (x > -0.5).astype(int) + (x > 0.5) + (x > 1.5)
    w, thresholds = fit_ordinal(np.arange(600), np.zeros(600, int), x, grades, 1, 4)
    assert w[0] > 2 and (np.diff(thresholds) > 0).all() and np.allclose(thresholds / w[0], [-0.5, 0.5, 1.5], atol=0.15)


def exact(rows, every, k):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    size = Counter(len(v) for _, v in rows).most_common(1)[0][0]
    best = {}
    for q, x in rows:
        if q % every == 0 and len(x) == size:
            for i, y in rows:
                if i != q and len(y) == size:
                    best[q, i] = max(best.get((q, i), -np.inf), float(x @ y))
    out = {}
    for (q, i), s in best.items():
        out.setdefault(q, []).append((-s, i))
    return {q: sorted(v)[:k] for q, v in out.items()}


def test_nearest_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(60)] + [(i, [1.0] * 8) for i in range(60, 90)]
    rows += [(20, rows[20][1]), (21, [9.0] * 8), (100, None), (101, []), (102, [0.0] * 8), (103, [1.0, None] * 4), (104, [float("nan")] * 8), (105, [float("inf")] * 8), (106, [1.0] * 3), (None, [1.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as leaf")
    for sizes in ({}, {"chunk_rows": 7, "chunk_queries": 2}):
        got = {}
        for r in nearest(vectors, recall=1.0, leaf_rows=4, **sizes).collect():
            got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
        want = exact(rows, 20, 20)
        assert got.keys() == want.keys()
        found = sum(len({i for *_, i in got[q]} & {i for _, i in want[q]}) for q in want)
        assert found >= 0.9 * sum(map(len, want.values()))
        for q, v in got.items():
            v.sort()
            assert [r for r, *_ in v] == [*range(1, len(v) + 1)] and len(v) == 20 and v == sorted(v, key=lambda x: (round(x[1], 9), x[2]))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest(few).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert nearest(few.limit(0)).count() == nearest(few.where("vec_id = 0")).count() == 0


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    got = {}
    for r in nearest(table(spark, "/root/testdata/sf0.01", "embeddings")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(rows, 20, 20)
    assert sum(len(got[q] & {i for _, i in v}) for q, v in want.items()) >= 0.9 * sum(map(len, want.values()))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, really, many of them, to track you.</p></div>
<main><h1>Title &amp; more</h1><p>First paragraph, with a <a href="#">link</a>, and some more words to read.<br>After a break.
<p>Second one&nbsp;here, &#8220;quoted&#8221;, and long enough to be worth points, too.</p><div class="ad"><p>Buy this, buy that, buy it all, right now, please.</p></div>
<p>Short.</p><form><p>Your name, your mail, your money, all of it in this form.</p></form><ul><li>A point, made briefly</li></ul></main>
<div id="comments"><p>First! I disagree, strongly, with all of this, and more.</p></div><aside><p>Related, but elsewhere, and not wanted here, at all.</p></aside>
<footer>&copy; nobody</footer></body></html>"""


def test_article_of_a_full_page():
    assert main_text(PAGE) == "Title & more\nFirst paragraph, with a link, and some more words to read. After a break.\n" \
        "Second one here, “quoted”, and long enough to be worth points, too.\nShort.\nA point, made briefly"


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<p", ""), ("plain words", "plain words"), ("<div><p>a<b>c</p><p>d", "ac\nd"), ("<script>x", ""), ("a < b &lt; c &amp d", "a < b < c & d")])
def test_small_pages(page, text):
    assert main_text(page) == text


def test_pages_of_the_table(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    html_of = {r.page_id: r.html for r in pages.collect()}
    import html

    for r in extract(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", html_of[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("<p>|</p>|<h1>|</h1>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p>" + "long, " * 200_000), (2, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in extract(odd).collect()) == [0, 0, 1, 6 * 200_000 - 1]
    assert extract(odd.limit(0)).count() == 0
