"""Masking, lines, line numbers and chunks against plain models, on chosen and random texts."""

import random
import re

from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators import chunks as CH
from sieveline.operators import matching, metrics

EDGES = [
    "", "\n", "a\n\n\n", "a\r\nb", 'x = "unterminated\nnext', "c = 'u\nnext", "/* open\nto the end", '"a \\" b" c', '"a\\\nb"',
    "/*/ x */ y", "/*/", "//", "/", "'\"' + '\\''", "é \"ü\" // ö\nß", "a /* b */ c // d\n\"e\" 'f'", "\n\n", " \n \n", "//a\\\nb",
]


def random_texts(n, alphabet, seed, length=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, length))) for _ in range(n)]


def model_mask(text, keep_literals=False):
    """Character by character."""
    out, i, state = [], 0, "code"
    while i < len(text):
        ch, two = text[i], text[i:i + 2]
        if state == "code":
            if two in ("//", "/*"):
                state = "line" if two == "//" else "block"
                out.append("  ")
                i += 2
                continue
            if ch in "\"'":
                state = ch
                out.append(ch if keep_literals else " ")
            else:
                out.append(ch)
        elif state == "line":
            out.append("\n" if ch == "\n" else " ")
            state = "code" if ch == "\n" else state
        elif state == "block":
            if two == "*/":
                out.append("  ")
                i += 2
                state = "code"
                continue
            out.append("\n" if ch == "\n" else " ")
        else:
            if ch == "\n":
                out.append(ch)
                state = "code"
            elif ch == "\\" and i + 1 < len(text) and text[i + 1] != "\n":
                out.append(text[i:i + 2] if keep_literals else "  ")
                i += 2
                continue
            else:
                out.append(ch if keep_literals else " ")
                state = "code" if ch == state else state
        i += 1
    return "".join(out)


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(8)


def test_mask_equals_the_model(spark):
    texts = EDGES + random_texts(5000, "ab/*\"'\\\n ", 1)
    got = rows(spark, texts).select("id", T.mask_source("t").alias("m"), T.mask_source("t", True).alias("k")).collect()
    for r in got:
        text = texts[r.id]
        assert r.m == model_mask(text), repr(text)
        assert r.k == model_mask(text, True), repr(text)
        assert len(r.m) == len(text) and [i for i, c in enumerate(r.m) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]


def test_mask_of_a_very_long_literal(spark):
    text = 'a = "' + "x\\\"" * 200_000 + '"; b'
    masked = spark.createDataFrame([(text,)], "t string").select(T.mask_source("t").alias("m")).first().m
    assert masked == "a = " + " " * (len(text) - 7) + "; b"


def java_lines(text):
    parts = text.split("\n")
    if text == "":
        return 1
    while parts and parts[-1] == "":
        parts.pop()
    return len(parts)


def test_line_count(spark):
    texts = EDGES + random_texts(2000, "a \n", 2, 12)
    for r in rows(spark, texts).select("id", T.line_count("t").alias("n"), T.line_count("t", 0).alias("z")).collect():
        assert r.n == java_lines(texts[r.id])
        assert r.z == (java_lines(texts[r.id]) if texts[r.id] else 0)


def test_match_lines_agree_with_offsets(spark):
    texts = random_texts(3000, "ab+;\n ", 3)
    pattern = r"a[^;]*\+[^;]*b|b\s+a"
    got = rows(spark, texts).select("id", T.match_start_lines("t", pattern).alias("n")).collect()
    for r in got:
        want = sorted({texts[r.id].count("\n", 0, m.start()) + 1 for m in re.finditer(pattern, texts[r.id])})
        assert r.n == want, repr(texts[r.id])


def test_explode_lines_keeps_blanks(files):
    lines = matching.explode_lines(files({"a": "x\r\ny\rz\n\n"})).orderBy("line_number").collect()
    assert [(r.line_number, r.line) for r in lines] == [(1, "x"), (2, "y"), (3, "z"), (4, ""), (5, "")]


def model_lines(text):
    """(is_code, is_comment, is_blank) line by line, carrying the comment flag along."""
    out, inside = [], False
    for line in text.rstrip("\n").split("\n"):
        cut = line.strip("".join(map(chr, range(33))))
        before = inside
        if "/*" in cut:
            inside = True
        if "*/" in cut:
            inside = False
        slashes = cut.startswith("//")
        out.append((
            not inside and "*/" not in cut and cut != "" and not slashes,
            before or slashes or "/*" in cut,
            re.fullmatch(r"[ \t\n\x0b\f\r]*", line) is not None,
        ))
    return out


def test_line_classes_and_metrics_equal_the_model(spark):
    texts = [t for t in EDGES + random_texts(6000, "a/* \n", 4) if t.strip("\n")]
    table = rows(spark, texts)
    got = {}
    for r in metrics.line_classes(table, keys=("id",), content="t").collect():
        got.setdefault(r.id, {})[r.line_number] = (r.is_code, r.is_comment, r.is_blank)
    for i, text in enumerate(texts):
        want = model_lines(text)
        assert [got[i][n + 1] for n in range(len(want))] == want, repr(text)
    for r in metrics.file_metrics(table, keys=("id",), content="t").collect():
        want = model_lines(texts[r.id])
        assert (r.lines, r.loc, r.comment_lines, r.blank_lines) == (len(want), *[sum(c) for c in zip(*want)]), repr(texts[r.id])


def test_metrics_of_nothing(spark):
    table = spark.createDataFrame([(0, None), (1, ""), (2, "\n\n")], "id int, t string")
    for r in metrics.file_metrics(table, keys=("id",), content="t").collect():
        assert (r.lines, r.loc, r.comment_lines, r.blank_lines, r.methods) == (0, 0, 0, 0, 0)
        assert r.maintainability == 100.0 and r.comment_density == 0.0 and not r.adequate_comments
        assert r.complexity == (1 if r.id == 2 else 0)


def test_complexity_as_coded_counts_every_position(spark):
    table = spark.createDataFrame([("a || b",)], "t string")
    plain, raw = table.select(metrics.estimated_complexity("t"), metrics.estimated_complexity("t", True)).first()
    assert plain == 2 and raw > len("a || b")


def model_chunks(text, size, step):
    if len(text) <= size:
        return [(0, 1, text, 1, java_lines(text))]
    n = -(-len(text) // step)
    return [(i, n, text[i * step:i * step + size], java_lines(text[:i * step]), java_lines(text[:i * step + size])) for i in range(n)]


def test_chunks_equal_the_model(spark):
    texts = EDGES + random_texts(400, "ab\n\n\né", 5, 400) + ["\n" * 300, "x" * 8000, "x" * 8001, "y" * 14401]
    table = rows(spark, texts)
    for size, overlap in ((50, 0.1), (20, 0.5), (33, 0.0), (8000, 0.1)):
        step = size - int(size * overlap)
        got = {}
        for r in CH.chunk_text(table, ("id",), "t", size, overlap).collect():
            got.setdefault(r.id, []).append((r.chunk_index, r.total_chunks, r.content, r.start_line, r.end_line))
        for i, text in enumerate(texts):
            chunks = sorted(got[i])
            assert chunks == model_chunks(text, size, step), (size, repr(text[:60]))
            assert "".join(c[2][:step] for c in chunks[:-1]) + chunks[-1][2] == text


def test_contained_tail(spark):
    table = spark.createDataFrame([(0, "y" * 14401)], "id int, t string")
    assert CH.chunk_text(table, ("id",), "t").count() == 3
    assert CH.chunk_text(table, ("id",), "t", skip_contained_tail=True).count() == 2


def test_count_occurrences(spark):
    texts = ["aaaa", "", "banana", "aXa"]
    got = rows(spark, texts).select("id", T.count_occurrences("t", "aa").alias("n")).collect()
    assert {texts[r.id]: r.n for r in got} == {t: t.count("aa") for t in texts}
    assert rows(spark, ["x"]).select(T.count_occurrences("t", "").alias("n"), T.count_occurrences(F.lit(None).cast("string"), "a").alias("m")).first() == (0, 0)


def test_class_count_equals_the_full_pattern(spark):
    from sieveline.functions.constants import CLASS_PATTERN

    rnd = random.Random(6)
    words = ["class", "public", "static", "final", "abstract", " ", "  ", "\n", "X", "y1", "{", "subclass", "private"]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    for r in metrics.file_metrics(rows(spark, texts), keys=("id",), content="t").collect():
        assert r.classes == len(list(re.finditer(CLASS_PATTERN, texts[r.id], re.ASCII))), repr(texts[r.id])
