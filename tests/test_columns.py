"""Checks, naming, cleaning, paths and JSON expressions against plain Python."""

import json
import random
import re

from pyspark.sql import functions as F

from sieveline.functions import checks as K
from sieveline.functions import cleaning as CL
from sieveline.functions import constants as C
from sieveline.functions import json_values as J
from sieveline.functions import paths as P
from sieveline.operators import profiles as PR

CHOSEN = [
    None, "", " ", "\t\n", "a", "aB", "Ab", "A_B", "a_b", "_a", "__", "a__b", "https://h.x/a/b.git", "git@h:a/b", " git@h:a/b ", "ftp://x", "http:",
    "HTTP://X", "mailto:x", "nope:x", "http://h:8080/x", "http://h:80x/", "http://h:/", "a@b.co", "a@b.c", " a@b.com\n", "x.y", "..", "a..b", "a/b",
    "a\\b", "a b", "1.2.3.4", "256.1.1.1", "01.2.3.4", "1.2.3", "com.acme", "com.Acme", "SELECT 1", "ok -- x", "<SCRIPT>", "onload=", "é", "abc\n",
    '{"a": 1}', "[1]", "12", "{bad", "x" * 300, "  lead and trail  ", "a\r\nb\rc", "HTTPServer", "newInstance2Go", "tab\there",
]


def values():
    rnd = random.Random(9)
    return CHOSEN + ["".join(rnd.choice("aAzZ09_.-@/ \n\té:") for _ in range(rnd.randint(0, 12))) for _ in range(2000)]


def java_trim(s):
    return s.strip("".join(map(chr, range(33))))


def full(pattern):
    return lambda s: re.fullmatch(pattern, s, re.ASCII) is not None


def blank(s):
    return s is None or java_trim(s) == ""


def valid_json(s):
    try:
        json.loads(s)
        return True
    except ValueError:
        return False


MODELS = {
    "is_empty": lambda s: s is None or s == "",
    "is_blank": blank,
    "git_url": lambda s: not blank(s) and full(C.GIT_URL)(java_trim(s)),
    "email": lambda s: not blank(s) and full(C.EMAIL)(java_trim(s)),
    "alphanumeric": lambda s: not blank(s) and full("[a-zA-Z0-9]+")(s),
    "safe_file_name": lambda s: not blank(s) and ".." not in s and full("[a-zA-Z0-9._-]+")(s),
    "sql_marker": lambda s: not blank(s) and any(m in s.lower() for m in C.SQL_MARKERS),
    "xss_marker": lambda s: not blank(s) and any(m in s.lower() for m in C.XSS_MARKERS),
    "ipv4": lambda s: not blank(s) and full(C.IPV4)(s),
    "ascii": lambda s: s is None or s.isascii(),
    "java_package": lambda s: s is not None and full(C.JAVA_PACKAGE)(s),
    "java_class": lambda s: s is not None and full(C.JAVA_CLASS)(s),
}


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(8)


def test_text_checks(spark):
    texts = values()
    got = frame(spark, texts).select("id", *[K.TEXT_CHECKS[n]("t").alias(n) for n in MODELS]).collect()
    for r in got:
        for name, model in MODELS.items():
            assert r[name] == model(texts[r.id]), (name, texts[r.id])


def test_naming_checks(spark):
    texts = values()
    tests = {"camel": C.CAMEL_CASE, "pascal": C.PASCAL_CASE, "snake": C.SNAKE_CASE, "screaming_snake": C.SCREAMING_SNAKE_CASE}
    got = frame(spark, texts).select("id", *[PR.CONVENTIONS[n]("t").alias(n) for n in tests]).collect()
    for r in got:
        for name, pattern in tests.items():
            assert r[name] == (texts[r.id] is not None and full(pattern)(texts[r.id])), (name, texts[r.id])


def test_urls_and_json(spark):
    urls = {"https://h.x/a/b.git": True, "http:": True, "HTTP://X": True, "mailto:x": True, "nope:x": False, "x.y": False, "http://h:8080/x": True,
            "http://h:80x/": False, "http://h:/": True, "": False, None: False, "git@h:a/b": False, " http://x ": True}
    got = frame(spark, list(urls)).select("t", K.is_valid_url("t").alias("v")).collect()
    assert {r.t: r.v for r in got} == urls
    docs = {'{"a": 1}': True, "[1]": True, "12": True, "{bad": False, "": False, " ": False, None: False, '"x"': True}
    got = frame(spark, list(docs)).select("t", K.is_valid_json("t").alias("v")).collect()
    assert {r.t: r.v for r in got} == docs


def test_number_and_length_checks(spark):
    table = spark.createDataFrame([(v,) for v in (None, -1, 0, 1, 65535, 65536)], "n int")
    got = table.select("n", K.is_positive("n"), K.is_non_negative("n"), K.is_valid_port("n"), K.in_range("n", 0, 1)).collect()
    assert [tuple(r)[1:] for r in got] == [
        (False, False, False, False), (False, False, False, False), (False, True, False, True), (True, True, True, True),
        (True, True, True, False), (True, True, False, False)]
    texts = frame(spark, [None, "", "ab", "abc\n"])
    assert [r.v for r in texts.select("id", K.length_in_range("t", 2, 3).alias("v")).orderBy("id").collect()] == [False, False, True, False]
    assert [r.v for r in texts.select("id", K.matches_pattern("t", "[a-c]+").alias("v")).orderBy("id").collect()] == [False, False, True, False]
    assert texts.select(K.matches_pattern("t", None).alias("v")).first().v is False


def camel(s):
    out, up = "", False
    for ch in s:
        if ch == "_":
            up = True
        else:
            out, up = out + (ch.upper() if up else ch), False
    return out


def first_words(s, n):
    if s is None:
        return ""
    parts = re.split(r"[ \t\n\x0b\f\r]+", s)
    while len(parts) > 1 and parts[-1] == "":
        parts.pop()
    return " ".join(parts[:n])


def test_cleaning(spark):
    texts = values()
    got = frame(spark, texts).select(
        "id", CL.sanitize("t").alias("s"), CL.normalize_line_endings("t").alias("e"), CL.remove_whitespace("t").alias("w"),
        CL.truncate("t", 5).alias("c"), CL.first_words("t", 2).alias("f"), CL.sanitize_file_name("t").alias("n"),
        CL.camel_to_snake("t").alias("cs"), CL.snake_to_camel("t").alias("sc")).collect()
    for r in got:
        t = texts[r.id]
        assert r.f == first_words(t, 2), repr(t)
        assert r.n == ("unnamed" if not t else re.sub("[^a-zA-Z0-9._-]", "_", t))
        if t is None:
            assert (r.s, r.e, r.w, r.c, r.cs, r.sc) == (None,) * 6
            continue
        assert r.s == re.sub(r"[^\x20-\x7e]", "", t)
        assert r.e == t.replace("\r\n", "\n").replace("\r", "\n")
        assert r.w == re.sub(r"[ \t\n\x0b\f\r]+", "", t)
        assert r.c == (t if len(t) <= 5 else t[:2] + "...")
        assert r.cs == re.sub("([a-z])([A-Z])", r"\1_\2", t).lower()
        assert r.sc == camel(t), repr(t)


def test_paths(spark):
    cases = {  # path: extension, name, language, supported, skipped, kind, text
        "a/b.java": (".java", "b", "java", True, False, "source", True),
        "noext": ("", "noext", "unknown", False, False, "other", False),
        ".hidden": ("", ".hidden", "unknown", False, False, "other", False),
        "end.": ("", "end", "unknown", False, False, "other", False),
        "d.x/f": (".x/f", "f", "unknown", False, False, "other", False),
        "build/x.py": (".py", "x", "python", True, True, "source", True),
        "a/out/b.PY": (".PY", "b", "unknown", False, True, "other", True),
        "a/outer/b.c": (".c", "b", "unknown", True, False, "source", True),
        "x/.git": ("/.git".replace("/", ""), ".git", "unknown", False, True, "other", False),
        "p.tar.gz": (".gz", "p.tar", "unknown", False, False, "archive", False),
        "q.toml": (".toml", "q", "unknown", False, False, "config", False),
        "r.md": (".md", "r", "unknown", False, False, "other", True),
    }
    got = frame(spark, list(cases)).select(
        "t", P.file_extension("t"), P.name_without_extension("t"), P.detect_language("t"), P.is_supported("t"),
        P.in_skipped_directory("t"), P.file_kind("t"), P.is_text_file("t")).collect()
    assert {r.t: tuple(r)[1:] for r in got} == cases
    nulls = frame(spark, [None]).select(P.normalize_path("t"), P.file_extension("t"), P.name_without_extension("t"), P.is_supported("t")).first()
    assert tuple(nulls) == ("", "", "", False)


def test_json_values(spark):
    table = spark.createDataFrame([
        ('{"a": {"b": "x"}, "k": 1}', '{"k": null, "z": [1]}'), (None, '{"u": 1}'), ('{"m": 1}', None), ("{bad", '{"u": 1}')], "a string, b string")
    got = table.select(J.merge("a", "b").alias("m"), J.extract_value("a", "a.b").alias("x"), J.extract_value("a", "a.q").alias("q"),
                       J.parse_rows("a", "k int").alias("r")).collect()
    assert json.loads(got[0].m) == {"a": {"b": "x"}, "k": None, "z": [1]}
    assert (got[0].x, got[0].q, got[0].r.k) == ("x", None, 1)
    assert got[1].m == '{"u": 1}' and got[2].m == '{"m": 1}'
    assert got[3].r is None and got[3].x is None


def test_profile_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "t string")
    rows = PR.validation_profile(empty, {"t": PR.text_checks("t")}).collect()
    assert len(rows) == len(K.TEXT_CHECKS) and all((r.rows, r.passes, r.failures, r.share) == (0, 0, 0, 0.0) for r in rows)


def test_clean_text_steps(spark):
    table = spark.createDataFrame([("a\r\nb",)], "t string")
    assert PR.clean_text(table, "t", ("line_endings", lambda c: F.upper(c)), into="u").first().u == "A\nB"
