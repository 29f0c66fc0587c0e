"""Whole JSON in the profile, and work that stays even on large tables."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from sieveline.functions import checks as K
from sieveline.operators import profiles as PR
from sieveline.sources import archive_files as AF
from sieveline.sources import archives as AR
from sieveline.sources.partitions import spread

WHOLE = ["8294", ' {"a":1,"a":{"b":2,"b":3}} ', "[1, [2]]\n", '"x"', "null", "-1.5e3", "[]", "{}"]
NOT_WHOLE = ["8294 and words", '{"a":1} rest', "1,2", '1,"b":2', "1] x [2", '{"a":1},{"a":2}', "1}", "[1]]", '"x" "y"', "x", "", " ", None]


def test_json_in_a_profile_is_the_whole_text(spark):
    texts = spark.createDataFrame([(t,) for t in WHOLE + NOT_WHOLE], "t string")
    rows = texts.select("t", K.TEXT_CHECKS["json"]("t").alias("ok")).collect()
    assert {r.t for r in rows if r.ok} == set(WHOLE) and all(r.ok is not None for r in rows)
    profile = {r.check: r.passes for r in PR.validation_profile(texts, {"t": PR.text_checks("t")}).collect()}
    assert profile["json"] == len(WHOLE)


def test_a_value_that_repeats_is_checked_once(spark):
    words = ["a@b.cd", "x", "x", "12", "12", "12", "", None, None, "true", "tru", "-", "+1", "NaN", "http://h"]
    table = spark.createDataFrame([(w,) for w in words], "w string")
    each = PR.validation_profile(table, {"w": PR.text_checks("w")}).collect()
    assert sorted(PR.value_profile(table, "w", PR.text_checks("w")).collect()) == sorted(each)
    assert {r.check: r.passes for r in each}["json"] == 4
    empty = PR.value_profile(table.limit(0), "w", PR.text_checks("w")).collect()
    assert {(r.rows, r.passes, r.share) for r in empty} == {(0, 0, 0.0)}


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    spark.range(100_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    with_splits = spark.read.parquet(str(tmp_path / "t")).unionByName(*[spark.range(0, 1, 1, 16)])  # many partitions, one of them full
    sizes = [r["count"] for r in spread(with_splits, task_rows=5_000).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 100_001 and len(sizes) >= 20 and max(sizes) <= 5_200


def _archive(entries, method=zipfile.ZIP_DEFLATED):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", method) as bundle:
        for name, data in entries.items():
            bundle.writestr(name, data)
    return buffer.getvalue()


def test_directories_of_small_archives_share_a_batch(tmp_path):
    for i in range(50):
        (tmp_path / f"{i}.zip").write_bytes(_archive({"a.java": "x", "b.java": "y"}))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    names = [*[f"{i}.zip" for i in range(50)], "bad.zip"]
    batches = list(AF._directories([pd.DataFrame({"archive": names, "uri": [str(tmp_path / n) for n in names]})]))
    assert len(batches) == 1 and len(batches[0]) == 101
    assert list(batches[0]["reject_reason"].dropna()) == ["not a zip archive"]


def test_entries_taken_at_once_are_those_zipfile_reads():
    texts = {"a.java": "class A {}", "ü/é.java": "x" * 5000, "empty.py": "", "odd.py": b"\xff"}
    plain = _archive(texts)
    renamed = plain.replace(b"a.java", b"b.java", 1)  # the name in front of the entry is not that of the directory
    damaged = bytearray(_archive({"a.java": "class A {}"}, zipfile.ZIP_STORED))
    damaged[damaged.index(b"class")] ^= 1
    other = _archive(texts, zipfile.ZIP_BZIP2)
    prefixed = b"#!/bin/sh\n" + plain
    for data in (plain, renamed, bytes(damaged), other, prefixed, plain[:60] + b"\0" * 8 + plain[68:]):
        want = []
        with zipfile.ZipFile(io.BytesIO(data)) as bundle:
            for info in bundle.infolist():
                try:
                    want.append((info.filename, bundle.read(info).decode("utf-8"), None))
                except UnicodeDecodeError:
                    want.append((info.filename, None, "not text"))
                except Exception:
                    want.append((info.filename, None, "unreadable entry"))
        got = pd.concat(AR._entries([pd.DataFrame({"archive": ["z"], "content": [data]})]))
        rows = got[["entry_path", "content", "reject_reason"]].astype(object)
        assert [tuple(r) for r in rows.where(rows.notna(), None).itertuples(index=False)] == want


def test_names_are_resolved_only_where_they_must_be(spark):
    names = {"a/b": "a/b", "./a": "a", "a//b": "a/b", "a/../b": "b", "a/.": "a", "": "", "a..b/c": "a..b/c", "a/b/": "a/b", ".x/y": ".x/y", "...": "..."}
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", AR.normal_form("p").alias("n"), AR.escapes_root("p").alias("e")).collect()
    assert {r.p: r.n for r in rows} == names and not any(r.e for r in rows)
    outside = spark.createDataFrame([(n,) for n in ("/a", "..", "a/../../b")], "p string").select(AR.escapes_root("p").alias("e")).collect()
    assert all(r.e for r in outside)
