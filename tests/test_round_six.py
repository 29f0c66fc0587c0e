"""Archives wave by wave, their directories read as ``zipfile`` reads them, and pages of findings ranked by task or by prefix sums."""

import glob
import io
import struct
import zipfile
from urllib.parse import urlparse

import pytest

from fixtures import table_queries as TQ
from fixtures.registry import QUERIES
from sieveline.operators.java_tokens import method_facts_of
from sieveline.plans import report as RP
from sieveline.sources import archive_files as AF


@pytest.mark.parametrize("name", ["archive_tree", "archive_rejects"])
def test_only_the_archives_of_a_wave_lie_on_disk(spark, tmp_path, monkeypatch, name):
    keys = [(i, i % 23) for i in range(300)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    whole = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
    seen, plain, base = [], AF.archive_tree, urlparse(spark.conf.get("spark.checkpoint.dir")).path
    count = lambda: len(glob.glob(f"{base}/**/*.zip", recursive=True))
    before = count()

    def counted(*args, **options):
        seen.append(count() - before)
        return plain(*args, **options)

    monkeypatch.setattr(AF, "archive_tree", counted)
    monkeypatch.setattr(TQ, "_WAVE_FILES", 100)
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == whole and len(whole) > 100
    assert len(seen) == 3 and sum(seen) == 23 and max(seen) < 23 and count() == before


def bundled(entries, **options):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", **options) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return buffer.getvalue()


def test_directories_are_read_as_zipfile_reads_them(tmp_path):
    plain = bundled({"a/B.java": "x" * 50, "ü.py": "", "d/": "", "a/./b/../c.js": "y"}, compression=zipfile.ZIP_DEFLATED)
    with zipfile.ZipFile(io.BytesIO(plain)) as z:
        assert AF._listed(plain) == [(i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC, i.flag_bits) for i in z.infolist()]
    at = plain.index(b"PK\x01\x02")
    noted, ahead = bundled({"a.py": "1"}) + b"", b"prefix" + plain
    with zipfile.ZipFile(buffer := io.BytesIO(noted), "a") as z:
        z.comment = b"note"
    odd = [b"", b"nothing", plain[:-1], buffer.getvalue(), ahead, plain[:at] + b"XX" + plain[at + 2 :],
           plain[: at + 24] + struct.pack("<H", 9) + plain[at + 26 :][:0], plain[: at + 6] + b"\xff" + plain[at + 7 :]]
    assert [AF._listed(data) for data in odd] == [None] * len(odd)
    for i, data in enumerate((buffer.getvalue(), ahead, plain)):
        (tmp_path / f"{i}.zip").write_bytes(data)
    assert [[e[0] for e in AF._directory(f"file:{tmp_path}/{i}.zip")] for i in range(3)] == [
        ["a.py"], ["a/B.java", "ü.py", "d/", "a/./b/../c.js"], ["a/B.java", "ü.py", "d/", "a/./b/../c.js"]]


def _findings(spark):
    rows = [(f"job-{i % 7}" if i % 11 else None, ("LOW", "CRITICAL", "odd")[i % 3], ("SECURITY", "CODE_QUALITY", "ARCHITECTURE")[i % 4 % 3],
             f"t{i % 5}", "d", None, f"f{i % 13}", i % 17, f"r{i % 2}", "s") for i in range(400)]
    rows += [("job-big", "HIGH", "SECURITY", "t", "d", "r", f"f{i % 3}", i // 5, "r", "s") for i in range(250)]
    return spark.createDataFrame(rows, "job_id string, severity string, category string, title string, description string, recommendation string, "
                                       "file_path string, line_number int, rule_id string, source string")


def test_findings_of_small_jobs_are_ranked_without_tables(spark):
    base = urlparse(spark.conf.get("spark.checkpoint.dir")).path
    tables = lambda: len(glob.glob(f"{base}/numbering-*"))
    found, before = _findings(spark), tables()
    by_task = RP.finding_pages(found, page_size=10).collect()
    assert tables() == before
    # some jobs, or all of them, by prefix sums: the same pages
    for job_rows in (200, 1):
        assert sorted(map(repr, RP.finding_pages(found, page_size=10, job_rows=job_rows).collect())) == sorted(map(repr, by_task))
    assert tables() == before + 2
    sizes = {(r.job_id, r.page): len(r.security_findings) + len(r.quality_findings) + len(r.architecture_findings) for r in by_task}
    pages = {r.job_id: r.pages for r in by_task}
    assert len(pages) == 9 and sum(sizes.values()) == 650 and len(sizes) == sum(pages.values())
    assert all(n == 10 for (job, page), n in sizes.items() if page < pages[job] - 1)


def test_the_lines_of_tokens_are_those_of_line_feeds():
    text = "class A {\n\n  int m(int a,\x0b int b)\x0c {\r\n return a > 1 ? 1\x85 : 2; }\n}"
    assert method_facts_of(text) == [("m", 3, 4, 2, 2, 0)]
