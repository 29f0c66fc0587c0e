"""Replies, requests, archives, trees, job states, reports and streams."""

import io
import json
import os
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sieveline.functions import constants as C
from sieveline.operators import chunks as CH
from sieveline.operators import findings as FN
from sieveline.operators import replies as R
from sieveline.operators.rule_catalog import rules_frame, rules_from_frame
from sieveline.plans import jobs as JB
from sieveline.plans import report as RP
from sieveline.plans import scan
from sieveline.session import shared_folder
from sieveline.sources import archives as AR
from sieveline.sources import requests as RQ
from sieveline.sources import trees as TR
from sieveline.streaming import runs as ST

REPLY = "job_id string, file_path string, chunk_index int, provider string, reply string"


def replies(spark, *texts):
    return spark.createDataFrame([("j", "f", i, "beta", t) for i, t in enumerate(texts)], REPLY)


def test_chunk_replies(spark):
    fence = "```json\n%s\n```"
    texts = [
        fence % '{"summary": "s", "findings": [{"title": "t", "description": "d", "recommendation": "r", "severity": "high", "lineHint": 7}]}',
        '{"findings": [{"severity": "critical", "lineHint": "42"}, {"lineHint": null}, {"lineHint": "x"}, {}]}',
        "no json", "", '{"summary": null, "findings": 3}', "[1]",
    ]
    parsed = R.parse_chunk_replies(replies(spark, *texts))
    assert {r.chunk_index: r.summary for r in parsed.collect()} == {
        0: "s", 1: C.NO_SUMMARY, 2: C.UNPARSED_CHUNK, 3: C.NO_SUMMARY, 4: C.NO_SUMMARY, 5: C.NO_SUMMARY}
    rows = R.reply_findings(parsed).collect()
    assert sorted((r.severity, r.title, r.line_number is None, r.line_number) for r in rows) == sorted([
        ("HIGH", "t", False, 7), ("CRITICAL", "", False, 42), ("INFO", "", False, 0), ("INFO", "", False, 0), ("INFO", "", True, None)])
    assert len({r.rule_id for r in rows}) == 5 and all(r.rule_id.startswith("LLM-ARCH-") and r.source == "LLM_BETA" for r in rows)
    again = R.reply_findings(parsed).collect()
    assert sorted(r.rule_id for r in again) == sorted(r.rule_id for r in rows)


def test_envelopes(spark):
    bodies = ['{"content": [{"text": "a"}]}', '{"choices": [{"message": {"content": "b"}}]}', '{"results": [{"generated_text": "c"}]}', "{}", "x", None]
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select(R.response_text("b").alias("t")).collect()
    assert [r.t for r in got] == ["a", "b", "c", None, None, None]


def test_request_bodies(spark):
    prompts = spark.createDataFrame([('say "hi"\n',)], "prompt string")
    chat = json.loads(CH.inference_requests(prompts, "messages", "m").first().body)
    assert chat == {"model": "m", "max_tokens": 2000, "messages": [{"role": "user", "content": 'say "hi"\n'}]}
    plain = json.loads(CH.inference_requests(prompts, "input", "m", "p").first().body)
    assert plain == {"model_id": "m", "project_id": "p", "input": 'say "hi"\n',
                     "parameters": {"max_new_tokens": 2000, "temperature": 0.2, "top_p": 0.9}}
    with pytest.raises(ValueError):
        CH.inference_requests(prompts, "other")


def test_prompt_fields(spark):
    chunks = spark.createDataFrame([("f.py", 1, 3, "co{file}de", "python", 5, 9)],
                                   "file_path string, chunk_index int, total_chunks int, content string, language string, start_line int, end_line int")
    text = CH.chunk_prompts(chunks).first().prompt
    assert text.startswith(f"Excerpt 2/3 of f.py, lines 5-9, written in python. It belongs to {C.PROMPT_PROJECT}.") and "co{file}de" in text
    assert "It belongs to Shop." in CH.chunk_prompts(chunks, "Shop").first().prompt


def test_project_prompts_hold_every_summary_once(spark):
    """One project with a third of everything and more is split; small ones stay whole and ordered."""
    rows = [("big", f"f{i % 300}", i // 300, f"s{i}") for i in range(3000)] + [("small", f, i, f"{f}{i}") for f in "ba" for i in (10, 2)]
    table = spark.createDataFrame(rows, "job_id string, file_path string, chunk_index int, summary string")
    got = CH.project_prompts(table, per_prompt=100, template="{summaries}").collect()
    big = [r for r in got if r.job_id == "big"]
    assert len(big) > 20 and max(r.summaries for r in big) < 250 and {r.parts for r in big} == {30}
    assert sorted(s for r in big for s in r.prompt.split("\n- ")) == sorted(f"s{i}" for i in range(3000))
    small = [r for r in got if r.job_id == "small"]
    assert [r.prompt for r in small] == ["a2\n- a10\n- b2\n- b10"] and small[0].parts == 1


def test_routing(spark):
    requests = spark.createDataFrame([
        ("1", "GIT_URL", "https://h/a/b", None, None), ("2", "GIT_URL", "bad", None, None), ("3", "RAW_CODE", None, "code", " "),
        ("4", "FILE_UPLOAD", None, None, None), ("5", None, None, None, None), ("6", "RAW_CODE", None, "x", "n.py")],
        "job_id string, input_type string, git_url string, raw_code string, file_name string")
    assert [r.route for r in RQ.route_requests(requests).orderBy("job_id").collect()] == ["git", "reject", "raw", "reject", "reject", "raw"]
    assert [(r.path, r.content) for r in RQ.raw_snippets(requests).orderBy("job_id").collect()] == [("snippet.java", "code"), ("n.py", "x")]
    uploads = spark.createDataFrame([("a.zip", 5, b"zip"), ("b.py", 3, b"abc"), ("../c", 1, b"c"), ("d", 0, b""), (None, 3, b"abc"), ("e.py", 99_000_000, b"")],
                                    "file_name string, length bigint, content binary").withColumn("job_id", F.lit("j"))
    assert [r.route for r in RQ.route_uploads(uploads).collect()] == ["archive", "file", "reject", "reject", "reject", "reject"]
    assert [(r.path, r.content) for r in RQ.upload_sources(uploads).collect()] == [("b.py", "abc")]


def archive(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as bundle:
        for name, data in entries.items():
            bundle.writestr(name, data)
    return buffer.getvalue()


def test_archives(spark):
    good = archive({"src/A.java": "class A {}", "src/../B.py": "b", "../up.py": "no", "/abs.py": "no", "a/../../b.py": "no", "x/": "",
                    "bin.py": b"\xff\xfe\x00", "node_modules/c.js": "c", "read.md": "r"})
    table = spark.createDataFrame([("g.zip", good), ("bad.zip", b"nothing")], "archive string, content binary")
    rows = {(r.archive, r.entry_path): (r.content, r.reject_reason) for r in AR.expand_archives(table).collect()}
    assert rows[("g.zip", "src/A.java")] == ("class A {}", None) and rows[("g.zip", "B.py")] == ("b", None)
    for name in ("../up.py", "/abs.py", "a/../../b.py"):
        assert rows[("g.zip", name)] == (None, "outside the target directory")
    assert rows[("g.zip", "bin.py")][1] == "not text" and rows[("bad.zip", None)][1] == "not a zip archive"
    assert sorted(r.path for r in AR.archive_sources(table).collect()) == ["B.py", "src/A.java"]


def tree(root):
    for path, data in {"src/A.java": b"new Random()\n", "src/b.txt": b"x", "build/C.java": b"x", "a b/D.py": "é".encode(), "bad.py": b"\xff\xfe",
                       "big.java": b"x" * 5000}.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data)


def test_tree(spark, tmp_path):
    tree(tmp_path)
    rows = {r.path: r.content for r in TR.scan_tree(spark, str(tmp_path), "j", max_bytes=1000).collect()}
    assert rows == {"src/A.java": "new Random()\n", "a b/D.py": "é"}
    left_out = {r.path: (r.length, r.reject_reason) for r in TR.rejected_files(spark, str(tmp_path), max_bytes=1000).collect()}
    assert left_out == {"bad.py": (2, "not text"), "big.java": (5000, "larger than 1000 bytes")}
    assert sorted(r.path for r in TR.find_files(spark, str(tmp_path), "*.java").collect()) == ["big.java", "build/C.java", "src/A.java"]
    size = TR.tree_size(spark, str(tmp_path)).first()
    assert (size.bytes, size.files) == (sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs), 6)
    plan = TR.tree_size(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


STATE = "job_id string, n int, status string, updated_at timestamp_ntz, completed_at timestamp_ntz"
T0 = datetime(2024, 5, 1)


def states(spark):
    rows = [("hot", i, "RUNNING", T0 + timedelta(seconds=i), None) for i in range(5000)] + [
        ("hot", 9999, "COMPLETED", T0 + timedelta(days=1), T0 + timedelta(days=1)), ("old", 1, "COMPLETED", T0, T0), ("open", 2, "RUNNING", T0, None)]
    return spark.createDataFrame(rows, STATE)


def test_job_states(spark, tmp_path):
    latest = JB.latest_jobs(states(spark))
    assert {r.job_id: r.n for r in latest.collect()} == {"hot": 9999, "old": 1, "open": 2}
    at = F.lit("2024-05-02 00:00:01").cast("timestamp_ntz")
    assert sorted(r.job_id for r in JB.expire_jobs(latest, at).collect()) == ["hot", "open"]
    edge = F.lit("2024-05-02 00:00:00").cast("timestamp_ntz")
    assert JB.expire_jobs(latest, edge).count() == 3
    JB.save_jobs(states(spark), str(tmp_path / "jobs"))
    assert JB.latest_jobs(JB.read_jobs(spark, str(tmp_path / "jobs"))).count() == 3
    assert JB.job_lookup(latest, "none").count() == 0


def test_report(spark, files, tmp_path):
    source = files({"a.java": "new Random() // TODO\n", "b.py": "x\ny\n", "c.yaml": ""}, "j1").unionByName(files({"z.java": "x"}, "j2"))
    requests = spark.createDataFrame([("j1", "Shop", True), ("j2", None, False), ("j3", None, None)], "job_id string, project_name string, include_llm boolean")
    requests = requests.withColumn("started_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    narratives = R.parse_project_replies(spark.createDataFrame(
        [("j1", '{"executiveSummary": "e", "architecturalAssessment": "a", "topRecommendations": ["x", 2]}'), ("j2", "ignored")], "job_id string, reply string"))
    scans = RP.write_scans(source, str(tmp_path / "scans"))
    found = scan.findings_of(scans)
    reports = RP.build_reports(requests, scans, found, narratives, F.lit("2024-01-02").cast("timestamp_ntz"))
    rows = {r.job_id: r for r in reports.collect()}
    one = rows["j1"]
    assert (one.project_name, one.total_findings, one.medium_count, one.info_count, one.critical_count) == ("Shop", 2, 1, 1, 0)
    assert (one.total_files, one.total_lines, one.files_by_language) == (3, 4, {"java": 1, "python": 1, "unknown": 1})
    assert (one.executive_summary, one.top_recommendations) == ("e", ["x", "2"])
    assert (rows["j2"].project_name, rows["j2"].executive_summary, rows["j2"].total_findings) == (C.DEFAULT_PROJECT, C.SKIPPED_SUMMARY, 0)
    assert (rows["j3"].total_files, rows["j3"].files_by_language, rows["j3"].executive_summary) == (0, {}, "")
    from_texts = RP.build_reports(requests, source, found, narratives, F.lit("2024-01-02").cast("timestamp_ntz"))
    assert from_texts.drop("files_by_language").exceptAll(reports.drop("files_by_language")).count() == 0
    documents = {(r.job_id, r.page): json.loads(r.json) for r in RP.report_json(reports, RP.finding_pages(found), pretty=True).collect()}
    doc = documents[("j1", 0)]
    assert [f["rule_id"] for f in doc["security_findings"]] == ["OWASP-A02-RAND-001"] and "error_message" not in doc
    RP.write_report_json(RP.report_json(reports), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_pages_keep_every_finding_of_a_huge_job(spark):
    found = spark.range(5000).select(
        F.lit("hot").alias("job_id"), F.lit("LOW").alias("severity"), F.lit("SECURITY").alias("category"), F.lit("t").alias("title"),
        F.lit("d").alias("description"), F.lit("r").alias("recommendation"), F.concat(F.lit("f"), (F.col("id") % 50).cast("string")).alias("file_path"),
        F.col("id").cast("int").alias("line_number"), F.lit("R").alias("rule_id"), F.lit("s").alias("source"))
    pages = RP.finding_pages(found, page_size=200).select("page", F.size("security_findings").alias("n")).collect()
    assert len(pages) == 25 and sum(p.n for p in pages) == 5000 and max(p.n for p in pages) < 400


def test_merge_passes_and_null_lines(spark):
    schema = "job_id string, rule_id string, path string, line_number int"
    line = spark.createDataFrame([("j", "R", "p", 1)], schema)
    text = spark.createDataFrame([("j", "R", "p", 1), ("j", "R", "p", 2), ("j", "S", "p", 1)], schema)
    assert FN.merge_passes(line, text).count() == 3
    twice = spark.createDataFrame([("j", "R", "p", None)] * 2, schema)
    assert FN.dedupe_findings(twice, FN.HIT_KEY).count() == 1


def test_rule_table_round_trip_and_limit(spark):
    assert rules_from_frame(rules_frame(spark))[:13] == scan.security_rules()
    with pytest.raises(ValueError):
        rules_from_frame(rules_frame(spark).crossJoin(spark.range(200)).drop("id"))
    with pytest.raises(ValueError):
        rules_from_frame(rules_frame(spark).withColumn("view", F.lit("none")))


def test_stream_of_files_equals_batch(spark, tmp_path):
    tree(tmp_path / "in")
    root = str(tmp_path / "in")
    stream = TR.stream_tree(spark, root, "j")
    ST.stream_security_scan(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in/src/Late.java").write_text("new Random()\n")
    ST.stream_security_scan(TR.stream_tree(spark, root, "j"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = scan.security_scan(TR.scan_tree(spark, root, "j"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() == 2


def test_stream_of_states_over_two_runs(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    all_states = states(spark).withColumn("event_id", F.col("n"))
    for part in (all_states.where("n < 3000"), all_states.where("n >= 3000")):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(all_states.schema).parquet(source)
        ST.stream_latest_status(stream, out, cp).awaitTermination()
    assert {r.job_id: r.n for r in ST.read_latest_status(spark, out).collect()} == {"hot": 9999, "old": 1, "open": 2}


def test_shared_folders_are_fresh_and_follow_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one != two and os.path.dirname(one) == os.path.dirname(two)
    assert base is None or os.path.dirname(one) == base.rstrip("/")
