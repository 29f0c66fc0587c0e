"""Further inputs derived from the given tables, row by row, in Spark and in SQL: requests, uploads, job states,
model replies, method facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.sources.partitions import spread


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def _pick(values, index):
    """The value at ``index`` of a short list of SQL expressions."""
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


# One text serves both engines where the expressions are plain enough to mean the same in both.
REQUESTS_SQL = f"""
SELECT concat('job-', CAST(o_orderkey AS STRING)) AS job_id,
       {_pick(["'GIT_URL'", "'RAW_CODE'", "'FILE_UPLOAD'", "'RAW_CODE'", "'GIT_URL'", "'OTHER'"], 'o_orderkey % 6')} AS input_type,
       {_pick(["concat('https://git.example.com/team/repo', CAST(o_orderkey AS STRING), '.git')",
               "concat('git@git.example.com:team/r', CAST(o_orderkey AS STRING))",
               "concat('ftp://x/', CAST(o_orderkey AS STRING))", "NULL", "concat(' http://h/a/b', CAST(o_orderkey AS STRING), ' ')"],
              'o_orderkey % 5')} AS git_url,
       concat('class R', CAST(o_orderkey AS STRING), ' {{ }}') AS raw_code,
       {_pick(["NULL", "''", "'  '", "concat('R', CAST(o_orderkey AS STRING), '.java')", "'a b.py'"], 'o_orderkey % 5')} AS file_name,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('Project ', CAST(o_orderkey AS STRING)) END AS project_name,
       o_orderkey % 4 <> 0 AS include_llm
FROM orders"""

UPLOADS_SQL = f"""
SELECT concat('job-', CAST(o_orderkey AS STRING)) AS job_id,
       {_pick(["concat('src', CAST(o_orderkey AS STRING), '.zip')", "'Main.java'", "'../up.zip'", "'dir/x.py'", "NULL",
               "'a..b.java'", "'with space.zip'", "'ok-1_2.py'"], 'o_orderkey % 8')} AS file_name,
       CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE CAST(floor(o_totalprice * 200) AS BIGINT) END AS length
FROM orders"""

STATES_SQL = """
SELECT concat('job-', CAST(user_id AS STRING)) AS job_id, event_id,
       CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED'
            ELSE 'RUNNING' END AS status,
       CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('P', CAST(user_id AS STRING)) END AS project_name,
       ts AS updated_at, ts - INTERVAL '1' HOUR AS started_at,
       CASE WHEN event_type IN ('purchase', 'error') THEN ts END AS completed_at,
       CASE WHEN event_type = 'error' THEN concat('E', CAST(event_id AS STRING)) END AS error_message,
       event_id % 50 AS total_findings
FROM events"""

FACTS_SQL = """
SELECT concat('job-', CAST(l_suppkey AS STRING)) AS job_id, concat('src/F', CAST(l_partkey AS STRING), '.java') AS path,
       concat('m', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS name,
       CAST(l_linenumber * 10 AS INT) AS start_line, CAST(l_linenumber * 10 + l_partkey % 90 AS INT) AS end_line,
       CAST(l_orderkey % 9 AS INT) AS n_params, CAST(l_suppkey % 30 AS INT) AS complexity, CAST(l_partkey % 7 AS INT) AS nesting
FROM lineitem"""

# Replies of a model to chunks, one per event, of eight kinds: fenced, plain, no JSON, null hint, no summary, findings
# that are no list, odd values, empty.
REPLY_TEXT = _pick(
    [
        """concat('```json', chr(10), '{"summary": "S', CAST(event_id AS STRING), '", "findings": [{"title": "T',"""
        """ CAST(event_id AS STRING), '", "description": "d", "recommendation": "r", "severity": "high", "lineHint": ',"""
        """ CAST(event_id % 77 AS STRING), '}]}', chr(10), '```')""",
        """concat('{"summary": "plain", "findings": [{"title": "A", "severity": "Critical", "lineHint": "42"},"""
        """ {"title": "B', CAST(event_id AS STRING), '", "description": "x"}]}')""",
        "concat('Sorry, no answer ', CAST(event_id AS STRING))",
        """'{"summary": "null hint", "findings": [{"title": "C", "severity": "low", "lineHint": null}]}'""",
        """'{"findings": []}'""",
        """'{"summary": "no list", "findings": "none"}'""",
        """'  {"summary": "odd", "findings": [{"title": "D", "severity": "odd", "lineHint": "abc"}, {}]}  '""",
        "''",
    ],
    "event_id % 8",
)
REPLY_KEYS = """concat('job-', CAST(user_id AS STRING)) AS job_id,
       concat('src/F', CAST(event_id % 97 AS STRING), '.java') AS file_path,
       CAST(floor(event_id / 97) AS INT) AS chunk_index,
       CASE event_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS provider"""
REPLIES_SQL = f"SELECT event_id, {REPLY_KEYS}, {REPLY_TEXT} AS reply FROM events"

PROJECT_REPLY = _pick(
    [
        """concat('```json', chr(10), '{"executiveSummary": "E', CAST(c_custkey AS STRING), '", "architecturalAssessment":"""
        """ "A", "topRecommendations": ["r1", "r2", "r3", "r4", "r5", "r6", "r', CAST(c_custkey AS STRING), '"]}', chr(10), '```')""",
        """'{"executiveSummary": "only"}'""",
        "concat('no json ', CAST(c_custkey AS STRING))",
        """'{"executiveSummary": "x", "topRecommendations": "none"}'""",
        "''",
    ],
    "c_custkey % 5",
)
PROJECT_REPLIES_SQL = f"SELECT concat('job-', CAST(c_custkey AS STRING)) AS job_id, {PROJECT_REPLY} AS reply FROM customer"


def derived(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """Run one of the texts above over its table."""
    spread(table(spark, sf_dir, name)).createOrReplaceTempView(f"given_{name}")
    return spark.sql(sql.replace(f"FROM {name}", f"FROM given_{name}"))


def requests(spark, sf):
    return derived(spark, sf, "orders", REQUESTS_SQL)


def uploads(spark, sf):
    return derived(spark, sf, "orders", UPLOADS_SQL)


def states(spark, sf):
    return derived(spark, sf, "events", STATES_SQL)


def facts(spark, sf):
    return derived(spark, sf, "lineitem", FACTS_SQL)


def replies(spark, sf):
    return derived(spark, sf, "events", REPLIES_SQL)


def project_replies(spark, sf):
    return derived(spark, sf, "customer", PROJECT_REPLIES_SQL)


def envelopes(spark, sf) -> DataFrame:
    """The replies in the three envelope shapes."""
    text = F.struct(F.col("reply").alias("text"))
    body = (
        F.when(F.col("provider") == "alpha", F.to_json(F.struct(F.array(text).alias("content"))))
        .when(F.col("provider") == "beta", F.to_json(F.struct(F.array(F.struct(
            F.struct(F.col("reply").alias("content")).alias("message"))).alias("choices"))))
        .otherwise(F.to_json(F.struct(F.array(F.struct(F.col("reply").alias("generated_text"))).alias("results"))))
    )
    return replies(spark, sf).withColumn("body", body)


ENVELOPES_SQL = f"""
SELECT *, CASE provider
    WHEN 'alpha' THEN json_object('content', json_array(json_object('text', reply)))
    WHEN 'beta' THEN json_object('choices', json_array(json_object('message', json_object('content', reply))))
    ELSE json_object('results', json_array(json_object('generated_text', reply))) END::VARCHAR AS body
FROM ({REPLIES_SQL})"""


def documents(spark, sf) -> DataFrame:
    """Documents as source rows: (job_id, path, content); the project is the language."""
    d = spread(table(spark, sf, "documents", "doc_id", "text", "lang"))
    return d.select(
        F.concat(F.lit("job-"), "lang").alias("job_id"),
        F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("text").alias("content"),
    )


DOCUMENTS_SQL = """SELECT 'job-' || lang AS job_id, 'docs/d' || doc_id || '.md' AS path, text AS content FROM documents"""
