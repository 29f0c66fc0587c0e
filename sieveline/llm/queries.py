"""Registered queries of the operators on training data, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bpe_codec, fm_dedup, html_text, lm_scoring, ngram_join, packing, phrases, quality, resampling, suffix_dedup, token_counts, toxicity, vector_tree
from sieveline.llm.tables import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return quality.quality(table(spark, sf_dir, "documents")).select(*names)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode(table(spark, sf_dir, "documents"), decode_too=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tree.nearest(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fm_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.likelihood(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_token_counts, op3_quality_rules, op4_ngram_join, op5_bpe_codec, op6_nearest, op7_substring_dedup, op8_packing, op9_suffix_dedup, op10_html_text, op11_resampling,
    op12_lm_scoring, op13_phrases,
)}

_WORD = r"[^\x20\x09-\x0D]+"

_JACCARD = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM d),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
link AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY ALL) p
  JOIN n na ON na.r = p.a JOIN n nb ON nb.r = p.b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.component_id
FROM d LEFT JOIN n USING (r)
JOIN (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY 1) least USING (r)
"""


def _without_repeats(window: int) -> str:
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS MATERIALIZED (
  SELECT r, unnest(range(1, len(w) - {window - 2})) AS i, w FROM d WHERE len(w) >= {window}),
h AS MATERIALIZED (SELECT r, i, array_to_string(w[i:i + {window - 1}], ' ') AS t FROM g),
twice AS (SELECT t FROM h GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {window})) AS j FROM h JOIN twice USING (t)),
marks AS (SELECT r, list(j) AS js, count(*) AS n FROM gone GROUP BY r),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
rest AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN marks USING (r) LEFT JOIN rest USING (r)
"""


# CRC-32 of each distinct word from its bytes: the table of 256 remainders comes from the reflected polynomial.
_RESAMPLING = r"""
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
w AS MATERIALIZED (
  SELECT kind, r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x
  FROM (SELECT 's' AS kind, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 't', NULL, NULL, text FROM benchmark)),
named AS MATERIALIZED (
  SELECT x, xor(4294967295, list_reduce(list_transform(range(0, octet_length(encode(x)), 1), lambda i: CAST('0x' || substr(hex(encode(x)), 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS b
  FROM (SELECT DISTINCT x FROM w), crc),
n AS MATERIALIZED (SELECT b, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 't') AS t FROM w JOIN named USING (x) GROUP BY b),
tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM n),
gain AS MATERIALIZED (
  SELECT b, floor(1000 * ln(((n.t + 1)::DOUBLE * (tot.s + 10000)) / ((n.s + 1)::DOUBLE * (tot.t + 10000))))::BIGINT AS g FROM n, tot),
per AS (SELECT r, count(*) AS k, sum(g)::BIGINT AS weight FROM w JOIN named USING (x) JOIN gain USING (b) WHERE kind = 's' GROUP BY r),
scored AS (
  SELECT r, doc_id, coalesce(k, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN per USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS p, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND p <= 10 * able // 100 THEN p END AS rank FROM placed
"""

_PHRASES = r"""
WITH p AS MATERIALIZED (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
cut AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, j, (2000000 * c.a::HUGEINT) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j, string_split(phrase, ' ') AS w FROM f WHERE k > 1) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')),
scored AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY ALL),
stays AS (SELECT s.* FROM scored s LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM stays JOIN total USING (lang) QUALIFY rank <= 2000
"""


ORACLES = {"op4_ngram_join": _JACCARD, "op7_substring_dedup": _without_repeats(fm_dedup.WINDOW), "op9_suffix_dedup": _without_repeats(suffix_dedup.WINDOW), "op11_resampling": _RESAMPLING, "op13_phrases": _PHRASES}
