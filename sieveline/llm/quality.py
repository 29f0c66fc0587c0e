"""Quality rules by weak supervision, in column expressions only.

Each rule looks at one measure of a text and votes good, bad or abstains. Expectation-maximisation over the counts of vote patterns
(at most 3 to the number of rules, whatever the corpus' size) estimates how often each rule is right on either class; the posterior
probability of good quality then decides, instead of asking every rule to pass.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.tables import kept

WORD = "[^\\x20\\x09-\\x0D]+"
SPACES, SYMBOLS = "[\\x20\\x09-\\x0D]+", "[#*$%&|<>]"
PLAIN = "(?<![^\\x20\\x09-\\x0D])\\p{L}+[.,;:!?]?(?![^\\x20\\x09-\\x0D])"
WINDOW = 8
# Frequent function words of the languages in the corpus.
COMMON = ("the", "of", "and", "to", "in", "is", "that", "de", "la", "le", "les", "et", "un", "une", "que", "el", "los", "der", "die", "das", "und", "von", "zu")


class Rule(NamedTuple):
    """Votes bad where bad holds, else good where good holds, else abstains. SQL conditions on the measures."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 20", "false"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words", "false"),
    Rule("symbols", "10 * n_symbols > n_words", "false"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "false"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "false"),
    Rule("capitals", "2 * n_capitals > word_chars", "false"),
    Rule("plain_words", "100 * n_plain < 60 * n_words", "100 * n_plain >= 85 * n_words and n_words >= 20"),
    Rule("common_words", "100 * n_common < 2 * n_words and n_words >= 20", "100 * n_common >= 8 * n_words"),
)


def _doubled(reach: int) -> Column:
    return F.transform("h", lambda x, i: F.xxhash64(x, F.get(F.col("h"), i + reach)))


def measures(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named by carry, and the measures of every row of docs (doc_id, text).

    n_repeat_words is the words in 8-word windows found twice or more. Windows are told apart by 64-bit hashes; sorting puts equal
    ones side by side, so the time is that of a sort however often one repeats."""
    own = ("doc_id", *carry)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), *carry, text.alias("t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    staged = base.select(*own, "t", "words", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"), F.size("words").alias("n"))
    staged = staged.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    for reach in (1, 2, 4):  # the hash of 2, 4, 8 words from those of half as many
        staged = staged.select(*own, "t", "words", "lines", "n", _doubled(reach).alias("h"))
    staged = staged.select(*own, "t", "words", "lines", "n", F.slice("h", 1, F.greatest(F.col("n") - (WINDOW - 1), F.lit(0))).alias("h"))
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    staged = staged.select(
        *own, "t", "words", "lines", "n",
        F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs).otherwise(F.array().cast("array<struct<h: bigint, i: int>>")).alias("p"),
    )
    before, after = (lambda j: F.get(F.col("p"), j - 1)["h"]), (lambda j: F.get(F.col("p"), j + 1)["h"])
    twice = F.filter("p", lambda x, j: ((j > 0) & (x["h"] == before(j))) | F.coalesce(x["h"] == after(j), F.lit(False)))
    staged = staged.select(*own, "t", "words", "lines", "n", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at"))
    covered = F.aggregate(
        F.transform("at", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda s, x: s + x
    )
    return staged.select(
        *own, F.col("n").cast("long").alias("n_words"), F.length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), (F.length("t") - F.length(F.regexp_replace("t", "\\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit(PLAIN)).cast("long").alias("n_plain"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*COMMON))).cast("long").alias("n_common"),
    )


def votes(rules: tuple[Rule, ...]) -> list[Column]:
    return [F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).alias(f"vote_{r.name}") for r in rules]


class Model(NamedTuple):
    """Log odds of good quality before any vote, and what a good or a bad vote of each rule adds."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 100) -> Model:
    """Expectation-maximisation over (votes, rows) pairs. It starts from the sum of the votes. How often a rule votes good, and bad,
    is estimated for each class, smoothed by one vote; an abstention says nothing, and a vote never counts against its own
    direction."""
    belief = [1 / (1 + math.exp(-2.0 * sum(v))) for v, _ in patterns]
    model = Model(0.0, (0.0,) * n_rules, (0.0,) * n_rules)
    for _ in range(rounds):
        in_good = sum(b * c for b, (_, c) in zip(belief, patterns))
        in_bad = sum((1 - b) * c for b, (_, c) in zip(belief, patterns))
        prior = (in_good + 1) / (in_good + in_bad + 2)

        def odds(j: int, vote: int) -> float:
            of_good = sum(b * c for b, (v, c) in zip(belief, patterns) if v[j] == vote)
            of_bad = sum((1 - b) * c for b, (v, c) in zip(belief, patterns) if v[j] == vote)
            return math.log((of_good + 1) / (in_good + 2)) - math.log((of_bad + 1) / (in_bad + 2))

        good = [max(0.0, odds(j, 1)) for j in range(n_rules)]
        bad = [min(0.0, odds(j, -1)) for j in range(n_rules)]
        model = Model(math.log(prior / (1 - prior)), tuple(good), tuple(bad))
        score = [model.prior + sum(good[j] if x > 0 else bad[j] if x < 0 else 0.0 for j, x in enumerate(v)) for v, _ in patterns]
        new = [1 / (1 + math.exp(-max(-60.0, min(60.0, s)))) for s in score]
        moved = max((abs(a - b) for a, b in zip(new, belief)), default=0.0)
        belief = new
        if moved < 1e-9:
            break
    return model


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named by carry, the measures, base_failed, the votes, posterior and kept of every row of docs (doc_id, text; others are ignored).

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated windows. kept: not base_failed, and the posterior
    probability of good quality is `least` or more. A null or empty text has no words and fails. Rows with equal doc_id, null
    included, are rows of their own and all count in the estimate; an empty table gives no rows."""
    voted = kept(measures(docs, carry).select("*", *votes(rules)), "measures")
    names = [f"vote_{r.name}" for r in rules]
    counts = voted.groupBy(*names).count().collect()  # 3 ** len(rules) rows at most
    model = fit(sorted((tuple(r[n] for n in names), r["count"]) for r in counts), len(rules))
    odds = F.lit(model.prior)
    for name, good, bad in zip(names, model.good, model.bad):
        odds = odds + F.when(F.col(name) > 0, good).when(F.col(name) < 0, bad).otherwise(0.0)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted.select("*", failed.alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("posterior")).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
