import pytest
from pyspark.sql import functions as F

WORDS = "the river runs past old mills and every winter ice covers its slow dark bends where herons wait for fish".split()


def prose(seed: int, n: int) -> str:
    """n words of made-up prose, different for each seed."""
    x, out = seed * 2654435761 % 2**32 or 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 16) % len(WORDS)] + str((x >> 8) % 97))
    return " ".join(out)


@pytest.fixture
def table_of(spark):
    """A table of (doc_id, text) rows with further columns whose names clash with those of operators."""

    def make(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        for name in ("node", "row", "rejected", "kept", "key", "n_words", "component_id", "a.b"):
            docs = docs.withColumn(name, F.lit(None).cast("string"))
        return docs

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, repeated rows and ids, near copies, one very long text, special strings, odd characters."""
    long, base = prose(1, 30_000), prose(2, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (4, "one two"), (None, "one two"), (None, None), (5, base), (6, base), (6, " ".join(near)),
        (7, long), (8, "it's they'll <|endoftext|> x" + "a" * 500), (9, "Ünï çødé 日本語 テスト 👍🏽 ½ 12345 \x0b\x0c end"), (10, prose(3, 60) + " " + base + " " + prose(4, 60)),
        (11, "same line\nsame line\nother\n\nsame line " + "again and again we go on and on " * 12), (12, prose(5, 3)), (13, prose(6, 4)), (14, "THE " * 40),
    ]
