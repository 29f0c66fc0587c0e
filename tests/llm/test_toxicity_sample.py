from pyspark.sql import functions as F

from sieveline.llm import toxicity


def test_repeated_labelled_document_counts_once_in_the_fit(spark, monkeypatch):
    rows = [(i, f"calm words number {i} about rivers" if i % 2 else f"vile slur number {i} about rivers") for i in range(200)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    again = docs.unionByName(spark.range(3000).select(F.lit(0).cast("long").alias("doc_id"), F.concat(F.lit("other text "), F.col("id").cast("string")).alias("text")))
    sizes = []
    real = toxicity.fit_ordinal
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda rows, columns, values, grades, *a, **b: sizes.append(len(grades)) or real(rows, columns, values, grades, *a, **b))
    assert toxicity.fit(docs, labels) is not None and toxicity.fit(again, labels) is not None
    assert sizes == [200, 200]
