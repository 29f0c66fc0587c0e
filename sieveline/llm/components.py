"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.tables import kept


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """One step. edges: u > v. both: large-star, which links larger neighbours to the least; else small-star."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    met = seen.join(least, "u")
    if both:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge table (u, v) of longs; root is the least node of the component. Edges from a node to
    itself and edges with null are left out. Work per step is linear in the edges; a hub is a skewed join key, which Spark
    splits. Each step is written to the shared folder, and the loop ends when a step changes nothing."""
    state = kept(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    sign = [F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))]
    now = tuple(state.agg(*sign).first())
    while now[0]:
        state = kept(_stars(_stars(state, True), False), "edges")
        was, now = now, tuple(state.agg(*sign).first())
        if was == now:
            break
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
