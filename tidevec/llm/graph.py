"""Connected components of an edge table, by distributed label minimisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidevec.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """v, label: for each vertex of edges(a, b) the smallest vertex that it is connected with; kept in scratch.

    Vertices are of any type with an order. A round takes the least label among neighbours, then follows the
    label's own label, so long chains shorten fast. Rows with a null end are left out; an empty table gives
    no rows. Each round is kept in the shared folder until the next is there, so a lost executor costs at
    most one round.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    rows = 2 * e.count()
    both = scratch.keep(e.union(e.select("b", "a")).toDF("a", "b").distinct(), rows)
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), rows)
    while True:
        near = both.join(labels.toDF("b", "l"), "b").groupBy("a").agg(F.min("l").alias("l")).withColumnRenamed("a", "v")
        lower = scratch.keep(labels.join(near, "v").select("v", F.least("label", "l").alias("label"), F.col("label").alias("old")), rows)
        up = lower.select(F.col("v").alias("label"), F.col("label").alias("next"))
        moved = scratch.keep(lower.join(up, "label", "left").select("v", F.coalesce("next", "label").alias("label"), "old"), rows)
        done = moved.where("label <> old").isEmpty()
        scratch.drop(labels, lower)
        labels = scratch.part(moved, "v", "label")
        if done:
            scratch.drop(both)
            return labels
