"""Connected components of link tables whose size grows with the data: hooking and pointer jumping as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint without the plan's estimate of its size: a join multiplies the sizes of its sides, so by pointer
    jumping the estimate's digits double each time, and after some twenty-five jumps planning never ends."""
    spark, done = df.sparkSession, stash(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def components(nodes: DataFrame | None, links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, comp): the smallest node reachable over ``links`` (a, b), itself included.

    Each round reads both ends' labels, hooks every label to the smallest label beside it, shortens the
    chains of hooks by pointer jumping until every hook ends at a label without one, and relabels. So a
    label's own node carries that label, and links between labels stand for the links they came from. Only
    labels that still have an open link take part, so a round costs joins on the links that remain. Both sides of every join are read from a checkpoint,
    so that an end which a third of all links share is split by the skew join.
    ``labels`` (a checkpointed result of this function) is taken as the start instead of single nodes.
    Null nodes are left out; repeated nodes, repeated links, loops and empty tables are allowed.
    """
    if labels is None:
        labels = _cut(nodes.select("node").where("node is not null").distinct().withColumn("comp", F.col("node")))
    rest = links.select("a", "b").where("a <> b")
    while True:
        at_a = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        at_b = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        rest = _cut(rest.join(at_a, "a").join(at_b, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        if rest.isEmpty():
            return labels
        hooks = _cut(rest.groupBy(F.greatest("a", "b").alias("from")).agg(F.min(F.least("a", "b")).alias("to")))
        while True:
            further = hooks.select(F.col("from").alias("to"), F.col("to").alias("beyond"))
            jumped = _cut(hooks.join(further, "to", "left").select("from", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")))
            hooks = jumped.select("from", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = _cut(labels.join(hooks.withColumnRenamed("from", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
