"""Places and quantiles of timelines and groups of any size: sums over ranges of rows, carried over from range to range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with ``__i``, the place from 1 in its timeline ``by``, and for each of ``sums`` the sum up to the row.

    Rows are ranged over all timelines, summed range by range, and moved up by what earlier ranges of the timeline hold,
    so a timeline of any length is summed in as many places as it has ranges. The ranges are fixed (``settled``) before
    they are read twice."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.withColumns({"__i": F.lit(1).cast("long"), **sums}).repartitionByRange(tasks, by, *order).withColumn("__range", F.spark_partition_id()))
    names, w = ["__i", *sums], Window.partitionBy(by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    held = ranged.groupBy(by, "__range").agg(*(F.sum(c).alias(c) for c in names))
    held = held.select(by, "__range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_held") for c in names))
    inside = ranged.withColumns({c: F.sum(c).over(w) for c in names}).join(held, [by, "__range"])
    return inside.withColumns({c: F.col(c) + F.col(f"{c}_held") for c in names}).drop("__range", *(f"{c}_held" for c in names))


def settled(df: DataFrame) -> DataFrame:
    """The same rows for good: a checkpoint in the session's folder for them where it has one, else kept in memory and
    on disk (a local session)."""
    spark = df.sparkSession
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(given)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()


def exact_quantiles(counts: DataFrame, by: str, value: str, n: str, quantiles: dict[str, float]) -> DataFrame:
    """(by, statistic, value): quantiles of each ``by`` from (by, value, n), n rows having the value; between two values
    the quantile lies on the line. A group without values has no row.

    Counts are ranged over all groups and each range is summed; the sums say in which ranges the places lie, and only
    these are looked at row by row. So a group of any number of values is in as many tasks as it has ranges."""
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.select(by, F.col(value).alias("__v"), F.col(n).cast("long").alias("__c")).repartitionByRange(tasks, by, "__v")
    ranged = settled(ranged.withColumn("__range", F.spark_partition_id()))
    w = Window.partitionBy(by)
    held = ranged.groupBy(by, "__range").agg(F.sum("__c").alias("__n"))  # a row for each range
    earlier = F.coalesce(F.sum("__n").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(by, "__range", earlier.alias("__held"), (earlier + F.col("__n")).alias("__end"), F.sum("__n").over(w).alias("__all"))
    places = F.array(*(F.struct(F.lit(k).alias("statistic"), (F.lit(float(p)) * (F.col("__all") - 1)).alias("at")) for k, p in quantiles.items()))
    within = lambda place, low, high: (place >= low) & (place < high)
    either = lambda q, low, high: within(F.floor(q["at"]), low, high) | within(F.ceil(q["at"]), low, high)
    asked = held.select(by, "__range", "__held", F.filter(places, lambda q: either(q, F.col("__held"), F.col("__end"))).alias("__asked")).where(F.size("__asked") > 0)
    x = ranged.join(asked, [by, "__range"])
    upto = F.sum("__c").over(Window.partitionBy(by, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("__upto", upto + F.col("__held")).withColumn("__from", F.col("__upto") - F.col("__c"))
    x = x.where(F.exists("__asked", lambda q: either(q, F.col("__from"), F.col("__upto")))).withColumn("q", F.explode("__asked"))
    low, high = (within(f("q.at"), F.col("__from"), F.col("__upto")) for f in (F.floor, F.ceil))
    g = x.where(low | high).groupBy(by, "q.statistic").agg(F.max(F.when(low, F.col("__v"))).alias("lo"), F.max(F.when(high, F.col("__v"))).alias("hi"), F.max("q.at").alias("at"))
    between = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))
    return g.select(by, "statistic", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(between).alias("value"))


def with_quantiles(groups: DataFrame, rows: DataFrame, keys: list[str], value: Column, quantiles: dict[str, float]) -> DataFrame:
    """``groups``, one row for each of ``keys``, with a column for each of ``quantiles`` of ``value`` over the group's ``rows``;
    null values count for nothing, null keys are keys. Rows become counts of (keys, value) first."""
    key = F.struct(F.lit(0).alias("__all"), *keys).alias("__key")
    counts = rows.select(key, value.cast("double").alias("__x")).where("__x is not null").groupBy("__key", "__x").agg(F.count("*").alias("__n"))
    q = exact_quantiles(counts, "__key", "__x", "__n", quantiles)
    wide = q.groupBy("__key").agg(*(F.max(F.when(F.col("statistic") == k, F.col("value"))).alias(k) for k in quantiles))
    return groups.withColumn("__key", key).join(wide, "__key", "left").drop("__key")
