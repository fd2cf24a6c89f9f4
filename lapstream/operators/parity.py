"""Parity of training and serving features: schemas, values known at the time, coverage and match rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["race", "driver", "lapNumber"]


def point_in_time(offline: DataFrame, pairs: dict[str, str], tolerance: float, lag: int = 2) -> DataFrame:
    """For each trend of ``pairs`` (trend -> its base column), recomputed from what was known at each lap, the base less the
    driver's base ``lag`` laps earlier (0 without one): rows, rows that differ, and first laps whose trend is not 0. A trend
    that has seen a later or a nearer lap differs. All trends are recomputed over one window."""
    w = Window.partitionBy("race", "driver").orderBy("lapNumber")
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    off = lambda t, b: F.abs(F.coalesce(F.col(b) - F.lag(b, lag).over(w), F.lit(0.0)) - value(t)) > tolerance
    x = offline.select(F.row_number().over(w).alias("__k"), *(F.struct(F.lit(t).alias("trend"), off(t, b).alias("differs"), (F.abs(value(t)) > tolerance).alias("some")).alias(f"__{i}") for i, (t, b) in enumerate(pairs.items())))
    long = x.select("__k", F.explode(F.array(*(f"__{i}" for i in range(len(pairs))))).alias("p")).select("__k", "p.*")
    return long.groupBy("trend").agg(F.count("*").alias("rows"), F.sum(F.col("differs").cast("int")).alias("mismatches"), F.sum((F.col("some") & (F.col("__k") <= lag)).cast("int")).alias("early"))


def _same(kind: str, a: Column, b: Column, tolerance: float) -> Column:
    if kind == "boolean":
        return F.coalesce(a, F.lit(False)) == F.coalesce(b, F.lit(False))
    if kind == "string":
        return a.eqNullSafe(b)
    x, y = a.cast("double"), b.cast("double")
    return F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())


def match_rates(offline: DataFrame, serving: DataFrame, columns: list[str], tolerance: float) -> DataFrame:
    """(feature, n, matches) over the keys that both have: flags with null as false, numbers within ``tolerance``, texts
    exactly; two nulls match. Of repeated offline keys any one row is taken."""
    kinds = dict(offline.dtypes)
    a, b = (df.dropDuplicates(KEY).select(*KEY, *(F.col(c).alias(f"{c}{end}") for c in columns)) for df, end in ((offline, "_offline"), (serving, "_serving")))
    said = F.array(*(F.struct(F.lit(c).alias("feature"), _same(kinds[c], F.col(f"{c}_offline"), F.col(f"{c}_serving"), tolerance).alias("same")) for c in columns))
    return a.join(b, KEY).select(F.explode(said).alias("p")).groupBy("p.feature").agg(F.count("*").alias("n"), F.sum(F.col("p.same").cast("int")).alias("matches"))


def parity_audit(
    offline: DataFrame, serving: DataFrame, training: list[str], bundle: list[str], payload: list[str], required: list[str], pairs: dict[str, str], columns: list[str], tolerance: float = 1e-6, least: float = 0.99
) -> DataFrame:
    """(check, value, status): the audit of serving against training.

    ``training`` and ``bundle`` columns are the same in the same order; the live ``payload`` has the ``required`` fields;
    serving makes every training column (coverage); each trend of ``pairs`` is right at its time; each feature of
    ``columns`` that both have matches, and the mean of the match rates is at least ``least``."""
    spark = offline.sparkSession
    made = [c for c in training if c in serving.columns]
    facts = [("schema_bundle_training_exact", float(training == bundle), 1.0), ("schema_live_payload_required_fields", float(set(required) <= set(payload)), 1.0), ("schema_serving_transform_feature_coverage", len(made) / max(1, len(training)), 1.0)]
    schema = spark.createDataFrame(facts, "check string, value double, floor double")
    trends = point_in_time(offline, pairs, tolerance).select(F.concat(F.lit("point_in_time_"), "trend").alias("check"), (1 - (F.col("mismatches") + F.col("early")) / F.col("rows")).alias("value"), F.lit(1.0).alias("floor"))
    shared = [c for c in columns if c in offline.columns and c in serving.columns]
    rates = match_rates(offline, serving, shared, tolerance).select(F.concat(F.lit("feature_match_rate::"), "feature").alias("check"), (F.col("matches") / F.col("n")).alias("value"), F.lit(float(least)).alias("floor"))
    overall = rates.agg(F.lit("feature_parity_overall").alias("check"), F.avg("value").alias("value"), F.lit(float(least)).alias("floor"))
    every = reduce(DataFrame.unionByName, [schema, trends, rates, overall])
    return every.select("check", F.round("value", 6).alias("value"), F.when(F.col("value") >= F.col("floor"), "PASS").otherwise("FAIL").alias("status"))
