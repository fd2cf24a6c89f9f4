"""How well scores tell targets apart: areas under precision and recall, operating points, the best point, by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import Y, numbered

#: Thresholds that reports mark on a curve. Fixed values.
MARKS = {"threshold_0.50": 0.5, "threshold_0.10": 0.1, "threshold_0.05": 0.05}
WHOLE = "overall"


def curves(df: DataFrame, scores: list[str], group: Column) -> DataFrame:
    """(group, score_type, i, threshold, pos, tp, precision, recall, all_pos, all_rows): the points of each score's curve, from
    the highest distinct score down, for each ``group`` and for all rows (``overall``).

    Rows without a score do not count; a curve whose rows are all of one class is undefined and has no points. Rows become
    counts by score first; running counts are carried over ranges (``numbered``), so no curve is one task."""
    long = df.select(group.cast("string").alias("g"), Y, F.explode(F.array(*(F.struct(F.lit(s).alias("score_type"), F.col(s).cast("double").alias("s")) for s in scores))).alias("x"))
    own = long.select("g", Y, "x.*").where(F.col("s").isNotNull() & ~F.isnan("s")).groupBy("g", "score_type", "s").agg(F.count("*").alias("n"), F.sum(Y).alias("pos"))
    both = own.withColumn("group", F.explode(F.array("g", F.lit(WHOLE)))).groupBy(F.to_json(F.struct("group", "score_type")).alias("key"), (-F.col("s")).alias("down")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    x = numbered(both, "key", ["down"], {"tp": F.col("pos").cast("long"), "seen": F.col("n").cast("long")})
    whole = x.groupBy("key").agg(F.max("tp").alias("all_pos"), F.max("seen").alias("all_rows")).where("all_pos > 0 and all_pos < all_rows")
    name = F.from_json("key", "group string, score_type string")
    return x.join(whole, "key").select(
        name["group"].alias("group"), name["score_type"].alias("score_type"), F.col("__i").alias("i"), (-F.col("down")).alias("threshold"), "pos", "tp", (F.col("tp") / F.col("seen")).alias("precision"), (F.col("tp") / F.col("all_pos")).alias("recall"), "seen", "all_pos", "all_rows"
    )


def discrimination(points: DataFrame) -> DataFrame:
    """For each curve of ``curves``: average precision, the area by trapezoids (from recall 0 and precision 1), prevalence,
    rows and positive rows. A point meets the one before it by an equi-join on its place."""
    c = F.col
    before = points.select("group", "score_type", (c("i") + 1).alias("i"), c("recall").alias("r0"), c("precision").alias("p0"))
    x = points.join(before, ["group", "score_type", "i"], "left")
    area = (c("recall") - F.coalesce("r0", F.lit(0.0))) * (c("precision") + F.coalesce("p0", F.lit(1.0))) / 2
    g = x.groupBy("group", "score_type").agg(F.round(F.sum(c("pos") / c("all_pos") * c("precision")), 6).alias("pr_auc_ap"), F.round(F.sum(area), 6).alias("pr_auc_trapz"), F.max("all_pos").alias("n_positive"), F.max("all_rows").alias("n_rows"))
    return g.withColumn("prevalence", F.round(c("n_positive") / c("n_rows"), 6))


def operating_points(points: DataFrame, marks: dict[str, float] | None = None) -> DataFrame:
    """Where each mark lies on each curve: the distinct score next to it (of two as near the lower), precision and recall there.

    Of marks that agree to 8 digits the first counts."""
    first: dict[float, tuple[str, float]] = {}
    for label, value in (MARKS if marks is None else marks).items():
        first.setdefault(round(float(value), 8), (label, float(value)))
    wanted = F.explode(F.array(*(F.struct(F.lit(label).alias("point_label"), F.lit(value).alias("requested_threshold")) for label, value in first.values())))
    x = points.withColumn("m", wanted).select(*points.columns, "m.*")
    near = F.struct(F.abs(F.col("threshold") - F.col("requested_threshold")).alias("away"), F.col("threshold").alias("effective_threshold"), F.col("precision"), F.col("recall"))
    g = x.groupBy("group", "score_type", "point_label", "requested_threshold").agg(F.min(near).alias("p"))
    return g.select("group", "score_type", "point_label", "requested_threshold", "p.effective_threshold", F.round("p.precision", 6).alias("precision"), F.round("p.recall", 6).alias("recall"))


def best_points(points: DataFrame) -> DataFrame:
    """The point of the best F1 of each curve; of equals the one with the lowest threshold."""
    c = F.col
    f1 = 2 * c("tp") / (c("seen") + c("all_pos"))
    g = points.groupBy("group", "score_type").agg(F.max(F.struct(f1.alias("f1"), (-c("threshold")).alias("down"), "precision", "recall")).alias("p"))
    return g.select("group", "score_type", (-c("p.down")).alias("threshold"), *(F.round(f"p.{x}", 6).alias(x) for x in ("f1", "precision", "recall")))
