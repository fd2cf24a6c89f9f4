"""Decision policies of scored folds: thresholds under a precision floor with an ordered fallback, held against fixed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import P, Y, threshold_sweep, with_rates

#: Names of the two ways a constrained threshold comes about, as reports have them. Fixed values.
MET, FALLBACK = "constrained_utility", "fallback_max_precision"


def threshold_policies(calibration: DataFrame, thresholds: list[float], floor: float, cost: float, keys: list[str]) -> DataFrame:
    """For each of ``keys`` (a fold) the threshold of the best F1, and the constrained one.

    Constrained: of the thresholds with a precision of at least ``floor`` the one of the highest utility, true positives
    less ``cost`` for each false one; ties go by F1, recall, precision, then the higher threshold. Where none reaches the
    floor (``fallback_max_precision``): by precision, utility, recall, F1, threshold. An undefined rate counts as 0. The best
    F1 goes by recall, then the lower threshold. ``reachable`` of ``candidates`` thresholds meet the floor.

    Rows are counted by target and score first; only the counts meet the grid of thresholds."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    s = threshold_sweep(calibration, thresholds, keys).withColumns({c: zero(F.col(c)) for c in ("precision", "recall", "f1")}).withColumn("utility", F.col("tp") - F.lit(float(cost)) * F.col("fp"))
    met = F.col("precision") >= floor
    by_utility, by_precision = F.struct("utility", "f1", "recall", "precision", "threshold"), F.struct("precision", "utility", "recall", "f1", "threshold")
    g = s.groupBy(*keys).agg(
        F.max(F.when(met, by_utility)).alias("met"), F.max(by_precision).alias("rest"), F.sum(met.cast("int")).alias("reachable"), F.count("*").alias("candidates"),
        F.max_by("threshold", F.struct("f1", "recall", -F.col("threshold"))).alias("threshold_free"),
    )
    pick = lambda c: F.coalesce(F.col("met")[c], F.col("rest")[c])
    return g.select(*keys, "threshold_free", pick("threshold").alias("threshold"), F.when(F.col("met").isNull(), FALLBACK).otherwise(MET).alias("mode"), pick("precision").alias("precision"), F.round(pick("precision") - floor, 6).alias("margin"), pick("utility").alias("utility"), "reachable", "candidates")


def with_policy(scores: DataFrame, policies: DataFrame, keys: list[str]) -> DataFrame:
    """``scores`` with their fold's constrained threshold, its mode and the decision."""
    own = policies.select(*keys, F.col("threshold").alias("constrained_threshold"), F.col("mode").alias("constrained_mode"))
    return scores.join(own, keys).withColumn("constrained_pred", (F.col(P) >= F.col("constrained_threshold")).cast("int"))


def policy_table(decided: DataFrame, fixed: list[float]) -> DataFrame:
    """The constrained policy of ``with_policy`` beside fixed thresholds: confusion, rates, and by how much the constrained
    policy's positive rate, precision and recall are above those of each fixed one (for itself 0)."""
    hits = [F.struct(F.lit("constrained_policy").alias("policy"), F.col("constrained_pred").alias("hit"))]
    hits += [F.struct(F.lit(f"fixed_threshold_{t:.2f}").alias("policy"), (F.col(P) >= t).cast("int").alias("hit")) for t in fixed]
    counts = decided.groupBy(Y, P, "constrained_pred").agg(F.count("*").alias("n")).withColumn("h", F.explode(F.array(*hits)))
    y, hit, n = F.col(Y), F.col("h.hit"), F.col("n")
    cell = lambda a, b, name: F.sum(F.when((y == a) & (hit == b), n).otherwise(0)).alias(name)
    t = with_rates(counts.groupBy(F.col("h.policy").alias("policy")).agg(cell(1, 1, "tp"), cell(0, 1, "fp"), cell(0, 0, "tn"), cell(1, 0, "fn")))
    rates = ("positive_rate", "precision", "recall")
    own = t.where("policy = 'constrained_policy'").select(*(F.col(c).alias(f"own_{c}") for c in rates))  # one row
    return t.crossJoin(F.broadcast(own)).select(*t.columns, *(F.round(F.col(f"own_{c}") - F.col(c), 6).alias(f"delta_{c}") for c in rates))


def policy_summary(decided: DataFrame) -> DataFrame:
    """One row: rows, mean, smallest, largest and outer tenths of the constrained threshold, rows decided by fallback and
    their share, and how many rows each mode decided (``mode:n``, joined by ``;``)."""
    # Thresholds are few, one for each fold: they are counted before anything is ranked.
    t = decided.groupBy("constrained_threshold", "constrained_mode").agg(F.count("*").alias("n"))
    c, n = F.col("constrained_threshold"), F.col("n")
    fallback = F.sum(F.when(F.col("constrained_mode") == FALLBACK, n).otherwise(0))
    tenth = lambda p: F.round(F.percentile(c, F.lit(p), n), 6)
    whole = t.agg(
        F.sum("n").alias("rows"), F.round(F.sum(c * n) / F.sum("n"), 6).alias("threshold_mean"), F.min(c).alias("threshold_min"), F.max(c).alias("threshold_max"), tenth(0.1).alias("threshold_p10"),
        tenth(0.9).alias("threshold_p90"), fallback.alias("fallback_rows"), F.round(fallback / F.sum("n"), 6).alias("fallback_rate"),
    )
    modes = t.groupBy("constrained_mode").agg(F.sum("n").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("constrained_mode", "n"))), lambda m: F.concat(m["constrained_mode"], F.lit(":"), m["n"].cast("string"))), ";").alias("modes"))
    return whole.crossJoin(F.broadcast(modes))  # one row each
