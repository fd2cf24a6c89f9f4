"""Evaluation of scores: binary metrics, reliability, thresholds, curves, bootstrap, rule tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decisions import count_if, ratio
from .quantiles import numbered, with_quantiles

Y, P = "target_y", "raw_proba"


def confusion(y: Column, positive: Column) -> list[Column]:
    return [count_if((y == 1) & positive).alias("tp"), count_if((y == 0) & positive).alias("fp"), count_if((y == 0) & ~positive).alias("tn"), count_if((y == 1) & ~positive).alias("fn")]


def with_rates(g: DataFrame) -> DataFrame:
    c = F.col
    return g.withColumn("precision", ratio(c("tp"), c("tp") + c("fp"))).withColumn("recall", ratio(c("tp"), c("tp") + c("fn"))).withColumn("f1", ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))).withColumn("positive_rate", ratio(c("tp") + c("fp"), c("tp") + c("fp") + c("tn") + c("fn")))


def binary_metrics(df: DataFrame, threshold: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    return with_rates(df.groupBy(*(keys or [])).agg(*confusion(F.col(Y), F.col(P) >= threshold)))


def threshold_sweep(df: DataFrame, thresholds: list[float], keys: list[str] | None = None) -> DataFrame:
    """Metrics at every threshold. Rows are counted by (target, score) first; only counts meet the grid."""
    counts = df.groupBy(*(keys or []), Y, P).agg(F.count("*").alias("n"))
    t = counts.withColumn("threshold", F.explode(F.array(*(F.lit(float(x)) for x in thresholds))))
    hit, y, n = F.col(P) >= F.col("threshold"), F.col(Y), F.col("n")
    cell = lambda c, name: F.sum(F.when(c, n).otherwise(0)).alias(name)
    return with_rates(t.groupBy(*(keys or []), "threshold").agg(cell((y == 1) & hit, "tp"), cell((y == 0) & hit, "fp"), cell((y == 0) & ~hit, "tn"), cell((y == 1) & ~hit, "fn")))


def best_threshold(sweep: DataFrame, floor: float = 0.0) -> DataFrame:
    """The threshold of the best F1 with a precision of at least ``floor``; ties go to the higher one."""
    return sweep.where(F.col("precision") >= floor).agg(F.max_by("threshold", F.struct("f1", "precision", "threshold")).alias("threshold"), F.max("f1").alias("f1"))


def locked_threshold(calibration: DataFrame, test: DataFrame, thresholds: list[float], floor: float = 0.0) -> DataFrame:
    """Metrics of ``test`` at the threshold that is best on ``calibration`` (0.5 if none reaches the precision floor)."""
    best = best_threshold(threshold_sweep(calibration, thresholds), floor).select(F.coalesce("threshold", F.lit(0.5)).alias("threshold"))
    counts = test.groupBy(Y, P).agg(F.count("*").alias("n")).crossJoin(F.broadcast(best))  # one row
    hit, y = F.col(P) >= F.col("threshold"), F.col(Y)
    cell = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    return with_rates(counts.groupBy("threshold").agg(cell((y == 1) & hit, "tp"), cell((y == 0) & hit, "fp"), cell((y == 0) & ~hit, "tn"), cell((y == 1) & ~hit, "fn")))


def fold_metrics(df: DataFrame, thresholds: list[float], floor: float, keys: list[str]) -> DataFrame:
    """For each fold: average precision, its lift over the prevalence, Brier score, F1 at 0.5, and the thresholds of the
    best F1 without and with the precision floor. Scores are counted before they are ranked."""
    g = df.groupBy(*keys, P).agg(F.count("*").alias("n"), F.sum(Y).alias("pos"))
    w = Window.partitionBy(*keys).orderBy(F.col(P).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, pos, p = F.col("n"), F.col("pos"), F.col(P)
    ap, base = F.sum(pos * F.col("pr")) / F.sum("pos"), F.sum("pos") / F.sum("n")
    ranked = g.withColumn("pr", F.sum("pos").over(w) / F.sum("n").over(w)).groupBy(*keys).agg(
        F.round(ap, 6).alias("average_precision"), F.round(base, 6).alias("prevalence"), F.round(ap / base, 6).alias("lift"), F.round(F.sum(pos * (1 - p) * (1 - p) + (n - pos) * p * p) / F.sum("n"), 6).alias("brier")
    )
    order, enough = F.struct("f1", "precision", "threshold"), F.col("precision") >= floor
    chosen = threshold_sweep(df, thresholds, keys).groupBy(*keys).agg(
        F.max_by("threshold", order).alias("threshold_free"), F.max("f1").alias("f1_free"), F.max_by("threshold", F.when(enough, order)).alias("threshold_floor"), F.max(F.when(enough, F.col("f1"))).alias("f1_floor")
    )
    fixed = binary_metrics(df, 0.5, keys).select(*keys, F.col("f1").alias("f1_baseline"))
    return ranked.join(chosen, keys).join(fixed, keys)


def reliability_bins(df: DataFrame, bins: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Size, mean score and frequency of each of ``bins`` equal ranges of the score; empty ones have n = 0."""
    keys = keys or []
    b = F.least(F.floor(F.col(P) * bins), F.lit(bins - 1)).cast("int")
    g = df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(P), 6).alias("confidence"), F.round(F.avg(F.col(Y).cast("double")), 6).alias("frequency"))
    spine = g.groupBy(*keys).agg(F.count("*")).select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(g, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), "confidence", "frequency")


def quantile_bins(df: DataFrame, bins: int) -> DataFrame:
    """Reliability in ranges between quantiles of the score; equal edges are one, the ends are 0 and 1."""
    inner = F.percentile(P, F.array(*(F.lit(i / bins) for i in range(1, bins))))
    edges = df.agg(inner.alias("e")).select(F.array_distinct(F.concat(F.array(F.lit(0.0)), F.coalesce("e", F.array().cast("array<double>")), F.array(F.lit(1.0)))).alias("e"))
    counts = df.groupBy(P).agg(F.count("*").alias("n"), F.sum(Y).alias("pos")).crossJoin(F.broadcast(edges))  # one row
    i = F.least(F.size(F.filter("e", lambda x: x <= F.col(P))), F.size("e") - 1)
    rows = counts.select((i - 1).alias("bin"), F.round(F.element_at("e", i), 6).alias("lo"), F.round(F.element_at("e", i + 1), 6).alias("hi"), P, "n", "pos")
    return rows.groupBy("bin", "lo", "hi").agg(F.sum("n").alias("n"), F.round(F.sum(F.col(P) * F.col("n")) / F.sum("n"), 6).alias("confidence"), F.round(F.sum("pos") / F.sum("n"), 6).alias("frequency"))


def calibration_errors(df: DataFrame, bins: int = 10, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    b = F.least(F.floor(F.col(P) * bins), F.lit(bins - 1)).cast("int")
    g = df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(P).alias("c"), F.avg(F.col(Y).cast("double")).alias("f"), F.sum((F.col(P) - F.col(Y)) * (F.col(P) - F.col(Y))).alias("sq"))
    gap = F.abs(F.col("c") - F.col("f"))
    return g.groupBy(*keys).agg(F.sum("n").alias("n"), F.round(F.sum(gap * F.col("n")) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap), 6).alias("mce"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))


def pr_points(df: DataFrame) -> DataFrame:
    """Precision and recall at each distinct score. Running counts over scores are made in two levels, in 256
    ranges of the score and then across ranges, so that no window sees all of them."""
    g = df.groupBy(P).agg(F.count("*").alias("n"), F.sum(Y).alias("pos")).withColumn("part", F.floor(F.col(P) * 256))
    inside = Window.partitionBy("part").orderBy(F.col(P).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = g.groupBy("part").agg(F.sum("n").alias("pn"), F.sum("pos").alias("pp"))
    above = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = parts.select("part", F.coalesce(F.sum("pn").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("pp").over(above), F.lit(0)).alias("p0"), F.sum("pp").over(everything).alias("allpos"), F.sum("pn").over(everything).alias("alln"))
    x = g.withColumn("cn", F.sum("n").over(inside)).withColumn("cp", F.sum("pos").over(inside)).join(offsets, "part")
    tp, n = F.col("cp") + F.col("p0"), F.col("cn") + F.col("n0")
    return x.select(F.col(P).alias("threshold"), F.col("pos"), tp.alias("tp"), (n - tp).alias("fp"), (tp / n).alias("precision"), (tp / F.col("allpos")).alias("recall"), "allpos", "alln")


def average_precision(df: DataFrame) -> DataFrame:
    return pr_points(df).agg(F.round(F.sum(F.col("pos") / F.col("allpos") * F.col("precision")), 6).alias("average_precision"), F.count("*").alias("points"))


def pr_gain(points: DataFrame) -> DataFrame:
    base = F.col("allpos") / F.col("alln")
    gain = lambda x: F.try_divide(x - base, (1 - base) * x)
    return points.where("tp > 0").select("threshold", F.round(gain(F.col("precision")), 6).alias("precision_gain"), F.round(gain(F.col("recall")), 6).alias("recall_gain"))


def decision_curve(df: DataFrame, thresholds: list[float]) -> DataFrame:
    s = threshold_sweep(df, thresholds)
    n, odds = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"), F.col("threshold") / (1 - F.col("threshold"))
    prev = (F.col("tp") + F.col("fn")) / n
    return s.select("threshold", F.round(F.col("tp") / n - F.col("fp") / n * odds, 6).alias("net_benefit"), F.round(prev - (1 - prev) * odds, 6).alias("treat_all"), F.lit(0.0).alias("treat_none"))


def numeric_profile(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    g = df.groupBy(*keys).agg(F.count(column).alias("n"), F.round(F.min(column), 3).alias("min"), F.round(F.avg(column), 3).alias("mean"), F.round(F.max(column), 3).alias("max"))
    q = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return with_quantiles(g, df, keys, F.col(column), q).select(*keys, "n", "min", "mean", *(F.round(k, 3).alias(k) for k in q), "max")


def null_profile(df: DataFrame) -> DataFrame:
    counts = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.round(F.col(c) * 100, 3).alias("null_pct")) for c in df.columns)))
    return counts.select(pairs.alias("x")).select("x.*")


def top_nulls(df: DataFrame, top: int = 8) -> DataFrame:
    """The columns with the most nulls, most first, ties by name."""
    return null_profile(df).orderBy(F.col("null_pct").desc(), "column").limit(top)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one in all columns."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("__n")).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def latency_summary(df: DataFrame, components: list[str], total: str, warmup: int, keys: list[str]) -> DataFrame:
    """For each component of the events after the warm-up: percentiles, mean and maximum of the good ones in ms, the share
    of good events, and the component's share of the total time."""
    ok = F.col("status") == "ok"
    long = df.where(F.col("event_index") > warmup).select(*keys, ok.alias("ok"), F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.when(ok, F.col(c).cast("double")).alias("v"), F.when(ok, F.col(total).cast("double")).alias("all")) for c in components))).alias("x")).select(*keys, "ok", "x.*")
    g = long.groupBy(*keys, "component").agg(F.count("v").alias("n"), F.round(F.avg("v"), 3).alias("mean"), F.round(F.max("v"), 3).alias("max"), ratio(count_if(F.col("ok")), F.count("*")).alias("availability"), F.round(F.sum("v") / F.sum("all"), 6).alias("share"))
    q = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return with_quantiles(g, long, [*keys, "component"], F.col("v"), q).select(*keys, "component", "n", *(F.round(k, 3).alias(k) for k in q), "mean", "max", "availability", "share")


def duplicate_key_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().agg(count_if(F.col("count") > 1).alias("duplicate_keys"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("excess_rows"))


def wilson_interval(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = k / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.round((mid - half) / (1 + z * z / n), 6), F.round((mid + half) / (1 + z * z / n), 6)


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    p = (k1 + k2) / (n1 + n2)
    return F.round(F.try_divide(k1 / n1 - k2 / n2, F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))), 6)


def normal_tail(z: float) -> float:
    """Two-sided p-value, on the one-row result."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def mcnemar_exact(only_a: int, only_b: int) -> float:
    """Exact binomial p-value of the discordant pairs, on the one-row result."""
    n, k = only_a + only_b, min(only_a, only_b)
    return 1.0 if n == 0 else min(1.0, 2.0 * sum(math.comb(n, i) for i in range(k + 1)) / 2.0**n)


def rolling_agreement(df: DataFrame, by: str, order: list[str], window: int, least: int) -> DataFrame:
    """Accuracy and Cohen's kappa of predictions over the last ``window`` rows of each timeline.

    A window is the difference of two prefix sums (``numbered``), the row's and that of the row ``window`` places before,
    found by an equi-join; so a window may cross ranges, and one long timeline is not one task."""
    y, p = F.col(Y), F.col("pred")
    flag = lambda x: F.coalesce(x.cast("long"), F.lit(0).cast("long"))
    sums = {"__n": flag(p.isNotNull()), "__hit": flag(y == p), "__y": flag(F.when(p.isNotNull(), y)), "__p": flag(p)}
    x = numbered(df.select(by, *order, Y, "pred"), by, order, sums)
    before = x.select(by, (F.col("__i") + window).alias("__i"), *(F.col(c).alias(f"{c}0") for c in sums))
    x = x.join(before, [by, "__i"], "left").withColumns({c: F.col(c) - F.coalesce(f"{c}0", F.lit(0)) for c in sums})
    n = F.col("__n")
    ty, tp = F.col("__y") / n, F.col("__p") / n
    chance = ty * tp + (1 - ty) * (1 - tp)
    x = x.where(n >= least).select(by, *order, n.alias("n"), (F.col("__hit") / n).alias("acc"), chance.alias("chance"))
    return x.select(by, *order, "n", F.round("acc", 6).alias("accuracy"), F.round(F.try_divide(F.col("acc") - F.col("chance"), 1 - F.col("chance")), 6).alias("kappa"))


def chronological_windows(df: DataFrame, by: str, order: list[str], windows: int, least: int = 1) -> DataFrame:
    """``df`` with ``window``: each timeline ``by`` in ``windows`` slices of equal counts (0, 1, ..). Slices under ``least``
    rows go; a timeline without any slice left is slice 0 whole. Places come from ``numbered``, so no timeline is a task."""
    x = numbered(df, by, order, {})
    total = x.groupBy(by).agg(F.max("__i").alias("__n"))
    slot = F.floor((F.col("__i") - 1) * windows / F.col("__n")).cast("int")
    x = x.join(total, by).withColumn("window", slot).drop("__i", "__n")
    sizes = x.groupBy(by, "window").agg(F.count("*").alias("__size")).where(F.col("__size") >= least).select(by, "window", F.lit(True).alias("__kept"))
    none = sizes.select(by).distinct().withColumn("__any", F.lit(True))
    x = x.join(sizes, [by, "window"], "left").join(none, by, "left")
    return x.where("__kept or __any is null").withColumn("window", F.when(F.col("__any"), F.col("window")).otherwise(F.lit(0))).drop("__kept", "__any")


def rules(source: DataFrame, checks: list[tuple[str, Column]], threshold: int = 0) -> DataFrame:
    """One row for each rule: how many rows break it, and PASS or FAIL. One pass over the table."""
    one = source.agg(*(count_if(c).alias(n) for n, c in checks))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).alias("value")) for n, _ in checks)))
    return one.select(rows.alias("x")).select("x.check", "x.value", F.when(F.col("x.value") <= threshold, "PASS").otherwise("FAIL").alias("status"))


def gate(checks: DataFrame) -> DataFrame:
    """The worst status over all rules: NO_GO on a failure, GO_WITH_CONDITIONS on a hold, else GO."""
    worst = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "HOLD", 1).otherwise(0))
    return checks.agg(F.count("*").alias("checks"), count_if(F.col("status") == "PASS").alias("passed"), F.when(worst == 2, "NO_GO").when(worst == 1, "GO_WITH_CONDITIONS").otherwise("GO").alias("decision"))


def hash_draw(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / 4294967296.0


#: Repetitions of a bootstrap that are summed side by side.
AT_ONCE = 20


def ap_bootstrap(df: DataFrame, other: str, reps: int, seed: int = 12345) -> DataFrame:
    """Average-precision difference of two scores for each repetition of a bootstrap over races.

    Draws come from hashes of the repetition and the draw, so reruns agree; a repetition weighs each race by how often
    it was drawn, so the work is reps times the per-race score histograms, never reps times the rows. ``AT_ONCE`` repetitions
    are summed in one row: a histogram meets its race's weights as arrays, and races are numbered over ranges.
    """
    races = numbered(df.select(F.lit(0).alias("all"), "race").distinct(), "all", ["race"], {}).select("race", (F.col("__i") - 1).alias("i"))
    draws = races.crossJoin(F.broadcast(races.agg(F.count("*").alias("n")))).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    drawn = draws.select("rep", F.floor(hash_draw(F.lit(seed), F.col("rep"), F.col("i")) * F.col("n")).cast("int").alias("i"))
    weight = lambda k: F.sum((F.col("rep") % AT_ONCE == k).cast("long"))
    weights = drawn.groupBy("i", F.floor(F.col("rep") / AT_ONCE).alias("block")).agg(F.array(*(weight(k) for k in range(AT_ONCE))).alias("w")).join(races, "i")
    long = df.select("race", Y, F.explode(F.array(*(F.struct(F.lit(n).alias("model"), F.col(c).alias("s")) for n, c in (("a", P), ("b", other))))).alias("m")).select("race", Y, "m.*")
    hist = long.groupBy("race", "model", "s").agg(F.count("*").alias("n"), F.sum(Y).alias("pos"))
    sums = [F.sum(F.col(v) * F.get("w", F.lit(k))).alias(f"{v}{k}") for v in ("n", "pos") for k in range(AT_ONCE)]
    g = hist.join(weights.select("block", "race", "w"), "race").groupBy("block", "model", "s").agg(*sums)
    each = F.array(*(F.struct((F.col("block") * AT_ONCE + k).alias("rep"), F.col(f"n{k}").alias("n"), F.col(f"pos{k}").alias("pos")) for k in range(AT_ONCE)))
    g = g.select("model", "s", F.explode(each).alias("g")).select("model", "s", "g.*").where("n > 0")
    w = Window.partitionBy("rep", "model").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = g.withColumn("precision", F.sum("pos").over(w) / F.sum("n").over(w))
    ap = x.groupBy("rep").agg(*(F.sum(F.when(F.col("model") == m, F.col("pos") * F.col("precision"))).alias(f"s{m}") for m in "ab"), *(F.sum(F.when(F.col("model") == m, F.col("pos"))).alias(f"p{m}") for m in "ab"))
    return ap.select("rep", F.round(F.try_divide(F.col("sb"), F.col("pb")) - F.try_divide(F.col("sa"), F.col("pa")), 6).alias("delta"))


def ap_interval(deltas: DataFrame, level: float = 0.95) -> DataFrame:
    """Repetitions, mean and percentile interval of the differences of ``ap_bootstrap``, and how often they are above 0."""
    d, tail = F.col("delta"), (1 - level) / 2
    return deltas.agg(F.count(d).alias("reps"), F.round(F.avg(d), 6).alias("mean"), F.round(F.percentile(d, tail), 6).alias("low"), F.round(F.percentile(d, 1 - tail), 6).alias("high"), ratio(count_if(d > 0), F.count(d)).alias("above_zero"))
