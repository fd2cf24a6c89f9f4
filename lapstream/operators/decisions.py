"""Decisions against outcomes: labels, one-to-one matching, metrics, error taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .quantiles import with_quantiles

KEY = ["race", "driver", "lapNumber"]


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def count_if(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("long"))


def future_window_label(features: DataFrame, evals: DataFrame, horizon: int = 2) -> DataFrame:
    """The first stop in the laps k+1 .. k+horizon, and whether it was a success. A join bounded by the horizon."""
    e = evals.select("race", "driver", (F.col("pitLapNumber")).alias("pit"), "result", F.explode(F.sequence(F.col("pitLapNumber") - horizon, F.col("pitLapNumber") - 1)).alias("lapNumber"))
    first = e.groupBy(*KEY).agg(F.min(F.struct("pit", "result")).alias("m"))
    j = features.join(first, KEY, "left")
    return j.select(*features.columns, F.col("m.pit").alias("matchedPitLap"), F.col("m.result").alias("matchedResult"), F.coalesce(F.col("m.result").isin(S.POSITIVE_RESULTS), F.lit(False)).cast("int").alias("target_y"))


def dedup_priority(decisions: DataFrame) -> DataFrame:
    """One decision a key: by label, score, time."""
    order = [S.choose(F.col("suggestionLabel"), S.LABEL_PRIORITY, 0).desc(), F.col("totalScore").desc(), F.col("eventTimeMillis").desc()]
    return decisions.withColumn("__r", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where("__r = 1").drop("__r")


def match_decisions(decisions: DataFrame, evals: DataFrame, horizon: int = 2, by: list[str] | None = None) -> DataFrame:
    """Each decision at lap k takes the earliest unused stop in k .. k+horizon; one stop serves one decision.

    Laps only rise within a driver's race, so one pointer into the sorted stops suffices: a fold over two sorted
    arrays for each race and driver, which a race bounds. Returns the decision's keys (and ``by``), matchedPitLap,
    matchedResult, nextPitLap (used or not), pitInWindow, outcome and exclusionReason.
    """
    by = by or []
    d = decisions.groupBy(*by, "race", "driver").agg(F.array_sort(F.collect_list("lapNumber")).alias("laps"))
    e = evals.groupBy("race", "driver").agg(F.array_sort(F.collect_list(F.struct(F.col("pitLapNumber").alias("lap"), "result"))).alias("pits"))
    j = d.join(e, ["race", "driver"], "left").withColumn("pits", F.coalesce("pits", F.array().cast("array<struct<lap:int,result:string>>")))

    def step(acc, k):
        free = F.filter("pits", lambda p, i: (i >= acc["ptr"]) & (p["lap"] >= k))
        got = F.get(free, F.lit(0))
        hit = F.coalesce(got["lap"] <= k + horizon, F.lit(False))
        after = F.size("pits") - F.size(free) + 1
        coming = F.get(F.filter("pits", lambda p: p["lap"] >= k), F.lit(0))["lap"]
        row = F.struct(k.alias("lapNumber"), F.when(hit, got["lap"]).alias("pit"), F.when(hit, got["result"]).alias("result"), coming.alias("coming"))
        return F.struct(F.when(hit, after).otherwise(acc["ptr"]).alias("ptr"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    zero = F.struct(F.lit(0).alias("ptr"), F.array().cast("array<struct<lapNumber:int,pit:int,result:string,coming:int>>").alias("rows"))
    rows = j.select(*by, "race", "driver", F.explode(F.aggregate("laps", zero, step)["rows"]).alias("r"))
    result = S.normalize_label(F.col("r.result"))
    out = rows.select(
        *by, "race", "driver", F.col("r.lapNumber").alias("lapNumber"), F.col("r.pit").alias("matchedPitLap"), F.col("r.result").alias("matchedResult"), F.col("r.coming").alias("nextPitLap"),
        F.coalesce(F.col("r.coming") <= F.col("r.lapNumber") + horizon, F.lit(False)).alias("pitInWindow"),
        F.when(F.col("r.pit").isNull(), F.lit("EXCLUDED")).otherwise(S.outcome_of(result)).alias("outcome"),
        F.when(F.col("r.pit").isNull(), F.lit("NO_MATCH_WITHIN_HORIZON")).otherwise(S.exclusion_reason(result)).alias("exclusionReason"),
    )
    return out


def decision_metrics(matched: DataFrame, keys: list[str]) -> DataFrame:
    scored = F.col("outcome") != "EXCLUDED"
    g = matched.groupBy(*keys).agg(F.count("*").alias("actionable"), count_if(scored).alias("scored"), count_if(~scored).alias("excluded"), count_if(F.col("outcome") == "1").alias("tp"), count_if(F.col("outcome") == "0").alias("fp"))
    return g.withColumn("precision", ratio(F.col("tp"), F.col("scored"))).withColumn("coverage", ratio(F.col("scored"), F.col("actionable")))


def metrics_rollup(matched: DataFrame) -> DataFrame:
    """Overall, by year and by race in one pass."""
    scored = F.col("outcome") != "EXCLUDED"
    g = matched.withColumn("year", S.year_of_race(F.col("race"))).rollup("year", "race").agg(F.count("*").alias("actionable"), count_if(scored).alias("scored"), count_if(F.col("outcome") == "1").alias("tp"))
    return g.withColumn("precision", ratio(F.col("tp"), F.col("scored")))


def exclusion_distribution(matched: DataFrame, top: int = 10) -> DataFrame:
    g = matched.where("outcome = 'EXCLUDED'").groupBy("exclusionReason").agg(F.count("*").alias("n"))
    return g.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy()))).orderBy(F.col("n").desc(), "exclusionReason").limit(top)


def near_miss_distribution(matched: DataFrame, horizon: int = 2) -> DataFrame:
    x = matched.where("matchedPitLap is null").withColumn("bucket", S.near_miss_bucket(F.col("nextPitLap") - F.col("lapNumber"), horizon))
    g = x.groupBy("bucket").agg(F.count("*").alias("n"))
    return g.withColumn("rate", ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))


def threshold_frontier(scores: DataFrame, evals: DataFrame, thresholds: list[float], horizon: int = 2) -> DataFrame:
    """Matching and metrics at every threshold as one job: the threshold is one more grouping key."""
    grid = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    d = scores.withColumn("threshold", grid).where("totalScore >= threshold").select("threshold", *KEY)
    m = match_decisions(d, evals, horizon, by=["threshold"])
    return decision_metrics(m, ["threshold"])


def by_year_wide(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select("year", F.col("precision").alias("precision_a"), F.col("scored").alias("scored_a"))
    y = b.select("year", F.col("precision").alias("precision_b"), F.col("scored").alias("scored_b"))
    return x.join(y, "year", "full").withColumn("delta", F.round(F.col("precision_b") - F.col("precision_a"), 6)).withColumn("scored_ratio", ratio(F.col("scored_b"), F.col("scored_a")))


def paired_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """2 x 2 counts of two sources' scored decisions on one key, and McNemar's corrected chi-square."""
    j = a.where("outcome <> 'EXCLUDED'").select(*KEY, (F.col("outcome") == "1").alias("x")).join(b.where("outcome <> 'EXCLUDED'").select(*KEY, (F.col("outcome") == "1").alias("y")), KEY)
    g = j.agg(F.count("*").alias("overlap"), F.coalesce(count_if(F.col("x") & ~F.col("y")), F.lit(0)).alias("only_a"), F.coalesce(count_if(~F.col("x") & F.col("y")), F.lit(0)).alias("only_b"))
    d = F.greatest(F.lit(0), F.abs(F.col("only_a") - F.col("only_b")) - 1)
    return g.withColumn("chi_square", ratio(d * d, F.col("only_a") + F.col("only_b")))


def fp_overlap_sets(sources: dict[str, DataFrame]) -> DataFrame:
    """How many false-positive keys are in each combination of sources."""
    rows = None
    for name, df in sources.items():
        x = df.where("outcome = '0'").select(*KEY).distinct().withColumn("source", F.lit(name))
        rows = x if rows is None else rows.unionByName(x)
    flags = rows.groupBy(*KEY).agg(*(F.max((F.col("source") == n).cast("int")).alias(f"in_{n}") for n in sources))
    return flags.groupBy(*(f"in_{n}" for n in sources)).agg(F.count("*").alias("n"))


def feature_effects(rows: DataFrame, columns: list[str], positive: Column) -> DataFrame:
    """For each feature: size, mean, spread, median and outer tenths among true and false positives, and Cohen's d."""
    long = rows.select(positive.alias("tp"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("f")).select("tp", "f.*")
    of = lambda t, f: f(F.when(F.col("tp") == t, F.col("v")))
    sides, tenths = (("tp", True), ("fp", False)), {"median": 0.5, "p10": 0.1, "p90": 0.9}
    g = long.groupBy("feature").agg(of(True, F.count).alias("n_tp"), of(False, F.count).alias("n_fp"), of(True, F.avg).alias("m1"), of(False, F.avg).alias("m0"), of(True, F.var_pop).alias("v1"), of(False, F.var_pop).alias("v0"))
    spine = rows.sparkSession.createDataFrame([(c, t) for c in columns for _, t in sides], "feature string, tp boolean")
    both = with_quantiles(spine, long.where("tp is not null"), ["feature", "tp"], F.col("v"), tenths)
    wide = both.groupBy("feature").agg(*(F.max(F.when(F.col("tp") == t, F.round(n, 6))).alias(f"{n}_{k}") for k, t in sides for n in tenths))
    d = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt((F.col("v1") + F.col("v0")) / 2))
    means = g.select("feature", "n_tp", "n_fp", F.round("m1", 6).alias("mean_tp"), F.round("m0", 6).alias("mean_fp"), F.round(F.sqrt("v1"), 6).alias("std_tp"), F.round(F.sqrt("v0"), 6).alias("std_fp"), F.round(d, 6).alias("cohens_d"))
    return means.join(wide, "feature")


def emit_gate(scores: DataFrame, least: float = 40.0, delta: float = 10.0, repeat: int = 2, peak: float = 70.0, slow: float = 0.005) -> DataFrame:
    """Scores worth telling (again), of ``pit_scores`` at new laps and under caution: a new stint, a label other than the class of the last told score,
    another status, a jump of the score, a rise of timing pressure by 2 while action is called for, or every ``repeat``
    laps while it is. Once a stint, a slow car whose score fell from ``peak`` or above to below ``least`` is a LOST_CHANCE.

    A fold over each driver's moments, which a race bounds, since what was told last decides what is told next."""
    c = F.col
    per = scores.groupBy("race", "driver").agg(F.array_sort(F.collect_list(F.struct("snapMillis", "lapNumber", "stint", "score", "label", c("now").alias("status"), "timing", "action", "pace"))).alias("rows"))

    def step(acc, r):
        same = F.coalesce(acc["on"] == r["stint"], F.lit(False))
        high = F.greatest(F.when(same, acc["peak"]).otherwise(0.0), r["score"])
        lost = F.when(same, acc["lost"]).otherwise(F.lit(False))
        gone = ~lost & (high >= peak) & (r["score"] < least) & (r["pace"] > slow)
        calls = r["label"].isin("PIT_NOW", "GOOD_PIT")
        told = S.score_class(acc["score"])
        again = (
            F.coalesce(acc["stint"] != r["stint"], F.lit(True))
            | (told != r["label"])
            | (acc["status"] != r["status"])
            | (F.abs(r["score"] - acc["score"]) >= delta)
            | (calls & (r["action"] >= 10) & (r["timing"] - acc["timing"] >= 2))
            | (calls & (r["lapNumber"] - acc["lap"] >= repeat))
        )
        tell = ~gone & (r["score"] >= least) & again
        row = F.struct(r["lapNumber"].alias("lapNumber"), r["snapMillis"].alias("snapMillis"), r["score"].alias("score"), F.when(gone, "LOST_CHANCE").otherwise(r["label"]).alias("label"))
        keep = lambda new, name: F.when(tell, new).otherwise(acc[name]).alias(name)
        return F.struct(
            r["stint"].alias("on"), high.alias("peak"), (lost | gone).alias("lost"), keep(r["stint"], "stint"), keep(r["status"], "status"), keep(r["score"], "score"),
            keep(r["timing"], "timing"), keep(r["lapNumber"], "lap"), F.when(tell | gone, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"),
        )

    none = lambda t, n: F.lit(None).cast(t).alias(n)
    zero = F.struct(none("int", "on"), F.lit(0.0).alias("peak"), F.lit(False).alias("lost"), none("int", "stint"), none("string", "status"), none("double", "score"), none("double", "timing"), none("int", "lap"), F.array().cast("array<struct<lapNumber:int,snapMillis:bigint,score:double,label:string>>").alias("out"))
    return per.select("race", "driver", F.explode(F.aggregate("rows", zero, step)["out"]).alias("o")).select("race", "driver", "o.*")


def suggest_error_tag(row: dict[str, Column]) -> Column:
    """Tag of a case for review, from its origin, subtype and the lap's context."""
    scored = row["case_origin"] == "scored_fp"
    upset = (row["trackStatus"] > 1) | F.coalesce(row["rainfall"], F.lit(False))
    fp = F.when(upset, "Weather / Safety Car Disruption").when(row["progress"] >= 0.8, "End-of-Race Tire Management").when((row["gapAhead"] <= 1.2) | (row["gapBehind"] <= 1.2), "Traffic / DRS Train").otherwise("Strategic Offset / Gamble")
    sub = row["subtype"]
    ex = (
        F.when(sub == "unexpected_within_horizon", "Duplicate Trigger (Comparator One-to-One Consumption)")
        .when(sub == "near_miss_3_5", "Near-Miss Strategic Extension")
        .when((sub == "far_miss_6_plus") & (row["progress"] >= 0.7), "Long-Stint Conservation")
        .when(sub == "far_miss_6_plus", "Early/Mid Stint Strategic Deferral")
        .when((sub == "no_future") & (row["progress"] >= 0.65), "One-Stop Stretch / No Further Stop")
        .when(sub == "no_future", "No-Future Stop (Unrealized Signal)")
        .otherwise("Unclassified Exclusion")
    )
    return F.when(scored, fp).otherwise(ex)


def decisions_from_scores(scores: DataFrame, threshold: float) -> DataFrame:
    """Scores from the threshold on as decisions; the total is the score in per cent."""
    return scores.where(F.col("raw_proba") >= threshold).select(*KEY, F.lit("PIT_NOW").alias("suggestionLabel"), (F.col("raw_proba") * 100).alias("totalScore"))


def decode_codes(df: DataFrame, code: str, target: str, purity: float) -> DataFrame:
    """``df`` with ``decoded``, the target that most rows of its code have (ties to the larger); null where their share
    is below ``purity``. Codes are counted first, so one row for each code meets the rows."""
    counts = df.groupBy(code, target).agg(F.count("*").alias("n"))
    mapping = counts.groupBy(code).agg(F.max_by(target, F.struct("n", target)).alias("decoded"), (F.max("n") / F.sum("n")).alias("share")).select(code, F.when(F.col("share") >= purity, F.col("decoded")).alias("decoded"))
    return df.join(mapping, code, "left")


def drop_zone_join(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """``rows`` with their drop zone: position (0 without one), gap to the car ahead (999), and whether there is one.

    ``zones`` (race, driver, lapNumber, position, gap) must have a key once; ``duplicate_key_stats`` tells."""
    hit = zones.select(*KEY, F.col("position").alias("dropPosition"), F.col("gap").alias("dropGap"), F.lit(True).alias("hit"))
    return rows.join(hit, KEY, "left").withColumns({"dropPosition": F.coalesce("dropPosition", F.lit(0)), "dropGap": F.coalesce("dropGap", F.lit(999.0)), "hasDropZone": F.coalesce("hit", F.lit(False))}).drop("hit")


def key_membership(timeline: DataFrame, decided: DataFrame, available: DataFrame) -> DataFrame:
    """``timeline`` keys with ``prediction``: 1 where decided, 0 where available only, null where neither."""
    flag = lambda df, name: df.select(*KEY).distinct().withColumn(name, F.lit(1))
    j = timeline.select(*KEY).join(flag(decided, "d"), KEY, "left").join(flag(available, "a"), KEY, "left")
    return j.select(*KEY, F.when(F.col("d") == 1, 1).when(F.col("a") == 1, 0).alias("prediction"))
