"""Audits of splits, decisions and streams, the gate over layers, and measures of a threshold frontier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .decisions import KEY, count_if, match_decisions, ratio
from .ml import leaks, split_plan

#: Labels that call for action, outcomes, and reasons for an exclusion (the last two are beginnings).
ACTIONABLE = ("PIT_NOW", "GOOD_PIT")
OUTCOMES = ("0", "1", "EXCLUDED")
REASONS = ("", "NO_MATCH_WITHIN_HORIZON", "WEATHER_SURVIVAL_STOP", "MISSING_RESULT")
REASON_STARTS = ("UNRESOLVED_", "UNMAPPED_RESULT_")


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _share_left(bad: Column, of: Column) -> Column:
    """1 - bad / of, 1 for nothing at all."""
    return F.round(1 - F.coalesce(F.try_divide(bad.cast("double"), of.cast("double")), F.lit(0.0)), 6)


def split_integrity(dataset: DataFrame, oof: DataFrame, folds: int, plan: DataFrame | None = None) -> DataFrame:
    """(check, value, status): seven rules on a training table and its out-of-fold scores, and whether all hold.

    ``dataset`` has race and maybe sourceYear, ``oof`` race and fold; ``plan`` (fold, race, role) is by default the grouped
    one. A value is the share that keeps the rule and PASS means 1. Each table is aggregated to races once."""
    plan = split_plan(dataset, "race", "grouped", folds) if plan is None else plan
    year = S.year_of_race(F.col("race"))
    other = (year != F.col("sourceYear")) if "sourceYear" in dataset.columns else F.lit(False)
    races = dataset.groupBy("race").agg(F.count("*").alias("n"), count_if(other).alias("wrong_year"))
    named = F.coalesce(F.col("race").rlike(r"^\d{4}\s::\s.+$"), F.lit(False))
    scored = oof.groupBy("race").agg(F.count("*").alias("m"), F.collect_set("fold").alias("folds"))
    both = races.join(scored, races["race"].eqNullSafe(scored["race"]), "full").select(races["race"], "n", "wrong_year", "m", "folds")
    c = F.col
    totals = both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("m"), F.lit(0)).alias("scored"), F.coalesce(F.sum(F.when(~named & c("n").isNotNull(), c("n"))), F.lit(0)).alias("unnamed"), F.coalesce(F.sum("wrong_year"), F.lit(0)).alias("wrong"),
        count_if(c("m").isNotNull()).alias("races"), count_if(F.size("folds") > 1).alias("several"), count_if(c("n").isNull() | c("m").isNull()).alias("apart"), F.size(F.array_distinct(F.flatten(F.collect_set("folds")))).alias("seen"),
    )
    x = totals.crossJoin(F.broadcast(leaks(plan, "race").agg(F.count("*").alias("leaks"))))  # one row each
    values = {
        "race_key_prefix_format": _share_left(c("unnamed"), c("rows")),
        "source_year_prefix_consistency": _share_left(c("wrong"), c("rows")),
        "grouped_kfold_no_race_overlap": F.when(c("leaks") == 0, 1.0).otherwise(0.0),
        "oof_fold_uniqueness_per_race": _share_left(F.coalesce("several", F.lit(0)), c("races")),
        "oof_row_coverage_vs_dataset": F.coalesce(ratio(c("scored"), c("rows")), F.lit(0.0)),
        "oof_race_universe_match": F.when(F.coalesce("apart", F.lit(0)) == 0, 1.0).otherwise(0.0),
        "oof_fold_count_match": ratio(F.greatest("seen", F.lit(0)), F.lit(folds)),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("check"), v.alias("value")) for k, v in values.items()))
    whole = F.struct(F.lit("split_integrity_overall").alias("check"), F.when(F.forall(rows, lambda r: r["value"] == 1), 1.0).otherwise(0.0).alias("value"))
    return x.select(F.explode(F.concat(rows, F.array(whole))).alias("r")).select("r.check", "r.value", F.when(F.col("r.value") == 1, "PASS").otherwise("FAIL").alias("status"))


def decision_contract(matched: DataFrame, horizon: int = 2, keys: list[str] | None = None) -> DataFrame:
    """(keys, check, value, status): the seven rules that matched decisions keep: labels, outcomes, distance within the
    horizon, a stop serves one decision, the window flag, reasons of scored and of excluded rows.

    Counted for each stop first, then summed, so that no group holds more than the decisions of one stop."""
    keys = keys or []
    c = F.col
    outcome, reason, label = S.normalize_label(c("outcome")), F.coalesce(S.normalize_label(c("exclusionReason")), F.lit("")), S.normalize_label(c("suggestionLabel"))
    hit, far = c("matchedPitLap").isNotNull(), c("matchedPitLap") - c("lapNumber")
    allowed = reason.isin(*REASONS)
    for start in REASON_STARTS:
        allowed = allowed | F.startswith(reason, F.lit(start))
    facts = {
        "rows": F.lit(True), "hits": hit, "scored": outcome.isin("0", "1"), "excluded": outcome == "EXCLUDED",
        "label": ~F.coalesce(label.isin(*ACTIONABLE), F.lit(False)), "outcome": ~F.coalesce(outcome.isin(*OUTCOMES), F.lit(False)), "far": hit & ~far.between(0, horizon),
        "window": hit & ~F.coalesce("pitInWindow", F.lit(False)), "reason": outcome.isin("0", "1") & (reason != ""), "unknown": (outcome == "EXCLUDED") & ~allowed,
    }
    stops = matched.groupBy(*keys, "race", "driver", "matchedPitLap").agg(*(count_if(v).alias(k) for k, v in facts.items()))
    g = stops.groupBy(*keys).agg(*(F.sum(k).alias(k) for k in facts), count_if(c("matchedPitLap").isNotNull() & (c("rows") > 1)).alias("twice"))
    rules = {
        "actionable_label_contract": ("label", "rows"), "outcome_domain": ("outcome", "rows"), "match_distance_within_horizon": ("far", "hits"), "one_to_one_target_consumption": ("twice", "hits"),
        "matched_rows_window_flag": ("window", "hits"), "scored_rows_have_empty_exclusion_reason": ("reason", "scored"), "exclusion_reason_domain": ("unknown", "excluded"),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(bad, F.lit(0)).alias("invalid"), _share_left(c(bad), c(of)).alias("value")) for k, (bad, of) in rules.items())))
    return g.select(*keys, rows.alias("r")).select(*keys, "r.*").withColumn("status", F.when(c("invalid") == 0, "PASS").otherwise("FAIL"))


def comparator_invariance(sets: dict[str, DataFrame], horizon: int = 2, expected: int = 2) -> DataFrame:
    """(check, value, status) over sets of matched decisions that are to be compared: whether all have the same columns in
    the same order, whether the horizon is the expected one, the seven rules of ``decision_contract`` for each set, and all
    of them together. A set without rows has no rules, so that the whole fails."""
    shapes = [[(x.name, x.dataType) for x in df.schema] for df in sets.values()]
    rules = decision_contract(_sources(sets), horizon, ["source"]).select(F.concat_ws("_", "source", "check").alias("check"), "value", "status")
    fixed = {"comparator_schema_exact_match": all(s == shapes[0] for s in shapes), "fixed_horizon_contract_constant": horizon == expected}
    one = rules.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.lit(float(ok)).alias("value"), F.lit("PASS" if ok else "FAIL").alias("status")) for k, ok in fixed.items()))).alias("r")).select("r.*")
    checks = rules.unionByName(one)
    whole = (F.count("*") == len(fixed) + 7 * len(sets)) & (count_if(F.col("status") == "FAIL") == 0)
    overall = checks.agg(F.when(whole, 1.0).otherwise(0.0).alias("value")).select(F.lit("comparator_invariance_overall").alias("check"), "value", F.when(F.col("value") == 1, "PASS").otherwise("FAIL").alias("status"))
    return checks.unionByName(overall)


def _sources(sets: dict[str, DataFrame]) -> DataFrame:
    columns = ["race", "driver", "lapNumber", "suggestionLabel", "matchedPitLap", "pitInWindow", "outcome", "exclusionReason"]
    return _stack([df.select(F.lit(name).alias("source"), *columns) for name, df in sets.items()])


def comparator_details(sets: dict[str, DataFrame]) -> DataFrame:
    """(section, name, value): rows of each set, scored, excluded and matched ones, and the largest and smallest distance of a
    match (null without matches). A set without rows is not listed."""
    c = F.col
    outcome, far = S.normalize_label(c("outcome")), c("matchedPitLap") - c("lapNumber")
    facts = {"rows_total": F.count("*"), "rows_scored": count_if(outcome.isin("0", "1")), "rows_excluded": count_if(outcome == "EXCLUDED"), "rows_matched": F.count("matchedPitLap"), "max_match_distance": F.max(far), "min_match_distance": F.min(far)}
    g = _sources(sets).groupBy(c("source").alias("section")).agg(*(v.cast("double").alias(k) for k, v in facts.items()))
    return g.select("section", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), c(k).alias("value")) for k in facts))).alias("r")).select("section", "r.*")


def judged(checks: DataFrame) -> DataFrame:
    """``checks`` (layer, check, value, threshold, direction gte or lte, strict, hold) with margin and status: PASS within
    the threshold (not at it, if strict), HOLD within ``hold`` (null: no such band), else FAIL, also without a value."""
    c = F.col
    sign = F.when(c("direction") == "gte", 1.0).otherwise(-1.0)
    margin, spare = sign * (c("value") - c("threshold")), sign * (c("value") - c("hold"))
    inside = lambda m: F.when(c("strict"), m > 0).otherwise(m >= 0)
    return checks.withColumn("margin", F.round(margin, 6)).withColumn("status", F.when(inside(margin), "PASS").when(inside(spare), "HOLD").otherwise("FAIL"))


def layer_status(checks: DataFrame) -> DataFrame:
    """For each layer its counts and its worst status: FAIL before HOLD before PASS."""
    n = {s: count_if(F.col("status") == s) for s in ("PASS", "HOLD", "FAIL")}
    g = checks.groupBy("layer").agg(F.count("*").alias("checks_total"), n["PASS"].alias("checks_passed"), n["HOLD"].alias("checks_hold"), n["FAIL"].alias("checks_failed"))
    return g.withColumn("status", F.when(F.col("checks_failed") > 0, "FAIL").when(F.col("checks_hold") > 0, "HOLD").otherwise("PASS"))


def integrated_gate(checks: DataFrame, operational: str) -> DataFrame:
    """One row: NO_GO if any layer but the operational one fails; else, with all of those passing, GO or
    GO_WITH_CONDITIONS as the operational one passes or holds; else HOLD. Confidence goes with the decision."""
    core, status = F.col("layer") != operational, F.col("status")
    one = layer_status(checks).agg(
        count_if(core & (status == "FAIL")).alias("failed"), count_if(core & (status != "PASS")).alias("open"), F.max(F.when(~core, status)).alias("ops"),
        *(F.sum(k).alias(k) for k in ("checks_total", "checks_passed", "checks_hold", "checks_failed")), F.concat_ws("/", F.array_sort(F.collect_list(F.when(core & (status == "FAIL"), F.col("layer"))))).alias("failed_layers"),
    )
    settled = F.col("open") == 0
    decision = F.when(F.col("failed") > 0, "NO_GO").when(settled & (F.col("ops") == "PASS"), "GO").when(settled & (F.col("ops") == "HOLD"), "GO_WITH_CONDITIONS").otherwise("HOLD")
    confidence = F.when(decision == "NO_GO", "LOW").when(decision == "GO", "HIGH").otherwise("MEDIUM")
    return one.select(decision.alias("decision"), confidence.alias("confidence"), "checks_total", "checks_passed", "checks_hold", "checks_failed", "failed_layers")


def frontier_matches(scores: DataFrame, evals: DataFrame, thresholds: list[float], horizon: int = 2) -> DataFrame:
    """Matched decisions at every threshold; the threshold is one more key of the matching."""
    d = scores.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))).where("totalScore >= threshold").select("threshold", *KEY)
    return match_decisions(d, evals, horizon, by=["threshold"])


def frontier_measures(matches: DataFrame, thresholds: list[float], floor: float, baseline_scored: int) -> DataFrame:
    """The 21 measures beside each threshold, with a row of zeros where nothing is decided. ``baseline_scored`` is the
    number of scored decisions that the rule under comparison has."""
    c = F.col
    scored, none = c("outcome") != "EXCLUDED", c("exclusionReason") == "NO_MATCH_WITHIN_HORIZON"
    ahead = c("nextPitLap") - c("lapNumber")
    g = matches.groupBy("threshold").agg(
        F.count("*").alias("actionable"), count_if(scored).alias("scored"), count_if(~scored).alias("excluded"), count_if(c("outcome") == "1").alias("tp"), count_if(c("outcome") == "0").alias("fp"),
        count_if(none).alias("no_match_count"), count_if(none & (ahead == 3)).alias("no_match_one_lap_beyond"), count_if(none & ahead.between(4, 5)).alias("no_match_two_to_three_laps_beyond"), count_if(none & (ahead >= 6)).alias("no_match_four_plus_laps_beyond"),
        count_if(none & c("pitInWindow")).alias("no_match_pit_in_window_but_consumed"), count_if(c("exclusionReason") == "UNRESOLVED_INCIDENT_FILTER").alias("excluded_incident"),
        count_if(c("exclusionReason") == "UNRESOLVED_MISSING_POST_GAP").alias("excluded_missing_post_gap"), count_if(c("exclusionReason") == "WEATHER_SURVIVAL_STOP").alias("excluded_weather"),
    )
    counts = [x for x in g.columns if x != "threshold"]
    spine = matches.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    x = spine.join(g, "threshold", "left").na.fill(0, counts)
    rate = lambda a, b: F.coalesce(ratio(c(a), c(b)), F.lit(0.0))
    precision = ratio(c("tp"), c("scored"))
    return x.select("threshold", *counts, precision.alias("precision"), rate("scored", "actionable").alias("scored_rate"), rate("tp", "actionable").alias("tp_per_actionable"), ((c("scored") > 0) & (c("tp") / F.greatest(c("scored"), F.lit(1)) >= floor)).cast("int").alias("meets_precision_floor"), F.round(precision - floor, 6).alias("precision_delta_vs_floor"), ratio(c("scored"), F.lit(baseline_scored)).alias("scored_vs_baseline_ratio"), rate("no_match_count", "excluded").alias("no_match_rate"))


def frontier_by_year(matches: DataFrame) -> DataFrame:
    c = F.col
    g = matches.groupBy("threshold", S.year_of_race(c("race")).alias("year")).agg(F.count("*").alias("actionable"), count_if(c("outcome") != "EXCLUDED").alias("scored"), count_if(c("outcome") == "1").alias("tp"), count_if(c("outcome") == "0").alias("fp"))
    return g.select("*", ratio(c("tp"), c("scored")).alias("precision"), ratio(c("scored"), c("actionable")).alias("scored_rate"), ratio(c("tp"), c("actionable")).alias("tp_per_actionable"))


def frontier_choice(measures: DataFrame) -> DataFrame:
    """The threshold to use: of those that reach the floor the one that scores most, then most hits, precision, lowest
    threshold; if none does, the most precise one that scores at all; if none scores, the lowest."""
    c = F.col
    order = F.when(c("meets_precision_floor") == 1, F.struct(F.lit(2).alias("k"), c("scored").cast("double").alias("a"), c("tp").cast("double").alias("b"), c("precision").alias("c"), -c("threshold")))
    order = order.when(c("scored") > 0, F.struct(F.lit(1).alias("k"), c("precision").alias("a"), c("scored").cast("double").alias("b"), c("tp").cast("double").alias("c"), -c("threshold")))
    order = order.otherwise(F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), -c("threshold")))
    return measures.agg(F.max_by(F.struct(*measures.columns), order).alias("best")).select("best.*")


def stream_profile(df: DataFrame, kind: str, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """(stream, measure, value) of one stream: rows, repeated keys and their rows beyond the first, and for each check the
    rows that it counts and their per cent. Counted by key first, so one shuffle of counts."""
    c = F.col
    g = df.groupBy(*key).agg(F.count("*").alias("__n"), *(count_if(v).alias(k) for k, v in checks.items()))
    one = g.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(count_if(c("__n") > 1), F.lit(0)).alias("duplicate_keys"), F.coalesce(F.sum(c("__n") - 1), F.lit(0)).alias("duplicate_rows"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in checks))
    pairs = [F.struct(F.lit(k).alias("measure"), c(k).cast("double").alias("value")) for k in ("rows", "duplicate_keys", "duplicate_rows", *checks)]
    pairs += [F.struct(F.lit(f"{k}_pct").alias("measure"), F.coalesce(F.round(F.try_divide(c(k) * F.lit(100.0), c("rows").cast("double")), 2), F.lit(0.0)).alias("value")) for k in checks]
    return one.select(F.lit(kind).alias("stream"), F.explode(F.array(*pairs)).alias("m")).select("stream", "m.*")


def stream_checks() -> dict[str, tuple[list[str], dict[str, Column]]]:
    """For each stream its key and the condition of each measure."""
    c = F.col
    off = c("trackStatus").isNull() | (c("trackStatus") != "1")
    return {
        "ml_features": (KEY, {"negative_gap": c("gapToCarAhead") < 0, "null_gap": c("gapToCarAhead").isNull()}),
        "pit_evals": (["race", "driver", "pitLapNumber"], {"unresolved": F.startswith(c("result"), F.lit("UNRESOLVED_")), "null_result": c("result").isNull()}),
        "pit_suggestions": (KEY, {"unlabelled": c("suggestionLabel").isNull(), "actionable": c("suggestionLabel").isin(*ACTIONABLE)}),
        "drop_zones": ([*KEY], {"negative_positions_lost": c("positionsLost") < 0, "negative_gap_to_car": c("gapToCar") < 0, "positions_lost_mismatch": c("emergencePosition") - c("position") != c("positionsLost"), "non_green": c("status").isNull() | (c("status") != "1")}),
        "lift_coast": (["race", "driver", "brakeMillis"], {"bad_time_order": ~((c("startMillis") < c("liftMillis")) & (c("liftMillis") < c("brakeMillis"))), "missing_time": c("startMillis").isNull() | c("liftMillis").isNull() | c("brakeMillis").isNull()}),
        "tire_drops": (KEY, {"negative_delta": c("delta") < 0, "very_early": F.coalesce("tyreLife", F.lit(0)) <= 3, "non_green": off}),
    }


def stream_audits(streams: dict[str, DataFrame]) -> DataFrame:
    """The profiles of the streams given by name, as one table."""
    known = stream_checks()
    return _stack([stream_profile(df, name, *known[name]) for name, df in streams.items()])

