"""Registered queries of stream reports, forensics, curves by group and feature profiles, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import curves as U
from ..operators import features as X
from ..operators import laps as L
from ..operators import pace as W
from ..operators import quality as R
from .audits import ORACLES, QUERIES, profile_sql
from .queries import CLEANQ, KEY, C, q

__all__ = ["ORACLES", "QUERIES"]

QUANTILE = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def spread_sql(measure: str, table: str, of: str, top: int | None = None) -> str:
    counts = f"SELECT CAST({of} AS VARCHAR) AS item, COUNT(*) AS n FROM {table} GROUP BY 1"
    if top is None:
        return f"SELECT '{measure}' AS measure, item, 'count' AS statistic, n::DOUBLE AS value FROM ({counts}) x"
    best = f"SELECT '{measure}' AS measure, item, 'count' AS statistic, n::DOUBLE AS value FROM ({counts} ORDER BY n DESC, item NULLS LAST LIMIT {top}) x"
    return f"{best} UNION ALL SELECT '{measure}', NULL, 'unique', COUNT(*)::DOUBLE FROM ({counts}) x HAVING COUNT(*) > 0"


def numbers_sql(measure: str, table: str, of: str, which: tuple[str, ...], by: str | None = None) -> str:
    names = {"count": "COUNT(x)::DOUBLE", "mean": "ROUND(AVG(x), 3)", "min": "MIN(x)", "max": "MAX(x)"} | {k: f"quantile_cont(x, {p})" for k, p in QUANTILE.items()}
    values = ", ".join(f"ROUND({names[w]}, 3)" for w in which)
    return f"SELECT '{measure}' AS measure, item, unnest({list(which)}) AS statistic, unnest([{values}]::DOUBLE[]) AS value FROM (SELECT CAST({by or 'NULL'} AS VARCHAR) AS item, CAST({of} AS DOUBLE) AS x FROM {table}) y WHERE x IS NOT NULL GROUP BY item"


def details_sql(stream: str, parts: list[str]) -> str:
    return f"SELECT '{stream}' AS stream, * FROM ({' UNION ALL '.join(parts)}) z"


def generic_sql(stream: str, table: str, columns: list[str]) -> str:
    nulls = ", ".join(f"ROUND(ROUND(100.0::DOUBLE * AVG(CAST({c} IS NULL AS INT)), 3), 2)" for c in columns)
    return f"""SELECT '{stream}' AS stream, 'exact_duplicate_rows' AS measure, NULL AS item, 'count' AS statistic, COALESCE(SUM(k - 1), 0)::DOUBLE AS value FROM (SELECT COUNT(*) AS k FROM {table} GROUP BY ALL, {", ".join(columns)}) x
 UNION ALL SELECT '{stream}', 'columns', NULL, 'count', {len(columns)}
 UNION ALL SELECT * FROM (SELECT '{stream}', 'nulls', * FROM (SELECT unnest({columns}) AS item, 'pct', unnest([{nulls}]::DOUBLE[]) AS v FROM {table}) x WHERE v > 0 ORDER BY v DESC, item LIMIT 8) y""".replace("GROUP BY ALL, ", "GROUP BY ")


streams = lambda f: {"ml_features": f("laps"), "pit_evals": f("evaluated"), "pit_suggestions": f("suggestions"), "drop_zones": L.drop_zones(f("laps")), "lift_coast": L.lift_coast(f("telemetry")), "tire_drops": L.tire_drops(f("laps"))}
LONG, SHORT = ("min", "mean", "p95", "max"), ("mean", "median", "min", "max")
q("v12_stream_details", "laps telemetry pit_evals suggestions evaluated", lambda f: R.details(streams(f)),
  f", dz AS ({ORACLES['w13_drop_zones']}), lc AS ({ORACLES['k1_lift_coast']}), td AS ({ORACLES['w11_tire_drops']}) " + " UNION ALL ".join([
      details_sql("ml_features", [spread_sql("track_status_distribution", "laps", "trackStatus"), spread_sql("top_races_by_rows", "laps", "race", 10)]),
      details_sql("pit_evals", [spread_sql("result_distribution", "evaluated", "result"), spread_sql("resolved_via_distribution", "evaluated", "resolvedVia"), spread_sql("races", "evaluated", "race", 0)]),
      details_sql("pit_suggestions", [spread_sql("suggestion_label_distribution", "suggestions", "suggestionLabel"), numbers_sql("total_score", "suggestions", "totalScore", ("mean", "median", "p90", "p99", "min", "max"))]),
      details_sql("drop_zones", [spread_sql("track_status_distribution", "dz", "status"), numbers_sql("gap_to_physical_car", "dz", "gapToCar", LONG), numbers_sql("current_position", "dz", "position", SHORT), numbers_sql("emergence_position", "dz", "emergencePosition", SHORT), numbers_sql("positions_lost", "dz", "positionsLost", SHORT)]),
      details_sql("lift_coast", [spread_sql("top_drivers", "lc", "driver", 10), numbers_sql("full_to_lift_seconds", "lc", "(liftMillis - startMillis) / 1000", LONG), numbers_sql("lift_to_brake_seconds", "lc", "(brakeMillis - liftMillis) / 1000", LONG)]),
      details_sql("tire_drops", [spread_sql("alerts_by_compound", "td", "compound"), numbers_sql("delta_seconds", "td", "delta", LONG), numbers_sql("tyre_life_by_compound", "td", "tyreLife", ("count", "mean", "median", "min", "max"), "compound")]),
  ]))

EVALUATED = ["race", "driver", "pitLapNumber", "result", "compound", "trackStatusAtPit", "prePitGapAhead", "postPitGapToRival", "baselineLapTime", "gapDeltaPct", "rivalAhead", "offsetStrategy", "resolvedVia"]
q("v12_stream_report", "laps pit_evals evaluated suggestions", lambda f: R.stream_report({"pit_evals": f("evaluated"), "pit_suggestions": f("suggestions")}),
  ", r AS (" + profile_sql("pit_evals", "evaluated", "race, driver, pitLapNumber", {"unresolved": "starts_with(result, 'UNRESOLVED_')", "null_result": "result IS NULL"}) + " UNION ALL "
  + profile_sql("pit_suggestions", "suggestions", KEY, {"unlabelled": "suggestionLabel IS NULL", "actionable": "suggestionLabel IN ('PIT_NOW', 'GOOD_PIT')"}) + ") SELECT stream, measure, NULL AS item, 'total' AS statistic, value FROM r UNION ALL "
  + generic_sql("pit_evals", "evaluated", EVALUATED) + " UNION ALL " + generic_sql("pit_suggestions", "suggestions", ["race", "driver", "lapNumber", "suggestionLabel", "totalScore", "eventTimeMillis"]) + " UNION ALL "
  + details_sql("pit_evals", [spread_sql("result_distribution", "evaluated", "result"), spread_sql("resolved_via_distribution", "evaluated", "resolvedVia"), spread_sql("races", "evaluated", "race", 0)]) + " UNION ALL "
  + details_sql("pit_suggestions", [spread_sql("suggestion_label_distribution", "suggestions", "suggestionLabel"), numbers_sql("total_score", "suggestions", "totalScore", ("mean", "median", "p90", "p99", "min", "max"))]))

DEF = "result = 'SUCCESS_DEFEND'"
FACTS = {
    ("success_defend", None): DEF, ("nulls_in_success_defend", "prePitGapAhead"): f"{DEF} AND prePitGapAhead IS NULL", ("nulls_in_success_defend", "postPitGapToRival"): f"{DEF} AND postPitGapToRival IS NULL",
    ("nulls_in_success_defend", "baselineLapTime"): f"{DEF} AND baselineLapTime IS NULL", ("extreme_gap", None): "abs(gapDeltaPct) > 20", ("stops", "wet"): "compound IN ('INTERMEDIATE', 'WET')", ("stops", "dry"): "compound NOT IN ('INTERMEDIATE', 'WET')",
    ("pit_status_null", None): "trackStatusAtPit IS NULL", ("rival_ahead_null", None): "rivalAhead IS NULL", ("post_gap_null", None): "postPitGapToRival IS NULL", ("baseline_le_zero_or_null", None): "COALESCE(baselineLapTime, 0) <= 0", ("offset_strategy", None): "offsetStrategy",
}
_counts = [f"SELECT '{m}' AS measure, {repr(i) if i else 'NULL'} AS item, 'count' AS statistic, (COUNT(*) FILTER ({v}))::DOUBLE AS value FROM evaluated" for (m, i), v in FACTS.items()]
_shares = [f"SELECT '{m}', NULL, 'pct', ROUND(100.0::DOUBLE * COUNT(*) FILTER ({v}) / COUNT(*), 2) FROM evaluated" for (m, i), v in FACTS.items() if m in ("success_defend", "rival_ahead_null", "post_gap_null", "offset_strategy")]
q("v13_forensics", "laps pit_evals evaluated", lambda f: R.forensics(f("evaluated"), f("laps")), " " + " UNION ALL ".join([
    *_counts, *_shares, "SELECT 'ml_status_null', NULL, 'count', (COUNT(*) FILTER (trackStatus IS NULL))::DOUBLE FROM laps", spread_sql("resolved_via_all", "evaluated", "resolvedVia"), spread_sql("resolved_via_success_defend", f"(SELECT * FROM evaluated WHERE {DEF}) d", "resolvedVia"),
    spread_sql("pit_status", "(SELECT * FROM evaluated WHERE trackStatusAtPit IS NOT NULL) s", "trackStatusAtPit"), spread_sql("ml_status", "laps", "trackStatus"), numbers_sql("gap_delta_pct", "evaluated", "gapDeltaPct", ("mean", "median"), "CASE WHEN compound IN ('INTERMEDIATE', 'WET') THEN 'wet' ELSE 'dry' END"),
]))
q("v13_extreme_stops", "laps pit_evals evaluated", lambda f: R.extreme_gaps(f("evaluated")),
  "SELECT race, driver, pitLapNumber, rivalAhead, ROUND(prePitGapAhead, 3) AS prePitGapAhead, ROUND(postPitGapToRival, 3) AS postPitGapToRival, ROUND(gapDeltaPct, 3) AS gapDeltaPct, result, resolvedVia FROM evaluated WHERE abs(gapDeltaPct) > 20 ORDER BY abs(gapDeltaPct) DESC, race, driver, pitLapNumber LIMIT 5")


# Curves by year and for all rows, of two scores
curves = lambda f: U.curves(f("oof").withColumn("calibrated_proba", F.floor(C("raw_proba") * 50) / 50), ["raw_proba", "calibrated_proba"], S.year_of_race(C("race")))
CURVES = """, lg AS (SELECT substr(race, 1, 4) AS y, 'raw_proba' AS score_type, raw_proba AS s, target_y FROM oof UNION ALL SELECT substr(race, 1, 4), 'calibrated_proba', FLOOR(raw_proba * 50) / 50, target_y FROM oof),
bg AS (SELECT y AS "group", score_type, s, COUNT(*) AS n, SUM(target_y) AS pos FROM lg GROUP BY ALL UNION ALL SELECT 'overall', score_type, s, COUNT(*), SUM(target_y) FROM lg GROUP BY ALL),
cp AS (SELECT *, SUM(pos) OVER w AS tp, SUM(n) OVER w AS seen, SUM(pos) OVER (PARTITION BY "group", score_type) AS ap, SUM(n) OVER (PARTITION BY "group", score_type) AS an FROM bg WINDOW w AS (PARTITION BY "group", score_type ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
cv AS (SELECT *, tp / seen AS precision, tp / ap AS recall, LAG(tp / seen, 1, 1.0::DOUBLE) OVER w AS p0, LAG(tp / ap, 1, 0.0::DOUBLE) OVER w AS r0 FROM cp WINDOW w AS (PARTITION BY "group", score_type ORDER BY s DESC))"""
q("w25_discrimination", "oof", lambda f: U.discrimination(curves(f)), CURVES + """ SELECT "group", score_type, ROUND(SUM(pos / ap * precision), 6) AS pr_auc_ap, ROUND(SUM((recall - r0) * (precision + p0) / 2), 6) AS pr_auc_trapz, CAST(MAX(ap) AS BIGINT) AS n_positive, CAST(MAX(an) AS BIGINT) AS n_rows, ROUND(MAX(ap) / MAX(an), 6) AS prevalence FROM cv GROUP BY 1, 2""")
q("w25_operating_points", "oof", lambda f: U.operating_points(curves(f), {**U.MARKS, "between": 0.3337, "again": 0.1}),
  CURVES + """ SELECT "group", score_type, point_label, requested_threshold, s AS effective_threshold, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall FROM cv, (SELECT unnest(['threshold_0.50', 'threshold_0.10', 'threshold_0.05', 'between']) AS point_label, unnest([0.5, 0.1, 0.05, 0.3337]::DOUBLE[]) AS requested_threshold) m
  QUALIFY ROW_NUMBER() OVER (PARTITION BY "group", score_type, point_label ORDER BY abs(s - requested_threshold), s) = 1""")
q("w25_best_points", "oof", lambda f: U.best_points(curves(f)), CURVES + """ SELECT "group", score_type, s AS threshold, ROUND(2 * tp / (seen + ap), 6) AS f1, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall FROM cv QUALIFY ROW_NUMBER() OVER (PARTITION BY "group", score_type ORDER BY 2 * tp / (seen + ap) DESC, s) = 1""")


# Features of a profile
def profiled(f):
    plan = X.profile_plan("percent_race_team_v1_strict", ["pitLoss, vscPitLoss", "scPitLoss"])
    rows = X.planned(X.with_mode(f("laps"), plan.mode), plan, [*KEY.split(", "), "tyreLife"], ["pitInTime", "pitOutTime", "eventTimeMillis", "trackTemp", "totalLaps", "gapToCarAhead"])
    return rows.withColumns({c: F.round(c, 6) for c in X.MODES[plan.mode]})


PAST = "AVG(m) OVER (PARTITION BY {} ORDER BY lapNumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM (SELECT {}, lapNumber, AVG(lapTime) AS m FROM laps GROUP BY ALL) z"
CLIP = "ROUND(GREATEST(0.5::DOUBLE, LEAST(2.0::DOUBLE, COALESCE(lapTime / {}, 1.0::DOUBLE))), 6)"
q("f18_profile_matrix", "laps", profiled,
  f""", t AS (SELECT race, team, lapNumber, {PAST.format('race, team', 'race, team')}), r AS (SELECT race, lapNumber, {PAST.format('race', 'race')})
  SELECT {KEY}, position, stint, tyreLife, compound, trackStatus, ROUND(LEAST(1.5::DOUBLE, lapNumber / totalLaps), 6) AS race_progress_pct,
    {CLIP.format('AVG(lapTime) OVER (PARTITION BY race, driver ORDER BY lapNumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')} AS lapTime_vs_driver_prev_mean_pct,
    {CLIP.format('t.past')} AS lapTime_vs_team_prev_lapbucket_mean_pct, {CLIP.format('r.past')} AS lapTime_vs_race_prev_lapbucket_mean_pct
  FROM laps JOIN t USING (race, team, lapNumber) JOIN r USING (race, lapNumber)""")


# Pace against the car ahead, and against the leader
ahead = lambda f: f("laps").alias("a").join(f("laps").alias("b"), (C("a.race") == C("b.race")) & (C("a.lapNumber") == C("b.lapNumber")) & (C("a.position") == C("b.position") + 1)).select("a.race", "a.driver", C("b.driver").alias("rival"), "a.lapNumber")
q("w20_relative_pace", "laps", lambda f: W.relative_pace_gap(f("laps"), ahead(f)).withColumn("paceGap", F.round("paceGap", 6)),
  f""", lp AS (SELECT race, driver, lapNumber + o AS a, AVG(lapTime) AS pace FROM laps, (SELECT unnest([0, 1, 2, 3]) AS o) s WHERE {CLEANQ} GROUP BY ALL HAVING COUNT(*) >= 2),
  pr AS (SELECT a.race, a.driver, b.driver AS rival, a.lapNumber FROM laps a JOIN laps b ON a.race = b.race AND a.lapNumber = b.lapNumber AND a.position = b.position + 1),
  tr AS (SELECT pr.*, r, CAST(pr.lapNumber + d AS INT) AS anchor FROM pr, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS r, unnest([0, -1, 1, -2, 2, -3, 3]) AS d) s),
  fd AS (SELECT tr.*, x.pace - y.pace AS g FROM tr JOIN lp x ON x.race = tr.race AND x.driver = tr.driver AND x.a = tr.anchor JOIN lp y ON y.race = tr.race AND y.driver = tr.rival AND y.a = tr.anchor WHERE anchor > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY tr.race, tr.driver, tr.rival, tr.lapNumber ORDER BY r) = 1)
  SELECT pr.race, pr.driver, pr.rival, pr.lapNumber, fd.anchor, ROUND(fd.g, 6) AS paceGap FROM pr LEFT JOIN fd USING (race, driver, rival, lapNumber)""")
q("w20_leader_pace", "laps", lambda f: W.leader_pace_gap(f("laps")).select(*KEY.split(", "), *(F.round(c, 6).alias(c) for c in ("pace", "reference", "paceGap"))),
  f""", cl AS (SELECT race, driver, lapNumber, position, lapTime, AVG(lapTime) OVER (PARTITION BY race, driver ORDER BY lapNumber ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM laps WHERE {CLEANQ}),
  pc AS (SELECT {KEY}, (SELECT arg_max(m, cl.lapNumber) FROM cl WHERE cl.race = l.race AND cl.driver = l.driver AND cl.lapNumber <= l.lapNumber) AS pace, (SELECT arg_max(m, cl.lapNumber) FROM cl WHERE cl.race = l.race AND cl.driver = l.driver AND cl.lapNumber < l.lapNumber) AS before,
    (SELECT arg_max(lapTime, cl.lapNumber) FROM cl WHERE cl.race = l.race AND cl.position = 1 AND cl.lapNumber BETWEEN l.lapNumber - 2 AND l.lapNumber) AS led FROM laps l)
  SELECT {KEY}, ROUND(pace, 6) AS pace, ROUND(COALESCE(led, before), 6) AS reference, ROUND(pace - COALESCE(led, before), 6) AS paceGap FROM pc""")
