"""Registered queries: each operator over the derived tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.register import register_sql
from ..operators import decisions as D
from ..operators import evaluation as E
from ..operators import features as X
from ..operators import laps as L
from ..operators import ml as M
from ..operators.pit_cycles import pit_cycles
from ..sources import io as IO
from .fixtures import fixture, with_clause

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
C = F.col


def q(name: str, names: str, build: Callable, sql: str | None = None, once: str | None = None) -> None:
    """names: the fixtures read; sql may begin with a comma to add to the WITH list; once: a fixture of which the query has
    many readers: it is derived once and kept on disk for them."""

    def run(spark, sf_dir):
        given = {once: fixture(spark, sf_dir, once)} if once else {}
        out = build(lambda n: fixture(spark, sf_dir, n, given))
        for df in given.values():  # not before: fixtures read it as a temporary view, and Spark forgets rows kept for a dropped one
            df.persist(StorageLevel.DISK_ONLY)
        return out

    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_clause(*names.split()) + "\n" + sql


GREENQ = "COALESCE(NULLIF(trim(trackStatus), ''), '1') = '1'"
CLEANQ = f"(lapTime > 0 AND pitInTime IS NULL AND pitOutTime IS NULL AND {GREENQ})"
POS = "'SUCCESS_UNDERCUT', 'SUCCESS_OVERCUT', 'SUCCESS_DEFEND', 'SUCCESS_FREE_STOP', 'OFFSET_ADVANTAGE'"
NEG = "'FAILURE_PACE_DEFICIT', 'FAILURE_TRAFFIC', 'OFFSET_DISADVANTAGE'"
KEY = "race, driver, lapNumber"
MAXSTINT = "CASE upper(compound) WHEN 'SOFT' THEN 18.0 WHEN 'MEDIUM' THEN 30.0 WHEN 'HARD' THEN 40.0 WHEN 'WET' THEN 25.0 WHEN 'INTERMEDIATE' THEN 25.0 ELSE 30.0 END::DOUBLE"

# Scalar functions
q("f1_canonical_status", "laps", lambda f: f("laps").select("race", "driver", "lapNumber", S.canonical_status(F.concat("trackStatus", F.lit("2"))).alias("code")),
  f"SELECT {KEY}, CASE WHEN s LIKE '%5%' THEN '5' WHEN s LIKE '%4%' THEN '4' WHEN s LIKE '%7%' THEN '7' WHEN s LIKE '%6%' THEN '6' WHEN s LIKE '%2%' THEN '2' ELSE '1' END AS code FROM (SELECT *, trackStatus || '2' AS s FROM laps) x")
q("f2_status_predicates", "laps", lambda f: f("laps").groupBy("race").agg(D.count_if(S.is_green(C("trackStatus"))).alias("green"), D.count_if(S.is_caution(C("trackStatus"))).alias("caution")),
  "SELECT race, COUNT(*) FILTER (trackStatus = '1') AS green, COUNT(*) FILTER (trackStatus IN ('4','6','7')) AS caution FROM laps GROUP BY race")
q("f3_parse_event_time", "laps", lambda f: f("laps").select("race", "driver", "lapNumber", S.parse_event_time(F.date_format(F.timestamp_millis("eventTimeMillis"), "yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("ms")),
  f"SELECT {KEY}, eventTimeMillis AS ms FROM laps")
q("f4_parse_mixed_ts", "laps", lambda f: f("laps").select("race", "driver", "lapNumber", S.parse_mixed_ts(F.concat(F.date_format(F.timestamp_millis("eventTimeMillis"), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("+0000"))).alias("ms")),
  f"SELECT {KEY}, eventTimeMillis AS ms FROM laps")
q("f5_normalize_label", "pit_evals", lambda f: f("pit_evals").select(S.normalize_label(F.concat(F.lit(" "), F.lower(F.replace(C("result"), F.lit("_"), F.lit(" "))))).alias("label"), "pitLapNumber"),
  "SELECT result AS label, pitLapNumber FROM pit_evals")
q("f6_race_names", "laps", lambda f: f("laps").select("race").distinct().select("race", S.year_of_race(C("race")).alias("year"), S.strip_year_prefix(C("race")).alias("name"), S.with_year_prefix(S.year_of_race(C("race")), S.strip_year_prefix(C("race"))).alias("again")),
  "SELECT DISTINCT race, CAST(substr(race, 1, 4) AS INT) AS year, substr(race, 9) AS name, race AS again FROM laps")
q("f7_accurate_laps", "laps", lambda f: f("laps").where(S.accurate_or_pit(C("lapTime") < 81, C("pitInTime"), C("pitOutTime"))).select("race", "driver", "lapNumber"),
  f"SELECT {KEY} FROM laps WHERE lapTime < 81 OR pitInTime IS NOT NULL OR pitOutTime IS NOT NULL")
q("f8_clean_laps", "laps", lambda f: f("laps").where(L.clean()).select("race", "driver", "lapNumber", "lapTime"), f"SELECT {KEY}, lapTime FROM laps WHERE {CLEANQ}")
q("f9_from_start_lap", "laps", lambda f: f("laps").where(C("lapNumber").isNull() | (C("lapNumber") >= 40)).select("race", "driver", "lapNumber"), f"SELECT {KEY} FROM laps WHERE lapNumber IS NULL OR lapNumber >= 40")
q("f10_trim_tail", "laps telemetry", lambda f: f("telemetry").join(f("laps").where("lapNumber <= 1").groupBy(F.substring("race", 9, 9).alias("g")).agg(F.max("eventTimeMillis").alias("lastLap")), F.substring("race", 9, 9) == C("g")).where(C("eventTimeMillis") % 86400000 <= C("lastLap") % 86400000 + 50000).select("race", "driver", "eventTimeMillis"),
  "SELECT t.race, t.driver, t.eventTimeMillis FROM telemetry t JOIN (SELECT substr(race, 9, 9) AS g, MAX(eventTimeMillis) AS m FROM laps WHERE lapNumber <= 1 GROUP BY 1) l ON substr(t.race, 9, 9) = l.g WHERE t.eventTimeMillis % 86400000 <= l.m % 86400000 + 50000")
q("f12_select_pit_loss", "laps", lambda f: f("laps").select("race", "driver", "lapNumber", S.select_pit_loss(C("trackStatus"), C("pitLoss"), C("vscPitLoss"), C("scPitLoss")).alias("loss")),
  f"SELECT {KEY}, CASE trackStatus WHEN '4' THEN scPitLoss WHEN '6' THEN vscPitLoss WHEN '7' THEN vscPitLoss WHEN '1' THEN pitLoss END AS loss FROM laps")
q("f13_clip_ratio", "laps", lambda f: f("laps").select("race", "driver", "lapNumber", F.round(S.clip_ratio(C("lapTime") / 81, 1.0, 0.99, 1.01), 6).alias("r")),
  f"SELECT {KEY}, ROUND(GREATEST(0.99::DOUBLE, LEAST(1.01::DOUBLE, COALESCE(lapTime / 81, 1.0::DOUBLE))), 6) AS r FROM laps")
q("f14_compound_maps", "laps", lambda f: f("laps").select("compound").distinct().select("compound", S.choose(F.upper("compound"), S.MAX_STINT, 30.0).alias("stint"), S.choose(F.upper("compound"), S.BASE_THRESHOLD, 0.015).alias("base"), S.choose(F.upper("compound"), S.NEXT_COMPOUND, "MEDIUM").alias("following")),
  f"SELECT DISTINCT compound, {MAXSTINT} AS stint, CASE compound WHEN 'SOFT' THEN 0.012 WHEN 'HARD' THEN 0.02 WHEN 'INTERMEDIATE' THEN 0.025 ELSE 0.015 END::DOUBLE AS base, CASE compound WHEN 'MEDIUM' THEN 'HARD' ELSE 'MEDIUM' END AS following FROM laps")
q("f15_outcomes", "pit_evals", lambda f: f("pit_evals").groupBy(S.outcome_of(C("result")).alias("outcome"), S.exclusion_reason(C("result")).alias("reason")).agg(F.count("*").alias("n")),
  f"SELECT CASE WHEN result IN ({POS}) THEN '1' WHEN result IN ({NEG}) THEN '0' ELSE 'EXCLUDED' END AS outcome, CASE WHEN result IN ({POS}, {NEG}) THEN '' ELSE result END AS reason, COUNT(*) AS n FROM pit_evals GROUP BY 1, 2")
q("f16_gap_fill", "laps", lambda f: f("laps").select("race", "driver", "lapNumber", F.coalesce("gapToCarAhead", F.lit(S.GAP_FILL)).alias("gap"), C("gapToCarAhead").isNotNull().alias("hasGap")),
  f"SELECT {KEY}, COALESCE(gapToCarAhead, 999.0) AS gap, gapToCarAhead IS NOT NULL AS hasGap FROM laps")
q("f17_format_lap_time", "laps", lambda f: f("laps").select("race", "driver", "lapNumber", S.format_lap_time(C("lapTime")).alias("t")),
  f"SELECT {KEY}, CASE WHEN lapTime IS NOT NULL THEN printf('%d:%02d.%03d', CAST(ROUND(lapTime * 1000) AS BIGINT) // 60000, CAST(ROUND(lapTime * 1000) AS BIGINT) // 1000 % 60, CAST(ROUND(lapTime * 1000) AS BIGINT) % 1000) END AS t FROM laps")
q("f19_feature_matrix", "laps", lambda f: f("laps").select("race", "driver", "lapNumber", *(F.coalesce((C("compound") == c), F.lit(False)).cast("int").alias(f"compound_{c}") for c in ("SOFT", "MEDIUM", "HARD", "INTERMEDIATE")), C("compound").isNull().cast("int").alias("compound_null")),
  f"SELECT {KEY}, CAST(compound = 'SOFT' AS INT) AS compound_SOFT, CAST(compound = 'MEDIUM' AS INT) AS compound_MEDIUM, CAST(compound = 'HARD' AS INT) AS compound_HARD, CAST(compound = 'INTERMEDIATE' AS INT) AS compound_INTERMEDIATE, 0 AS compound_null FROM laps")
q("f24_alert_kind", "pit_evals suggestions", lambda f: f("pit_evals").select(F.to_json(F.struct("race", "result")).alias("p")).unionByName(f("suggestions").select(F.to_json(F.struct("race", "suggestionLabel")).alias("p"))).groupBy(S.alert_kind(C("p")).alias("kind")).agg(F.count("*").alias("n")),
  "SELECT 'pit_eval' AS kind, COUNT(*) AS n FROM pit_evals UNION ALL SELECT 'pit_suggestion', COUNT(*) FROM suggestions")
q("f26_error_tags", "laps", lambda f: f("laps").select("race", "driver", "lapNumber", D.suggest_error_tag({"case_origin": F.when(C("position") % 2 == 0, "scored_fp").otherwise("excluded"), "subtype": F.when(C("lapNumber") % 3 == 0, "no_future").otherwise("near_miss_3_5"), "trackStatus": C("trackStatus").cast("int"), "rainfall": F.lit(None).cast("boolean"), "progress": C("lapNumber") / C("totalLaps"), "gapAhead": C("gapToCarAhead"), "gapBehind": F.lit(None).cast("double")}).alias("tag")),
  f"""SELECT {KEY}, CASE WHEN position % 2 = 0 THEN CASE WHEN CAST(trackStatus AS INT) > 1 THEN 'Weather / Safety Car Disruption' WHEN lapNumber / totalLaps >= 0.8 THEN 'End-of-Race Tire Management' WHEN gapToCarAhead <= 1.2 THEN 'Traffic / DRS Train' ELSE 'Strategic Offset / Gamble' END
  WHEN lapNumber % 3 <> 0 THEN 'Near-Miss Strategic Extension' WHEN lapNumber / totalLaps >= 0.65 THEN 'One-Stop Stretch / No Further Stop' ELSE 'No-Future Stop (Unrealized Signal)' END AS tag FROM laps""")
q("f27_status_time", "track_status", lambda f: f("track_status").select("race", F.unix_millis(F.timestamp_millis(F.lit(1704067200000)) + F.make_dt_interval(secs=(C("eventTimeMillis") - 1704067200000) / 1000)).alias("ms"), S.canonical_status(C("status")).alias("code")),
  "SELECT race, eventTimeMillis AS ms, status AS code FROM track_status")

# Joins
q("j1_asof_nearest", "telemetry", lambda f: L.asof_nearest(f("telemetry").withColumn("eventTimeMillis", C("eventTimeMillis") + C("speed") % 7 * 60), f("telemetry"), ["race", "driver"], "eventTimeMillis", "speed", 200, ["race", "driver", "eventTimeMillis"]).distinct().select("race", "driver", "eventTimeMillis", "nearest_speed"),
  """, x AS (SELECT DISTINCT race, driver, eventTimeMillis + speed % 7 * 60 AS eventTimeMillis FROM telemetry)
  SELECT x.race, x.driver, x.eventTimeMillis, arg_min(t.speed, struct_pack(d := abs(t.eventTimeMillis - x.eventTimeMillis), e := t.eventTimeMillis)) AS nearest_speed FROM x LEFT JOIN telemetry t ON t.race = x.race AND t.driver = x.driver AND abs(t.eventTimeMillis - x.eventTimeMillis) <= 200 GROUP BY ALL""")
q("j2_lap_of_sample", "laps telemetry", lambda f: L.asof_backward(f("telemetry").select("driver", "eventTimeMillis", "speed", F.substring("race", 9, 9).alias("gp")), f("laps").select(F.substring("race", 9, 9).alias("gp"), "driver", (C("eventTimeMillis") % 86400000 + 1704067200000).alias("eventTimeMillis"), "lapNumber"), ["gp", "driver"], "eventTimeMillis", ["lapNumber"]),
  ", l AS (SELECT substr(race, 9, 9) AS gp, driver, eventTimeMillis % 86400000 + 1704067200000 AS ms, lapNumber FROM laps) SELECT t.driver, t.eventTimeMillis, t.speed, t.gp, l.lapNumber AS asof_lapNumber FROM (SELECT *, substr(race, 9, 9) AS gp FROM telemetry) t ASOF LEFT JOIN l ON t.gp = l.gp AND t.driver = l.driver AND t.eventTimeMillis >= l.ms")
q("j3_enrich_status", "laps track_status", lambda f: L.asof_backward(f("laps").select("race", "driver", "lapNumber", "eventTimeMillis"), f("track_status"), ["race"], "eventTimeMillis", ["status"]).withColumn("asof_status", F.coalesce("asof_status", F.lit("1"))),
  "SELECT l.race, l.driver, l.lapNumber, l.eventTimeMillis, COALESCE(s.status, '1') AS asof_status FROM laps l ASOF LEFT JOIN track_status s ON l.race = s.race AND l.eventTimeMillis >= s.eventTimeMillis")
q("j4_weather_join", "laps", lambda f: f("laps").select("race", "driver", "lapNumber").join(f("laps").where("position % 3 = 0").select("race", "driver", "lapNumber", "trackTemp"), D.KEY, "left"),
  f"SELECT {KEY}, CASE WHEN position % 3 = 0 THEN trackTemp END AS trackTemp FROM laps")
q("j5_drop_zone_join", "laps", lambda f: D.drop_zone_join(f("laps").select(*D.KEY), f("laps").where("tyreLife >= 8").select(*D.KEY, "position", F.coalesce("gapToCarAhead", F.lit(0.0)).alias("gap"))),
  f"SELECT {KEY}, CASE WHEN tyreLife >= 8 THEN position ELSE 0 END AS dropPosition, CASE WHEN tyreLife >= 8 THEN COALESCE(gapToCarAhead, 0.0) ELSE 999.0 END AS dropGap, tyreLife >= 8 AS hasDropZone FROM laps")
q("j6_future_window_label", "laps pit_evals", lambda f: D.future_window_label(f("laps").select(*D.KEY), f("pit_evals")),
  f""", m AS (SELECT l.race, l.driver, l.lapNumber, MIN(struct_pack(p := e.pitLapNumber, r := e.result)) AS m FROM laps l LEFT JOIN pit_evals e ON l.race = e.race AND l.driver = e.driver AND e.pitLapNumber BETWEEN l.lapNumber + 1 AND l.lapNumber + 2 AND e.pitLapNumber IS NOT NULL GROUP BY ALL)
  SELECT {KEY}, m.p AS matchedPitLap, m.r AS matchedResult, CASE WHEN m.r IN ({POS}) THEN 1 ELSE 0 END AS target_y FROM m""")
MATCH = f""", d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY race, driver ORDER BY lapNumber) AS rn FROM (SELECT DISTINCT {KEY} FROM suggestions WHERE suggestionLabel IN ('PIT_NOW', 'GOOD_PIT')) x),
e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY race, driver ORDER BY pitLapNumber) AS pn FROM pit_evals),
w AS (SELECT race, driver, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS ptr, CAST(NULL AS INT) AS lapNumber, CAST(NULL AS BIGINT) AS hit FROM (SELECT DISTINCT race, driver FROM d) x
 UNION ALL SELECT race, driver, rn, COALESCE(hit, ptr), lapNumber, hit FROM (SELECT d.race, d.driver, d.rn, w.ptr, d.lapNumber,
   (SELECT MIN(pn) FROM e WHERE e.race = d.race AND e.driver = d.driver AND e.pn > w.ptr AND e.pitLapNumber >= d.lapNumber AND e.pitLapNumber <= d.lapNumber + 2) AS hit FROM w JOIN d ON d.race = w.race AND d.driver = w.driver AND d.rn = w.rn + 1) z),
m AS (SELECT w.race, w.driver, w.lapNumber, e.pitLapNumber AS matchedPitLap, e.result AS matchedResult,
  (SELECT MIN(pitLapNumber) FROM e e2 WHERE e2.race = w.race AND e2.driver = w.driver AND e2.pitLapNumber >= w.lapNumber) AS nextPitLap,
  CASE WHEN e.result IS NULL THEN 'EXCLUDED' WHEN e.result IN ({POS}) THEN '1' WHEN e.result IN ({NEG}) THEN '0' ELSE 'EXCLUDED' END AS outcome,
  CASE WHEN e.result IS NULL THEN 'NO_MATCH_WITHIN_HORIZON' WHEN e.result IN ({POS}, {NEG}) THEN '' ELSE e.result END AS exclusionReason
  FROM w LEFT JOIN e ON e.race = w.race AND e.driver = w.driver AND e.pn = w.hit WHERE w.rn > 0)
"""
matched = lambda f: D.match_decisions(f("suggestions").where("suggestionLabel in ('PIT_NOW', 'GOOD_PIT')").select(*D.KEY).distinct(), f("pit_evals"))
RATES = "COUNT(*) AS actionable, COUNT(*) FILTER (outcome <> 'EXCLUDED') AS scored, COUNT(*) FILTER (outcome = 'EXCLUDED') AS excluded, COUNT(*) FILTER (outcome = '1') AS tp, COUNT(*) FILTER (outcome = '0') AS fp, ROUND(COUNT(*) FILTER (outcome = '1') / NULLIF(COUNT(*) FILTER (outcome <> 'EXCLUDED'), 0), 6) AS precision, ROUND(COUNT(*) FILTER (outcome <> 'EXCLUDED') / COUNT(*), 6) AS coverage"
q("j7_match_decisions", "suggestions pit_evals", matched, MATCH + "SELECT *, COALESCE(nextPitLap <= lapNumber + 2, FALSE) AS pitInWindow FROM m")
q("j8_paired_overlap", "suggestions pit_evals", lambda f: D.paired_overlap(matched(f), matched(f).withColumn("outcome", F.when(C("lapNumber") % 5 == 0, F.lit("0")).otherwise(C("outcome")))),
  MATCH + ", p AS (SELECT outcome = '1' AS x, CASE WHEN lapNumber % 5 = 0 THEN FALSE ELSE outcome = '1' END AS y FROM m WHERE outcome <> 'EXCLUDED'), g AS (SELECT COUNT(*) AS overlap, COUNT(*) FILTER (x AND NOT y) AS only_a, COUNT(*) FILTER (NOT x AND y) AS only_b FROM p) SELECT *, ROUND(CASE WHEN only_a + only_b > 0 THEN CAST(GREATEST(0, abs(only_a - only_b) - 1) AS DOUBLE) * GREATEST(0, abs(only_a - only_b) - 1) / (only_a + only_b) END, 6) AS chi_square FROM g")
by_year = lambda m: D.decision_metrics(m.withColumn("year", S.year_of_race(C("race"))), ["year"])
q("j9_by_year_wide", "suggestions pit_evals", lambda f: D.by_year_wide(by_year(matched(f)), by_year(matched(f).where("lapNumber <= 25"))),
  MATCH + f", y AS (SELECT CAST(substr(race, 1, 4) AS INT) AS year, {RATES} FROM m GROUP BY 1), z AS (SELECT CAST(substr(race, 1, 4) AS INT) AS year, {RATES} FROM m WHERE lapNumber <= 25 GROUP BY 1) SELECT COALESCE(y.year, z.year) AS year, y.precision AS precision_a, y.scored AS scored_a, z.precision AS precision_b, z.scored AS scored_b, ROUND(z.precision - y.precision, 6) AS delta, ROUND(z.scored / NULLIF(y.scored, 0), 6) AS scored_ratio FROM y FULL JOIN z ON y.year = z.year")
q("j12_parity_join", "laps", lambda f: f("laps").select(*D.KEY, C("lapTime").alias("lapTime_offline")).join(f("laps").select(*D.KEY, F.round("lapTime", 1).alias("lapTime_serving")), D.KEY).agg(F.count("*").alias("n"), D.count_if(F.abs(C("lapTime_offline") - C("lapTime_serving")) <= 0.02).alias("same")),
  "SELECT COUNT(*) AS n, COUNT(*) FILTER (abs(lapTime - ROUND(lapTime, 1)) <= 0.02) AS same FROM laps")
q("j13_ladder", "laps", lambda f: L.directed_gap(f("laps")),
  f""", x AS (SELECT {KEY}, position, COALESCE(SUM(gapToCarAhead) OVER w, 0) AS s, COUNT(*) FILTER (gapToCarAhead IS NULL) OVER w AS b FROM laps WINDOW w AS (PARTITION BY race, lapNumber ORDER BY position))
  SELECT x.race, x.lapNumber, x.driver, y.driver AS other, CASE WHEN x.b = y.b THEN ROUND(x.s - y.s, 3) END AS gap FROM x JOIN x y ON x.race = y.race AND x.lapNumber = y.lapNumber AND abs(x.position - y.position) BETWEEN 1 AND 6""")
q("j14_key_membership", "laps suggestions", lambda f: D.key_membership(f("laps"), f("suggestions").where("suggestionLabel in ('PIT_NOW', 'GOOD_PIT')"), f("suggestions")),
  f"SELECT l.race, l.driver, l.lapNumber, s.prediction FROM laps l LEFT JOIN (SELECT {KEY}, MAX(CAST(suggestionLabel IN ('PIT_NOW', 'GOOD_PIT') AS INT)) AS prediction FROM suggestions GROUP BY ALL) s USING ({KEY})")
q("j15_rival_at_position", "laps", lambda f: L.rival_at(f("laps"), -1),
  f", c AS (SELECT a.race, a.driver, a.lapNumber, arg_max(b.driver, b.lapNumber) AS rival FROM laps a JOIN laps b ON a.race = b.race AND b.position = a.position - 1 AND b.lapNumber BETWEEN a.lapNumber - 1 AND a.lapNumber AND b.driver <> a.driver GROUP BY ALL) SELECT {KEY}, c.rival FROM laps LEFT JOIN c USING ({KEY})")
q("j16_fill_roster", "laps suggestions", lambda f: f("laps").select("race", "driver").distinct().join(L.latest_per_key(f("suggestions"), ["race", "driver"], ["lapNumber", "totalScore", "suggestionLabel"]).select("race", "driver", "suggestionLabel", "totalScore"), ["race", "driver"], "left").select("race", "driver", F.coalesce("suggestionLabel", F.lit("MONITOR")).alias("label"), F.coalesce("totalScore", F.lit(0.0)).alias("score")),
  "SELECT race, driver, COALESCE(suggestionLabel, 'MONITOR') AS label, COALESCE(totalScore, 0.0) AS score FROM (SELECT DISTINCT race, driver FROM laps) r LEFT JOIN (SELECT * FROM suggestions QUALIFY ROW_NUMBER() OVER (PARTITION BY race, driver ORDER BY lapNumber DESC, totalScore DESC, suggestionLabel DESC) = 1) s USING (race, driver)")

# Aggregations
OOFTH = [i / 20 for i in range(1, 20)]
q("a1_duplicate_keys", "suggestions", lambda f: E.duplicate_key_stats(f("suggestions"), D.KEY), f"SELECT COUNT(*) FILTER (n > 1) AS duplicate_keys, CAST(SUM(n - 1) AS BIGINT) AS excess_rows FROM (SELECT COUNT(*) AS n FROM suggestions GROUP BY {KEY}) x")
q("a2_value_distribution", "laps", lambda f: f("laps").groupBy("trackStatus").agg(F.count("*").alias("n")), "SELECT trackStatus, COUNT(*) AS n FROM laps GROUP BY 1")
PROFILE = lambda c: f"COUNT({c}) AS n, ROUND(MIN({c}), 3) AS min, ROUND(AVG({c}), 3) AS mean, ROUND(quantile_cont({c}, 0.5), 3) AS median, ROUND(quantile_cont({c}, 0.9), 3) AS p90, ROUND(quantile_cont({c}, 0.95), 3) AS p95, ROUND(quantile_cont({c}, 0.99), 3) AS p99, ROUND(MAX({c}), 3) AS max"
q("a3_numeric_profile", "laps", lambda f: E.numeric_profile(f("laps"), "lapTime", ["race"]), f"SELECT race, {PROFILE('lapTime')} FROM laps GROUP BY race")
q("a4_null_profile", "laps", lambda f: E.null_profile(f("laps").select("lapTime", "gapToCarAhead", "pitInTime", "pitOutTime")),
  "SELECT unnest(['lapTime', 'gapToCarAhead', 'pitInTime', 'pitOutTime']) AS \"column\", unnest([ROUND(100.0 * AVG(CAST(lapTime IS NULL AS INT)), 3), ROUND(100.0 * AVG(CAST(gapToCarAhead IS NULL AS INT)), 3), ROUND(100.0 * AVG(CAST(pitInTime IS NULL AS INT)), 3), ROUND(100.0 * AVG(CAST(pitOutTime IS NULL AS INT)), 3)]) AS null_pct FROM laps")
q("a5_decision_metrics", "suggestions pit_evals", lambda f: D.decision_metrics(matched(f), ["race"]), MATCH + f"SELECT race, {RATES} FROM m GROUP BY race")
q("a5_metrics_rollup", "suggestions pit_evals", lambda f: D.metrics_rollup(matched(f)), MATCH + ", y AS (SELECT *, CAST(substr(race, 1, 4) AS INT) AS year FROM m) SELECT year, race, COUNT(*) AS actionable, COUNT(*) FILTER (outcome <> 'EXCLUDED') AS scored, COUNT(*) FILTER (outcome = '1') AS tp, ROUND(COUNT(*) FILTER (outcome = '1') / NULLIF(COUNT(*) FILTER (outcome <> 'EXCLUDED'), 0), 6) AS precision FROM y GROUP BY ROLLUP (year, race)")
q("a6_exclusions", "suggestions pit_evals", lambda f: D.exclusion_distribution(matched(f)), MATCH + "SELECT exclusionReason, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share FROM m WHERE outcome = 'EXCLUDED' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
CONF = "COUNT(*) FILTER (target_y = 1 AND raw_proba >= {t}) AS tp, COUNT(*) FILTER (target_y = 0 AND raw_proba >= {t}) AS fp, COUNT(*) FILTER (target_y = 0 AND raw_proba < {t}) AS tn, COUNT(*) FILTER (target_y = 1 AND raw_proba < {t}) AS fn"
BR = "*, ROUND(tp / NULLIF(tp + fp, 0), 6) AS precision, ROUND(tp / NULLIF(tp + fn, 0), 6) AS recall, ROUND(2 * tp / NULLIF(2 * tp + fp + fn, 0), 6) AS f1, ROUND((tp + fp) / (tp + fp + tn + fn), 6) AS positive_rate"
q("a7_binary_metrics", "oof", lambda f: E.binary_metrics(f("oof"), 0.5, ["fold"]), f"SELECT {BR} FROM (SELECT fold, {CONF.format(t=0.5)} FROM oof GROUP BY fold) x")
q("a8_reliability", "oof", lambda f: E.reliability_bins(f("oof"), 2000, ["fold"]), "SELECT fold, bin, COALESCE(n, 0) AS n, confidence, frequency FROM (SELECT * FROM (SELECT DISTINCT fold FROM oof) x, (SELECT CAST(unnest(range(2000)) AS INT) AS bin) y) s LEFT JOIN (SELECT fold, CAST(LEAST(FLOOR(raw_proba * 2000), 1999) AS INT) AS bin, COUNT(*) AS n, ROUND(AVG(raw_proba), 6) AS confidence, ROUND(AVG(target_y), 6) AS frequency FROM oof GROUP BY 1, 2) g USING (fold, bin)")
q("a8_calibration", "oof", lambda f: E.calibration_errors(f("oof"), 10, ["fold"]), "SELECT fold, CAST(SUM(n) AS BIGINT) AS n, ROUND(SUM(abs(c - f) * n) / SUM(n), 6) AS ece, ROUND(MAX(abs(c - f)), 6) AS mce, ROUND(SUM(sq) / SUM(n), 6) AS brier FROM (SELECT fold, LEAST(FLOOR(raw_proba * 10), 9) AS b, COUNT(*) AS n, AVG(raw_proba) AS c, AVG(target_y) AS f, SUM((raw_proba - target_y) * (raw_proba - target_y)) AS sq FROM oof GROUP BY 1, 2) x GROUP BY fold")
q("a9_quantile_edges", "oof", lambda f: f("oof").agg(F.percentile("raw_proba", F.array(*(F.lit(i / 5) for i in range(1, 5)))).alias("e")).select(F.posexplode("e").alias("i", "edge")).select("i", F.round("edge", 6).alias("edge")),
  "SELECT unnest([0, 1, 2, 3]) AS i, unnest([ROUND(x, 6) FOR x IN quantile_cont(raw_proba, [0.2, 0.4, 0.6, 0.8])]) AS edge FROM oof")
TH = "(SELECT unnest(range(1, 20)) / 20 AS threshold)"
SWEEP = f", sw AS (SELECT {BR} FROM (SELECT threshold, {CONF.format(t='threshold')} FROM oof, {TH} t GROUP BY threshold) x)"
q("a10_threshold_sweep", "oof", lambda f: E.threshold_sweep(f("oof"), OOFTH), SWEEP + " SELECT * FROM sw")
q("a10_best_threshold", "oof", lambda f: E.best_threshold(E.threshold_sweep(f("oof"), OOFTH), 0.5), SWEEP + " SELECT threshold, f1 FROM sw WHERE precision >= 0.5 ORDER BY f1 DESC, precision DESC, threshold DESC LIMIT 1")
scored = lambda f: f("suggestions").groupBy(*D.KEY).agg(F.max("totalScore").alias("totalScore"))
q("a11_threshold_frontier", "suggestions pit_evals", lambda f: D.threshold_frontier(scored(f), f("pit_evals"), [50.0]).drop("threshold"), MATCH.replace(f"SELECT DISTINCT {KEY} FROM suggestions WHERE suggestionLabel IN ('PIT_NOW', 'GOOD_PIT')", f"SELECT DISTINCT {KEY} FROM suggestions WHERE totalScore >= 50") + f"SELECT {RATES} FROM m")
q("a11_frontier_grid", "suggestions pit_evals", lambda f: D.threshold_frontier(scored(f), f("pit_evals"), [40.0, 50.0, 60.0, 70.0, 80.0]))
q("a12_policy_table", "oof", lambda f: E.binary_metrics(f("oof"), 0.3).withColumn("policy", F.lit("fixed_0.3")).unionByName(E.binary_metrics(f("oof"), 0.7).withColumn("policy", F.lit("fixed_0.7"))), f"SELECT {BR} FROM (SELECT 'fixed_0.3' AS policy, {CONF.format(t=0.3)} FROM oof UNION ALL SELECT 'fixed_0.7', {CONF.format(t=0.7)} FROM oof) x")
q("a13_fp_overlap", "suggestions pit_evals", lambda f: D.fp_overlap_sets({"a": matched(f), "b": matched(f).where("lapNumber <= 30"), "c": matched(f).where("lapNumber > 10")}), MATCH + "SELECT 1 AS in_a, CAST(lapNumber <= 30 AS INT) AS in_b, CAST(lapNumber > 10 AS INT) AS in_c, COUNT(*) AS n FROM m WHERE outcome = '0' GROUP BY 1, 2, 3")
q("a14_feature_effects", "oof", lambda f: D.feature_effects(f("oof").where("raw_proba >= 0.5"), ["raw_proba", "lapNumber"], C("target_y") == 1),
  ", x AS (SELECT target_y, unnest(['raw_proba', 'lapNumber']) AS feature, unnest([raw_proba, CAST(lapNumber AS DOUBLE)]) AS v FROM oof WHERE raw_proba >= 0.5), g AS (SELECT feature, COUNT(*) FILTER (target_y = 1) AS n_tp, COUNT(*) FILTER (target_y = 0) AS n_fp, AVG(v) FILTER (target_y = 1) AS m1, AVG(v) FILTER (target_y = 0) AS m0, var_pop(v) FILTER (target_y = 1) AS v1, var_pop(v) FILTER (target_y = 0) AS v0, ROUND(quantile_cont(v, 0.5) FILTER (target_y = 1), 6) AS median_tp, ROUND(quantile_cont(v, 0.1) FILTER (target_y = 1), 6) AS p10_tp, ROUND(quantile_cont(v, 0.9) FILTER (target_y = 1), 6) AS p90_tp, ROUND(quantile_cont(v, 0.5) FILTER (target_y = 0), 6) AS median_fp, ROUND(quantile_cont(v, 0.1) FILTER (target_y = 0), 6) AS p10_fp, ROUND(quantile_cont(v, 0.9) FILTER (target_y = 0), 6) AS p90_fp FROM x GROUP BY 1) SELECT median_tp, p10_tp, p90_tp, median_fp, p10_fp, p90_fp, feature, n_tp, n_fp, ROUND(m1, 6) AS mean_tp, ROUND(m0, 6) AS mean_fp, ROUND(sqrt(v1), 6) AS std_tp, ROUND(sqrt(v0), 6) AS std_fp, ROUND((m1 - m0) / sqrt((v1 + v0) / 2), 6) AS cohens_d FROM g")
q("a15_near_misses", "suggestions pit_evals", lambda f: D.near_miss_distribution(matched(f)), MATCH + "SELECT CASE WHEN nextPitLap IS NULL THEN 'no_future' WHEN nextPitLap - lapNumber <= 2 THEN 'unexpected_within_horizon' WHEN nextPitLap - lapNumber <= 5 THEN 'near_miss_3_5' ELSE 'far_miss_6_plus' END AS bucket, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS rate FROM m WHERE matchedPitLap IS NULL GROUP BY 1")
q("a16_latency", "timings", lambda f: E.numeric_profile(f("timings").where("status = 'ok' and event_index > 50"), "total_ms", ["year"]), f"SELECT year, {PROFILE('total_ms')} FROM timings WHERE status = 'ok' AND event_index > 50 GROUP BY year")
q("a17_class_balance", "oof", lambda f: f("oof").agg(D.count_if(C("target_y") == 1).alias("positives"), D.count_if(C("target_y") == 0).alias("negatives")).withColumn("weight", D.ratio(C("negatives"), C("positives"))), "SELECT *, ROUND(negatives / positives, 6) AS weight FROM (SELECT COUNT(*) FILTER (target_y = 1) AS positives, COUNT(*) FILTER (target_y = 0) AS negatives FROM oof) x")
q("a18_field_median", "laps", lambda f: L.field_median(f("laps")).withColumn("medianLap", F.round("medianLap", 6)), f"SELECT race, lapNumber, ROUND(quantile_cont(lapTime, 0.5), 6) AS medianLap FROM laps WHERE {CLEANQ} GROUP BY 1, 2")
q("a19_coverage", "laps suggestions", lambda f: f("laps").agg(F.countDistinct("race").alias("laps")).crossJoin(f("suggestions").agg(F.countDistinct("race").alias("suggestions"))), "SELECT (SELECT COUNT(DISTINCT race) FROM laps) AS laps, (SELECT COUNT(DISTINCT race) FROM suggestions) AS suggestions")
q("a20_wet_dry", "laps pit_evals", lambda f: f("pit_evals").join(f("laps").select("race", "driver", C("lapNumber").alias("pitLapNumber"), (C("compound") == "INTERMEDIATE").alias("wet")), ["race", "driver", "pitLapNumber"]).groupBy("result", "wet").agg(F.count("*").alias("n")), "SELECT result, compound = 'INTERMEDIATE' AS wet, COUNT(*) AS n FROM pit_evals e JOIN laps l ON e.race = l.race AND e.driver = l.driver AND e.pitLapNumber = l.lapNumber GROUP BY 1, 2")
q("a21_drift", "suggestions pit_evals", lambda f: D.decision_metrics(matched(f), ["race"]).agg(F.round(F.avg("precision"), 5).alias("mean"), F.round(F.stddev_pop("precision"), 5).alias("std"), F.round(F.avg("coverage"), 5).alias("coverage")), MATCH + f"SELECT ROUND(AVG(precision), 5) AS mean, ROUND(stddev_pop(precision), 5) AS std, ROUND(AVG(coverage), 5) AS coverage FROM (SELECT race, {RATES} FROM m GROUP BY race) x")
q("a22_config_summary", "oof", lambda f: E.binary_metrics(f("oof"), 0.5, ["fold"]).agg(F.round(F.avg("precision"), 5).alias("precision"), F.round(F.avg("recall"), 5).alias("recall"), F.round(F.avg("f1"), 5).alias("f1"), F.count("*").alias("folds")), f"SELECT ROUND(AVG(precision), 5) AS precision, ROUND(AVG(recall), 5) AS recall, ROUND(AVG(f1), 5) AS f1, COUNT(*) AS folds FROM (SELECT {BR} FROM (SELECT fold, {CONF.format(t=0.5)} FROM oof GROUP BY fold) x) y")
q("a23_split_coverage", "oof", lambda f: f("oof").groupBy("fold").agg(F.countDistinct("race").alias("races"), F.countDistinct(S.year_of_race(C("race"))).alias("years"), F.count("*").alias("n"), F.sum("target_y").alias("positives")), "SELECT fold, COUNT(DISTINCT race) AS races, COUNT(DISTINCT substr(race, 1, 4)) AS years, COUNT(*) AS n, CAST(SUM(target_y) AS BIGINT) AS positives FROM oof GROUP BY fold")
q("a24_baseline_lap", "laps", lambda f: L.baseline_laps(f("laps")).withColumn("baseline", F.round("baseline", 6)),
  f", b AS (SELECT race, driver, stint, MIN(lapTime) AS best FROM laps WHERE {CLEANQ} GROUP BY ALL), m AS (SELECT race, lapNumber, quantile_cont(lapTime, 0.5) AS med FROM laps WHERE {CLEANQ} GROUP BY ALL) SELECT race, driver, lapNumber, ROUND(COALESCE(best, med, 95.0), 6) AS baseline FROM laps LEFT JOIN b USING (race, driver, stint) LEFT JOIN m USING (race, lapNumber)")
q("a25_total_laps", "laps", lambda f: f("laps").select(*D.KEY).join(f("laps").groupBy("race").agg(F.max("lapNumber").alias("total")), "race"), f"SELECT {KEY}, MAX(lapNumber) OVER (PARTITION BY race) AS total FROM laps")
q("a26_failures", "timings", lambda f: f("timings").where("status <> 'ok'").groupBy("status", "year").agg(F.count("*").alias("n")), "SELECT status, year, COUNT(*) AS n FROM timings WHERE status <> 'ok' GROUP BY ALL")

# Windows
q("w1_gap_to_car_ahead", "laps", lambda f: L.gap_to_car_ahead(f("laps")).select(*D.KEY, "gap"), f", x AS (SELECT *, SUM(lapTime) OVER (PARTITION BY race, driver ORDER BY lapNumber ROWS UNBOUNDED PRECEDING) AS c FROM laps) SELECT {KEY}, ROUND(c - LAG(c) OVER (PARTITION BY race, lapNumber ORDER BY position), 3) AS gap FROM x")
q("w2_rivals", "laps", lambda f: L.rivals(f("laps")), f"SELECT {KEY}, position, LAG(driver) OVER w AS driverAhead, LEAD(driver) OVER w AS driverBehind, CASE WHEN LAG(driver) OVER w IS NOT NULL THEN abs(gapToCarAhead) END AS gapAhead, abs(LEAD(gapToCarAhead) OVER w) AS gapBehind FROM laps WINDOW w AS (PARTITION BY race, lapNumber ORDER BY position)")
q("w3_drs_trains", "laps", lambda f: L.drs_trains(f("laps")), ", r AS (SELECT *, SUM(CASE WHEN gapToCarAhead < 1.0 THEN 0 ELSE 1 END) OVER (PARTITION BY race, lapNumber ORDER BY position ROWS UNBOUNDED PRECEDING) AS t FROM laps) SELECT race, lapNumber, MIN(position) AS head, COUNT(*) AS size, string_agg(driver, ',' ORDER BY position) AS drivers FROM r GROUP BY race, lapNumber, t HAVING COUNT(*) >= 3")
STINT = ", st0 AS (SELECT *, CASE WHEN LAG(lapNumber) OVER w IS NULL OR tyreLife < LAG(tyreLife) OVER w OR compound IS DISTINCT FROM LAG(compound) OVER w THEN 1 ELSE 0 END AS nw FROM laps WINDOW w AS (PARTITION BY race, driver ORDER BY lapNumber)), st AS (SELECT *, CAST(SUM(nw) OVER (PARTITION BY race, driver ORDER BY lapNumber ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stintId FROM st0)"
q("w4_stint_segments", "laps", lambda f: L.stint_segments(f("laps")).select(*D.KEY, "stintId"), STINT + f" SELECT {KEY}, stintId FROM st")
q("w5_stint_features", "laps", lambda f: L.stint_features(f("laps")).select(*D.KEY, "stintBest", F.round("paceDropRatio", 6).alias("pace"), F.round("tireLifeRatio", 6).alias("tire")), STINT + f", b AS (SELECT *, MIN(lapTime) OVER (PARTITION BY race, driver, stintId ORDER BY lapNumber ROWS UNBOUNDED PRECEDING) AS stintBest FROM st) SELECT {KEY}, stintBest, ROUND(GREATEST(0.5::DOUBLE, LEAST(2.0::DOUBLE, COALESCE(lapTime / stintBest, 1.0::DOUBLE))), 6) AS pace, ROUND(GREATEST(0.0::DOUBLE, LEAST(3.0::DOUBLE, tyreLife / {MAXSTINT})), 6) AS tire FROM b")
q("w6_lag2_trend", "laps", lambda f: L.lag2_trend(f("laps"), "gapToCarAhead", "trend").select(*D.KEY, F.round("trend", 6).alias("trend")), f"SELECT {KEY}, ROUND(COALESCE(gapToCarAhead - LAG(gapToCarAhead, 2) OVER (PARTITION BY race, driver ORDER BY lapNumber), 0.0), 6) AS trend FROM laps")
q("w7_expanding_z", "laps", lambda f: L.expanding_z(f("laps"), "trackTemp", "z").select(*D.KEY, F.round("z", 4).alias("z")), f", x AS (SELECT {KEY}, trackTemp AS v, COUNT(trackTemp) OVER w AS n, SUM(trackTemp) OVER w AS s, SUM(trackTemp * trackTemp) OVER w AS qq FROM laps WINDOW w AS (PARTITION BY race ORDER BY lapNumber, driver ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT {KEY}, ROUND(CASE WHEN n >= 2 AND qq / n - (s / n) * (s / n) > 1e-12 THEN (v - s / n) / sqrt(qq / n - (s / n) * (s / n)) ELSE 0.0 END, 4) AS z FROM x")
q("w8_driver_prev_mean", "laps", lambda f: L.driver_prev_mean_ratio(f("laps")).select(*D.KEY, F.round("driverPrevMeanRatio", 6).alias("r")), f"SELECT {KEY}, ROUND(GREATEST(0.5::DOUBLE, LEAST(2.0::DOUBLE, COALESCE(lapTime / AVG(lapTime) OVER (PARTITION BY race, driver ORDER BY lapNumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0::DOUBLE))), 6) AS r FROM laps")
q("w9_team_prev_bucket", "laps", lambda f: L.bucket_prev_ratio(f("laps"), ["race", "team"], "r").select(*D.KEY, F.round("r", 6).alias("r")), f", m AS (SELECT race, team, lapNumber, AVG(lapTime) AS m FROM laps GROUP BY ALL), p AS (SELECT *, AVG(m) OVER (PARTITION BY race, team ORDER BY lapNumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM m) SELECT race, driver, lapNumber, ROUND(GREATEST(0.5::DOUBLE, LEAST(2.0::DOUBLE, COALESCE(lapTime / past, 1.0::DOUBLE))), 6) AS r FROM laps JOIN p USING (race, team, lapNumber)")
q("w10_race_progress", "laps", lambda f: f("laps").select(*D.KEY, F.round(F.least(F.lit(1.5), C("lapNumber") / C("totalLaps")), 6).alias("progress")), f"SELECT {KEY}, ROUND(LEAST(1.5::DOUBLE, lapNumber / totalLaps), 6) AS progress FROM laps")
q("w11_tire_drops", "laps", lambda f: L.tire_drops(f("laps")).withColumn("delta", F.round("delta", 6)), f""", c AS (SELECT *, MIN(lapTime) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb, MIN(lapTime) OVER (w ROWS UNBOUNDED PRECEDING) AS best FROM laps WHERE {CLEANQ} AND lapNumber > 2 WINDOW w AS (PARTITION BY race, driver, stint ORDER BY lapNumber)),
s AS (SELECT *, CASE WHEN lapTime > pb * 1.07::DOUBLE THEN 0 WHEN lapTime > best * (1.0::DOUBLE + GREATEST(0.005::DOUBLE, CASE compound WHEN 'SOFT' THEN 0.012 WHEN 'HARD' THEN 0.02 WHEN 'INTERMEDIATE' THEN 0.025 ELSE 0.015 END::DOUBLE - 0.003::DOUBLE * LEAST(lapNumber / totalLaps, 1.0::DOUBLE) - CASE WHEN trackTemp > 40 THEN 0.002 ELSE 0.0 END::DOUBLE)) THEN 1 ELSE 0 END AS slow FROM c),
r AS (SELECT *, SUM(1 - slow) OVER (PARTITION BY race, driver, stint ORDER BY lapNumber ROWS UNBOUNDED PRECEDING) AS run FROM s), p AS (SELECT *, SUM(slow) OVER (PARTITION BY race, driver, stint, run ORDER BY lapNumber ROWS UNBOUNDED PRECEDING) AS place FROM r)
SELECT {KEY}, compound, tyreLife, lapTime, best AS stintBest, ROUND(lapTime - best, 6) AS delta, trackStatus FROM p WHERE slow = 1 AND place % 2 = 0""")
# Grids at moments, and the scores on them
TRIGGERS = """, gm AS (SELECT race, eventTimeMillis AS t, MAX(lapNumber) AS L FROM laps GROUP BY 1, 2),
gp AS (SELECT *, MAX(L) OVER (PARTITION BY race ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM gm),
trig AS (SELECT race, t, L, L - 3 AS floorLap FROM gp WHERE L > COALESCE(before, 0) AND L > 1)"""
CAUTIONS = """, trig AS (SELECT s.race, s.t, MAX(l.lapNumber) - 1 AS L, MAX(l.lapNumber) - 4 AS floorLap FROM (SELECT DISTINCT race, eventTimeMillis AS t FROM track_status WHERE status IN ('4', '6', '7')) s JOIN laps l ON l.race = s.race AND l.eventTimeMillis <= s.t GROUP BY 1, 2 HAVING MAX(l.lapNumber) > 1)"""
BOTH = TRIGGERS.replace("trig AS", "t1 AS") + CAUTIONS.replace("trig AS", "t2 AS") + ", trig AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 WHERE NOT EXISTS (SELECT 1 FROM t1 WHERE t1.race = t2.race AND t1.t = t2.t))"
GRID = """, rk AS (SELECT trig.race, trig.t, trig.L, l.driver, MAX(l.eventTimeMillis) AS e FROM trig JOIN laps l ON l.race = trig.race AND l.eventTimeMillis <= trig.t GROUP BY ALL),
gr AS (SELECT rk.t, rk.L, l.* FROM rk JOIN laps l ON l.race = rk.race AND l.driver = rk.driver AND l.eventTimeMillis = rk.e JOIN trig ON trig.race = rk.race AND trig.t = rk.t WHERE l.lapNumber >= trig.floorLap)"""
NOW = """, nw AS (SELECT trig.race, trig.t, COALESCE(arg_max(s.status, s.eventTimeMillis), '1') AS now FROM trig LEFT JOIN track_status s ON s.race = trig.race AND s.eventTimeMillis <= trig.t GROUP BY ALL)"""


def emerging(source: str, status: str) -> str:
    return f""", ld AS (SELECT *, ROUND(COALESCE(SUM(gapToCarAhead) OVER w, 0), 6) AS s, COUNT(*) FILTER (gapToCarAhead IS NULL) OVER w AS b, ROW_NUMBER() OVER w AS k, LAG(driver) OVER w AS netRival,
  LAG(pitInTime) OVER w AS pitAhead, LAG(lapNumber) OVER w AS lapAhead, LEAD(pitInTime) OVER w AS pitBehind, LEAD(lapNumber) OVER w AS lapBehind,
  CASE {status} WHEN '4' THEN scPitLoss WHEN '6' THEN vscPitLoss WHEN '7' THEN vscPitLoss WHEN '1' THEN pitLoss END AS loss FROM {source} WINDOW w AS (PARTITION BY race, t ORDER BY position, driver ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ov AS (SELECT x.race, x.t, x.driver, MIN(y.k) FILTER (y.s - x.s >= x.loss) AS beyond, MAX(y.k) AS furthest FROM ld x JOIN ld y ON x.race = y.race AND x.t = y.t AND y.b = x.b AND y.k > x.k GROUP BY ALL),
em AS (SELECT x.*, m.driver AS carAhead, m.compound AS carCompound, m.tyreLife AS carTyreLife, COALESCE(m.position + 1, x.position) AS emergencePosition, x.loss - (m.s - x.s) AS gapToCar
  FROM ld x LEFT JOIN ov ON ov.race = x.race AND ov.t = x.t AND ov.driver = x.driver LEFT JOIN ld m ON m.race = x.race AND m.t = x.t AND x.loss IS NOT NULL AND m.k = COALESCE(ov.beyond - 1, ov.furthest) AND m.k > x.k)"""


PACE = f""", pa AS (SELECT *, CASE WHEN {CLEANQ} THEN lapTime END AS ct, CASE WHEN pitInTime IS NULL AND pitOutTime IS NULL AND {GREENQ} AND gapToCarAhead >= 0 THEN gapToCarAhead END AS fg FROM laps),
pb AS (SELECT *, MIN(ct) OVER w AS best, LAST_VALUE(fg IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prevGap FROM pa WINDOW w AS (PARTITION BY race, driver, stint ORDER BY lapNumber)),
pc AS (SELECT *, ct / best - 1.0 AS pr, LAST_VALUE(CASE WHEN ct IS NOT NULL THEN ct / best - 1.0 END IGNORE NULLS) OVER (PARTITION BY race, driver, stint ORDER BY lapNumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM pb),
pd AS (SELECT *, SUM(CASE WHEN pr <= 0.005 THEN 1 ELSE 0 END) OVER (PARTITION BY race, driver, stint ORDER BY lapNumber ROWS UNBOUNDED PRECEDING) AS run FROM pc),
ps AS (SELECT {KEY}, best, COALESCE(pr, held, 0.0) AS pace, COALESCE(pr - held, 0.0) AS paceDelta, CAST(SUM(CASE WHEN pr > 0.005 THEN 1 ELSE 0 END) OVER (PARTITION BY race, driver, stint, run ORDER BY lapNumber ROWS UNBOUNDED PRECEDING) AS BIGINT) AS slowLaps, COALESCE(fg - prevGap, 0.0) AS gapDelta FROM pd)"""
NEXTSTINT = "CASE upper(compound) WHEN 'MEDIUM' THEN 40.0 ELSE 30.0 END::DOUBLE"
SCORES = GRID + NOW + ", gs AS (SELECT gr.*, nw.now FROM gr JOIN nw ON nw.race = gr.race AND nw.t = gr.t)" + emerging("gs", "now") + PACE + f""", sn AS (SELECT trig.race, trig.t, z.compound, MAX(z.tyreLife)::DOUBLE AS m FROM trig JOIN laps z ON z.race = trig.race AND z.eventTimeMillis <= trig.t WHERE z.compound IS NOT NULL GROUP BY ALL),
s1 AS (SELECT em.*, ps.pace, ps.paceDelta, ps.slowLaps, ps.gapDelta, COALESCE(a.m, {MAXSTINT.replace("upper(compound)", "upper(em.compound)")}) AS stintSeen, COALESCE(n.m, {NEXTSTINT.replace("upper(compound)", "upper(em.compound)")}) AS nextStint, CAST(totalLaps - em.lapNumber AS DOUBLE) AS lapsLeft
  FROM em JOIN ps ON ps.race = em.race AND ps.driver = em.driver AND ps.lapNumber = em.lapNumber LEFT JOIN sn a ON a.race = em.race AND a.t = em.t AND a.compound = em.compound
  LEFT JOIN sn n ON n.race = em.race AND n.t = em.t AND n.compound = CASE upper(em.compound) WHEN 'MEDIUM' THEN 'HARD' ELSE 'MEDIUM' END WHERE tyreLife >= 8 AND pitInTime IS NULL AND pitOutTime IS NULL),
s2 AS (SELECT *, CASE WHEN {GREENQ} THEN LEAST(12.0, CASE WHEN pitAhead IS NOT NULL AND abs(lapNumber - lapAhead) <= 1 THEN 10.0 ELSE 0.0 END + CASE WHEN pitBehind IS NOT NULL AND abs(lapNumber - lapBehind) <= 1 THEN 6.0 ELSE 0.0 END) ELSE 0.0 END::DOUBLE AS rival,
  CASE WHEN lapTime IS NOT NULL AND slowLaps >= 1 AND pace > 0 THEN 30.0::DOUBLE * LEAST(1.0::DOUBLE, pow(pace / 0.02::DOUBLE, 1.5::DOUBLE)) ELSE 0.0::DOUBLE END AS paceScore,
  CASE WHEN tyreLife / stintSeen < 0.7::DOUBLE THEN 0.0::DOUBLE ELSE 30.0::DOUBLE * LEAST(1.0::DOUBLE, pow((tyreLife / stintSeen - 0.7::DOUBLE) / (1.0::DOUBLE - 0.7::DOUBLE), 2)) END AS urgency,
  CASE WHEN totalLaps <= 0 OR lapsLeft <= 0 OR nextStint >= lapsLeft THEN 0.0::DOUBLE ELSE -15.0::DOUBLE * LEAST(1.0::DOUBLE, (lapsLeft - nextStint) / lapsLeft * 3.0::DOUBLE) END AS penalty,
  CASE WHEN totalLaps <= 0 THEN 0.0::DOUBLE ELSE -100.0::DOUBLE / (1.0::DOUBLE + exp(-15.0::DOUBLE * (lapNumber / totalLaps - 0.92::DOUBLE))) END AS ending,
  CASE WHEN now IN ('4', '6', '7') THEN 60.0 ELSE 0.0 END::DOUBLE AS status, CASE WHEN gapToCar IS NULL OR gapToCar >= 3 THEN 30.0::DOUBLE WHEN gapToCar >= 1 THEN 30.0::DOUBLE * (gapToCar - 1.0::DOUBLE) / 2.0::DOUBLE WHEN gapToCar >= 0 THEN -30.0::DOUBLE * (1.0::DOUBLE - gapToCar) ELSE -30.0::DOUBLE END AS road FROM s1),
s3 AS (SELECT *, CASE WHEN loss IS NULL THEN 0.0::DOUBLE WHEN carTyreLife >= 25 AND road < 30 THEN LEAST(30.0::DOUBLE, road + 5.0::DOUBLE) ELSE road END AS traffic, LEAST(30.0::DOUBLE, urgency + rival) AS action FROM s2),
s4 AS (SELECT *, CASE WHEN status > 0 OR (urgency < 8 AND rival <= 0) THEN 0.0::DOUBLE ELSE GREATEST(0.0::DOUBLE, LEAST(10.0::DOUBLE, 6.0::DOUBLE * LEAST(1.0::DOUBLE, GREATEST(0.0::DOUBLE, paceDelta) / 0.003::DOUBLE) + 4.0::DOUBLE * LEAST(1.0::DOUBLE, GREATEST(0.0::DOUBLE, gapDelta) / 0.8::DOUBLE)
  + CASE WHEN penalty < 0 THEN 2.0::DOUBLE * LEAST(1.0::DOUBLE, abs(penalty) / 8.0::DOUBLE) ELSE 0.0::DOUBLE END + LEAST(2.5::DOUBLE, rival * 0.25::DOUBLE) + CASE WHEN traffic < 0 THEN -1.5 WHEN traffic >= 20 THEN 1.0 ELSE 0.0 END::DOUBLE)) END AS timing FROM s3),
s5 AS (SELECT *, GREATEST(0.0::DOUBLE, LEAST(100.0::DOUBLE, paceScore + status + traffic + penalty + action + timing + ending)) AS score FROM s4),
s6 AS (SELECT *, CASE WHEN score >= 80 THEN 'PIT_NOW' WHEN score >= 60 THEN 'GOOD_PIT' WHEN status <= 0 AND score >= 52 AND paceScore >= 8 AND action >= 10 THEN 'GOOD_PIT' ELSE 'MONITOR' END AS l1 FROM s5),
s7 AS (SELECT *, CASE WHEN l1 <> 'MONITOR' AND traffic < 0 AND urgency < 28 THEN 'MONITOR' ELSE l1 END AS l2 FROM s6),
sc AS (SELECT *, CASE WHEN l2 = 'MONITOR' OR status > 0 OR rival > 0 THEN l2 WHEN action >= 12 AND (penalty <= -3 OR timing >= 3.5 OR paceScore >= 18) THEN l2 WHEN paceScore >= 18 AND penalty <= -3 AND (timing >= 3.5 OR paceDelta >= 0.001) THEN l2 ELSE 'MONITOR' END AS label FROM s7)"""
WHY = """COALESCE(NULLIF(concat_ws(' + ', CASE WHEN paceScore > 5 THEN 'pace drop' END, CASE WHEN rival > 0 THEN 'rival boxed' END, CASE WHEN timing >= 6 THEN 'window tightening' WHEN timing >= 3 THEN 'window forming' END, CASE WHEN status > 0 THEN 'SC/VSC opportunity' END,
  CASE WHEN traffic >= 25 THEN 'clean air' WHEN traffic > 0 THEN 'decent gap' WHEN traffic < -10 THEN 'traffic risk' END, CASE WHEN penalty < -5 THEN 'tight tire window' END, CASE WHEN action >= 20 THEN 'tire cliff' WHEN action >= 10 THEN 'closing window' END, CASE WHEN ending < -30 THEN 'race ending' END), ''), 'general')"""
scores = lambda f: L.pit_scores(f("laps"), f("track_status"))
AT = [*D.KEY, "snapMillis"]
PARTS = ["score", "paceScore", "urgency", "action", "penalty", "ending", "status", "traffic", "rival", "timing"]
ROUNDED = ", ".join(f"ROUND({c}, 6) AS {c}" for c in PARTS)
rounded = lambda df: df.select(*AT, "label", "why", *(F.round(c, 6).alias(c) for c in PARTS))
q("w12_race_snapshots", "laps", lambda f: L.grid_at(f("laps"), L.race_snapshots(f("laps"))).select(*AT, "snapLap", "position"), TRIGGERS + GRID + f" SELECT {KEY}, t AS snapMillis, L AS snapLap, position FROM gr")
q("w13_drop_zones", "laps", lambda f: L.drop_zones(f("laps")), TRIGGERS + GRID + emerging("gr", "trackStatus") + f" SELECT {KEY}, L AS snapLap, position, emergencePosition, emergencePosition - position AS positionsLost, netRival, carAhead, ROUND(gapToCar, 3) AS gapToCar, carCompound, carTyreLife, trackStatus AS status, loss FROM em WHERE tyreLife >= 8 AND carAhead IS NOT NULL")
q("w14_pace_state", "laps", lambda f: L.pace_state(f("laps")).select(*D.KEY, "best", F.round("pace", 6).alias("pace"), F.round("paceDelta", 6).alias("paceDelta"), "slowLaps", F.round("gapDelta", 6).alias("gapDelta")), PACE + f" SELECT {KEY}, best, ROUND(pace, 6) AS pace, ROUND(paceDelta, 6) AS paceDelta, slowLaps, ROUND(gapDelta, 6) AS gapDelta FROM ps")
q("w16_neighbor_pit_boost", "laps track_status", lambda f: scores(f).select(*AT, "rival"), TRIGGERS + SCORES + f" SELECT {KEY}, t AS snapMillis, rival FROM sc")
q("w17_traffic_score", "laps track_status", lambda f: scores(f).select(*AT, F.round("traffic", 6).alias("traffic"), "emergencePosition"), TRIGGERS + SCORES + f" SELECT {KEY}, t AS snapMillis, ROUND(traffic, 6) AS traffic, emergencePosition FROM sc")
q("w18_pit_scores", "laps track_status", lambda f: rounded(scores(f)), TRIGGERS + SCORES + f" SELECT {KEY}, t AS snapMillis, label, {WHY} AS why, {ROUNDED} FROM sc")
q("f21_decision_labels", "laps track_status", lambda f: scores(f).groupBy("race", "label").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most")), TRIGGERS + SCORES + " SELECT race, label, COUNT(*) AS n, ROUND(MIN(score), 6) AS least, ROUND(MAX(score), 6) AS most FROM sc GROUP BY 1, 2")
q("f23_explained_scores", "laps track_status", lambda f: scores(f).groupBy("why", "label").agg(F.count("*").alias("n")), TRIGGERS + SCORES + f" SELECT {WHY} AS why, label, COUNT(*) AS n FROM sc GROUP BY 1, 2")
q("k7_caution_rescore", "laps track_status", lambda f: rounded(L.pit_scores(f("laps"), f("track_status"), ("caution",))), CAUTIONS + SCORES + f" SELECT {KEY}, t AS snapMillis, label, {WHY} AS why, {ROUNDED} FROM sc")
EMIT = f""", er AS (SELECT race, driver, ROW_NUMBER() OVER (PARTITION BY race, driver ORDER BY t) AS rn, t, lapNumber, stint, score, label, now, timing, action, pace FROM sc),
ew AS (SELECT race, driver, CAST(0 AS BIGINT) AS rn, NULL::INT AS onStint, 0.0::DOUBLE AS peak, FALSE AS lost, NULL::INT AS stint, NULL::VARCHAR AS status, NULL::DOUBLE AS score, NULL::DOUBLE AS timing, NULL::INT AS lap, NULL::VARCHAR AS told, NULL::INT AS lapNumber, NULL::BIGINT AS t, NULL::DOUBLE AS s FROM (SELECT DISTINCT race, driver FROM er) x
 UNION ALL SELECT race, driver, rn, stint2, peak2, lost2 OR gone, CASE WHEN tell THEN stint2 ELSE stint END, CASE WHEN tell THEN now ELSE status END, CASE WHEN tell THEN s2 ELSE score END, CASE WHEN tell THEN timing2 ELSE timing END, CASE WHEN tell THEN lap2 ELSE lap END, CASE WHEN gone THEN 'LOST_CHANCE' WHEN tell THEN label END, lap2, t2, s2
 FROM (SELECT *, NOT gone AND s2 >= 40 AND (stint IS NULL OR stint <> stint2 OR label <> CASE WHEN score >= 80 THEN 'PIT_NOW' WHEN score >= 60 THEN 'GOOD_PIT' ELSE 'MONITOR' END OR status <> now OR abs(s2 - score) >= 10 OR (label <> 'MONITOR' AND ((action >= 10 AND timing2 - timing >= 2) OR lap2 - lap >= 2))) AS tell
 FROM (SELECT *, NOT lost2 AND peak2 >= 70 AND s2 < 40 AND pace > 0.005 AS gone FROM (SELECT w.race, w.driver, r.rn, w.stint, w.status, w.score, w.timing, w.lap, r.stint AS stint2, r.now, r.score AS s2, r.timing AS timing2, r.lapNumber AS lap2, r.t AS t2, r.label, r.action, r.pace,
   GREATEST(CASE WHEN w.onStint = r.stint THEN w.peak ELSE 0.0::DOUBLE END, r.score) AS peak2, CASE WHEN w.onStint = r.stint THEN w.lost ELSE FALSE END AS lost2 FROM ew w JOIN er r ON r.race = w.race AND r.driver = w.driver AND r.rn = w.rn + 1) a) b) c)"""
q("k6_emit_gate", "laps track_status", lambda f: D.emit_gate(L.pit_scores(f("laps"), f("track_status"), ("lap", "caution"))).withColumn("score", F.round("score", 6)), BOTH + SCORES + EMIT + f" SELECT {KEY}, t AS snapMillis, ROUND(s, 6) AS score, told AS label FROM ew WHERE told IS NOT NULL")
COAST = f""", tg AS (SELECT * FROM telemetry WHERE {GREENQ} AND lapNumber > 5),
br AS (SELECT race, driver, eventTimeMillis AS b FROM tg WHERE brake = 1),
li AS (SELECT l.race, l.driver, l.eventTimeMillis AS l, MIN(b.b) AS b FROM tg l JOIN br b ON b.race = l.race AND b.driver = l.driver AND b.b > l.eventTimeMillis WHERE throttle < 5 AND brake = 0 GROUP BY ALL),
st AS (SELECT s.race, s.driver, s.eventTimeMillis AS f, MIN(l.l) AS l FROM tg s JOIN (SELECT l.race, l.driver, l.eventTimeMillis AS l FROM tg l WHERE throttle < 5 AND brake = 0) l ON l.race = s.race AND l.driver = s.driver AND l.l > s.eventTimeMillis WHERE throttle >= 95 AND speed >= 250 AND nGear >= 6 AND brake = 0 GROUP BY ALL),
cd AS (SELECT st.race, st.driver, st.f, st.l, li.b FROM st JOIN li ON li.race = st.race AND li.driver = st.driver AND li.l = st.l WHERE li.b - st.f < 4000),
wk AS (SELECT race, driver, CAST(-1 AS BIGINT) AS b FROM (SELECT DISTINCT race, driver FROM cd) x UNION ALL SELECT w.race, w.driver, arg_min(c.b, c.f) AS b FROM wk w JOIN cd c ON c.race = w.race AND c.driver = w.driver AND c.f > w.b GROUP BY w.race, w.driver),
hit AS (SELECT c.race, c.driver, c.b, MIN(c.f) AS f, arg_min(c.l, c.f) AS l FROM cd c JOIN wk ON wk.race = c.race AND wk.driver = c.driver AND wk.b = c.b
  WHERE c.f > COALESCE((SELECT MAX(p.b) FROM wk p WHERE p.race = c.race AND p.driver = c.driver AND p.b < c.b), -1) GROUP BY ALL),
co AS (SELECT race, driver, f AS startMillis, l AS liftMillis, b AS brakeMillis, b - l AS coastMillis FROM hit WHERE b - l >= 550)"""
q("k1_lift_coast", "telemetry", lambda f: L.lift_coast(f("telemetry")), COAST + " SELECT * FROM co")
q("f28_coast_seconds", "telemetry", lambda f: L.lift_coast(f("telemetry")).groupBy("race", "driver").agg(F.count("*").alias("n"), F.round(F.avg(C("coastMillis") / 1000), 6).alias("coast_seconds"), F.round(F.avg((C("liftMillis") - C("startMillis")) / 1000), 6).alias("full_to_lift_seconds"), F.round(F.avg((C("brakeMillis") - C("startMillis")) / 1000), 6).alias("full_to_brake_seconds")),
  COAST + " SELECT race, driver, COUNT(*) AS n, ROUND(AVG(coastMillis / 1000), 6) AS coast_seconds, ROUND(AVG((liftMillis - startMillis) / 1000), 6) AS full_to_lift_seconds, ROUND(AVG((brakeMillis - startMillis) / 1000), 6) AS full_to_brake_seconds FROM co GROUP BY 1, 2")
q("w15_compound_max_stint", "laps", lambda f: f("laps").select(*D.KEY, F.max("tyreLife").over(L.Window.partitionBy("race", "compound").orderBy("lapNumber", "driver").rowsBetween(L.UNBOUNDED, 0)).alias("seen")), f"SELECT {KEY}, MAX(tyreLife) OVER (PARTITION BY race, compound ORDER BY lapNumber, driver ROWS UNBOUNDED PRECEDING) AS seen FROM laps")
q("w20_moving_pace", "laps", lambda f: L.moving_pace(f("laps")).withColumn("pace", F.round("pace", 6)), f"SELECT {KEY}, ROUND(AVG(lapTime) OVER (PARTITION BY race, driver ORDER BY lapNumber ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS pace FROM laps WHERE {CLEANQ}")
q("w22_dedup_keep_last", "suggestions", lambda f: L.dedup_keep_last(f("suggestions"), D.KEY, ["eventTimeMillis"]).select(*D.KEY, "suggestionLabel"), f"SELECT {KEY}, suggestionLabel FROM suggestions QUALIFY ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY eventTimeMillis DESC) = 1")
q("w23_dedup_priority", "suggestions", lambda f: D.dedup_priority(f("suggestions")).select(*D.KEY, "suggestionLabel", "totalScore"), f"SELECT {KEY}, suggestionLabel, totalScore FROM suggestions QUALIFY ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY CASE suggestionLabel WHEN 'PIT_NOW' THEN 4 WHEN 'GOOD_PIT' THEN 3 ELSE 1 END DESC, totalScore DESC, eventTimeMillis DESC) = 1")
uniq = lambda f: f("oof").groupBy("race", "driver", "lapNumber").agg(F.max("target_y").alias("target_y"), F.max("raw_proba").alias("raw_proba"))
q("w24_rolling_agreement", "oof", lambda f: E.rolling_agreement(uniq(f).withColumn("pred", F.when(C("lapNumber") % 7 != 0, (C("raw_proba") >= 0.5).cast("int"))), "race", ["lapNumber", "driver"], 200, 50),
  f""", u AS (SELECT {KEY}, MAX(target_y) AS y, MAX(raw_proba) AS s FROM oof GROUP BY ALL), p AS (SELECT *, CASE WHEN lapNumber % 7 <> 0 THEN CAST(s >= 0.5 AS INT) END AS p FROM u),
  w AS (SELECT race, lapNumber, driver, COUNT(p) OVER w AS n, SUM(CAST(y = p AS INT)) OVER w / COUNT(p) OVER w AS acc, SUM(CASE WHEN p IS NOT NULL THEN y END) OVER w / COUNT(p) OVER w AS ty, SUM(p) OVER w / COUNT(p) OVER w AS tp FROM p WINDOW w AS (PARTITION BY race ORDER BY lapNumber, driver ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))
  SELECT race, lapNumber, driver, n, ROUND(acc, 6) AS accuracy, ROUND((acc - (ty * tp + (1 - ty) * (1 - tp))) / NULLIF(1 - (ty * tp + (1 - ty) * (1 - tp)), 0), 6) AS kappa FROM w WHERE n >= 50""")
PR = ", g AS (SELECT raw_proba AS s, COUNT(*) AS n, SUM(target_y) AS pos FROM oof GROUP BY 1), pr AS (SELECT s, pos, SUM(pos) OVER w AS tp, SUM(n) OVER w AS k, SUM(pos) OVER () AS ap, SUM(n) OVER () AS an FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"
q("w25_pr_curve", "oof", lambda f: E.pr_points(f("oof")).select("threshold", "tp", "fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")), PR + " SELECT s AS threshold, CAST(tp AS BIGINT) AS tp, CAST(k - tp AS BIGINT) AS fp, ROUND(tp / k, 6) AS precision, ROUND(tp / ap, 6) AS recall FROM pr")
q("w25_average_precision", "oof", lambda f: E.average_precision(f("oof")), PR + " SELECT ROUND(SUM(pos / ap * (tp / k)), 6) AS average_precision, COUNT(*) AS points FROM pr")
q("w26_pr_gain", "oof", lambda f: E.pr_gain(E.pr_points(f("oof"))), PR + " SELECT s AS threshold, ROUND((tp / k - ap / an) / ((1 - ap / an) * (tp / k)), 6) AS precision_gain, ROUND((tp / ap - ap / an) / ((1 - ap / an) * (tp / ap)), 6) AS recall_gain FROM pr WHERE tp > 0")
q("w27_decision_curve", "oof", lambda f: E.decision_curve(f("oof"), OOFTH), SWEEP + " SELECT threshold, ROUND(tp / (tp + fp + tn + fn) - fp / (tp + fp + tn + fn) * (threshold / (1 - threshold)), 6) AS net_benefit, ROUND((tp + fn) / (tp + fp + tn + fn) - (1 - (tp + fn) / (tp + fp + tn + fn)) * (threshold / (1 - threshold)), 6) AS treat_all, 0.0 AS treat_none FROM sw")
q("w28_latest_per_key", "suggestions", lambda f: L.latest_per_key(f("suggestions"), ["race", "driver"], ["eventTimeMillis", "suggestionLabel"]).select("race", "driver", "suggestionLabel", "eventTimeMillis"), "SELECT race, driver, suggestionLabel, eventTimeMillis FROM suggestions QUALIFY ROW_NUMBER() OVER (PARTITION BY race, driver ORDER BY eventTimeMillis DESC, suggestionLabel DESC) = 1")
q("w29_gap_to_leader", "laps", lambda f: L.ladder(f("laps")).select(*D.KEY, F.round("gapSum", 6).alias("gapToLeader")), f"SELECT {KEY}, ROUND(COALESCE(SUM(gapToCarAhead) OVER (PARTITION BY race, lapNumber ORDER BY position), 0), 6) AS gapToLeader FROM laps")
q("w31_race_index", "laps", lambda f: f("laps").groupBy("race").agg(F.min("eventTimeMillis").alias("t")).select("race", F.row_number().over(L.Window.orderBy("t", "race")).alias("i")), "SELECT race, ROW_NUMBER() OVER (ORDER BY t, race) AS i FROM (SELECT race, MIN(eventTimeMillis) AS t FROM laps GROUP BY race) x")
q("o1_top_k", "laps", lambda f: f("laps").where("gapToCarAhead is not null").orderBy(C("gapToCarAhead").desc(), *D.KEY).limit(25).select(*D.KEY, "gapToCarAhead"), f"SELECT {KEY}, gapToCarAhead FROM laps WHERE gapToCarAhead IS NOT NULL ORDER BY gapToCarAhead DESC, {KEY} LIMIT 25")
q("o2_seeded_sample", "laps", lambda f: f("laps").orderBy(F.md5(F.concat_ws("|", F.lit("7"), *D.KEY)), *D.KEY).limit(40).select(*D.KEY), f"SELECT {KEY} FROM laps ORDER BY md5('7|' || race || '|' || driver || '|' || lapNumber), {KEY} LIMIT 40")
q("u1_event_union", "laps track_status", lambda f: f("laps").select("race", "eventTimeMillis", "driver", F.lit("lap").alias("topic")).unionByName(f("track_status").select("race", "eventTimeMillis", "status", F.lit("status").alias("topic")), allowMissingColumns=True), "SELECT race, eventTimeMillis, driver, 'lap' AS topic, NULL AS status FROM laps UNION ALL SELECT race, eventTimeMillis, NULL, 'status', status FROM track_status")
q("u2_key_sets", "laps suggestions", lambda f: f("laps").select(*D.KEY).exceptAll(f("suggestions").select(*D.KEY).distinct()).withColumn("set", F.lit("only_laps")).unionByName(f("laps").select(*D.KEY).intersect(f("suggestions").select(*D.KEY)).withColumn("set", F.lit("both"))), f"SELECT {KEY}, CASE WHEN ({KEY}) IN (SELECT ({KEY}) FROM suggestions) THEN 'both' ELSE 'only_laps' END AS set FROM laps")

# State over sequences, audits
q("k4_classify_stop", "laps", lambda f: f("laps").select(*D.KEY, S.classify_stop(C("gapToCarAhead"), F.lag("gapToCarAhead").over(L.race_driver()), F.coalesce("lapTime", F.lit(0.0)), C("position") % 2 == 0, C("trackStatus"), C("compound"), C("tyreLife") > 12).alias("result")),
  f""", x AS (SELECT *, gapToCarAhead AS a, LAG(gapToCarAhead) OVER (PARTITION BY race, driver ORDER BY lapNumber) AS b, COALESCE(lapTime, 0.0) AS bl FROM laps)
  SELECT {KEY}, CASE WHEN compound = 'INTERMEDIATE' THEN 'WEATHER_SURVIVAL_STOP' WHEN a IS NULL THEN 'UNRESOLVED_MISSING_PRE_GAP' WHEN b IS NULL THEN 'UNRESOLVED_MISSING_POST_GAP' WHEN bl <= 0 THEN 'UNRESOLVED_INVALID_BASELINE' WHEN abs(a) > 60 OR abs(b) > 60 OR abs(b - a) > 45 THEN 'UNRESOLVED_MISSING_POST_GAP'
  WHEN abs((b - a) / bl * 100) > 20 THEN 'UNRESOLVED_INCIDENT_FILTER' WHEN trackStatus IN ('4','6','7') AND abs((b - a) / bl * 100) < 1 THEN 'SUCCESS_FREE_STOP' WHEN (b - a) / bl * 100 < -0.5 THEN CASE WHEN position % 2 = 0 THEN 'SUCCESS_UNDERCUT' ELSE 'SUCCESS_OVERCUT' END
  WHEN tyreLife > 12 THEN 'FAILURE_TRAFFIC' WHEN abs((b - a) / bl * 100) <= 0.5 THEN 'SUCCESS_DEFEND' ELSE 'FAILURE_PACE_DEFICIT' END AS result FROM x""")
q("v1_decisions_from_scores", "oof", lambda f: D.decisions_from_scores(f("oof"), 0.8), f"SELECT {KEY}, 'PIT_NOW' AS suggestionLabel, raw_proba * 100 AS totalScore FROM oof WHERE raw_proba >= 0.8")
q("v2_decode_codes", "oof", lambda f: D.decode_codes(f("oof").withColumn("code", F.floor(C("raw_proba") * 10).cast("int")), "code", "target_y", 0.7).groupBy("code", "decoded").agg(F.count("*").alias("n")), ", x AS (SELECT CAST(FLOOR(raw_proba * 10) AS INT) AS code, target_y FROM oof), c AS (SELECT code, target_y, COUNT(*) AS n FROM x GROUP BY ALL) SELECT code, CASE WHEN MAX(n) / SUM(n) >= 0.7 THEN arg_max(target_y, struct_pack(n := n, t := target_y)) END AS decoded, CAST(SUM(n) AS BIGINT) AS n FROM c GROUP BY code")
q("v3_intervals", "suggestions pit_evals", lambda f: (lambda m: m.select("race", E.wilson_interval(C("tp"), C("scored"))[0].alias("low"), E.wilson_interval(C("tp"), C("scored"))[1].alias("high"), E.two_proportion_z(C("tp"), C("scored"), F.lit(70.0), F.lit(100.0)).alias("z")))(D.decision_metrics(matched(f), ["race"]).where("scored > 0")),
  MATCH + f", g AS (SELECT race, {RATES} FROM m GROUP BY race), c AS (SELECT race, tp, scored AS n, tp / scored AS p, 1.959963984540054::DOUBLE AS z FROM g WHERE scored > 0) SELECT race, ROUND((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, ROUND((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high, ROUND((p - 0.7::DOUBLE) / sqrt(((tp + 70) / (n + 100)) * (1 - (tp + 70) / (n + 100)) * (1 / n + 0.01::DOUBLE)), 6) AS z FROM c")
q("v5_ap_bootstrap", "oof", lambda f: E.ap_bootstrap(f("oof").withColumn("other", F.floor(C("raw_proba") * 100) / 100), "other", 20))
q("v6_three_way_table", "suggestions pit_evals", lambda f: D.decision_metrics(matched(f).withColumn("source", F.lit("rule")).unionByName(matched(f).where("lapNumber <= 25").withColumn("source", F.lit("early"))), ["source"]), MATCH + f", s AS (SELECT *, 'rule' AS source FROM m UNION ALL SELECT *, 'early' FROM m WHERE lapNumber <= 25) SELECT source, {RATES} FROM s GROUP BY source")
contract = lambda f: E.rules(matched(f), [("outcome_domain", ~C("outcome").isin("0", "1", "EXCLUDED")), ("distance_in_horizon", ~C("matchedPitLap").between(C("lapNumber"), C("lapNumber") + 2)), ("reason_when_excluded", (C("outcome") == "EXCLUDED") & (C("exclusionReason") == "")), ("late_laps", C("lapNumber") > 45)])
RULES = MATCH + ", ck AS (SELECT 'outcome_domain' AS \"check\", 0 AS value UNION ALL SELECT 'distance_in_horizon', COUNT(*) FILTER (matchedPitLap NOT BETWEEN lapNumber AND lapNumber + 2) FROM m UNION ALL SELECT 'reason_when_excluded', 0 UNION ALL SELECT 'late_laps', COUNT(*) FILTER (lapNumber > 45) FROM m), rt AS (SELECT \"check\", value, CASE WHEN value <= 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ck)"
q("v8_decision_contract", "suggestions pit_evals", contract, RULES + " SELECT * FROM rt")
q("v10_gate", "suggestions pit_evals", lambda f: E.gate(contract(f)), RULES + " SELECT COUNT(*) AS checks, COUNT(*) FILTER (status = 'PASS') AS passed, CASE WHEN bool_or(status = 'FAIL') THEN 'NO_GO' ELSE 'GO' END AS decision FROM rt")
q("v7_split_integrity", "oof", lambda f: E.rules(f("oof"), [("score_in_range", ~C("raw_proba").between(0, 1)), ("binary_target", ~C("target_y").isin(0, 1)), ("year_in_race", S.year_of_race(C("race")).isNull()), ("null_fold", C("fold").isNull())]), "SELECT unnest(['score_in_range', 'binary_target', 'year_in_race', 'null_fold']) AS \"check\", unnest([COUNT(*) FILTER (raw_proba NOT BETWEEN 0 AND 1), COUNT(*) FILTER (target_y NOT IN (0, 1)), COUNT(*) FILTER (NOT regexp_matches(race, '^[0-9]{4} :: ')), COUNT(*) FILTER (fold IS NULL)]) AS value, 'PASS' AS status FROM oof")
q("v12_stream_audit", "laps", lambda f: E.rules(f("laps"), [("negative_gap", C("gapToCarAhead") < 0), ("lap_without_time", C("lapTime").isNull()), ("position_range", ~C("position").between(1, 20))]), "SELECT unnest(['negative_gap', 'lap_without_time', 'position_range']) AS \"check\", unnest([COUNT(*) FILTER (gapToCarAhead < 0), COUNT(*) FILTER (lapTime IS NULL), COUNT(*) FILTER (position NOT BETWEEN 1 AND 20)]) AS value, unnest(['PASS', CASE WHEN COUNT(*) FILTER (lapTime IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END, 'PASS']) AS status FROM laps")

# Stops, splits and feeds
q("k2_pit_cycles", "laps", lambda f: pit_cycles(f("laps")))
q("k3_resolutions", "laps", lambda f: pit_cycles(f("laps")).groupBy("resolution", "result").agg(F.count("*").alias("n")))
q("s6_merge_seasons", "laps suggestions", lambda f: IO.merge_seasons({y: f("suggestions").where(C("race").startswith(str(y))).withColumn("race", S.strip_year_prefix(C("race"))) for y in (2022, 2023, 2024, 2025)}, D.KEY, "eventTimeMillis").select(*D.KEY, "suggestionLabel"),
  f"SELECT {KEY}, suggestionLabel FROM suggestions QUALIFY ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY eventTimeMillis DESC) = 1")
q("s10_alert_feed", "laps pit_evals suggestions", lambda f: IO.alert_feed({"pit_eval": f("pit_evals"), "suggestion": f("suggestions").select("race", "driver", "suggestionLabel")}),
  "SELECT race, driver, pitLapNumber, result, NULL AS suggestionLabel, 'pit_eval' AS kind FROM pit_evals UNION ALL SELECT race, driver, NULL, NULL, suggestionLabel, 'suggestion' FROM suggestions")
q("m1_grouped_folds", "oof", lambda f: M.grouped_folds(f("oof"), "race", 5), "SELECT race, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INT) AS fold FROM (SELECT race, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, race) - 1 AS r FROM oof GROUP BY race) x")
q("m1_rolling_years", "laps", lambda f: M.split_plan(f("laps").withColumn("year", S.year_of_race(C("race"))), "race", "rolling_year", order="year"),
  ", k AS (SELECT race, DENSE_RANK() OVER (ORDER BY substr(race, 1, 4)) - 1 AS i FROM (SELECT DISTINCT race FROM laps) x) SELECT t.i AS fold, k.race, CASE WHEN k.i = t.i THEN 'test' ELSE 'train' END AS role FROM k JOIN (SELECT DISTINCT i FROM k) t ON k.i <= t.i WHERE t.i > 0")
q("m1_leave_one_out", "laps", lambda f: M.split_plan(f("laps"), "race", "leave_one_out"), ", k AS (SELECT race, ROW_NUMBER() OVER (ORDER BY race) - 1 AS i FROM (SELECT DISTINCT race FROM laps) x) SELECT t.i AS fold, k.race, CASE WHEN k.i = t.i THEN 'test' ELSE 'train' END AS role FROM k, k t")
q("m2_leakage", "oof", lambda f: M.leaks(M.split_plan(f("oof"), "race", "grouped"), "race").agg(F.count("*").alias("leaks")), "SELECT 0 AS leaks")
q("w21_calendar_sort", "laps", lambda f: f("laps").select(*D.KEY, S.year_of_race(C("race")).alias("year")).orderBy("year", "race", "lapNumber", "driver"), f"SELECT {KEY}, CAST(substr(race, 1, 4) AS INT) AS year FROM laps")
q("w30_chronological_windows", "laps", lambda f: f("laps").groupBy("race", "lapNumber").agg(F.count("*").alias("n"), F.min("eventTimeMillis").alias("t")).withColumn("i", F.row_number().over(L.Window.partitionBy("race").orderBy("t", "lapNumber")) - 1).withColumn("window", F.floor(C("i") * 4 / F.count("*").over(L.Window.partitionBy("race")))).groupBy("race", "window").agg(F.sum("n").alias("n"), F.min("t").alias("since")),
  ", g AS (SELECT race, lapNumber, COUNT(*) AS n, MIN(eventTimeMillis) AS t FROM laps GROUP BY ALL), i AS (SELECT *, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY race ORDER BY t, lapNumber) - 1) * 4 / COUNT(*) OVER (PARTITION BY race)) AS BIGINT) AS w FROM g) SELECT race, w AS \"window\", CAST(SUM(n) AS BIGINT) AS n, MIN(t) AS since FROM i GROUP BY race, w")
q("f11_pit_losses", "laps", lambda f: f("laps").select("race").distinct().select("race", *(c.alias(n) for c, n in zip(S.pit_losses(F.when(C("race").like("%GP1%"), "Monaco Grand Prix").otherwise(S.strip_year_prefix(C("race")))), ("green", "vsc", "sc"), strict=True))),
  "SELECT DISTINCT race, CASE WHEN race LIKE '%GP1%' THEN 20.0 ELSE 22.0 END AS green, CASE WHEN race LIKE '%GP1%' THEN 12.0 ELSE 14.0 END AS vsc, CASE WHEN race LIKE '%GP1%' THEN 9.5 ELSE 11.0 END AS sc FROM laps")
q("f18_feature_plan", "laps", lambda f: f("laps").select(X.feature_plan(f("laps").columns, ["lapTime"], ["pitLoss", "vscPitLoss", "scPitLoss"], ["eventTimeMillis", "team", "trackTemp", "pitInTime", "pitOutTime", "gapToCarAhead"])),
  "SELECT race, driver, lapNumber, position, stint, tyreLife, compound, lapTime, trackStatus, totalLaps FROM laps")
q("f20_align_schema", "laps", lambda f: X.align_schema(f("laps").select("lapNumber", "lapTime", "position"), ["lapTime", "lapNumber", "unseen"]), "SELECT COALESCE(lapTime, 0.0) AS lapTime, CAST(lapNumber AS DOUBLE) AS lapNumber, 0.0 AS unseen FROM laps")
q("j10_outcome_profile", "laps suggestions pit_evals", lambda f: matched(f).join(f("laps").select(*D.KEY, "compound", "tyreLife"), D.KEY).where("outcome <> 'EXCLUDED'").groupBy("compound", "outcome").agg(F.count("*").alias("n"), F.round(F.avg("tyreLife"), 6).alias("tyre_life")),
  MATCH + f"SELECT compound, outcome, COUNT(*) AS n, ROUND(AVG(tyreLife), 6) AS tyre_life FROM m JOIN laps USING ({KEY}) WHERE outcome <> 'EXCLUDED' GROUP BY 1, 2")
q("j11_error_context", "laps suggestions pit_evals", lambda f: matched(f).where("outcome = '0'").select(*D.KEY).join(f("laps").where("lapTime is not null").select(*D.KEY, "trackStatus"), D.KEY, "left"),
  MATCH + f"SELECT m.race, m.driver, m.lapNumber, l.trackStatus FROM m LEFT JOIN (SELECT * FROM laps WHERE lapTime IS NOT NULL) l USING ({KEY}) WHERE outcome = '0'")
q("v9_feature_parity", "laps", lambda f: X.feature_parity(f("laps"), f("laps").withColumn("lapTime", F.round("lapTime", 1)), D.KEY, ["lapTime", "position"], 0.02),
  "SELECT 'lapTime' AS feature, COUNT(*) AS n, ROUND(COUNT(*) FILTER (lapTime IS NULL OR abs(lapTime - ROUND(lapTime, 1)) <= 0.02) / COUNT(*), 6) AS match_rate FROM laps UNION ALL SELECT 'position', COUNT(*), 1.0 FROM laps")
q("v11_consistency", "suggestions pit_evals", lambda f: X.consistency(D.decision_metrics(matched(f), ["race"]), D.decision_metrics(matched(f), ["race"]).withColumn("precision", F.floor(C("precision") * 100) / 100), ["race"], "precision", 0.003),
  MATCH + f", g AS (SELECT race, {RATES} FROM m GROUP BY race) SELECT race, precision AS computed, FLOOR(precision * 100) / 100 AS published, CASE WHEN abs(precision - FLOOR(precision * 100) / 100) <= 0.003 THEN 'PASS' ELSE 'FAIL' END AS status FROM g")
q("v13_extreme_gaps", "laps pit_evals", lambda f: f("pit_evals").join(f("laps").select("race", "driver", C("lapNumber").alias("pitLapNumber"), "gapToCarAhead"), ["race", "driver", "pitLapNumber"]).groupBy("result").agg(F.count("*").alias("n"), D.count_if(C("gapToCarAhead").isNull()).alias("null_gap"), F.round(F.max("gapToCarAhead"), 3).alias("max_gap")),
  "SELECT result, COUNT(*) AS n, COUNT(*) FILTER (gapToCarAhead IS NULL) AS null_gap, ROUND(MAX(gapToCarAhead), 3) AS max_gap FROM pit_evals e JOIN laps l ON e.race = l.race AND e.driver = l.driver AND e.pitLapNumber = l.lapNumber GROUP BY 1")
q("v14_review_sheet", "suggestions pit_evals", lambda f: matched(f).where("outcome <> '1'").select(*D.KEY, F.when(C("outcome") == "0", "scored_fp").otherwise("excluded").alias("origin"), S.near_miss_bucket(C("nextPitLap") - C("lapNumber")).alias("subtype")).orderBy(F.md5(F.concat_ws("|", *D.KEY)), *D.KEY).limit(30),
  MATCH + f"SELECT {KEY}, CASE WHEN outcome = '0' THEN 'scored_fp' ELSE 'excluded' END AS origin, CASE WHEN nextPitLap IS NULL THEN 'no_future' WHEN nextPitLap - lapNumber <= 2 THEN 'unexpected_within_horizon' WHEN nextPitLap - lapNumber <= 5 THEN 'near_miss_3_5' ELSE 'far_miss_6_plus' END AS subtype FROM m WHERE outcome <> '1' ORDER BY md5(race || '|' || driver || '|' || lapNumber), {KEY} LIMIT 30")

# Selection on scores, export and SQL names
q("a9_quantile_bins", "oof", lambda f: E.quantile_bins(f("oof"), 5),
  ", e AS (SELECT list_sort(list_distinct(list_concat([0.0::DOUBLE], quantile_cont(raw_proba, [0.2, 0.4, 0.6, 0.8]), [1.0::DOUBLE]))) AS e FROM oof), b AS (SELECT CAST(LEAST(len([x FOR x IN e.e IF x <= raw_proba]), len(e.e) - 1) AS INT) - 1 AS bin, e.e AS edges, raw_proba, target_y FROM oof, e) SELECT bin, ROUND(edges[bin + 1], 6) AS lo, ROUND(edges[bin + 2], 6) AS hi, COUNT(*) AS n, ROUND(AVG(raw_proba), 6) AS confidence, ROUND(AVG(target_y), 6) AS frequency FROM b GROUP BY ALL")
q("a4_top_nulls", "laps", lambda f: E.top_nulls(f("laps").select("lapTime", "gapToCarAhead", "pitInTime", "pitOutTime"), 3),
  "SELECT * FROM (SELECT unnest(['lapTime', 'gapToCarAhead', 'pitInTime', 'pitOutTime']) AS \"column\", unnest([ROUND(100.0 * AVG(CAST(lapTime IS NULL AS INT)), 3), ROUND(100.0 * AVG(CAST(gapToCarAhead IS NULL AS INT)), 3), ROUND(100.0 * AVG(CAST(pitInTime IS NULL AS INT)), 3), ROUND(100.0 * AVG(CAST(pitOutTime IS NULL AS INT)), 3)]) AS null_pct FROM laps) x ORDER BY null_pct DESC, \"column\" LIMIT 3")
q("a4_duplicate_rows", "laps", lambda f: E.duplicate_rows(f("laps").select("race", "lapNumber", "compound")), "SELECT CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT COUNT(*) AS n FROM laps GROUP BY race, lapNumber, compound) x")
q("a16_latency_components", "timings", lambda f: E.latency_summary(f("timings"), ["feature_ms", "total_ms"], "total_ms", 50, ["year"]),
  ", x AS (SELECT year, status = 'ok' AS ok, unnest(['feature_ms', 'total_ms']) AS component, CASE WHEN status = 'ok' THEN unnest([CAST(feature_ms AS DOUBLE), CAST(total_ms AS DOUBLE)]) END AS v, CASE WHEN status = 'ok' THEN CAST(total_ms AS DOUBLE) END AS t FROM timings WHERE event_index > 50) SELECT year, component, COUNT(v) AS n, ROUND(quantile_cont(v, 0.5), 3) AS p50, ROUND(quantile_cont(v, 0.95), 3) AS p95, ROUND(quantile_cont(v, 0.99), 3) AS p99, ROUND(AVG(v), 3) AS mean, ROUND(MAX(v), 3) AS max, ROUND(COUNT(*) FILTER (ok) / COUNT(*), 6) AS availability, ROUND(SUM(v) / SUM(t), 6) AS share FROM x GROUP BY year, component")
q("m5_locked_threshold", "oof", lambda f: E.locked_threshold(f("oof").where("fold = 5"), f("oof").where("fold <> 5"), OOFTH, 0.5),
  SWEEP.replace("FROM oof,", "FROM (SELECT * FROM oof WHERE fold = 5) c,") + f", b AS (SELECT threshold FROM sw WHERE precision >= 0.5 ORDER BY f1 DESC, precision DESC, threshold DESC LIMIT 1) SELECT {BR} FROM (SELECT b.threshold, {CONF.format(t='b.threshold')} FROM oof, b WHERE fold <> 5 GROUP BY b.threshold) x")
BEST = "arg_max(threshold, struct_pack(a := f1, b := precision, c := threshold))"
q("m6_fold_metrics", "oof", lambda f: E.fold_metrics(f("oof"), OOFTH, 0.5, ["fold"]),
  f""", g AS (SELECT fold, raw_proba, COUNT(*) AS n, SUM(target_y) AS pos FROM oof GROUP BY 1, 2), p AS (SELECT *, SUM(pos) OVER w / SUM(n) OVER w AS pr FROM g WINDOW w AS (PARTITION BY fold ORDER BY raw_proba DESC ROWS UNBOUNDED PRECEDING)),
  a AS (SELECT fold, ROUND(SUM(pos * pr) / SUM(pos), 6) AS average_precision, ROUND(SUM(pos) / SUM(n), 6) AS prevalence, ROUND(SUM(pos * pr) / SUM(pos) / (SUM(pos) / SUM(n)), 6) AS lift, ROUND(SUM(pos * (1 - raw_proba) * (1 - raw_proba) + (n - pos) * raw_proba * raw_proba) / SUM(n), 6) AS brier FROM p GROUP BY fold),
  s AS (SELECT {BR} FROM (SELECT fold, threshold, {CONF.format(t='threshold')} FROM oof, {TH} t GROUP BY fold, threshold) x), u AS (SELECT fold, {BEST} AS threshold_free, MAX(f1) AS f1_free FROM s GROUP BY fold), c AS (SELECT fold, {BEST} AS threshold_floor, MAX(f1) AS f1_floor FROM s WHERE precision >= 0.5 GROUP BY fold),
  f AS (SELECT fold, f1 AS f1_baseline FROM s WHERE threshold = 0.5) SELECT * FROM a JOIN u USING (fold) LEFT JOIN c USING (fold) JOIN f USING (fold)""")


def _named(f):
    laps = f("laps")
    register_sql(laps.sparkSession)
    return laps.sparkSession.sql("SELECT race, driver, lapNumber, canonical_status(concat(trackStatus, '2')) AS code, is_caution(trackStatus) AS caution, year_of_race(race) AS year, compound_max_stint(compound) AS stint, next_compound(compound) AS following FROM {laps}", laps=laps)


q("x1_sql_functions", "laps", _named,
  f"SELECT {KEY}, CASE WHEN s LIKE '%5%' THEN '5' WHEN s LIKE '%4%' THEN '4' WHEN s LIKE '%7%' THEN '7' WHEN s LIKE '%6%' THEN '6' WHEN s LIKE '%2%' THEN '2' ELSE '1' END AS code, COALESCE(trackStatus IN ('4', '6', '7'), FALSE) AS caution, CAST(substr(race, 1, 4) AS INT) AS year, {MAXSTINT} AS stint, CASE upper(compound) WHEN 'MEDIUM' THEN 'HARD' ELSE 'MEDIUM' END AS following FROM (SELECT *, trackStatus || '2' AS s FROM laps) x")
