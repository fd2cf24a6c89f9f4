"""Registered queries of the audits, the gate, the frontier and the bootstrap, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as A
from ..operators import decisions as D
from ..operators import evaluation as E
from ..operators import features as X
from ..operators import laps as L
from ..operators import parity as V
from ..operators import policies as Y
from ..operators.quantiles import with_quantiles
from .queries import KEY, NEG, ORACLES, POS, QUERIES, C, matched, q, scored

__all__ = ["ORACLES", "QUERIES"]


def matching(rows: str) -> str:
    """CTEs up to ``m``, the decisions of ``rows`` (g, race, driver, lapNumber) matched within each g."""
    return f""", d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY g, race, driver ORDER BY lapNumber) AS rn FROM (SELECT DISTINCT g, {KEY} FROM ({rows}) y) x),
e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY race, driver ORDER BY pitLapNumber) AS pn FROM pit_evals),
w AS (SELECT g, race, driver, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS ptr, CAST(NULL AS INT) AS lapNumber, CAST(NULL AS BIGINT) AS hit FROM (SELECT DISTINCT g, race, driver FROM d) x
 UNION ALL SELECT g, race, driver, rn, COALESCE(hit, ptr), lapNumber, hit FROM (SELECT d.g, d.race, d.driver, d.rn, w.ptr, d.lapNumber,
   (SELECT MIN(pn) FROM e WHERE e.race = d.race AND e.driver = d.driver AND e.pn > w.ptr AND e.pitLapNumber >= d.lapNumber AND e.pitLapNumber <= d.lapNumber + 2) AS hit FROM w JOIN d ON d.g = w.g AND d.race = w.race AND d.driver = w.driver AND d.rn = w.rn + 1) z),
m AS (SELECT w.g, w.race, w.driver, w.lapNumber, e.pitLapNumber AS pit, (SELECT MIN(pitLapNumber) FROM e e2 WHERE e2.race = w.race AND e2.driver = w.driver AND e2.pitLapNumber >= w.lapNumber) - w.lapNumber AS ahead,
  CASE WHEN e.result IS NULL THEN 'EXCLUDED' WHEN e.result IN ({POS}) THEN '1' WHEN e.result IN ({NEG}) THEN '0' ELSE 'EXCLUDED' END AS outcome,
  CASE WHEN e.result IS NULL THEN 'NO_MATCH_WITHIN_HORIZON' WHEN e.result IN ({POS}, {NEG}) THEN '' ELSE e.result END AS reason
  FROM w LEFT JOIN e ON e.race = w.race AND e.driver = w.driver AND e.pn = w.hit WHERE w.rn > 0)"""


# Splits and decisions
SPLITS = ["race_key_prefix_format", "source_year_prefix_consistency", "grouped_kfold_no_race_overlap", "oof_fold_uniqueness_per_race", "oof_row_coverage_vs_dataset", "oof_race_universe_match", "oof_fold_count_match"]
q("v7_split_rules", "oof", lambda f: A.split_integrity(f("oof").withColumn("sourceYear", C("fold") + 2021), f("oof").select(*D.KEY, "fold").distinct(), 5),
  f""", u AS (SELECT DISTINCT {KEY}, fold FROM oof),
  t AS (SELECT (SELECT COUNT(*) FROM oof)::DOUBLE AS n, (SELECT COUNT(*) FROM u) AS m, (SELECT COUNT(*) FROM oof WHERE NOT regexp_matches(race, '^[0-9]{{4}} :: .+$')) AS bad, (SELECT COUNT(*) FROM oof WHERE CAST(substr(race, 1, 4) AS INT) <> fold + 2021) AS wrong,
    (SELECT COUNT(*) FROM (SELECT race FROM u GROUP BY race HAVING COUNT(DISTINCT fold) > 1) x)::DOUBLE AS several, (SELECT COUNT(DISTINCT race) FROM u) AS races, (SELECT COUNT(DISTINCT fold) FROM u)::DOUBLE AS seen),
  r AS (SELECT unnest({SPLITS}) AS "check", unnest([1 - bad / n, ROUND(1 - wrong / n, 6), 1, ROUND(1 - several / races, 6), ROUND(m / n, 6), 1, ROUND(seen / 5, 6)]::DOUBLE[]) AS value FROM t),
  a AS (SELECT * FROM r UNION ALL SELECT 'split_integrity_overall', CASE WHEN MIN(value) = 1 AND MAX(value) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE FROM r)
  SELECT *, CASE WHEN value = 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM a""")


def labelled(f):
    """Matched decisions of two sources, those that call for action and all, with their labels."""
    out = []
    for source, rows in (("acted", f("suggestions").where(C("suggestionLabel").isin(*A.ACTIONABLE))), ("all", f("suggestions"))):
        one = D.dedup_priority(rows)
        out.append(D.match_decisions(one.select(*D.KEY), f("pit_evals")).join(one.select(*D.KEY, "suggestionLabel"), D.KEY).withColumn("source", F.lit(source)))
    return out[0].unionByName(out[1])


q("v8_contract_rules", "suggestions pit_evals", lambda f: A.decision_contract(labelled(f), 2, ["source"]),
  matching(f"SELECT 'acted' AS g, {KEY} FROM suggestions WHERE suggestionLabel IN ('PIT_NOW', 'GOOD_PIT') UNION ALL SELECT 'all', {KEY} FROM suggestions")
  + f""", lb AS (SELECT {KEY}, MAX(CASE suggestionLabel WHEN 'PIT_NOW' THEN 4 WHEN 'GOOD_PIT' THEN 3 ELSE 1 END) AS p FROM suggestions GROUP BY ALL),
  x AS (SELECT m.*, lb.p FROM m JOIN lb USING ({KEY})), tw AS (SELECT g, COUNT(*) FILTER (k > 1) AS twice FROM (SELECT g, race, driver, pit, COUNT(*) AS k FROM x WHERE pit IS NOT NULL GROUP BY ALL) z GROUP BY g),
  y AS (SELECT g, COUNT(*) AS n, COUNT(pit) AS h, COUNT(*) FILTER (outcome <> 'EXCLUDED') AS s, COUNT(*) FILTER (outcome = 'EXCLUDED') AS ex, COUNT(*) FILTER (p < 3) AS label, COUNT(*) FILTER (pit NOT BETWEEN lapNumber AND lapNumber + 2) AS far,
    COUNT(*) FILTER (pit IS NOT NULL AND NOT COALESCE(ahead <= 2, FALSE)) AS win, COUNT(*) FILTER (outcome <> 'EXCLUDED' AND reason <> '') AS re, COUNT(*) FILTER (outcome = 'EXCLUDED' AND NOT (reason IN ('NO_MATCH_WITHIN_HORIZON', 'WEATHER_SURVIVAL_STOP') OR reason LIKE 'UNRESOLVED%')) AS unk FROM x GROUP BY g)
  SELECT g AS source, unnest(['actionable_label_contract', 'outcome_domain', 'match_distance_within_horizon', 'one_to_one_target_consumption', 'matched_rows_window_flag', 'scored_rows_have_empty_exclusion_reason', 'exclusion_reason_domain']) AS "check",
    unnest([label, 0, far, twice, win, re, unk]) AS invalid, unnest([ROUND(1 - label / n, 6), 1, ROUND(1 - far / h, 6), ROUND(1 - twice / h, 6), ROUND(1 - win / h, 6), ROUND(1 - re / s, 6), ROUND(1 - unk / ex, 6)]::DOUBLE[]) AS value,
    unnest([CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END FOR v IN [label, 0, far, twice, win, re, unk]]) AS status FROM y JOIN tw USING (g)""")


compared = lambda f: {source: labelled(f).where(C("source") == source).drop("source") for source in ("acted", "all")}
q("v8_comparator_invariance", "suggestions pit_evals", lambda f: A.comparator_invariance(compared(f)),
  f""", cr AS ({ORACLES['v8_contract_rules']}), ck AS (SELECT source || '_' || "check" AS "check", value, status FROM cr UNION ALL SELECT unnest(['comparator_schema_exact_match', 'fixed_horizon_contract_constant']), 1.0, 'PASS')
  SELECT * FROM ck UNION ALL SELECT 'comparator_invariance_overall', CASE WHEN bool_and(status = 'PASS') AND COUNT(*) = 16 THEN 1.0 ELSE 0.0 END, CASE WHEN bool_and(status = 'PASS') AND COUNT(*) = 16 THEN 'PASS' ELSE 'FAIL' END FROM ck""")
q("v8_comparator_details", "suggestions pit_evals", lambda f: A.comparator_details(compared(f)),
  matching(f"SELECT 'acted' AS g, {KEY} FROM suggestions WHERE suggestionLabel IN ('PIT_NOW', 'GOOD_PIT') UNION ALL SELECT 'all', {KEY} FROM suggestions")
  + """ SELECT g AS section, unnest(['rows_total', 'rows_scored', 'rows_excluded', 'rows_matched', 'max_match_distance', 'min_match_distance']) AS name,
  unnest([COUNT(*), COUNT(*) FILTER (outcome <> 'EXCLUDED'), COUNT(*) FILTER (outcome = 'EXCLUDED'), COUNT(pit), MAX(pit - lapNumber), MIN(pit - lapNumber)]::DOUBLE[]) AS value FROM m GROUP BY g""")


# The frontier of thresholds
STEPS = [10.0, 40.0, 50.0, 60.0, 70.0, 80.0, 95.0]
FRONTIER = matching(f"SELECT t AS g, {KEY} FROM suggestions, (SELECT unnest({STEPS})::DOUBLE AS t) th WHERE totalScore >= t") + f""", ms AS (SELECT g, COUNT(*) AS actionable, COUNT(*) FILTER (outcome <> 'EXCLUDED') AS scored, COUNT(*) FILTER (outcome = 'EXCLUDED') AS excluded, COUNT(*) FILTER (outcome = '1') AS tp, COUNT(*) FILTER (outcome = '0') AS fp,
  COUNT(*) FILTER (pit IS NULL) AS no_match_count, COUNT(*) FILTER (pit IS NULL AND ahead = 3) AS no_match_one_lap_beyond, COUNT(*) FILTER (pit IS NULL AND ahead IN (4, 5)) AS no_match_two_to_three_laps_beyond, COUNT(*) FILTER (pit IS NULL AND ahead >= 6) AS no_match_four_plus_laps_beyond,
  COUNT(*) FILTER (pit IS NULL AND ahead <= 2) AS no_match_pit_in_window_but_consumed, COUNT(*) FILTER (reason = 'UNRESOLVED_INCIDENT_FILTER') AS excluded_incident, COUNT(*) FILTER (reason = 'UNRESOLVED_MISSING_POST_GAP') AS excluded_missing_post_gap, COUNT(*) FILTER (reason = 'WEATHER_SURVIVAL_STOP') AS excluded_weather FROM m GROUP BY g),
fr AS (SELECT th.t AS threshold, COALESCE(COLUMNS(ms.* EXCLUDE (g)), 0) FROM (SELECT unnest({STEPS})::DOUBLE AS t) th LEFT JOIN ms ON ms.g = th.t),
fm AS (SELECT *, ROUND(tp / NULLIF(scored, 0), 6) AS precision, ROUND(COALESCE(scored / NULLIF(actionable, 0), 0), 6) AS scored_rate, ROUND(COALESCE(tp / NULLIF(actionable, 0), 0), 6) AS tp_per_actionable, CASE WHEN scored > 0 AND tp / NULLIF(scored, 0) >= 0.6::DOUBLE THEN 1 ELSE 0 END AS meets_precision_floor,
  ROUND(ROUND(tp / NULLIF(scored, 0), 6) - 0.6::DOUBLE, 6) AS precision_delta_vs_floor, ROUND(scored / 100, 6) AS scored_vs_baseline_ratio, ROUND(COALESCE(no_match_count / NULLIF(excluded, 0), 0), 6) AS no_match_rate FROM fr)"""
matches = lambda f: A.frontier_matches(scored(f), f("pit_evals"), STEPS)
measures = lambda f: A.frontier_measures(matches(f), STEPS, 0.6, 100)
q("a11_frontier_measures", "suggestions pit_evals", measures, FRONTIER + " SELECT * FROM fm")
q("a11_frontier_years", "suggestions pit_evals", lambda f: A.frontier_by_year(matches(f)), FRONTIER + ", y AS (SELECT g AS threshold, CAST(substr(race, 1, 4) AS INT) AS year, COUNT(*) AS actionable, COUNT(*) FILTER (outcome <> 'EXCLUDED') AS scored, COUNT(*) FILTER (outcome = '1') AS tp, COUNT(*) FILTER (outcome = '0') AS fp FROM m GROUP BY 1, 2) SELECT *, ROUND(tp / NULLIF(scored, 0), 6) AS precision, ROUND(scored / actionable, 6) AS scored_rate, ROUND(tp / actionable, 6) AS tp_per_actionable FROM y")
q("a11_frontier_choice", "suggestions pit_evals", lambda f: A.frontier_choice(measures(f)), FRONTIER + " SELECT * FROM fm ORDER BY meets_precision_floor DESC, (scored > 0) DESC, CASE WHEN meets_precision_floor = 1 THEN scored ELSE precision END DESC NULLS LAST, CASE WHEN meets_precision_floor = 1 THEN tp ELSE scored END DESC, CASE WHEN meets_precision_floor = 1 THEN precision ELSE tp END DESC, threshold LIMIT 1")


# The gate over layers
def gate_checks(f):
    """Checks of five layers on the derived tables: B scores against each other, C matching, D precision at a high
    threshold, F parity of two versions of a column, G latency (operational)."""
    low, high = (E.binary_metrics(f("oof"), t).select((C("tp") + C("fp")).alias(f"n{i}"), C("tp").alias(f"k{i}")) for i, t in enumerate((0.3, 0.6)))
    both = low.crossJoin(F.broadcast(high))  # one row each
    ok = C("status") == "ok"
    time = f("timings").agg((D.count_if(ok) / F.count("*")).alias("up"), D.count_if(~ok).alias("down"))
    time = with_quantiles(time, f("timings").where(ok), [], C("total_ms"), {"p95": 0.95})
    free = matched(f).where("outcome = 'EXCLUDED'").agg(F.avg((C("exclusionReason") == "NO_MATCH_WITHIN_HORIZON").cast("double")).alias("v"))
    parity = X.feature_parity(f("laps"), f("laps").withColumn("lapTime", F.round("lapTime", 1)), D.KEY, ["lapTime"], 0.05)
    row = lambda df, layer, check, value, threshold, direction, strict=False, hold=None: df.select(F.lit(layer).alias("layer"), F.lit(check).alias("check"), F.round(value.cast("double"), 6).alias("value"), F.lit(float(threshold)).alias("threshold"), F.lit(direction).alias("direction"), F.lit(strict).alias("strict"), F.lit(hold).cast("double").alias("hold"))
    return A._stack([
        row(both, "B", "precision_delta", C("k1") / C("n1") - C("k0") / C("n0"), 0, "gte", True), row(both, "B", "two_proportion_z", E.two_proportion_z(C("k1"), C("n1"), C("k0"), C("n0")), 1.959964, "gte"),
        row(free, "C", "no_match_rate", C("v"), 0.5, "gte"), row(E.binary_metrics(f("oof"), 0.7), "D", "constrained_precision", C("precision"), 0.6, "gte"),
        row(parity, "F", "parity", C("match_rate"), 0.99, "gte"), row(time, "G", "latency_p95_total_ms", C("p95"), 60, "lte", True, 80.0), row(time, "G", "availability", C("up"), 0.999, "gte", False, 0.98), row(time, "G", "failed_events", C("down"), 0, "lte"),
    ])


GATE = matching(f"SELECT 'a' AS g, {KEY} FROM suggestions WHERE suggestionLabel IN ('PIT_NOW', 'GOOD_PIT')") + f""", pr AS (SELECT COUNT(*) FILTER (raw_proba >= 0.3)::DOUBLE AS n0, COUNT(*) FILTER (raw_proba >= 0.3 AND target_y = 1)::DOUBLE AS k0, COUNT(*) FILTER (raw_proba >= 0.6)::DOUBLE AS n1, COUNT(*) FILTER (raw_proba >= 0.6 AND target_y = 1)::DOUBLE AS k1,
  COUNT(*) FILTER (raw_proba >= 0.7)::DOUBLE AS n2, COUNT(*) FILTER (raw_proba >= 0.7 AND target_y = 1)::DOUBLE AS k2 FROM oof), ti AS (SELECT quantile_cont(total_ms::DOUBLE, 0.95) FILTER (status = 'ok') AS p95, COUNT(*) FILTER (status = 'ok') / COUNT(*) AS up, COUNT(*) FILTER (status <> 'ok') AS down FROM timings),
ck AS (SELECT 'B' AS layer, 'precision_delta' AS "check", k1 / n1 - k0 / n0 AS value, 0.0::DOUBLE AS threshold, 'gte' AS direction, TRUE AS strict, NULL::DOUBLE AS hold FROM pr
 UNION ALL SELECT 'B', 'two_proportion_z', (k1 / n1 - k0 / n0) / sqrt((k1 + k0) / (n1 + n0) * (1 - (k1 + k0) / (n1 + n0)) * (1 / n1 + 1 / n0)), 1.959964, 'gte', FALSE, NULL FROM pr
 UNION ALL SELECT 'C', 'no_match_rate', AVG(CASE WHEN pit IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE), 0.5, 'gte', FALSE, NULL FROM m WHERE outcome = 'EXCLUDED'
 UNION ALL SELECT 'D', 'constrained_precision', k2 / n2, 0.6, 'gte', FALSE, NULL FROM pr
 UNION ALL SELECT 'F', 'parity', COUNT(*) FILTER (lapTime IS NULL OR abs(lapTime - ROUND(lapTime, 1)) <= 0.05) / COUNT(*), 0.99, 'gte', FALSE, NULL FROM laps
 UNION ALL SELECT 'G', 'latency_p95_total_ms', p95, 60, 'lte', TRUE, 80 FROM ti UNION ALL SELECT 'G', 'availability', up, 0.999, 'gte', FALSE, 0.98 FROM ti UNION ALL SELECT 'G', 'failed_events', down, 0, 'lte', FALSE, NULL FROM ti),
cv AS (SELECT layer, "check", ROUND(value, 6) AS value, threshold, direction, strict, hold FROM ck), cs AS (SELECT *, CASE direction WHEN 'gte' THEN value - threshold ELSE threshold - value END AS mg, CASE direction WHEN 'gte' THEN value - hold ELSE hold - value END AS sp FROM cv),
jd AS (SELECT layer, "check", value, threshold, direction, strict, hold, ROUND(mg, 6) AS margin, CASE WHEN (strict AND mg > 0) OR (NOT strict AND mg >= 0) THEN 'PASS' WHEN (strict AND sp > 0) OR (NOT strict AND sp >= 0) THEN 'HOLD' ELSE 'FAIL' END AS status FROM cs),
ly AS (SELECT layer, COUNT(*) AS checks_total, COUNT(*) FILTER (status = 'PASS') AS checks_passed, COUNT(*) FILTER (status = 'HOLD') AS checks_hold, COUNT(*) FILTER (status = 'FAIL') AS checks_failed, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'HOLD') THEN 'HOLD' ELSE 'PASS' END AS status FROM jd GROUP BY layer)"""
NEEDED = "suggestions pit_evals oof timings"
q("v10_gate_checks", NEEDED, lambda f: A.judged(gate_checks(f)), GATE + " SELECT * FROM jd")
q("v10_gate_layers", NEEDED, lambda f: A.layer_status(A.judged(gate_checks(f))), GATE + " SELECT * FROM ly")
q("v10_integrated_gate", NEEDED, lambda f: A.integrated_gate(A.judged(gate_checks(f)), "G"),
  GATE + """, g AS (SELECT COUNT(*) FILTER (layer <> 'G' AND status = 'FAIL') AS failed, COUNT(*) FILTER (layer <> 'G' AND status <> 'PASS') AS open, MAX(status) FILTER (layer = 'G') AS ops, SUM(checks_total)::BIGINT AS checks_total, SUM(checks_passed)::BIGINT AS checks_passed, SUM(checks_hold)::BIGINT AS checks_hold, SUM(checks_failed)::BIGINT AS checks_failed, COALESCE(string_agg(layer, '/' ORDER BY layer) FILTER (layer <> 'G' AND status = 'FAIL'), '') AS failed_layers FROM ly)
  SELECT CASE WHEN failed > 0 THEN 'NO_GO' WHEN open = 0 AND ops = 'PASS' THEN 'GO' WHEN open = 0 AND ops = 'HOLD' THEN 'GO_WITH_CONDITIONS' ELSE 'HOLD' END AS decision, CASE WHEN failed > 0 THEN 'LOW' WHEN open = 0 AND ops = 'PASS' THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, checks_total, checks_passed, checks_hold, checks_failed, failed_layers FROM g""")


# Quality of streams
def profile_sql(stream: str, table: str, key: str, checks: dict[str, str]) -> str:
    names = ["rows", "duplicate_keys", "duplicate_rows", *checks, *(f"{k}_pct" for k in checks)]
    values = ["n", "dk", "dr", *checks, *(f"ROUND(COALESCE({k} * 100.0::DOUBLE / NULLIF(n, 0), 0), 2)" for k in checks)]
    per = ", ".join(f"COUNT(*) FILTER ({v}) AS {k}" for k, v in checks.items())
    sums = ", ".join(f"COALESCE(SUM({k}), 0) AS {k}" for k in checks)
    return f"SELECT '{stream}' AS stream, unnest({names}) AS measure, unnest([{', '.join(values)}]::DOUBLE[]) AS value FROM (SELECT COALESCE(SUM(k), 0) AS n, COUNT(*) FILTER (k > 1) AS dk, COALESCE(SUM(k - 1), 0) AS dr, {sums} FROM (SELECT COUNT(*) AS k, {per} FROM {table} GROUP BY {key}) x) y"


q("v12_stream_profiles", "laps telemetry pit_evals suggestions",
  lambda f: A.stream_audits({"ml_features": f("laps"), "pit_evals": f("pit_evals"), "pit_suggestions": f("suggestions"), "drop_zones": L.drop_zones(f("laps")), "lift_coast": L.lift_coast(f("telemetry")), "tire_drops": L.tire_drops(f("laps"))}),
  f", dz AS ({ORACLES['w13_drop_zones']}), lc AS ({ORACLES['k1_lift_coast']}), td AS ({ORACLES['w11_tire_drops']}) " + " UNION ALL ".join([
      profile_sql("ml_features", "laps", KEY, {"negative_gap": "gapToCarAhead < 0", "null_gap": "gapToCarAhead IS NULL"}),
      profile_sql("pit_evals", "pit_evals", "race, driver, pitLapNumber", {"unresolved": "starts_with(result, 'UNRESOLVED_')", "null_result": "result IS NULL"}),
      profile_sql("pit_suggestions", "suggestions", KEY, {"unlabelled": "suggestionLabel IS NULL", "actionable": "suggestionLabel IN ('PIT_NOW', 'GOOD_PIT')"}),
      profile_sql("drop_zones", "dz", KEY, {"negative_positions_lost": "positionsLost < 0", "negative_gap_to_car": "gapToCar < 0", "positions_lost_mismatch": "emergencePosition - position <> positionsLost", "non_green": "status <> '1'"}),
      profile_sql("lift_coast", "lc", "race, driver, brakeMillis", {"bad_time_order": "NOT (startMillis < liftMillis AND liftMillis < brakeMillis)", "missing_time": "liftMillis IS NULL"}),
      profile_sql("tire_drops", "td", KEY, {"negative_delta": "delta < 0", "very_early": "COALESCE(tyreLife, 0) <= 3", "non_green": "trackStatus <> '1'"}),
  ]), once="laps")

# Difference of two scores, bootstrapped over races
BOOT = """, rc AS (SELECT race, ROW_NUMBER() OVER (ORDER BY race) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT race FROM oof) x),
wt AS (SELECT rep, CAST(FLOOR(CAST('0x' || substr(md5('12345|' || rep || '|' || i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * n) AS BIGINT) AS i, COUNT(*) AS w FROM rc, (SELECT unnest(range(100)) AS rep) r GROUP BY 1, 2),
hs AS (SELECT race, 'a' AS model, raw_proba AS s, COUNT(*) AS n, SUM(target_y) AS pos FROM oof GROUP BY ALL UNION ALL SELECT race, 'b', FLOOR(raw_proba * 100) / 100, COUNT(*), SUM(target_y) FROM oof GROUP BY ALL),
bg AS (SELECT wt.rep, hs.model, hs.s, SUM(hs.n * wt.w) AS n, SUM(hs.pos * wt.w) AS pos FROM hs JOIN rc ON rc.race = hs.race JOIN wt ON wt.i = rc.i GROUP BY ALL),
bp AS (SELECT *, SUM(pos) OVER w / SUM(n) OVER w AS pr FROM bg WINDOW w AS (PARTITION BY rep, model ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
bd AS (SELECT rep, ROUND(SUM(pos * pr) FILTER (model = 'b') / SUM(pos) FILTER (model = 'b') - SUM(pos * pr) FILTER (model = 'a') / SUM(pos) FILTER (model = 'a'), 6) AS delta FROM bp GROUP BY rep)"""
q("v5_ap_interval", "oof", lambda f: E.ap_interval(E.ap_bootstrap(f("oof").withColumn("other", F.floor(C("raw_proba") * 100) / 100), "other", 100)),
  BOOT + " SELECT COUNT(delta) AS reps, ROUND(AVG(delta), 6) AS mean, ROUND(quantile_cont(delta, 0.025), 6) AS low, ROUND(quantile_cont(delta, 0.975), 6) AS high, ROUND(COUNT(*) FILTER (delta > 0) / COUNT(delta), 6) AS above_zero FROM bd")


# Policies by fold
GRID19 = [i / 20 for i in range(1, 20)]
FLOOR, COST = 0.42, 0.5
policies = lambda f: Y.threshold_policies(f("oof"), GRID19, FLOOR, COST, ["fold"])
decided = lambda f: Y.with_policy(f("oof"), policies(f), ["fold"])
CHOSEN = f""", sw AS (SELECT fold, t AS threshold, COUNT(*) FILTER (target_y = 1 AND raw_proba >= t) AS tp, COUNT(*) FILTER (target_y = 0 AND raw_proba >= t) AS fp, COUNT(*) FILTER (target_y = 1 AND raw_proba < t) AS fn FROM oof, (SELECT unnest({GRID19}::DOUBLE[]) AS t) g GROUP BY 1, 2),
rt AS (SELECT *, COALESCE(ROUND(tp / NULLIF(tp + fp, 0), 6), 0) AS precision, COALESCE(ROUND(tp / NULLIF(tp + fn, 0), 6), 0) AS recall, COALESCE(ROUND(2 * tp / NULLIF(2 * tp + fp + fn, 0), 6), 0) AS f1, tp - {COST}::DOUBLE * fp AS utility FROM sw),
rk AS (SELECT *, precision >= {FLOOR} AS met, ROW_NUMBER() OVER (PARTITION BY fold, precision >= {FLOOR} ORDER BY utility DESC, f1 DESC, recall DESC, precision DESC, threshold DESC) AS r1, ROW_NUMBER() OVER (PARTITION BY fold ORDER BY precision DESC, utility DESC, recall DESC, f1 DESC, threshold DESC) AS r2,
  ROW_NUMBER() OVER (PARTITION BY fold ORDER BY f1 DESC, recall DESC, threshold) AS r3, bool_or(precision >= {FLOOR}) OVER (PARTITION BY fold) AS any_met, COUNT(*) FILTER (precision >= {FLOOR}) OVER (PARTITION BY fold) AS reachable, COUNT(*) OVER (PARTITION BY fold) AS candidates FROM rt),
ch AS (SELECT a.fold, b.threshold AS threshold_free, a.threshold, CASE WHEN a.any_met THEN 'constrained_utility' ELSE 'fallback_max_precision' END AS mode, a.precision, ROUND(a.precision - {FLOOR}, 6) AS margin, a.utility, a.reachable, a.candidates
  FROM rk a JOIN rk b ON a.fold = b.fold AND b.r3 = 1 WHERE CASE WHEN a.any_met THEN a.met AND a.r1 = 1 ELSE a.r2 = 1 END),
dc AS (SELECT oof.*, ch.threshold AS ct, ch.mode, CAST(raw_proba >= ch.threshold AS INT) AS hit FROM oof JOIN ch USING (fold))"""
q("a12_fold_policies", "oof", policies, CHOSEN + " SELECT * FROM ch")
q("a12_policy_reference", "oof", lambda f: Y.policy_table(decided(f), [0.1, 0.5]),
  CHOSEN + """, pl AS (SELECT 'constrained_policy' AS policy, target_y, hit FROM dc UNION ALL SELECT 'fixed_threshold_0.10', target_y, CAST(raw_proba >= 0.1 AS INT) FROM dc UNION ALL SELECT 'fixed_threshold_0.50', target_y, CAST(raw_proba >= 0.5 AS INT) FROM dc),
  cf AS (SELECT policy, COUNT(*) FILTER (target_y = 1 AND hit = 1) AS tp, COUNT(*) FILTER (target_y = 0 AND hit = 1) AS fp, COUNT(*) FILTER (target_y = 0 AND hit = 0) AS tn, COUNT(*) FILTER (target_y = 1 AND hit = 0) AS fn FROM pl GROUP BY 1),
  ra AS (SELECT *, ROUND(tp / NULLIF(tp + fp, 0), 6) AS precision, ROUND(tp / NULLIF(tp + fn, 0), 6) AS recall, ROUND(2 * tp / NULLIF(2 * tp + fp + fn, 0), 6) AS f1, ROUND((tp + fp) / (tp + fp + tn + fn), 6) AS positive_rate FROM cf)
  SELECT ra.*, ROUND(o.positive_rate - ra.positive_rate, 6) AS delta_positive_rate, ROUND(o.precision - ra.precision, 6) AS delta_precision, ROUND(o.recall - ra.recall, 6) AS delta_recall FROM ra, (SELECT * FROM ra WHERE policy = 'constrained_policy') o""")
q("a12_policy_summary", "oof", lambda f: Y.policy_summary(decided(f)),
  CHOSEN + """ SELECT COUNT(*) AS rows, ROUND(AVG(ct), 6) AS threshold_mean, MIN(ct) AS threshold_min, MAX(ct) AS threshold_max, ROUND(quantile_cont(ct, 0.1), 6) AS threshold_p10, ROUND(quantile_cont(ct, 0.9), 6) AS threshold_p90,
  COUNT(*) FILTER (mode = 'fallback_max_precision') AS fallback_rows, ROUND(COUNT(*) FILTER (mode = 'fallback_max_precision') / COUNT(*), 6) AS fallback_rate, (SELECT string_agg(mode || ':' || n, ';' ORDER BY mode) FROM (SELECT mode, COUNT(*) AS n FROM dc GROUP BY 1) z) AS modes FROM dc""")


# Parity with recomputation: one trend is right, one has seen two laps ahead; serving is off on every tenth lap
def _served(f):
    w = L.race_driver()
    offline = L.lag2_trend(f("laps"), "lapTime", "paceTrend").withColumn("leakyTrend", F.coalesce(C("lapTime") - F.lead("lapTime", 2).over(w), F.lit(0.0)))
    serving = offline.withColumn("lapTime", F.when(C("lapNumber") % 10 == 0, C("lapTime") + 0.01).otherwise(C("lapTime"))).drop("leakyTrend")
    columns = ["lapTime", "tyreLife", "compound", "paceTrend", "leakyTrend"]
    return V.parity_audit(offline, serving, columns, columns[:4], serving.columns, ["race", "driver", "lapNumber", "lapTime"], {"paceTrend": "lapTime", "leakyTrend": "lapTime"}, columns)


q("v9_parity_audit", "laps", _served,
  f""", o AS (SELECT {KEY}, lapTime, COALESCE(lapTime - LAG(lapTime, 2) OVER w, 0.0::DOUBLE) AS want, COALESCE(lapTime - LEAD(lapTime, 2) OVER w, 0.0::DOUBLE) AS leak, ROW_NUMBER() OVER w AS k FROM laps WINDOW w AS (PARTITION BY race, driver ORDER BY lapNumber)),
  m AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (abs(want - leak) > 1e-6) + COUNT(*) FILTER (k <= 2 AND abs(leak) > 1e-6) AS bad, COUNT(*) FILTER (k <= 2 AND abs(want) > 1e-6) AS early, COUNT(*) FILTER (lapTime IS NOT NULL AND lapNumber % 10 = 0) AS off FROM o),
  c AS (SELECT unnest(['schema_bundle_training_exact', 'schema_live_payload_required_fields', 'schema_serving_transform_feature_coverage', 'point_in_time_paceTrend', 'point_in_time_leakyTrend', 'feature_match_rate::lapTime', 'feature_match_rate::tyreLife', 'feature_match_rate::compound', 'feature_match_rate::paceTrend']) AS "check",
    unnest([0, 1, 0.8, 1 - early / n, 1 - bad / n, 1 - off / n, 1, 1, 1]::DOUBLE[]) AS value, unnest([1, 1, 1, 1, 1, 0.99, 0.99, 0.99, 0.99]::DOUBLE[]) AS least FROM m),
  a AS (SELECT * FROM c UNION ALL SELECT 'feature_parity_overall', AVG(value), 0.99 FROM c WHERE "check" LIKE 'feature_match%')
  SELECT "check", ROUND(value, 6) AS value, CASE WHEN value >= least THEN 'PASS' ELSE 'FAIL' END AS status FROM a""")
