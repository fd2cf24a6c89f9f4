"""Domain tables derived from the supplied tables; the same SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, str] = {}


SQL["laps"] = """
WITH base AS (
  SELECT event_id, value, user_id,
         CAST(FLOOR(event_id / 1000.0) AS BIGINT) AS race_no,
         CAST(event_id % 20 AS BIGINT) AS drv,
         CAST(FLOOR((event_id % 1000) / 20.0) AS BIGINT) + 1 AS lap
  FROM events),
timed AS (
  SELECT race_no, drv, lap, event_id, user_id,
         80000 + drv * 40 + CAST(FLOOR(LEAST(value, 60.0) * 50) AS BIGINT)
           + CASE WHEN (lap + drv * 3) % 17 = 0 THEN 22000 ELSE 0 END AS ms,
         CASE WHEN (lap + drv * 3) % 17 = 0 THEN 1 ELSE 0 END AS pit_in,
         CASE WHEN (lap - 1 + drv * 3) % 17 = 0 AND lap > 1 THEN 1 ELSE 0 END AS pit_out
  FROM base),
cum AS (
  SELECT *, CAST(SUM(ms) OVER (PARTITION BY race_no, drv ORDER BY lap ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_ms,
         1 + CAST(SUM(pit_out) OVER (PARTITION BY race_no, drv ORDER BY lap ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stint
  FROM timed),
pos AS (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY race_no, lap ORDER BY cum_ms, drv) AS INT) AS position,
         cum_ms - LAG(cum_ms) OVER (PARTITION BY race_no, lap ORDER BY cum_ms, drv) AS gap_ms,
         ROW_NUMBER() OVER (PARTITION BY race_no, drv, stint ORDER BY lap) AS tyre
  FROM cum)
SELECT CAST(2022 + race_no % 4 AS STRING) || ' :: GP' || CAST(race_no AS STRING) AS race,
       'D' || CAST(drv AS STRING) AS driver, CAST(lap AS INT) AS lapNumber, position, CAST(stint AS INT) AS stint,
       CAST(tyre AS INT) AS tyreLife,
       CASE WHEN race_no % 7 = 6 THEN 'INTERMEDIATE' WHEN (stint + drv) % 3 = 0 THEN 'SOFT' WHEN (stint + drv) % 3 = 1 THEN 'MEDIUM' ELSE 'HARD' END AS compound,
       CASE WHEN user_id % 29 = 0 THEN NULL ELSE CAST(ms AS DOUBLE) / 1000 END AS lapTime,
       CAST(gap_ms AS DOUBLE) / 1000 AS gapToCarAhead,
       CASE WHEN pit_in = 1 THEN CAST(cum_ms AS DOUBLE) / 1000 END AS pitInTime,
       CASE WHEN pit_out = 1 THEN CAST(cum_ms - ms AS DOUBLE) / 1000 END AS pitOutTime,
       CASE WHEN (lap + race_no) % 23 IN (0, 1) THEN '4' WHEN (lap + race_no) % 23 = 5 THEN '6' WHEN (lap + race_no) % 23 = 11 THEN '2' ELSE '1' END AS trackStatus,
       'T' || CAST(CAST(FLOOR(drv / 2.0) AS BIGINT) AS STRING) AS team,
       30.0E0 + (lap % 15) AS trackTemp,
       22.0E0 AS pitLoss, 14.0E0 AS vscPitLoss, 11.0E0 AS scPitLoss, 50 AS totalLaps,
       CAST(1704067200000 + race_no * 86400000 + (cum_ms - ms) AS BIGINT) AS eventTimeMillis
FROM pos
"""


SQL["telemetry"] = """
WITH b AS (SELECT event_id, value, CAST(FLOOR(event_id / 250.0) AS BIGINT) AS g, event_id % 250 AS i FROM events),
p AS (SELECT *, (i + g) % 20 AS ph FROM b)
SELECT '2024 :: GP' || CAST(CAST(FLOOR(g / 4.0) AS BIGINT) AS STRING) AS race, 'D' || CAST(g % 4 AS STRING) AS driver,
       CAST(1704067200000 + i * 250 AS BIGINT) AS eventTimeMillis, CAST(5 + FLOOR(i / 50.0) AS INT) AS lapNumber,
       CASE WHEN g % 3 = 2 AND i >= 200 THEN '4' ELSE '1' END AS trackStatus,
       CAST(CASE WHEN ph < 10 THEN 240 + FLOOR(LEAST(value, 60.0)) ELSE 220 END AS INT) AS speed,
       CASE WHEN ph < 10 THEN 100 WHEN ph < 17 THEN 0 ELSE 50 END AS throttle,
       CASE WHEN ph >= 15 AND ph < 17 THEN 1 ELSE 0 END AS brake,
       CASE WHEN ph < 10 THEN 8 ELSE 5 END AS nGear
FROM p
"""


SQL["track_status"] = """
SELECT race, eventTimeMillis, trackStatus AS status
FROM (SELECT *, LAG(trackStatus) OVER (PARTITION BY race ORDER BY lapNumber) AS prev FROM laps WHERE driver = 'D0') c
WHERE prev IS NULL OR prev <> trackStatus
"""


SQL["pit_evals"] = """
SELECT race, driver, lapNumber AS pitLapNumber,
       CASE (lapNumber * 7 + position) % 8
         WHEN 0 THEN 'SUCCESS_UNDERCUT' WHEN 1 THEN 'SUCCESS_OVERCUT' WHEN 2 THEN 'SUCCESS_DEFEND' WHEN 3 THEN 'OFFSET_ADVANTAGE'
         WHEN 4 THEN 'FAILURE_PACE_DEFICIT' WHEN 5 THEN 'FAILURE_TRAFFIC' WHEN 6 THEN 'UNRESOLVED_INCIDENT_FILTER'
         ELSE 'WEATHER_SURVIVAL_STOP' END AS result
FROM laps WHERE pitInTime IS NOT NULL
"""


SQL["suggestions"] = """
SELECT race, driver, lapNumber,
       CASE WHEN tyreLife >= 14 THEN 'PIT_NOW' WHEN tyreLife >= 11 THEN 'GOOD_PIT' ELSE 'MONITOR' END AS suggestionLabel,
       CAST(tyreLife * 5 + position % 5 AS DOUBLE) AS totalScore, eventTimeMillis
FROM laps WHERE tyreLife >= 8 AND (lapNumber * 31 + position * 7) % 5 < 3
UNION ALL
SELECT race, driver, lapNumber, 'MONITOR', CAST(tyreLife AS DOUBLE), eventTimeMillis - 1
FROM laps WHERE tyreLife >= 8 AND position % 6 = 0
"""


SQL["oof"] = """
SELECT CAST(2022 + l_suppkey % 4 AS STRING) || ' :: GP' || CAST(l_suppkey AS STRING) AS race,
       'D' || CAST(l_linenumber AS STRING) AS driver, l_orderkey AS lapNumber, CAST(1 + l_suppkey % 5 AS INT) AS fold,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target_y,
       CAST((l_partkey * 37 + l_orderkey) % 700 + CASE WHEN l_returnflag = 'R' THEN 300 ELSE 0 END AS DOUBLE) / 1000 AS raw_proba
FROM lineitem
"""


SQL["timings"] = """
SELECT l_orderkey AS event_index, CAST(2022 + l_suppkey % 4 AS INT) AS year,
       CASE WHEN l_linenumber = 7 AND l_partkey % 11 = 0 THEN 'error' ELSE 'ok' END AS status,
       l_quantity AS feature_ms, l_extendedprice / 1000 AS total_ms
FROM lineitem
"""


SQL["evaluated"] = """
SELECT e.race, e.driver, e.pitLapNumber, e.result, l.compound, l.status AS trackStatusAtPit, l.pre AS prePitGapAhead, l.post AS postPitGapToRival, l.base AS baselineLapTime,
       (l.post - l.pre) / l.base * 100 AS gapDeltaPct, l.rival AS rivalAhead, l.pos % 4 = 0 AS offsetStrategy,
       CASE WHEN l.post IS NULL THEN 'SAFETY_TIMEOUT' WHEN (l.lap + l.pos) % 3 = 0 THEN 'RIVAL_PIT' ELSE 'SETTLED' END AS resolvedVia
FROM (SELECT * FROM pit_evals) e JOIN (
  SELECT race, driver, lapNumber AS lap, position AS pos, compound, NULLIF(trackStatus, '2') AS status, gapToCarAhead AS pre,
         LEAD(gapToCarAhead, 3) OVER (PARTITION BY race, driver ORDER BY lapNumber) AS post, LAG(lapTime) OVER (PARTITION BY race, driver ORDER BY lapNumber) AS base,
         LAG(driver) OVER (PARTITION BY race, lapNumber ORDER BY position) AS rival
  FROM laps) l ON l.race = e.race AND l.driver = e.driver AND l.lap = e.pitLapNumber
"""


#: What each fixture reads besides the supplied tables.
NEEDS = {"track_status": ["laps"], "pit_evals": ["laps"], "suggestions": ["laps"], "evaluated": ["laps", "pit_evals"]}


def with_clause(*names: str) -> str:
    """``WITH`` for the named fixtures and what they need."""
    order: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order)


def fixture(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """The named table, from the supplied ones and those of ``given`` (others that it needs, by name)."""
    given = given or {}
    if name in given:
        return given[name]
    inputs = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "lineitem") if f"FROM {t}" in SQL[name]}
    inputs |= {n: fixture(spark, sf_dir, n, given) for n in NEEDS.get(name, [])}
    text = SQL[name]
    for t in inputs:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **inputs)
