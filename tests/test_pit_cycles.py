"""Scenarios of stops: two or three cars of one race, each lap 82 seconds, and what becomes of a stop on lap 20."""

import pytest

from lapstream.operators.pit_cycles import pit_cycles

SCHEMA = "race string, driver string, lapNumber int, position int, compound string, tyreLife int, pitInTime double, pitOutTime double, gapToCarAhead double, trackStatus string, totalLaps int, stint int, lapTime double, eventTimeMillis long"


def lap(driver, n, position, gap=None, stint=1, pit=False, compound="MEDIUM", time=82.0, status="1", life=10, total=51, ms=82_000):
    return ("2024 :: Test", driver, n, position, compound, life, 100.0 if pit else None, None, gap, status, total, stint, None if pit else time, n * ms)


def stop_of(spark, rows, driver="VER"):
    got = pit_cycles(spark.createDataFrame(rows, SCHEMA)).where(f"driver = '{driver}'").collect()
    assert len(got) == 1
    return got[0]


def run_up(gap=2.5):
    return [x for n in range(15, 20) for x in (lap("LEC", n, 1, time=81.5), lap("VER", n, 2, gap))]


def undercut(gap=2.5, post=1.0):
    rows = run_up(gap) + [lap("LEC", 20, 1), lap("VER", 20, 2, gap, pit=True)]
    for n in range(21, 25):
        rows += [lap("LEC", n, 1), lap("VER", n, 2, 1.5, stint=2, compound="HARD")]
    rows += [lap("LEC", 25, 1, pit=True), lap("VER", 25, 1 if post else 2, stint=2, compound="HARD")]
    return rows + [x for n in range(26, 30) for x in (lap("VER", n, 1, stint=2, compound="HARD"), lap("LEC", n, 2, post, stint=2, compound="HARD"))]


def test_undercut(spark):
    r = stop_of(spark, undercut())
    assert (r["result"], r["resolution"], r["rival"], r["rivalPitLap"], r["compareLap"]) == ("SUCCESS_UNDERCUT", "RIVAL_PIT", "LEC", 25, 29)
    assert r["pittedFirst"] and not r["offsetStrategy"]
    assert (r["preGap"], r["postGap"]) == (2.5, -1.0) and r["gapDeltaPct"] == pytest.approx(-3.5 / 81.5 * 100, abs=0.2)


def test_rival_stopped_shortly_before(spark):
    rows = [lap("LEC", n, 1, pit=n == 16, stint=1 if n <= 16 else 2) for n in range(12, 30)] + [lap("VER", n, 2, 2.5 if n <= 20 else 6.0, pit=n == 20, stint=1 if n <= 20 else 2) for n in range(12, 30)]
    r = stop_of(spark, rows)
    assert (r["rivalPitLap"], r["resolution"], r["result"], r["pittedFirst"]) == (16, "RIVAL_PIT", "FAILURE_PACE_DEFICIT", False)


def test_rival_that_stays_out(spark):
    rows = [x for n in range(12, 36) for x in (lap("LEC", n, 1, total=36), lap("VER", n, 2, 2.5 if n <= 20 else 1.0, pit=n == 20, stint=1 if n <= 20 else 2, total=36))]
    r = stop_of(spark, rows)
    assert (r["resolution"], r["result"], r["offsetStrategy"], r["compareLap"]) == ("OFFSET_TIMEOUT", "OFFSET_ADVANTAGE", True, 27)


def test_timer_before_the_offset_lap(spark):
    rows = [x for n in range(12, 51) for x in (lap("LEC", n, 1, total=70), lap("VER", n, 2, 2.5, pit=n == 20, stint=1 if n <= 20 else 2, total=70))]
    r = stop_of(spark, rows)
    assert (r["resolution"], r["result"], r["compareLap"]) == ("SAFETY_TIMER", "SUCCESS_DEFEND", 24)


def test_pace_stands_for_unknown_gaps(spark):
    rows = [lap("LEC", n, 1, pit=n == 23, stint=1 if n <= 23 else 2) for n in range(12, 30)]
    rows += [lap("VER", n, 2, 2.5 if n <= 20 else None, pit=n == 20, stint=1 if n <= 20 else 2, time=82.0 if n <= 20 else 80.0) for n in range(12, 30)]
    r = stop_of(spark, rows)
    assert (r["resolution"], r["result"], r["postGap"]) == ("RIVAL_PIT_PACE_SHIFT", "SUCCESS_UNDERCUT", -2.0)


def test_order_stands_for_unknown_pace(spark):
    rows = [lap("LEC", n, 1 if n <= 23 else 2, None, pit=n == 23, stint=1 if n <= 23 else 2, time=None) for n in range(12, 30)]
    rows += [lap("VER", n, 2 if n <= 23 else 1, 2.5 if n <= 20 else None, pit=n == 20, stint=1 if n <= 20 else 2, time=None) for n in range(12, 30)]
    r = stop_of(spark, rows)
    assert (r["resolution"], r["result"], r["postGap"]) == ("POSITIONAL_FALLBACK", "SUCCESS_UNDERCUT", None)


def test_alone_against_the_leader(spark):
    rows = [lap("LEC", n, 1, time=80.0) for n in range(12, 30)] + [lap("VER", n, 9, None, pit=n == 20, stint=1 if n <= 20 else 2, time=82.0 if n <= 20 else 81.0) for n in range(12, 30)]
    r = stop_of(spark, rows)
    assert (r["resolution"], r["result"], r["rival"]) == ("REFERENCE_FALLBACK", "SUCCESS_DEFEND", None)


def test_unresolved(spark):
    assert stop_of(spark, [lap("VER", n, 2, pit=n == 2) for n in range(1, 9)])["resolution"] == "EARLY_LAP_FILTER"
    r = stop_of(spark, [lap("VER", n, 2, pit=n == 20, time=None) for n in range(15, 30)])
    assert (r["result"], r["resolution"]) == ("UNRESOLVED_MISSING_RIVAL", "INSUFFICIENT_DATA")
    r = stop_of(spark, undercut(post=40.0))
    assert r["result"] == "UNRESOLVED_INCIDENT_FILTER"


def test_caution_laps_do_not_settle(spark):
    rows = undercut() + [x for n in range(30, 34) for x in (lap("VER", n, 1, stint=2), lap("LEC", n, 2, 1.0, stint=2))]
    caution = lambda at: [(*x[:9], "4", *x[10:]) if x[2] in at else x for x in rows]
    assert stop_of(spark, caution((27,)))["compareLap"] == 30
    late = stop_of(spark, caution((27, 28)))  # lap 31 is 902 seconds after the stop
    assert (late["compareLap"], late["resolution"]) == (24, "SAFETY_TIMER")


def test_laps_are_read_twice_and_dealt_without_lines(spark):
    plan = pit_cycles(spark.createDataFrame(undercut(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "driver" in x and "lapNumber" in x]
