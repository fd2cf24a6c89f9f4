"""Pace of cars against plain Python, with missing laps, unclean laps and a car without any pace."""

import random

import pytest

from lapstream.operators import pace as W

SCHEMA = "race string, driver string, lapNumber int, position int, lapTime double, pitInTime double, pitOutTime double, trackStatus string"


@pytest.fixture(scope="module")
def laps():
    rng = random.Random(11)
    out = []
    for driver in "ABCD":
        for lap in range(1, 31):
            if rng.random() < 0.25 and driver != "A" or driver == "D" and lap > 2:
                continue
            out.append(("R", driver, lap, 1 + "ABCD".index(driver) if rng.random() < 0.8 else 9, rng.choice([None, 0.0] + [80 + rng.random() * 5] * 6), 1.0 if rng.random() < 0.2 else None, None, rng.choice(["1", "1", "1", "4", None])))
    return out


def clean(r):
    return (r[4] or 0) > 0 and r[5] is None and r[6] is None and r[7] in ("1", None)


def mean(values):
    return sum(values) / len(values) if values else None


def test_relative_pace(spark, laps):
    def local(driver, lap):
        own = [r[4] for r in laps if r[1] == driver and lap - 3 <= r[2] <= lap and clean(r)]
        return mean(own) if len(own) >= 2 else None

    pairs = [("R", a, b, lap) for a in "ABCD" for b in "ABCD" if a < b for lap in range(1, 31)]
    df = spark.createDataFrame(laps, SCHEMA)
    got = {(r["driver"], r["rival"], r["lapNumber"]): (r["anchor"], r["paceGap"]) for r in W.relative_pace_gap(df, spark.createDataFrame(pairs + pairs[:3], "race string, driver string, rival string, lapNumber int")).collect()}
    assert len(got) == len(pairs)
    for _, a, b, lap in pairs:
        want = (None, None)
        for step in (0, -1, 1, -2, 2, -3, 3):
            x, y = local(a, lap + step), local(b, lap + step)
            if lap + step > 0 and x is not None and y is not None:
                want = (lap + step, x - y)
                break
        assert got[a, b, lap][0] == want[0]
        assert got[a, b, lap][1] == (None if want[1] is None else pytest.approx(want[1], abs=1e-9))
    assert any(v[0] is None for v in got.values()) and any(v[0] not in (None, k[2]) for k, v in got.items())


def test_leader_pace(spark, laps):
    got = {(r["driver"], r["lapNumber"]): r for r in W.leader_pace_gap(spark.createDataFrame(laps, SCHEMA)).collect()}
    assert len(got) == len(laps)
    for r in laps:
        upto = lambda lap: mean([x[4] for x in laps if x[1] == r[1] and x[2] <= lap and clean(x)][-3:])
        led = next((x[4] for back in range(3) for x in laps if x[2] == r[2] - back and x[3] == 1 and clean(x)), None)
        pace, reference = upto(r[2]), led if led is not None else upto(r[2] - 1)
        row = got[r[1], r[2]]
        assert row["pace"] == (None if pace is None else pytest.approx(pace, abs=1e-9))
        assert row["reference"] == (None if reference is None else pytest.approx(reference, abs=1e-9))
        assert (row["paceGap"] is None) == (pace is None or reference is None)


def test_no_laps(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert W.leader_pace_gap(none).count() == 0
    assert W.relative_pace_gap(none, spark.createDataFrame([("R", "A", "B", 3)], "race string, driver string, rival string, lapNumber int")).first()["paceGap"] is None


def test_relative_pace_deals_pairs_once(spark):
    laps = spark.createDataFrame([("R", "A", 1, 80.0, None, None, "1")], "race string, driver string, lapNumber int, lapTime double, pitInTime double, pitOutTime double, trackStatus string")
    pairs = spark.createDataFrame([("R", "A", "B", 3)], "race string, driver string, rival string, lapNumber int")
    plan = W.relative_pace_gap(laps, pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # pairs are not multiplied by the laps searched and brought back by a third join
