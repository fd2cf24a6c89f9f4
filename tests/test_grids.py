"""Grids and drop zones against plain Python on odd rows; no array of cars is made twice, and stream audits derive laps once."""

import random

import __spark_entry__
from conftest import DATA
from lapstream.operators import laps as L

SCHEMA = "race string, driver string, lapNumber int, position int, tyreLife int, compound string, gapToCarAhead double, pitInTime double, pitLoss double, vscPitLoss double, scPitLoss double, trackStatus string, eventTimeMillis long"


def odd_laps():
    rng, rows = random.Random(5), []
    for race in ("a", "b", "c"):
        for d in range(9):
            t = rng.randrange(30)
            for lap in range(1, 14):
                t += rng.randrange(8, 14) + 60 * (d == 8)  # one car far behind, whose laps are too old for a grid
                gap = None if rng.random() < 0.15 else rng.choice([-0.5, 1.0, 2.5, 4.25])
                rows.append((race, None if rng.random() < 0.05 else f"D{d}", None if rng.random() < 0.04 else lap, d + 1, rng.randrange(5, 20), "SOFT", gap, None, None if rng.random() < 0.1 else 6.0, 4.0, 3.0, rng.choice("146"), None if race == "c" and rng.random() < 0.03 else t))
    rows.append(("c", "D1", 12, 2, 9, "SOFT", 1.0, None, 6.0, 4.0, 3.0, "1", None))
    return rows


def grids(rows):
    """(race, moment) -> lap and latest rows by then, by each driver's next row."""
    out = {}
    for race in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == race]
        key = lambda r: (r[12] is not None, r[12] or 0, r[2] is not None, r[2] or 0)
        until = {}
        for d in {r[1] for r in own}:
            line = sorted((r for r in own if r[1] == d), key=key)
            until |= {id(r): n[12] if n else None for r, n in zip(line, [*line[1:], None])}
        undated, top = [r[2] for r in own if r[12] is None and r[2] is not None], 0
        top = max(undated, default=0)
        for t in sorted({r[12] for r in own if r[12] is not None}):
            highest = max((r[2] for r in own if r[12] == t and r[2] is not None), default=0)
            real = [r for r in own if r[12] == t and r[1] is not None and r[2] == highest]
            if highest > top and highest > 1 and real:
                cars = [r for r in own if r[12] is not None and r[12] <= t and (until[id(r)] is None or until[id(r)] > t) and r[2] is not None and r[2] >= highest - 3]
                out[race, t] = highest, sorted((r[3], r[1] or "", r[2]) for r in cars)
            top = max(top, highest)
    return out


def test_grids(spark):
    rows = odd_laps()
    rng, moments = random.Random(1), 0
    for _ in range(3):
        some = [r for r in rows if rng.random() < 0.9 and (r[12] is not None or rng.random() < 0.5)]
        got = {(r["race"], r["snapMillis"]): (r["snapLap"], sorted((x["position"], x["driver"] or "", x["lapNumber"]) for x in r["cars"])) for r in L.snapshots(L.by_race(spark.createDataFrame(some, SCHEMA))).collect()}
        assert got == grids(some)
        moments += len(got)
    assert moments > 40


def test_car_ahead_after_a_stop(spark):
    rows = [r for r in odd_laps() if None not in (r[1], r[2], r[12])]
    laps = spark.createDataFrame(rows, SCHEMA)
    want = set()
    for g in L.snapshots(L.by_race(laps)).collect():
        cars = g["cars"]
        for i, me in enumerate(cars):
            loss = {"4": me["scPitLoss"], "6": me["vscPitLoss"], "1": me["pitLoss"]}[me["trackStatus"]]
            gap, hit = 0.0, None
            for x in cars[i + 1 :]:
                if x["gapToCarAhead"] is None or loss is None or gap + x["gapToCarAhead"] >= loss:
                    break
                gap, hit = gap + x["gapToCarAhead"], x
            if hit and me["tyreLife"] >= 8:
                want.add((g["race"], me["driver"], g["snapLap"], hit["driver"], round(loss - gap, 3)))
    got = L.drop_zones(laps).select("race", "driver", "snapLap", "carAhead", "gapToCar").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_arrays_are_made_once(spark):
    plan = L.drop_zones(spark.createDataFrame(odd_laps(), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" in plan and not any("lambdafunction" in x for x in plan.split("\n") if x.lstrip(" :+-").startswith("Filter"))


def test_laps_are_derived_once(spark):
    df = __spark_entry__.queries()["v12_stream_profiles"](spark, DATA)
    assert "InMemoryRelation" in df._jdf.queryExecution().withCachedData().toString()
