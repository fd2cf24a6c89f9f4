"""Races are dealt in as many parts as the session shuffles into, however few bytes they are."""

from lapstream.operators import laps as L


def test_by_race_keeps_its_parts(spark):
    dealt = L.by_race(spark.range(100).selectExpr("cast(id % 20 as string) as race"))
    assert dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_paces_are_settled_before_races_are_dealt(spark):
    laps = spark.createDataFrame([], "race string, driver string, lapNumber int, position int, compound string, tyreLife int, pitInTime double, pitOutTime double, gapToCarAhead double, trackStatus string, totalLaps int, stint int, lapTime double, eventTimeMillis long, pitLoss double, vscPitLoss double, scPitLoss double")
    status = spark.createDataFrame([], "race string, eventTimeMillis long, status string")
    plan = L.pit_scores(laps, status)._jdf.queryExecution().analyzed().toString().split("\n")
    dealt = next(i for i, x in enumerate(plan) if "RepartitionByExpression" in x)
    paces = [i for i, x in enumerate(plan) if "+- Window" in x and "stint#" in x.split("], [")[-2]]
    assert paces and min(paces) > dealt
