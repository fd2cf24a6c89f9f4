"""Scenarios for the scoring gates, stop labels, matching and causal features."""

from pyspark.sql import functions as F

from lapstream.functions import scalars as S
from lapstream.operators import decisions as D
from lapstream.operators import evaluation as E
from lapstream.operators import laps as L
from lapstream.operators import ml as M
from lapstream.plans.fixtures import fixture
from conftest import DATA


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def label(spark, **v):
    base = dict(score=85.0, pace=0.0, urgency=0.0, boosted_urgency=0.0, traffic=10.0, status=0.0, penalty=0.0, rival=0.0, timing=0.0, pace_delta=0.0) | v
    return one(spark, S.decision_label(**{k: F.lit(x) for k, x in base.items()}))


def test_gates(spark):
    assert label(spark) == "MONITOR"  # too early without urgency
    assert label(spark, rival=10.0) == "PIT_NOW"
    assert label(spark, status=60.0) == "PIT_NOW"
    assert label(spark, rival=10.0, traffic=-5.0) == "MONITOR"
    assert label(spark, rival=10.0, traffic=-5.0, urgency=29.0) == "PIT_NOW"
    assert label(spark, score=55.0, pace=9.0, boosted_urgency=13.0, timing=4.0) == "GOOD_PIT"


def test_times(spark):
    for text, ms in [("2024-01-01T00:00:00Z", 1704067200000), ("2024-01-01T00:00:00.250", 1704067200250), (None, 0), ("", 0), ("nonsense", 0)]:
        assert one(spark, S.parse_event_time(F.lit(text).cast("string"))) == ms


def test_stop_labels(spark):
    def of(pre, post, **v):
        a = dict(baseline=82.0, first=True, status="1", compound="HARD", traffic=False) | v
        return one(spark, S.classify_stop(F.lit(pre).cast("double"), F.lit(post).cast("double"), *(F.lit(x) for x in a.values())))

    assert of(2.5, -1.0) == "SUCCESS_UNDERCUT"
    assert of(2.5, -1.0, first=False) == "SUCCESS_OVERCUT"
    assert of(2.5, 2.6) == "SUCCESS_DEFEND"
    assert of(2.5, 2.6, status="4") == "SUCCESS_FREE_STOP"
    assert of(2.5, 6.0) == "FAILURE_PACE_DEFICIT"
    assert of(2.5, 6.0, traffic=True) == "FAILURE_TRAFFIC"
    assert of(None, 6.0) == "UNRESOLVED_MISSING_PRE_GAP"
    assert of(2.5, 30.0) == "UNRESOLVED_INCIDENT_FILTER"
    assert of(2.5, 2.5, compound="wet") == "WEATHER_SURVIVAL_STOP"


def test_one_stop_serves_one_decision(spark):
    d = spark.createDataFrame([("r", "a", k) for k in (5, 6, 7)], "race string, driver string, lapNumber int")
    e = spark.createDataFrame([("r", "a", 7, "SUCCESS_DEFEND")], "race string, driver string, pitLapNumber int, result string")
    got = {r["lapNumber"]: (r["matchedPitLap"], r["pitInWindow"]) for r in D.match_decisions(d, e).collect()}
    assert got == {5: (7, True), 6: (None, True), 7: (None, True)}


def test_future_does_not_alter_the_past(spark):
    laps = fixture(spark, DATA, "laps")
    cut = laps.where("lapNumber <= 20")
    for f in (lambda x: L.expanding_z(x, "trackTemp", "v"), lambda x: L.driver_prev_mean_ratio(x).withColumnRenamed("driverPrevMeanRatio", "v"), lambda x: L.bucket_prev_ratio(x, ["race", "team"], "v"), lambda x: L.lag2_trend(x, "lapTime", "v")):
        a = {(r["race"], r["driver"], r["lapNumber"]): r["v"] for r in f(laps).where("lapNumber <= 20").collect()}
        b = {(r["race"], r["driver"], r["lapNumber"]): r["v"] for r in f(cut).collect()}
        assert a == b


def test_frontier_counts_fall(spark):
    scores = fixture(spark, DATA, "suggestions").groupBy(*D.KEY).agg(F.max("totalScore").alias("totalScore"))
    rows = D.threshold_frontier(scores, fixture(spark, DATA, "pit_evals"), [40.0, 60.0, 80.0]).orderBy("threshold").collect()
    assert [r["actionable"] for r in rows] == sorted((r["actionable"] for r in rows), reverse=True)


def test_statistics():
    assert abs(E.normal_tail(1.959963984540054) - 0.05) < 1e-9
    assert E.mcnemar_exact(0, 0) == 1.0
    assert abs(E.mcnemar_exact(1, 5) - 0.21875) < 1e-12


def test_training(spark):
    rows = spark.range(400).select(F.concat(F.lit("r"), (F.col("id") % 10).cast("string")).alias("race"), (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    plan = M.split_plan(rows, "race", "grouped", folds=2)
    assert M.leaks(plan, "race").isEmpty()
    out = M.train_oof(rows, plan, "race", ["x"], ["c"], "y")
    assert out.count() == 400
    assert out.where((F.col("calibrated") > 0.5).cast("int") == F.col("y")).count() == 400


def test_calibration_surrogates_and_export(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 / 7.0).alias("raw_proba"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    assert M.calibrator(rows, "y", least=10)[1] == "isotonic" and M.calibrator(rows, "y", least=1000)[1] == "sigmoid"
    sweep = M.surrogate_sweep(rows, rows, ["x"], "y", delta=0.5).collect()
    assert [r["candidate"] for r in sweep if r["chosen"]] == ["logistic"] and all(r["f1"] > 0.9 for r in sweep)
    M.export_matrix(rows, str(tmp_path / "out"), "y")
    assert spark.read.parquet(str(tmp_path / "out" / "matrix")).count() == 300
    assert [r["role"] for r in spark.read.parquet(str(tmp_path / "out" / "manifest")).orderBy("place").collect()] == ["feature", "feature", "label"]
