"""Sessions with both outputs, late rows, live scoring with versions, training over a grid, importance by window."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from lapstream.operators import laps as L
from lapstream.operators import ml as M
from lapstream.plans.fixtures import fixture
from lapstream.sources import io as IO
from lapstream.streaming import jobs as J

KEY = ["race", "driver", "lapNumber"]


def drained(df, name, path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(100)
    return df.sparkSession.table(name)


def key_of(df, *columns):
    return sorted(tuple(str(x) for x in r) for r in df.select(*columns).collect())


def test_both_outputs_of_a_session(spark, tmp_path):
    laps = fixture(spark, DATA, "laps").where("lapNumber <= 15").cache()
    path = str(tmp_path / "in")
    laps.coalesce(1).write.json(path)
    end = laps.agg(F.max("eventTimeMillis")).first()[0] + 9 * 3_600_000
    spark.createDataFrame([("end", "x", 1, 1, end), ("end", "x", 2, 1, end + 9 * 3_600_000)], "race string, driver string, lapNumber int, position int, eventTimeMillis long").coalesce(1).write.mode("append").json(path)
    read = lambda: J.session_laps(spark.readStream.schema(IO.SCHEMAS["laps"]).option("maxFilesPerTrigger", 1).json(path), "1 hour")
    trains = drained(J.session_trains(read()), "trains", str(tmp_path / "c1")).where("race <> 'end'")
    assert key_of(trains, "race", "lapNumber", "head", "size", "drivers") == key_of(L.drs_trains(laps), "race", "lapNumber", "head", "size", "drivers") != []
    rows = drained(J.session_features(read()), "features_of", str(tmp_path / "c2")).where("race <> 'end'")
    want = L.rivals(laps).select(*KEY, F.col("gapAhead").alias("a"), F.col("gapBehind").alias("b")).join(laps, KEY)
    assert key_of(rows, *KEY, "position", "gapAhead", "gapBehind", "lapTime", "tyreLife", "team") == key_of(want, *KEY, "position", "a", "b", "lapTime", "tyreLife", "team")
    assert rows.where("hasGapAhead <> (gapAhead is not null)").isEmpty()


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    listener = J.LateRows()
    spark.streams.addListener(listener)
    schema, path = "race string, driver string, lapNumber int, position int, eventTimeMillis long", str(tmp_path / "in")
    full = IO.SCHEMAS["laps"]
    for rows in ([("r", "a", 1, 1, 100_000)], [("r", "a", 2, 1, 300_000)], [("r", "b", 2, 2, 301_000)], [("r", "b", 1, 2, 101_000)], [("r", "a", 3, 1, 900_000)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)
    try:
        sessions = J.session_laps(spark.readStream.schema(full).option("maxFilesPerTrigger", 1).json(path))
        got = drained(sessions, "late", str(tmp_path / "c")).where("lapNumber = 1").select(F.explode("cars.driver").alias("d")).collect()
        for _ in range(50):
            if listener.dropped.get("late"):
                break
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert [r["d"] for r in got] == ["a"] and listener.dropped["late"] == 1


def model_rows(spark, n=400):
    return spark.range(n).select(
        F.concat(F.lit("r"), (F.col("id") % 10).cast("string")).alias("race"), F.col("id").cast("string").alias("driver"), F.lit(1).alias("lapNumber"), (F.col("id") % 7).cast("double").alias("x"),
        (F.pmod(F.xxhash64("id"), F.lit(5))).cast("double").alias("noise"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"), (F.col("id") % 7 > 3).cast("int").alias("y"), F.floor(F.col("id") / (n / 2)).cast("int").alias("part"),
    )


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_live_scoring(spark, tmp_path, method):
    """Aligned with the bundle's columns, calibrated, decided; a restart gives no message twice, a new version is told."""
    rows = model_rows(spark).cache()
    model = M.pipeline(["x", "absent"], ["c"], "y").fit(M.weighted(rows.withColumn("absent", F.lit(0.0)), "y"))
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows.withColumn("absent", F.lit(0.0)).withColumn("w", F.lit(1.0))).withColumn("raw_proba", vector_to_array("probability")[1])
    fitted, how = M.calibrator(scored.select("raw_proba", "y"), "y", method)
    assert how == method
    bundle, path, out, ck = (str(tmp_path / x) for x in ("bundle", "in", "out", "ck"))
    M.save_bundle(model, bundle, 0.4, ["x", "absent", "c"], "test", 1, fitted)
    M.save_bundle(model, bundle, 0.9, ["x", "absent", "c"], "test", 2, fitted)
    first, second = rows.where("part = 0").drop("y"), rows.where("part = 1").drop("y")
    read = lambda: spark.readStream.schema(first.schema).json(path)
    first.coalesce(1).write.mode("append").json(path)
    J.serve(read(), bundle, out, ck, version=1).awaitTermination(100)
    J.serve(read(), bundle, out, ck, version=1).awaitTermination(100)
    assert spark.read.json(out).count() == 200
    second.coalesce(1).write.mode("append").json(path)
    J.serve(read(), bundle, out, ck).awaitTermination(100)
    said = [json.loads(r["value"]) for r in spark.read.json(out).collect()]
    assert len(said) == 400 and len({m["driver"] for m in said}) == 400
    assert {(m["threshold"], m["modelVersion"]) for m in said} == {(0.4, 1), (0.9, 2)}
    want = {r["driver"]: r["y"] for r in rows.collect()}
    assert all(m["prediction"] == int(m["predictionProba"] >= m["threshold"]) and (m["predictionProba"] > 0.5) == (want[m["driver"]] == 1) for m in said)
    with pytest.raises(ValueError):
        M.load_bundle(spark, bundle, 7)


def test_grid_training(spark):
    rows = model_rows(spark)
    plan = M.split_plan(rows, "race", "grouped", folds=2)
    oof = M.train_oof(rows, plan, "race", ["x"], ["c"], "y", grid=[{"maxIter": 2, "maxDepth": 1}, {"maxIter": 5, "maxDepth": 4}], parallel=3, least=20).cache()
    assert oof.count() == 800 and {r["calibration"] for r in oof.select("calibration").distinct().collect()} == {"isotonic"}
    board = M.leaderboard(oof, "y").collect()
    assert [r["folds"] for r in board] == [2, 2] and board[0]["ap_calibrated"] == 1.0 and board[0]["f1_locked"] == 1.0
    assert board[0]["brier_calibrated"] <= board[0]["brier_raw"]


def test_importance_by_window(spark):
    """A feature that decides in one window only loses F1 there, noise nowhere; windows with other features disagree."""
    rows = model_rows(spark, 800).withColumn("z", F.pmod(F.xxhash64("driver", F.lit("z")), F.lit(2)).cast("double"))
    rows = rows.withColumn("y", F.when(F.col("part") == 0, F.col("y")).otherwise(F.col("z").cast("int"))).withColumn("p", F.col("part").cast("double")).cache()
    model = M.pipeline(["x", "z", "p", "noise"], [], "y").fit(M.weighted(rows, "y"))
    drops = M.permutation_by_window(model, rows, ["x", "z", "noise"], "y", ["driver"], "part", repeats=2).cache()
    got = {(r["part"], r["feature"], r["repeat"]): r["f1_drop"] for r in drops.collect()}
    assert len(got) == 12
    for r in (0, 1):
        assert got[0, "x", r] > 0.2 and got[1, "z", r] > 0.2
        assert all(abs(got[k]) < 0.05 for k in got if k[1] == "noise") and abs(got[0, "z", r]) < 0.05 and abs(got[1, "x", r]) < 0.05
    agree = M.rank_agreement(drops, "part").collect()
    assert [(r["a"], r["b"]) for r in agree] == [(0, 1)] and agree[0]["spearman"] < 1
