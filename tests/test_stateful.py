"""State machines on streams give the rows of the batch operators, whatever the order of arrival within the lateness."""

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from lapstream.operators import laps as L
from lapstream.plans.fixtures import fixture
from lapstream.sources import io as IO
from lapstream.streaming import stateful as T

KEY = ["race", "driver", "lapNumber"]


def drained(df, name, path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.table(name)


def feed(spark, tables, top, files=4):
    """A folder for each table: files of events in order of time but for two seconds, sliced at the same times; the last
    one has an event an hour on, in a race of its own."""
    jitter = lambda df: F.col("eventTimeMillis") + F.pmod(F.xxhash64(*df.columns), F.lit(2000))
    last = max(df.agg(F.max("eventTimeMillis")).first()[0] for df in tables.values())
    first = min(df.agg(F.min("eventTimeMillis")).first()[0] for df in tables.values())
    for name, df in tables.items():
        step = F.least(F.lit(files - 1), F.floor((jitter(df) - first) * files / (last - first)))
        for i in range(files):
            df.where(step == i).coalesce(1).write.mode("append").json(f"{top}/{name}")
        spark.createDataFrame([("end", last + 3_600_000)], "race string, eventTimeMillis long").coalesce(1).write.mode("append").json(f"{top}/{name}")


@pytest.fixture(scope="module")
def streams(spark, tmp_path_factory):
    T.with_state(spark)
    laps, status = fixture(spark, DATA, "laps").cache(), fixture(spark, DATA, "track_status").cache()
    top = tmp_path_factory.mktemp("feeds")
    feed(spark, {"laps": laps, "track_status": status}, top)
    read = lambda kind: spark.readStream.schema(IO.SCHEMAS[kind]).option("maxFilesPerTrigger", 1).json(str(top / kind))
    return laps, status, lambda: (read("laps"), read("track_status")), top


def rounded(df, *columns):
    kinds = dict(df.dtypes)
    return sorted(tuple(str(v) for v in r) for r in df.select(*(F.round(c, 9).alias(c) if kinds[c] == "double" else c for c in columns)).collect())


def test_drop_zones(streams):
    laps, status, read, top = streams
    got = drained(T.drop_zones_stream(*read()), "zones", str(top / "c1"))
    want = L.drop_zones(laps)
    assert rounded(got, *want.columns) == rounded(want, *want.columns)


def test_scores_on_laps_and_under_caution(streams):
    laps, status, read, top = streams
    got = drained(T.pit_scores_stream(*read()), "scores", str(top / "c2"))
    columns = [*KEY, "kind", "snapMillis", "now", "score", "label", "why", "pace", "paceDelta", "slowLaps", "gapDelta", "emergencePosition"]
    for kind in ("lap", "caution"):
        want = L.pit_scores(laps, status, (kind,))
        assert want.count() > 0
        assert rounded(got.where(F.col("kind") == kind), *columns) == rounded(want, *columns)


@pytest.fixture
def served(spark):
    """State with a lifetime in processing time would ask for batches without data for ever."""
    T.with_state(spark).conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def batch_features(laps):
    x = L.lag2_trend(L.lag2_trend(L.stint_features(laps), "paceDropRatio", "paceTrend"), "gapToCarAhead", "gapTrend")
    x = L.driver_prev_mean_ratio(L.expanding_z(x, "lapTime", "lapTimeZ"))
    x = L.bucket_prev_ratio(L.bucket_prev_ratio(x, ["race", "team"], "teamPrevRatio"), ["race"], "racePrevRatio")
    return x.select(*T._FEATURE_NAMES)


def test_features_as_served(spark, served, tmp_path):
    """A feed in order of laps, one lap of it sent wrong first and then again, gives the batch features of the laps."""
    laps = fixture(spark, DATA, "laps").where("lapNumber <= 24").cache()
    path = str(tmp_path / "in")
    for lo, hi in ((1, 6), (7, 12), (13, 18), (19, 24)):
        laps.where(f"lapNumber between {lo} and {hi}").coalesce(1).write.mode("append").json(path)
        if lo == 7:  # the last lap so far of each driver again, after a wrong time of it
            laps.where("lapNumber = 12").withColumn("lapTime", F.col("lapTime") * 3).coalesce(1).write.mode("append").json(path)
            laps.where("lapNumber = 12").coalesce(1).write.mode("append").json(path)
    stream = spark.readStream.schema(IO.SCHEMAS["laps"]).option("maxFilesPerTrigger", 1).json(path)
    got = drained(T.features_stream(stream), "features", str(tmp_path / "c"))
    assert got.count() == laps.count() + 2 * laps.where("lapNumber = 12").count()
    want = batch_features(laps)
    once = got.where("lapNumber <> 12")
    assert rounded(once, *T._FEATURE_NAMES) == rounded(want.where("lapNumber <> 12"), *T._FEATURE_NAMES)
    right = got.where("lapNumber = 12").join(laps.select(*KEY), KEY).groupBy(*KEY).agg(F.count("*").alias("n"))
    assert {r["n"] for r in right.collect()} == {3}


def test_state_has_a_lifetime(spark, served, tmp_path):
    """After the lifetime a race starts anew; within it, it goes on."""
    import time

    laps = fixture(spark, DATA, "laps").where("driver = 'D1' and lapNumber <= 9").cache()
    schema, path = IO.SCHEMAS["laps"], str(tmp_path / "in")
    laps.where("lapNumber <= 3").coalesce(1).write.mode("append").json(path)

    def run(life, c):
        out = T.features_stream(spark.readStream.schema(schema).json(path), life).writeStream.format("json").option("path", str(tmp_path / f"{c}out"))
        out.option("checkpointLocation", str(tmp_path / c)).trigger(availableNow=True).start().awaitTermination(100)
        return spark.read.schema(T.FEATURES).json(str(tmp_path / f"{c}out"))

    run(1_000, "c1"), run(3_600_000, "c2")
    time.sleep(2)
    laps.where("lapNumber between 4 and 6").coalesce(1).write.mode("append").json(path)
    short, long = run(1_000, "c1"), run(3_600_000, "c2")
    first = lambda df: df.where("lapNumber = 4").select("driverPrevMeanRatio", "stintId", "paceTrend").first()
    assert tuple(first(short)) == (1.0, 1, 0.0)
    want = batch_features(laps).where("lapNumber = 4").select("driverPrevMeanRatio", "stintId", "paceTrend").first()
    assert tuple(round(x, 9) for x in first(long)) == tuple(round(x, 9) for x in want) and want[0] != 1.0
