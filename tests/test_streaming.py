"""Streams over files give the rows of the batch operators."""

from lapstream.operators import laps as L
from lapstream.plans.fixtures import fixture
from lapstream.sources import io as IO
from lapstream.streaming import jobs as J
from conftest import DATA

KEY = ["race", "driver", "lapNumber"]


def drained(df, name, path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def written(spark, tmp_path):
    laps = fixture(spark, DATA, "laps")
    path = str(tmp_path / "laps")
    laps.orderBy("eventTimeMillis").coalesce(1).write.json(path)
    return laps, path


def test_tire_drops(spark, tmp_path):
    laps, path = written(spark, tmp_path)
    got = drained(J.tire_drops_stream(IO.read_stream(spark, "laps", path)), "tire", str(tmp_path / "c1"))
    want = L.tire_drops(laps)
    key = lambda df: sorted((r["race"], r["driver"], r["lapNumber"]) for r in df.collect())
    assert key(got) == key(want)


def test_session_rivals(spark, tmp_path):
    laps, path = written(spark, tmp_path)
    sessions = drained(J.session_laps(IO.read_stream(spark, "laps", path), "1 hour"), "sessions", str(tmp_path / "c2"))
    got = {(r["race"], r["driver"], r["lapNumber"]): (r["driverAhead"], r["driverBehind"]) for r in J.session_rivals(sessions).collect()}
    want = {(r["race"], r["driver"], r["lapNumber"]): (r["driverAhead"], r["driverBehind"]) for r in L.rivals(laps).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_enrichment(spark, tmp_path):
    laps, path = written(spark, tmp_path)
    status, out = fixture(spark, DATA, "track_status"), str(tmp_path / "out")
    J.enrich_each_batch(IO.read_stream(spark, "laps", path), lambda: status, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "c3"), "1 second").processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    assert spark.read.parquet(out).count() == laps.count()


def test_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"race": "r", "driver": "a", "lapNumber": 3}\n\n{broken\n')
    good, bad = IO.read_events(spark, str(tmp_path / "x.jsonl"), "laps")
    assert [r["lapNumber"] for r in good.collect()] == [3] and bad.count() == 1
