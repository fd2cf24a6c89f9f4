"""Stops on a stream: the scenarios of the batch operator, the 15-minute timer and a second stop while one is open."""

from pyspark.sql import functions as F

from lapstream.operators.pit_cycles import pit_cycles
from lapstream.streaming import stateful as T
from test_pit_cycles import SCHEMA, lap, undercut


def scenarios():
    both = lambda n, gap, **k: (lap("LEC", n, 1, total=k.get("total", 51)), lap("VER", n, 2, gap, pit=n == 20, stint=1 if n <= 20 else 2, total=k.get("total", 51)))
    two = [lap("VER", n, 2, 2.5, pit=n in (20, 23), stint=1 + (n > 20) + (n > 23)) for n in range(12, 40)]
    return {
        "undercut": undercut(),
        "before": [lap("LEC", n, 1, pit=n == 16, stint=1 if n <= 16 else 2) for n in range(12, 30)] + [lap("VER", n, 2, 2.5 if n <= 20 else 6.0, pit=n == 20, stint=1 if n <= 20 else 2) for n in range(12, 30)],
        "offset": [x for n in range(12, 36) for x in both(n, 2.5 if n <= 20 else 1.0, total=36)],
        "timer": [x for n in range(12, 51) for x in both(n, 2.5, total=70)],
        "alone": [lap("LEC", n, 1, time=80.0) for n in range(12, 30)] + [lap("VER", n, 9, None, pit=n == 20, stint=1 if n <= 20 else 2, time=82.0 if n <= 20 else 81.0) for n in range(12, 30)],
        "early": [lap("VER", n, 2, pit=n == 2) for n in range(1, 9)],
        "missing": [lap("VER", n, 2, pit=n == 20, time=None) for n in range(15, 30)],
        "incident": undercut(post=40.0),
        "pace": [lap("LEC", n, 1, pit=n == 23, stint=1 if n <= 23 else 2) for n in range(12, 30)] + [lap("VER", n, 2, 2.5 if n <= 20 else None, pit=n == 20, stint=1 if n <= 20 else 2, time=82.0 if n <= 20 else 80.0) for n in range(12, 30)],
        "twice": [lap("LEC", n, 1, total=70) for n in range(12, 40)] + two,
    }


def test_scenarios(spark, tmp_path):
    T.with_state(spark)
    rows = spark.createDataFrame([(name, *r[1:]) for name, rs in scenarios().items() for r in rs], SCHEMA).cache()
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lo, hi in ((0, 21), (22, 27), (28, 99)):
        rows.where(f"lapNumber between {lo} and {hi}").coalesce(1).write.mode("append").json(path)
    spark.createDataFrame([("end", 10**8)], "race string, eventTimeMillis long").coalesce(1).write.mode("append").json(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(path)
    T.stops_each_batch(stream, SCHEMA, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "c")).awaitTermination(200)
    want = pit_cycles(rows)
    got = spark.read.parquet(out).select(*want.columns)
    as_rows = lambda df: {(r["race"], r["driver"], r["pitLap"]): tuple(r) for r in df.collect()}
    a, b = as_rows(got), as_rows(want)
    assert set(a) == set(b)
    assert {k: (a[k], b[k]) for k in a if a[k] != b[k]} == {}
    how = {k[0]: r["resolution"] for k, r in (((x["race"],), x) for x in want.where("driver = 'VER'").collect())}
    assert how["timer"] == "SAFETY_TIMER" and how["undercut"] == "RIVAL_PIT" and how["offset"] == "OFFSET_TIMEOUT" and how["early"] == "EARLY_LAP_FILTER"
    assert [k for k in a if k[0] == "twice" and k[1] == "VER"] == [("twice", "VER", 20)]
