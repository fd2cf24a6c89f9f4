"""Stream reports and forensics against plain Python, on odd rows and on empty tables."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from lapstream.operators import quality as R


def rows(df):
    return {(r["measure"], r["item"], r["statistic"]): r["value"] for r in df.collect()}


def test_exact_quantiles(spark):
    rng = random.Random(3)
    values = {"a": [rng.randint(-50, 50) / 4 for _ in range(3001)], "b": [7.5], "c": [1.0] * 40 + [2.0]}
    counts = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "k string, x double").groupBy("k", "x").agg(F.count("*").alias("n"))
    got = {(r["k"], r["statistic"]): r["value"] for r in R.exact_quantiles(counts, "k", "x", "n", R.QUANTILES).collect()}
    want = {(k, name): float(pd.Series(v).quantile(p)) for k, v in values.items() for name, p in R.QUANTILES.items()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_observed_and_told(spark):
    df = spark.createDataFrame([("x", 1.0, "g"), ("x", None, "g"), (None, float("nan"), None), ("y", 3.0, None), ("z", 8.0, "h")], "v string, n double, g string")
    measures = {"all": R.Spread("v"), "top": R.Spread("v", 2), "n": R.Numbers("n", ("count", "mean", "median")), "by": R.Numbers("n", ("max",), by="g")}
    assert rows(R.told(R.observed(df, measures), measures)) == {
        ("all", "x", "count"): 2, ("all", "y", "count"): 1, ("all", "z", "count"): 1, ("all", None, "count"): 1,
        ("top", "x", "count"): 2, ("top", "y", "count"): 1, ("top", None, "unique"): 4,
        ("n", None, "count"): 3, ("n", None, "mean"): 4, ("n", None, "median"): 3, ("by", "g", "max"): 1, ("by", None, "max"): 3, ("by", "h", "max"): 8,
    }


def test_empty_streams(spark):
    empty = spark.createDataFrame([], "race string, driver string, lapNumber int, suggestionLabel string, totalScore double")
    got = {(r["stream"], r["measure"], r["statistic"]): r["value"] for r in R.stream_report({"pit_suggestions": empty}).collect()}
    assert got["pit_suggestions", "rows", "total"] == 0 and got["pit_suggestions", "columns", "count"] == 5
    assert not any(m in ("total_score", "suggestion_label_distribution") for _, m, _ in got)


def test_forensics(spark):
    evals = spark.createDataFrame(
        [
            ("R", "A", 5, "SUCCESS_DEFEND", "WET", "1", 1.0, None, 80.0, None, "B", True, "SETTLED"),
            ("R", "B", 6, "SUCCESS_DEFEND", "HARD", None, None, 2.0, None, 25.0, None, False, None),
            ("R", "C", 7, "FAILURE_TRAFFIC", None, "4", 1.0, 2.0, 0.0, -40.5, "A", None, "SETTLED"),
            ("R", "C", 7, None, "HARD", "4", 1.0, 2.0, 90.0, 20.0, "A", None, "RIVAL_PIT"),
        ],
        "race string, driver string, pitLapNumber int, result string, compound string, trackStatusAtPit string, prePitGapAhead double, postPitGapToRival double, baselineLapTime double, gapDeltaPct double, rivalAhead string, offsetStrategy boolean, resolvedVia string",
    )
    got = rows(R.forensics(evals, spark.createDataFrame([("1",), (None,), ("1",)], "trackStatus string")))
    assert got["success_defend", None, "count"] == 2 and got["success_defend", None, "pct"] == 50
    assert [got["nulls_in_success_defend", c, "count"] for c in ("prePitGapAhead", "postPitGapToRival", "baselineLapTime")] == [1, 1, 1]
    assert got["extreme_gap", None, "count"] == 2 and got["stops", "wet", "count"] == 1 and got["stops", "dry", "count"] == 3
    assert got["resolved_via_all", "SETTLED", "count"] == 2 and got["resolved_via_all", None, "count"] == 1 and got["resolved_via_success_defend", "SETTLED", "count"] == 1
    assert got["gap_delta_pct", "dry", "median"] == 20 and ("gap_delta_pct", "wet", "median") not in got
    assert got["baseline_le_zero_or_null", None, "count"] == 2 and got["offset_strategy", None, "pct"] == 25
    assert got["ml_status", "1", "count"] == 2 and got["ml_status_null", None, "count"] == 1
    assert [(r["driver"], r["gapDeltaPct"]) for r in R.extreme_gaps(evals).collect()] == [("C", -40.5), ("B", 25.0)]
    none = rows(R.forensics(evals.limit(0), evals.limit(0).select(F.lit("1").alias("trackStatus"))))
    assert none["success_defend", None, "pct"] == 0 and none["stops", "dry", "count"] == 0
