"""Quantiles of whole groups: the same as over sorted values, and no aggregate that gathers a group's values in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapstream.operators import decisions as D
from lapstream.operators import evaluation as E
from lapstream.operators.quantiles import with_quantiles


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_with_quantiles(spark):
    rows = [(None, float(i % 70)) for i in range(501)] + [(2024, float(i)) for i in range(300)] + [(2025, None), (2026, 7.0), (2026, float("inf"))]
    df = spark.createDataFrame(rows, "year int, x double")
    got = {r["year"]: r for r in with_quantiles(df.select("year").distinct(), df, ["year"], F.col("x"), {"a": 0.0, "m": 0.5, "p": 0.95, "z": 1.0}).collect()}
    for year in (None, 2024):
        v = [x for y, x in rows if y == year]
        assert [got[year][k] for k in "ampz"] == pytest.approx(np.quantile(v, [0, 0.5, 0.95, 1]))
    assert got[2025]["m"] is None and got[2026]["a"] == 7.0 and got[2026]["z"] == float("inf")


def test_no_group_in_one_task(spark):
    df = spark.range(2000).selectExpr("cast(id % 2 as int) as year", "if(id % 7 = 0, 'error', 'ok') as status", "id as event_index", "id * 1.5 as total_ms", "id % 3 = 0 as tp")
    for out in (E.numeric_profile(df, "total_ms", ["year"]), E.latency_summary(df, ["total_ms"], "total_ms", 5, ["year"]), D.feature_effects(df, ["total_ms"], F.col("tp"))):
        assert "percentile(" not in plan_of(out)
    r = D.feature_effects(df, ["total_ms"], F.col("tp")).first()
    v = [i * 1.5 for i in range(2000)]
    assert (r["p90_tp"], r["median_fp"]) == pytest.approx((np.quantile(v[::3], 0.9), np.median([x for i, x in enumerate(v) if i % 3])))
