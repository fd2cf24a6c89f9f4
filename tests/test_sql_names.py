"""SQL names give what the column functions give, on odd values too."""

import math

from pyspark.sql import functions as F

from lapstream.functions import scalars as S
from lapstream.functions.register import definitions, register_sql

C = F.col
TEXTS = [None, "", " ", "1", " 4 ", "24", "671", "nan", "<NA>", "good pit", "2024 :: GP one", "2024:: GP", "20x4 :: GP", "2024-01-01T00:00:00Z", "2024-01-01 00:00:00.250+0100", "2024-01-01T05:00:00", "nonsense", "SUCCESS_DEFEND", "FAILURE_TRAFFIC", "UNRESOLVED_X", "WEATHER_SURVIVAL_STOP", "other", "soft", "MEDIUM"]
NUMBERS = [None, 0.0, -1.0, 59.9996, 83.4567, 3725.5, math.inf, math.nan]


def test_texts(spark):
    assert register_sql(spark) == list(definitions())
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    same = {
        "canonical_status(t)": S.canonical_status(C("t")), "normalize_or_green(t)": S.normalize_or_green(C("t")), "is_green(t)": S.is_green(C("t")), "is_caution(t)": S.is_caution(C("t")), "parse_event_time(t)": S.parse_event_time(C("t")),
        "parse_mixed_ts(t)": S.parse_mixed_ts(C("t")), "normalize_label(t)": S.normalize_label(C("t")), "year_of_race(t)": S.year_of_race(C("t")), "strip_year_prefix(t)": S.strip_year_prefix(C("t")), "with_year_prefix(2024, t)": S.with_year_prefix(F.lit(2024), C("t")),
        "select_pit_loss(t, 1D, 2D, 3D)": S.select_pit_loss(C("t"), F.lit(1.0), F.lit(2.0), F.lit(3.0)), "outcome_of(t)": S.outcome_of(C("t")), "exclusion_reason(t)": S.exclusion_reason(C("t")), "clean_lap(80D, NULL, NULL, t)": S.clean_lap(F.lit(80.0), F.lit(None), F.lit(None), C("t")),
    }
    rows = df.select("t", *(F.expr(k).alias(f"{i}a") for i, k in enumerate(same)), *(v.alias(f"{i}b") for i, v in enumerate(same.values()))).collect()
    for i, name in enumerate(same):
        assert [(r["t"], r[f"{i}a"]) for r in rows] == [(r["t"], r[f"{i}b"]) for r in rows], name


def test_numbers(spark):
    register_sql(spark)
    df = spark.createDataFrame([(x,) for x in NUMBERS], "x double")
    rows = df.select(
        F.expr("clip_ratio(x, 1D, 0.5D, 2D)").alias("a"), S.clip_ratio(C("x"), 1.0, 0.5, 2.0).alias("b"), F.expr("accurate_or_pit(x > 0, x, NULL)").alias("c"), S.accurate_or_pit(C("x") > 0, C("x"), F.lit(None)).alias("d"), F.expr("clean_lap(x, NULL, NULL, '1')").alias("e"), S.clean_lap(C("x"), F.lit(None), F.lit(None), F.lit("1")).alias("f")
    ).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] and r["e"] == r["f"] for r in rows)
    times = df.where("x < 10000").select(F.expr("format_lap_time(x)").alias("a"), S.format_lap_time(C("x")).alias("b")).collect()
    assert [r["a"] for r in times] == [r["b"] for r in times] and "1:00.000" in [r["a"] for r in times]
