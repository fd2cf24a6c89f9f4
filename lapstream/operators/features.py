"""Column plans and matrices for models, parity and review tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import laps as L
from .decisions import count_if, ratio

#: Modes and the columns that each needs, and profiles with their mode and the features they leave out. Fixed values.
MODES: dict[str, tuple[str, ...]] = {
    "off": (),
    "track_agnostic_v1": ("trackTemp_expanding_z", "airTemp_expanding_z", "humidity_expanding_z", "speedTrap_expanding_z", "lapTime_expanding_z"),
    "track_percentage_v1": ("race_progress_pct", "lapTime_vs_driver_prev_mean_pct"),
    "track_percentage_team_v1": ("race_progress_pct", "lapTime_vs_driver_prev_mean_pct", "lapTime_vs_team_prev_lapbucket_mean_pct"),
    "track_percentage_race_team_v1": ("race_progress_pct", "lapTime_vs_driver_prev_mean_pct", "lapTime_vs_team_prev_lapbucket_mean_pct", "lapTime_vs_race_prev_lapbucket_mean_pct"),
}
AUTO = "auto"
MEDIUM = ("team", "rainfall", "hasGapAhead", "hasGapBehind")
PROFILES: dict[str, tuple[str, tuple[str, ...]]] = {
    "baseline": ("off", ()),
    "drop_medium_v1": ("off", MEDIUM),
    "drop_aggressive_v1_candidate": ("off", (*MEDIUM, "pitLoss", "pace_trend", "has_drop_zone_data")),
    "track_agnostic_v1": ("track_agnostic_v1", MEDIUM),
    "percent_conservative_v1": ("track_percentage_v1", MEDIUM),
    "percent_team_v1": ("track_percentage_team_v1", MEDIUM),
    "percent_race_team_v1": ("track_percentage_race_team_v1", MEDIUM),
    "percent_race_team_v1_strict": ("track_percentage_race_team_v1", (*MEDIUM, "lapTime")),
    "percent_race_team_aggressive_v1": ("track_percentage_race_team_v1", (*MEDIUM, "lapTime", "pitLoss", "pace_trend", "has_drop_zone_data")),
}


@dataclass(frozen=True)
class Plan:
    profile: str
    excludes: tuple[str, ...]
    mode: str


def profile_plan(profile: str, excludes: list[str] | tuple[str, ...] = (), mode: str = AUTO) -> Plan:
    """The plan of a named profile: its own excludes, then those given (an item may hold several, joined by commas), once each
    and in order; ``auto`` is the profile's mode. Unknown names are errors."""
    if profile.strip() not in PROFILES:
        raise ValueError(f"unknown feature profile: {profile}; known: {', '.join(PROFILES)}")
    if mode.strip() not in (AUTO, *MODES):
        raise ValueError(f"unknown mode: {mode}; known: {', '.join((AUTO, *MODES))}")
    own, left_out = PROFILES[profile.strip()]
    given = [x.strip() for item in excludes for x in item.split(",")]
    return Plan(profile.strip(), tuple(dict.fromkeys(x for x in (*left_out, *given) if x)), own if mode.strip() == AUTO else mode.strip())


def with_mode(laps: DataFrame, mode: str) -> DataFrame:
    """``laps`` with the columns that ``mode`` needs, all from the past only. Where a column to derive from is missing, so is
    what is derived from it (``planned`` then says so)."""
    out = laps
    for name in MODES[mode]:
        source = name.removesuffix("_expanding_z")
        if source != name:
            out = L.expanding_z(out, source, name) if source in laps.columns else out
        elif name == "race_progress_pct":
            out = out.withColumn(name, F.least(F.lit(1.5), F.try_divide(F.col("lapNumber").cast("double"), F.col("totalLaps").cast("double"))))
        elif name == "lapTime_vs_driver_prev_mean_pct":
            out = out.withColumn(name, S.clip_ratio(F.col("lapTime") / F.avg("lapTime").over(L.race_driver().rowsBetween(L.UNBOUNDED, -1)), 1.0, 0.5, 2.0))
        else:
            out = L.bucket_prev_ratio(out, ["race", "team"] if "_team_" in name else ["race"], name)
    return out


def planned(df: DataFrame, plan: Plan, required: list[str] = (), metadata: list[str] = ()) -> DataFrame:
    """The columns of ``df`` that the plan keeps; ``required`` ones and those of the plan's mode must be there."""
    return df.select(*feature_plan(df.columns, [*required, *MODES[plan.mode]], plan.excludes, metadata))


def feature_plan(columns: list[str], required: list[str], excludes: list[str] = (), metadata: list[str] = ()) -> list[str]:
    """The columns to keep, in order, once each; a missing required column is an error."""
    missing = [c for c in required if c not in columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return [c for c in dict.fromkeys(columns) if c not in {*excludes, *metadata}]


def one_hot(df: DataFrame, column: str, values: list[str]) -> list[Column]:
    return [*(F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{column}_{v}") for v in values), F.col(column).isNull().cast("int").alias(f"{column}_null")]


def align_schema(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """The training columns in their order; those that are missing or null are 0."""
    return matrix.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in matrix.columns else F.lit(0.0).alias(c) for c in columns))


def feature_parity(offline: DataFrame, serving: DataFrame, key: list[str], columns: list[str], tolerance: float) -> DataFrame:
    """For each feature the rows in both tables and the share that agrees, two nulls agreeing."""
    j = offline.select(*key, *(F.col(c).cast("double").alias(f"{c}_offline") for c in columns)).join(serving.select(*key, *(F.col(c).cast("double").alias(f"{c}_serving") for c in columns)), key)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}_offline").alias("a"), F.col(f"{c}_serving").alias("b")) for c in columns)))
    same = (F.abs(F.col("p.a") - F.col("p.b")) <= tolerance) | (F.col("p.a").isNull() & F.col("p.b").isNull())
    return j.select(pairs.alias("p")).groupBy(F.col("p.feature").alias("feature")).agg(F.count("*").alias("n"), ratio(count_if(same), F.count("*")).alias("match_rate"))


def consistency(detail: DataFrame, published: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Recomputed and published values side by side, PASS within the tolerance."""
    j = detail.select(*key, F.col(value).alias("computed")).join(published.select(*key, F.col(value).alias("published")), key, "full")
    return j.withColumn("status", F.when(F.abs(F.col("computed") - F.col("published")) <= tolerance, "PASS").otherwise("FAIL"))
