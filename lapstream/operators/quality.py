"""Reports on streams: how values spread, statistics with exact quantiles, the most frequent values, and forensics of stops.

All reports are one table (stream, measure, item, statistic, value): ``item`` is the value or group that a row is about
(null for a stream as a whole, and for rows without a value), ``statistic`` what is told of it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audits import stream_checks, stream_profile
from .decisions import count_if
from .evaluation import duplicate_rows, top_nulls
from .quantiles import exact_quantiles, settled

#: Stops on these tyres are wet; a change of a gap beyond this per cent of a lap is extreme. Fixed values.
WET = ("INTERMEDIATE", "WET")
EXTREME_PCT = 20.0
QUANTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@dataclass(frozen=True)
class Spread:
    """Rows by value; with ``top`` only the most frequent (ties by value) beside the number of different values."""

    of: str
    top: int | None = None


@dataclass(frozen=True)
class Numbers:
    """Statistics of a number, by ``by`` where given. Null and NaN are left out."""

    of: str
    which: tuple[str, ...]
    by: str | None = None
    needs: tuple[str, ...] = field(default=())


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def observed(df: DataFrame, measures: dict[str, Spread | Numbers], prefix: str = "") -> DataFrame:
    """(measure, item, x): a row for each row and measure; x is the number, null for a spread."""
    text = lambda e: F.expr(e).cast("string") if e else F.lit(None).cast("string")
    one = lambda k, m: F.struct(F.lit(prefix + k).alias("measure"), text(m.of if isinstance(m, Spread) else m.by).alias("item"), (F.lit(None) if isinstance(m, Spread) else F.expr(m.of)).cast("double").alias("x"))
    return df.select(F.explode(F.array(*(one(k, m) for k, m in measures.items()))).alias("m")).select("m.*")


def told(seen: DataFrame, measures: dict[str, Spread | Numbers]) -> DataFrame:
    """(measure, item, statistic, value) of what ``observed`` gave: rows of each value (``count``) of a spread, and with
    ``top`` also how many values there are (``unique``); statistics of numbers to 3 digits. A null value is the item null.

    Rows become counts of (measure, item, x) in one shuffle; everything else reads these counts."""
    stats = {k: m for k, m in measures.items() if isinstance(m, Numbers)}
    known = ~F.col("measure").isin(*stats) | (F.col("x").isNotNull() & ~F.isnan("x"))
    counts = settled(seen.where(known).groupBy("measure", "item", "x").agg(F.count("*").alias("n")))
    tops = {k: m.top for k, m in measures.items() if isinstance(m, Spread) and m.top is not None}
    row = lambda df, statistic, value: df.select("measure", "item", F.lit(statistic).alias("statistic"), value.cast("double").alias("value"))
    frames = [row(counts.where(~F.col("measure").isin(*tops, *stats)), "count", F.col("n"))]
    if tops:
        ranked = counts.where(F.col("measure").isin(*tops))
        place = F.row_number().over(Window.partitionBy("measure").orderBy(F.col("n").desc(), F.col("item").asc_nulls_last()))
        most = reduce(lambda a, k: a.when(F.col("measure") == k, F.lit(tops[k])), tops, F)
        frames += [row(ranked.withColumn("__r", place).where(F.col("__r") <= max(tops.values())).where(F.col("__r") <= most), "count", F.col("n"))]
        frames += [row(ranked.groupBy("measure").agg(F.count("*").alias("n")).withColumn("item", F.lit(None).cast("string")), "unique", F.col("n"))]
    return _union([*frames, _statistics(counts, stats)] if stats else frames)


def _statistics(counts: DataFrame, measures: dict[str, Numbers]) -> DataFrame:
    counts = counts.where(F.col("measure").isin(*measures)).withColumn("__key", F.to_json(F.struct("measure", "item")))
    x, n = F.col("x"), F.col("n")
    plain = {"count": F.sum(n).cast("double"), "mean": F.sum(x * n) / F.sum(n), "min": F.min(x), "max": F.max(x)}
    g = counts.groupBy("__key").agg(*(v.alias(k) for k, v in plain.items()))
    rows = g.select("__key", F.explode(F.array(*(F.struct(F.lit(k).alias("statistic"), F.col(k).alias("value")) for k in plain))).alias("s")).select("__key", "s.*")
    asked = {s for m in measures.values() for s in m.which}
    if asked & set(QUANTILES):
        rows = rows.unionByName(exact_quantiles(counts, "__key", "x", "n", {k: p for k, p in QUANTILES.items() if k in asked}))
    own = F.from_json("__key", "measure string, item string")
    rows = rows.select(own["measure"].alias("measure"), own["item"].alias("item"), "statistic", F.round("value", 3).alias("value"))
    return rows.where(reduce(lambda a, b: a | b, ((F.col("measure") == k) & F.col("statistic").isin(*m.which) for k, m in measures.items())))


#: For each stream what is told beyond its counts: measure, and the column or expression it is of. Fixed names.
DETAILS: dict[str, tuple[dict[str, Spread], dict[str, Numbers]]] = {
    "ml_features": ({"track_status_distribution": Spread("trackStatus"), "top_races_by_rows": Spread("race", 10)}, {}),
    "pit_evals": ({"result_distribution": Spread("result"), "resolved_via_distribution": Spread("resolvedVia"), "races": Spread("race", 0)}, {}),
    "pit_suggestions": ({"suggestion_label_distribution": Spread("suggestionLabel"), "track_status_distribution": Spread("trackStatus")}, {"total_score": Numbers("totalScore", ("mean", "median", "p90", "p99", "min", "max"))}),
    "drop_zones": (
        {"track_status_distribution": Spread("status")},
        {
            "gap_to_physical_car": Numbers("gapToCar", ("min", "mean", "p95", "max")), "current_position": Numbers("position", ("mean", "median", "min", "max")),
            "emergence_position": Numbers("emergencePosition", ("mean", "median", "min", "max")), "positions_lost": Numbers("positionsLost", ("mean", "median", "min", "max")),
        },
    ),
    "lift_coast": (
        {"track_status_distribution": Spread("trackStatus"), "top_drivers": Spread("driver", 10)},
        {
            "full_to_lift_seconds": Numbers("(liftMillis - startMillis) / 1000", ("min", "mean", "p95", "max"), needs=("liftMillis", "startMillis")),
            "lift_to_brake_seconds": Numbers("(brakeMillis - liftMillis) / 1000", ("min", "mean", "p95", "max"), needs=("brakeMillis", "liftMillis")),
        },
    ),
    "tire_drops": ({"alerts_by_compound": Spread("compound")}, {"delta_seconds": Numbers("delta", ("min", "mean", "p95", "max")), "tyre_life_by_compound": Numbers("tyreLife", ("count", "mean", "median", "min", "max"), by="compound")}),
}


def _has(df: DataFrame, m: Spread | Numbers) -> bool:
    named = [*(getattr(m, "needs", ()) or (m.of,)), *([m.by] if getattr(m, "by", None) else [])]
    return set(named) <= set(df.columns)


def details(streams: dict[str, DataFrame]) -> DataFrame:
    """What ``DETAILS`` names for the streams given by name, all counted together; a measure of a column that the stream
    does not have is left out."""
    measures, seen = {}, []
    for kind, df in streams.items():
        own = {k: m for given in DETAILS[kind] for k, m in given.items() if _has(df, m)}
        measures |= {f"{kind}.{k}": m for k, m in own.items()}
        seen += [observed(df, own, f"{kind}.")] if own else []
    rows = told(_union(seen), measures)
    return rows.select(F.split_part("measure", F.lit("."), F.lit(1)).alias("stream"), F.split_part("measure", F.lit("."), F.lit(2)).alias("measure"), "item", "statistic", "value")


def generic(df: DataFrame, kind: str, top: int = 8) -> DataFrame:
    """Columns, rows that repeat an earlier one in all columns, and the per cent of nulls of the ``top`` columns with any."""
    alone = lambda x, name: x.select(F.lit(kind).alias("stream"), F.lit(name).alias("measure"), F.lit(None).cast("string").alias("item"), F.lit("count").alias("statistic"), F.col("v").cast("double").alias("value"))
    repeated = alone(duplicate_rows(df).select(F.col("duplicate_rows").alias("v")), "exact_duplicate_rows")
    nulls = top_nulls(df, top).where("null_pct > 0").select(F.lit(kind).alias("stream"), F.lit("nulls").alias("measure"), F.col("column").alias("item"), F.lit("pct").alias("statistic"), F.round("null_pct", 2).alias("value"))
    width = alone(df.sparkSession.range(1).select(F.lit(len(df.columns)).alias("v")), "columns")
    return _union([repeated, nulls, width])


def stream_report(streams: dict[str, DataFrame]) -> DataFrame:
    """Everything about the streams given by name: the counts of ``stream_profile``, ``generic`` and ``details``.

    A stream without rows has its counts (0) and no distributions or statistics."""
    known = stream_checks()
    frames = []
    for kind, df in streams.items():
        counted = stream_profile(df, kind, *known[kind]).select("stream", "measure", F.lit(None).cast("string").alias("item"), F.lit("total").alias("statistic"), "value")
        frames += [counted, generic(df, kind)]
    return _union([*frames, details(streams)])


def forensics(evals: DataFrame, features: DataFrame) -> DataFrame:
    """(measure, item, statistic, value) on resolved stops: successful defences and what is missing in them, how stops were
    resolved, extreme changes of the gap, wet against dry stops, and whether track status reached stops and features.

    ``evals`` has result, resolvedVia, compound, trackStatusAtPit, prePitGapAhead, postPitGapToRival, baselineLapTime,
    gapDeltaPct, rivalAhead and offsetStrategy, ``features`` trackStatus. A share of nothing is 0; a null tyre is dry."""
    c = F.col
    defend, wet = F.coalesce(c("result") == "SUCCESS_DEFEND", F.lit(False)), F.coalesce(c("compound").isin(*WET), F.lit(False))
    facts = {
        ("success_defend", None): defend, ("nulls_in_success_defend", "prePitGapAhead"): defend & c("prePitGapAhead").isNull(), ("nulls_in_success_defend", "postPitGapToRival"): defend & c("postPitGapToRival").isNull(),
        ("nulls_in_success_defend", "baselineLapTime"): defend & c("baselineLapTime").isNull(), ("extreme_gap", None): F.abs("gapDeltaPct") > EXTREME_PCT, ("stops", "wet"): wet, ("stops", "dry"): ~wet,
        ("pit_status_null", None): c("trackStatusAtPit").isNull(), ("rival_ahead_null", None): c("rivalAhead").isNull(), ("post_gap_null", None): c("postPitGapToRival").isNull(),
        ("baseline_le_zero_or_null", None): F.coalesce("baselineLapTime", F.lit(0.0)) <= 0, ("offset_strategy", None): F.coalesce("offsetStrategy", F.lit(False)),
    }
    counts = _facts(evals, facts, shares={"success_defend", "rival_ahead_null", "post_gap_null", "offset_strategy"})
    status = _facts(features, {("ml_status_null", None): c("trackStatus").isNull()}, shares=set())
    stops = {"resolved_via_all": Spread("resolvedVia"), "resolved_via_success_defend": Spread("CASE WHEN result = 'SUCCESS_DEFEND' THEN resolvedVia END"), "pit_status": Spread("trackStatusAtPit")}
    stops["gap_delta_pct"] = Numbers("gapDeltaPct", ("mean", "median"), by=f"CASE WHEN compound IN {WET} THEN 'wet' ELSE 'dry' END")
    laps = {"ml_status": Spread("trackStatus")}
    rows = told(_union([observed(evals, stops), observed(features, laps)]), stops | laps)
    return _union([counts, status, rows.where("measure = 'resolved_via_all' or item is not null")])


def _facts(df: DataFrame, facts: dict[tuple[str, str | None], Column], shares: set[str]) -> DataFrame:
    """One aggregate over ``df``: rows for which each fact holds, and for ``shares`` their per cent."""
    one = df.agg(F.count("*").alias("__rows"), *(count_if(v).alias(f"__{i}") for i, v in enumerate(facts.values())))
    row = lambda k, statistic, value: F.struct(F.lit(k[0]).alias("measure"), F.lit(k[1]).cast("string").alias("item"), F.lit(statistic).alias("statistic"), value.alias("value"))
    cells = [row(k, "count", F.coalesce(F.col(f"__{i}"), F.lit(0)).cast("double")) for i, k in enumerate(facts)]
    cells += [row(k, "pct", F.coalesce(F.round(F.try_divide(F.col(f"__{i}") * F.lit(100.0), F.col("__rows").cast("double")), 2), F.lit(0.0))) for i, k in enumerate(facts) if k[0] in shares]
    return one.select(F.explode(F.array(*cells)).alias("m")).select("m.*")


def extreme_gaps(evals: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` stops with the greatest change of the gap, of those beyond the limit; ties by race, driver and lap."""
    numbers = ("prePitGapAhead", "postPitGapToRival", "gapDeltaPct")
    rows = evals.where(F.abs("gapDeltaPct") > EXTREME_PCT).orderBy(F.abs("gapDeltaPct").desc(), "race", "driver", "pitLapNumber").limit(top)
    return rows.select("race", "driver", "pitLapNumber", "rivalAhead", *(F.round(x, 3).alias(x) for x in numbers), "result", "resolvedVia")
