"""Operators on lap, sensor and status tables: as-of joins, gaps, rivals, trains, stints, causal features, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

UNBOUNDED, CURRENT = Window.unboundedPreceding, Window.currentRow
CLEAN = ("lapTime", "pitInTime", "pitOutTime", "trackStatus")


def race_driver():
    return Window.partitionBy("race", "driver").orderBy("lapNumber")


def race_lap():
    return Window.partitionBy("race", "lapNumber").orderBy("position")


def clean() -> Column:
    return S.clean_lap(*(F.col(c) for c in CLEAN))


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row of the same key at or before it: one union, one window."""
    cols = left.columns
    tagged = left.select(*cols, F.lit(1).alias("__side"), *(F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values))
    marks = right.select(*(F.col(c) if c in [*by, on] else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols), F.lit(0).alias("__side"), *(F.col(v).alias(f"__{v}") for v in values))
    w = Window.partitionBy(*by).orderBy(on, "__side").rowsBetween(UNBOUNDED, CURRENT)
    return tagged.unionByName(marks).select("*", *(F.last(f"__{v}", ignorenulls=True).over(w).alias(f"asof_{v}") for v in values)).where("__side = 1").select(*cols, *(f"asof_{v}" for v in values))


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, tolerance: int, key: list[str]) -> DataFrame:
    """The nearest ``right`` value within ``tolerance``: an equi-join on time buckets, then the closest (ties: earlier)."""
    bucket = F.floor(F.col(on) / tolerance)
    r = right.select(*by, F.col(on).alias("__on"), F.col(value).alias("__v"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__b"))
    near = left.withColumn("__b", bucket).join(r, [*by, "__b"]).where(F.abs(F.col(on) - F.col("__on")) <= tolerance)
    best = near.groupBy(*key).agg(F.min_by("__v", F.struct(F.abs(F.col(on) - F.col("__on")), F.col("__on"))).alias(f"nearest_{value}"))
    return left.join(best, key, "left")


def gap_to_car_ahead(laps: DataFrame) -> DataFrame:
    total = F.sum("lapTime").over(race_driver().rowsBetween(UNBOUNDED, CURRENT))
    return laps.withColumn("cumTime", total).withColumn("gap", F.round(F.col("cumTime") - F.lag("cumTime").over(race_lap()), 3))


def rivals(laps: DataFrame) -> DataFrame:
    return laps.select(
        "race", "driver", "lapNumber", "position",
        F.lag("driver").over(race_lap()).alias("driverAhead"), F.lead("driver").over(race_lap()).alias("driverBehind"),
        F.when(F.lag("driver").over(race_lap()).isNotNull(), F.abs("gapToCarAhead")).alias("gapAhead"), F.abs(F.lead("gapToCarAhead").over(race_lap())).alias("gapBehind"),
    )


def drs_trains(laps: DataFrame, gap: float = 1.0, least: int = 3) -> DataFrame:
    """Runs of cars each less than ``gap`` seconds behind the next, as rows of race and lap."""
    start = F.when(F.coalesce(F.col("gapToCarAhead") < gap, F.lit(False)), 0).otherwise(1)
    runs = laps.withColumn("train", F.sum(start).over(race_lap().rowsBetween(UNBOUNDED, CURRENT)))
    cars = F.array_sort(F.collect_list(F.struct("position", "driver")))
    return runs.groupBy("race", "lapNumber", "train").agg(F.count("*").alias("size"), F.min("position").alias("head"), cars.alias("cars")).where(F.col("size") >= least).select("race", "lapNumber", "head", "size", F.array_join(F.col("cars.driver"), ",").alias("drivers"))


def stint_segments(laps: DataFrame) -> DataFrame:
    w = race_driver()
    new = F.lag("lapNumber").over(w).isNull() | F.coalesce(F.col("tyreLife") < F.lag("tyreLife").over(w), F.lit(False)) | ~F.col("compound").eqNullSafe(F.lag("compound").over(w))
    return laps.withColumn("stintId", F.sum(new.cast("int")).over(w.rowsBetween(UNBOUNDED, CURRENT)))


def stint_features(laps: DataFrame) -> DataFrame:
    w = Window.partitionBy("race", "driver", "stintId").orderBy("lapNumber").rowsBetween(UNBOUNDED, CURRENT)
    best = F.min("lapTime").over(w)
    return stint_segments(laps).withColumn("stintBest", best).withColumn("paceDropRatio", S.clip_ratio(F.col("lapTime") / F.col("stintBest"), 1.0, 0.5, 2.0)).withColumn("tireLifeRatio", S.clip_ratio(F.col("tyreLife") / S.choose(F.upper("compound"), S.MAX_STINT, 30.0), 0.0, 0.0, 3.0))


def lag2_trend(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(column) - F.lag(column, 2).over(race_driver()), F.lit(0.0)))


def expanding_z(laps: DataFrame, column: str, out: str) -> DataFrame:
    """Score against all earlier laps of the race in order of lap and driver: only the past counts."""
    w = Window.partitionBy("race").orderBy("lapNumber", "driver").rowsBetween(UNBOUNDED, -1)
    n, s, q = F.count(column).over(w), F.sum(column).over(w), F.sum(F.col(column) * F.col(column)).over(w)
    var = q / n - (s / n) * (s / n)
    return laps.withColumn(out, F.when((n >= 2) & (var > 1e-12), (F.col(column) - s / n) / F.sqrt(var)).otherwise(F.lit(0.0)))


def driver_prev_mean_ratio(laps: DataFrame) -> DataFrame:
    return laps.withColumn("driverPrevMeanRatio", S.clip_ratio(F.col("lapTime") / F.avg("lapTime").over(race_driver().rowsBetween(UNBOUNDED, -1)), 1.0, 0.5, 2.0))


def bucket_prev_ratio(laps: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Lap time over the mean of earlier laps' means of the same ``keys``: averages by lap first, then the past."""
    means = laps.groupBy(*keys, "lapNumber").agg(F.avg("lapTime").alias("m"))
    past = means.withColumn("past", F.avg("m").over(Window.partitionBy(*keys).orderBy("lapNumber").rowsBetween(UNBOUNDED, -1))).drop("m")
    return laps.join(past, [*keys, "lapNumber"]).withColumn(out, S.clip_ratio(F.col("lapTime") / F.col("past"), 1.0, 0.5, 2.0)).drop("past")


def tire_drops(laps: DataFrame) -> DataFrame:
    """Second, fourth, .. slow lap in a row against the stint's best, by compound, fuel and track temperature; the first
    two laps of a race count for nothing."""
    w = Window.partitionBy("race", "driver", "stint").orderBy("lapNumber")
    x = laps.where(clean() & (F.col("lapNumber") > 2)).withColumn("prevBest", F.min("lapTime").over(w.rowsBetween(UNBOUNDED, -1))).withColumn("best", F.min("lapTime").over(w.rowsBetween(UNBOUNDED, CURRENT)))
    limit = F.greatest(F.lit(0.005), S.choose(F.upper("compound"), S.BASE_THRESHOLD, 0.015) - F.when(F.col("totalLaps") > 0, 0.003 * F.least(F.col("lapNumber") / F.col("totalLaps"), F.lit(1.0))).otherwise(0.0) - F.when(F.col("trackTemp") > 40, 0.002).otherwise(0.0))
    odd = F.coalesce(F.col("lapTime") > F.col("prevBest") * 1.07, F.lit(False))
    x = x.withColumn("slow", (~odd & (F.col("lapTime") > F.col("best") * (1.0 + limit))).cast("int"))
    x = x.withColumn("run", F.sum(1 - F.col("slow")).over(w.rowsBetween(UNBOUNDED, CURRENT)))
    place = F.sum("slow").over(Window.partitionBy("race", "driver", "stint", "run").orderBy("lapNumber").rowsBetween(UNBOUNDED, CURRENT))
    return x.withColumn("place", place).where("slow = 1 and place % 2 = 0").select("race", "driver", "lapNumber", "compound", "tyreLife", "lapTime", F.col("best").alias("stintBest"), (F.col("lapTime") - F.col("best")).alias("delta"), "trackStatus")


def ladder(laps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Running sum of gaps down the order of a lap, and the number of unknown gaps so far: two cars are
    comparable if no unknown gap lies between them, and then the difference of sums is the distance."""
    w = Window.partitionBy(*(keys or ["race", "lapNumber"])).orderBy("position", "driver").rowsBetween(UNBOUNDED, CURRENT)
    return laps.withColumn("gapSum", F.round(F.coalesce(F.sum("gapToCarAhead").over(w), F.lit(0.0)), 6)).withColumn("gapBlock", F.sum(F.col("gapToCarAhead").isNull().cast("int")).over(w)).withColumn("place", F.row_number().over(w))


#: Laps that a car's latest row may lie behind the leader's to be in a grid.
RECENT = 3
MOMENT = ["race", "snapMillis"]


def race_snapshots(laps: DataFrame) -> DataFrame:
    """When a snapshot is taken: (race, snapMillis, snapLap, floorLap) at each moment that raises a race's highest lap,
    from the second lap on. Events of one millisecond are one moment."""
    at = laps.where("driver is not null and lapNumber > 0").groupBy("race", F.col("eventTimeMillis").alias("snapMillis")).agg(F.max("lapNumber").alias("snapLap"))
    before = F.max("snapLap").over(Window.partitionBy("race").orderBy("snapMillis").rowsBetween(UNBOUNDED, -1))
    return at.withColumn("before", before).where("snapLap > coalesce(before, 0) and snapLap > 1").select(*MOMENT, "snapLap", (F.col("snapLap") - RECENT).alias("floorLap"))


def caution_snapshots(laps: DataFrame, status: DataFrame) -> DataFrame:
    """The same at each status under caution: scores are taken again for the last completed lap."""
    top = laps.groupBy("race", "eventTimeMillis").agg(F.max("lapNumber").alias("top"))
    top = top.withColumn("top", F.max("top").over(Window.partitionBy("race").orderBy("eventTimeMillis").rowsBetween(UNBOUNDED, CURRENT)))
    calls = status.where(S.is_caution(F.col("status"))).select("race", "eventTimeMillis").distinct()
    done = F.col("asof_top") - 1
    return asof_backward(calls, top, ["race"], "eventTimeMillis", ["top"]).where("asof_top > 1").select("race", F.col("eventTimeMillis").alias("snapMillis"), done.alias("snapLap"), (done - RECENT).alias("floorLap"))


def grid_at(laps: DataFrame, moments: DataFrame) -> DataFrame:
    """The grid at each of ``moments``: every driver's latest lap row by then, if not older than ``floorLap``.

    A moment meets each driver of its race once, and one as-of window by driver finds the row."""
    asked = moments.join(laps.select("race", "driver").distinct(), "race").withColumnRenamed("snapMillis", "eventTimeMillis")
    rows = laps.select("race", "driver", "eventTimeMillis", F.struct("*").alias("row"))
    found = asof_backward(asked, rows, ["race", "driver"], "eventTimeMillis", ["row"]).where("asof_row.lapNumber >= floorLap")
    return found.select(F.col("eventTimeMillis").alias("snapMillis"), "snapLap", "asof_row.*")


def snapshots(laps: DataFrame, status: DataFrame | None = None, of: tuple[str, ...] = ("lap",)) -> DataFrame:
    """(race, kind, snapMillis, snapLap, now, seen, cars): the grid at each moment of a race, its cars in order.

    Moments of kind ``lap`` are those of ``race_snapshots``, of kind ``caution`` those of ``caution_snapshots``. ``now`` is
    the track's status by then (its own under caution), ``seen`` the longest tyre life by then of each compound. With both
    kinds, a caution called in the millisecond of a new lap is no moment of its own.

    Laps are dealt by race once; every window and the grouping behind it hold on to that. A race is one array in order of
    time, a row of which counts until the driver's next one. A moment's grid is a filter of the part of that array from
    where the race first came to the grid's lowest lap (``climbs``) up to the moment: no row before it has such a lap."""
    c = F.col
    own, timed = Window.partitionBy("race", "driver").orderBy("eventTimeMillis", "lapNumber"), Window.partitionBy("race").orderBy("eventTimeMillis")
    worn = Window.partitionBy("race", "compound").orderBy("eventTimeMillis").rangeBetween(UNBOUNDED, -1)
    rows = [x for x in laps.columns if x not in ("__until", "__top", "__longest")]
    x = laps.withColumn("__until", F.lead("eventTimeMillis").over(own)).withColumn("__top", F.max("lapNumber").over(timed.rangeBetween(UNBOUNDED, CURRENT))).withColumn("__before", F.max("lapNumber").over(timed.rangeBetween(UNBOUNDED, -1))).withColumn("__longest", F.max("tyreLife").over(worn))
    x = x.withColumn("__n", F.count("*").over(timed.rangeBetween(UNBOUNDED, CURRENT)).cast("int")).withColumn("__first", F.count("*").over(timed.rangeBetween(UNBOUNDED, -1)).cast("int"))
    real = c("driver").isNotNull() & (c("lapNumber") > 0)
    raised = real & (c("lapNumber") > F.coalesce("__before", F.lit(0))) & (c("lapNumber") > 1) & (c("lapNumber") == c("__top"))
    undated = c("eventTimeMillis").isNull()  # first in order
    climbs = (c("lapNumber") == c("__top")) & (undated | c("__before").isNull() | (c("lapNumber") > c("__before")))
    older = c("compound").isNotNull() & (c("tyreLife") > F.coalesce("__longest", F.lit(-1)))
    when = c("eventTimeMillis").alias("t")
    race = x.groupBy("race").agg(
        F.sort_array(F.collect_list(F.struct(when, c("__until").alias("until"), F.struct(*rows).alias("row")))).alias("rows"),
        F.array_distinct(F.collect_list(F.when(raised, F.struct(when, c("lapNumber").alias("lap"), c("__n").alias("n"))))).alias("raised"),
        F.array_distinct(F.collect_list(F.when(climbs, F.struct(c("lapNumber").alias("lap"), F.when(undated, 0).otherwise(c("__first")).alias("first"))))).alias("climbs"),
        F.collect_list(F.when(older, F.struct("compound", when, c("tyreLife").alias("n")))).alias("older"),
        F.array_sort(F.array_distinct(F.collect_list(F.struct(when, c("__top").alias("lap"), c("__n").alias("n"))))).alias("tops"),
    )
    if status is None:
        race = race.withColumn("calls", F.array().cast("array<struct<t:bigint,s:string>>"))
    else:
        calls = status.groupBy("race").agg(F.array_sort(F.collect_list(F.struct(when, c("status").alias("s")))).alias("calls"))
        race = race.join(calls, "race", "left")
    last = lambda xs, t: F.try_element_at(F.filter(xs, lambda e: e["t"] <= t), F.lit(-1))
    moment = lambda kind, t, lap, n: F.struct(F.lit(kind).alias("kind"), t.alias("t"), lap.alias("lap"), n.alias("n"))
    on_lap = F.transform("raised", lambda m: moment("lap", m["t"], m["lap"], m["n"]))
    called = F.array_distinct(F.transform(F.filter("calls", lambda e: S.is_caution(e["s"])), lambda e: e["t"]))
    on_call = F.filter(F.transform(F.transform(called, lambda t: F.struct(t.alias("t"), last(c("tops"), t).alias("top"))), lambda m: moment("caution", m["t"], m["top"]["lap"] - 1, m["top"]["n"])), lambda m: m["lap"] > 0)
    if "lap" in of:  # events of one millisecond are one moment, under the status called then
        on_call = F.filter(on_call, lambda m: ~F.exists("raised", lambda r: r["t"] == m["t"]))
    moments = F.concat(*([on_lap] if "lap" in of else []), *([F.coalesce(on_call, F.array().cast("array<struct<kind:string,t:bigint,lap:int,n:int>>"))] if "caution" in of else []))
    each = race.withColumn("m", F.explode(moments))
    t, floor = c("m.t"), c("m.lap") - RECENT
    first = F.coalesce(F.array_min(F.transform(F.filter("climbs", lambda e: e["lap"] >= floor), lambda e: e["first"])), F.lit(0))
    recent = F.slice("rows", first + 1, F.greatest(c("m.n") - first, F.lit(0)))
    cars = F.transform(F.filter(recent, lambda r: (r["t"] <= t) & (r["until"].isNull() | (r["until"] > t)) & (r["row"]["lapNumber"] >= floor)), lambda r: F.struct(r["row"]["position"].alias("p"), r["row"]["driver"].alias("d"), r["row"].alias("row")))
    by_then = F.filter("older", lambda e: e["t"] <= t)
    seen = F.map_from_entries(F.transform(F.array_distinct(F.transform(by_then, lambda e: e["compound"])), lambda k: F.struct(k, F.array_max(F.transform(F.filter(by_then, lambda e: e["compound"] == k), lambda e: e["n"])))))
    now = S.normalize_or_green(last(c("calls"), t)["s"])
    return each.select("race", c("m.kind").alias("kind"), t.alias("snapMillis"), c("m.lap").alias("snapLap"), now.alias("now"), seen.alias("seen"), F.transform(F.sort_array(cars), lambda r: r["row"]).alias("cars"))


def emergence(grids: DataFrame, status) -> DataFrame:
    """Each car of ``grids`` (.., cars in order) after a stop now: the car it would come out behind, the gap to it.

    A grid is at most a field of cars; gaps are summed down it until they reach the loss of a stop under ``status`` (a
    function of a car) or one is unknown. Only row by row: a stream may ask this of its grids as well."""
    # One pass down the grid for the sums of gaps and the number of unknown ones; arrays are made before they are exploded,
    # so that none is made again for a condition on what it gives.
    tail = lambda acc, k, zero: F.coalesce(F.try_element_at(acc, F.lit(-1))[k], zero)
    add = lambda acc, x: F.struct((F.size(acc) + 1).alias("place"), (tail(acc, "gap", F.lit(0.0)) + F.coalesce(x["gapToCarAhead"], F.lit(0.0))).alias("gap"), (tail(acc, "open", F.lit(0)) + x["gapToCarAhead"].isNull().cast("int")).alias("open"))
    sums = F.aggregate("cars", F.array().cast("array<struct<place:int,gap:double,open:int>>"), lambda acc, x: F.concat(acc, F.array(add(acc, x))))
    slim = lambda x, upto: F.struct(
        upto["place"].alias("place"), x["position"].alias("position"), x["driver"].alias("driver"), x["lapNumber"].alias("lapNumber"), F.round(upto["gap"], 6).alias("gapSum"), upto["open"].alias("gapBlock"),
        x["compound"].alias("compound"), x["tyreLife"].alias("tyreLife"), x["pitInTime"].isNotNull().alias("boxed"),
    )
    others = [x for x in grids.columns if x not in ("race", "cars")]
    each = grids.withColumn("line", F.zip_with("cars", sums, slim)).select(*others, "line", F.posexplode_outer("cars").alias("i", "car")).where("i is not null")
    each = each.select(*others, "line", "car.*", F.get("line", F.col("i")).alias("me"))
    c = F.col
    each = each.withColumn("loss", S.select_pit_loss(status(each), c("pitLoss"), c("vscPitLoss"), c("scPitLoss")))
    place, here = c("me.place"), c("me")
    each = each.withColumn("behind", F.get("line", place)).withColumn("ahead", F.when(place > 1, F.get("line", place - 2)))
    # The last car of the block before the first one that the loss does not reach.
    ends = F.filter(F.slice("line", place + 1, F.size("line")), lambda x: (x["gapBlock"] != here["gapBlock"]) | (x["gapSum"] - here["gapSum"] >= c("loss")))
    inside = F.coalesce(F.get(ends, F.lit(0))["place"], F.size("line") + 1) - 1
    each = each.withColumn("inside", F.when(c("loss").isNotNull(), inside)).select("*", F.explode_outer(F.when(c("inside") > place, F.slice("line", c("inside"), F.lit(1)))).alias("m"))
    m = c("m")
    kept = [x for x in each.columns if x not in ("line", "me", "inside", "m")]
    return each.select(
        *kept, here["gapSum"].alias("gapSum"), here["gapBlock"].alias("gapBlock"), m["driver"].alias("carAhead"), m["compound"].alias("carCompound"), m["tyreLife"].alias("carTyreLife"),
        F.coalesce(m["position"] + 1, c("position")).alias("emergencePosition"), (c("loss") - (m["gapSum"] - here["gapSum"])).alias("gapToCar"),
    )


def by_race(laps: DataFrame) -> DataFrame:
    """Dealt by race once: windows over a race and anything beside it need no exchange of their own.

    In as many parts as the session shuffles into, which are not put together again: laps are few bytes in a shuffle, but
    each window of the stage behind it sorts a task's rows in memory of its own."""
    return laps.repartition(int(laps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "race")


def zones_of(grids: DataFrame, least_tyre_life: int = 8) -> DataFrame:
    """Who would come out of a stop behind whom at the moments of ``grids``, by each car's own track status."""
    e = emergence(grids, lambda each: F.col("trackStatus")).where((F.col("tyreLife") >= least_tyre_life) & F.col("carAhead").isNotNull())
    return e.select(
        "race", "driver", "lapNumber", "snapLap", "position", "emergencePosition", (F.col("emergencePosition") - F.col("position")).alias("positionsLost"), F.col("ahead.driver").alias("netRival"),
        "carAhead", F.round("gapToCar", 3).alias("gapToCar"), "carCompound", "carTyreLife", S.normalize_or_green(F.col("trackStatus")).alias("status"), "loss",
    )


def drop_zones(laps: DataFrame, least_tyre_life: int = 8) -> DataFrame:
    """At each new lap of a race: who would come out of a stop behind whom."""
    return zones_of(snapshots(by_race(laps)), least_tyre_life)


def pace_state(laps: DataFrame) -> DataFrame:
    """Stint best, pace ratio and its change, slow laps in a row and the change of the gap ahead, all within a stint;
    gaps count on green laps without a stop."""
    w = Window.partitionBy("race", "driver", "stint").orderBy("lapNumber")
    x = laps.withColumn("ct", F.when(clean(), F.col("lapTime"))).withColumn("best", F.min("ct").over(w.rowsBetween(UNBOUNDED, CURRENT)))
    x = x.withColumn("paceRatio", F.when(F.col("ct").isNotNull(), F.col("ct") / F.col("best") - 1.0)).withColumn("held", F.last("paceRatio", ignorenulls=True).over(w.rowsBetween(UNBOUNDED, -1)))
    x = x.withColumn("paceDelta", F.coalesce(F.col("paceRatio") - F.col("held"), F.lit(0.0))).withColumn("slow", (F.col("paceRatio") > 0.005).cast("int"))
    x = x.withColumn("run", F.sum(F.when(F.col("slow") == 0, 1).otherwise(0)).over(w.rowsBetween(UNBOUNDED, CURRENT)))
    x = x.withColumn("slowLaps", F.coalesce(F.sum("slow").over(Window.partitionBy("race", "driver", "stint", "run").orderBy("lapNumber").rowsBetween(UNBOUNDED, CURRENT)), F.lit(0)))
    free = F.col("pitInTime").isNull() & F.col("pitOutTime").isNull() & S.is_green(F.col("trackStatus")) & (F.col("gapToCarAhead") >= 0)
    x = x.withColumn("freeGap", F.when(free, F.col("gapToCarAhead")))
    gap = F.coalesce(F.col("freeGap") - F.last("freeGap", ignorenulls=True).over(w.rowsBetween(UNBOUNDED, -1)), F.lit(0.0))
    pace = F.coalesce("paceRatio", "held", F.lit(0.0))
    return x.withColumn("gapDelta", gap).withColumn("pace", pace).drop("ct", "held", "slow", "run", "paceRatio", "freeGap")


def scores_of(grids: DataFrame, least_tyre_life: int = 8) -> DataFrame:
    """The components of the score of a stop now, the score (0 to 100), the decision and its reasons, for each car of
    ``grids`` (with ``pace_state``) that is not in the pits and has worn tyres."""
    c = F.col
    e = emergence(grids, lambda each: c("now")).where((c("tyreLife") >= least_tyre_life) & c("pitInTime").isNull() & c("pitOutTime").isNull())
    boost = lambda car, points: F.when(c(car)["boxed"] & (F.abs(c("lapNumber") - c(car)["lapNumber"]) <= 1), points).otherwise(0.0)
    e = e.withColumn("rival", F.when(S.is_green(c("trackStatus")), F.least(F.lit(12.0), boost("ahead", 10.0) + boost("behind", 6.0))).otherwise(0.0))
    stint = lambda compound: F.coalesce(F.try_element_at("seen", compound).cast("double"), S.choose(F.upper(compound), S.MAX_STINT, 30.0))
    e = e.withColumn("paceScore", F.when(c("lapTime").isNotNull(), S.pace_score(c("pace"), c("slowLaps"))).otherwise(0.0)).withColumn("urgency", S.urgency_score(c("tyreLife"), F.when(c("compound").isNull(), 30.0).otherwise(stint(c("compound")))))
    e = e.withColumn("action", F.least(F.lit(30.0), c("urgency") + c("rival"))).withColumn("penalty", S.strategy_penalty(c("lapNumber"), c("totalLaps"), stint(S.choose(F.upper("compound"), S.NEXT_COMPOUND, "MEDIUM"))))
    e = e.withColumn("ending", S.end_of_race_penalty(c("lapNumber"), c("totalLaps"))).withColumn("status", S.track_status_score(c("now"))).withColumn("traffic", F.when(c("loss").isNull(), F.lit(0.0)).otherwise(S.traffic_score(c("gapToCar"), c("carTyreLife"))))
    e = e.withColumn("timing", S.timing_pressure(c("paceDelta"), c("gapDelta"), c("urgency"), c("penalty"), c("traffic"), c("status"), c("rival")))
    e = e.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), c("paceScore") + c("status") + c("traffic") + c("penalty") + c("action") + c("timing") + c("ending"))))
    label = S.decision_label(c("score"), c("paceScore"), c("urgency"), c("action"), c("traffic"), c("status"), c("penalty"), c("rival"), c("timing"), c("paceDelta"))
    why = S.explain_score(c("paceScore"), c("status"), c("traffic"), c("penalty"), c("action"), c("ending"), c("rival"), c("timing"))
    return e.withColumn("label", label).withColumn("why", why).drop("ahead", "behind", "seen")


def pit_scores(laps: DataFrame, status: DataFrame, of: tuple[str, ...] = ("lap",), least_tyre_life: int = 8) -> DataFrame:
    """``scores_of`` the grids at the moments of these kinds.

    ``status`` (race, eventTimeMillis, status) is the track's status, green before its first; a car's own laps decide
    on its pace and on the rivals' stops. Paces are settled before races are dealt: their sorts are in tasks of their own,
    which Spark cuts by size."""
    return scores_of(snapshots(by_race(pace_state(laps)), status, of), least_tyre_life)


def rival_at(laps: DataFrame, step: int) -> DataFrame:
    """The driver ``step`` places away on the same lap, else on the lap before, never the driver itself: two
    equi-joins on race, lap and position."""
    key = ["race", "lapNumber", "position"]
    own = laps.select(*key, "driver")
    found = own
    for back, name in ((0, "now"), (1, "past")):
        b = laps.select("race", (F.col("lapNumber") + back).alias("lapNumber"), (F.col("position") - step).alias("position"), F.col("driver").alias(name))
        found = found.join(b, key, "left")
    other = lambda n: F.when(F.col(n) != F.col("driver"), F.col(n))
    return found.groupBy("race", "driver", "lapNumber").agg(F.max(F.coalesce(other("now"), other("past"))).alias("rival"))


def directed_gap(laps: DataFrame, most: int = 6) -> DataFrame:
    """Signed distance between all pairs of cars of a lap at most ``most`` places apart; null across unknown gaps."""
    x = ladder(laps).select("race", "lapNumber", "driver", "position", "gapSum", "gapBlock")
    y = x.select("race", "lapNumber", F.col("driver").alias("other"), F.col("position").alias("p2"), F.col("gapSum").alias("s2"), F.col("gapBlock").alias("b2"))
    return x.join(y, ["race", "lapNumber"]).where(F.abs(F.col("p2") - F.col("position")).between(1, most)).select("race", "lapNumber", "driver", "other", F.when(F.col("b2") == F.col("gapBlock"), F.round(F.col("gapSum") - F.col("s2"), 3)).alias("gap"))


def field_median(laps: DataFrame) -> DataFrame:
    return laps.where(clean()).groupBy("race", "lapNumber").agg(F.percentile("lapTime", 0.5).alias("medianLap"))


def baseline_laps(laps: DataFrame, safe: float = 95.0) -> DataFrame:
    best = laps.where(clean()).groupBy("race", "driver", "stint").agg(F.min("lapTime").alias("best"))
    return laps.join(best, ["race", "driver", "stint"], "left").join(field_median(laps), ["race", "lapNumber"], "left").select("race", "driver", "lapNumber", F.coalesce("best", "medianLap", F.lit(safe)).alias("baseline"))


def moving_pace(laps: DataFrame, n: int = 4) -> DataFrame:
    x = laps.where(clean())
    return x.select("race", "driver", "lapNumber", F.avg("lapTime").over(race_driver().rowsBetween(-(n - 1), CURRENT)).alias("pace"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def dedup_keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; rows with an incomplete key pass."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return latest_per_key(df.where(whole), keys, order).unionByName(df.where(~whole))


def lift_coast(telemetry: DataFrame, window_ms: int = 4000, least_ms: int = 550, first_lap: int = 5) -> DataFrame:
    """Full throttle, then a lift, then the brake, in that order within ``window_ms``, in green samples after
    lap ``first_lap``; matches do not overlap, so no lift and brake come twice.

    For each start the first lift after it and the first brake after that. The walk over a driver's candidate ends,
    in time order, accepts at each end the earliest start that no accepted match has passed."""
    c = F.col
    green = telemetry.where(S.is_green(c("trackStatus")) & (c("lapNumber") > first_lap))
    # Backwards in time, so that what comes next is what came last.
    w = Window.partitionBy("race", "driver").orderBy(c("eventTimeMillis").desc()).rowsBetween(UNBOUNDED, -1)
    x = green.withColumn("nextBrake", F.last(F.when(c("brake") == 1, c("eventTimeMillis")), ignorenulls=True).over(w))
    lift = (c("throttle") < 5) & (c("brake") == 0)
    x = x.withColumn("lift", F.last(F.when(lift, F.struct(c("eventTimeMillis").alias("l"), c("nextBrake").alias("b"))), ignorenulls=True).over(w))
    starts = x.where("throttle >= 95 and speed >= 250 and nGear >= 6 and brake = 0 and lift.b is not null").where(c("lift.b") - c("eventTimeMillis") < window_ms)
    ends = starts.groupBy("race", "driver", c("lift.b").alias("b")).agg(F.array_sort(F.collect_list(F.struct(c("eventTimeMillis").alias("f"), c("lift.l").alias("l")))).alias("cand"))
    walk = ends.groupBy("race", "driver").agg(F.array_sort(F.collect_list(F.struct("b", "cand"))).alias("ends"))

    def step(acc, e):
        free = F.filter(e["cand"], lambda s: s["f"] > acc["last"])
        got = F.get(free, F.lit(0))
        hit = F.struct(got["f"].alias("f"), got["l"].alias("l"), e["b"].alias("b"))
        return F.when(F.size(free) > 0, F.struct(e["b"].alias("last"), F.concat(acc["hits"], F.array(hit)).alias("hits"))).otherwise(acc)

    zero = F.struct(F.lit(-1).cast("long").alias("last"), F.array().cast("array<struct<f:bigint,l:bigint,b:bigint>>").alias("hits"))
    hits = walk.select("race", "driver", F.explode(F.aggregate("ends", zero, step)["hits"]).alias("h"))
    return hits.select("race", "driver", c("h.f").alias("startMillis"), c("h.l").alias("liftMillis"), c("h.b").alias("brakeMillis"), (c("h.b") - c("h.l")).alias("coastMillis")).where(F.col("coastMillis") >= least_ms)
