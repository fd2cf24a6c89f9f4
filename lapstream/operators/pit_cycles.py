"""Outcome of stops: each stop with its rival, when both have settled, and the change of the gap or of what stands for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .laps import CURRENT, UNBOUNDED, clean, ladder, race_driver, race_lap

#: Green laps until settled, laps without an evaluation, laps searched around one, laps looked back for the
#: rival's stop, share of the laps left until strategies count as different, milliseconds and laps of the safety timer.
SETTLE, WARMUP, SEARCH, LOOKBACK, OFFSET, TIMER, TIMER_LAPS = 4, 2, 3, 6, 0.4, 900_000, 5
#: Laps and least samples of a pace, laps of a recent pace, least gap and most places of an order that counts.
SPAN, SAMPLES, RECENT_LAPS, LEAST_GAP, MOST_PLACES = 4, 2, 3, 0.3, 6
#: Fixed value: baseline without a clean lap of the stint or of the field.
NO_BASELINE = 95.0
NEAR = [0, *(s * o for o in range(1, SEARCH + 1) for s in (-1, 1))]


def lap_lines(laps: DataFrame) -> DataFrame:
    """(race, driver, line): a car's laps in order as one array ``rows``, which a race bounds, with what the evaluation of
    stops looks up: time, place, stops, green laps so far, ladder of gaps, paces, traffic ahead, and a stop's own row.
    Beside it ``laps`` and ``greens`` alone, so that a row is found by its place in an array of integers."""
    c = F.col
    x = ladder(laps).withColumn("traffic", F.coalesce((F.lag("tyreLife").over(race_lap()) >= 25) & (c("gapToCarAhead") < 2.0), F.lit(False)))
    x = x.withColumn("ct", F.when(clean(), c("lapTime"))).withColumn("green", S.is_green(c("trackStatus")))
    span = race_driver().rangeBetween(-(SPAN - 1), 0)
    so_far = race_driver().rowsBetween(UNBOUNDED, CURRENT)
    x = x.withColumn("mark", c("pitInTime").isNotNull() | F.coalesce(c("stint") > F.lag("stint").over(race_driver()), F.lit(False)))
    x = x.withColumn("greens", F.sum(c("green").cast("int")).over(so_far)).withColumn("pace", F.when(F.count("ct").over(span) >= SAMPLES, F.avg("ct").over(span)))
    # The mean of the last clean laps, on every lap: clean laps are numbered, and the number of the last one finds it.
    x = x.withColumn("k", F.count("ct").over(so_far))
    recent = Window.partitionBy("race", "driver").orderBy("k").rangeBetween(-(RECENT_LAPS - 1), 0)
    x = x.withColumn("recent", F.when(c("k") > 0, F.avg("ct").over(recent)))
    fields = [c("lapNumber").alias("lap"), c("eventTimeMillis").alias("t"), "position", "mark", "pitInTime", "green", "greens", "gapSum", "gapBlock", "pace", "recent", "traffic", "compound", "stint", "ct", "trackStatus", "totalLaps"]
    x = x.groupBy("race", "driver").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    line = F.struct("rows", c("rows")["lap"].alias("laps"), c("rows")["greens"].alias("greens")).alias("line")
    return x.select("race", "driver", line).where("race is not null and driver is not null")


def courses(laps: DataFrame) -> DataFrame:
    """(race, course): arrays by lap of a race: when it began, the leader's last clean time in three laps, the median of clean
    times, and its cars by position."""
    c = F.col
    ct = F.when(clean(), c("lapTime"))
    x = laps.groupBy("race", "lapNumber").agg(
        F.collect_list(F.struct("position", "driver")).alias("cars"), F.min("eventTimeMillis").alias("begun"), F.percentile(ct, 0.5).alias("median"), F.max(F.when(c("position") == 1, ct)).alias("led"),
    )
    x = x.withColumn("leader", F.last("led", ignorenulls=True).over(Window.partitionBy("race").orderBy("lapNumber").rangeBetween(-2, 0)))
    x = x.groupBy("race").agg(F.sort_array(F.collect_list(F.struct("lapNumber", "begun", "leader", "median", "cars"))).alias("all"))
    return x.select("race", F.struct(c("all")["lapNumber"].alias("laps"), *(c("all")[k].alias(k) for k in ("begun", "leader", "median", "cars"))).alias("course"))


def on_course(lap: Column, what: str) -> Column:
    return F.get(F.col("course")[what], (F.array_position(F.col("course")["laps"], lap) - 1).cast("int"))


def neighbour(step: int) -> Column:
    """The driver ``step`` places away on the stop's lap, else on the lap before, never the driver itself."""
    c = F.col
    there = lambda cars: F.transform(F.filter(cars, lambda x: x["position"] == c("position") + step), lambda x: x["driver"])
    others = lambda cars: F.array_max(F.filter(there(cars), lambda d: d != c("driver")))
    now, past = on_course(c("pitLap"), "cars"), on_course(c("pitLap") - 1, "cars")
    either = F.when(F.exists(there(now), lambda d: d.isNull() | (d == c("driver"))), F.greatest(others(now), others(past)))
    return either.otherwise(F.coalesce(others(now), others(past)))


def at(line: Column, lap: Column) -> Column:
    """The row of a lap, null if there is none."""
    return F.get(line["rows"], (F.array_position(line["laps"], lap) - 1).cast("int"))


def first_of(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def gap_of(own: Column, rival: Column) -> Column:
    """Signed distance of two cars on a lap (negative: ahead of the rival), null across unknown gaps or over six places."""
    return F.when((own["gapBlock"] == rival["gapBlock"]) & (F.abs(own["position"] - rival["position"]) <= MOST_PLACES), F.round(own["gapSum"] - rival["gapSum"], 3))


def near(lap: Column, offsets: list[int], value, until: Column | None = None, rival: str = "rivalLine") -> Column:
    """The first known value(own, rival) on the laps ``lap`` + offset, in that order; rows after ``until`` are not seen.
    Both rows of each lap are looked up once, before ``value`` reads their fields."""
    pairs = F.array(*(F.struct(at(F.col("line"), lap + o).alias("a"), at(F.col(rival), lap + o).alias("b")) for o in offsets))

    def one(p: Column) -> Column:
        a, b = p["a"], p["b"]
        return value(a, b) if until is None else F.when((a["t"] <= until) & (b["t"] <= until), value(a, b))

    return first_of(F.transform(pairs, one))


def settle_lap(line: Column, pit: Column) -> Column:
    """The row of the fourth green lap after a stop: the first one with four more green laps so far."""
    return F.get(line["rows"], (F.array_position(line["greens"], at(line, pit)["greens"] + SETTLE) - 1).cast("int"))


def rival_pit_search(line: Column, pit: Column) -> tuple[Column, Column]:
    """The rival's first stop in the laps before (the stop's own included), and its first one after."""
    rows = line["rows"]
    before = F.get(F.filter(rows, lambda x: x["pitInTime"].isNotNull() & x["lap"].between(pit - LOOKBACK, pit)), F.lit(0))["lap"]
    return before, F.get(F.filter(rows, lambda x: x["mark"] & (x["lap"] > pit)), F.lit(0))["lap"]


def pct_of(pre: Column, post: Column, baseline: Column) -> Column:
    """Change of a gap in per cent of a lap; null for gaps over a minute or changes over 45 seconds."""
    whole = (F.abs(pre) <= 60) & (F.abs(post) <= 60) & (F.abs(post - pre) <= 45) & (baseline > 0)
    return F.when(whole, (post - pre) / baseline * 100)


def not_pending(stops: DataFrame) -> DataFrame:
    """Without the stops (race, driver, pitLap, t0, resolvedAt) of a driver whose last evaluated stop is still open: a fold
    over a driver's stops in order of time, since a stop that is left out keeps none open."""
    stop = F.struct("t0", "pitLap", "resolvedAt")
    start = F.struct(F.lit(None).cast("bigint").alias("open"), F.array().cast("array<int>").alias("laps"))

    def step(acc, s):
        free = acc["open"].isNull() | (s["t0"] > acc["open"])
        taken = F.struct(s["resolvedAt"].alias("open"), F.concat(acc["laps"], F.array(s["pitLap"])).alias("laps"))
        return F.when(free, taken).otherwise(acc)

    kept = F.aggregate(F.array_sort(F.collect_list(stop).over(Window.partitionBy("race", "driver"))), start, step)["laps"]
    return stops.withColumn("__laps", kept).where(F.array_contains("__laps", F.col("pitLap"))).drop("__laps")


def pit_cycles(laps: DataFrame) -> DataFrame:
    """One row for each stop: rival, gaps, delta in per cent of a lap, label, and how it was resolved.

    The rival is the car ahead, or the one behind where that has no known gap or the leader stops. If the rival stopped in
    the six laps before, or stops before the offset lap (40 per cent of the laps left), gaps are compared on the later of
    the two settled laps (RIVAL_PIT). If it does not stop by then, the gap there decides (OFFSET_TIMEOUT). What neither
    settles within 15 minutes is compared in the five laps after the driver settled (SAFETY_TIMER). Where no gap is known,
    the change of relative pace stands for it (.._PACE_SHIFT), then a change of order (POSITIONAL_FALLBACK); without any
    rival, pace against the leader (REFERENCE_FALLBACK). Else EARLY_LAP_FILTER or INSUFFICIENT_DATA.

    A stop while the driver's last one is still open is not evaluated (``not_pending``). A race becomes one
    row of its cars' laps, which a race bounds: a stop and all it looks up are in it, and nothing that carries laps is dealt
    again. A lap that has no row has no pace. Laps with neither race nor driver are left
    out.
    """
    c, lit = F.col, F.lit
    race = lap_lines(laps).groupBy("race").agg(F.collect_list(F.struct("driver", "line")).alias("cars")).join(courses(laps), "race")
    stopped_at = lambda car: F.transform(F.filter(car["line"]["rows"], lambda x: x["pitInTime"].isNotNull()), lambda x: F.struct(car["driver"].alias("driver"), x.alias("row")))
    line_of = lambda driver: F.get(F.filter("cars", lambda car: car["driver"] == driver), lit(0))["line"]
    s = race.select("race", "cars", "course", F.explode(F.flatten(F.transform("cars", stopped_at))).alias("stop"))
    s = s.select("race", "stop.driver", "cars", "course", c("stop.row.lap").alias("pitLap"), "stop.row.position", "stop.row.trackStatus", "stop.row.totalLaps", c("stop.row.t").alias("t0"), "stop.row.stint", line_of(c("stop.driver")).alias("line"))
    s = s.withColumn("ahead", neighbour(-1)).withColumn("behind", neighbour(1))
    s = s.select("*", line_of(c("ahead")).alias("aheadLine"), line_of(c("behind")).alias("behindLine")).drop("cars")
    pit = c("pitLap")
    best = F.array_min(F.transform(F.filter(c("line")["rows"], lambda x: x["stint"] == c("stint")), lambda x: x["ct"]))
    s = s.withColumn("baseline", F.coalesce(best, on_course(pit, "median"), lit(NO_BASELINE)))

    # Of both neighbours the first one whose gap before the stop is known is the rival, else the first one.
    s = s.withColumn("gapAhead", near(pit, NEAR, gap_of, rival="aheadLine")).withColumn("gapBehind", near(pit, NEAR, gap_of, rival="behindLine"))
    turned = c("ahead").isNull() | (c("gapAhead").isNull() & c("gapBehind").isNotNull())
    pick = lambda a, b: F.when(turned, c(b)).otherwise(c(a))
    s = s.select("*", pick("ahead", "behind").alias("rival"), pick("aheadLine", "behindLine").alias("rivalLine"), pick("gapAhead", "gapBehind").alias("preGap")).drop("ahead", "behind", "aheadLine", "behindLine", "gapAhead", "gapBehind")

    before, after = rival_pit_search(c("rivalLine"), pit)
    s = s.withColumn("own", settle_lap(c("line"), pit)).withColumn("settled", F.coalesce(c("own")["lap"], pit + SETTLE)).withColumn("before", before).withColumn("after", after)
    s = s.withColumn("offsetLap", F.greatest(pit + F.ceil(F.greatest(lit(1), c("totalLaps") - pit) * OFFSET), c("own")["lap"]).cast("int"))
    s = s.withColumn("answered", c("before").isNotNull() | F.coalesce(c("after") <= c("offsetLap"), lit(False))).withColumn("rivalPitLap", F.coalesce("before", "after"))
    s = s.withColumn("other", F.when(c("answered"), settle_lap(c("rivalLine"), c("rivalPitLap"))))
    s = s.withColumn("begun", on_course(c("offsetLap"), "begun"))
    due, own_t = c("t0") + TIMER, c("own")["t"]
    ready = F.when(c("own").isNotNull() & c("other").isNotNull(), F.greatest(own_t, c("other")["t"]))
    timeout = F.when(c("own").isNotNull() & c("begun").isNotNull(), F.greatest(own_t, c("begun")))
    case = F.when(pit <= WARMUP, "early").when(c("preGap").isNull(), "alone").when(c("answered") & (ready <= due), "rival").when(~c("answered") & (timeout <= due), "offset").otherwise("timer")
    s = s.withColumn("case", case).withColumn("resolvedAt", F.when(case == "early", c("t0")).when(case == "alone", F.coalesce(F.least(own_t, due), due)).when(case == "rival", ready).when(case == "offset", timeout).otherwise(due))
    s = s.withColumn("seen", F.when(c("case") == "rival", ready).otherwise(timeout))
    is_ = lambda name: c("case") == name
    s = s.withColumn("compareLap", F.when(is_("rival"), F.greatest(c("own")["lap"], c("other")["lap"])).when(is_("offset"), c("offsetLap")).otherwise(c("settled")))

    lap = c("compareLap")
    gap = F.when(is_("rival"), F.coalesce(near(lap, NEAR, gap_of, c("seen")), near(lap, NEAR, gap_of), near(c("settled"), NEAR, gap_of)))
    gap = gap.when(is_("offset"), near(lap, [*NEAR, -SEARCH - 1], gap_of, c("seen"))).when(is_("timer"), near(lap, list(range(TIMER_LAPS, -1, -1)), gap_of, due))
    apart = lambda a, b: a["pace"] - b["pace"]
    s = s.withColumn("gap", gap).withColumn("paceBefore", near(F.greatest(lit(1), pit - 1), NEAR, apart)).withColumn("paceAfter", near(lap, NEAR, apart))
    mine = lambda n: at(c("line"), n)
    against = lambda n: mine(n)["recent"] - F.coalesce(on_course(n, "leader"), mine(n - 1)["recent"])
    s = s.withColumn("refBefore", F.when(is_("alone"), against(F.greatest(lit(1), pit - 1)))).withColumn("refAfter", F.when(is_("alone"), against(lap)))
    places = near(lap, NEAR, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct((a["position"] < b["position"]).alias("ahead"), (a["green"] & b["green"] & (F.abs(a["position"] - b["position"]) <= MOST_PLACES)).alias("fair"))))
    stopped = c("before").isNotNull() | F.coalesce(c("after") <= lap + SEARCH, lit(False))
    flipped = places["fair"] & (F.abs(c("preGap")) >= LEAST_GAP) & ((c("preGap") < 0) != places["ahead"]) & (is_("rival") | (is_("timer") & stopped))
    s = s.withColumn("flip", F.when(flipped, places["ahead"]))

    base, traffic, compound = c("baseline"), c("traffic"), c("compound")
    after_stop = F.get(F.filter(c("line")["rows"], lambda x: x["lap"] > pit), lit(0))["compound"]
    s = s.withColumn("traffic", F.coalesce(mine(c("settled"))["traffic"], lit(False))).withColumn("compound", after_stop)
    s = s.withColumn("byGap", pct_of(c("preGap"), c("gap"), base)).withColumn("byPace", pct_of(c("paceBefore"), c("paceAfter"), base)).withColumn("byRef", pct_of(c("refBefore"), c("refAfter"), base))
    first = c("answered") & (pit <= c("rivalPitLap"))
    stop = lambda pre, post: S.classify_stop(pre, post, base, first, c("trackStatus"), compound, traffic)
    band = lambda d: F.when(F.abs(d) > 20, "UNRESOLVED_INCIDENT_FILTER").when(d < -0.5, "OFFSET_ADVANTAGE").when(d > 0.5, "OFFSET_DISADVANTAGE").otherwise("SUCCESS_DEFEND")
    ref = F.when(F.upper(compound).isin("INTERMEDIATE", "WET"), "WEATHER_SURVIVAL_STOP").when(c("byRef").isNull(), "UNRESOLVED_MISSING_POST_GAP").when(F.abs(c("byRef")) > 20, "UNRESOLVED_INCIDENT_FILTER")
    ref = ref.when(S.is_caution(c("trackStatus")) & (F.abs(c("byRef")) < 1), "SUCCESS_FREE_STOP").when(c("byRef") <= 0.5, "SUCCESS_DEFEND").otherwise("FAILURE_PACE_DEFICIT")
    by_order = F.when(c("flip"), F.when(first, "SUCCESS_UNDERCUT").otherwise("SUCCESS_OVERCUT")).otherwise(F.when(traffic, "FAILURE_TRAFFIC").otherwise("FAILURE_PACE_DEFICIT"))
    answer = lambda result, how, post=lit(None), delta=lit(None): F.struct(result.alias("result"), (lit(how) if isinstance(how, str) else how).alias("how"), post.cast("double").alias("post"), delta.cast("double").alias("delta"))
    lacking = lambda what: answer(lit(what), "INSUFFICIENT_DATA")
    got = (
        F.when(is_("early"), answer(lit("UNRESOLVED_EARLY_LAP"), "EARLY_LAP_FILTER"))
        .when(is_("alone") & c("refBefore").isNull() & c("rival").isNull(), lacking("UNRESOLVED_MISSING_RIVAL"))
        .when(is_("alone") & c("refBefore").isNull(), lacking("UNRESOLVED_MISSING_PRE_GAP"))
        .when(is_("alone") & c("refAfter").isNull(), lacking("UNRESOLVED_MISSING_POST_GAP"))
        .when(is_("alone"), answer(ref, "REFERENCE_FALLBACK", c("refAfter"), c("byRef")))
        .when(is_("offset") & c("byGap").isNotNull(), answer(band(c("byGap")), "OFFSET_TIMEOUT", c("gap"), c("byGap")))
        .when(is_("offset") & c("byPace").isNotNull(), answer(band(c("byPace")), "OFFSET_TIMEOUT_PACE_SHIFT", c("paceAfter"), c("byPace")))
        .when(is_("offset"), answer(lit("UNRESOLVED_MISSING_POST_GAP"), "OFFSET_TIMEOUT", c("gap")))
        .when(c("gap").isNotNull(), answer(stop(c("preGap"), c("gap")), F.when(is_("rival"), "RIVAL_PIT").otherwise("SAFETY_TIMER"), c("gap"), c("byGap")))
        .when(c("byPace").isNotNull(), answer(stop(c("paceBefore"), c("paceAfter")), F.when(is_("rival"), "RIVAL_PIT_PACE_SHIFT").otherwise("SAFETY_TIMER_PACE_SHIFT"), c("paceAfter"), c("byPace")))
        .when(c("flip").isNotNull(), answer(by_order, "POSITIONAL_FALLBACK"))
        .otherwise(lacking("UNRESOLVED_MISSING_POST_GAP"))
    )
    s = s.withColumn("got", got)
    s = not_pending(s.select("race", "driver", "pitLap", "t0", "resolvedAt", "rival", "answered", "rivalPitLap", "compareLap", "preGap", "got", is_("offset").alias("offset"), first.alias("first")))
    return s.select(
        "race", "driver", "pitLap", "rival", F.when(c("answered"), c("rivalPitLap")).alias("rivalPitLap"), "compareLap", "preGap", F.round("got.post", 3).alias("postGap"), F.round("got.delta", 4).alias("gapDeltaPct"),
        F.col("got.how").alias("resolution"), c("offset").alias("offsetStrategy"), F.coalesce("first", lit(False)).alias("pittedFirst"), F.col("got.result").alias("result"),
    )
