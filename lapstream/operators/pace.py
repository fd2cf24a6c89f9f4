"""Pace of a car around a lap, against another car's and against the leader's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .laps import CURRENT, UNBOUNDED, clean, race_driver
from .pit_cycles import RECENT_LAPS, SAMPLES, SEARCH, SPAN

#: Laps looked back for a lap of the leader. Fixed value.
LEADER_BACK = 2
CAR = ["race", "driver", "lapNumber"]


def local_pace(laps: DataFrame, span: int, least: int) -> DataFrame:
    """(race, driver, lapNumber, pace): the mean clean lap of the ``span`` laps up to each lap, where at least ``least`` of them
    are clean; also for laps without a row of their own.

    A clean lap is dealt to the ``span`` laps that look back on it and averaged there, so one shuffle of partial sums."""
    dealt = laps.where(clean()).select("race", "driver", F.explode(F.sequence("lapNumber", F.col("lapNumber") + (span - 1))).alias("lapNumber"), "lapTime")
    return dealt.groupBy(*CAR).agg(F.avg("lapTime").alias("pace"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def relative_pace_gap(laps: DataFrame, pairs: DataFrame, span: int = SPAN, least: int = SAMPLES, search: int = SEARCH) -> DataFrame:
    """``pairs`` (race, driver, rival, lapNumber), each once, with ``anchor`` and ``paceGap``: the difference of both cars' local
    paces at the lap, or else at the nearest of ``search`` laps before and after (before first) where both have one;
    null where there is none."""
    c, key = F.col, ["race", "driver", "rival", "lapNumber"]
    steps = [0, *(s * d for d in range(1, search + 1) for s in (-1, 1))]
    asked = pairs.select(*key).distinct()
    # A car's paces around each lap in one row, made where its laps are: a pair meets two such rows, whatever ``search`` is.
    shifted = local_pace(laps.repartition("race", "driver"), span, least).withColumn("step", F.explode(F.array(*(F.lit(s) for s in steps)))).withColumn("lapNumber", c("lapNumber") - c("step"))
    near = shifted.groupBy(*CAR).agg(*(F.max(F.when(c("step") == s, c("pace"))).alias(f"p{i}") for i, s in enumerate(steps)))
    sides = {"own": "driver", "other": "rival"}
    for side, car in sides.items():
        asked = asked.join(near.select("race", c("driver").alias(car), "lapNumber", *(c(f"p{i}").alias(f"{side}{i}") for i in range(len(steps)))), ["race", car, "lapNumber"], "left")
    anchor = lambda s: c("lapNumber") + s
    best = F.coalesce(*(F.when((anchor(s) > 0) & c(f"own{i}").isNotNull() & c(f"other{i}").isNotNull(), F.struct(anchor(s).alias("anchor"), (c(f"own{i}") - c(f"other{i}")).alias("paceGap"))) for i, s in enumerate(steps)))
    return asked.withColumn("best", best).select(*key, "best.anchor", "best.paceGap")


def leader_pace_gap(laps: DataFrame, recent: int = RECENT_LAPS, search: int = LEADER_BACK) -> DataFrame:
    """(race, driver, lapNumber, pace, reference, paceGap) of each lap: the mean of the car's last ``recent`` clean laps, the
    leader's clean lap of that lap or of the nearest of ``search`` laps before, else the car's own mean up to the lap
    before, and the difference (null without either)."""
    last = Window.partitionBy("race", "driver").orderBy("lapNumber").rowsBetween(-(recent - 1), CURRENT)
    own = laps.where(clean()).select(*CAR, F.avg("lapTime").over(last).alias("mean"))
    upto = race_driver().rowsBetween(UNBOUNDED, CURRENT)
    x = laps.select(*CAR).join(own, CAR, "left").withColumn("pace", F.last("mean", ignorenulls=True).over(upto))
    x = x.withColumn("before", F.lag("pace").over(race_driver())).drop("mean")
    led = laps.where(clean() & (F.col("position") == 1)).groupBy("race", "lapNumber").agg(F.min("lapTime").alias("led"))
    seen = led.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(search)))).groupBy("race", (F.col("lapNumber") + F.col("back")).alias("lapNumber")).agg(F.min_by("led", "back").alias("led"))
    x = x.join(seen, ["race", "lapNumber"], "left").withColumn("reference", F.coalesce("led", "before"))
    return x.select(*CAR, "pace", "reference", F.when(F.col("reference") > 0, F.col("pace") - F.col("reference")).alias("paceGap"))
