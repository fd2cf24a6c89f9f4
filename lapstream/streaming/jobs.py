"""Structured Streaming: session windows, enrichment by a slow stream, stateful alerts with timers, live scoring."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import BASE_THRESHOLD
from ..operators.laps import asof_backward
from ..operators.ml import calibrated, load_bundle

LATENESS = "5 seconds"


def timed(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """With ``ts`` and its watermark. Later events are dropped by the windows behind it."""
    return stream.withColumn("ts", F.timestamp_millis("eventTimeMillis")).withWatermark("ts", lateness)


#: What a session keeps of a car's lap: the columns of rivals and of feature rows.
CAR = ["position", "driver", "gapToCarAhead", "tyreLife", "compound", "lapTime", "trackTemp", "pitLoss", "team", "trackStatus", "eventTimeMillis"]


def session_laps(laps: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """(race, lapNumber, w, cars): all cars of a lap once no more has come for ``gap``, cars by position."""
    return timed(laps).groupBy("race", "lapNumber", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_list(F.struct(*CAR))).alias("cars"))


def _each_car(sessions: DataFrame) -> tuple[DataFrame, Column, Column, list[Column]]:
    """A row for each car of a session, the cars ahead and behind, and its gaps."""
    x = sessions.select("race", "lapNumber", "w", "cars", F.posexplode("cars").alias("i", "car"))
    ahead, behind = F.get("cars", F.col("i") - 1), F.get("cars", F.col("i") + 1)
    gaps = [F.when(ahead.isNotNull(), F.abs("car.gapToCarAhead")).alias("gapAhead"), F.abs(behind["gapToCarAhead"]).alias("gapBehind")]
    return x, ahead, behind, gaps


def session_rivals(sessions: DataFrame) -> DataFrame:
    """The car ahead and behind from a session's cars; the same rows as the batch operator."""
    x, ahead, behind, gaps = _each_car(sessions)
    return x.select("race", "car.driver", "lapNumber", "car.position", ahead["driver"].alias("driverAhead"), behind["driver"].alias("driverBehind"), *gaps)


def session_features(sessions: DataFrame) -> DataFrame:
    """Feature rows of the same sessions: a car's lap with its gaps, and whether they are known."""
    x, _, _, gaps = _each_car(sessions)
    return x.select("race", "lapNumber", *(f"car.{c}" for c in CAR if c != "gapToCarAhead"), *gaps).withColumn("hasGapAhead", F.col("gapAhead").isNotNull()).withColumn("hasGapBehind", F.col("gapBehind").isNotNull())


def session_trains(sessions: DataFrame, close: float = 1.0, least: int = 3, gap: str = "10 seconds") -> DataFrame:
    """Trains of a lap from a second session window, ``gap`` behind the first one's output; the rows of ``drs_trains``.

    Sessions of one lap that are closer than ``gap`` become one; a train is a run of cars, each less than ``close``
    seconds behind the one before, found in the array of a lap's cars."""
    again = sessions.groupBy("race", "lapNumber", F.session_window(F.window_time("w"), gap).alias("w2")).agg(F.array_sort(F.flatten(F.collect_list("cars"))).alias("cars"))
    n = F.size("cars")
    heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~F.coalesce(F.get("cars", i)["gapToCarAhead"] < close, F.lit(False)))
    runs = F.transform(heads, lambda h, k: F.struct(h.alias("at"), (F.coalesce(F.get(heads, k + 1), n) - h).alias("size")))
    x = again.select("race", "lapNumber", "cars", F.explode(F.filter(runs, lambda r: r["size"] >= least)).alias("run"))
    own = F.slice("cars", F.col("run.at") + 1, F.col("run.size"))
    return x.select("race", "lapNumber", own[0]["position"].alias("head"), F.col("run.size").alias("size"), F.array_join(F.transform(own, lambda c: c["driver"]), ",").alias("drivers"))


class LateRows(StreamingQueryListener):
    """Counts, for each query (its name, else its id), the rows that its watermarks have dropped so far.

    Add it with ``spark.streams.addListener``; ``dropped`` then grows with every batch."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        self.dropped[p.name or str(p.id)] = self.dropped.get(p.name or str(p.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def enrich_each_batch(stream: DataFrame, status: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds"):
    """The latest status before each event. The slow stream is a table that each batch reads anew, so an idle status
    source holds nothing up."""

    def one(batch: DataFrame, number: int) -> None:
        joined = asof_backward(batch, status(), ["race"], "eventTimeMillis", ["status"])
        sink(joined.withColumn("status", F.coalesce("asof_status", F.lit("1"))).drop("asof_status"), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


TIRE_ALERT = "race string, driver string, lapNumber int, lapTime double, stintBest double, delta double"


def tire_drop_step(state: tuple, lap: tuple) -> tuple[tuple, tuple | None]:
    """(stint, best, slow laps) and a lap (number, stint, time, compound, total laps, track temperature)."""
    stint, best, slow = state
    number, s, time, compound, total, temp = lap
    if s != stint:
        stint, best, slow = s, float("inf"), 0
    if time > best * 1.07:
        return (stint, best, 0), None
    best = min(best, time)
    limit = BASE_THRESHOLD.get((compound or "").upper(), 0.015) - (0.003 * min(number / total, 1.0) if total > 0 else 0.0) - (0.002 if temp is not None and temp > 40 else 0.0)
    if time <= best * (1.0 + max(0.005, limit)):
        return (stint, best, 0), None
    if slow + 1 < 2:
        return (stint, best, slow + 1), None
    return (stint, best, 0), (number, time, best, time - best)


def tire_drops_stream(laps: DataFrame, ttl_ms: int = 2 * 3600 * 1000) -> DataFrame:
    """Tyre alerts of clean laps with state by race and driver, dropped ``ttl_ms`` after the last event."""

    def step(key: tuple, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else (-1, float("inf"), 0)
        rows = pd.concat(list(frames)).sort_values("lapNumber")
        out = []
        for r in rows.itertuples():
            temp = None if pd.isna(r.trackTemp) else r.trackTemp
            held, alert = tire_drop_step(held, (r.lapNumber, r.stint, r.lapTime, r.compound, r.totalLaps, temp))
            if alert:
                out.append((*key, *alert))
        state.update((int(held[0]), float(held[1]), int(held[2])))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["eventTimeMillis"].max())) + ttl_ms)
        yield pd.DataFrame(out, columns=["race", "driver", "lapNumber", "lapTime", "stintBest", "delta"])

    clean = timed(laps).where("lapTime > 0 and pitInTime is null and pitOutTime is null and coalesce(nullif(trim(trackStatus), ''), '1') = '1' and lapNumber > 2")
    return clean.groupBy("race", "driver").applyInPandasWithState(step, TIRE_ALERT, "stint int, best double, slow int", "append", GroupStateTimeout.EventTimeTimeout)


def serve(stream: DataFrame, bundle: str, path: str, checkpoint: str, version: int | None = None):
    """Live scoring: features aligned with the bundle's columns, probability, calibrated score, decision, as JSON messages
    (key, value) under ``path``.

    The bundle (``save_bundle``) is read once, its newest version unless one is given. A batch writes the folder of its
    own number and overwrites it if it is run again, so a restart from the checkpoint leaves each message once."""
    model, fitted, meta = load_bundle(stream.sparkSession, bundle, version)

    def one(batch: DataFrame, number: int) -> None:
        kept = [c for c in batch.columns if c not in meta["columns"]]
        text = {c for c, kind in batch.dtypes if kind == "string"}  # null is a category of its own
        aligned = batch.select(*kept, *(F.lit(0.0).alias(c) if c not in batch.columns else F.col(c) if c in text else F.coalesce(F.col(c), F.lit(0)).alias(c) for c in meta["columns"]))
        scored = calibrated(model.transform(aligned.withColumn("w", F.lit(1.0))).withColumn("raw_proba", vector_to_array("probability")[1]), fitted)
        said = scored.select(
            "race", "driver", "lapNumber", F.round("raw_proba", 6).alias("rawProba"), F.round("calibrated", 6).alias("predictionProba"), (F.col("calibrated") >= meta["threshold"]).cast("int").alias("prediction"),
            F.lit(meta["threshold"]).alias("threshold"), F.lit(meta["version"]).alias("modelVersion"), F.lit("ML_PIT_PREDICTION").alias("type"),
        )
        said.select(F.col("race").alias("key"), F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
