"""Keyed state machines on streams: grids at moments, serving features, stops with timers.

They need the RocksDB state store (``with_state``). Rows of a key wait until the watermark has passed them, so what
comes out does not depend on the order of arrival within the lateness that the watermark allows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import scalars as S
from ..operators import pit_cycles as C
from ..operators.laps import RECENT, clean, scores_of, zones_of

LATENESS = "5 seconds"
#: Milliseconds without an event after which a key's state goes.
LIFETIME = 2 * 3600 * 1000


def with_state(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def keyed_events(parts: dict[str, DataFrame], lateness: str = LATENESS) -> DataFrame:
    """(race, kind, t, payload, ts): streams of several kinds as one keyed stream.

    They share one watermark behind the union, the latest event of any of them, so a kind that is silent for hours
    (track status) holds nothing up."""
    out = None
    for kind, df in parts.items():
        x = df.select("race", F.lit(kind).alias("kind"), F.col("eventTimeMillis").alias("t"), F.to_json(F.struct("*")).alias("payload"))
        out = x if out is None else out.unionByName(x)
    return out.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", lateness)


class InOrder(StatefulProcessor):
    """Holds the events of a race back until the watermark has passed them, and hands them on in order of time.

    Events of one millisecond are handed on together. ``LIFETIME`` after its last event a race is forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, kind string, payload string")
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for frame in rows:
            new = [(int(t), kind, payload) for t, kind, payload in zip(frame["t"], frame["kind"], frame["payload"])]
            if new:
                self.waiting.appendList(new)
                times.update(x[0] for x in new)
        if times:
            newest = max(times | ({self.last.get()[0]} if self.last.exists() else set()))
            self.last.update((newest,))
            for t in times | {newest + LIFETIME}:
                self.handle.registerTimer(t)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get())
        due = [r for r in rows if r[0] <= now]
        if due:
            rest = [tuple(r) for r in rows if r[0] > now]
            self.waiting.put(rest) if rest else self.waiting.clear()
            by_time: dict[int, list] = {}
            for t, kind, payload in due:
                by_time.setdefault(t, []).append((kind, json.loads(payload)))
            yield from self.at(key, by_time)
        yield from self.on_timer(key, expiredTimerInfo.getExpiryTimeInMs(), now)
        if self.last.exists() and self.last.get()[0] + LIFETIME <= now:
            self.forget()

    def at(self, key, by_time: dict[int, list]) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def on_timer(self, key, due: int, now: int) -> Iterator[pd.DataFrame]:
        return iter([])

    def forget(self) -> None:
        self.waiting.clear()
        self.last.clear()

    def close(self) -> None:
        pass


GRID = "race string, kind string, snapMillis long, snapLap int, now string, seen string, cars string"


def pace_step(held: dict | None, row: dict) -> dict:
    """What ``pace_state`` says at a lap, from what it said at the driver's last one; a new stint starts anew."""
    if held is None or held["stint"] != row["stint"]:
        held = {"stint": row["stint"], "best": None, "ratio": None, "slow": 0, "gap": None}
    best, ratio, gap = held["best"], None, row.get("gapToCarAhead")
    if row["isClean"]:
        best = row["lapTime"] if best is None else min(best, row["lapTime"])
        ratio = row["lapTime"] / best - 1.0
    slow = held["slow"] if ratio is None else held["slow"] + 1 if ratio > 0.005 else 0
    free = gap if row["isFree"] and gap is not None and gap >= 0 else None
    now = {"stint": row["stint"], "best": best, "ratio": held["ratio"] if ratio is None else ratio, "slow": slow, "gap": held["gap"] if free is None else free}
    said = {
        "best": best, "slowLaps": slow, "pace": now["ratio"] or 0.0, "paceDelta": ratio - held["ratio"] if ratio is not None and held["ratio"] is not None else 0.0,
        "gapDelta": free - held["gap"] if free is not None and held["gap"] is not None else 0.0,
    }
    return now | {"said": said}


class Grids(InOrder):
    """A race's latest rows by driver; the grid of them when the highest lap rises and when a caution is called."""

    def init(self, handle):
        super().init(handle)
        self.race = handle.getValueState("race", "top int, now string")
        self.cars = handle.getMapState("cars", "driver string", "row string, pace string")
        self.worn = handle.getMapState("worn", "compound string", "n int")

    def at(self, key, by_time):
        top, now = self.race.get() if self.race.exists() else (0, S.GREEN)
        cars = {k[0]: [json.loads(x) for x in v] for k, v in self.cars.iterator()}
        worn = {k[0]: v[0] for k, v in self.worn.iterator()}
        out, touched, older = [], set(), set()
        for t, events in sorted(by_time.items()):
            laps = [e for kind, e in events if kind == "lap"]
            calls = [e.get("code") or S.GREEN for kind, e in events if kind == "status"]
            now = calls[-1] if calls else now
            for row in sorted(laps, key=lambda r: r["lapNumber"]):
                driver = row.get("driver")
                if driver is None:
                    continue
                pace = pace_step(cars[driver][1] if driver in cars else None, row)
                cars[driver] = [row | pace.pop("said"), pace]
                touched.add(driver)
                if row.get("compound") is not None and row.get("tyreLife") is not None and row["tyreLife"] > worn.get(row["compound"], -1):
                    worn[row["compound"]] = row["tyreLife"]
                    older.add(row["compound"])
            high = max([r["lapNumber"] for r in laps if r.get("driver") is not None and r["lapNumber"] > 0], default=0)
            raised, top = high > top and high > 1, max(top, high)
            moments = [("lap", top)] if raised else []
            if any(c in S.CAUTION for c in calls) and top > 1:
                moments.append(("caution", top - 1))
            for kind, lap in moments:
                grid = sorted((c[0] for c in cars.values() if c[0]["lapNumber"] >= lap - RECENT), key=lambda r: (r.get("position") is not None, r.get("position") or 0, r["driver"]))
                out.append((key[0], kind, t, lap, now, json.dumps(worn), json.dumps(grid)))
        self.race.update((top, now))
        for d in touched:
            self.cars.updateValue((d,), tuple(json.dumps(x) for x in cars[d]))
        for c in older:
            self.worn.updateValue((c,), (worn[c],))
        if out:
            yield pd.DataFrame(out, columns=["race", "kind", "snapMillis", "snapLap", "now", "seen", "cars"])

    def forget(self):
        super().forget()
        for state in (self.race, self.cars, self.worn):
            state.clear()


def _marked(laps: DataFrame) -> DataFrame:
    free = F.col("pitInTime").isNull() & F.col("pitOutTime").isNull() & S.is_green(F.col("trackStatus"))
    return laps.withColumn("isClean", clean()).withColumn("isFree", free)


def grids_stream(laps: DataFrame, status: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The rows of ``snapshots`` over ``pace_state``, of both kinds, from streams of laps and of track status."""
    marked = _marked(laps)
    code = status.select("race", "eventTimeMillis", S.normalize_or_green(F.col("status")).alias("code"))
    events = keyed_events({"lap": marked, "status": code}, lateness)
    said = [StructField("best", DoubleType()), StructField("paceDelta", DoubleType()), StructField("slowLaps", LongType()), StructField("gapDelta", DoubleType()), StructField("pace", DoubleType())]
    car = StructType([*laps.schema.fields, *said])
    out = events.groupBy("race").transformWithStateInPandas(Grids(), GRID, "Append", "EventTime")
    return out.withColumn("seen", F.from_json("seen", "map<string,int>")).withColumn("cars", F.from_json("cars", ArrayType(car)))


def drop_zones_stream(laps: DataFrame, status: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The rows of ``drop_zones``: one expression for batch and stream, on grids that the stream's state gives."""
    return zones_of(grids_stream(laps, status, lateness).where("kind = 'lap'"))


def pit_scores_stream(laps: DataFrame, status: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The rows of ``pit_scores`` at new laps and under caution."""
    return scores_of(grids_stream(laps, status, lateness))


FEATURES = "race string, driver string, lapNumber int, stintId int, stintBest double, paceDropRatio double, tireLifeRatio double, paceTrend double, gapTrend double, lapTimeZ double, driverPrevMeanRatio double, teamPrevRatio double, racePrevRatio double"
_FEATURE_NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def clipped(x: float | None, default: float, lo: float, hi: float) -> float:
    """``clip_ratio`` of one value."""
    return default if x is None or x != x or x in (float("inf"), float("-inf")) else min(max(x, lo), hi)


def _over(a: float | None, b: float | None) -> float | None:
    return a / b if a is not None and b else None


def _mean(pairs: list[tuple[float, int]]) -> float | None:
    """The mean of the means of (sum, count) pairs."""
    means = [s / n for s, n in pairs if n]
    return sum(means) / len(means) if means else None


def stint_step(held: dict | None, row: dict) -> dict:
    """Stint, its best lap and the last values of a driver after a lap, from those before it."""
    held = held or {"lap": None, "id": 0, "tyre": None, "compound": None, "best": None, "pace": [], "gap": [], "sum": 0.0, "n": 0}
    time, tyre = row.get("lapTime"), row.get("tyreLife")
    new = held["lap"] is None or (tyre is not None and held["tyre"] is not None and tyre < held["tyre"]) or row.get("compound") != held["compound"]
    best = None if new else held["best"]
    if time is not None:
        best = time if best is None else min(best, time)
    ratio = clipped(_over(time, best), 1.0, 0.5, 2.0)
    gap, before = row.get("gapToCarAhead"), held["gap"]
    said = {
        "stintId": held["id"] + new, "stintBest": best, "paceDropRatio": ratio, "paceTrend": ratio - held["pace"][-2] if len(held["pace"]) >= 2 else 0.0,
        "tireLifeRatio": clipped(_over(tyre, S.MAX_STINT.get((row.get("compound") or "").upper(), 30.0)), 0.0, 0.0, 3.0),
        "gapTrend": gap - before[-2] if len(before) >= 2 and gap is not None and before[-2] is not None else 0.0,
        "driverPrevMeanRatio": clipped(_over(time, held["sum"] / held["n"] if held["n"] else None), 1.0, 0.5, 2.0),
    }
    return {
        "lap": row["lapNumber"], "id": said["stintId"], "tyre": tyre, "compound": row.get("compound"), "best": best, "pace": [*held["pace"], ratio][-2:], "gap": [*before, gap][-2:],
        "sum": held["sum"] + (time or 0.0), "n": held["n"] + (time is not None), "said": said,
    }


@dataclass
class Features(StatefulProcessor):
    """Serving features of a race's laps as they come: what ``stint_features``, ``lag2_trend``, ``expanding_z``,
    ``driver_prev_mean_ratio`` and ``bucket_prev_ratio`` say of them, from running sums instead of the laps themselves.

    Laps of one batch are taken in order of lap and driver. A lap that comes again replaces what it gave before. Each
    state has a lifetime since it was last written: the store drops it without a word from here."""

    lifetime: int = LIFETIME
    state: dict = field(default_factory=dict, repr=False)

    def init(self, handle):
        life = self.lifetime
        self.drivers = handle.getMapState("drivers", "driver string", "before string, after string", life)
        self.laps = handle.getMapState("laps", "driver string, lap int", "time double, team string", life)
        self.buckets = handle.getMapState("buckets", "team string, lap int", "sum double, n int", life)
        self.sums = handle.getValueState("sums", "n int, sum double, squares double", life)

    def handleInputRows(self, key, rows, timerValues):
        events = [{k: v for k, v in r.items() if v is not None and v == v} for frame in rows for r in frame.to_dict("records")]
        events = sorted((e for e in events if "driver" in e and "lapNumber" in e), key=lambda e: (e["lapNumber"], e["driver"]))
        if not events:
            return
        buckets = {tuple(k): tuple(v) for k, v in self.buckets.iterator()}
        n, total, squares = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0)
        out, touched = [], set()
        for e in events:
            driver, lap, time, team = e["driver"], int(e["lapNumber"]), e.get("lapTime"), e.get("team")
            if self.laps.containsKey((driver, lap)):
                old, old_team = self.laps.getValue((driver, lap))
                if old is not None:
                    n, total, squares = n - 1, total - old, squares - old * old
                    for b in ((old_team, lap), (None, lap)) if old_team is not None else ((None, lap),):
                        buckets[b] = (buckets.get(b, (0.0, 0))[0] - old, buckets.get(b, (0.0, 0))[1] - 1)
                        touched.add(b)
            before, after = (json.loads(x) for x in self.drivers.getValue((driver,))) if self.drivers.containsKey((driver,)) else (None, None)
            base = before if after is not None and after["lap"] == lap else after
            now = stint_step(base, e | {"lapNumber": lap})
            said = now.pop("said")
            if after is None or lap >= after["lap"]:
                self.drivers.updateValue((driver,), (json.dumps(base), json.dumps(now)))
            mean = total / n if n else 0.0
            var = squares / n - mean * mean if n else 0.0
            z = (time - mean) / var**0.5 if n >= 2 and var > 1e-12 and time is not None else 0.0 if n < 2 or var <= 1e-12 else None
            past = lambda t: _mean([v for (name, k), v in buckets.items() if name == t and k < lap])
            ratios = [clipped(_over(time, past(t)), 1.0, 0.5, 2.0) for t in (team, None)]
            out.append((key[0], driver, lap, said["stintId"], said["stintBest"], said["paceDropRatio"], said["tireLifeRatio"], said["paceTrend"], said["gapTrend"], z, said["driverPrevMeanRatio"], ratios[0] if team is not None else 1.0, ratios[1]))
            self.laps.updateValue((driver, lap), (time, team))
            if time is not None:
                n, total, squares = n + 1, total + time, squares + time * time
                for b in ((team, lap), (None, lap)) if team is not None else ((None, lap),):
                    s, k = buckets.get(b, (0.0, 0))
                    buckets[b] = (s + time, k + 1)
                    touched.add(b)
        for b in touched:
            self.buckets.updateValue(b, buckets[b])
        self.sums.update((n, total, squares))
        yield pd.DataFrame(out, columns=_FEATURE_NAMES)

    def close(self):
        pass


def features_stream(laps: DataFrame, lifetime: int = LIFETIME) -> DataFrame:
    """``Features`` of a stream of laps, keyed by race.

    A lifetime counts processing time, for which Spark makes batches without data as long as the query runs; a query that
    is to end with its input (``availableNow``) needs ``spark.sql.streaming.noDataMicroBatches.enabled=false``."""
    read = laps.select("race", "driver", "lapNumber", "lapTime", "tyreLife", "compound", "gapToCarAhead", "team").where("driver is not null and lapNumber > 0")
    return read.groupBy("race").transformWithStateInPandas(Features(lifetime), FEATURES, "Append", "ProcessingTime")


RESOLVED = "race string, driver string, pitLap int, resolvedAt long, laps string"


class Field:
    """What a race's laps so far say of a stop: rival, settled laps, and when it can be resolved."""

    def __init__(self, rows: list[dict]) -> None:
        self.cars: dict[str, list[dict]] = {}
        self.order: dict[int, dict[str, tuple]] = {}
        by_lap: dict[int, list[dict]] = {}
        for r in sorted(rows, key=lambda r: (r["lapNumber"], r["eventTimeMillis"])):
            line = self.cars.setdefault(r["driver"], [])
            r["mark"] = r.get("pitInTime") is not None or bool(line and (r.get("stint") or 0) > (line[-1].get("stint") or 0))
            line.append(r)
            by_lap.setdefault(r["lapNumber"], []).append(r)
        self.begun = {n: min(r["eventTimeMillis"] for r in rs) for n, rs in by_lap.items()}
        for n, rs in by_lap.items():
            total, unknown, ladder = 0.0, 0, {}
            for r in sorted(rs, key=lambda r: (r.get("position") or 0, r["driver"])):
                gap = r.get("gapToCarAhead")
                total, unknown = total + (gap or 0.0), unknown + (gap is None)
                ladder[r["driver"]] = (total, unknown, r.get("position"))
            self.order[n] = ladder

    def gap_near(self, a: str, b: str, lap: int) -> bool:
        """Whether a gap of two cars is known on a lap or near it."""
        for o in C.NEAR:
            x, y = (self.order.get(lap + o, {}).get(d) for d in (a, b))
            if x and y and x[1] == y[1] and x[2] is not None and y[2] is not None and abs(x[2] - y[2]) <= C.MOST_PLACES:
                return True
        return False

    def beside(self, driver: str, lap: int, position: int, step: int) -> str | None:
        for n in (lap, lap - 1):
            found = [d for d, (_, _, p) in self.order.get(n, {}).items() if p == position + step and d != driver]
            if found:
                return max(found)
        return None

    def settled(self, driver: str, lap: int) -> dict | None:
        greens = [r for r in self.cars.get(driver, []) if r["lapNumber"] > lap and r["isGreen"]]
        return greens[C.SETTLE - 1] if len(greens) >= C.SETTLE else None

    def resolved_at(self, driver: str, lap: int) -> int | None:
        """When a stop has been resolved by the laps so far; null while it is open. The safety timer is not in here."""
        stop = next(r for r in self.cars[driver] if r["lapNumber"] == lap)
        own = self.settled(driver, lap)
        if own is None:
            return None
        near = [d for d in (self.beside(driver, lap, stop["position"], step) for step in (-1, 1)) if d is not None]
        rival = next((d for d in near if self.gap_near(driver, d, lap)), None)
        if rival is None:
            return own["eventTimeMillis"]
        line = self.cars[rival]
        before = next((r["lapNumber"] for r in line if r.get("pitInTime") is not None and lap - C.LOOKBACK <= r["lapNumber"] <= lap), None)
        after = next((r["lapNumber"] for r in line if r["mark"] and r["lapNumber"] > lap), None)
        offset = max(lap + math.ceil(max(1, (stop.get("totalLaps") or 0) - lap) * C.OFFSET), own["lapNumber"])
        if before is not None or (after is not None and after <= offset):
            other = self.settled(rival, before if before is not None else after)
            return None if other is None else max(own["eventTimeMillis"], other["eventTimeMillis"])
        return max(own["eventTimeMillis"], self.begun[offset]) if offset in self.begun else None


class Stops(InOrder):
    """Open stops of a race, each with its safety timer. A stop leaves with the laps seen so far once it is resolved or its
    timer is due; while it is open, another stop of its driver is passed over."""

    def init(self, handle):
        super().init(handle)
        self.laps = handle.getListState("laps", "payload string")
        self.open = handle.getMapState("open", "driver string", "lap int, t0 long")

    def at(self, key, by_time):
        rows = [json.loads(x[0]) for x in self.laps.get()]
        pending = {k[0]: tuple(v) for k, v in self.open.iterator()}
        held, new, out = set(pending), [], []
        for t, events in sorted(by_time.items()):
            yield from self.due(key, rows, pending, t - 1)
            fresh = [e for _, e in events if e.get("driver") is not None and e["lapNumber"] > 0]
            rows += fresh
            new += fresh
            for r in fresh:
                if r.get("pitInTime") is not None and r["driver"] not in pending:
                    if r["lapNumber"] <= C.WARMUP:
                        out.append(self.told(key, r["driver"], r["lapNumber"], t, rows))
                    else:
                        pending[r["driver"]] = (r["lapNumber"], t)
                        self.handle.registerTimer(t + C.TIMER)
            field_ = Field(rows) if pending else None
            for driver, (lap, t0) in list(pending.items()):
                done = field_.resolved_at(driver, lap)
                if done is not None and done <= t0 + C.TIMER:
                    out.append(self.told(key, driver, lap, done, rows))
                    del pending[driver]
        if new:
            self.laps.appendList([(json.dumps(r),) for r in new])
        for driver in held - set(pending):
            self.open.removeKey((driver,))
        for driver, stop in pending.items():
            self.open.updateValue((driver,), stop)
        if out:
            yield pd.DataFrame(out, columns=["race", "driver", "pitLap", "resolvedAt", "laps"])

    def told(self, key, driver, lap, t, rows):
        return key[0], driver, lap, t, json.dumps([r for r in rows if r["eventTimeMillis"] <= t])

    def due(self, key, rows, pending, now):
        """Stops whose safety timer is over by ``now``."""
        for driver, (lap, t0) in list(pending.items()):
            if t0 + C.TIMER <= now:
                del pending[driver]
                yield pd.DataFrame([self.told(key, driver, lap, t0 + C.TIMER, rows)], columns=["race", "driver", "pitLap", "resolvedAt", "laps"])

    def on_timer(self, key, due, now):
        pending = {k[0]: tuple(v) for k, v in self.open.iterator()}
        if any(t0 + C.TIMER <= now for _, t0 in pending.values()):
            before = set(pending)
            yield from self.due(key, [json.loads(x[0]) for x in self.laps.get()], pending, now)
            for driver in before - set(pending):
                self.open.removeKey((driver,))

    def forget(self):
        super().forget()
        self.laps.clear()
        self.open.clear()


def resolved_stops(laps: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """(race, driver, pitLap, resolvedAt, laps): stops of a stream as they are resolved, with the race's laps by then."""
    marked = laps.withColumn("isGreen", S.is_green(F.col("trackStatus")))
    return keyed_events({"lap": marked}, lateness).groupBy("race").transformWithStateInPandas(Stops(), RESOLVED, "Append", "EventTime")


def evaluated(resolved: DataFrame, schema: str) -> DataFrame:
    """``pit_cycles`` of resolved stops, each over the laps that had been seen when it was."""
    stop = F.concat_ws("\x01", "race", "driver", F.col("pitLap").cast("string"))
    x = resolved.select(F.col("race").alias("__race"), F.col("driver").alias("__driver"), "pitLap", stop.alias("__stop"), F.explode(F.from_json("laps", f"array<struct<{schema}>>")).alias("lap"))
    laps = x.select(F.col("__stop").alias("race"), *(f"lap.{part.split()[0]}" for part in schema.split(", ") if part.split()[0] != "race"))
    asked = x.select(F.col("__stop").alias("race"), F.col("__race").alias("name"), F.col("__driver").alias("driver"), "pitLap").distinct()
    out = C.pit_cycles(laps).join(asked, ["race", "driver", "pitLap"])
    return out.withColumn("race", F.col("name")).drop("name")


def stops_each_batch(laps: DataFrame, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, lateness: str = LATENESS):
    """Evaluates the stops that each batch resolves with the batch operator itself."""
    return resolved_stops(laps, lateness).writeStream.foreachBatch(lambda batch, number: sink(evaluated(batch, schema), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
