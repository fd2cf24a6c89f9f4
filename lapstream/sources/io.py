"""Readers and writers of event files, tables and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LAPS = "race string, driver string, lapNumber int, position int, stint int, tyreLife int, compound string, lapTime double, gapToCarAhead double, pitInTime double, pitOutTime double, trackStatus string, team string, trackTemp double, pitLoss double, vscPitLoss double, scPitLoss double, totalLaps int, eventTimeMillis long"
TELEMETRY = "race string, driver string, eventTimeMillis long, lapNumber int, speed int, throttle int, brake int, nGear int"
TRACK_STATUS = "race string, eventTimeMillis long, status string"
SCHEMAS = {"laps": LAPS, "telemetry": TELEMETRY, "track_status": TRACK_STATUS}


def _with_corrupt(schema: str) -> StructType:
    return StructType.fromDDL(schema + ", _corrupt_record string")


def read_events(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(events, bad lines) of JSON lines; blank lines are neither."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select(F.from_json("value", _with_corrupt(SCHEMAS[kind]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("e"), "value")
    bad = F.col("e").isNull() | F.col("e._corrupt_record").isNotNull()
    return parsed.where(~bad).select("e.*").drop("_corrupt_record"), parsed.where(bad).select("value")


def read_stream(spark: SparkSession, kind: str, path: str | None = None, servers: str | None = None, topic: str | None = None) -> DataFrame:
    """A stream of one kind of event: from a Kafka topic, or from a folder of JSON lines."""
    if path is not None:
        return spark.readStream.schema(SCHEMAS[kind]).json(path)
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), SCHEMAS[kind]).alias("e")).select("e.*").where("race is not null or driver is not null")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def latest_snapshot(spark: SparkSession, folder: str, stream: str, year: int, tag: str) -> str:
    """The newest file of a stream, by modification time and name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{stream}_{year}_{tag}_*.jsonl").load(folder).select("path", "modificationTime")
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    if row["path"] is None:
        raise FileNotFoundError(f"{stream}_{year}_{tag}_*.jsonl in {folder}")
    return row["path"]


def union_parts(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[kind]).option("recursiveFileLookup", "true").json(folder)


def merge_seasons(seasons: dict[int, DataFrame], keys: list[str], order: str) -> DataFrame:
    """Seasons with the year in the race's name; of rows with one key the last stays, rows without a whole key pass."""
    every = None
    for year, df in sorted(seasons.items()):
        named = df.withColumn("race", F.when(F.col("race").rlike(r"^\d{4} :: "), F.col("race")).otherwise(F.concat_ws(" :: ", F.lit(str(year)), "race")))
        every = named if every is None else every.unionByName(named, allowMissingColumns=True)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return every.where(whole).withColumn("__r", last).where("__r = 1").drop("__r").unionByName(every.where(~whole))


def write_events(df: DataFrame, path: str, checkpoint: str | None = None, every: str = "15 seconds", most_records: int = 50_000):
    """JSON lines: batch, or a stream that rolls files by time and size."""
    if not df.isStreaming:
        return df.write.mode("append").option("maxRecordsPerFile", most_records).json(path)
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", most_records).trigger(processingTime=every).start()


def to_messages(df: DataFrame, key: str) -> DataFrame:
    """(key, value) with each row as JSON; nulls are left out."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def publish(df: DataFrame, key: str, servers: str, topic: str, checkpoint: str):
    return to_messages(df, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def write_dataset(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).csv if path.endswith(".csv") else df.write.mode("overwrite").parquet)(path)


def alert_feed(alerts: dict[str, DataFrame]) -> DataFrame:
    """All kinds of alerts as one table with a kind."""
    out = None
    for kind, df in alerts.items():
        x = df.withColumn("kind", F.lit(kind))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out
