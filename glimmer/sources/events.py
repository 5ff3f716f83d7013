"""Sources and sinks: schemas, CSV and JSON files, streams, seeds, partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANDING_SCHEMA = "content_id long, video_session_id string, user_id string, event_type string, event string, event_timestamp long, platform string, app_version string, country string, audio_language string, subtitle_language string, player_version string, session_start_epoch long"
CONTENT_SCHEMA = "content_id long, title string, video_type string, category string"


def read_csv(spark: SparkSession, path: str, schema: str = LANDING_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str = LANDING_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream_json(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Landing rows from JSON files as they arrive."""
    return spark.readStream.schema(LANDING_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Landing rows from a topic of JSON messages (needs Spark's Kafka connector on the cluster)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return parse_messages(raw)


def parse_messages(raw: DataFrame) -> DataFrame:
    """Landing rows of messages (value: JSON as bytes); one that can't be read gives a row of nulls."""
    return raw.select(F.from_json(F.col("value").cast("string"), LANDING_SCHEMA).alias("v")).select("v.*")


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Typed events by month; a file's rows lie in the order of session and time, so a session's read is contiguous."""
    by_month = events.withColumn("yyyymm", F.date_format("event_timestamp", "yyyyMM"))
    by_month.repartition("yyyymm", "video_session_id").sortWithinPartitions("yyyymm", "video_session_id", "event_timestamp").write.mode(mode).partitionBy("yyyymm").parquet(path)


def write_cells(cells: DataFrame, path: str, mode: str = "append") -> None:
    by_day = cells.withColumn("day", F.to_date("minute"))
    by_day.repartition("day", F.col("minute")).sortWithinPartitions("day", "country", "platform", "video_type", "category", "minute").write.mode(mode).partitionBy("day").parquet(path)


def seed_scenario(spark: SparkSession, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Landing rows of three small sessions before as_of (one open and silent for a while, one paused, one short), and their content."""
    minutes = [
        ("sA", 100, [(9.0, "VideoSessionStart", ""), (8.9, "VideoPlay", ""), (8.0, "VideoHeartbeat", ""), (7.0, "VideoHeartbeat", ""), (4.0, "VideoHeartbeat", ""), (1.0, "VideoHeartbeat", "")]),
        ("sB", 101, [(6.0, "VideoPlay", ""), (5.0, "VideoHeartbeat", ""), (4.0, "VideoHeartbeat", "pause"), (3.0, "VideoHeartbeat", "resume"), (2.0, "VideoSessionEnd", "")]),
        ("sC", 102, [(3.0, "VideoPlay", ""), (2.0, "VideoSessionEnd", "")]),
    ]
    rows = [(content, sid, f"user-{sid}", kind, marker, ago, "web", "1.0", "IN", "hin", "", "2.0") for sid, content, steps in minutes for ago, kind, marker in steps]
    events = spark.createDataFrame(rows, "content_id long, video_session_id string, user_id string, event_type string, event string, ago double, platform string, app_version string, country string, audio_language string, subtitle_language string, player_version string")
    now = F.unix_millis(F.lit(as_of).cast("timestamp"))
    events = events.withColumn("event_timestamp", (now - F.round(F.col("ago") * 60000)).cast("long")).withColumn("session_start_epoch", F.col("event_timestamp"))
    names = [c.split()[0] for c in LANDING_SCHEMA.split(", ")]
    content = spark.createDataFrame([(100, "Final", "live", "sport"), (101, "Series", "vod", "drama"), (102, "Film", "vod", "film")], CONTENT_SCHEMA)
    return events.select(*names), content
