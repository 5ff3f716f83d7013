"""The driver's `events` table as playback events: one session a user, with platform and user switches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"signup": ("VideoSessionStart", "x"), "click": ("VideoPlay", "x"), "view": ("VideoHeartbeat", "x"), "purchase": ("VideoHeartbeat", "pause"), "error": ("VideoError", "x")}
#: DuckDB's twin of landing(), events() and content(): CTEs raw, ev and cd.
CTES = """
raw AS (
  SELECT user_id % 9 AS content_id, 's' || user_id AS video_session_id, 'u' || user_id || CASE WHEN day(ts) > 20 THEN 'b' ELSE 'a' END AS user_id,
    CASE event_type WHEN 'signup' THEN 'VideoSessionStart' WHEN 'click' THEN 'VideoPlay' WHEN 'error' THEN 'VideoError' ELSE 'VideoHeartbeat' END AS event_type,
    CASE event_type WHEN 'purchase' THEN 'pause' ELSE 'x' END AS event, epoch_us(ts) // 1000 AS event_timestamp,
    ['android', 'ios', 'web', 'tv', 'firetv'][(user_id + day(ts) // 11) % 5 + 1] AS platform,
    CASE WHEN k % 5 = 0 THEN ' ' ELSE 'v' || (k % 3) END AS app_version, ['IN', 'US', 'GB'][user_id % 3 + 1] AS country,
    ['hin', 'HIN', 'hin-hindi', ''][k % 4 + 1] AS audio_language, ['und', 'Eng', ' tam-x '][k % 3 + 1] AS subtitle_language,
    CASE WHEN k % 7 = 0 THEN '' ELSE 'p' || (k % 2) END AS player_version, epoch_us(ts) // 1000 AS session_start_epoch
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
ev AS (
  SELECT content_id, video_session_id, user_id, event_type, event, make_timestamp(event_timestamp * 1000) AS event_timestamp, platform,
    CASE WHEN trim(app_version) = '' THEN 'unk' ELSE app_version END AS app_version, country,
    CASE WHEN audio_language = '' OR lower(trim(audio_language)) IN ('und', 'unknown', 'unk') THEN 'unk' ELSE split_part(lower(trim(audio_language)), '-', 1) END AS audio_language,
    CASE WHEN subtitle_language = '' OR lower(trim(subtitle_language)) IN ('und', 'unknown', 'unk') THEN 'unk' ELSE split_part(lower(trim(subtitle_language)), '-', 1) END AS subtitle_language,
    CASE WHEN trim(player_version) = '' THEN 'unk' ELSE player_version END AS player_version, make_timestamp(session_start_epoch * 1000) AS session_start_epoch
  FROM raw),
cd AS (
  SELECT p_partkey + 1 AS content_id, min(p_name) AS title, CASE WHEN (p_partkey + 1) % 2 = 0 THEN 'live' ELSE 'vod' END AS video_type, ['sport', 'drama', 'film'][(p_partkey + 1) % 3 + 1] AS category
  FROM part GROUP BY p_partkey)"""


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing rows (epoch milliseconds) from the table's users and times."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts, user, k = F.col("ts").cast("timestamp"), F.col("user_id"), F.get_json_object("props", "$.k").cast("long")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    named = lambda place: F.coalesce(*[F.when(F.col("event_type") == name, both[place]) for name, both in KINDS.items()])
    return rows.select(
        (user % 9).alias("content_id"),
        F.concat(F.lit("s"), user).alias("video_session_id"),
        F.concat(F.lit("u"), user, F.when(F.day(ts) > 20, "b").otherwise("a")).alias("user_id"),
        named(0).alias("event_type"),
        named(1).alias("event"),
        F.unix_millis(ts).alias("event_timestamp"),
        pick(("android", "ios", "web", "tv", "firetv"), (user + F.floor(F.day(ts) / 11)) % 5).alias("platform"),
        F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("v"), k % 3)).alias("app_version"),
        pick(("IN", "US", "GB"), user % 3).alias("country"),
        pick(("hin", "HIN", "hin-hindi", ""), k % 4).alias("audio_language"),
        pick(("und", "Eng", " tam-x "), k % 3).alias("subtitle_language"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("p"), k % 2)).alias("player_version"),
        F.unix_millis(ts).alias("session_start_epoch"),
    )


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `part` table as the content catalogue: it has titles that nobody watches, and lacks content 0, which some do."""
    i = F.col("p_partkey") + 1
    category = F.element_at(F.array(F.lit("sport"), F.lit("drama"), F.lit("film")), (i % 3 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select(i.alias("content_id"), F.col("p_name").alias("title"), F.when(i % 2 == 0, "live").otherwise("vod").alias("video_type"), category.alias("category"))
