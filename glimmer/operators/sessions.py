"""From events to foreground-active intervals: classify, collapse, state, segments, islands, arrays.

`by_session` deals events by session once; the collapse by (session, time)
and all windows over a session then need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.config import EngineConfig, Rules
from glimmer.functions.scalar import plus_seconds, seconds_between, text_or_empty

SESSION = "video_session_id"


def project_landing(landing: DataFrame) -> DataFrame:
    """Landing rows (times in epoch milliseconds) as typed events with normalized attributes, by name; works on streams."""
    from glimmer.functions.scalar import norm_dim, norm_lang

    return landing.select(
        "content_id",
        SESSION,
        "user_id",
        "event_type",
        "event",
        F.timestamp_millis("event_timestamp").alias("event_timestamp"),
        "platform",
        norm_dim(F.col("app_version")).alias("app_version"),
        "country",
        norm_lang(F.col("audio_language")).alias("audio_language"),
        norm_lang(F.col("subtitle_language")).alias("subtitle_language"),
        norm_dim(F.col("player_version")).alias("player_version"),
        F.timestamp_millis("session_start_epoch").alias("session_start_epoch"),
    )


def classify(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row an event with transition 1 (activates), -1 (deactivates) or 0."""
    on = F.col("event_type").isin(*rules.activating_types) | F.col("event").isin(*rules.activating_markers)
    off = F.col("event_type").isin(*rules.deactivating_types) | F.col("event").isin(*rules.deactivating_markers)
    transition = F.when(on, 1).when(off, -1).otherwise(0).alias("transition")
    return events.select(SESSION, "user_id", F.col("event_timestamp").alias("ts"), "content_id", "platform", "country", transition)


def collapse(classified: DataFrame) -> DataFrame:
    """One row a (session, time): deactivation outranks activation, which outranks neutral; the smallest of each attribute."""
    least = [F.min(c).alias(c) for c in ("user_id", "content_id", "platform", "country")]
    transition = F.when(F.min("transition") < 0, -1).otherwise(F.max("transition")).alias("transition")
    return classified.repartition(SESSION).groupBy(SESSION, "ts").agg(*least, transition)


def running_state(collapsed: DataFrame) -> DataFrame:
    """Adds state, the last transition so far that isn't 0 (else 0), and next_ts."""
    by_time = Window.partitionBy(SESSION).orderBy("ts")
    last = F.last(F.when(F.col("transition") != 0, F.col("transition")), ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    return collapsed.withColumn("state", F.coalesce(last, F.lit(0))).withColumn("next_ts", F.lead("ts").over(by_time))


def segments(stated: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Active stretches between neighbouring events; silence beyond the gap leaves a heartbeat's grace."""
    grace = plus_seconds(F.col("ts"), cfg.heartbeat_seconds)
    bridged = seconds_between(F.col("ts"), F.col("next_ts")) <= cfg.gap_seconds
    end = F.when(bridged, F.col("next_ts")).otherwise(grace)
    return stated.where("state = 1").select(SESSION, "user_id", "content_id", "platform", "country", F.col("ts").alias("seg_start"), end.alias("seg_end"))


def islands(parts: DataFrame, split_on: tuple[str, ...] = ("platform", "user_id")) -> DataFrame:
    """Segments merged while they touch and no attribute in split_on changes."""
    by_time = Window.partitionBy(SESSION).orderBy("seg_start")
    so_far = F.max("seg_end").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("seg_start") > so_far
    for c in split_on:
        new = new | (F.col(c) != F.lag(c).over(by_time))
    numbered = parts.withColumn("new", F.when(new, 1).otherwise(0))
    numbered = numbered.withColumn("island", F.sum("new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    least = [F.min(c).alias(c) for c in ("user_id", "content_id", "platform", "country")]
    merged = numbered.groupBy(SESSION, "island").agg(*least, F.min("seg_start").alias("active_start"), F.max("seg_end").alias("active_end"))
    return merged.where("active_end > active_start")


def session_intervals(merged: DataFrame, content: DataFrame, cfg: EngineConfig, as_of=None) -> DataFrame:
    """One row a session: its sorted intervals, whether they may still grow, and its content."""
    array = F.array_sort(F.collect_list(F.struct("active_start", "active_end", "platform", "user_id"))).alias("intervals")
    rows = merged.groupBy(SESSION).agg(array, F.max("active_end").alias("last_end"), F.min("content_id").alias("content_id"), F.min("country").alias("country"))
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    provisional = F.col("last_end") >= plus_seconds(now, -cfg.gap_seconds)
    rows = rows.select(SESSION, "intervals", provisional.alias("is_provisional"), "content_id", "country")
    return enrich(rows, content).withColumn("version", F.unix_millis(now))


def enrich(rows: DataFrame, content: DataFrame) -> DataFrame:
    """Adds video_type, category, title ('' where the content isn't known).

    Whether the catalogue is small enough to be broadcast is Spark's to tell, by its size in bytes.
    """
    known = content.groupBy("content_id").agg(*[F.min(c).alias(c) for c in ("video_type", "category", "title")])
    joined = rows.join(known, "content_id", "left")
    for c in ("video_type", "category", "title"):
        joined = joined.withColumn(c, text_or_empty(F.col(c)))
    return joined


def active_segments(events: DataFrame, cfg: EngineConfig, rules: Rules = Rules()) -> DataFrame:
    return segments(running_state(collapse(classify(events, rules))), cfg)
