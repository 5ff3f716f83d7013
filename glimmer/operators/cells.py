"""From intervals to cells: bucket expansion and exact distinct counts, in three builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.config import CORE_DIMS, EXTENDED_DIMS, EngineConfig
from glimmer.functions.scalar import bucket_floor, buckets_touched, last_instant, plus_seconds
from glimmer.operators.sessions import SESSION, enrich


def expand(intervals: DataFrame, cfg: EngineConfig, since=None, until=None) -> DataFrame:
    """A row for each bucket that [active_start, active_end) touches.

    since and until (columns or times, until excluded) bound the buckets; the intervals are
    clipped to them first, so a long interval isn't expanded beyond.
    """
    rows = intervals.where("active_end > active_start")
    start, end = F.col("active_start"), F.col("active_end")
    if since is not None:
        rows = rows.where(end > since)
        start = F.greatest(start, since)
    if until is not None:
        rows = rows.where(start < until)
        end = F.least(end, until)
    return rows.withColumn("minute", F.explode(buckets_touched(start, end, cfg.bucket_seconds)))


def unpack(sessions: DataFrame) -> DataFrame:
    """Session rows as one row an interval."""
    return sessions.select("*", F.inline("intervals")).drop("intervals")


def count_cells(atoms: DataFrame, keys: tuple[str, ...] = (*CORE_DIMS, "minute")) -> DataFrame:
    """Exact distinct sessions and users of each key; repeats are taken out where they arise, before the shuffle."""
    return atoms.select(*keys, SESSION, "user_id").distinct().groupBy(*keys).agg(F.count_distinct(SESSION).alias("concurrent"), F.count_distinct("user_id").alias("concurrent_users"))


def session_aware(sessions: DataFrame, cfg: EngineConfig) -> DataFrame:
    return count_cells(expand(unpack(sessions), cfg))


def session_independent(parts: DataFrame, content: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The same cells straight from segments, without islands."""
    rows = parts.withColumnsRenamed({"seg_start": "active_start", "seg_end": "active_end"})
    return count_cells(expand(enrich(rows, content), cfg))


def latest_attributes(events: DataFrame) -> DataFrame:
    """Each session's last value of the attributes that vary by event; ties go to the larger value."""
    names = ("subtitle_language", "audio_language", "player_version", "app_version")
    return events.groupBy(SESSION).agg(*[F.max_by(c, F.struct("event_timestamp", c)).alias(c) for c in names])


def extended(sessions: DataFrame, events: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Cells by the core and the extended dimensions."""
    rows = unpack(sessions).join(latest_attributes(events), SESSION)
    return count_cells(expand(rows, cfg), (*CORE_DIMS, "minute", *EXTENDED_DIMS))


def naive(events: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Sessions with a heartbeat in the bucket, whatever their state: the figure to compare with."""
    beats = events.where("event_type = 'VideoHeartbeat'")
    return beats.groupBy(bucket_floor(F.col("event_timestamp"), cfg.bucket_seconds).alias("minute")).agg(F.count_distinct(SESSION).alias("naive"))


def last_seen(events: DataFrame) -> DataFrame:
    return events.groupBy(SESSION).agg(F.max("event_timestamp").alias("last_ts"))


def dim_values(events: DataFrame, dims: tuple[str, ...] = ("platform", "country")) -> DataFrame:
    """Distinct (dim, value) pairs, in one pass over the events."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims])).alias("p")
    return events.select(pairs).select("p.*").distinct()


def recent_sessions(events: DataFrame, seen: DataFrame, cfg: EngineConfig, as_of) -> DataFrame:
    """The whole history of the sessions seen within the lookback."""
    recent = seen.where(F.col("last_ts") >= plus_seconds(F.lit(as_of).cast("timestamp"), -cfg.lookback_seconds))
    return events.join(recent.select(SESSION), SESSION, "left_semi")


def steps(intervals: DataFrame, cfg: EngineConfig, of: str = SESSION, keys: tuple[str, ...] = CORE_DIMS) -> DataFrame:
    """(*keys, minute, until, n): the number of distinct `of` of each key, from each bucket in which it changes up to the next such bucket.

    A sweep: what one `of` touches is merged to runs of buckets, each run is +1
    where it begins and -1 where it ends, and a running sum over a key's
    changes is the count.  Rows before the sum are two a run, however long it is.
    """
    rows = intervals.where("active_end > active_start")
    begin, after = bucket_floor(F.col("active_start"), cfg.bucket_seconds), plus_seconds(bucket_floor(last_instant(F.col("active_end")), cfg.bucket_seconds), cfg.bucket_seconds)
    rows = rows.select(*keys, F.col(of).alias("of"), begin.alias("begin"), after.alias("after"))
    by_time = Window.partitionBy(*keys, "of").orderBy("begin", "after")
    reached = F.max("after").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("begin") > reached, 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "of", "run").agg(F.min("begin").alias("begin"), F.max("after").alias("after"))
    edges = F.array(F.struct(F.col("begin").alias("minute"), F.lit(1).alias("change")), F.struct(F.col("after").alias("minute"), F.lit(-1).alias("change")))
    changes = runs.select(*keys, F.inline(edges)).groupBy(*keys, "minute").agg(F.sum("change").alias("change")).where("change <> 0")
    in_time = Window.partitionBy(*keys).orderBy("minute")
    counted = changes.withColumn("n", F.sum("change").over(in_time)).withColumn("until", F.lead("minute").over(in_time))
    return counted.where("n > 0").select(*keys, "minute", "until", "n")


def by_sweep(intervals: DataFrame, cfg: EngineConfig, keys: tuple[str, ...] = CORE_DIMS) -> DataFrame:
    """The cells of both counts from steps: buckets are expanded once a cell, not once a session."""
    def dense(of: str, name: str) -> DataFrame:
        rows = steps(intervals, cfg, of, keys)
        return rows.withColumn("minute", F.explode(buckets_touched(F.col("minute"), F.col("until"), cfg.bucket_seconds))).select(*keys, "minute", F.col("n").alias(name))

    # A session has one user at a time, so both have the same cells.
    return dense(SESSION, "concurrent").join(dense("user_id", "concurrent_users"), [*keys, "minute"])


def numbered(values: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """(column, id): a number for each distinct value, dense within each of `parts` ranges of numbers, so bitmaps of them are short."""
    part = F.pmod(F.xxhash64(column), F.lit(parts))
    rows = values.select(column).where(F.col(column).isNotNull()).distinct().withColumn("part", part)
    return rows.select(column, (F.col("part") * F.lit(1 << 40) + F.row_number().over(Window.partitionBy("part").orderBy(column))).alias("id"))


def bitmap_cells(atoms: DataFrame, of: str, ids: DataFrame, keys: tuple[str, ...] = (*CORE_DIMS, "minute")) -> DataFrame:
    """(*keys, chunk, bits): which `of` a cell has, as bitmaps of 32768 ids each.  Bitmaps of cells merge exactly, as counts don't."""
    rows = atoms.select(*keys, of).join(ids, of)
    return rows.groupBy(*keys, F.bitmap_bucket_number("id").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def rolled_up(bitmaps: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """Exact distinct counts over any of the cells' keys, from the cells alone."""
    merged = bitmaps.groupBy(*keys, "chunk").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return merged.groupBy(*keys).agg(F.sum("n").alias(name))
