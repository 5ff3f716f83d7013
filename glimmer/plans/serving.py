"""Serving queries over cells and events: curves, peaks, averages, arrivals, top content, drop-downs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.config import EngineConfig
from glimmer.functions.scalar import bucket_floor, long_or_zero, parse_time, seconds_between
from glimmer.operators.sessions import SESSION, enrich


def matches(**wanted):
    """The condition that a row matches every filter; '' and None stand for all, and so does 0 for content_id given as text."""
    out = F.lit(True)
    for name, value in wanted.items():
        if name == "content_id" and isinstance(value, str):
            out = out & ((F.lit(value) == "") | (long_or_zero(F.lit(value)) == 0) | (F.col(name) == long_or_zero(F.lit(value))))
        elif value not in (None, ""):
            out = out & (F.col(name) == value)
    return out


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    return rows.where(matches(**wanted))


def per_minute(cells: DataFrame, start: str, end: str, values: dict[str, str], **wanted) -> DataFrame:
    """Sums of the cells that match for each minute of the range that has any cell; null where none of them matches."""
    rows = within(cells, "minute", start, end)
    return rows.groupBy("minute").agg(*[F.sum(F.when(matches(**wanted), F.col(v))).alias(name) for name, v in values.items()])


def bounds(rows: DataFrame, column: str, start: str = "", end: str = "") -> DataFrame:
    """One row (from_ts, to_ts): the given times, or the first and last there are."""
    return rows.agg(F.coalesce(parse_time(F.lit(start)), F.min(column)).alias("from_ts"), F.coalesce(parse_time(F.lit(end)), F.max(column)).alias("to_ts"))


def within(rows: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows in the range, both ends included; a given end reaches the scan as a filter."""
    if start:
        rows = rows.where(F.col(column) >= parse_time(F.lit(start)))
    if end:
        rows = rows.where(F.col(column) <= parse_time(F.lit(end)))
    return rows


def curve(cells: DataFrame, cfg: EngineConfig, start: str = "", end: str = "", **wanted) -> DataFrame:
    """Sessions and users for each bucket of the range, zero where nobody watches; off-grid bounds are floored.

    The cells are read once: each minute that is there is followed by the zeros
    up to the next one.  The window holds a row a bucket of the range.
    """
    sums = per_minute(cells, start, end, {"c": "concurrent", "u": "concurrent_users"}, **wanted)
    given = [F.lit(t) for t in (start, end) if t]
    if given:
        # Both ends of the range are there, with cells or without; a range of which one end is the data's has none if that is beyond the other.
        ends = cells.sparkSession.range(1).select(F.explode(F.array(*map(parse_time, given))).alias("minute"))
        none = F.lit(None).cast("long")
        sums = sums.unionByName(ends.select(bucket_floor(F.col("minute"), cfg.bucket_seconds).alias("minute"), none.alias("c"), none.alias("u")))
        sums = sums.groupBy("minute").agg(F.sum("c").alias("c"), F.sum("u").alias("u"))
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(cfg.bucket_seconds))
    next_minute = F.lead("minute").over(Window.orderBy("minute"))
    grid = F.sequence(F.col("minute"), F.coalesce(F.col("next") - step, F.col("minute")), step)
    rows = sums.withColumn("next", next_minute).select("c", "u", F.posexplode(grid).alias("i", "minute"))
    value = lambda c: F.when(F.col("i") == 0, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long")
    return rows.select("minute", value("c").alias("concurrent"), value("u").alias("concurrent_users"))


def earliest_peak(value: str = "c"):
    """The first minute of the highest value."""
    return F.min_by("minute", F.when(F.col(value).isNotNull(), F.struct(-F.col(value), "minute")))


def kpis(cells: DataFrame, cfg: EngineConfig, start: str = "", end: str = "", **wanted) -> DataFrame:
    """Peak, its first minute, the average over all buckets of the range, and the last bucket's value; the cells are read once."""
    sums = per_minute(cells, start, end, {"c": "concurrent"}, **wanted)
    first = parse_time(F.lit(start)) if start else F.min("minute")
    last = parse_time(F.lit(end)) if end else F.max("minute")
    buckets = seconds_between(first, last) / cfg.bucket_seconds + 1
    return sums.agg(
        F.max("c").cast("long").alias("peak_concurrency"),
        earliest_peak().alias("peak_minute"),
        F.round(F.sum("c") / buckets, 1).alias("avg_concurrency"),
        F.max_by("c", F.when(F.col("c").isNotNull(), F.col("minute"))).cast("long").alias("last_minute_concurrency"),
    )


def _starts_and_ends() -> list:
    one = lambda kind: F.count_distinct(F.when(F.col("event_type") == kind, F.col(SESSION)))
    return [one("VideoSessionStart").alias("sessions_started"), one("VideoSessionEnd").alias("sessions_ended")]


def _events_in(events: DataFrame, content: DataFrame, start: str, end: str, wanted: dict) -> DataFrame:
    rows = within(events, "event_timestamp", start, end)
    return filtered(enrich(rows, content) if {"video_type", "category"} & {k for k, v in wanted.items() if v} else rows, **wanted)


def started_ended(events: DataFrame, content: DataFrame, start: str = "", end: str = "", **wanted) -> DataFrame:
    return _events_in(events, content, start, end, wanted).agg(*_starts_and_ends())


def arrivals(events: DataFrame, content: DataFrame, cfg: EngineConfig, start: str = "", end: str = "", **wanted) -> DataFrame:
    rows = _events_in(events, content, start, end, wanted)
    return rows.groupBy(bucket_floor(F.col("event_timestamp"), cfg.bucket_seconds).alias("minute")).agg(*_starts_and_ends())


def new_users(events: DataFrame, start: str = "", end: str = "") -> DataFrame:
    """Users whose first event of all is in the range; filters don't apply."""
    firsts = events.groupBy("user_id").agg(F.min("event_timestamp").alias("first_ts"))
    return within(firsts, "first_ts", start, end).agg(F.count("*").alias("new_users"))


def peak_by(cells: DataFrame, keys: tuple[str, ...], value: str = "concurrent", start: str = "", end: str = "", **wanted) -> DataFrame:
    """Each key's own peak and its first minute."""
    sums = filtered(within(cells, "minute", start, end), **wanted).groupBy(*keys, "minute").agg(F.sum(value).alias("c"))
    return sums.groupBy(*keys).agg(F.max("c").cast("long").alias("peak"), earliest_peak().alias("peak_minute"))


def peak_in(cells: DataFrame, unit: str) -> DataFrame:
    """The peak of each hour or day, and its first minute."""
    sums = cells.groupBy("minute").agg(F.sum("concurrent").alias("c"))
    return sums.groupBy(F.date_trunc(unit, "minute").alias(unit)).agg(F.max("c").cast("long").alias("peak"), earliest_peak().alias("peak_minute"))


def top_content(cells: DataFrame, content: DataFrame, k: int = 20, start: str = "", end: str = "", **wanted) -> DataFrame:
    """The k contents with the highest peaks, ties by id, with a name for unknown ones."""
    top = peak_by(cells, ("content_id",), start=start, end=end, **wanted).orderBy(F.desc("peak"), "content_id").limit(k)
    named = top.join(content.groupBy("content_id").agg(F.min("title").alias("title")), "content_id", "left")
    return named.withColumn("title", F.coalesce("title", F.concat(F.lit("Unknown ("), F.col("content_id").cast("string"), F.lit(")")))).select("content_id", "title", "peak", "peak_minute")


def grain(cells: DataFrame, cfg: EngineConfig, unit: str, start: str = "", end: str = "", **wanted) -> DataFrame:
    """Peak and average of the zero-filled curve by hour or day."""
    by = curve(cells, cfg, start, end, **wanted).groupBy(F.date_trunc(unit, "minute").alias(unit))
    return by.agg(F.max("concurrent").alias("peak_concurrency"), F.round(F.avg("concurrent"), 1).alias("avg_concurrency"))


def peak_avg(cells: DataFrame, cfg: EngineConfig, value: str = "concurrent") -> DataFrame:
    """Peak, its first minute, and the average over the buckets between the first and the last that are there."""
    sums = cells.groupBy("minute").agg(F.sum(value).alias("c"))
    buckets = seconds_between(F.min("minute"), F.max("minute")) / cfg.bucket_seconds + 1
    return sums.agg(F.max("c").cast("long").alias("peak"), earliest_peak().alias("peak_minute"), F.round(F.sum("c") / buckets, 6).alias("avg"))


def dropdown(cells: DataFrame, *columns: str, limit: int | None = None) -> DataFrame:
    """All distinct values, or the first `limit` of them where the drop-down asks for so many."""
    values = cells.select(*columns).distinct().orderBy(*columns[::-1])
    return values if limit is None else values.limit(limit)


def dropdown_of(dim_values: DataFrame, dim: str, limit: int | None = None) -> DataFrame:
    """A drop-down from the small table of (dim, value) pairs, which ingestion keeps up to date: no cell is derived for it."""
    return dropdown(dim_values.where(F.col("dim") == dim).select(F.col("value").alias(dim)), dim, limit=limit)


def exact_totals(atoms: DataFrame) -> DataFrame:
    """Distinct sessions and users a bucket over all dimensions, which sums of cells can overcount."""
    return atoms.groupBy("minute").agg(F.count_distinct(SESSION).alias("sessions"), F.count_distinct("user_id").alias("users"))


