"""Column functions: buckets, second counts, normalizers, lenient parsing; and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from glimmer.config import EngineConfig

TIME_PATTERNS = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def bucket_floor(ts: Column, seconds: int) -> Column:
    """The start of the epoch-aligned bucket that holds ts."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / F.lit(seconds)) * F.lit(seconds))


def plus_seconds(ts: Column, seconds: int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries passed between two times (00:00.9 to 00:01.0 passes one)."""
    return F.unix_seconds(end) - F.unix_seconds(start)


def last_instant(end: Column) -> Column:
    """The last millisecond of a half-open interval."""
    return end - F.expr("INTERVAL '0.001' SECOND")


def buckets_touched(start: Column, end: Column, seconds: int) -> Column:
    """Array of the buckets that [start, end) touches."""
    return F.sequence(bucket_floor(start, seconds), bucket_floor(last_instant(end), seconds), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))


def norm_lang(x: Column) -> Column:
    """`unk` for '', und, unknown and unk; else lower case, trimmed, up to the first hyphen."""
    plain = F.lower(F.trim(x))
    return F.when((x == "") | plain.isin("und", "unknown", "unk"), "unk").otherwise(F.split(plain, "-")[0])


def norm_dim(x: Column) -> Column:
    """`unk` for blanks, else unchanged."""
    return F.when(F.trim(x) == "", "unk").otherwise(x)


def parse_time(x: Column) -> Column:
    """A time in one of TIME_PATTERNS; null where none fits."""
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(p)) for p in TIME_PATTERNS])


def long_or_zero(x: Column) -> Column:
    return F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint"))


def text_or_empty(x: Column) -> Column:
    """Unmatched dimension attributes count as ''."""
    return F.coalesce(x, F.lit(""))


def readable_size(x: Column) -> Column:
    out = F.concat(F.format_number(x / 1024**4, 2), F.lit(" TiB"))
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB"), (0, "B")):
        out = F.when(x < 1024 ** (power + 1), F.concat(F.format_number(x / 1024**power, 2), F.lit(f" {unit}"))).otherwise(out)
    return out


def register_sql_functions(spark: SparkSession, cfg: EngineConfig) -> None:
    """The knobs and normalizers as SQL functions; Catalyst folds them into the plan."""
    knobs = {"bucket_seconds": cfg.bucket_seconds, "heartbeat_seconds": cfg.heartbeat_seconds, "missing_heartbeat_buffer_seconds": cfg.buffer_seconds, "hot_window_seconds": cfg.hot_window_seconds}
    for name, value in knobs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cfg_{name}() RETURNS INT RETURN {int(value)}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cfg_gap_timeout_seconds() RETURNS INT RETURN cfg_heartbeat_seconds() + cfg_missing_heartbeat_buffer_seconds()")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION norm_lang(x STRING) RETURNS STRING RETURN CASE WHEN x = '' OR lower(trim(x)) IN ('und', 'unknown', 'unk') THEN 'unk' ELSE split(lower(trim(x)), '-')[0] END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION norm_dim(x STRING) RETURNS STRING RETURN CASE WHEN trim(x) = '' THEN 'unk' ELSE x END")
