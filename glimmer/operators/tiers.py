"""Hot and cold tiers: split, serve, retain, and read the latest version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.config import CORE_DIMS, EngineConfig
from glimmer.functions.scalar import bucket_floor, plus_seconds
from glimmer.operators.cells import count_cells, expand
from glimmer.operators.sessions import SESSION

CELL_KEY = (*CORE_DIMS, "minute")


def latest(rows: DataFrame, keys: tuple[str, ...], version: str = "version") -> DataFrame:
    """The newest row of each key; a key's versions are combined before the shuffle."""
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), version).alias("row"))
    return newest.select("row.*")


def split_at(events: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row: the first hot bucket, a hot window before the last event."""
    return events.agg(plus_seconds(bucket_floor(F.max("event_timestamp"), cfg.bucket_seconds), -cfg.hot_window_seconds).alias("wm"))


def cold(intervals: DataFrame, boundary: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Cells before the boundary (one row); intervals are clipped there before they are expanded."""
    return count_cells(expand(intervals.join(F.broadcast(boundary)), cfg, until=F.col("wm")))


def hot(intervals: DataFrame, boundary: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Cells from the boundary (one row) on; intervals that end before it are not expanded."""
    return count_cells(expand(intervals.join(F.broadcast(boundary)), cfg, since=F.col("wm")))


def tiered(cells: DataFrame, boundary: DataFrame) -> DataFrame:
    """Cells with their tier: cold before the boundary (one row), hot from it on; served together, each minute is in one of them."""
    rows = cells.join(F.broadcast(boundary))
    return rows.withColumn("tier", F.when(F.col("minute") < F.col("wm"), "cold").otherwise("hot")).drop("wm")


def serve(cold_cells: DataFrame, hot_cells: DataFrame) -> DataFrame:
    """Cold rows, and hot rows after the last cold minute (all, if cold is empty); for tiers that were written at different times."""
    last = cold_cells.agg(F.coalesce(F.max("minute"), F.timestamp_seconds(F.lit(0))).alias("last"))
    return cold_cells.unionByName(hot_cells.join(F.broadcast(last)).where("minute > last").drop("last"))


def _clipped(intervals: DataFrame, since, until) -> DataFrame:
    """The parts of intervals within [since, until), with what cells are counted by."""
    rows = intervals.where((F.col("active_end") > F.col("active_start")) & (F.col("active_end") > since) & (F.col("active_start") < until))
    return rows.select(SESSION, "user_id", *CORE_DIMS, F.greatest("active_start", since).alias("active_start"), F.least("active_end", until).alias("active_end"))


def changed(before: DataFrame, again: DataFrame, derived: DataFrame, since, until) -> DataFrame:
    """(session, user) of each interval within [since, until) that re-deriving the sessions in `derived` has added or taken away.

    before has all sessions' intervals as they were, again those of the
    re-derived ones; rows of other sessions in it don't count.  since and until
    are starts of buckets.
    """
    was, now = (_clipped(rows, since, until).join(derived, SESSION, "left_semi") for rows in (before, again))
    both = was.withColumn("sign", F.lit(-1)).unionByName(now.withColumn("sign", F.lit(1)))
    return both.groupBy(*was.columns).agg(F.sum("sign").alias("sign")).where("sign <> 0").select(SESSION, "user_id").distinct()


def corrections(before: DataFrame, again: DataFrame, derived: DataFrame, cfg: EngineConfig, since, until) -> DataFrame:
    """Signed changes of the cells within [since, until) that re-deriving the sessions in `derived` brings; arguments as for changed.

    Only the sessions that change there, and the other sessions of their users,
    are expanded: a user whom another session keeps in a cell must not be
    counted out of it.
    """
    late = changed(before, again, derived, since, until)
    sessions, users = late.select(SESSION).distinct(), late.select("user_id").distinct()
    old = _clipped(before, since, until)
    others = old.join(sessions, SESSION, "left_anti").join(users, "user_id", "left_semi").select(*old.columns)
    was = old.join(sessions, SESSION, "left_semi").unionByName(others)
    now = _clipped(again, since, until).join(sessions, SESSION, "left_semi").unionByName(others)
    both = was.withColumn("sign", F.lit(-1)).unionByName(now.withColumn("sign", F.lit(1)))
    counts = count_cells(expand(both, cfg), (*CELL_KEY, "sign"))
    change = [F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("concurrent", "concurrent_users")]
    return counts.groupBy(*CELL_KEY).agg(*change).where("concurrent <> 0 OR concurrent_users <> 0")


def corrected(cold_cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Cold cells with all signed changes added up; cells that nothing is left of are dropped."""
    rows = cold_cells.unionByName(changes)
    counts = [F.sum(c).alias(c) for c in ("concurrent", "concurrent_users")]
    return rows.groupBy(*CELL_KEY).agg(*counts).where("concurrent > 0 OR concurrent_users > 0")


def retained(rows: DataFrame, column: str, days: int, as_of) -> DataFrame:
    return rows.where(F.col(column) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def retained_versions(rows: DataFrame, days: int, as_of) -> DataFrame:
    """Rows whose version, a time in epoch milliseconds, is within so many days of as_of."""
    return retained(rows.withColumn("_at", F.timestamp_millis("version")), "_at", days, as_of).drop("_at")


def overlap(cold_cells: DataFrame, hot_cells: DataFrame) -> DataFrame:
    """Minutes that are in both tiers; there should be none."""
    return cold_cells.select("minute").intersect(hot_cells.select("minute"))
