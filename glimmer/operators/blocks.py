"""States, segments and islands of sessions too large for one task: windows over (session, time block), and carries between blocks.

What a window over a whole session would know at a row is what the session's
earlier blocks hand over (the last transition, the last segment, how many islands
began) and what the block itself has seen so far.  Each block is summed up in one row;
carries are windows over those rows, a session's blocks, and go back to the rows by
(session, block).  So the rows of one session are in as many tasks as it has blocks.
Results equal those of the session windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.config import EngineConfig, Rules
from glimmer.operators import sessions as S

SESSION = S.SESSION
_BLOCK = (SESSION, "block")


def _by_block():
    return Window.partitionBy(SESSION).orderBy("block")


def _before():
    return _by_block().rowsBetween(Window.unboundedPreceding, -1)


def block_of(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds)).alias("block")


def collapse(classified: DataFrame, block_seconds: int) -> DataFrame:
    """As the engine's collapse, dealt by session and block; adds block."""
    least = [F.min(c).alias(c) for c in ("user_id", "content_id", "platform", "country")]
    transition = F.when(F.min("transition") < 0, -1).otherwise(F.max("transition")).alias("transition")
    return classified.withColumn("block", block_of(F.col("ts"), block_seconds)).repartition(*_BLOCK).groupBy(*_BLOCK, "ts").agg(*least, transition)


def running_state(collapsed: DataFrame) -> DataFrame:
    """Adds state and next_ts to rows with a block."""
    turn = F.when(F.col("transition") != 0, F.col("transition"))
    blocks = collapsed.groupBy(*_BLOCK).agg(F.max_by("transition", F.when(F.col("transition") != 0, F.col("ts"))).alias("turn"), F.min("ts").alias("first_ts"))
    carries = blocks.select(*_BLOCK, F.last("turn", ignorenulls=True).over(_before()).alias("state_in"), F.lead("first_ts").over(_by_block()).alias("first_after"))
    by_time = Window.partitionBy(*_BLOCK).orderBy("ts")
    so_far = F.last(turn, ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    rows = collapsed.join(carries, list(_BLOCK))
    rows = rows.withColumn("state", F.coalesce(so_far, "state_in", F.lit(0))).withColumn("next_ts", F.coalesce(F.lead("ts").over(by_time), "first_after"))
    return rows.drop("state_in", "first_after")


def segments(stated: DataFrame, cfg: EngineConfig, block_seconds: int) -> DataFrame:
    """As the engine's segments, with the block that a segment starts in."""
    return S.segments(stated, cfg).withColumn("block", block_of(F.col("seg_start"), block_seconds))


def islands(parts: DataFrame, split_on: tuple[str, ...] = ("platform", "user_id")) -> DataFrame:
    """As the engine's islands, from segments with a block."""
    row = F.struct("seg_start", *split_on)
    blocks = parts.groupBy(*_BLOCK).agg(F.max("seg_end").alias("end"), F.max_by(row, "seg_start").alias("last"))
    carries = blocks.select(*_BLOCK, F.max("end").over(_before()).alias("end_in"), F.lag("last").over(_by_block()).alias("last_in"))
    by_time = Window.partitionBy(*_BLOCK).orderBy("seg_start")
    so_far = F.max("seg_end").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.lag(row).over(by_time), "last_in")
    new = F.col("seg_start") > F.greatest(so_far, "end_in")  # greatest() leaves out nulls
    for c in split_on:
        new = new | (F.col(c) != before[c])
    numbered = parts.join(carries, list(_BLOCK)).withColumn("new", F.when(new, 1).otherwise(0))
    begun = numbered.groupBy(*_BLOCK).agg(F.sum("new").alias("begun"))
    begun = begun.select(*_BLOCK, F.coalesce(F.sum("begun").over(_before()), F.lit(0)).alias("begun_in"))
    island = F.col("begun_in") + F.sum("new").over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    numbered = numbered.join(begun, list(_BLOCK)).withColumn("island", island)
    least = [F.min(c).alias(c) for c in ("user_id", "content_id", "platform", "country")]
    merged = numbered.groupBy(SESSION, "island").agg(*least, F.min("seg_start").alias("active_start"), F.max("seg_end").alias("active_end"))
    return merged.where("active_end > active_start")


def islands_of_events(events: DataFrame, cfg: EngineConfig, rules: Rules = Rules(), block_seconds: int = 86_400) -> DataFrame:
    """From events to islands, no task holding more than a session's block (block_seconds should exceed the gap, for speed alone)."""
    stated = running_state(collapse(S.classify(events, rules), block_seconds))
    return islands(segments(stated, cfg, block_seconds))
