"""Active intervals as a stream: a cursor for each session in the state store, closed by event-time timers.

A trigger reads its own events and the state of the sessions that they touch,
never their history.  Events wait in the state until the watermark has passed
them, so they may come in any order within the watermark's delay; then they are
folded into the cursor: the last transition, the last event, and the interval
that is open.  An interval that nothing can lengthen any more is given out as
final, once.  What still can change (the open interval, and what the waiting
events make of it) is given out as provisional each time that the session changes, and
the newest version of that counts.

A session that falls silent is closed by a timer when the watermark passes the
gap, without an event of its own; a later timer forgets the session altogether.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from glimmer.config import EngineConfig, Rules
from glimmer.operators import cells as C
from glimmer.operators import sessions as S

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ATTRIBUTES = "user_id string, platform string, content_id long, country string"
_CURSOR = f"state int, last_ts long, {_ATTRIBUTES}, closed boolean, open_start long, open_end long, open_user_id string, open_platform string, open_content_id long, open_country string, open_last_user_id string, open_last_platform string, version long, provisional boolean, timer long"
_WAITING = f"ts long, transition int, {_ATTRIBUTES}"
OUTPUT = f"{S.SESSION} string, {_ATTRIBUTES}, active_start timestamp, active_end timestamp, is_provisional boolean, version long"
_Output = Row(*(c.split()[0] for c in OUTPUT.split(", ")))


def _least(x, y):
    return y if x is None else x if y is None else min(x, y)


@dataclass(frozen=True)
class Event:
    """All events of one session in one millisecond."""

    ts: int
    transition: int
    user_id: str | None
    platform: str | None
    content_id: int | None
    country: str | None

    def merged(self, other: Event) -> Event:
        """Deactivation outranks activation, which outranks neutral; the smallest of each attribute."""
        turn = -1 if -1 in (self.transition, other.transition) else max(self.transition, other.transition)
        return Event(self.ts, turn, _least(self.user_id, other.user_id), _least(self.platform, other.platform), _least(self.content_id, other.content_id), _least(self.country, other.country))


@dataclass(frozen=True)
class Interval:
    """The smallest value of each attribute, and those of the last stretch, which tell whether the next one may join."""

    start: int
    end: int
    user_id: str | None
    platform: str | None
    content_id: int | None
    country: str | None
    last_user_id: str | None
    last_platform: str | None


@dataclass(frozen=True)
class Cursor:
    """Where a session stands after the events that are folded in.  closed: the last event's stretch is in `open` or given out."""

    state: int = 0
    last: Event | None = None
    closed: bool = True
    open: Interval | None = None

    def ended(self, end: int) -> tuple[Cursor, list[Interval]]:
        """The last event's stretch ends: it lengthens the open interval, or that is final and another one is open."""
        e = self.last
        part, o = Interval(e.ts, end, e.user_id, e.platform, e.content_id, e.country, e.user_id, e.platform), self.open
        if o and part.start <= o.end and not _differ(o.last_platform, part.platform) and not _differ(o.last_user_id, part.user_id):
            joined = Interval(o.start, max(o.end, end), _least(o.user_id, part.user_id), _least(o.platform, part.platform), _least(o.content_id, part.content_id), _least(o.country, part.country), e.user_id, e.platform)
            return replace(self, closed=True, open=joined), []
        return replace(self, closed=True, open=part), [self.open] if self.open else []

    def silent(self, heartbeat_ms: int) -> tuple[Cursor, list[Interval]]:
        """No event follows within the gap: the heartbeat's grace ends the stretch, and nothing can lengthen the interval."""
        now, out = (self, []) if self.closed else self.ended(self.last.ts + heartbeat_ms)
        return replace(now, open=None), out + ([now.open] if now.open else [])

    def after(self, event: Event, cfg: EngineConfig) -> tuple[Cursor, list[Interval]]:
        """The next event in time, and the intervals that are final with it."""
        now, out = self, []
        if not self.closed:
            if event.ts // 1000 - self.last.ts // 1000 <= cfg.gap_seconds:
                now, out = self.ended(event.ts)
            else:
                now, out = self.silent(1000 * cfg.heartbeat_seconds)
        state = event.transition or now.state
        if state != 1 and now.open:  # whatever comes later starts after its end
            out, now = [*out, now.open], replace(now, open=None)
        return replace(now, state=state, last=event, closed=state != 1), out


def _differ(x, y) -> bool:
    """As SQL's <>: an unknown value doesn't differ."""
    return x is not None and y is not None and x != y


def fold(cursor: Cursor, events: list[Event], cfg: EngineConfig) -> tuple[Cursor, list[Interval]]:
    out: list[Interval] = []
    for event in events:
        cursor, final = cursor.after(event, cfg)
        out += final
    return cursor, out


class SessionCursor(StatefulProcessor):
    """The stateful processor of one stream; its state is a cursor and the waiting events of each session."""

    def __init__(self, cfg: EngineConfig) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", _CURSOR)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [Event(r["ts_millis"], r["transition"], r["user_id"], r["platform"], r["content_id"], r["country"]) for r in rows]
        return self._step(key[0], fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._step(key[0], [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _step(self, session: str, fresh: list[Event], watermark: int, fired: int | None = None) -> Iterator[Row]:
        cfg, kept = self.cfg, self.cursor.get() if self.cursor.exists() else None
        cursor, version, had, timer = Cursor(), 0, False, None
        if kept:
            last = Event(kept[1], 0, *kept[2:6]) if kept[1] is not None else None
            opened = Interval(*kept[7:15]) if kept[7] is not None else None
            cursor, version, had, timer = Cursor(kept[0], last, kept[6], opened), kept[15], kept[16], kept[17]
        by_ts: dict[int, Event] = {}
        for e in [*(Event(*r) for r in (self.waiting.get() if self.waiting.exists() else ())), *fresh]:
            by_ts[e.ts] = by_ts[e.ts].merged(e) if e.ts in by_ts else e
        events = [by_ts[ts] for ts in sorted(by_ts)]
        # A row as old as the last folded event came behind the watermark: the batch engine would have had it, the stream has not.
        events = [e for e in events if not cursor.last or e.ts > cursor.last.ts]
        done = [e for e in events if e.ts < watermark]
        waiting = events[len(done) :]
        cursor, final = fold(cursor, done, cfg)
        if cursor.last and not waiting and watermark >= self._silent_at(cursor.last.ts):
            cursor, more = cursor.silent(1000 * cfg.heartbeat_seconds)
            final += more
        ahead, provisional = fold(cursor, waiting, cfg)
        provisional += ahead.silent(1000 * cfg.heartbeat_seconds)[1]

        forget = None if waiting or not cursor.last else cursor.last.ts + 86_400_000 * cfg.events_ttl_days
        if timer is not None and timer != fired:
            self.handle.deleteTimer(timer)
        if forget is not None and watermark >= forget:
            self.cursor.clear()
            self.waiting.clear()
        else:
            # The next time at which this session changes by itself: its events are all behind the watermark, its gap is over, or it is forgotten.
            timer = waiting[-1].ts + 1 if waiting else self._silent_at(cursor.last.ts) if cursor.open or not cursor.closed else forget
            self.handle.registerTimer(timer)
            self.waiting.put([(e.ts, e.transition, e.user_id, e.platform, e.content_id, e.country) for e in waiting]) if waiting else self.waiting.clear()
            e, o = cursor.last, cursor.open
            self.cursor.update((
                cursor.state, *((e.ts, e.user_id, e.platform, e.content_id, e.country) if e else (None,) * 5), cursor.closed,
                *((o.start, o.end, o.user_id, o.platform, o.content_id, o.country, o.last_user_id, o.last_platform) if o else (None,) * 8), version + 1, bool(provisional), timer,
            ))
        rows = [(i, False) for i in final] + [(i, True) for i in provisional]
        for i, flag in rows:
            if i.end > i.start:
                yield _Output(session, i.user_id, i.platform, i.content_id, i.country, _time(i.start), _time(i.end), flag, version + 1)
        if had and not rows:  # what was provisional is so no more
            yield _Output(session, None, None, None, None, None, None, True, version + 1)

    def _silent_at(self, ts: int) -> int:
        """The first millisecond at which an event would be beyond the gap."""
        return (ts // 1000 + self.cfg.gap_seconds + 1) * 1000


def _time(millis: int):
    from datetime import datetime, timedelta, timezone

    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=millis)


class SessionStream:
    """Keeps the intervals of a stream of landing rows under `root`, a folder that the whole cluster shares.

    Events may be late by `delay`; those that come later still are dropped by
    the watermark, and the query's progress counts them.  Needs the RocksDB
    state store, which start() sets for the session.
    """

    def __init__(self, spark: SparkSession, root: str, cfg: EngineConfig = EngineConfig(), rules: Rules = Rules(), delay: str = "10 minutes") -> None:
        self.spark, self.root, self.cfg, self.rules, self.delay = spark, root.rstrip("/"), cfg, rules, delay

    def changes(self, landing: DataFrame) -> DataFrame:
        """The stream of final and provisional intervals."""
        timed = S.project_landing(landing).where(f"{S.SESSION} IS NOT NULL").withWatermark("event_timestamp", self.delay)
        # Deactivation and activation as in the batch engine; the time column keeps its watermark.
        rows = S.classify(timed, self.rules).withColumn("ts_millis", F.unix_millis("ts"))
        return rows.groupBy(S.SESSION).transformWithState(statefulProcessor=SessionCursor(self.cfg), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")

    def _write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/intervals/batch={batch}")

    def start(self, landing: DataFrame, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
        """Runs on a stream of landing rows; with every=None, over what is there, and then ends.  A batch that is tried again replaces its own part."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        trigger = {"availableNow": True} if every is None else {"processingTime": every}
        out = self.changes(landing).writeStream.outputMode("update").foreachBatch(self._write).option("checkpointLocation", checkpoint)
        return out.trigger(**trigger).start()

    def islands(self) -> DataFrame:
        """The intervals as they stand, in the batch engine's columns: all final ones, and the newest provisional ones of each session."""
        rows = self.spark.read.option("basePath", f"{self.root}/intervals").parquet(f"{self.root}/intervals/batch=*").drop("batch")
        newest = rows.groupBy(S.SESSION).agg(F.max("version").alias("newest"))
        kept = rows.join(newest, S.SESSION).where("active_start IS NOT NULL AND (NOT is_provisional OR version = newest)")
        return kept.select(S.SESSION, "user_id", "content_id", "platform", "country", "active_start", "active_end", "is_provisional")

    def cells(self, content: DataFrame) -> DataFrame:
        """Exact cells of the intervals as they stand."""
        rows = self.islands()
        of = rows.groupBy(S.SESSION).agg(F.min("content_id").alias("content_id"), F.min("country").alias("country"))
        return C.count_cells(C.expand(S.enrich(rows.drop("content_id", "country").join(of, S.SESSION), content), self.cfg))
