"""Checks that hold served numbers against independent ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.config import CORE_DIMS, EXTENDED_DIMS, EngineConfig, Rules
from glimmer.functions.scalar import bucket_floor, last_instant, plus_seconds, seconds_between
from glimmer.operators import cells as C
from glimmer.operators import sessions as S

SESSION = S.SESSION
VALUES = ("concurrent", "concurrent_users")


def differences(left: DataFrame, right: DataFrame, keys: tuple[str, ...], values: tuple[str, ...] = VALUES) -> DataFrame:
    """Keys whose values differ, a missing side counting as 0: one full join on the keys."""
    names = lambda df, side: df.select(*keys, *[F.col(v).alias(f"{v}_{side}") for v in values])
    both = names(left, "a").join(names(right, "b"), list(keys), "full")
    both = both.select(*keys, *[F.coalesce(f"{v}_{s}", F.lit(0)).cast("long").alias(f"{v}_{s}") for v in values for s in "ab"])
    wrong = F.lit(False)
    for v in values:
        wrong = wrong | ~F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_b"))
    return both.where(wrong)


def scorecard(aware: DataFrame, independent: DataFrame) -> DataFrame:
    """One row: cells on either side, session totals, and cells that differ."""
    keys = (*CORE_DIMS, "minute")
    one = lambda df, side: df.agg(F.count("*").alias(f"cells_{side}"), F.sum("concurrent").cast("long").alias(f"total_{side}"))
    wrong = differences(aware, independent, keys).agg(F.count("*").alias("cell_mismatches"))
    return one(aware, "sa").join(F.broadcast(one(independent, "si"))).join(F.broadcast(wrong))  # a row each


def rollup_differences(ext: DataFrame, core: DataFrame) -> DataFrame:
    """Where the extended cells' session sums differ from the core cells."""
    keys = (*CORE_DIMS, "minute")
    return differences(ext.groupBy(*keys).agg(F.sum("concurrent").alias("concurrent")), core, keys, ("concurrent",))


def array_segments(events: DataFrame, cfg: EngineConfig, rules: Rules = Rules()) -> DataFrame:
    """Segments by arrays instead of windows: each session's sorted transitions, filled forward.

    A structurally different way to the same rows, for checking: a session's history is one array.
    """
    steps = S.collapse(S.classify(events, rules)).groupBy(SESSION).agg(F.array_sort(F.collect_list(F.struct("ts", "transition", "user_id", "platform", "content_id", "country"))).alias("steps"))
    places = F.sequence(F.lit(0), F.size("steps") - 1)
    rows = steps.withColumn("turns", F.filter(places, lambda i: F.get("steps", i)["transition"] != 0))
    # From each turn to the next, that one included: of those that activate, every step but the next turn is active.
    part = F.transform("turns", lambda b, k: F.slice("steps", b + 1, F.coalesce(F.get("turns", k + 1), F.size("steps")) - b + 1))
    rows = rows.select(SESSION, F.posexplode(part).alias("k", "part"), (F.size("turns") - 1).alias("last")).where(F.get("part", F.lit(0))["transition"] == 1)
    pairs = F.zip_with("part", F.slice("part", 2, 1 << 30), lambda step, following: F.struct(step.alias("step"), following["ts"].alias("next_ts")))
    active = F.slice(pairs, F.lit(1), F.size("part") - F.when(F.col("k") < F.col("last"), 1).otherwise(0))
    rows = rows.select(SESSION, F.inline(active)).select(SESSION, "step.user_id", "step.platform", "step.content_id", "step.country", F.col("step.ts").alias("seg_start"), "next_ts")
    end = F.when(seconds_between(F.col("seg_start"), F.col("next_ts")) <= cfg.gap_seconds, F.col("next_ts")).otherwise(plus_seconds(F.col("seg_start"), cfg.heartbeat_seconds))
    return rows.withColumn("seg_end", end).drop("next_ts")


def array_cells(events: DataFrame, content: DataFrame, cfg: EngineConfig, rules: Rules = Rules()) -> DataFrame:
    """Cells from the segments of arrays, without islands: independent of what is served."""
    return C.session_independent(array_segments(events, cfg, rules), content, cfg)


def array_cells_extended(events: DataFrame, content: DataFrame, cfg: EngineConfig, rules: Rules = Rules()) -> DataFrame:
    """Extended cells in the same way."""
    parts = array_segments(events, cfg, rules).withColumnsRenamed({"seg_start": "active_start", "seg_end": "active_end"})
    rows = S.enrich(parts, content).join(C.latest_attributes(events), SESSION)
    return C.count_cells(C.expand(rows, cfg), (*CORE_DIMS, "minute", *EXTENDED_DIMS))


def totals(**sides: tuple[DataFrame, str]) -> DataFrame:
    """One row: the sum of each side's column."""
    out = None
    for name, (rows, column) in sides.items():
        one = rows.agg(F.sum(column).cast("long").alias(name))
        out = one if out is None else out.join(F.broadcast(one))  # a row each
    return out


def three_way(**sides: DataFrame) -> DataFrame:
    """Session totals of each minute by every side, which should agree, and whether they do: full joins, a missing side counting as 0."""
    out = None
    for name, cells in sides.items():
        one = cells.groupBy("minute").agg(F.sum("concurrent").alias(name))
        out = one if out is None else out.join(one, "minute", "full")
    counts = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in sides]
    out = out.select("minute", *counts)
    first = next(iter(sides))
    agree = F.lit(True)
    for name in sides:
        agree = agree & (F.col(name) == F.col(first))
    return out.withColumn("agree", agree)


def beside(left: DataFrame, right: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], names: tuple[str, str]) -> DataFrame:
    """The values of two sides by key, null where a side has none, and whether all agree."""
    one, other = (df.select(*keys, *[F.col(v).alias(f"{v}_{n}") for v in values]) for df, n in zip((left, right), names, strict=True))
    agree = F.lit(True)
    for v in values:
        agree = agree & F.col(f"{v}_{names[0]}").eqNullSafe(F.col(f"{v}_{names[1]}"))
    return one.join(other, list(keys), "full").withColumn("agree", agree)


def served_and_exact(cells: DataFrame, atoms: DataFrame) -> DataFrame:
    """Minutes in which the sum of served sessions isn't the number of distinct ones: sessions that switch a dimension within the bucket."""
    served = cells.groupBy("minute").agg(F.sum("concurrent").cast("long").alias("served"))
    exact = atoms.groupBy("minute").agg(F.count_distinct(SESSION).alias("exact"))
    both = served.join(exact, "minute", "full").select("minute", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("served", "exact")])
    return both.where("served <> exact")


def array_atoms_differences(events: DataFrame, atoms: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Counts of (session, bucket) pairs of both ways, and of those that just one of them has; anti joins both ways."""
    parts = array_segments(events, cfg).withColumnsRenamed({"seg_start": "active_start", "seg_end": "active_end"})
    one = C.expand(parts, cfg).select(SESSION, "minute").distinct()
    other = atoms.select(SESSION, "minute").distinct()
    lone = lambda a, b, name: a.join(b, [SESSION, "minute"], "left_anti").agg(F.count("*").alias(name))
    return lone(one, other, "only_arrays").join(F.broadcast(lone(other, one, "only_windows"))).join(F.broadcast(one.agg(F.count("*").alias("by_arrays"))))  # a row each


def start_only_samples(events: DataFrame, intervals: DataFrame, rules: Rules = Rules(), k: int = 10) -> DataFrame:
    """The k latest sessions that only a start activated, with their intervals' span and number."""
    spans = intervals.groupBy(SESSION).agg(F.min("active_start").alias("active_start"), F.max("active_end").alias("active_end"), F.count("*").alias("interval_count"))
    firsts = events.groupBy(SESSION).agg(F.min("event_timestamp").alias("session_start_ts"))
    rows = start_only_sessions(events, rules).join(firsts, SESSION).join(spans, SESSION)
    return rows.orderBy(F.desc("session_start_ts"), SESSION).limit(k)


def paused_samples(events: DataFrame, intervals: DataFrame, rules: Rules = Rules(), k: int = 10) -> DataFrame:
    """The k sessions with the most deactivated instants, with their intervals' span and number."""
    paused = S.running_state(S.collapse(S.classify(events, rules))).where("state = -1").groupBy(SESSION).agg(F.count("*").alias("paused_instants"))
    spans = intervals.groupBy(SESSION).agg(F.count("*").alias("active_intervals"), F.min("active_start").alias("first_active"), F.max("active_end").alias("last_active"))
    return paused.join(spans, SESSION).orderBy(F.desc("paused_instants"), SESSION).limit(k)


def paused_inside(events: DataFrame, intervals: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row: deactivated instants, their sessions, and how many lie in an active interval of theirs (none should)."""
    paused = S.running_state(S.collapse(S.classify(events, rules))).where("state = -1").select(SESSION, "ts")
    inside = points_in_intervals(paused, intervals.select(SESSION, "active_start", "active_end"))
    counts = paused.agg(F.count("*").alias("deactivated_instants"), F.count_distinct(SESSION).alias("sessions_with_paused_state"))
    return counts.join(F.broadcast(inside.agg(F.count("*").alias("inside_active_interval"))))


def points_in_intervals(points: DataFrame, intervals: DataFrame, bin_seconds: int = 3600) -> DataFrame:
    """points(session, ts, ...) joined with the intervals(session, active_start, active_end, ...) of theirs that hold ts.

    A binned join: an interval is in each bin of time that it touches, a point
    in one, so a pair meets once, and a point meets what is near it, not all
    intervals of its session.
    """
    binned = points.withColumn("bin", F.floor(F.unix_seconds("ts") / bin_seconds))
    first, last = (F.floor(F.unix_seconds(c) / bin_seconds) for c in (F.col("active_start"), last_instant(F.col("active_end"))))
    spread = intervals.where("active_end > active_start").withColumn("bin", F.explode(F.sequence(first, last)))
    return binned.join(spread, [SESSION, "bin"]).where("active_start <= ts AND ts < active_end").drop("bin")


def start_only_sessions(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Sessions with a start and a beat but no other activation."""
    play = F.col("event_type").isin("VideoPlay", "AppForegrounded") | F.col("event").isin(*rules.activating_markers)
    found = events.groupBy(SESSION).agg(F.count_if(F.col("event_type") == "VideoSessionStart").alias("starts"), F.count_if(F.col("event_type") == "VideoHeartbeat").alias("beats"), F.count_if(play).alias("plays"))
    return found.where("starts > 0 AND beats > 0 AND plays = 0").select(SESSION)


def start_only(events: DataFrame, intervals: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row: sessions with a start and a beat but no other activation, and how many of them have an interval."""
    found = start_only_sessions(events, rules)
    have = intervals.select(SESSION).distinct().withColumn("has", F.lit(1))
    return found.join(have, SESSION, "left").agg(F.count("*").alias("start_only_sessions"), F.count("has").alias("with_active_interval"), F.count_if(F.col("has").isNull()).alias("missing"))


def lead_in(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row: how long sessions wait between their start and their first play."""
    play = (F.col("event_type") == "VideoPlay") | F.col("event").isin(*rules.activating_markers)
    first = lambda cond: F.min(F.when(cond, F.col("event_timestamp")))
    waits = events.groupBy(SESSION).agg(first(F.col("event_type") == "VideoSessionStart").alias("s"), first(play).alias("p")).where("s IS NOT NULL AND p IS NOT NULL")
    gap = seconds_between(F.col("s"), F.col("p"))
    waits = waits.select(gap.alias("gap"))
    late = F.count_if(F.col("gap") > 0)
    return waits.agg(F.count("*").alias("sessions_with_start_and_play"), late.alias("sessions_with_lead_in"), F.round(100.0 * late / F.count("*"), 1).alias("pct_with_lead_in"), F.round(F.avg(F.when(F.col("gap") > 0, F.col("gap"))), 1).alias("avg_lead_in_seconds"))


def repeats_in_bucket(intervals: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Sessions with more than one interval that starts in the same bucket."""
    return intervals.groupBy(SESSION, bucket_floor(F.col("active_start"), cfg.bucket_seconds).alias("minute")).agg(F.count("*").alias("intervals_in_minute")).where("intervals_in_minute > 1")


def naive_comparison(events: DataFrame, cells: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Each served bucket beside the naive heartbeat count."""
    served = cells.groupBy("minute").agg(F.sum("concurrent").cast("long").alias("served"))
    return served.join(C.naive(events, cfg), "minute", "left").select("minute", "served", F.coalesce("naive", F.lit(0)).alias("naive"))


def report(checks: dict[str, DataFrame]) -> list[tuple[str, str, int]]:
    """(name, PASS or FAIL, rows) of checks that expect no row."""
    out = []
    for name, rows in checks.items():
        n = rows.count()
        out.append((name, "FAIL" if n else "PASS", n))
    return out
