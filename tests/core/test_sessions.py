"""Hand-made sessions with known active intervals, and a loop in plain Python as a second opinion."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import made_up
from glimmer.config import EngineConfig, Rules
from glimmer.operators import cells, sessions, tiers
from glimmer.plans import serving, validation
from glimmer.plans.engine import Engine
from glimmer.sources import events as sources

T0 = datetime(2024, 1, 1)
CFG = EngineConfig()
EVENTS = "content_id long, video_session_id string, user_id string, event_type string, event string, event_timestamp timestamp, platform string, country string"
START, PLAY, BEAT, END = "VideoSessionStart", "VideoPlay", "VideoHeartbeat", "VideoSessionEnd"


def at(clock):
    minutes, seconds = clock.split(":")
    return T0 + timedelta(minutes=int(minutes), seconds=float(seconds))


def rows(steps, sid="s", content=1):
    """steps: (clock, type, marker, platform, user), the last three optional."""
    out = []
    for step in steps:
        clock, kind, marker, platform, user = (*step, *("x", "web", "u")[len(step) - 2 :])
        out.append((content, sid, user, kind, marker, at(clock), platform, "IN"))
    return out


def found(spark, events, cfg=CFG, rules=Rules()):
    merged = sessions.islands(sessions.active_segments(spark.createDataFrame(events, EVENTS), cfg, rules))
    return sorted((r["active_start"], r["active_end"], r["platform"], r["user_id"]) for r in merged.collect())


CASES = {
    "ends on the boundary": ([("0:00", START), ("1:00", BEAT), ("2:00", END)], [("0:00", "2:00")]),
    "pause and resume": ([("0:00", START), ("1:00", BEAT, "pause"), ("2:00", BEAT), ("3:00", BEAT, "resume"), ("4:00", END)], [("0:00", "1:00"), ("3:00", "4:00")]),
    "silence leaves the grace": ([("0:00", START)], [("0:00", "1:00")]),
    "gap of 90 bridges": ([("0:00", START), ("1:30", BEAT)], [("0:00", "2:30")]),
    "gap of 91 splits": ([("0:00", START), ("1:31", BEAT)], [("0:00", "1:00"), ("1:31", "2:31")]),
    "91 second boundaries split": ([("0:00.9", START), ("1:31", BEAT)], [("0:00.9", "1:00.9"), ("1:31", "2:31")]),
    "deactivation wins a tie": ([("0:00", START), ("0:00", BEAT, "pause")], []),
    "activation is tested first": ([("0:00", PLAY, "pause")], [("0:00", "1:00")]),
    "never started": ([("0:00", BEAT), ("1:00", BEAT)], []),
    "unknown type deactivates by marker": ([("0:00", START), ("0:30", "Odd", "speed-pause")], [("0:00", "0:30")]),
    "repeats and order don't matter": ([("4:00", END), ("0:00", START), ("1:00", BEAT, "pause"), ("0:00", START), ("3:00", BEAT, "resume"), ("2:00", BEAT)], [("0:00", "1:00"), ("3:00", "4:00")]),
}


@pytest.mark.parametrize("name", CASES)
def test_intervals(spark, name):
    steps, want = CASES[name]
    assert [(a, b) for a, b, _, _ in found(spark, rows(steps))] == [(at(a), at(b)) for a, b in want]


def test_switches_split(spark):
    got = found(spark, rows([("0:00", START, "x", "android"), ("1:00", BEAT, "x", "ios"), ("2:00", END, "x", "ios")]))
    assert [(a, b, p) for a, b, p, _ in got] == [(at("0:00"), at("1:00"), "android"), (at("1:00"), at("2:00"), "ios")]
    got = found(spark, rows([("0:00", START), ("1:00", BEAT, "x", "web", "v"), ("2:00", END)]))
    assert [u for *_, u in got] == ["u", "v"]


def landing(events):
    return events.select(
        "content_id", "video_session_id", "user_id", "event_type", "event", F.unix_millis("event_timestamp").alias("event_timestamp"), "platform", F.lit("1").alias("app_version"), "country",
        F.lit("hin").alias("audio_language"), F.lit("").alias("subtitle_language"), F.lit(" ").alias("player_version"), F.lit(0).cast("long").alias("session_start_epoch"),
    )


def engine(spark, events, **more):
    content = spark.createDataFrame([(1, "One", "vod", "film")], sources.CONTENT_SCHEMA)
    return Engine(landing(spark.createDataFrame(events, EVENTS)), content, CFG, as_of="2024-01-01 03:00:00", **more)


def test_cells(spark):
    steps = [("0:00", START, "x", "android"), ("0:30", BEAT, "x", "ios"), ("2:00", END, "x", "ios")]
    e = engine(spark, rows(steps) + rows([("0:00", START), ("1:00", END)], "t", -5))
    got = {(r["minute"].minute, r["platform"], r["content_id"]): r["concurrent"] for r in e.cells.collect()}
    assert got == {(0, "android", 1): 1, (0, "ios", 1): 1, (1, "ios", 1): 1, (0, "web", -5): 1}
    assert {r["video_type"] for r in e.cells.where("content_id = -5").collect()} == {""}
    exact = {r["minute"].minute: r["sessions"] for r in serving.exact_totals(e.atoms).collect()}
    assert exact == {0: 2, 1: 1}  # minute 0 sums to 3 over platforms


def test_curve_is_filled_and_filters(spark):
    e = engine(spark, rows([("0:00", START), ("0:30", END), ("4:00", PLAY), ("4:30", END)]))
    curve = [(r["minute"].minute, r["concurrent"]) for r in serving.curve(e.cells, CFG).orderBy("minute").collect()]
    assert curve == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 1)]
    wide = serving.curve(e.cells, CFG, "2023-12-31 23:59:30", "2024-01-01 00:05:10")
    assert wide.count() == 7 and wide.agg(F.sum("concurrent")).first()[0] == 2
    assert serving.curve(e.cells, CFG, platform="tv").agg(F.sum("concurrent")).first()[0] == 0
    assert serving.filtered(e.cells, content_id="0").count() == 2 and serving.filtered(e.cells, content_id="x").count() == 2
    kpi = serving.kpis(e.cells, CFG).first()
    assert (kpi["peak_concurrency"], kpi["peak_minute"].minute, kpi["avg_concurrency"], kpi["last_minute_concurrency"]) == (1, 0, 0.4, 1)


def test_long_and_short_session_through_tiers(spark):
    long = [("0:00", START)] + [(f"{m}:00", BEAT) for m in range(1, 120)] + [("120:00", END)]
    e = engine(spark, rows(long) + rows([("0:00", START), ("5:00", END)], "b"))
    cells_ = {(r["minute"], r["concurrent"]) for r in e.cells.collect()}
    assert {(r["minute"], r["concurrent"]) for r in e.now.collect()} == cells_ and len(cells_) == 120
    assert tiers.overlap(e.cold, e.hot).count() == 0
    empty = tiers.serve(e.cells.where("false"), e.cells)
    assert empty.count() == 120


def loop(events):
    """Active intervals of one session's (ts, transition) rows, step by step."""
    at_ms = {}
    for ts, t in events:
        at_ms.setdefault(ts, []).append(t)
    steps = sorted((ts, -1 if min(t) < 0 else max(t)) for ts, t in at_ms.items())
    state, out = 0, []
    for i, (ts, t) in enumerate(steps):
        state = t or state
        if state != 1:
            continue
        end = ts + timedelta(seconds=CFG.heartbeat_seconds)
        if i + 1 < len(steps) and int(steps[i + 1][0].timestamp()) - int(ts.timestamp()) <= CFG.gap_seconds:
            end = steps[i + 1][0]
        if out and ts <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([ts, end])
    return [tuple(x) for x in out]


def test_generated_sessions_against_the_loop_and_each_other(spark):
    made = made_up.generate(spark, 60, seed=5)
    assert made.orderBy("video_session_id", "event_timestamp").collect() == made.repartition(7).orderBy("video_session_id", "event_timestamp").collect()
    content = spark.createDataFrame([(i, f"T{i}", "vod", "film") for i in range(70, 72)], sources.CONTENT_SCHEMA)
    e = Engine(made, content, CFG, as_of="2024-01-03 00:00:00")
    by_session = {}
    for r in sessions.classify(e.events).collect():
        by_session.setdefault(r["video_session_id"], []).append((r["ts"], r["transition"]))
    got = {}
    for r in e.islands.orderBy("active_start").collect():
        got.setdefault(r["video_session_id"], []).append((r["active_start"], r["active_end"]))
    assert got == {s: x for s, steps in by_session.items() if (x := loop(steps))}
    keys = (*cells.CORE_DIMS, "minute")
    checks = {
        "aware = independent": validation.differences(e.cells, e.cells_independent, keys),
        "served = cells": validation.differences(e.now, e.cells, keys),
        "extended rolls up": validation.rollup_differences(e.cells_extended, e.cells),
    }
    assert {status for _, status, _ in validation.report(checks)} == {"PASS"}
    assert tuple(validation.array_atoms_differences(e.events, e.atoms, CFG).first())[:2] == (0, 0)
    assert validation.paused_inside(e.events, e.intervals).first()["inside_active_interval"] == 0
    wrong = e.cells.withColumn("concurrent", F.col("concurrent") + F.when(F.col("platform") == "web", 1).otherwise(0))
    assert validation.differences(wrong, e.cells, keys).count() == e.cells.where("platform = 'web'").count() > 0


def test_seed_scenario(spark):
    made, content = sources.seed_scenario(spark, "2024-01-01 12:00:00")
    e = Engine(made, content, CFG, as_of="2024-01-01 12:00:00")
    got = {r["video_session_id"]: [(iv["active_start"].strftime("%H:%M"), iv["active_end"].strftime("%H:%M")) for iv in r["intervals"]] for r in e.sessions.collect()}
    assert got == {"sA": [("11:51", "11:54"), ("11:56", "11:57"), ("11:59", "12:00")], "sB": [("11:54", "11:56"), ("11:57", "11:58")], "sC": [("11:57", "11:58")]}
    assert {r["video_session_id"] for r in e.sessions.where("is_provisional").collect()} == {"sA"}
