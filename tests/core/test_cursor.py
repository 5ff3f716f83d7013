"""The stream of session cursors against the batch engine: shuffled batches, restarts, timers, late rows."""

import json
import os
import random
import shutil

from pyspark.sql import functions as F

import made_up
from glimmer.config import EngineConfig
from glimmer.plans.engine import Engine
from glimmer.sources import events as sources
from glimmer.streaming.cursor import Cursor, Event, SessionStream, fold

COLUMNS = ("video_session_id", "user_id", "content_id", "platform", "country", "active_start", "active_end")


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def put(folder, i, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
    os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in this order


def test_restarted_on_shuffled_batches_without_history_equals_batch(spark, tmp_path):
    cfg = EngineConfig()
    made = [r.asDict() for r in made_up.generate(spark, 30, seed=3).collect()]
    for r in made[::7]:  # attributes change within a session
        r["user_id"], r["platform"] = r["user_id"] + "x", None if r["event_timestamp"] % 2 else "car"
    rng = random.Random(1)
    made.sort(key=lambda r: r["event_timestamp"] + rng.randrange(900_000))  # up to 15 minutes late
    n = len(made)
    parts = [made[i * n // 6 : (i + 1) * n // 6] for i in range(6)]
    parts[3] = parts[3] + parts[2][-40:]  # rows that are sent again
    whole = tmp_path / "whole"
    for i, part in enumerate(parts):
        put(whole, i, part)
    stream = SessionStream(spark, f"{tmp_path}/live", cfg, delay="20 minutes")
    landing, kept = tmp_path / "in", tmp_path / "kept"
    kept.mkdir()
    for some in ((0, 1, 2), (3, 4), (5,)):
        for old in landing.glob("*"):
            old.unlink()
        for i in some:
            put(landing, i, parts[i])
        query = stream.start(sources.stream_json(spark, str(landing), 1), f"{tmp_path}/checkpoint", every=None)
        query.awaitTermination(300)
        # No batch reads what earlier ones were given or have written: both are taken away before the next.
        for part in (tmp_path / "live" / "intervals").glob("batch=*"):
            shutil.move(str(part), str(kept))
    for part in kept.glob("batch=*"):
        shutil.move(str(part), f"{tmp_path}/live/intervals")
    content = spark.createDataFrame([(i, f"T{i}", "vod", "film") for i in range(70, 73)], sources.CONTENT_SCHEMA)
    batch = Engine(sources.read_json(spark, str(whole)), content, cfg, as_of="2024-01-03 00:00:00")
    assert rows_of(stream.islands()) == rows_of(batch.islands)
    key = lambda df: sorted(map(tuple, df.select("minute", "platform", "content_id", "country", "video_type", "concurrent", "concurrent_users").collect()), key=str)
    assert key(stream.cells(content)) == key(batch.cells)
    final = stream.islands().where("NOT is_provisional")
    assert final.count() > 0.8 * batch.islands.count()
    assert final.count() == final.select("video_session_id", "active_start").distinct().count()


def landing_row(session, second, kind="VideoHeartbeat", marker=""):
    base = {"content_id": 7, "user_id": "u", "platform": "web", "app_version": "1", "country": "NO", "audio_language": "x", "subtitle_language": "x", "player_version": "1", "session_start_epoch": 0}
    return base | {"video_session_id": session, "event_type": kind, "event": marker, "event_timestamp": 1_704_067_200_000 + second * 1000}


def test_timers_close_and_forget_silent_sessions_and_late_rows_are_dropped(spark, tmp_path):
    cfg = EngineConfig(events_ttl_days=0)  # a session is forgotten as soon as it is closed
    put(tmp_path / "in", 0, [landing_row("silent", 0, "VideoPlay"), landing_row("ended", 0, "VideoPlay"), landing_row("ended", 30, "VideoSessionEnd"), landing_row("on", 0, "VideoPlay"), landing_row("taken back", 0, "VideoPlay")])
    put(tmp_path / "in", 1, [landing_row("on", 80 + 80 * i) for i in range(4)] + [landing_row("taken back", 0, marker="pause", kind="Odd")])
    put(tmp_path / "in", 2, [landing_row("on", 400), landing_row("on", 480)])
    put(tmp_path / "in", 3, [landing_row("on", 560), landing_row("late", 5, "VideoPlay")])
    stream = SessionStream(spark, f"{tmp_path}/live", cfg, delay="1 minute")
    query = stream.start(sources.stream_json(spark, f"{tmp_path}/in", 1), f"{tmp_path}/checkpoint", every=None)
    query.awaitTermination(300)
    got = {(r["video_session_id"], (r["active_end"] - r["active_start"]).total_seconds(), r["is_provisional"]) for r in stream.islands().collect()}
    # 'on' beats until 560 and may go on; the others are closed for good, and 'late' came 400 seconds behind the watermark.
    assert got == {("silent", 60.0, False), ("ended", 30.0, False), ("on", 620.0, True)}
    closed = spark.read.parquet(f"{tmp_path}/live/intervals").where("video_session_id = 'silent' AND NOT is_provisional").select("batch").first()["batch"]
    assert closed > 0  # in a batch without an event of its own
    progress = [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
    assert sum(p.numRowsDroppedByWatermark for p in progress) == 1
    state = spark.read.format("state-metadata").load(f"{tmp_path}/checkpoint")
    assert state.where("operatorName LIKE '%ransformWithState%'").count() > 0
    cursors = spark.read.format("statestore").option("stateVarName", "cursor").load(f"{tmp_path}/checkpoint")
    assert [r[0] for r in cursors.select("key.video_session_id").collect()] == ["on"]


def test_fold_keeps_batch_rules():
    """Ties by time, switches with unknown values, silence and resumption, step by step."""
    cfg = EngineConfig()
    event = lambda s, t, user="u", platform="web": Event(s * 1000, t, user, platform, 7, "NO")
    assert event(0, 1).merged(event(0, -1)).transition == -1 and event(0, 0).merged(event(0, 1)).transition == 1
    cursor, final = fold(Cursor(), [event(0, 1), event(60, 0, platform=None), event(120, 0, platform="car"), event(180, -1), event(240, 0), event(300, 1)], cfg)
    # An unknown platform differs from none, so the stretches to 180 are one interval with the smallest value known.
    assert [(i.start // 1000, i.end // 1000, i.platform) for i in final] == [(0, 180, "car")] and cursor.open is None
    cursor, final = fold(cursor, [event(391, 0)], cfg)
    assert [(i.start // 1000, i.end // 1000) for i in final] == [(300, 360)]
    assert cursor.silent(60_000)[1][0].end == 451_000 and cursor.silent(60_000)[0].silent(60_000)[1] == []
