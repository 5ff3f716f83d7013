"""Late events against a backfill, and the small tables as streaming state."""

import json
import os

from pyspark.sql import functions as F

import made_up
from glimmer.config import EngineConfig
from glimmer.operators import cells, tiers
from glimmer.plans import queries
from glimmer.plans.engine import Engine
from glimmer.sources import events as sources
from glimmer.streaming.live import LiveEngine
from glimmer.streaming.seen import SeenStream, state_rows

CONTENT = [(i, f"T{i}", "vod", "film") for i in range(70, 73)]


def figures(cells_):
    return sorted(map(tuple, cells_.select(*tiers.CELL_KEY, "concurrent", "concurrent_users").collect()), key=str)


def test_cold_and_hot_equal_a_backfill_after_late_events(spark, tmp_path):
    # Two sessions share a user; a quarter of the rows come hours late, among them a session's only activation.
    made = made_up.generate(spark, 24, seed=11).withColumn("n", F.pmod(F.xxhash64("video_session_id", "event_timestamp"), F.lit(4)))
    made = made.withColumn("country", F.when(F.col("n") == 1, "AA").otherwise(F.col("country"))).cache()
    content = spark.createDataFrame(CONTENT, sources.CONTENT_SCHEMA)
    cfg = EngineConfig(hot_window_seconds=1800)
    middle = 1_704_067_200_000 + 50_000_000
    steps = [made.where(f"n <> 1 AND event_timestamp < {middle}"), made.where(f"n <> 1 AND event_timestamp >= {middle}"), made.where("n = 1 AND event_type <> 'VideoPause'"), made.where("n = 1")]
    lives = [LiveEngine(spark, f"{tmp_path}/{frozen}", content, cfg, frozen=frozen) for frozen in (False, True)]
    for i, rows in enumerate(steps):
        for live in lives:
            live.process(rows.drop("n"), i)
    late, frozen = lives
    want = figures(Engine(made.drop("n"), content, cfg, as_of="2024-01-05 00:00:00").cells)
    assert figures(late.now()) == want
    assert figures(frozen.now()) != want and not frozen.has("corrections")
    signs = late._read("corrections").where("batch = 2").agg(F.min("concurrent"), F.max("concurrent"), F.min("concurrent_users"), F.max("concurrent_users")).first()
    assert signs[0] < 0 < signs[1] and signs[2] < 0 < signs[3]
    late.process(steps[3].drop("n"), 3)  # a retry changes nothing
    assert figures(late.now()) == want
    assert late.compact("2000-01-01") == 0 and figures(late.now()) == want
    late.process(steps[0].limit(20).drop("n"), 4)  # rows that are sent again correct nothing
    assert figures(late.now()) == want and not (tmp_path / "False" / "corrections" / "batch=4").exists()
    assert late.compact("2000-01-01") > 0 and figures(late.now()) == want
    made.unpersist()


def row(session, user, second, kind, marker=""):
    base = {"content_id": 7, "platform": "web", "app_version": "1", "country": "NO", "audio_language": "x", "subtitle_language": "x", "player_version": "1", "session_start_epoch": 0}
    return base | {"video_session_id": session, "user_id": user, "event_type": kind, "event": marker, "event_timestamp": 1_704_067_200_000 + second * 1000}


def landed(spark, rows):
    names = [c.split()[0] for c in sources.LANDING_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], sources.LANDING_SCHEMA)


def test_a_session_of_which_nothing_is_left_and_a_user_whom_another_keeps(spark, tmp_path):
    landing = lambda *rows: landed(spark, rows)
    content = spark.createDataFrame([], sources.CONTENT_SCHEMA)
    live = LiveEngine(spark, f"{tmp_path}/live", content, EngineConfig(hot_window_seconds=600))
    first = landing(row("a", "u", 0, "VideoPlay"), row("b", "u", 10, "VideoPlay"), row("c", None, 20, "VideoPlay"))
    live.process(first, 0)
    live.process(landing(row("z", "w", 7200, "VideoPlay")), 1)
    start = lambda: {(str(r["minute"])[11:16], r["concurrent"], r["concurrent_users"]) for r in live.now().collect()}
    assert ("00:00", 3, 1) in start()
    live.process(landing(row("a", "u", 0, "VideoPause")), 2)  # in the same millisecond, and it outranks the start
    assert ("00:00", 2, 1) in start() and live.intervals().where("video_session_id = 'a'").count() == 0
    live.process(landing(row("b", "u", 10, "VideoPause"), row("c", None, 20, "VideoError"), row("d", "v", 61, "VideoPlay")), 3)
    got = start()
    assert not [r for r in got if r[0] == "00:00"] and ("00:01", 1, 1) in got


def test_minutes_beyond_the_intervals_retention_are_final(spark, tmp_path):
    landing = lambda *rows: landed(spark, rows)
    content = spark.createDataFrame([], sources.CONTENT_SCHEMA)
    live = LiveEngine(spark, f"{tmp_path}/live", content, EngineConfig(intervals_ttl_days=1))
    live.process(landing(row("a", "u", 0, "VideoPlay")), 0)
    for i in (1, 2):
        live.process(landing(row("z", "w", 3 * 86_400 + i, "VideoPlay")), i)
    live.compact()  # drops the intervals of a, whose cells stay
    assert live.intervals().where("video_session_id = 'a'").count() == 0
    before = figures(live.now())
    live.process(landing(row("a", "u", 0, "VideoPlay"), row("a", "u", 50, "VideoHeartbeat")), 3)
    assert figures(live.now()) == before  # not counted twice


def test_the_registered_correction_changes_cells(spark):
    e = queries.engine(spark, "/root/testdata/sf0.001")
    late = F.col("event_type").isin("AppBackgrounded", "VideoError")
    early = Engine(e.landing.where(~late), e.content, e.cfg, as_of=queries.AS_OF)
    assert figures(tiers.cold(early.intervals, e.boundary, e.cfg)) != figures(e.cold) == figures(e.cold_after(late))


def test_small_tables_as_state_equal_batch_after_replays(spark, tmp_path):
    made = [r.asDict() for r in made_up.generate(spark, 20, seed=4).collect()]
    (tmp_path / "in").mkdir()

    def put(i, rows):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))

    stream = SeenStream(spark, f"{tmp_path}/seen")
    found = lambda df, *by: sorted(map(tuple, df.select(*by).collect()), key=str)
    sessions = len({r["video_session_id"] for r in made})
    for step in (made[::2], made[1::2], made[:100]):  # two halves of each session, then rows that are sent again, each after a restart
        put(len(os.listdir(tmp_path / "in")), step)
        held = []
        for start in (stream.start_last_seen, stream.start_dim_values):
            query = start(sources.stream_json(spark, f"{tmp_path}/in", 1), f"{tmp_path}/{start.__name__}", every=None)
            query.awaitTermination(300)
            held.append(max(state_rows(query)))
    assert held == [sessions, stream.dim_values().count()]  # state is as large as the tables
    batch = Engine(sources.read_json(spark, f"{tmp_path}/in"), spark.createDataFrame(CONTENT, sources.CONTENT_SCHEMA), EngineConfig()).events
    spans = batch.groupBy("video_session_id").agg(F.min("event_timestamp").alias("first_ts"), F.max("event_timestamp").alias("last_ts"))
    by = ("video_session_id", "first_ts", "last_ts")
    assert found(stream.last_seen(), *by) == found(spans, *by)
    assert found(stream.dim_values(), "dim", "value") == found(cells.dim_values(batch), "dim", "value")
