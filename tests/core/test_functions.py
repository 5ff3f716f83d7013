import json

from pyspark.sql import functions as F

import made_up
from glimmer.config import EngineConfig
from glimmer.functions import scalar
from glimmer.operators import cells, sessions, tiers
from glimmer.sources import events as sources
from glimmer.streaming.live import LiveEngine


def test_normalizers_and_their_sql(spark):
    scalar.register_sql_functions(spark, EngineConfig())
    df = spark.createDataFrame([("HIN",), ("hin-hindi",), ("",), ("  ",), ("und-x",), (" UND ",), ("unknown",), (None,)], "x string")
    got = df.select("x", scalar.norm_lang(F.col("x")), F.expr("norm_lang(x)"), scalar.norm_dim(F.col("x")), F.expr("norm_dim(x)")).collect()
    assert {r[0]: r[1] for r in got} == {"HIN": "hin", "hin-hindi": "hin", "": "unk", "  ": "", "und-x": "und", " UND ": "unk", "unknown": "unk", None: None}
    assert all(r[1] == r[2] and r[3] == r[4] for r in got)
    assert spark.sql("SELECT cfg_gap_timeout_seconds()").first()[0] == 90


def test_lenient_parsing(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-02",), ("",), ("12",), ("x",)], "x string")
    assert [bool(r[0]) for r in df.select(scalar.parse_time(F.col("x"))).collect()] == [True, True, False, False, False]
    assert [r[0] for r in df.select(scalar.long_or_zero(F.col("x"))).collect()] == [0, 0, 0, 12, 0]
    assert [r[0] for r in spark.createDataFrame([(12,), (2048,), (3 * 1024**3,)], "n long").select(scalar.readable_size(F.col("n"))).collect()] == ["12.00 B", "2.00 KiB", "3.00 GiB"]


def test_one_shuffle_from_events_to_islands(spark):
    made = made_up.generate(spark, 20)
    merged = sessions.islands(sessions.active_segments(sessions.project_landing(made), EngineConfig()))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_clipped_expansion(spark):
    cfg = EngineConfig()
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:30' AS active_start, timestamp'2024-01-01 05:00:00' AS active_end")
    clipped = cells.expand(rows, cfg, F.lit("2024-01-01 01:00:00").cast("timestamp"), F.lit("2024-01-01 01:10:00").cast("timestamp"))
    assert [r["minute"].minute for r in clipped.orderBy("minute").collect()] == list(range(10))
    assert cells.expand(rows, cfg).count() == 300


def test_files_round_trip(spark, tmp_path):
    made = made_up.generate(spark, 5).orderBy("video_session_id", "event_timestamp")
    made.write.option("header", True).csv(f"{tmp_path}/csv")
    made.write.json(f"{tmp_path}/json")
    want = sorted(made.collect())
    key = lambda df: sorted(r for r in df.fillna("").collect())
    assert key(sources.read_csv(spark, f"{tmp_path}/csv")) == want and key(sources.read_json(spark, f"{tmp_path}/json")) == want
    events = sessions.project_landing(made)
    sources.write_events(events, f"{tmp_path}/events")
    assert spark.read.parquet(f"{tmp_path}/events").drop("yyyymm").count() == events.count()


def test_stream_equals_batch(spark, tmp_path):
    from glimmer.plans.engine import Engine

    cfg = EngineConfig(hot_window_seconds=3600)
    made = [r.asDict() for r in made_up.generate(spark, 40, seed=3).orderBy("event_timestamp").collect()]
    (tmp_path / "in").mkdir()
    for i in range(4):
        part = made[i * len(made) // 4 : (i + 1) * len(made) // 4]
        part = part[::-1] + part[:5]  # out of order, with repeats
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
    content = spark.createDataFrame([(i, f"T{i}", "vod", "film") for i in range(70, 73)], sources.CONTENT_SCHEMA)
    live = LiveEngine(spark, f"{tmp_path}/live", content, cfg)
    query = live.start(sources.stream_json(spark, f"{tmp_path}/in", 1), f"{tmp_path}/checkpoint", every=None)
    query.awaitTermination(300)
    batch = Engine(sources.read_json(spark, f"{tmp_path}/in"), content, cfg, as_of="2024-01-02 00:00:00")
    keys = lambda df: sorted(map(tuple, df.select("minute", "platform", "content_id", "country", "video_type", "concurrent", "concurrent_users").collect()))
    assert live.metrics().count() == 4
    assert keys(live.now()) == keys(batch.cells)
    live.process(sources.read_json(spark, f"{tmp_path}/in/3.json"), 3)  # a retry changes nothing
    assert keys(live.now()) == keys(batch.cells)
    assert tiers.overlap(live._read("cold"), live._read("hot").where("batch = 3")).count() == 0
    # State over all batches: readers merge it, and only sessions that can still go on are provisional.
    seen = {r["video_session_id"]: (r["first_ts"], r["last_ts"]) for r in live.last_seen().collect()}
    spans = batch.events.groupBy("video_session_id").agg(F.min("event_timestamp").alias("a"), F.max("event_timestamp").alias("b")).collect()
    assert seen == {r["video_session_id"]: (r["a"], r["b"]) for r in spans}
    assert sorted(map(tuple, live.dim_values().collect())) == sorted(map(tuple, cells.dim_values(batch.events).collect()))
    last = batch.events.agg(F.max("event_timestamp")).first()[0]
    again = Engine(sources.read_json(spark, f"{tmp_path}/in"), content, cfg, as_of=last)
    ids = lambda df: {r[0] for r in df.where("is_provisional").select("video_session_id").distinct().collect()}
    assert ids(live.intervals()) == ids(again.intervals)
    day = str(last)[:10]
    assert live.drop_expired("2020-01-01") == 0 and live.drop_expired("2030-01-01") > 0 and not [p for p in (tmp_path / "live" / "events").rglob("day=*") if day in p.name]


def test_compaction_changes_no_figure_and_bounds_the_folders(spark, tmp_path):
    made = made_up.generate(spark, 12, seed=5).cache()
    content = spark.createDataFrame([], sources.CONTENT_SCHEMA)
    live = LiveEngine(spark, f"{tmp_path}/live", content, EngineConfig(hot_window_seconds=1800, intervals_ttl_days=1))
    part = lambda i: made.where(F.pmod(F.xxhash64("video_session_id"), F.lit(5)) == i)
    found = lambda *a: [sorted(map(str, df.collect())) for df in (live.now(), live.last_seen(), live.dim_values(), live.intervals(*a))]
    parts = lambda table: {p.name for p in (tmp_path / "live" / table).glob("batch=*")}
    assert live.compact() == 0  # nothing there
    for i in range(2):
        live.process(part(i), i)
    want = found()
    assert live.compact("2000-01-01") == 0 and found() == want and "batch=-1" in parts("cold")
    assert live.compact("2000-01-01") == 0 and found() == want  # no new batch since
    (tmp_path / "live" / "cold" / "batch=-9").mkdir()  # an attempt that was cut off isn't read
    live.process(part(1), 1)  # the newest batch is tried again
    assert found() == want
    for i in range(2, 4):
        live.process(part(i), i)
    want = found()
    assert live.compact("2000-01-01") > 0 and found() == want
    assert {"batch=-1", "batch=1", "batch=2", "batch=3", "batch=-3"} == parts("intervals") and "batch=0" not in parts("hot") | parts("marks")
    live.process(part(4), 4)
    live.compact("2100-01-01")
    kept = {r["batch"] for r in live._read("intervals").where("NOT is_provisional").select("batch").distinct().collect()}
    assert kept <= {4}  # older sessions are beyond retention
    assert max(len(parts(t)) for t in ("cold", "hot", "intervals", "last_seen", "dim_values", "marks")) <= 5
    made.unpersist()


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    landing = made_up.generate(spark, 3)
    content = spark.createDataFrame([], sources.CONTENT_SCHEMA)
    live = LiveEngine(spark, f"{tmp_path}/live", content)
    assert not live.has("marks")
    live.process(landing.limit(0), 0)
    live.process(landing, 1)
    before = sorted(live.now().collect())
    live.process(landing.limit(0), 2)
    assert sorted(live.now().collect()) == before and live.metrics().count() == 1


def test_writers_round_trip_and_kafka_messages(spark, tmp_path):
    """Cells by day, and the parsing that a topic's messages go through."""
    rows = spark.sql("SELECT timestamp'2024-01-02 03:00:00' AS minute, 'IN' AS country, 'web' AS platform, 'vod' AS video_type, 'film' AS category, 1L AS content_id, 2L AS concurrent UNION ALL SELECT timestamp'2024-01-03 03:00:00', 'US', 'tv', 'vod', 'film', 2L, 3L")
    sources.write_cells(rows, f"{tmp_path}/cells")
    assert sorted(p.name for p in (tmp_path / "cells").glob("day=*")) == ["day=2024-01-02", "day=2024-01-03"]
    assert sorted(spark.read.parquet(f"{tmp_path}/cells").select(*rows.columns).collect()) == sorted(rows.collect())
    message = spark.sql("""SELECT CAST('{"content_id": 7, "video_session_id": "s", "event_timestamp": 12}' AS BINARY) AS value UNION ALL SELECT CAST('{' AS BINARY)""")
    got = [(r["content_id"], r["video_session_id"], r["event_timestamp"], r["platform"]) for r in sources.parse_messages(message).collect()]
    assert sorted(got, key=str) == [(7, "s", 12, None), (None, None, None, None)]
