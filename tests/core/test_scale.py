"""Forms for large sessions and long intervals: each against the plain form."""

from pyspark.sql import functions as F

import made_up
from glimmer.config import EngineConfig
from glimmer.operators import blocks, cells, sessions
from glimmer.plans import validation
from glimmer.plans.engine import Engine
from glimmer.sources import events as sources

CFG = EngineConfig()


def events_with_a_hot_session(spark):
    """A third of all events are one session's, over two days; attributes change and are unknown at times."""
    made = made_up.generate(spark, 60, seed=9)
    n = made.count() // 2
    t = F.col("id")
    hot = spark.range(n).select("id").join(made.where("video_session_id = 's1'").orderBy("event_timestamp").limit(1))
    u = F.pmod(F.xxhash64(t), F.lit(100))
    hot = hot.withColumn("video_session_id", F.lit("hot")).withColumn("event_timestamp", F.col("event_timestamp") + t * 37_000 + u * 1000 * F.when(u < 5, 60).otherwise(1))
    hot = hot.withColumn("event_type", F.when(u < 4, "VideoPause").when(u < 12, "VideoPlay").otherwise("VideoHeartbeat")).withColumn("event", F.lit(""))
    hot = hot.withColumn("user_id", F.concat(F.lit("h"), F.floor(t / 50) % 2)).withColumn("platform", F.when(u == 50, None).otherwise(F.element_at(F.array(F.lit("web"), F.lit("car")), (F.floor(t / 30) % 2 + 1).cast("int"))))
    return made.unionByName(hot.select(*made.columns))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_blocks_of_a_hot_session_equal_its_windows(spark):
    events = sessions.project_landing(events_with_a_hot_session(spark))
    want = sessions.islands(sessions.active_segments(events, CFG))
    assert want.where("video_session_id = 'hot'").count() > 20
    for seconds in (86_400, 3600, 45):  # blocks shorter than the gap too
        got = blocks.islands_of_events(events, CFG, block_seconds=seconds)
        assert rows(got.select(*want.columns)) == rows(want), seconds
    stated = blocks.running_state(blocks.collapse(sessions.classify(events), 3600)).where("video_session_id = 'hot'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert stated.select(F.spark_partition_id().alias("p")).distinct().count() > 1  # it is in many tasks
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert stated.groupBy("block").count().agg(F.max("count")).first()[0] < 120
    assert blocks.islands_of_events(events.limit(0), CFG).collect() == []


def test_sweep_equals_expansion_and_moves_two_rows_a_run(spark):
    made = events_with_a_hot_session(spark)
    content = spark.createDataFrame([(70, "A", "vod", "film"), (71, "B", "live", "film")], sources.CONTENT_SCHEMA)
    e = Engine(made, content, CFG, as_of="2024-01-03 00:00:00")
    assert rows(cells.by_sweep(e.intervals, CFG).select(*e.cells.columns)) == rows(e.cells)
    long = spark.sql("SELECT 's' AS video_session_id, 'u' AS user_id, timestamp'2024-01-01 00:00:30' AS active_start, timestamp'2024-01-31 00:00:30' AS active_end UNION ALL SELECT 's', 'v', timestamp'2024-01-01 00:00:10', timestamp'2024-01-01 00:05:00'")
    swept = cells.steps(long, CFG, keys=())
    assert "sequence(" not in swept._jdf.queryExecution().optimizedPlan().toString()
    got = swept.collect()
    assert [(r["minute"].day, r["until"].day, r["until"].minute, r["n"]) for r in got] == [(1, 31, 1, 1)]


def test_bitmaps_merge_to_exact_counts(spark):
    made = events_with_a_hot_session(spark)
    content = spark.createDataFrame([(70, "A", "vod", "film")], sources.CONTENT_SCHEMA)
    e = Engine(made, content, CFG, as_of="2024-01-03 00:00:00")
    bits = cells.bitmap_cells(e.atoms, "user_id", cells.numbered(e.events, "user_id", parts=3))
    for keys in (("minute",), ("platform",), ("country", "video_type"), ()):
        want = e.atoms.groupBy(*keys).agg(F.count_distinct("user_id").alias("users"))
        assert rows(cells.rolled_up(bits, keys, "users")) == rows(want)
    many = spark.range(100_000).select(F.lit("k").alias("k"), F.col("id").cast("string").alias("v"))
    bits = cells.bitmap_cells(many.union(many), "v", cells.numbered(many, "v"), ("k",))
    assert cells.rolled_up(bits, ("k",), "n").first()["n"] == 100_000
    assert bits.count() <= 64  # ids are dense


def test_points_meet_the_intervals_near_them(spark):
    """A session of 20,000 intervals and as many points: the join by session and time bin has few rows more than points."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 600)
    intervals = spark.range(20_000).select(F.lit("s").alias("video_session_id"), at.alias("active_start"), (at + F.expr("INTERVAL 5 MINUTES")).alias("active_end"))
    points = spark.range(20_000).select(F.lit("s").alias("video_session_id"), (at + F.expr("INTERVAL 1 SECOND") * (F.col("id") % 600)).alias("ts"))
    found = validation.points_in_intervals(points, intervals)
    got = found.agg(F.count("*"), F.count_if(F.col("ts") < F.col("active_start")), F.count_if(F.col("ts") >= F.col("active_end"))).first()
    assert tuple(got) == (sum(i % 600 < 300 for i in range(20_000)), 0, 0)
    met = points.withColumn("bin", F.floor(F.unix_seconds("ts") / 3600)).groupBy("bin").count().agg(F.max("count")).first()[0]
    assert met <= 8 and "bin" in found._jdf.queryExecution().executedPlan().toString().split("Join", 1)[1].split("\n")[0]
    long = spark.sql("SELECT 's' AS video_session_id, timestamp'2024-01-01 00:30:00' AS active_start, timestamp'2024-01-03 01:00:00' AS active_end")
    edge = spark.sql("SELECT 's' AS video_session_id, explode(array(timestamp'2024-01-01 00:30:00', timestamp'2024-01-02 12:00:00', timestamp'2024-01-03 01:00:00')) AS ts")
    assert validation.points_in_intervals(edge, long).count() == 2
