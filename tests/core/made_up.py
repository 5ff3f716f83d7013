"""Made-up sessions for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate(spark: SparkSession, sessions: int, seed: int = 1, start: str = "2024-01-01 00:00:00", late_share: float = 0.07, marathon_share: float = 0.11) -> DataFrame:
    """Landing rows of made-up sessions, the same for the same seed whatever the partitions; built-ins only.

    A session starts within a day, beats about once a minute with pauses,
    resumes and background spells between, and ends, but for the marathon
    share and abandoned ones.  A share of events is stamped up to 9 seconds early.
    """
    draw = lambda *what: F.pmod(F.xxhash64(F.lit(seed), *[F.lit(w) if isinstance(w, str) else w for w in what]), F.lit(1 << 20)) / float(1 << 20)
    pick = lambda values, u: F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))
    s = F.col("id")
    begin = F.unix_millis(F.lit(start).cast("timestamp")) + F.floor(draw("begin", s) * 86_400_000).cast("long")
    marathon = draw("marathon", s) < marathon_share
    beats = F.when(marathon, 240).otherwise(F.floor(2 + draw("beats", s) * 40)).cast("int")
    rows = spark.range(sessions).select("id", begin.alias("begin"), marathon.alias("marathon"), beats.alias("beats"))
    rows = rows.select("*", F.posexplode(F.sequence(F.lit(0), F.col("beats"))).alias("n", "_"))
    n, u = F.col("n"), draw("step", s, F.col("n"))
    last = (n == F.col("beats")) & ~F.col("marathon") & (draw("abandoned", s) > 0.1)
    kind = F.when(n == 0, "VideoSessionStart").when(n == 1, "VideoPlay").when(last, "VideoSessionEnd")
    kind = kind.when(u < 0.04, "AppBackgrounded").when(u < 0.08, "AppForegrounded").when(u < 0.1, "VideoPause").when(u < 0.11, "VideoError").otherwise("VideoHeartbeat")
    marker = F.when(u > 0.96, "resume").when(u > 0.92, "pause").otherwise("")
    late = F.when(draw("late", s, n) < late_share, F.floor(500 + draw("by", s, n) * 8500)).otherwise(0)
    when = F.col("begin") + n * 60_000 + F.floor(draw("jitter", s, n) * 5000) - late
    return rows.select(
        (F.floor(draw("content", s) * 4) + 70).cast("long").alias("content_id"),
        F.concat(F.lit("s"), s).alias("video_session_id"),
        F.concat(F.lit("u"), F.floor(s / 2)).alias("user_id"),
        kind.alias("event_type"),
        marker.alias("event"),
        when.cast("long").alias("event_timestamp"),
        pick(("web", "console", "car"), draw("platform", s)).alias("platform"),
        pick(("7", "8", " "), draw("app", s)).alias("app_version"),
        pick(("NO", "PE"), draw("country", s)).alias("country"),
        pick(("swa", "SWA-coast", "und"), draw("audio", s, n)).alias("audio_language"),
        pick(("nor", ""), draw("subtitle", s)).alias("subtitle_language"),
        pick(("p", "q"), draw("player", s)).alias("player_version"),
        F.col("begin").alias("session_start_epoch"),
    )
