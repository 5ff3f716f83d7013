"""The incremental path: micro-batches of landing rows into versioned tables, hot and cold tiers.

Window functions and exact distinct counts don't run on a stream, so each
micro-batch is worked on as a DataFrame.  Every table is a folder with a part
for each batch, and a batch that is tried again replaces just its own parts:
a retry changes nothing, and no path is overwritten while it is read.
State merges on reading: sessions' first and last times by min and max,
attributes' values as a set, intervals by the newest version.  Events are in a
folder for each day, and a batch reads no day before the first event of the
sessions that it touches.

compact() merges the parts of many batches into one folder, named by a negative
batch.  Readers take the newest such folder that is complete (its success
marker is the pointer) and the batches after it; what it replaces is deleted
one compaction later, so that readers who have listed it can finish.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glimmer.config import EngineConfig, Rules
from glimmer.functions.scalar import bucket_floor, plus_seconds
from glimmer.operators import cells as C
from glimmer.operators import sessions as S
from glimmer.operators import tiers


class LiveEngine:
    """Keeps concurrency up to date under `root`, a folder that the whole cluster shares.

    A batch re-derives the sessions it touches from their whole history, and
    closes those that have fallen silent.
    Minutes older than the hot window are moved to the cold tier once.  Events
    that come later than that are written as signed corrections of its cells,
    as far back as intervals are kept (older minutes are final: what was there
    can't be told any more).  With frozen=True they change only the intervals.
    """

    def __init__(self, spark: SparkSession, root: str, content: DataFrame, cfg: EngineConfig = EngineConfig(), rules: Rules = Rules(), frozen: bool = False) -> None:
        self.spark, self.root, self.content, self.cfg, self.rules, self.frozen = spark, root.rstrip("/"), content, cfg, rules, frozen

    def _write(self, table: str, batch: int, rows: DataFrame, by: tuple[str, ...] = ()) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{table}/batch={batch}")

    def _path(self, table: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, table: str) -> bool:
        path, fs = self._path(table)
        return fs.exists(path)

    def _folders(self, table: str) -> tuple[list[int], int | None]:
        """The batches a reader takes, and the newest complete compacted one among them."""
        path, fs = self._path(table)
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        found = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
        whole = [b for b in found if b < 0 and fs.exists(self._path(f"{table}/batch={b}/_SUCCESS")[0])]
        newest = min(whole, default=None)
        until = -1 if newest is None else -newest - 1
        return sorted(b for b in found if b > until or b == newest), newest

    def _read(self, table: str, until: int | None = None) -> DataFrame | None:
        if not self.has(table):
            return None
        folders = [f"{self.root}/{table}/batch={b}" for b in self._folders(table)[0]]
        rows = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*folders)
        return rows if until is None else rows.where(F.col("batch") <= until)

    def events(self) -> DataFrame:
        return self._read("events").drop("batch", "day")

    def last_seen(self, until: int | None = None) -> DataFrame:
        """One row a session: the times of its first and last event over all batches."""
        return self._read("last_seen", until).groupBy(S.SESSION).agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))

    def dim_values(self) -> DataFrame:
        """The distinct values of the attributes over all batches."""
        return self._read("dim_values").select("dim", "value").distinct()

    def intervals(self) -> DataFrame:
        """The newest version of each session's intervals, one row an interval."""
        return C.unpack(tiers.latest(self._read("intervals").drop("batch"), (S.SESSION,)))

    def now(self) -> DataFrame:
        """Cold cells with their corrections, and the newest hot snapshot after them."""
        last = self._read("marks").agg(F.max("batch")).first()[0]
        cold = self._read("cold", last).drop("batch")
        changes = self._read("corrections", last)
        if changes is not None:
            cold = tiers.corrected(cold, changes.drop("batch"))
        return tiers.serve(cold, self._read("hot").where(F.col("batch") == last).drop("batch"))

    def metrics(self) -> DataFrame:
        """How many rows each batch brought, and where its tiers part."""
        return self._read("marks").orderBy(F.desc("batch"))

    def process(self, landing: DataFrame, batch: int) -> None:
        """One micro-batch; the steps follow each other as they depend on each other."""
        self._write("events", batch, S.project_landing(landing).withColumn("day", F.date_format("event_timestamp", "yyyy-MM-dd")), ("day",))
        if not self.spark.read.schema("event_timestamp timestamp").option("recursiveFileLookup", True).parquet(f"{self.root}/events/batch={batch}").take(1):
            return
        fresh = self._read("events").where(F.col("batch") == batch).drop("batch", "day")
        self._write("last_seen", batch, fresh.groupBy(S.SESSION).agg(F.min("event_timestamp").alias("first_ts"), F.max("event_timestamp").alias("last_ts")))
        self._write("dim_values", batch, C.dim_values(fresh))
        latest = self._read("last_seen", batch).agg(F.max("last_ts")).first()[0]
        now = F.lit(latest)
        touched = self._read("last_seen").where(F.col("batch") == batch).select(S.SESSION)
        # The days since the first event of a touched session are all that its history can be in.
        since_day = self.last_seen(batch).join(touched, S.SESSION, "left_semi").agg(F.date_format(F.min("first_ts"), "yyyy-MM-dd")).first()[0]
        history = self._read("events", batch).where(F.col("day") >= since_day).drop("batch", "day").join(touched, S.SESSION, "left_semi")
        merged = S.islands(S.active_segments(history, self.cfg, self.rules))
        rows = S.session_intervals(merged, self.content, self.cfg, as_of=latest).withColumn("version", F.lit(batch).cast("long"))
        before = self._read("intervals", batch - 1)
        if before is not None:
            # Sessions without an event in this batch that can't go on any more: only their state changes.
            open_rows = tiers.latest(before.drop("batch"), (S.SESSION,)).where("is_provisional").join(touched, S.SESSION, "left_anti")
            last_end = F.array_max(F.transform("intervals", lambda iv: iv["active_end"]))
            silent = open_rows.where(last_end < plus_seconds(now, -self.cfg.gap_seconds))
            # Sessions of which a late event has left nothing: an empty version, so that the one before isn't the newest.
            emptied = tiers.latest(before.drop("batch").join(touched, S.SESSION, "left_semi"), (S.SESSION,)).join(merged.select(S.SESSION), S.SESSION, "left_anti")
            emptied = emptied.withColumn("intervals", F.filter("intervals", lambda _: F.lit(False)))
            for closed in (silent, emptied):
                rows = rows.unionByName(closed.withColumn("is_provisional", F.lit(False)).withColumn("version", F.lit(batch).cast("long")))
        self._write("intervals", batch, rows)
        intervals = C.unpack(tiers.latest(self._read("intervals", batch).drop("batch"), (S.SESSION,)))
        # The tiers part a hot window before the last event; cold takes what lies between the last parting and this one.
        until = plus_seconds(bucket_floor(now, self.cfg.bucket_seconds), -self.cfg.hot_window_seconds)
        marks = self._read("marks")
        parted = marks.where(F.col("batch") < batch).agg(F.max("until")).first()[0] if marks is not None else None
        since = F.timestamp_seconds(F.lit(0)) if parted is None else F.lit(parted)
        if parted is not None and before is not None and not self.frozen:
            self._correct(batch, C.unpack(tiers.latest(before.drop("batch"), (S.SESSION,))), touched, now, since)
        self._write("cold", batch, C.count_cells(C.expand(intervals, self.cfg, since, until)))
        self._write("hot", batch, C.count_cells(C.expand(intervals, self.cfg, F.greatest(since, until))))
        mark = self.spark.range(1).select(F.greatest(since, until).alias("until"))
        self._write("marks", batch, mark.join(F.broadcast(fresh.agg(F.count("*").alias("rows")))))

    def _correct(self, batch: int, before: DataFrame, touched: DataFrame, now, until) -> None:
        """Writes what a batch changes in cold minutes, if anything; most batches have no such event and expand nothing."""
        # Compaction has dropped no interval that reaches into a bucket after this.
        since = plus_seconds(bucket_floor(now, self.cfg.bucket_seconds), self.cfg.bucket_seconds - 86_400 * self.cfg.intervals_ttl_days)
        again = C.unpack(self._read("intervals").where(F.col("batch") == batch).drop("batch"))
        if not tiers.changed(before, again, touched, since, until).isEmpty():
            self._write("corrections", batch, tiers.corrections(before, again, touched, self.cfg, since, until))

    def start(self, landing: DataFrame, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
        """Runs on a stream of landing rows; with every=None, over what is there, and then ends."""
        trigger = {"availableNow": True} if every is None else {"processingTime": every}
        return landing.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def retain(self, as_of) -> DataFrame:
        """Events within their retention."""
        return tiers.retained(self.events(), "event_timestamp", self.cfg.events_ttl_days, as_of)

    def drop_expired(self, as_of: str) -> int:
        """Deletes the folders of days that are wholly beyond the events' retention at as_of; returns how many."""
        cut = self.spark.range(1).select(F.date_format(F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(self.cfg.events_ttl_days)), "yyyy-MM-dd")).first()[0]
        path, fs = self._path("events/batch=*/day=*")
        old = [f.getPath() for f in fs.globStatus(path) or [] if f.getPath().getName().removeprefix("day=") < cut]
        for folder in old:
            fs.delete(folder, True)
        return len(old)

    def compact(self, as_of: str | None = None) -> int:
        """Merges all batches before the newest; returns how many folders are deleted.

        Sessions' times and attributes' values are merged, the newest version of
        intervals is kept, cold cells are put together and corrections added up.  Sessions whose intervals
        all ended before the intervals' retention at as_of (default: the last
        event) are dropped.  Deleted are batches, hot snapshots and marks that the
        compaction before this one has replaced.  The newest batch isn't
        touched: it may be tried again.  Not to run while a batch is worked on.
        """
        marks = self._read("marks")
        until = -1 if marks is None else marks.agg(F.max("batch")).first()[0] - 1
        before = self._folders("intervals")[1] if self.has("intervals") else None
        if until < 0 or before is not None and -before - 1 >= until:
            return 0
        if as_of is None:
            as_of = self.last_seen().agg(F.max("last_ts")).first()[0]

        def kept(rows: DataFrame) -> DataFrame:
            last = F.array_max(F.transform("intervals", lambda iv: iv["active_end"]))
            newest = tiers.latest(rows, (S.SESSION,)).withColumn("_end", last)
            cut = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(self.cfg.intervals_ttl_days))
            return newest.where(F.col("is_provisional") | (F.col("_end") >= cut)).drop("_end")

        merges = {
            "last_seen": lambda rows: rows.groupBy(S.SESSION).agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")),
            "dim_values": lambda rows: rows.select("dim", "value").distinct(),
            "intervals": kept,
            "cold": lambda rows: rows,
            "corrections": lambda rows: rows.groupBy(*tiers.CELL_KEY).agg(*[F.sum(c).alias(c) for c in ("concurrent", "concurrent_users")]).where("concurrent <> 0 OR concurrent_users <> 0"),
        }
        merges = {table: merge for table, merge in merges.items() if self.has(table)}
        for table, merge in merges.items():
            rows = self._read(table, until)
            if self._folders(table)[1] != -until - 1:
                self._write(table, -until - 1, merge(rows.drop("batch")))
        return 0 if before is None else sum(self._delete_replaced(table, before) for table in (*merges, "hot", "marks"))

    def _delete_replaced(self, table: str, compacted: int) -> int:
        """Deletes the batches that a compacted folder replaced, and older compacted folders."""
        path, fs = self._path(table)
        names = [(f.getPath(), f.getPath().getName()) for f in fs.listStatus(path)]
        old = [p for p, n in names if n.startswith("batch=") and compacted < int(n.removeprefix("batch=")) < -compacted]
        for folder in old:
            fs.delete(folder, True)
        return len(old)
