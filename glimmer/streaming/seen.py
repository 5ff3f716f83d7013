"""The small tables as streaming state: sessions' first and last times, and attributes' distinct values.

A trigger reads its own events and the state of the keys in them.  Times are
an aggregation in update mode: a trigger gives out the rows that changed, and
the newest row of a session counts.  Values are deduplicated in the state
store: each is given out once.  Rows that are sent again change neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glimmer.operators import cells as C
from glimmer.operators import sessions as S
from glimmer.operators import tiers
from glimmer.streaming.cursor import ROCKSDB


def state_rows(query: StreamingQuery) -> list[int]:
    """The rows that the stateful operators of a query hold after each trigger."""
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]


class SeenStream:
    """Keeps last_seen and dim_values of a stream of landing rows under `root`, a folder that the whole cluster shares.

    A session's state is two times and is kept, as its next event may come at
    any time; the state of values is as large as the tables that drop-downs list.
    Needs the RocksDB state store, which the start methods set for the session.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _start(self, rows: DataFrame, table: str, checkpoint: str, every: str | None) -> StreamingQuery:
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        trigger = {"availableNow": True} if every is None else {"processingTime": every}

        def write(part: DataFrame, batch: int) -> None:
            part.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch}")

        return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def start_last_seen(self, landing: DataFrame, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
        """Runs on a stream of landing rows; with every=None, over what is there, and then ends."""
        rows = S.project_landing(landing).groupBy(S.SESSION).agg(F.min("event_timestamp").alias("first_ts"), F.max("event_timestamp").alias("last_ts"))
        return self._start(rows, "last_seen", checkpoint, every)

    def start_dim_values(self, landing: DataFrame, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
        return self._start(C.dim_values(S.project_landing(landing)), "dim_values", checkpoint, every)

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}/batch=*")

    def last_seen(self) -> DataFrame:
        """One row a session: the times of its first and last event."""
        return tiers.latest(self._read("last_seen"), (S.SESSION,), "batch").drop("batch")

    def dim_values(self) -> DataFrame:
        return self._read("dim_values").drop("batch")
