"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Where the tables are noted that a block of own_tables_dropped() is to drop.
_noted: ContextVar[list | None] = ContextVar("noted", default=None)
#: Bytes of an Arrow batch that a task sends to Python: rows of very long texts or sets come a few at a time.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's limit of an Arrow batch, which every Python step of this package relies on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster names it; on one machine (a local master) else a folder made here once."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = _own.get(spark.sparkContext.applicationId)
        if not named:
            named = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return named.rstrip("/")


@contextlib.contextmanager
def own_shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of the writes in this block as each ends: what they made is in the table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Saved:
    """Tables written once and read again, which cuts lineage: a lost executor costs a re-read, no recomputation."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.noted = spark, _noted.get()
        bounded_batches(spark)

    def _note(self, df: DataFrame) -> DataFrame:
        if self.noted is not None:
            self.noted.append(df)
        return df

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        with own_shuffles_deleted(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.saved_at = path
        return self._note(out)

    def bucketed(self, df: DataFrame, column: str, buckets: int) -> DataFrame:
        """A table whose groups by `column` need no further shuffle."""
        name, path = f"saved_{uuid.uuid4().hex}", f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        with own_shuffles_deleted(self.spark):
            df.repartition(buckets, column).write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(name)
        out = self.spark.table(name)
        out.saved_at, out.saved_as = path, name
        return self._note(out)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in tables:
            if getattr(df, "saved_as", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {df.saved_as}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def own_tables_dropped(spark: SparkSession) -> Iterator[None]:
    """At the end of this block, the tables are dropped that Saved objects made in it have written.

    What a stage returns reads them, so its result has to be written in the
    block, through a Saved that was made before it.
    """
    noted: list[DataFrame] = []
    token = _noted.set(noted)
    try:
        yield
    finally:
        _noted.reset(token)
        Saved(spark).drop(*noted)


class Shared:
    """A broadcast value whose classes the executors need not have installed: they travel with it."""

    def __init__(self, spark: SparkSession, value) -> None:
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        """The value; a task takes it once."""
        return pickle.loads(self.packed.value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
