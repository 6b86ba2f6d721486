"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset, as in tests, a temporary folder (which the context remembers)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ionweave-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its object."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


_ROOTS: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("roots", default=None)


@contextlib.contextmanager
def scratch_dropped(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, all that was written by a :class:`Scratch` made in the meantime: what is returned must not read it."""
    roots: list[str] = []
    token = _ROOTS.set(roots)
    try:
        yield
    finally:
        _ROOTS.reset(token)
        for root in roots:
            fs, at = filesystem(spark, root)
            fs.delete(at, True)


class Scratch:
    """Tables that cut lineage and survive lost executors; drop those that are no longer read."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/ionweave/{tag}-{uuid.uuid4().hex}"
        self._n = 0
        if _ROOTS.get() is not None:
            _ROOTS.get().append(self.root)

    def write(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            fs, at = filesystem(self.spark, path)
            fs.delete(at, True)


def numbered(df: DataFrame, order: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """Adds 0, 1, 2 ... in the given order, without gathering the rows in one task.

    Rows are sorted by range; each partition counts its own, and what comes before it
    is a sum over one row a partition.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = scratch.write(rows)
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    counts = sorted((r["__part"], r["count"]) for r in rows.groupBy("__part").count().collect())  # one row a partition
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "__p long, __before long")
    out = rows.join(F.broadcast(table), rows["__part"] == table["__p"])
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__p", "__before")
