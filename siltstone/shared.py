"""Where intermediate tables go, and how lineage is cut.

Everything that is written between jobs goes to the folder that the cluster
names in ``spark.checkpoint.dir``; a folder of our own is used only where that
setting is missing and Spark runs in one local process (tests, notebooks).
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN = "siltstone"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can read and write."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "siltstone-checkpoints")


class Stored(list):
    """The paths of tables that were stored while it was the innermost open one."""


_open: list[Stored] = []


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage
    that survives lost executors and, unlike a cache, costs no executor memory."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_OWN}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["stored_at"] = path
    if _open:
        _open[-1].append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing will read again; others are left alone."""
    for df in tables:
        path = None if df is None else df.__dict__.get("stored_at")
        if path is not None:
            _delete(df.sparkSession, path)


@contextmanager
def small_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> Iterator[None]:
    """Arrow batches of at most so many bytes for what is run inside, so that workers
    hold few whole texts at a time; a single longer text is a batch of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most_bytes)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished jobs. It does so once the
    driver's collector finds their plans gone, which may not happen for hours."""
    for _ in range(2):  # plans that go may hold others
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)  # files are deleted beside the jobs


class stage_tables:
    """Deletes what was stored inside an earlier use of the same object when it is
    entered again, but for tables that ``docs`` still reads. For pipelines whose
    stages return plans that are written before the next stage begins."""

    def __init__(self) -> None:
        self.paths = Stored()

    def begin(self, docs: DataFrame) -> stage_tables:
        read = docs.inputFiles() if self.paths else []
        keep = Stored(p for p in self.paths if any(p.rsplit("/", 1)[-1] in f for f in read))
        for p in self.paths:
            if p not in keep:
                _delete(docs.sparkSession, p)
        self.paths = keep
        return self

    def __enter__(self) -> stage_tables:
        _open.append(self.paths)
        return self

    def __exit__(self, *_: object) -> None:
        _open.remove(self.paths)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint, which keeps its partitions and their order."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list, into: str = "place") -> DataFrame:
    """Rows with their place in an order, from one up: ranges are sorted each by itself,
    and one count for each of them tells where it begins; no task sees all rows."""
    spark = df.sparkSession
    keyed = store(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id()), "numbered")
    counts = [tuple(r) for r in keyed.groupBy("__part").agg(F.count("*"), F.min("__in")).orderBy("__part").collect()]  # a row for each range
    begins, total = [], 0
    for part, n, first in counts:
        begins.append((part, total - first))
        total += n
    starts = spark.createDataFrame(begins, "__part int, __begin long")
    return keyed.join(F.broadcast(starts), "__part").withColumn(into, F.col("__in") + F.col("__begin") + 1).drop("__part", "__in", "__begin")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table in fewer files than there are cores is dealt out to all of them, by a
    key; one in more files is left as it lies. For plans that work hard on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores, key)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
