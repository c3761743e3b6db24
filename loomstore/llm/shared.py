"""What the operators share: the shared folder, cutting lineage, sizing."""

from __future__ import annotations

import ctypes
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see, by spark.checkpoint.dir. Where that is unset, a folder in the warehouse on one machine; on several, an error."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def settle(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


_made: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    _made.append(path)
    return path


def written(spark: SparkSession, step, what: str) -> DataFrame:
    """stored(step(), what), after which all that was written on the way there is deleted: no other result may still need it."""
    mark = len(_made)
    out = stored(step(), what)
    for path in _made[mark:-1]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del _made[mark:-1]
    return out


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: like settle, in fewer bytes."""
    small_batches(df.sparkSession)
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts go to Python workers in batches of ARROW_ROWS, where the session does not set another number than Spark's own: a batch is held several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, ARROW_ROWS)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Free memory that the allocators of this process hold goes to the system: workers that wait for their next task, and the JVM, share an executor's limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


_held: dict = {}


def held(clear, name: str) -> None:
    """A module keeps something in the worker process under that name; clear() drops it."""
    _held[name] = clear


def drop_held(keep: tuple[str, ...] = ()) -> None:
    for name, clear in _held.items():
        if name not in keep:
            clear()


def tidy(f, keep: tuple[str, ...] = ()):
    """f for mapInArrow, with memory given back at the end of each task; what other tasks kept in the worker is dropped but for `keep`."""

    def run(batches):
        drop_held(keep)
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def tidy_group(f):
    """f for applyInPandas, with memory given back after each group. Without annotations, which Spark would try to read as its own kinds of functions."""

    def run(rows):
        drop_held()
        try:
            return f(rows)
        finally:
            give_back()

    return run
