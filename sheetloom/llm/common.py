"""What the operators of this subpackage share: work files, Arrow batches, text buffers."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that Spark puts in one Arrow batch, unless the session says otherwise.
BATCH_BYTES = 8 << 20
_SPARKS_BATCH_BYTES = "67108864b"
_WRITTEN: list[tuple[SparkSession, str]] = []


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset in a local session, as in tests, it is a folder of this machine; on a
    cluster that would be a folder that executors do not share, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = f"file:/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return root.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{work_root(spark)}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps start from files that
    outlive executors, and nothing before them is computed twice."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._work_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing will read again; any other table is
    left alone."""
    for df in tables:
        path = df.__dict__.pop("_work_path", None)
        if path is not None:
            spark = df.sparkSession
            _delete(spark, path)
            _WRITTEN.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean_up() -> None:
    """Delete the work files of this process. DataFrames that read them are then unusable."""
    while _WRITTEN:
        _delete(*_WRITTEN.pop())


def _clean_up_at_exit() -> None:
    for spark, _ in _WRITTEN[:1]:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            clean_up()


atexit.register(_clean_up_at_exit)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: 10,000 long rows at once would not fit a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == _SPARKS_BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@contextmanager
def released() -> Iterator[None]:
    """Give free memory back to the system afterwards: a Python worker lives on with what it kept,
    beside the workers and stages that come after it."""
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty); other columns can have any names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Texts:
    """UTF-8 texts one after another: text k is data[starts[k]:starts[k + 1]]."""

    data: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __iter__(self) -> Iterator[bytes]:
        whole = self.data.tobytes()
        at = self.starts.tolist()
        return (whole[a:b] for a, b in zip(at, at[1:], strict=False))


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The column's bytes without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return Texts(np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return Texts(held[starts[0] : starts[-1]], starts - starts[0])


def ragged(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[starts[k]:starts[k] + lengths[k]] for every k, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
