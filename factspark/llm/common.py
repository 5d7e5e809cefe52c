"""What the operators share: reading, cutting lineage, Arrow batches of bounded size."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.base import shared_dir as shared_dir
from ..sources.base import until_exit

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of text that a Python worker holds in numpy form at once.
BLOCK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = ("spark.sql.shuffleDependency.fileCleanup.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
_cutting: dict[int, tuple[int, dict[str, str | None]]] = {}  # by session: cuts under way, and the options before the first
_lock = threading.Lock()
_collecting: ContextVar[list[str] | None] = ContextVar("_collecting", default=None)


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go once the table behind them is written; the options are put back after the last of several cuts at a time."""
    with _lock:
        n, before = _cutting.get(id(spark), (0, {}))
        if not n:
            before = {k: spark.conf.get(k, None) for k in _CLEANUP}
            for k in _CLEANUP:
                spark.conf.set(k, "true")
        _cutting[id(spark)] = n + 1, before
    try:
        yield
    finally:
        with _lock:
            n, before = _cutting[id(spark)]
            _cutting[id(spark)] = n - 1, before
            if n == 1:
                for k, v in before.items():
                    spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation.

    The driver deletes the table when it ends, if nobody has before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    until_exit(spark, path)
    if (paths := _collecting.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """A list that gets the tables which cut() writes meanwhile, in this thread."""
    paths: list[str] = []
    token = _collecting.set(paths)
    try:
        yield paths
    finally:
        _collecting.reset(token)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables whose readers have finished."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches to Python hold so many rows at most, so that long texts do not pile up in one batch.

    The option is read when a query runs, so it stays; a session that has a
    value of its own keeps it.
    """
    if spark.conf.get(_BATCH) in ("10000", str(rows)):
        spark.conf.set(_BATCH, rows)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off - off[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about limit bytes each; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with f for each batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return df.mapInArrow(run, schema)
