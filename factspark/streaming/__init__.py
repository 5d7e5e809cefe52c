"""Transactions as a stream: listeners write a log that Structured Streaming reads."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conn import Conn
from ..tx import TxReport
from ..values import ANY, tagged

LOG = f"e long, a string, v {ANY}, tx long, added boolean, committed_at timestamp"


def log_to(conn: Conn, spark: SparkSession, path: str) -> Any:
    """Appends every transaction of conn to a log; the key with which to unlisten."""

    def write(report: TxReport) -> None:
        now = dt.datetime.now()
        rows = [(d.e, d.a, tagged(d.v), d.tx, d.added, now) for d in report.tx_data]
        if rows:
            spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)

    return conn.listen(write)


def changes(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream of changes."""
    return spark.readStream.schema(LOG).parquet(path)


def per_window(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Changes of each attribute by time window; those later than the watermark are left out."""
    return stream.withWatermark("committed_at", late).groupBy(F.window("committed_at", width), "a").agg(F.count("*").alias("changes"), F.sum(F.col("added").cast("int")).alias("added"))


def each_batch(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> Any:
    """Runs f for each micro-batch of what the log has so far, and stops."""
    query = stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
