"""Deletion fragmentation of a changing index, incrementally from a stream of inserts and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_dfi(changes: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(window_start, inserted, deleted, dfi)`` per event-time window of ``changes(ts, op)``; op is insert or delete.

    Works on batch and streaming frames. In a stream, rows later than the watermark are dropped by Spark and the state is
    one row a window. Other operations count for neither side; dfi is null in a window with neither.
    """
    source = changes.withWatermark("ts", late) if changes.isStreaming else changes
    dead, made = (F.sum((F.col("op") == o).cast("bigint")) for o in ("delete", "insert"))
    a = source.groupBy(F.window("ts", window)).agg(made.alias("inserted"), dead.alias("deleted"))
    return a.select(F.col("window.start").alias("window_start"), "inserted", "deleted", (F.col("deleted") / F.nullif(F.col("inserted") + F.col("deleted"), F.lit(0))).alias("dfi"))
