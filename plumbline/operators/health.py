"""Deletion fragmentation and partition-size skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.order_stats import Histogram
from plumbline.operators.verdict import evaluate


def dfi_total(corpus: DataFrame) -> DataFrame:
    """One row ``(live, dead, dfi)`` of ``corpus(deleted)``; dfi is null for an empty index. A null flag counts as live."""
    dead = F.coalesce(F.col("deleted"), F.lit(False)).cast("bigint")
    a = corpus.agg(F.coalesce(F.sum(1 - dead), F.lit(0)).alias("live"), F.coalesce(F.sum(dead), F.lit(0)).alias("dead"))
    return a.select("live", "dead", (F.col("dead") / F.nullif(F.col("live") + F.col("dead"), F.lit(0))).alias("dfi"))


def dfi_by_fragment(corpus: DataFrame, fragment: str) -> DataFrame:
    """``(fragment, live, dead, dfi)`` per fragment and, under the fragment 'ALL', of the whole: one rollup."""
    dead = F.coalesce(F.col("deleted"), F.lit(False)).cast("bigint")
    a = corpus.withColumn("_f", F.col(fragment).cast("string")).rollup("_f").agg(F.grouping("_f").alias("_g"), F.sum(1 - dead).alias("live"), F.sum(dead).alias("dead"))
    return a.select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col("_f")).alias("fragment"), "live", "dead", (F.col("dead") / (F.col("live") + F.col("dead"))).alias("dfi"))


def dfi_metric(counts: DataFrame, warn: float = 0.15, fail: float = 0.30, exact: bool = True, proxy: bool = False, capable: bool = True, entrypoint_tombstoned: bool = False) -> DataFrame:
    """One row ``(metric, value, evidence, state, reason)`` of :func:`dfi_total`; a dead entry point is a FAIL."""
    reason = F.when(F.lit(not capable), "deleted_counts_unavailable").when(F.col("dfi").isNull(), "empty_index")
    value = F.when(reason.isNull(), F.col("dfi"))
    state = evaluate(value, F.lit(warn), F.lit(fail), F.lit("higher_is_worse"))
    state = F.when(reason.isNotNull(), "UNAVAILABLE").when(F.lit(entrypoint_tombstoned), "FAIL").otherwise(state)
    return counts.select(F.lit("dfi").alias("metric"), value.alias("value"), F.lit("high" if exact and not proxy else "low").alias("evidence"), state.alias("state"), reason.alias("reason"))


def cell_sizes(corpus: DataFrame, n_cells: int | None = None) -> DataFrame:
    """``(cell, size)`` of live rows; with ``n_cells``, empty cells 0..n-1 are listed too."""
    sizes = corpus.filter(~F.coalesce(F.col("deleted"), F.lit(False))).groupBy(F.col("cell").cast("bigint").alias("cell")).agg(F.count(F.lit(1)).alias("size"))
    if n_cells is None:
        return sizes
    every = corpus.sparkSession.range(n_cells).select(F.col("id").alias("cell"))
    return every.join(sizes, "cell", "left").select("cell", F.coalesce("size", F.lit(0)).alias("size"))


SIZES = "n_cells bigint, total bigint, cv double, gini double, max_over_mean double, p99_over_mean double, empty_fraction double"


def partition_statistics(sizes: DataFrame) -> DataFrame:
    """One row of size statistics: population cv (null if all are empty), Gini, maximum and p99 over the mean, empty share.

    All of it follows from one histogram of the sizes.
    """
    h = Histogram(sizes, "size")
    mean = h.mean or None
    row = (h.n, int(h.total), h.moment(2) ** 0.5 / mean if mean else None, h.gini(), float(h.v[-1]) / mean if mean else None, h.quantile(0.99) / mean if mean else None, float(h.c[h.v == 0].sum() / h.n) if h.n else None)
    return sizes.sparkSession.createDataFrame([row], SIZES)


def partition_metric(stats: DataFrame, warn: float = 1.20, fail: float = 2.00, index_kind: str = "IVF") -> DataFrame:
    """One row ``(metric, value, evidence, state, reason)``: unavailable for other kinds of index, one cell or no rows."""
    reason = F.when(F.lit(index_kind not in ("IVF", "IVF_PQ")), "not_applicable").when(F.col("n_cells") <= 1, "single_partition").when(F.coalesce("total", F.lit(0)) == 0, "empty_index")
    value = F.when(reason.isNull(), F.col("cv"))
    state = F.coalesce(evaluate(value, F.lit(warn), F.lit(fail), F.lit("higher_is_worse")), F.lit("UNAVAILABLE"))
    return stats.select(F.lit("partition_size_cv").alias("metric"), value.alias("value"), F.when(F.col("n_cells") < 8, "low").otherwise("high").alias("evidence"), state.alias("state"), reason.alias("reason"))


def largest_cells(sizes: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest cells by (-size, cell): a top list."""
    return sizes.orderBy(F.desc("size"), "cell").limit(n)
