"""Deterministic sampling: the order of a keyed md5, never a random stream, so layouts do not matter."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import broadcast_if_small, hash_unit, materialise

#: Buckets of the histogram that finds the n-th smallest hash.
BUCKETS = 1 << 16
#: The same for each group where there are many.
GROUP_BUCKETS = 1 << 12


class ResourceError(RuntimeError):
    """The memory budget does not allow a meaningful audit."""


def keyed_hash(seed: int, purpose: str, id_col: str = "id") -> Column:
    """Uniform number of an id under a seed and purpose."""
    return hash_unit(F.lit(seed), F.lit(purpose), F.col(id_col))


def first_by(df: DataFrame, n: int, u: Column, id_col: str = "id") -> DataFrame:
    """The ``n`` rows of smallest ``u`` (in [0, 1), ties by id), without sorting the table.

    A histogram of ``u`` finds the bucket of the n-th row; only that bucket is ranked. Rows with a null ``u`` are never
    taken; n of 0 or less gives none, and n above the row count gives all.
    """
    with_u = df.withColumn("_u", u).filter(F.col("_u").isNotNull())
    if n <= 0:
        return df.limit(0)
    bucket = F.floor(F.col("_u") * BUCKETS).cast("int")
    counts = sorted((r["b"], r["count"]) for r in with_u.groupBy(bucket.alias("b")).count().collect())  # at most BUCKETS rows
    seen, edge, need = 0, BUCKETS, 0
    for b, c in counts:
        if seen + c >= n:
            edge, need = b, n - seen
            break
        seen += c
    below = with_u.filter(bucket < edge)
    at_edge = with_u.filter(bucket == edge).orderBy("_u", id_col).limit(need) if need else with_u.limit(0)
    return below.unionByName(at_edge).drop("_u")


def first_by_group(df: DataFrame, quotas: DataFrame, u: Column, group: str, id_col: str = "id") -> DataFrame:
    """The rows of smallest ``u`` of each group, as many as ``quotas(group, quota)`` says, without sorting a group.

    A histogram of ``u`` per group (GROUP_BUCKETS rows each at most) finds the bucket in which a quota ends; only the rows
    of that bucket are ranked. Groups without a quota, or with one of 0 or less, give nothing; a quota above the size of
    its group gives all of it.
    """
    bucket = F.floor(F.col("_u") * GROUP_BUCKETS).cast("int")
    with_u = df.withColumn("_u", u).filter(F.col("_u").isNotNull()).withColumn("_b", bucket)
    wanted = quotas.filter(F.col("quota") > 0)
    hist = with_u.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    ends = hist.withColumn("_end", upto).join(broadcast_if_small(wanted), group).filter((F.col("_end") - F.col("_c") < F.col("quota")) & (F.col("_end") >= F.col("quota")))
    edges = ends.select(group, F.col("_b").alias("_edge"), (F.col("quota") - F.col("_end") + F.col("_c")).alias("_need"))
    edges = materialise(wanted.select(group).join(edges, group, "left"), "edges")  # one row a group
    rows = with_u.join(broadcast_if_small(edges), group)
    whole = rows.filter(F.col("_edge").isNull() | (F.col("_b") < F.col("_edge")))
    part = rows.filter(F.col("_b") == F.col("_edge")).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_u", id_col))).filter(F.col("_r") <= F.col("_need"))
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


def sample_ids(corpus: DataFrame, n: int, seed: int, purpose: str, id_col: str = "id") -> DataFrame:
    """A sample of ``n`` rows without replacement, the same for any layout."""
    return first_by(corpus, n, keyed_hash(seed, purpose, id_col), id_col)


def derive_seed(root: int, purpose: str) -> int:
    """A seed of its own for a purpose."""
    return int.from_bytes(hashlib.sha256(f"{root}:{purpose}".encode()).digest()[:8], "big")


def bootstrap_means(values: DataFrame, value_col: str, resamples: int, seed: int) -> DataFrame:
    """``(b, mean)`` of resamples with replacement of per-query values ``(qid, value)``.

    The values are those of the query set, which is bounded by the audit's configuration; they are numbered by qid.
    """
    indexed = values.withColumn("_i", F.row_number().over(Window.orderBy("qid")) - 1)
    n = values.count()
    if not n:
        return values.sparkSession.createDataFrame([], "b int, mean double")
    spark = values.sparkSession
    draws = spark.range(resamples * n).select((F.col("id") / n).cast("int").alias("b"), (F.col("id") % n).alias("_j"))
    picked = draws.withColumn("_i", F.floor(hash_unit(F.lit(seed), "b", "_j") * n).cast("int"))
    return picked.join(F.broadcast(indexed.select("_i", F.col(value_col).alias("_v"))), "_i").groupBy("b").agg(F.avg("_v").alias("mean"))


def degrade(n: int, dim: int, queries: int, hub_sample: int, max_memory_mb: int | None, guard: int = 1000) -> tuple[int, int, bool]:
    """Queries and hubness sample that a memory budget allows, and whether they were cut.

    Queries stay at 5 or more and the sample at the guard of the hubness metric or more (if it was above).
    """
    need = n * dim * 4 / 2**20
    if not max_memory_mb or need <= max_memory_mb:
        return queries, hub_sample, False
    scale = max_memory_mb / need
    if scale < 1e-4:
        raise ResourceError("the memory budget is too small for this corpus")
    return max(5, int(queries * scale)), max(min(hub_sample, guard), int(hub_sample * scale)), True
