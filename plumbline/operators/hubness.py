"""Hubness: how unevenly a sample's neighbour lists name its members.

``neighbours(qid, id)`` lists the k nearest of each sample member within the sample; ``sample(id)`` are the members.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.vectors import norm
from plumbline.operators.order_stats import Histogram, quantiles
from plumbline.operators.verdict import evaluate

MIN_SAMPLE = 1000
CALIBRATED = (20_000, 10)
OFFENDERS = 1000


class InvariantError(AssertionError):
    """Counts do not add up."""


def n_k(neighbours: DataFrame, sample: DataFrame) -> DataFrame:
    """``(id, n_k)``: how often each member is named; 0 for members that nobody names."""
    named = neighbours.groupBy("id").agg(F.count(F.lit(1)).alias("n_k"))
    return sample.select("id").join(named, "id", "left").select("id", F.coalesce("n_k", F.lit(0)).alias("n_k"))


def assert_total(counts: DataFrame, k: int) -> DataFrame:
    """One row ``(s, total)``; raises if a full search did not name ``s * k`` neighbours."""
    r = counts.agg(F.count(F.lit(1)).alias("s"), F.coalesce(F.sum("n_k"), F.lit(0)).alias("total"))
    got = r.first()
    if got["total"] != got["s"] * k:
        raise InvariantError(f"{got['total']} neighbours named, {got['s'] * k} expected")
    return r


STATISTICS = "s bigint, hub_share_top1pct double, antihub_fraction double, skewness double, max_nk bigint, p99_nk double, median_nk double, mad_outliers bigint"


def statistics(counts: DataFrame) -> DataFrame:
    """One row of the N_k distribution: share of the top percent, anti-hub fraction, skewness, maximum, quantiles, outliers.

    All of it follows from one histogram of N_k, which has few distinct values. Skewness is null if all N_k are equal;
    shares are 0 for an empty sample. Outliers lie above the median by more than 5 median deviations, if that is not 0.
    """
    h = Histogram(counts, "n_k")
    if not h.n:
        return counts.sparkSession.createDataFrame([(0, 0.0, 0.0, None, None, None, None, 0)], STATISTICS)
    median, spread = h.quantile(0.5), h.moment(2)
    mad = h.quantile(0.5, abs(h.v - median))
    outliers = int(h.c[h.v > median + 5 * mad].sum()) if mad else 0
    skewness = h.moment(3) / spread**1.5 if spread > 0 else None
    row = (h.n, h.share_of_largest(math.ceil(h.n * 0.01)), float(h.c[h.v == 0].sum() / h.n), skewness, int(h.v[-1]), h.quantile(0.99), median, outliers)
    return counts.sparkSession.createDataFrame([row], STATISTICS)


def metrics(stats: DataFrame, k_hub: int, thresholds: dict[str, tuple[float, float]], enforce_min_sample: bool = True) -> DataFrame:
    """Two rows ``(metric, value, evidence, uncalibrated, state, reason)`` from :func:`statistics`.

    Unavailable under 1000 members (unless waived) or with k_hub >= S. Evidence is medium from 10000 members, else low,
    and a FAIL on low evidence stays a FAIL here: the verdict weighs it.
    """
    reason = F.when(F.lit(enforce_min_sample) & (F.col("s") < MIN_SAMPLE), "sample_too_small").when(F.lit(k_hub) >= F.col("s"), "k_hub_too_large")
    rows = stats.select("s", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v"), F.lit(w).alias("warn"), F.lit(f).alias("fail")) for m, (w, f) in thresholds.items()])).alias("r")).select("s", "r.*")
    value = F.when(reason.isNull(), F.col("v"))
    return rows.select(
        "metric", value.alias("value"), F.when(F.col("s") >= 10_000, "medium").otherwise("low").alias("evidence"),
        ((F.col("s") != CALIBRATED[0]) | F.lit(k_hub != CALIBRATED[1])).alias("uncalibrated"),
        F.coalesce(evaluate(value, F.col("warn"), F.col("fail"), F.lit("higher_is_worse")), F.lit("UNAVAILABLE")).alias("state"), reason.alias("reason"),
    )


def offenders(counts: DataFrame, cap: int = OFFENDERS) -> DataFrame:
    """``(kind, id, n_k)``: the hubs by (-N_k, id) and the anti-hubs by id, at most ``cap`` of each (a top list)."""
    top = counts.filter(F.col("n_k") > 0).orderBy(F.desc("n_k"), "id").limit(cap).select(F.lit("hub").alias("kind"), "id", "n_k")
    low = counts.filter(F.col("n_k") == 0).orderBy("id").limit(cap).select(F.lit("antihub").alias("kind"), "id", "n_k")
    return top.unionByName(low)


def histogram(values: DataFrame, col: str, buckets: int = 64) -> DataFrame:
    """``(bucket_start, width, n)``: unit buckets up to ``buckets`` distinct values, else equal widths without empty ones."""
    top = values.agg(F.max(col)).first()[0]
    if top is None:
        return values.sparkSession.createDataFrame([], "bucket_start bigint, width bigint, n bigint")
    width = 1 if top + 1 <= buckets else -(-(int(top) + 1) // buckets)
    counted = values.filter(F.col(col).isNotNull()).groupBy((F.floor(F.col(col) / width) * width).cast("bigint").alias("bucket_start")).agg(F.count(F.lit(1)).alias("n"))
    starts = values.sparkSession.range(int(top) + 1 if width == 1 else 1).select(F.col("id").alias("bucket_start"))
    return starts.join(counted, "bucket_start", "full").select("bucket_start", F.lit(width).cast("bigint").alias("width"), F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_vectors(corpus: DataFrame) -> DataFrame:
    """One row ``(n_duplicates)``: rows beyond the first of each exactly equal vector.

    Vectors are grouped by a 128-bit digest, so the shuffle moves 16 bytes a row, pre-aggregated. -0.0 equals 0.0.
    """
    digest = F.md5(F.to_json(F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0).cast("float")).otherwise(x))))
    groups = corpus.filter(F.col("vec").isNotNull()).groupBy(digest.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def norm_ratio(corpus: DataFrame) -> DataFrame:
    """One row ``(norm_p99_ratio)``: 99th percentile of the norms over their median, 1 if the median is 0 or there is none."""
    p99, median = quantiles(corpus, norm("vec"), [0.99, 0.5])
    return corpus.sparkSession.createDataFrame([(p99 / median if median else 1.0,)], "norm_p99_ratio double")
