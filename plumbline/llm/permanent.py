"""Samples that stay stable as data grows: permanent random numbers.

Every identifier gets a uniform number when it is first seen, and the number is kept in a table. New batches are
anti-joined with the table, so no identifier is numbered twice. A sample is everything below a threshold, and the
threshold of a request never decreases, so a selected identifier stays selected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.heavy_keys import sized_join
from plumbline.session import hash_unit, settle

#: Buckets of [0, 1) in which ids and thresholds meet.
BUCKETS = 256


class NumberTable:
    """The persisted numbers of one population, in a folder that all executors share.

    Edge cases: rows with a null id or null seed get no number yet (a later batch with a seed may bring it); an id that
    comes with several seeds in its first batch takes the smallest; repeated ids keep their number; an empty batch adds
    nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._numbers, self._thresholds = f"{folder}/numbers", f"{folder}/thresholds"

    def _there(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path) if self._there(path) else self.spark.createDataFrame([], schema)

    def numbers(self) -> DataFrame:
        """``(id, u)``, one row per identifier seen."""
        return self._read(self._numbers, "id bigint, u double")

    def thresholds(self) -> DataFrame:
        """``(request_id, threshold)``: the highest threshold each request has had."""
        return self._read(self._thresholds, "request_id bigint, threshold double").groupBy("request_id").agg(F.max("threshold").alias("threshold"))

    def insert(self, batch: DataFrame) -> None:
        """Number the unseen ids of ``batch(id, seed)``. One append is one Spark job and is committed as a whole."""
        fresh = batch.filter(F.col("id").isNotNull() & F.col("seed").isNotNull()).groupBy("id").agg(F.min("seed").alias("seed"))
        if self._there(self._numbers):
            fresh = fresh.join(self.numbers().select("id"), "id", "left_anti")
        fresh.select(F.col("id").cast("bigint").alias("id"), hash_unit("seed", "id").alias("u")).write.mode("append").parquet(self._numbers)

    def raise_thresholds(self, requests: DataFrame) -> None:
        """Record the wanted thresholds ``(request_id, keep_share)`` that are above the known ones; a null or NaN share asks for nothing."""
        want = requests.filter(F.col("keep_share").isNotNull() & ~F.isnan("keep_share"))
        want = want.groupBy(F.col("request_id").cast("bigint").alias("request_id")).agg(F.max("keep_share").cast("double").alias("threshold"))
        old = self.thresholds().withColumnRenamed("threshold", "_old")
        higher = want.join(old, "request_id", "left").filter(F.col("_old").isNull() | (F.col("threshold") > F.col("_old"))).drop("_old")
        if not higher.isEmpty():
            higher.write.mode("append").parquet(self._thresholds)

    def select(self) -> DataFrame:
        """``(request_id, threshold, id)`` of every id below the threshold of each request.

        [0, 1) is cut into BUCKETS; a threshold lies over its own bucket and all below, so an id meets the requests of its
        bucket by equality, however many requests there are, and is compared with no others.
        """
        last = F.least(F.floor(F.col("threshold") * BUCKETS), F.lit(BUCKETS - 1))
        over = self.thresholds().filter("threshold > 0").select("request_id", "threshold", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("_b"))
        numbers = self.numbers().withColumn("_b", F.floor(F.col("u") * BUCKETS).cast("bigint"))
        return sized_join(numbers, over, ["_b"], "id").filter(F.col("u") < F.col("threshold")).select("request_id", "threshold", "id")


def batch_of(points: DataFrame, batches: int, chunk: str = "chunk_index") -> DataFrame:
    """``points`` with ``_batch``, from 0: their chunks in order, cut into ``batches`` ranges of numbers of equal width.

    A null chunk arrives last. An empty table stays empty.
    """
    top = points.agg(F.max(chunk).alias("top")).first()["top"]
    at = F.floor(F.col(chunk).cast("bigint") * batches / F.lit((top or 0) + 1))
    return points.withColumn("_batch", F.coalesce(at, F.lit(batches - 1)).cast("int"))


def run_seeds(points: DataFrame, runs: DataFrame) -> DataFrame:
    """``(run_id, seed)`` of the runs that have points, evaluated once; runs without a seed are left out."""
    used = points.select("run_id").distinct()
    return settle(runs.filter(F.col("run_id").isNotNull() & F.col("seed").isNotNull()).join(used, "run_id", "left_semi").groupBy("run_id").agg(F.min("seed").alias("seed")), "seeds")


def seeded_points(points: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(id, seed)`` of points under the seed of their run; points of unknown runs or runs without a seed are left out."""
    return sized_join(points.filter(F.col("id").isNotNull()).select("run_id", "id"), seeds, ["run_id"], "id").select("id", "seed")
