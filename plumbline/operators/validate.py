"""Checks of a corpus before an audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.vectors import all_finite, is_zero, norm
from plumbline.session import broadcast_if_small, materialise

#: Offending ids that an error names, at most.
MAX_OFFENDERS = 20


class UsageError(ValueError):
    """The input cannot be audited; ``ids`` are the first offenders."""

    def __init__(self, message: str, ids: list[int] | None = None):
        super().__init__(message)
        self.ids = ids or []


def validation_counts(corpus: DataFrame, dim: int, metric: str) -> DataFrame:
    """One row ``(n_live, n_wrong_dim, n_not_finite, n_degenerate)`` of ``corpus(id, vec)``.

    Null vectors count as of wrong dimension; zero vectors are degenerate under COSINE only.
    """
    fits = F.coalesce(F.size("vec") == dim, F.lit(False))
    finite = F.coalesce(all_finite("vec"), F.lit(True))
    zero = fits & finite & is_zero("vec") if metric == "COSINE" else F.lit(False)
    return corpus.agg(
        F.count(F.lit(1)).alias("n_live"),
        F.coalesce(F.sum((~fits).cast("bigint")), F.lit(0)).alias("n_wrong_dim"),
        F.coalesce(F.sum((~finite).cast("bigint")), F.lit(0)).alias("n_not_finite"),
        F.coalesce(F.sum(zero.cast("bigint")), F.lit(0)).alias("n_degenerate"),
    )


def check(corpus: DataFrame, dim: int, metric: str) -> int:
    """Raise UsageError on a corpus that cannot be audited; returns the number of degenerate vectors."""
    r = validation_counts(corpus, dim, metric).first()
    if r["n_live"] < 2:
        raise UsageError("an audit needs at least two live vectors")
    if r["n_wrong_dim"]:
        raise UsageError(f"{r['n_wrong_dim']} vectors do not have {dim} dimensions")
    if r["n_not_finite"]:
        ids = [x[0] for x in corpus.filter(~all_finite("vec")).select("id").orderBy("id").limit(MAX_OFFENDERS).collect()]
        raise UsageError(f"{r['n_not_finite']} vectors hold numbers that are not finite", ids)
    return r["n_degenerate"]


def check_unit(corpus: DataFrame, tolerance: float = 1e-4) -> None:
    """Raise UsageError if a vector that was scaled to norm 1 is off by more than ``tolerance``."""
    off = F.abs(norm("vec") - 1)
    bad = corpus.filter(~(off <= tolerance)).select("id").limit(MAX_OFFENDERS).collect()
    if bad:
        raise UsageError("vectors do not have norm 1 after normalising", [r["id"] for r in bad])


def payload_equals(field: str, value: str):
    """Loose equality of a payload field: as text, or as whole numbers. ``field`` is one column name, whatever it holds."""
    column = F.col("`" + field.replace("`", "``") + "`")
    as_text = column.cast("string") == F.lit(value)
    as_number = column.try_cast("bigint") == F.lit(value).try_cast("bigint")
    return F.coalesce(as_text, F.lit(False)) | F.coalesce(as_number, F.lit(False))


def encode_ids(keys: DataFrame, key: str = "key") -> DataFrame:
    """``(key, id)``: dense ids from 0 for string or mixed keys, in key order and by (type, key) so that they cannot collide.

    Ranks come from per-range counts, so no task sorts all keys.
    """
    distinct = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    ranged = distinct.repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    ranged = materialise(ranged, "ids")
    sizes = ranged.groupBy("_p").count().orderBy("_p").collect()  # one row per partition
    offsets, at = [], 0
    for r in sizes:
        offsets.append((r["_p"], at))
        at += r["count"]
    table = keys.sparkSession.createDataFrame(offsets, "_p int, _o bigint")
    return ranged.join(F.broadcast(table), "_p").select(key, (F.col("_o") + F.col("_i")).alias("id"))


def decode_ids(rows: DataFrame, encoded: DataFrame, id_col: str = "id", key: str = "key") -> DataFrame:
    """``rows`` with the original ``key`` of each id by the table of :func:`encode_ids`; an unknown or null id has a null key."""
    table = encoded.select(F.col("id").alias("_id"), F.col(key))
    return rows.join(broadcast_if_small(table), F.col(id_col) == F.col("_id"), "left").drop("_id")
