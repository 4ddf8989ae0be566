"""Inverted-file search: cells, centroids, k-means and probing, with and without tombstones.

Tables: ``corpus(id, vec, cell, deleted)``, ``centroids(cell, centroid)``, ``queries(qid, vec)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.vectors import TIE_DECIMALS, distance, normalise
from plumbline.operators import knn
from plumbline.operators.knn import matrix, score
from plumbline.operators.sampling import sample_ids
from plumbline.session import broadcast_if_small, default_tasks

#: Distances of rows to centroids that are held at once.
SCORES = 8 << 20
#: Numbers of partial sums that a task keeps before it hands them on.
HELD_SUMS = 4 << 20


class CellSums:
    """Sums and counts of rows by cell."""

    def __init__(self):
        self.cells, self.n, self.s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 0))

    def add(self, cells: np.ndarray, n: np.ndarray, rows: np.ndarray) -> None:
        if not len(cells):
            return
        cells, n = np.concatenate([self.cells, cells]), np.concatenate([self.n, n])
        rows = np.concatenate([self.s, rows]) if self.s.size else rows
        order = np.argsort(cells, kind="stable")
        cells, n, rows = cells[order], n[order], rows[order]
        first = np.concatenate([[0], np.nonzero(cells[1:] != cells[:-1])[0] + 1])
        self.cells, self.n, self.s = cells[first], np.add.reduceat(n, first), np.add.reduceat(rows, first, axis=0)

    def batch(self) -> pa.RecordBatch:
        d = self.s.shape[1]
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(self.cells) + 1) * d, pa.int32()), pa.array(self.s.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(self.cells), pa.array(self.n), sums], names=["cell", "n", "s"])


_SUMS = "cell bigint, n bigint, s array<double>"


def _cell_sums(rows: DataFrame, cell_of) -> DataFrame:
    """``(cell, n, s)``: count and sum of the vectors of each cell; ``cell_of(batch)`` gives ``(cells, vectors)``.

    Tasks add up their own rows; what they send is added in two steps, so that a cell that all tasks have is no hot key.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = CellSums()
        for b in batches:
            cells, x = cell_of(b)
            if len(cells):
                sums.add(cells, np.ones(len(cells), np.int64), x.astype(np.float64, copy=False))
            if sums.s.size > HELD_SUMS:
                yield sums.batch()
                sums = CellSums()
        if len(sums.cells):
            yield sums.batch()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = CellSums()
        for b in batches:
            if b.num_rows:
                sums.add(b.column("cell").to_numpy(), b.column("n").to_numpy(), b.column("s").flatten().to_numpy().reshape(b.num_rows, -1))
        if len(sums.cells):
            yield sums.batch()

    tasks = default_tasks(rows.sparkSession)
    halfway = rows.mapInArrow(part, _SUMS).repartition(tasks, F.col("cell"), F.pmod(F.spark_partition_id(), F.lit(64))).mapInArrow(merge, _SUMS)
    return halfway.repartition(tasks, F.col("cell")).mapInArrow(merge, _SUMS)


def partition_centroids(corpus: DataFrame, live_only: bool = True) -> DataFrame:
    """``(cell, centroid)``: mean vector of each cell; cells without usable rows have none, and a null cell is left out."""
    rows = corpus.filter(~F.col("deleted")) if live_only and "deleted" in corpus.columns else corpus
    kind = rows.schema["cell"].dataType

    def cell_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return matrix(b.column("cell"), b.column("vec"))

    sums = _cell_sums(rows.select(F.col("cell").cast("bigint").alias("cell"), "vec"), cell_of)
    return sums.select(F.col("cell").cast(kind).alias("cell"), F.transform("s", lambda x: x / F.col("n")).alias("centroid"))


def _nearest(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Place of the nearest centroid, the lowest of equal ones, over as many rows at once as SCORES allows."""
    step = max(1, SCORES // len(c))
    parts = [np.round(score(x[s : s + step], c, metric), TIE_DECIMALS).argmin(1) for s in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def assign_cells(corpus: DataFrame, centroids: DataFrame, metric: str) -> DataFrame:
    """``corpus`` with the nearest ``cell``, the lowest of equal ones. The centroids (cells x d) travel with the tasks."""
    table = centroids.orderBy("cell").toArrow()
    cells, c = matrix(table.column("cell"), table.column("centroid"))
    held = corpus.sparkSession.sparkContext.broadcast((cells, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, c = held.value
        for b in batches if len(cells) else ():
            ids, x = matrix(b.column("id"), b.column("vec"), dim=c.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cells[_nearest(x, c, metric)])], names=["id", "cell"])

    return corpus.select("id", "vec").mapInArrow(run, "id bigint, cell bigint")


def kmeans(corpus: DataFrame, n_cells: int, metric: str = "L2", rounds: int = 12, seed: int = 1337) -> DataFrame:
    """Lloyd's k-means: ``(cell, centroid)``.

    Starts from a seeded sample. Each round assigns and sums in Arrow batches, so only one row of sums per cell comes to
    the driver. A cell that loses all rows keeps its centroid; COSINE re-normalises.
    """
    spark = corpus.sparkSession
    start = sample_ids(corpus.filter(F.col("vec").isNotNull()), n_cells, seed, "kmeans").orderBy("id").select("id", "vec").toArrow()
    _, c = matrix(start.column("id"), start.column("vec"))
    for _ in range(rounds if len(c) else 0):
        c = kmeans_round(corpus, c, metric)
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(c)], "cell bigint, centroid array<double>")


def kmeans_round(corpus: DataFrame, c: np.ndarray, metric: str) -> np.ndarray:
    """The centroids after one more round."""
    held = corpus.sparkSession.sparkContext.broadcast(c)

    def cell_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        c = held.value
        _, x = matrix(b.column("id"), b.column("vec"), dim=c.shape[1])
        return _nearest(x, c, metric), x

    summed = _cell_sums(corpus.select("id", "vec"), cell_of).toArrow().combine_chunks()  # one row a cell
    new = c.copy()
    if summed.num_rows:
        s = summed.column("s").combine_chunks().flatten().to_numpy().reshape(-1, c.shape[1])
        new[summed.column("cell").to_numpy()] = s / summed.column("n").to_numpy()[:, None]
    if metric == "COSINE":
        length = np.linalg.norm(new, axis=1, keepdims=True)
        new = np.where(length > 0, new / np.maximum(length, 1e-30), c)
    return new


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: str) -> DataFrame:
    """``(qid, vec, cell)``: the ``nprobe`` cells nearest to each query, by (distance, cell): a search over the centroids."""
    cells = centroids.select(F.col("cell").cast("bigint").alias("id"), F.col("centroid").alias("vec"))
    found = knn.exact_knn(cells, queries, nprobe, metric, exclude_self=False).select("qid", F.col("id").cast(centroids.schema["cell"].dataType).alias("cell"))
    return found.join(broadcast_if_small(queries.select("qid", "vec")), "qid")


def _scored(corpus: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, nprobe: int, metric: str) -> DataFrame:
    """``(qid, id, deleted, dist)`` of candidates in the probed cells, the ``k`` nearest of each query among them.

    The rows of a batch are compared with the queries of their cells, cell by cell; more than ``knn.SHIPPED_QUERIES``
    probes are joined with the cells' rows instead.
    """
    probed = probes(queries, centroids, nprobe, metric)
    rows = corpus.filter(F.col("vec").isNotNull()).select("id", "vec", F.col("cell").alias("grp"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    asked = probed.select(F.col("cell").alias("grp"), "qid", F.col("vec").alias("qvec"))
    held = asked.limit(knn.SHIPPED_QUERIES + 1).toArrow()
    if held.num_rows <= knn.SHIPPED_QUERIES:
        return knn.grouped_top(rows, held, k, metric, exclude_self=False, flag="deleted").select("qid", "id", "deleted", "dist")
    return rows.join(asked, "grp").select("qid", "id", "deleted", F.round(distance("qvec", "vec", metric), TIE_DECIMALS).alias("dist"))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id"))
    return rows.withColumn("rank", r).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)  # a limit that Spark applies before the shuffle


def ivf_search(corpus: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int, metric: str = "COSINE") -> DataFrame:
    """``(qid, rank, id, dist)``: the nearest live rows of the probed cells; short answers where the cells hold too few."""
    live = corpus.filter(~F.coalesce("deleted", F.lit(False)))
    return _ranked(_scored(live, queries, centroids, k, nprobe, metric), k).select("qid", "rank", "id", "dist")


def ivf_tombstoned(corpus: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int, ef_budget: int, metric: str = "COSINE") -> DataFrame:
    """As :func:`ivf_search`, but dead rows use up the candidate budget before they are dropped, so answers fall short."""
    seen = _ranked(_scored(corpus, queries, centroids, ef_budget, nprobe, metric), ef_budget).filter(~F.col("deleted")).drop("rank")
    return _ranked(seen, k).select("qid", "rank", "id", "dist")


def drop_self(found: DataFrame, k: int) -> DataFrame:
    """An engine's answer without the query itself, cut to ``k`` and ranked anew."""
    return _ranked(found.filter(F.col("id") != F.col("qid")).drop("rank"), k).select("qid", "rank", "id", "dist")


def normalised(corpus: DataFrame) -> DataFrame:
    """Vectors scaled to norm 1; zero vectors and those that cannot be scaled to it (not finite) are dropped."""
    return corpus.withColumn("vec", normalise("vec")).filter(F.col("vec").isNotNull())
