"""Deterministic 3-D projection: principal components from partial Gram matrices."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.knn import matrix


#: Matrices that a step of the tree leaves, as a part of those before, and that come to the driver.
FAN_IN = 8


def _cell(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], names=["m"])


@dataclass(frozen=True)
class Projection:
    mean: np.ndarray
    basis: np.ndarray  # d x 3
    scale: float
    explained: tuple[float, ...]


def fit(corpus: DataFrame, components: int = 3) -> Projection:
    """Mean, leading eigenvectors and scale of ``corpus(id, vec)``.

    Each task sums x and x x' of its rows and sends one d x d matrix as a single cell; the matrices are added in a tree and
    the driver gets FAN_IN of them. Signs are fixed so that the largest loading of a component is positive; with fewer
    dimensions than components the basis is padded with zeros. Vectors of another length than the first are left out.
    """
    first = corpus.select(F.size("vec").alias("d")).filter("d > 0").first()
    if not first:
        raise ValueError("an empty corpus cannot be projected")
    d = first["d"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for b in batches:
            ids, x = matrix(b.column("id"), b.column("vec"), dim=d)
            if len(ids):
                n += len(ids)
                s = x.sum(0) if s is None else s + x.sum(0)
                g = x.T @ x if g is None else g + x.T @ x
        if n:
            yield _cell(np.concatenate([[n], s, g.ravel()]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column("m"):
                part = np.frombuffer(x.as_buffer(), np.float64)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield _cell(total)

    parts, left = corpus.select("id", "vec").mapInArrow(sums, "m binary"), FAN_IN**2
    while left > 1:  # a tree: each task adds the matrices of its share, one at a time
        parts, left = parts.repartition(left, F.spark_partition_id()).mapInArrow(add, "m binary"), left // FAN_IN
    last = list(add(parts.toArrow().to_batches()))
    if not last:
        raise ValueError("an empty corpus cannot be projected")
    total = np.frombuffer(last[0].column("m")[0].as_buffer(), np.float64)
    n, mean, gram = total[0], total[1 : d + 1] / total[0], total[d + 1 :].reshape(d, d)
    cov = (gram - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    basis = np.zeros((d, components))
    basis[:, : min(d, components)] = vectors[:, :components]
    top = np.abs(basis).argmax(0)
    basis *= np.where(basis[top, np.arange(components)] < 0, -1, 1)
    whole = values.sum()
    return Projection(mean, basis, float(np.sqrt(3 * values[0])) or 1.0, tuple(float(v / whole) if whole > 1e-12 else 0.0 for v in values[:components]))


def transform(corpus: DataFrame, p: Projection) -> DataFrame:
    """``(id, x, y, z)`` as floats in [-1, 1]: centred, projected, scaled, clipped and stretched to the largest coordinate."""
    held = corpus.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for b in batches:
            ids, x = matrix(b.column("id"), b.column("vec"), dim=len(p.mean))
            y = np.clip((x - p.mean) @ p.basis / p.scale, -1, 1) if len(ids) else np.empty((0, 3))
            yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(y[:, i]) for i in range(3)]], names=["id", "x", "y", "z"])

    rows = corpus.select("id", "vec").mapInArrow(run, "id bigint, x double, y double, z double")
    top = rows.agg(F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z")))).first()[0] or 1.0
    return rows.select("id", *[(F.col(a) / top).cast("float").alias(a) for a in "xyz"])
