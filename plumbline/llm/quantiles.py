"""Percentiles of huge columns with bounded rank error: deterministic collapsing of weighted sorted buffers.

A sketch holds sorted buffers of ``k`` values; a buffer of level ``h`` stands for ``2**h`` input values per element. Two
buffers of a level collapse into one of the next by keeping every second element of their merged order, starting at the
first or the second element in turn. One collapse at level ``h`` moves the rank of any value by at most ``2**h``; the sum
of these amounts is kept as the proven bound. Up to ``k`` values per group the answers are exact.

Partitions build sketches of their own rows, and the sketches are merged in a tree of fixed fan-in over as many places as
there are partitions, so no task ever gets more than ``FAN_IN`` sketches of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.validate import encode_ids
from plumbline.session import broadcast_if_small, materialise

#: Elements of a buffer. With N values the bound is about log2(N / k) / (2 k) of N: under 0.03 % for 10**9 values.
BUFFER = 32_768
FAN_IN = 16
#: Values that a task holds before it hands its sketches on.
HELD = 8 << 20
QUANTILES = (0.5, 0.9, 0.99, 0.999)
SKETCH = "scope string, group_key string, part int, n bigint, rank_error bigint, levels array<int>, lengths array<int>, vals array<double>"


def collapse(a: np.ndarray, b: np.ndarray, second: bool) -> np.ndarray:
    """Every second element of the merged order of two sorted buffers of equal size and weight."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return both[1 if second else 0 :: 2]


class Sketch:
    """Buffers by level; ``loose`` are single values not yet forming a buffer."""

    def __init__(self, k: int = BUFFER):
        self.k, self.n, self.rank_error = k, 0, 0
        self.loose: list[np.ndarray] = []
        self.n_loose = 0
        self.full: dict[int, np.ndarray] = {}
        self.turn: dict[int, bool] = {}

    def _carry(self, level: int, buffer: np.ndarray) -> None:
        while level in self.full:
            self.turn[level] = not self.turn.get(level, True)
            buffer = collapse(self.full.pop(level), buffer, self.turn[level])
            self.rank_error += 1 << level
            level += 1
        self.full[level] = buffer

    def add(self, values: np.ndarray) -> None:
        """Take in finite values."""
        self.n += len(values)
        self._loose(np.asarray(values, dtype=np.float64))

    def _loose(self, values: np.ndarray) -> None:
        self.loose.append(values)
        self.n_loose += len(values)
        if self.n_loose > self.k:
            pool = np.concatenate(self.loose)
            whole = len(pool) // self.k * self.k
            if whole == len(pool):
                whole -= self.k  # an exact sketch of k values needs no buffer yet
            for at in range(0, whole, self.k):
                self._carry(0, np.sort(pool[at : at + self.k]))
            self.loose, self.n_loose = [pool[whole:]], len(pool) - whole

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.rank_error += other.rank_error
        for level in sorted(other.full):
            self._carry(level, other.full[level])
        for values in other.loose:
            self._loose(values)

    def held(self) -> int:
        """Values in memory."""
        return self.n_loose + self.k * len(self.full)

    def quantile(self, q: float) -> float:
        """The value of rank ``ceil(q * n)``, at least the first."""
        values = [np.concatenate(self.loose)] if self.n_loose else []
        weights = [np.ones(self.n_loose)] if self.n_loose else []
        for level, buffer in self.full.items():
            values.append(buffer)
            weights.append(np.full(len(buffer), float(1 << level)))
        v, w = np.concatenate(values), np.concatenate(weights)
        order = np.argsort(v, kind="stable")
        at = np.searchsorted(np.cumsum(w[order]), max(1, math.ceil(q * self.n)), side="left")
        return float(v[order][min(at, len(v) - 1)])

    def row(self) -> tuple:
        parts = [(-1, np.concatenate(self.loose) if self.loose else np.empty(0)), *sorted(self.full.items())]
        return self.n, self.rank_error, [p[0] for p in parts], [len(p[1]) for p in parts], np.concatenate([p[1] for p in parts])

    @staticmethod
    def of(row, k: int) -> Sketch:
        s, at = Sketch(k), 0
        s.n, s.rank_error = int(row.n), int(row.rank_error)
        for level, length in zip(row.levels, row.lengths):
            piece = np.asarray(row.vals[at : at + length], dtype=np.float64)
            at += length
            if level < 0:
                s.loose, s.n_loose = [piece], int(length)
            else:
                s.full[int(level)] = piece
        return s


_COLUMNS = [f.split()[0] for f in SKETCH.split(", ")]


def sketches(values: DataFrame, k: int = BUFFER) -> DataFrame:
    """One merged sketch per ``(scope, group_key)`` of ``values(scope, group_key, v)``.

    Null, NaN and infinite values are left out; a group without a finite value has no sketch. Null group keys form a
    group. Rows are taken as they are: remove repeated rows before. A task that holds more than HELD values hands its
    sketches on and begins new ones.
    """
    finite = values.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        found: dict[tuple, Sketch] = {}
        turn = added = 0

        def out() -> Iterator[pd.DataFrame]:
            rows = [(*key, turn, TaskContext.get().partitionId(), *s.row()) for key, s in found.items()]
            for at in range(0, len(rows), FAN_IN):
                yield pd.DataFrame(rows[at : at + FAN_IN], columns=[*_COLUMNS[:2], "turn", *_COLUMNS[2:]])

        for pdf in batches:
            for key, part in pdf.groupby(["scope", "group_key"], dropna=False, sort=False)["v"]:
                key = tuple(None if pd.isna(x) else x for x in key)
                found.setdefault(key, Sketch(k)).add(part.to_numpy())
            added += len(pdf)
            if added > HELD:
                added = sum(s.held() for s in found.values())
                if added > HELD:
                    yield from out()
                    found, turn, added = {}, turn + 1, 0
        yield from out()

    parts = materialise(finite.select("scope", "group_key", "v").mapInPandas(build, SKETCH.replace("part int", "turn int, part int")), "sketches")
    last = parts.agg(F.max("part").alias("part"), F.max("turn").alias("turn")).first()
    turns = (last["turn"] or 0) + 1
    numbered = parts.withColumn("part", F.col("part") * turns + F.col("turn")).drop("turn")
    return merge_tree(numbered, ((last["part"] or 0) + 1) * turns, k)


def merge_tree(parts: DataFrame, width: int, k: int = BUFFER) -> DataFrame:
    """Merge sketches whose ``part`` is below ``width``, FAN_IN parts at a time, to one per group."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        s = Sketch(k)
        for row in pdf.itertuples():
            s.merge(Sketch.of(row, k))
        first = pdf.iloc[0]
        return pd.DataFrame([(first["scope"], first["group_key"], int(first["part"]), *s.row())], columns=_COLUMNS)

    while width > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("scope", "group_key", "part").applyInPandas(merge, SKETCH)
        width = -(-width // FAN_IN)
    return parts


def combine(daily: DataFrame, scope: str, group_key: str, k: int = BUFFER) -> DataFrame:
    """One sketch of all the given sketches, without going back to the rows. The sketches are numbered densely, a null key first."""
    keys = encode_ids(daily.select("group_key"), "group_key").select(F.col("group_key").alias("_key"), (F.col("id") + 1).cast("int").alias("_part"))
    keys = materialise(keys, "keys")
    keyed = daily.join(broadcast_if_small(keys), F.col("group_key") == F.col("_key"), "left").withColumn("part", F.coalesce("_part", F.lit(0)))
    return merge_tree(keyed.select(F.lit(scope).alias("scope"), F.lit(group_key).alias("group_key"), *_COLUMNS[2:]), keys.count() + 1, k)


def rank_bounds(values: DataFrame, read: DataFrame) -> DataFrame:
    """``(scope, group_key, q, n, rank_error, within)``: whether each quantile of ``read`` is as near its rank as it says, by counting."""
    rows = values.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))).select(F.col("scope").alias("_s"), F.col("group_key").alias("_g"), "v")
    met = rows.join(broadcast_if_small(read), F.col("_s").eqNullSafe(F.col("scope")) & F.col("_g").eqNullSafe(F.col("group_key")))
    counts = met.groupBy("scope", "group_key", "q", "n", "rank_error").agg(F.sum((F.col("v") < F.col("value")).cast("bigint")).alias("_less"), F.sum((F.col("v") <= F.col("value")).cast("bigint")).alias("_upto"))
    rank = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("q") * F.col("n")))
    return counts.select("scope", "group_key", "q", "n", "rank_error", ((F.col("_less") + 1 - F.col("rank_error") <= rank) & (rank <= F.col("_upto") + F.col("rank_error"))).alias("within"))


def read_quantiles(sketched: DataFrame, qs: tuple[float, ...] = QUANTILES, k: int = BUFFER) -> DataFrame:
    """``(scope, group_key, q, value, n, rank_error)``; the true rank of ``value`` is within ``rank_error`` of ``ceil(q n)``."""
    schema = T.StructType.fromDDL("scope string, group_key string, q double, value double, n bigint, rank_error bigint")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                s = Sketch.of(row, k)
                rows += [(row.scope, row.group_key, q, s.quantile(q), s.n, s.rank_error) for q in qs if s.n]
            yield pd.DataFrame(rows, columns=schema.names)

    return sketched.mapInPandas(read, schema)


def metric_values(calibration: DataFrame) -> DataFrame:
    """``(scope, group_key, v)`` of calibration rows, each row_id once; metric ids are trimmed and lower-cased."""
    once = calibration.filter(F.col("row_id").isNotNull()).groupBy("row_id").agg(F.min(F.struct("written_at", "metric_id", "metric_value")).alias("r"))
    return once.select(F.lit("metric").alias("scope"), clean("r.metric_id").alias("group_key"), F.col("r.metric_value").alias("v"))


def recall_values(results: DataFrame) -> DataFrame:
    """``(scope, group_key, v)`` of recall_dist per day of reported_at, each (run_id, metric) once, at its first report."""
    name = clean("metric_id")
    rows = results.select("run_id", name.alias("metric"), "reported_at", F.col("detail.recall_dist").alias("v"))
    once = rows.groupBy("run_id", "metric").agg(F.min(F.struct("reported_at", "v")).alias("r"))
    return once.select(F.lit("recall_day").alias("scope"), _utc_day("r.reported_at").alias("group_key"), F.col("r.v").alias("v"))


def _utc_day(column: str):
    """The UTC day as text, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(F.col(column)) / 86_400).cast("int")).cast("string")


def clean(column: str):
    """Trimmed of any white space and lower-cased."""
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
