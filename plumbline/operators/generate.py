"""Synthetic corpora and the pathologies that audits must find. Everything follows from keyed hashes, not from streams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.sampling import derive_seed, first_by, first_by_group, keyed_hash
from plumbline.session import broadcast_if_small, hash_unit, materialise


def cluster_sizes(n: int, clusters: int, skew: float) -> list[int]:
    """Sizes that add up to ``n``: even, or falling with the rank to the power ``-skew``."""
    weights = [(r + 1) ** -skew for r in range(clusters)]
    raw = [n * w / sum(weights) for w in weights]
    sizes = [int(x) for x in raw]
    for i in sorted(range(clusters), key=lambda i: (sizes[i] - raw[i], i))[: n - sum(sizes)]:
        sizes[i] += 1
    return sizes


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of a well-known splittable generator)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _normal(seed: int, purpose: str, ids: np.ndarray, dim: int) -> np.ndarray:
    """Gaussian rows that follow from seed, purpose and id alone, all at once: hashed counters, turned by Box and Muller."""
    root = np.uint64(derive_seed(seed, purpose) % 2**64)
    with np.errstate(over="ignore"):
        row = _mixed(np.asarray(ids, dtype=np.int64).astype(np.uint64) ^ root)[:, None]
        half = -(-dim // 2)
        u = [(_mixed(row + np.arange(at, at + half, dtype=np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 for at in (0, half)]
    radius, turn = np.sqrt(-2 * np.log1p(-u[0])), 2 * np.pi * u[1]
    return np.concatenate([radius * np.cos(turn), radius * np.sin(turn)], axis=1)[:, :dim]


def generate_corpus(spark: SparkSession, n: int, dim: int, clusters: int, std: float = 0.2, skew: float = 0.0, seed: int = 1337, metric: str = "L2", norm_mean: float = 1.0, norm_std: float = 0.0) -> DataFrame:
    """``(id, vec, cluster_id, cell, deleted)``: Gaussian clusters; COSINE rows have norm 1, DOT rows random norms."""
    ends = np.cumsum(cluster_sizes(n, clusters, skew))
    centres = _normal(seed, "centres", np.arange(clusters), dim)
    held = spark.sparkContext.broadcast((ends, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, centres = held.value
        for b in batches:
            ids = b.column("id").to_numpy()
            c = np.searchsorted(ends, ids, side="right")
            x = centres[c] + std * _normal(seed, "points", ids, dim)
            if metric != "L2" and len(ids):
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            if metric == "DOT" and len(ids):
                x *= np.maximum(norm_mean + norm_std * _normal(seed, "norms", ids, 1), 1e-3)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * dim, pa.int32()), pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), vec, pa.array(c.astype(np.int64))], names=["id", "vec", "cluster_id"])

    return spark.range(n).mapInArrow(run, "id bigint, vec array<float>, cluster_id bigint").withColumn("cell", F.col("cluster_id")).withColumn("deleted", F.lit(False))


def apply_churn(corpus: DataFrame, fraction: float, skew: float, seed: int) -> DataFrame:
    """Mark ``round(fraction * live)`` live rows as deleted: by hash, or with a quota per cell falling with its rank.

    Cells are ranked by number; quotas beyond a cell's size are made up from the other rows by hash.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("the fraction must be between 0 and 1")
    live = corpus.filter(~F.col("deleted"))
    u = keyed_hash(seed, "churn")
    want = round(fraction * live.count())
    if not skew:
        gone = first_by(live, want, u).select("id")
    else:
        sizes = {r["cell"]: r["count"] for r in live.groupBy("cell").count().collect()}  # one row a cell
        cells = sorted(sizes)
        quota = dict(zip(cells, cluster_sizes(want, len(cells), skew)))
        table = corpus.sparkSession.createDataFrame([(c, quota[c]) for c in cells], f"cell {corpus.schema['cell'].dataType.simpleString()}, quota bigint")
        gone = first_by_group(live, table, u, "cell").select("id")
        short = want - sum(min(quota[c], sizes[c]) for c in cells)
        if short > 0:
            gone = gone.unionByName(first_by(live.join(gone, "id", "left_anti"), short, u).select("id"))
    return corpus.join(gone.withColumn("_gone", F.lit(True)), "id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def _replace(rows: DataFrame, seed: int, purpose: str, scale: float, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = (scale * _normal(seed, purpose, b.column("id").to_numpy(), dim)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dim, pa.int32()), pa.array(x.ravel()))], names=["id", "vec"])

    return rows.select("id").mapInArrow(run, "id bigint, vec array<float>")


def inject_hubs(corpus: DataFrame, n_hubs: int, strength: float, seed: int, metric: str = "L2") -> DataFrame:
    """Turn the live rows into a diffuse cloud and collapse at least ``n_hubs`` and 1 % of them into a tight ball.

    The smallest live ids become the hubs. DOT hubs get norm ``1 + strength``; COSINE rows are re-normalised.
    """
    if n_hubs < 1 or strength <= 0:
        raise ValueError("hubs and their strength must be positive")
    from plumbline.functions.vectors import norm, normalise

    live = corpus.filter(~F.col("deleted"))
    stats = live.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(norm("vec"), 2) / F.size("vec")).alias("ms"), F.max(F.size("vec")).alias("d")).first()
    if not stats["n"]:
        raise ValueError("a corpus without live rows cannot have hubs")
    scale = max(math.sqrt(stats["ms"] or 0), 1e-6) if (stats["ms"] or 0) > 1e-12 else 1.0
    count = min(stats["n"], max(n_hubs, math.ceil(0.01 * stats["n"])))
    hubs = live.select("id").orderBy("id").limit(count)
    ball = _replace(hubs, seed, "hubs", scale / (100 * strength), stats["d"])
    if metric == "DOT":
        ball = ball.withColumn("vec", F.transform(normalise("vec"), lambda x: (x * (1 + strength)).cast("float")))
    cloud = _replace(live.select("id").join(broadcast_if_small(hubs), "id", "left_anti"), seed, "cloud", scale, stats["d"])
    new = ball.unionByName(cloud)
    if metric == "COSINE":
        new = new.withColumn("vec", normalise("vec"))
    return corpus.join(new.withColumnRenamed("vec", "_vec"), "id", "left").withColumn("vec", F.coalesce("_vec", "vec")).drop("_vec")


def inject_antihubs(corpus: DataFrame, n: int, factor: float, seed: int) -> DataFrame:
    """Append ``n`` rows far outside: random directions at ``factor`` times the largest norm."""
    from plumbline.functions.vectors import norm, normalise

    top = corpus.agg(F.max("id").alias("id"), F.max(norm("vec")).alias("r"), F.max(F.size("vec")).alias("d")).first()
    ids = corpus.sparkSession.range(top["id"] + 1, top["id"] + 1 + n)
    far = _replace(ids, seed, "antihubs", 1.0, top["d"]).withColumn("vec", F.transform(normalise("vec"), lambda x: (x * (factor * top["r"])).cast("float")))
    extra = {c: F.lit(None).cast(corpus.schema[c].dataType) for c in corpus.columns if c not in ("id", "vec", "deleted")}
    return corpus.unionByName(far.withColumns({**extra, "deleted": F.lit(False)}).select(*corpus.columns))


def growth_for_cv(sizes: list[int], target_cv: float) -> float:
    """The growth of the larger half of the cells that brings the population cv of all sizes to ``target_cv``, by bisection.

    Sizes that are as uneven already need none (1); a cv that no growth reaches raises.
    """
    x = np.sort(np.asarray(sizes, dtype=np.float64))[::-1]
    large = np.arange(len(x)) < max(1, len(x) // 2)
    cv = lambda g: float((y := np.where(large, x * g, x)).std() / y.mean()) if x.sum() else 0.0
    if cv(1.0) >= target_cv:
        return 1.0
    low, high = 1.0, 1e6
    if cv(high) < target_cv:
        raise ValueError(f"no growth of half the cells gives a cv of {target_cv}")
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if cv(middle) < target_cv else (low, middle)
    return high


def skew_partitions(corpus: DataFrame, growth: float | None, seed: int, target_cv: float | None = None) -> DataFrame:
    """Grow the larger half of the cells: each of their live rows gets ``growth - 1`` jittered copies with new ids (a
    fractional part of the rows one more), or as many as give the sizes the cv ``target_cv``. Cells stay as they were when
    the index was built."""
    live = corpus.filter(~F.col("deleted"))
    sizes = live.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cell").collect()  # one row a cell
    if (growth is None) == (target_cv is None):
        raise ValueError("either the growth or the cv must be given")
    growth = growth if growth is not None else growth_for_cv([r["n"] for r in sizes], target_cv)
    large = corpus.sparkSession.createDataFrame([(r["cell"],) for r in sizes[: max(1, len(sizes) // 2)]], f"cell {corpus.schema['cell'].dataType.simpleString()}")
    top = corpus.agg(F.max("id").alias("id")).first()["id"] + 1
    whole, part = int(growth - 1), (growth - 1) % 1
    copies = F.lit(whole) + (hash_unit(F.lit(seed), F.lit("grow"), "id") < part).cast("int")
    grown = live.join(broadcast_if_small(large), "cell", "left_semi")
    rows = grown.withColumn("_c", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    jitter = F.transform("vec", lambda x, i: (x + (hash_unit(F.lit(seed), F.col("id"), F.col("_c"), i) - 0.5) * 1e-3).cast("float"))
    new = rows.withColumn("vec", jitter).withColumn("id", F.col("id") + F.lit(top) * F.col("_c")).drop("_c")
    return corpus.unionByName(new.select(*corpus.columns))


@dataclass(frozen=True)
class Scenario:
    """How a corpus is made, spoilt and searched (``search`` of None is exact), and what an audit must find."""

    rows: int
    dims: int
    clusters: int
    std: float
    skew: float
    seed: int
    steps: tuple
    search: dict | None
    verdict: str
    states: dict


#: Sizes of a scenario against the small one.
SIZES = {"tiny": 0.25, "small": 1.0, "large": 12.5}
#: The named scenarios at size small.
SCENARIOS = {
    "healthy": Scenario(8_000, 16, 32, 0.15, 0.0, 101, (), {"nprobe": 8}, "OK", {"canary_recall": "OK", "dfi": "OK", "partition_size_cv": "OK"}),
    "drifted": Scenario(2_000, 16, 16, 0.2, 0.3, 202, (("skew", 10, 203),), {"nprobe": 2}, "OK", {"dfi": "OK", "partition_size_cv": "OK"}),
    "tombstoned": Scenario(8_000, 16, 16, 0.2, 0.5, 303, (("churn", 0.35, 2.0, 304),), {"nprobe": 1, "ef_budget": 8}, "FAIL", {"dfi": "FAIL"}),
    "hubby": Scenario(8_000, 64, 24, 0.1, 0.0, 404, (("hubs", 8, 4.0, 405), ("antihubs", 20, 8.0, 406)), None, "WARN", {"canary_recall": "OK", "hub_share_top1pct": "FAIL", "antihub_fraction": "FAIL", "partition_size_cv": "UNAVAILABLE"}),
    "capability_limited": Scenario(2_000, 16, 8, 0.2, 0.0, 505, (("churn", 0.2, 0.0, 506),), None, "INCONCLUSIVE", {"canary_recall": "OK", "dfi": "UNAVAILABLE", "partition_size_cv": "UNAVAILABLE"}),
    "tiny": Scenario(50, 8, 5, 0.2, 0.0, 606, (), None, "INCONCLUSIVE", {"canary_recall": "OK", "hub_share_top1pct": "UNAVAILABLE", "antihub_fraction": "UNAVAILABLE", "partition_size_cv": "UNAVAILABLE"}),
}


def scenario_parts(spark: SparkSession, name: str, rows: int | None = None, size: str = "small") -> tuple[DataFrame, DataFrame]:
    """The corpus of a named scenario as it was when its index was built, and as it is now."""
    s = SCENARIOS[name]
    n = rows or max(50, round(s.rows * SIZES[size]))
    built = materialise(generate_corpus(spark, n, s.dims, s.clusters, s.std, s.skew, s.seed), "built")
    now = built
    for kind, *args in s.steps:
        if kind == "churn":
            now = apply_churn(now, *args)
        elif kind == "hubs":
            now = inject_hubs(now, *args)
        elif kind == "antihubs":
            now = inject_antihubs(now, *args)
        else:
            now = skew_partitions(now, *args)
        now = materialise(now, "scenario")
    return built, now


def scenario(spark: SparkSession, name: str, rows: int | None = None, size: str = "small") -> DataFrame:
    """The corpus of a named scenario, optionally at another number of rows or size."""
    return scenario_parts(spark, name, rows, size)[1]
