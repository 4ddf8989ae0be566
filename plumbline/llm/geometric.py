"""Uniform samples of fixed size from data of unknown length: a geometric file per shard.

Each shard keeps a reservoir outside memory. Newly accepted records wait in a memory buffer; a full buffer is flushed as a
subsample of randomly ordered segments whose sizes shrink exponentially, and older subsamples lose their largest segments
for it. So every accepted record evicts a random older one with sequential writes only.
Reservoirs of shards are merged by drawing each shard's part from the multivariate hypergeometric distribution of the
shard populations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import broadcast_if_small, default_tasks, materialise

#: Size of a segment against the one before it.
SHRINK = 0.75


def segment_sizes(n: int, least: int) -> list[int]:
    """Sizes of the segments of a subsample of ``n`` records: geometric down to ``least``, the rest as one tail."""
    sizes, left, size = [], n, max(1, round(n * (1 - SHRINK)))
    while left > least and size < left:
        sizes.append(size)
        left -= size
        size = max(1, round(left * (1 - SHRINK)))
    return [*sizes, left] if left else sizes


class GeometricFile:
    """A reservoir of ``capacity`` ids of which at most ``buffer`` new ones are in memory.

    Every id of the stream must be offered once. A full buffer is flushed: ``write(segment, ids)`` gets each new segment
    once, in random order, and the file is the newest state of :attr:`older`. A segment that an older one has to give way
    to is not overwritten in place but shortened or left out of that state, so whoever keeps the segments needs nothing
    but appending. After any number of offers, the live heads of the segments are a uniform sample without replacement
    of everything offered.
    """

    def __init__(self, capacity: int, buffer: int, rng: np.random.Generator, write: Callable[[int, np.ndarray], None]):
        self.capacity, self.buffer, self.rng, self.write = capacity, max(1, min(buffer, capacity)), rng, write
        self.seen = 0
        self.waiting: list[int] = []
        self.older: list[list[tuple[int, int]]] = []  # each subsample: (segment, live ids) of its segments, largest first
        self.on_disk = 0
        self.segments = 0

    def offer(self, ids: np.ndarray) -> None:
        """Take in a stretch of the stream; which of it is accepted is drawn at once, and only accepted ids are looked at."""
        at = 0
        while at < len(ids) and self.seen < self.capacity:  # until the reservoir is full, all are accepted
            n = min(self.capacity - self.seen, self.buffer - len(self.waiting), len(ids) - at)
            self.waiting += ids[at : at + n].tolist()
            self.seen, at = self.seen + n, at + n
            self._full()
        rest = ids[at:]
        if not len(rest):
            return
        accepted = np.nonzero(self.rng.random(len(rest)) * np.arange(self.seen + 1, self.seen + len(rest) + 1) < self.capacity)[0]
        self.seen += len(rest)
        # with chance (buffered / capacity) the evicted record is a waiting one, else it is on disk and goes at the flush
        for x, evicted in zip(rest[accepted].tolist(), (self.rng.random(len(accepted)) * self.capacity).astype(np.int64).tolist()):
            if evicted < len(self.waiting):
                self.waiting[evicted] = x
            else:
                self.waiting.append(x)
                self._full()

    def _full(self) -> None:
        if len(self.waiting) >= self.buffer:
            self.flush()

    def _evict(self, n: int) -> None:
        """Forget ``n`` records on disk. Segments hold records in random order, so a shorter head is a fair loss."""
        # which subsample loses how many: hypergeometric over their sizes, so that any record is as likely to go
        sizes = np.array([sum(s for _, s in sub) for sub in self.older], dtype=np.int64)
        lost = self.rng.multivariate_hypergeometric(sizes, n, method="marginals") if n else np.zeros(len(sizes), int)
        for sub, gone in zip(self.older, lost.tolist()):
            while gone:
                segment, size = sub[0]
                if size <= gone:
                    sub.pop(0)
                    gone -= size
                else:
                    sub[0] = (segment, size - gone)  # only the head of the segment still counts
                    gone = 0
        self.older = [sub for sub in self.older if sub]
        self.on_disk -= n

    def flush(self) -> None:
        if not self.waiting:
            return
        ids = self.rng.permutation(np.array(self.waiting, dtype=np.int64))
        self.waiting = []
        self._evict(max(0, self.on_disk + len(ids) - self.capacity))
        sub, at = [], 0
        for size in segment_sizes(len(ids), max(1, self.buffer // 16)):
            self.write(self.segments, ids[at : at + size])
            sub.append((self.segments, size))
            self.segments, at = self.segments + 1, at + size
        self.older.append(sorted(sub, key=lambda x: -x[1]))
        self.on_disk += len(ids)

    def live(self) -> list[tuple[int, int]]:
        """``(segment, live ids)`` after a last flush."""
        self.flush()
        return [x for sub in self.older for x in sub]


_SEGMENTS = "shard int, segment int, place int, id bigint, live int, population bigint"


def shard_reservoirs(stream: DataFrame, capacity: int, shards: int, buffer: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(shard, id)``, the reservoir of each shard of ``stream(id, batch_no)``, and ``(shard, population)``.

    The batches of a shard are offered in their order; an id that is sent again counts at its first batch only. Rows with
    a null id are left out. An empty stream gives no rows. The segments are rows that a task hands on as it flushes them,
    with a list of what is live of each at the end, so they lie where all output of Spark lies and a lost task is run anew.
    """
    first = stream.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("batch_no").alias("batch_no"))
    placed = first.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    ordered = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "batch_no", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, shard, flushed = None, 0, []
        for pdf in batches:
            if not len(pdf):
                continue
            if file is None:
                shard = int(pdf["shard"].iloc[0])
                file = GeometricFile(capacity, buffer, np.random.default_rng([seed, shard]), lambda segment, ids: flushed.append((segment, ids)))
            file.offer(pdf["id"].to_numpy())
            for segment, ids in flushed:
                yield _rows(shard, segment, ids)
            flushed.clear()
        if file is not None:
            live = file.live()
            for segment, ids in flushed:
                yield _rows(shard, segment, ids)
            ends = pd.DataFrame(live, columns=["segment", "live"])
            yield ends.assign(shard=shard, place=-1, id=0, population=file.seen)[_ORDER]

    written = materialise(ordered.mapInPandas(run, _SEGMENTS), "segments")
    heads = written.filter("place < 0").select("shard", "segment", "live", "population")
    ids = written.filter("place >= 0").select("shard", "segment", "place", "id").join(broadcast_if_small(heads.select("shard", "segment", "live")), ["shard", "segment"])
    return ids.filter(F.col("place") < F.col("live")).select("shard", "id"), heads.select("shard", "population").distinct()


_ORDER = [c.split()[0] for c in _SEGMENTS.split(", ")]


def _rows(shard: int, segment: int, ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"shard": shard, "segment": segment, "place": np.arange(len(ids)), "id": ids, "live": 0, "population": 0})


def fixed_size_samples(stream: DataFrame, sizes: DataFrame, seed: int = 1337, shards: int | None = None, buffer_share: float = 0.25) -> DataFrame:
    """``(queries, id)``: for every wanted size of ``sizes(queries)`` a uniform sample of that many distinct ids of ``stream(id, batch_no)``.

    A size above the population gives all ids; sizes of zero or less, and nulls, give none; a size that is asked for twice
    is drawn once. Results depend on the seed and the number of shards, not on the layout of the rows. The driver holds
    the shard populations only; each size draws its counts by shard where it stands.
    """
    spark = stream.sparkSession
    wanted = sizes.select(F.col("queries").cast("bigint").alias("queries")).filter("queries > 0").distinct()
    most = wanted.agg(F.max("queries")).first()[0]
    if not most:
        return spark.createDataFrame([], "queries bigint, id bigint")
    shards = shards or default_tasks(spark)
    pool, populations = shard_reservoirs(stream, most, shards, max(16, int(most * buffer_share)), seed)
    counts = sorted((r["shard"], r["population"]) for r in populations.collect())  # one row per shard
    order, colors = [c[0] for c in counts], np.array([c[1] for c in counts], dtype=np.int64)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = int(colors.sum())
        for pdf in batches:
            for size in pdf["queries"].tolist() if len(order) else ():
                drawn = np.random.default_rng([seed, size]).multivariate_hypergeometric(colors, size, method="marginals") if size <= total else colors
                yield pd.DataFrame({"queries": size, "shard": order, "take": drawn})

    plan = materialise(wanted.mapInPandas(draw, "queries bigint, shard int, take bigint"), "draws")
    # any subset of a uniform sample that does not look at the ids is uniform: the places are re-drawn for each size
    ranked = pool.join(broadcast_if_small(plan), "shard").withColumn("_u", F.xxhash64(F.lit(seed), "queries", "id"))
    return ranked.withColumn("_r", F.row_number().over(Window.partitionBy("queries", "shard").orderBy("_u", "id"))).filter("_r <= take").select("queries", "id")
