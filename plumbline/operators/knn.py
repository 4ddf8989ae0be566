"""Exact k-nearest neighbours of a stated query set, in long form ``(qid, rank, id, dist)``; rank from 0."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.vectors import TIE_DECIMALS, all_finite, distance
from plumbline.session import broadcast_if_small, materialise, rows_up_to

#: Queries that may travel with the tasks; larger sets are compared block by block.
SHIPPED_QUERIES = 20_000
#: Queries from which a corpus that is no larger than they are travels instead, so that a task finishes its queries.
MANY_QUERIES = 2_000
BLOCK_ROWS = 65_536
#: Memory for the distances of queries to rows that are held at once.
WORKING_SET_MB = 256
#: Numbers of the pairs whose exact distances are computed at once.
PAIR_NUMBERS = 256 << 10
#: Candidates that all tasks together may send to the final ranking; larger tasks send fewer.
SENT_ROWS = 200_000_000


def matrix(ids: pa.Array, vecs: pa.Array, dtype: type | None = np.float64, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows; rows with a null id, a null vector, another length than ``dim``, else than the first, or a number that
    is null or not finite are left out.

    ``dtype`` of None keeps the precision of the input.
    """
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    vecs = vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs
    lengths = vecs.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    known = lengths[lengths > 0]
    if not len(known):
        return np.empty(0, np.int64), np.empty((0, dim or 0))
    dim = dim or int(known[0])
    keep = (lengths == dim) & ids.is_valid().to_numpy(zero_copy_only=False)
    mask = pa.array(keep)
    whole = bool(keep.all())
    flat = (vecs if whole else vecs.filter(mask)).flatten().to_numpy(zero_copy_only=False)
    rows = (flat if dtype is None else flat.astype(dtype, copy=False)).reshape(-1, dim)
    ids = ids.filter(mask).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(all="ignore"):
        clean = bool(np.isfinite(flat.sum()))  # one pass tells that all are finite; else the rows are looked at
    if not clean:
        fine = np.isfinite(rows).all(1)
        ids, rows = ids[fine], rows[fine]
    return ids, rows


def score(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all queries to all rows by one matrix product."""
    inner = queries @ rows.T
    if metric == "L2":
        return np.sqrt(np.maximum((queries**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * inner, 0))
    return 1 - inner if metric == "COSINE" else -inner


def pair_distance(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows ``a[i]`` and ``b[j]`` in double precision, a stretch of pairs that fits a cache at a time."""
    out = np.empty(len(i))
    step = max(1, PAIR_NUMBERS // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        x, y = a[i[s : s + step]].astype(np.float64), b[j[s : s + step]]
        if metric == "L2":
            x -= y
            out[s : s + step] = np.sqrt(np.einsum("ij,ij->i", x, x))
        else:
            out[s : s + step] = np.einsum("ij,ij->i", x, y.astype(np.float64))
    return out if metric == "L2" else 1 - out if metric == "COSINE" else -out


def block_top(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, metric: str, exclude_self: bool, working_set_mb: int = WORKING_SET_MB) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest rows of each query in a block, ties at the border included: ``(qid, id, dist)``.

    One matrix product in the precision of the rows preselects, with a margin above its rounding error; what is left gets
    its distance in double precision. Queries and rows must be finite; a block whose squares do not fit its precision is
    compared in double precision. At most ``working_set_mb`` of distances are held at once.
    """
    nothing = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(ids) or not len(qids):
        return nothing
    q = q.astype(x.dtype, copy=False)
    x2, q2 = _squares(x), _squares(q)
    if not (np.isfinite(x2).all() and np.isfinite(q2).all()):
        x, q = x.astype(np.float64), q.astype(np.float64)
        x2, q2 = _squares(x), _squares(q)
    out = []
    unit = 5 * float(np.finfo(x.dtype).eps) * x.shape[1]  # a sum of d products is off by d * eps of their sizes at most
    step = max(1, (working_set_mb << 20) // (x.dtype.itemsize * 3 * len(ids)))
    largest = float(x2.max())
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    for s in range(0, len(qids), step):
        ask, a2 = q[s : s + step], q2[s : s + step, None]
        d = ask @ x.T
        d *= -2 if metric == "L2" else -1
        if metric == "L2":
            d += x2  # the square less that of the query: the same order
        if exclude_self:
            low, high = np.searchsorted(sorted_ids, qids[s : s + step], "left"), np.searchsorted(sorted_ids, qids[s : s + step], "right")
            while (same := np.nonzero(low < high)[0]).size:  # once, unless an id is repeated
                d[same, order[low[same]]] = np.inf
                low[same] += 1
        at = min(k, d.shape[1]) - 1
        edge = np.partition(d, at, axis=1)[:, at, None]
        limit = np.minimum(edge + unit * (a2 + largest), np.finfo(d.dtype).max)  # what is excluded stays beyond it
        i, j = np.nonzero(d <= limit)
        out.append((qids[s + i], ids[j], np.round(pair_distance(ask, i, x, j, metric), TIE_DECIMALS)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _squares(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.einsum("ij,ij->i", rows, rows)


def keep_top(qid: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` smallest of each query by (dist, id), an id once."""
    order = np.lexsort((ids, dist, qid))
    qid, ids, dist = qid[order], ids[order], dist[order]
    if not len(qid):
        return qid, ids, dist
    twice = np.concatenate([[False], (qid[1:] == qid[:-1]) & (ids[1:] == ids[:-1]) & (dist[1:] == dist[:-1])])
    qid, ids, dist = qid[~twice], ids[~twice], dist[~twice]
    start = np.concatenate([[True], qid[1:] != qid[:-1]])
    place = np.arange(len(qid)) - np.maximum.accumulate(np.where(start, np.arange(len(qid)), 0))
    return qid[place < k], ids[place < k], dist[place < k]


def rank_top(candidates: DataFrame, k: int, *groups: str) -> DataFrame:
    """Final ranking of ``(qid, id, dist)`` candidates by (dist, id), an id once per query: one shuffle, by query."""
    keys = [*groups, "qid"]
    once = candidates.repartition(*keys).groupBy(*keys, "id").agg(F.min("dist").alias("dist"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("dist", "id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select(*keys, (F.col("rank") - 1).alias("rank"), "id", "dist")


def exact_knn(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "COSINE", exclude_self: bool = True, strategy: str = "arrow", working_set_mb: int = WORKING_SET_MB) -> DataFrame:
    """Exact neighbours of ``queries(qid, vec)`` in ``corpus(id, vec)``.

    ``strategy``: "arrow" streams the corpus through one matrix product per batch, with the queries shipped to the tasks
    if they are at most SHIPPED_QUERIES, else in blocks; of many queries and a corpus that is no larger, the corpus is shipped; "expression" is the same in Catalyst expressions, for small
    inputs and cross-checks. Self matches (``id = qid``) are excluded before ranking; fewer than ``k`` rows give short
    answers; a repeated id counts once; vectors that are null, of another length than most queries, or hold a number that
    is null or not finite take no part, and such queries have no answer. COSINE is 1 - dot: normalise before. An empty
    side gives no rows.
    """
    corpus, queries = corpus.select("id", "vec"), queries.select("qid", F.col("vec").alias("qvec"))
    if strategy == "expression":
        rows, asked = corpus.filter(all_finite("vec")), broadcast_if_small(queries.filter(all_finite("qvec")))
        pairs = rows.join(asked, (F.size("vec") == F.size("qvec")) & ((F.col("id") != F.col("qid")) if exclude_self else F.col("id").isNotNull()))
        return rank_top(pairs.select("qid", "id", F.round(distance("qvec", "vec", metric), TIE_DECIMALS).alias("dist")), k)
    few = min(MANY_QUERIES, SHIPPED_QUERIES)
    asked = queries.limit(few + 1).toArrow()
    if asked.num_rows > few:
        n, dim = _usual(queries)
        if n <= SHIPPED_QUERIES and rows_up_to(corpus, n) <= n:
            return rank_top(_turned(corpus, queries, dim, k, metric, exclude_self, working_set_mb), k)
        if n > SHIPPED_QUERIES:
            return rank_top(_blocked(corpus, queries, dim, k, metric, exclude_self, working_set_mb), k)
        asked = queries.toArrow()
    return rank_top(_shipped(corpus, asked, k, metric, exclude_self, working_set_mb), k)


def _usual(queries: DataFrame) -> tuple[int, int | None]:
    """Rows, and the length that most vectors have, the smaller one of equally usual ones."""
    sizes = queries.groupBy(F.coalesce(F.size("qvec"), F.lit(-1)).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a length
    usual = [(-r["n"], r["d"]) for r in sizes if r["d"] > 0]
    return sum(r["n"] for r in sizes), min(usual)[1] if usual else None


def exact_knn_within(corpus: DataFrame, queries: DataFrame, k: int, metric: str, seconds: float, slices: int = 16, working_set_mb: int = WORKING_SET_MB) -> tuple[DataFrame, bool]:
    """Neighbours among as many slices of the corpus (by hash of the id) as a deadline allows, and whether it cut any off.

    At least one slice is searched. The slices' answers are kept, so that what was found in time is not searched again.
    """
    began, found = time.monotonic(), None
    for i in range(slices):
        part = corpus.filter(F.pmod(F.xxhash64("id"), F.lit(slices)) == i)
        top = materialise(exact_knn(part, queries, k, metric, working_set_mb=working_set_mb).select("qid", "id", "dist"), "slice")
        found = top if found is None else found.unionByName(top)
        if time.monotonic() - began > seconds and i + 1 < slices:
            return rank_top(found, k), True
    return rank_top(found, k), False


_SCHEMA = "qid bigint, id bigint, dist double"


def shipped_queries(asked: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of queries ``(qid, qvec)`` of the usual length, wherever the others stand."""
    lengths = asked.column("qvec").combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    counts = np.bincount(lengths[lengths > 0], minlength=1)
    return matrix(asked.column("qid"), asked.column("qvec"), None, int(counts.argmax()) or None)


def few_tasks(corpus: DataFrame, sent_each: int) -> DataFrame:
    """``corpus`` in so few tasks that all together send SENT_ROWS rows at most, if each sends ``sent_each``."""
    return corpus.coalesce(max(2 * corpus.sparkSession.sparkContext.defaultParallelism, SENT_ROWS // max(1, sent_each)))


def _shipped(corpus: DataFrame, asked: pa.Table, k: int, metric: str, exclude_self: bool, working_set_mb: int) -> DataFrame:
    qids, q = shipped_queries(asked)
    held = corpus.sparkSession.sparkContext.broadcast((qids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = held.value
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for b in batches if len(qids) else ():
            ids, x = matrix(b.column("id"), b.column("vec"), None, q.shape[1])
            if len(ids):
                found = block_top(qids, q, ids, x, k, metric, exclude_self, working_set_mb)
                best = keep_top(*(np.concatenate(c) for c in zip(best, found)), k)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names=["qid", "id", "dist"])

    return few_tasks(corpus, len(qids) * k).mapInArrow(run, _SCHEMA)


def _turned(corpus: DataFrame, queries: DataFrame, dim: int | None, k: int, metric: str, exclude_self: bool, working_set_mb: int) -> DataFrame:
    """The same with the corpus shipped and the queries streamed: a task sends ``k`` rows for each of its own queries only."""
    rows = corpus.toArrow()
    held = corpus.sparkSession.sparkContext.broadcast(matrix(rows.column("id"), rows.column("vec"), None, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = held.value
        for b in batches if len(ids) else ():
            qids, q = matrix(b.column("qid"), b.column("qvec"), None, x.shape[1])
            found = keep_top(*block_top(qids, q, ids, x, k, metric, exclude_self, working_set_mb), k)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["qid", "id", "dist"])

    return queries.mapInArrow(run, _SCHEMA)


def grouped_top(rows: DataFrame, asked: pa.Table, k: int, metric: str, exclude_self: bool = True, flag: str | None = None) -> DataFrame:
    """``(grp, qid, id, dist)`` candidates of ``asked(grp, qid, qvec)`` among the rows ``(grp, id, vec)`` of the same group.

    A query may be asked in several groups. ``flag`` names a boolean column of ``rows`` that is carried along.
    """
    lengths = asked.column("qvec").combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    dim = int(np.bincount(lengths[lengths > 0], minlength=1).argmax()) or None
    no, q = matrix(pa.array(np.arange(asked.num_rows)), asked.column("qvec"), None, dim)
    groups, qids = asked.column("grp").to_pylist(), asked.column("qid").to_numpy()
    of: dict = {}
    for place, i in enumerate(no):
        of.setdefault(groups[i], []).append(place)
    of = {g: np.array(v) for g, v in of.items()}
    held = rows.sparkSession.sparkContext.broadcast((of, no, qids[no], q))
    kind = rows.schema["grp"].dataType.simpleString()
    extra = f", {flag} boolean" if flag else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, no, qids, q = held.value
        best: dict = {}
        for b in batches if len(no) else ():
            ids, x, at = _rows_of(b, q.shape[1])
            grp = b.column("grp").take(pa.array(at)).dictionary_encode()
            code, names = grp.indices.to_numpy(), grp.dictionary.to_pylist()
            mark = b.column(flag).fill_null(False).to_numpy(zero_copy_only=False)[at] if flag else None
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(names) + 1))
            for c, g in enumerate(names):
                if g not in of:
                    continue
                mine, places = order[cuts[c] : cuts[c + 1]], of[g]
                a, r, d = block_top(qids[places], q[places], ids[mine], x[mine], k, metric, exclude_self)
                f = np.zeros(len(r), bool) if mark is None else mark[mine][_place(ids[mine], r)]
                old = best.get(g, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool)))
                best[g] = keep_flagged(*(np.concatenate(p) for p in zip(old, (a, r, d, f))), k)
        for g, (a, r, d, f) in best.items():
            cols = [pa.array([g] * len(a), type=kinds["grp"]), pa.array(a), pa.array(r), pa.array(d)] + ([pa.array(f)] if flag else [])
            yield pa.RecordBatch.from_arrays(cols, names=["grp", "qid", "id", "dist", *([flag] if flag else [])])

    kinds = {"grp": asked.schema.field("grp").type}
    each = max(1, asked.num_rows * k)
    return few_tasks(rows.select("grp", "id", "vec", *([flag] if flag else [])), each).mapInArrow(run, f"grp {kind}, qid bigint, id bigint, dist double{extra}")


def _rows_of(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and places in the batch of its usable rows."""
    at, x = matrix(pa.array(np.arange(b.num_rows)), b.column("vec"), None, dim)
    some = b.column("id").is_valid().to_numpy(zero_copy_only=False)[at]
    at, x = at[some], x[some]
    return b.column("id").take(pa.array(at)).to_numpy().astype(np.int64), x, at


def _place(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted id first stands."""
    order = np.argsort(ids, kind="stable")
    return order[np.searchsorted(ids[order], wanted)]


def keep_flagged(qid: np.ndarray, ids: np.ndarray, dist: np.ndarray, flag: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """As :func:`keep_top`, with a flag a row that is carried along; the flag belongs to the id."""
    a, r, d = keep_top(qid, ids, dist, k)
    return a, r, d, flag[_place(ids, r)] if len(r) else np.empty(0, bool)


def _blocked(corpus: DataFrame, queries: DataFrame, dim: int | None, k: int, metric: str, exclude_self: bool, working_set_mb: int) -> DataFrame:
    blocks = max(1, -(-corpus.count() // BLOCK_ROWS))
    rows = corpus.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    q_blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    rows = rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(q_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if a.num_rows and b.num_rows:
            ids, x = matrix(a.column("id"), a.column("vec"), None, dim)
            qids, q = matrix(b.column("qid"), b.column("qvec"), None, dim)
            if len(ids) and len(qids):
                found = keep_top(*block_top(qids, q, ids, x, k, metric, exclude_self, working_set_mb), k)
        return pa.table([pa.array(c) for c in found], names=["qid", "id", "dist"])

    return rows.groupBy("block", "qb").cogroup(asked.groupBy("block", "qb")).applyInArrow(run, _SCHEMA)


def d_k(neighbours: DataFrame) -> DataFrame:
    """``(qid, d_k, n)``: distance of the last neighbour given, and how many there are."""
    return neighbours.groupBy("qid").agg(F.max("dist").alias("d_k"), F.count(F.lit(1)).alias("n"))
