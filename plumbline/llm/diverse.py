"""Varied subsets of a given size: determinantal greedy selection over composable core-sets.

Two points resemble each other as a Gaussian kernel of their distance says, and less if their classes differ. A subset is
as varied as the determinant of its kernel matrix is large; the greedy choice takes the point with the largest gain, kept
up to date by one row of the Cholesky factor per step. The kernel is cut off at the borders of an octree level, so the
matrix falls into blocks of eight cells, the determinant into factors, and the greedy order over all is the blocks' orders
merged by gain. The level of a run and budget is the coarsest whose cells can give enough points; it has fewer occupied cells than
the budget has points, so every occupied cell is in the subset. Levels go down to where points coincide; what crowded
cells still lack is taken from the unused cells of the levels below, one point each.

Points move once, to the task of their (run, coarse cell); crowded cells are split over several tasks and pieces. Each
piece is reduced to core-sets. The core-sets of eight neighbouring cells are united, and a last greedy pass maximises the
determinant of the kernel over all of them, so that likeness across the cells' borders counts; what it gains ranks the
points of a run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.heavy_keys import fragment, plan_counted, sized_join
from plumbline.operators.sampling import first_by_group
from plumbline.session import broadcast_if_small, materialise

#: Levels of the octree (points that share a cell of the last one coincide), and the level by which points are spread over tasks.
DEPTH, BLOCK_LEVEL = 20, 3
#: Levels that are counted at once when the level of a run and budget is looked for, coarse ones first.
STAGES = ((1, 6), (7, 10), (11, 14), (15, DEPTH))
#: Shifts and masks that move the bits of a number of DEPTH bits to every third place.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
#: A coordinate this many powers of two beyond 99 % of its run is brought nearer, by the logarithm.
FAR = 10
#: Points a cell must be able to give (an octree cell has eight children), and points it is asked for.
ENOUGH, PICKS = 8, 10
#: Points that eight neighbouring cells are asked for when their core-sets are united.
PARENT_PICKS = 64
#: Width of the kernel in cells, and the kernel between different classes.
WIDTH, OTHER_CLASS = 0.35, 0.5
#: Rows that a task takes in before it works on the whole blocks it has.
UNIT = 65_536
NO_CELL = -1


def greedy(cell: np.ndarray, p: np.ndarray, cls: np.ndarray, picks: int = PICKS) -> tuple[np.ndarray, np.ndarray]:
    """Greedy choice in many cells at once: ``(row, gain)`` of up to ``picks`` rows of each cell.

    Rows must be grouped by ``cell``; of equal gains the earlier row wins. The gain is the factor by which the
    determinant grows, 1 for the first row of a cell. A row that adds nothing (a copy of a chosen one) is never chosen.
    """
    rows = np.arange(len(cell))
    chosen, gains = [], []
    starts = np.concatenate([[0], np.nonzero(cell[1:] != cell[:-1])[0] + 1]) if len(cell) else np.empty(0, int)
    sizes = np.diff(np.concatenate([starts, [len(cell)]]))
    group = np.repeat(np.arange(len(starts)), sizes)
    p = p.astype(np.float32)
    left = np.ones(len(cell), np.float32)
    factor = np.zeros((len(cell), picks), np.float32)
    for t in range(picks):
        if not len(rows):
            break
        best = np.maximum.reduceat(left, starts)
        at = np.minimum.reduceat(np.where(left >= best[group] - 1e-7, np.arange(len(rows)), len(rows)), starts)
        live = best > 1e-5
        chosen.append(rows[at[live]])
        gains.append(best[live])
        if t == picks - 1:
            break
        mine = at[group]
        d2 = ((p - p[mine]) ** 2).sum(1)
        k = np.exp(d2 * np.float32(-0.5 / WIDTH**2))
        k[cls != cls[mine]] *= np.float32(OTHER_CLASS)
        if t:
            k -= np.einsum("ij,ij->i", factor[:, :t], factor[mine, :t])
        e = k / np.sqrt(np.maximum(best, 1e-5))[group]
        factor[:, t] = e
        left = left - e * e
        left[at] = -1
        keep = (live & (sizes > t + 1))[group]  # cells that have given all they have drop out, once they are worth a copy
        if np.count_nonzero(keep) < 0.85 * len(keep):
            rows, p, cls, left, factor, group = rows[keep], p[keep], cls[keep], left[keep], factor[keep], group[keep]
            first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.empty(0, bool)
            starts = np.nonzero(first)[0]
            sizes = np.diff(np.concatenate([starts, [len(group)]]))
            group = np.repeat(np.arange(len(starts)), sizes)
    return (np.concatenate(chosen), np.concatenate(gains)) if chosen else (np.empty(0, int), np.empty(0, np.float32))


def _firsts(key: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Index of the row of smallest ``u`` for each key."""
    order = np.lexsort((u, key))
    k = key[order]
    return order[np.concatenate([[True], k[1:] != k[:-1]])] if len(key) else order


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that a row of grouped rows is in."""
    change = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate([[0], np.cumsum(change)]) if len(keys[0]) else np.empty(0, int)


_FOUND = "run_id bigint, level int, parent bigint, cell bigint, id bigint, u bigint, cls int, x float, y float, z float"
_SCORED = "run_id bigint, level int, id bigint, u bigint, cls int, gain float, lead boolean"


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], split_on: str | None = None) -> Iterator[pa.RecordBatch]:
    """Feed ``work`` with about UNIT rows at a time, cut between groups of equal ``keys``; the rows come grouped.

    A group of more than UNIT rows is held as a whole, or, with ``split_on``, is cut between different values of that
    column; every row is copied a bounded number of times.
    """
    held: list[pa.RecordBatch] = []
    n, least = 0, UNIT
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = _last_change([table.column(k).to_numpy() for k in keys])
        if not cut and split_on:
            cut = _last_change([table.column(split_on).to_numpy()])
        if cut:
            yield from work(table.slice(0, cut))
        held = table.slice(cut).to_batches()
        n = table.num_rows - cut
        least = UNIT if cut else 2 * n  # looked at again when it has doubled
    if n:
        yield from work(pa.Table.from_batches(held).combine_chunks())


def _last_change(keys: list[np.ndarray]) -> int:
    """Where the last run of equal keys begins; 0 if all are equal."""
    same = np.ones(len(keys[0]), bool)
    for k in keys:
        same &= k == k[-1]
    return 0 if same.all() else len(same) - int(same[::-1].argmin())


def _core_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Core-sets of each cell of each level that is wanted, block by block; the rows of a task come ordered by run, block, shard, hash and id.

    A block of more than UNIT rows is taken in pieces: a core-set of core-sets is one of the whole.
    """

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {n: table.column(n).to_numpy() for n in ("run_id", "cell", "block", "_shard", "id", "u", "cls", "levels")}
        p = np.stack([table.column(n).to_numpy() for n in "xyz"], 1)
        part = _runs(c["run_id"], c["block"], c["_shard"])
        once = np.concatenate([[True], (c["id"][1:] != c["id"][:-1]) | (part[1:] != part[:-1])])  # rows sent again are neighbours
        c, p, part = {n: x[once] for n, x in c.items()}, p[once], part[once]
        run_no = _runs(c["run_id"])
        for level in range(DEPTH + 1):
            at = np.nonzero((c["levels"] >> level) & 1)[0]
            if not len(at):
                continue
            run, ids, u, cls, cell = (c[n][at] for n in ("run_id", "id", "u", "cls", "cell"))
            if level:
                fine = np.where(cell < 0, NO_CELL, cell >> (3 * (DEPTH - max(level, BLOCK_LEVEL))))
                order = np.lexsort((fine, part[at]))  # keeps the hash order of the rows within a cell
                chosen, _ = greedy(_runs(part[at][order], fine[order]), p[at][order] * np.float32(2**level), cls[order])
                take = np.unique(np.concatenate([order[chosen], _firsts(run_no[at] * 1024 + cls, u)]))
                coarse = np.where(cell < 0, NO_CELL, cell >> (3 * (DEPTH - level))).astype(np.int64)
                cols = [run, np.full(len(at), level, np.int32), np.where(coarse < 0, NO_CELL, coarse >> 3), coarse, ids, u, cls.astype(np.int32), *p[at].T]
                cols = [x[take] for x in cols]
            else:  # taken anyway: nothing but the ids is needed, and zeros take no room
                none = np.zeros(len(at), np.int64)
                cols = [run, none.astype(np.int32), none, none, ids, none, none.astype(np.int32), *np.zeros((3, len(at)), np.float32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=[f.split()[0] for f in _FOUND.split(", ")])

    yield from _whole_groups(batches, ["run_id", "block", "_shard"], work, "id")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Choose again from the united core-sets of eight neighbouring cells, by one kernel over all of them.

    The rows of a task come ordered by run, level, parent, cell and hash. ``lead`` marks the first choice of each cell;
    what the choice leaves has gain 0.
    """

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        run, level, parent, cell, cls, u = (t.column(n).to_numpy() for n in ("run_id", "level", "parent", "cell", "cls", "u"))
        p = np.stack([t.column(n).to_numpy() for n in "xyz"], 1)
        chosen, gains = greedy(_runs(run, level, parent), p * np.float32(2.0) ** level[:, None].astype(np.float32), cls, PARENT_PICKS)
        gain = np.zeros(t.num_rows, np.float32)
        gain[chosen] = gains
        turn = np.full(t.num_rows, t.num_rows, np.int64)
        turn[chosen] = np.arange(len(chosen))  # steps come in order, so a smaller turn within a cell is an earlier choice
        place = _runs(run, level, parent, cell)
        order = np.lexsort((u, turn, place))
        lead = np.zeros(t.num_rows, bool)
        lead[order[np.concatenate([[True], place[order][1:] != place[order][:-1]])]] = True
        cols = [t.column(n).combine_chunks() for n in ("run_id", "level", "id", "u", "cls")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(gain), pa.array(lead)], names=[f.split()[0] for f in _SCORED.split(", ")])

    yield from _whole_groups(batches, ["run_id", "level", "parent"], work)


def located(points: DataFrame) -> DataFrame:
    """``(run_id, id, u, cls, x, y, z, cell, block)``: positions scaled to the cube of their run, with octree cells.

    Points with a null or NaN coordinate share one cell of their own; rows with a null id or run are left out. Where the
    largest coordinate is over ``2**FAR`` times what 99 % of the run stay within, those beyond it count by their
    logarithm, so that single far points leave the others their levels.
    """
    rows = points.filter(F.col("id").isNotNull() & F.col("run_id").isNotNull())
    fine = F.lit(True)
    for a in "xyz":
        fine = fine & F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))
    rows = rows.select("run_id", "id", F.coalesce(F.col("point_class").cast("int"), F.lit(-1)).alias("cls"), *[F.col(a).cast("double").alias(a) for a in "xyz"], F.coalesce(fine, F.lit(False)).alias("_fine"))
    most = F.greatest(*[F.abs(a) for a in "xyz"])
    power = F.when(F.col("_fine"), F.when(most > 0, F.ceil(F.log2(most))).otherwise(F.lit(-1100)))
    ends = rows.groupBy("run_id").agg(
        F.ceil(F.percentile(power, 0.99)).alias("_usual"), F.max(power).alias("_power"), *[f(F.when(F.col("_fine"), F.col(a))).alias(f"_{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    )  # the percentile is exact, over a few hundred different powers at most
    reach = F.pow(F.lit(2.0), F.greatest("_usual", F.lit(-1000)).cast("double"))
    ends = ends.withColumn("_reach", F.when(F.col("_power") > F.greatest("_usual", F.lit(-1000)) + FAR, reach))
    near = lambda v: F.when(F.abs(v) > F.col("_reach"), F.signum(v) * F.col("_reach") * (1 + F.log2(F.abs(v) / F.col("_reach")))).otherwise(v)
    ends = ends.withColumns({f"_{n}{a}": near(F.col(f"_{n}{a}")) for a in "xyz" for n in ("lo", "hi")})
    size = F.greatest(*[F.col(f"_hi{a}") - F.col(f"_lo{a}") for a in "xyz"])
    cube = ends.select("run_id", "_reach", *[F.col(f"_lo{a}") for a in "xyz"], F.when(size > 0, size).otherwise(F.lit(1.0)).alias("_size"))
    cube = materialise(cube, "cubes")  # one row per run, used by every read of the points
    n = 1 << DEPTH
    placed = sized_join(rows, cube, ["run_id"], "id")
    for a in "xyz":
        placed = placed.withColumn(a, F.when(F.col("_fine"), (near(F.col(a)) - F.col(f"_lo{a}")) / F.col("_size")).otherwise(F.lit(0.0)).cast("float"))
        placed = placed.withColumn(f"_i{a}", F.least(F.floor(F.col(a) * n), F.lit(n - 1)).cast("bigint"))
    for shift, mask in SPREAD:
        placed = placed.withColumns({f"_i{a}": F.col(f"_i{a}").bitwiseOR(F.shiftleft(f"_i{a}", shift)).bitwiseAND(F.lit(mask)) for a in "xyz"})
    code = F.col("_ix").bitwiseOR(F.shiftleft("_iy", 1)).bitwiseOR(F.shiftleft("_iz", 2))
    placed = placed.withColumn("cell", F.when(F.col("_fine"), code).otherwise(F.lit(NO_CELL)).cast("bigint"))
    block = F.when(F.col("cell") < 0, F.lit(NO_CELL)).otherwise(F.shiftright("cell", 3 * (DEPTH - BLOCK_LEVEL)))
    return placed.select("run_id", "id", F.xxhash64("id", F.lit(5)).alias("u"), "cls", "x", "y", "z", "cell", block.cast("int").alias("block"))


def _at_level(level: str) -> F.Column:
    """The cell of an octree level, by an expression for the level."""
    return F.when(F.col("cell") < 0, F.col("cell")).otherwise(F.expr(f"shiftright(cell, 3 * ({DEPTH} - {level}))"))


def choose_levels(counts: DataFrame, base: DataFrame, requests: DataFrame) -> DataFrame:
    """``(run_id, request_id, budget, level)``, level 0 where the request takes all points of the run.

    ``counts(run_id, cell, n)`` counts the rows in the cells of the first of STAGES, whose codes are those of DEPTH; for runs
    whose budgets these cells cannot give, the different positions of ``base`` are counted in deeper ones.
    """
    wanted = requests.filter(F.col("requested_budget") > 0).select("request_id", F.col("requested_budget").alias("budget"))
    total = counts.groupBy("run_id").agg(F.sum("n").alias("total"))
    left = total.join(broadcast_if_small(wanted))  # every request is a request of every run: the result itself has as many rows
    plan = left.filter(F.col("total") <= F.col("budget")).select("run_id", "request_id", "budget", F.lit(0).alias("level"))
    left = left.filter(F.col("total") > F.col("budget")).select("run_id", "request_id", "budget")
    placed = None
    for lo, hi in STAGES:
        if lo > STAGES[0][1]:
            if placed is None:
                runs = left.select("run_id").distinct()
                placed = materialise(sized_join(base.select("run_id", "cell", "id"), runs, ["run_id"], "id").select("run_id", "cell").distinct(), "positions")
                counts = placed.withColumn("n", F.lit(1))
            counts = counts.join(left.select("run_id").distinct(), "run_id", "left_semi")
        by_level = counts.withColumn("level", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
        cells = by_level.groupBy("run_id", "level", _at_level("level").alias("c")).agg(F.sum("n").alias("n"))
        can = cells.groupBy("run_id", "level").agg(F.sum(F.least("n", F.lit(ENOUGH))).alias("can"))
        each = can.join(left, "run_id").groupBy("run_id", "request_id", "budget").agg(F.min(F.when(F.col("can") >= F.col("budget"), F.col("level"))).alias("level"))
        each = materialise(each, "levels")
        plan = plan.unionByName(each.filter("level IS NOT NULL"))
        left = each.filter("level IS NULL").select("run_id", "request_id", "budget")
        if left.isEmpty():
            return plan
    return plan.unionByName(left.withColumn("level", F.lit(DEPTH)))


def varied_subsets(points: DataFrame, requests: DataFrame) -> DataFrame:
    """``(run_id, request_id, requested_budget, id)``: for each run and request a varied choice of that many points.

    Every class of the run and every occupied cell of the chosen level is in the subset; a run with fewer points gives
    all. Rows sent again count once. Requests with a null budget or one below 1 give nothing (the list of requests is
    short and is broadcast). Equal gains are settled by a hash of the id, so the result does not depend on the layout.
    """
    base = located(points)
    rough = 3 * (DEPTH - STAGES[0][1])
    top = F.when(F.col("cell") < 0, F.col("cell")).otherwise(F.shiftleft(F.shiftright("cell", rough), rough))
    counts = materialise(base.groupBy("run_id", top.alias("cell"), "block").agg(F.count(F.lit(1)).alias("n")), "cells")
    plan = materialise(choose_levels(counts, base, requests), "levels")
    bits = plan.groupBy("run_id").agg(F.bit_or(F.expr("shiftleft(1, level)")).alias("levels"))
    load = plan_counted(counts.groupBy("run_id", "block").agg(F.sum("n").alias("n")), ["run_id", "block"], "n")
    moved = fragment(sized_join(base, bits, ["run_id"], "id"), load, "id")
    found = materialise(moved.sortWithinPartitions("run_id", "block", "_shard", "u", "id").mapInArrow(_core_sets, _FOUND), "core-sets")

    united = found.filter("level > 0").repartition("run_id", "level", "parent").sortWithinPartitions("run_id", "level", "parent", "cell", "u", "id")
    some = plan.filter("level > 0")
    scored = materialise(sized_join(united.mapInArrow(_united, _SCORED), some, ["run_id", "level"], "id"), "scored")
    chosen = materialise(_best(scored, some), "chosen")

    everything = sized_join(found.filter("level = 0").select("run_id", "level", "id"), plan.filter("level = 0"), ["run_id", "level"], "id")
    out = everything.select("run_id", "request_id", "budget", "id").unionByName(chosen).unionByName(_fill(base, some, chosen))
    return out.select("run_id", "request_id", F.col("budget").alias("requested_budget"), "id")


def _best(scored: DataFrame, plan: DataFrame) -> DataFrame:
    """``(run_id, request_id, budget, id)``: the first of each class, the leads of the cells, then the others by gain, to the budget.

    All are ordered by one number in [0, 1), of which a histogram finds the budget, so no task ranks a whole run. Gains
    are compared to a millionth; the hash of the id decides between equal ones, as among the leads.
    """
    key = ["run_id", "request_id"]
    u = F.col("u") / F.lit(2.0**64) + 0.5
    step = F.lit(2.0**20)
    lost = (F.floor((F.lit(1.0) - F.least(F.greatest(F.col("gain").cast("double"), F.lit(0.0)), F.lit(1.0))) * step) + u) / (step + 1)
    of_class = scored.groupBy(*key, "cls").agg(F.min(lost).alias("_first"))  # a number a class, so Spark aggregates by hash
    marked = scored.join(broadcast_if_small(of_class), [*key, "cls"])
    order = F.when(lost == F.col("_first"), u / 8).when(F.col("lead"), F.lit(0.125) + u * 0.375).otherwise(F.lit(0.5) + lost / 2)
    marked = materialise(marked.select(F.concat_ws(":", *key).alias("_g"), *key, "budget", "id", F.least(order, F.lit(1 - 2.0**-40)).alias("_v")), "ordered")
    quotas = plan.select(F.concat_ws(":", *key).alias("_g"), F.col("budget").alias("quota"))
    return first_by_group(marked, quotas, F.col("_v"), "_g").select(*key, "budget", "id")


def _fill(base: DataFrame, plan: DataFrame, chosen: DataFrame) -> DataFrame:
    """What is still missing where points crowd within the cells of their level, or coincide.

    Level by level, the first point by hash of each cell that has none yet is taken, until the number is reached; a request
    starts below its own level. Only points that share a cell of the last level with a taken one, so coincide with it, are
    left to the hash alone.
    """
    added = chosen.limit(0)
    have = chosen.groupBy("run_id", "request_id").agg(F.count(F.lit(1)).alias("have"))
    short = materialise(plan.join(have, ["run_id", "request_id"], "left").withColumn("missing", F.col("budget") - F.coalesce("have", F.lit(0))).filter("missing > 0").select("run_id", "request_id", "budget", "level", "missing"), "short")
    if short.isEmpty():
        return added
    points = sized_join(base.select("run_id", "id", "u", "cell"), short.select("run_id", "request_id", "level"), ["run_id"], "id")
    points = points.groupBy("run_id", "request_id", "id", "u", "level").agg(F.min("cell").alias("cell"))
    points = materialise(points.join(chosen.select("run_id", "request_id", "id", F.lit(True).alias("_in")), ["run_id", "request_id", "id"], "left"), "crowds")
    key = ["run_id", "request_id"]
    for level in range(short.agg(F.min("level")).first()[0] + 1, DEPTH + 1):
        cells = points.filter(F.col("level") < level).groupBy(*key, _at_level(str(level)).alias("_c")).agg(F.max("_in").alias("_in"), F.min(F.struct("u", "id")).alias("_first"))
        picked = sized_join(cells.filter("_in IS NULL").select(*key, "_first.u", "_first.id"), short.select(*key, "budget", "missing"), key, "id")
        ranked = picked.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("u", "id")))
        picked = materialise(ranked.filter(F.col("_r") <= F.col("missing")).select(*key, "budget", "id"), "deeper")
        added = added.unionByName(picked)
        n = picked.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        short = materialise(short.join(n, key, "left").withColumn("missing", F.col("missing") - F.coalesce("_n", F.lit(0))).filter("missing > 0").drop("_n"), "short")
        if short.isEmpty():
            return added
        new = picked.select(*key, "id", F.lit(True).alias("_new"))
        points = points.join(short.select(*key), key, "left_semi").join(new, [*key, "id"], "left").withColumn("_in", F.coalesce("_in", "_new")).drop("_new")
        points = materialise(points, "crowds")
    rest = materialise(points.filter("_in IS NULL").select(*key, "id", "u").join(short, key), "rest")
    n = rest.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    # about twice as many as are missing come near the rank, whatever the size of the run
    near = rest.join(n, key).filter((F.col("u") / F.lit(2.0**64) + 0.5) < (2 * F.col("missing") + 50) / F.col("n"))
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("u", "id")))
    return added.unionByName(ranked.filter(F.col("_r") <= F.col("missing")).select(*key, "budget", "id"))
