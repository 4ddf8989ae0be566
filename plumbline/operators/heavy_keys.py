"""Per-key work without stragglers: fragment-replicate by estimated load.

The load of every key is counted with map-side combining. Keys whose load would fill a good part of a task are few by
construction (a key above ``total / (tasks * FINE)`` occurs at most ``tasks * FINE`` times), so only those are brought
to the driver. They are cut into shards in proportion to their load and bin-packed onto tasks, longest first; all other
keys are light and are spread by hash. The rows then move once, straight to the task of their shard. A matching side is
replicated only to the shards of its key.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from plumbline.session import default_tasks, materialise, small_enough

#: A key is heavy from 1/FINE of a task's fair load.
FINE = 8
#: A shard holds at most this share of a task's fair load.
SHARD = 0.5


@dataclass(frozen=True)
class LoadPlan:
    """Placement of the heavy keys. ``shards[(key values)] = [task, task, ...]``; every other key is light."""

    tasks: int
    total: int
    keys: tuple[str, ...]
    shards: dict[tuple, list[int]]

    @property
    def most_shards(self) -> int:
        return max((len(t) for t in self.shards.values()), default=1)


def pack(loads: dict[tuple, int], total: int, tasks: int) -> dict[tuple, list[int]]:
    """Cut keys into shards and place them on tasks, the largest shard first on the least loaded task.

    >>> sorted(len(t) for t in pack({("a",): 60, ("b",): 10}, 100, 5).values())
    [1, 6]
    """
    if not total:
        return {}
    fair = total / tasks
    light = max(0, total - sum(loads.values())) / tasks
    pieces = []
    for key, load in loads.items():
        n = max(1, -int(-load // (fair * SHARD)))
        pieces += [(load / n, key)] * n
    heap = [(light, t) for t in range(tasks)]
    out: dict[tuple, list[int]] = {k: [] for k in loads}
    for load, key in sorted(pieces, key=lambda p: (-p[0], str(p[1]))):
        at, task = heapq.heappop(heap)
        out[key].append(task)
        heapq.heappush(heap, (at + load, task))
    return out


def plan_load(df: DataFrame, keys: list[str], tasks: int | None = None) -> LoadPlan:
    """Estimate the load of each key by its row count and place the heavy keys.

    A null is a key value like any other. An empty table gives an empty plan.
    """
    tasks = tasks or default_tasks(df.sparkSession)
    seen = Observation()
    counts = df.observe(seen, F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_load"))
    top = counts.orderBy(F.desc("_load")).limit(tasks * FINE).collect()  # holds every key above total / (tasks * FINE)
    return _planned(top, _observed(seen, top), keys, tasks)


def plan_counted(counts: DataFrame, keys: list[str], load: str, tasks: int | None = None) -> LoadPlan:
    """The same from loads that are counted already: one row per key."""
    tasks = tasks or default_tasks(counts.sparkSession)
    seen = Observation()
    top = counts.observe(seen, F.sum(load).alias("n")).select(*keys, F.col(load).alias("_load")).orderBy(F.desc("_load")).limit(tasks * FINE).collect()
    return _planned(top, _observed(seen, top), keys, tasks)


def _observed(seen: Observation, top: list[Row]) -> int:
    """The observed total; an empty table is optimised away together with the observation."""
    return (seen.get["n"] or 0) if top else 0


def _planned(top: list[Row], total: int, keys: list[str], tasks: int) -> LoadPlan:
    loads = {tuple(r[k] for k in keys): r["_load"] for r in top if r["_load"] > total / (tasks * FINE)}
    return LoadPlan(tasks, total, tuple(keys), pack(loads, total, tasks))


def _layout(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """The placement as a table of at most ``tasks * FINE`` rows, safe to broadcast."""
    types = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name in plan.keys)
    schema = ", ".join(f"_k{i} {types[k]}" for i, k in enumerate(plan.keys)) + ", _tasks array<int>"
    return df.sparkSession.createDataFrame([(*k, t) for k, t in plan.shards.items()], schema)


def _placed(df: DataFrame, plan: LoadPlan) -> DataFrame:
    cond: Column = F.lit(True)
    for i, k in enumerate(plan.keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(F.broadcast(_layout(df, plan)), cond, "left").drop(*[f"_k{i}" for i in range(len(plan.keys))])


def fragment(df: DataFrame, plan: LoadPlan, spread_by: str) -> DataFrame:
    """Move each row to the task of its shard; adds ``_shard``, ``_task`` and ``_shards``, the number of shards of its key.

    Equal values of ``spread_by`` with equal keys share a shard, so they can be de-duplicated there.
    """
    shard = F.when(F.col("_tasks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread_by), F.size("_tasks")).cast("int"))
    task = F.when(F.col("_tasks").isNull(), F.pmod(F.hash(*plan.keys), F.lit(plan.tasks))).otherwise(F.get(F.col("_tasks"), F.col("_shard")))
    out = _placed(df, plan).withColumn("_shard", shard).withColumn("_task", task.cast("int")).withColumn("_shards", F.coalesce(F.size("_tasks"), F.lit(1))).drop("_tasks")
    return out.repartitionById(plan.tasks, F.col("_task"))


def replicate(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """The matching side: one copy of each row per shard of its key, with the same ``_shard`` and ``_task``."""
    n = F.when(F.col("_tasks").isNull(), F.lit(1)).otherwise(F.size("_tasks"))
    out = _placed(df, plan).withColumn("_shard", F.explode(F.sequence(F.lit(0), n - 1)))
    task = F.when(F.col("_tasks").isNull(), F.pmod(F.hash(*plan.keys), F.lit(plan.tasks))).otherwise(F.get(F.col("_tasks"), F.col("_shard")))
    return out.withColumn("_task", task.cast("int")).drop("_tasks").repartitionById(plan.tasks, F.col("_task"))


def key_stats(df: DataFrame, keys: list[str], id_col: str, value_col: str, plan: LoadPlan | None = None) -> DataFrame:
    """Distinct ids and the average of a value per key: ``(*keys, n_points, value_avg)``.

    Rows with a null id are left out. An id counts once per key, with its smallest value if rows disagree; a null or NaN
    value is left out of the average, which is null if no value is left. Null keys form a group of their own.
    """
    value = F.when(~F.isnan(F.col(value_col).cast("double")), F.col(value_col).cast("double"))
    rows = df.filter(F.col(id_col).isNotNull()).select(*keys, F.col(id_col).alias("_id"), value.alias("_v"))
    plan = plan or plan_load(rows, keys)
    points = fragment(rows, plan, "_id").groupBy("_task", *keys, "_shard", "_id").agg(F.min("_v").alias("_v"))
    shards = points.groupBy("_task", *keys, "_shard").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s"), F.count("_v").alias("_m"))
    return shards.groupBy(*keys).agg(F.sum("_n").alias("n_points"), (F.sum("_s") / F.nullif(F.sum("_m"), F.lit(0))).alias("value_avg"))


def fragment_replicate_join(big: DataFrame, matching: DataFrame, keys: list[str], spread_by: str, plan: LoadPlan | None = None) -> DataFrame:
    """Inner equi-join of a skewed side with a matching side that has the same key columns (nulls match nulls).

    The columns of the matching side must not clash with those of ``big`` apart from the keys.
    """
    plan = plan or plan_load(big, keys)
    left, right = fragment(big, plan, spread_by), replicate(matching, plan)
    for i, k in enumerate(keys):
        right = right.withColumnRenamed(k, f"_r{i}")
    right = right.withColumnsRenamed({"_task": "_rtask", "_shard": "_rshard"})
    cond = (F.col("_task") == F.col("_rtask")) & (F.col("_shard") == F.col("_rshard"))
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return left.join(right.hint("shuffle_hash"), cond).drop("_task", "_shard", "_shards", "_rtask", "_rshard", *[f"_r{i}" for i in range(len(keys))])


def sized_join(big: DataFrame, small: DataFrame, keys: list[str], spread_by: str) -> DataFrame:
    """Inner equi-join that broadcasts ``small`` only if its rows and bytes are counted to be few, else fragment-replicates it.

    A null key matches nothing, on either path. The keys come first, then the other columns of either side.
    """
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    order = [*keys, *[c for c in (*big.columns, *small.columns) if c not in keys]]
    big, small = big.filter(some), small.filter(some)
    joined = big.join(F.broadcast(small), keys) if small_enough(small) else fragment_replicate_join(big, small, keys, spread_by)
    return joined.select(*order)


def long_keys(points: DataFrame, fields: list[str], *others: str) -> DataFrame:
    """Unpivot key columns into ``(field_name, key_value, *others)`` in one pass; null values are kept."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("bigint").alias("key_value")) for f in fields]))
    return points.select(pairs.alias("_kv"), *others).select("_kv.field_name", "_kv.key_value", *others)


def scene_key_stats(points: DataFrame) -> DataFrame:
    """Distinct points and mean distance to the centroid per partition_id and per nk of a scene."""
    rows = long_keys(points, ["partition_id", "nk"], "id", "dist_centroid")
    return key_stats(rows, ["field_name", "key_value"], "id", "dist_centroid")


def heavy_values(points: DataFrame, share: float = 0.04) -> DataFrame:
    """Non-null key values held by more than ``share`` of all distinct points: ``(field_name, key_value)``."""
    stats = materialise(scene_key_stats(points), "key-stats")  # one row per key value, read twice below
    total = stats.groupBy("field_name").agg(F.sum("n_points").alias("_total"))  # every point once per field, null keys included
    return stats.join(F.broadcast(total), "field_name").filter(F.col("key_value").isNotNull() & (F.col("n_points") > share * F.col("_total"))).select("field_name", "key_value")


def points_above_mean(points: DataFrame) -> DataFrame:
    """Per key value, how many of its distinct points lie farther from the centroid than the key's mean."""
    rows = long_keys(points, ["partition_id", "nk"], "id", "dist_centroid").filter(F.col("id").isNotNull())
    keys = ["field_name", "key_value"]
    plan = plan_load(rows, keys)
    stats = key_stats(rows, keys, "id", "dist_centroid", plan)
    joined = fragment_replicate_join(rows, stats, keys, "id", plan)
    far = F.col("dist_centroid").cast("double") > F.col("value_avg")
    once = joined.groupBy(*keys, "id", "n_points").agg(F.max(F.coalesce(far & ~F.isnan("dist_centroid"), F.lit(False)).cast("int")).alias("_far"))
    return once.groupBy(*keys, "n_points").agg(F.sum("_far").alias("n_above"))
