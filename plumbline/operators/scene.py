"""Scenes: points of a corpus in the cube [-1, 1], thinned for display, coloured and framed.

``scene(id, x, y, z, point_class, partition_id, nk, dist_centroid)``; the attributes may be missing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.vectors import min_max, voxel_key
from plumbline.operators.sampling import first_by, keyed_hash
from plumbline.session import broadcast_if_small

#: Classes of points and those that are always shown.
CLASSES = {"ordinary": 0, "hub": 1, "antihub": 2, "tombstone": 3, "query": 4, "true_neighbour": 5, "returned": 6, "missed": 7}
PRIORITY = (1, 2, 4, 5, 6, 7)
#: Display budgets and chunk sizes.
DEFAULT_BUDGET, HARD_BUDGET, COARSE, REFINE = 200_000, 1_000_000, 50_000, 100_000
OVERSAMPLE, GRID_MIN, GRID_MAX = 8, 8, 256


def grid_for(target: int) -> int:
    """Cells a side of the thinning grid for a number of points."""
    return max(GRID_MIN, min(GRID_MAX, round((max(1, target) * OVERSAMPLE) ** (1 / 3))))


def resolve_budget(requested: int | None, device_max: int | None = None) -> int:
    """Points to show: the wish, never above what the device or the hard limit allows."""
    want = DEFAULT_BUDGET if requested is None or requested <= 0 else requested
    return min(want, HARD_BUDGET, device_max or HARD_BUDGET)


def plan_chunks(total: int, budget: int, coarse: int | None = None, refine: int | None = None) -> list[int]:
    """Sizes of the chunks that a scene is sent in: a coarse one, then refinements."""
    left, sizes = min(total, budget), []
    while left > 0:
        size = min(left, (refine or REFINE) if sizes else (coarse or COARSE))
        sizes.append(size)
        left -= size
    return sizes


def decimate(scene: DataFrame, budget: int, seed: int = 1337) -> DataFrame:
    """At most ``budget`` points: the priority classes, one point per occupied voxel, then a hash-ordered fill.

    Adds ``_stage`` (0 priority, 1 voxel, 2 fill). If the priority points alone exceed the budget, a hash-ordered part of
    them is taken; if all points fit, all are. Points with unusable coordinates count as one voxel. A budget of 0 or less
    gives none. Nothing is ranked over the whole scene: only the part that fills the budget is, by its hash.
    """
    if budget <= 0:
        return scene.withColumn("_stage", F.lit(0)).limit(0)
    staged = scene.withColumn("_stage", F.when(F.col("point_class").isin(*PRIORITY), 0).otherwise(1))
    n = {r["_stage"]: r["count"] for r in staged.groupBy("_stage").count().collect()}
    if sum(n.values()) <= budget:
        return staged
    u = keyed_hash(seed, "scene")
    priority, ordinary = staged.filter("_stage = 0"), staged.filter("_stage = 1")
    if n.get(0, 0) >= budget:
        return first_by(priority, budget, u)
    left = budget - n.get(0, 0)
    key = voxel_key(F.col("x"), F.col("y"), F.col("z"), grid_for(left))
    reps = ordinary.withColumn("_v", F.coalesce(key, F.lit(-1))).groupBy("_v").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("_rep"))
    marked = ordinary.join(reps, "id", "left").withColumn("_stage", F.when(F.col("_rep"), 1).otherwise(2)).drop("_rep")
    n_reps = reps.count()
    if n_reps >= left:
        return priority.unionByName(first_by(marked.filter("_stage = 1"), left, u))
    return priority.unionByName(marked.filter("_stage = 1")).unionByName(first_by(marked.filter("_stage = 2"), left - n_reps, u))


def chunk(scene: DataFrame, budget: int, index: int, seed: int = 1337, coarse: int | None = None, refine: int | None = None) -> DataFrame:
    """One chunk of a scene that is sent in order of stage and hash; chunks are disjoint and make up the decimated scene.

    The ranking runs over the decimated scene, which the display budget bounds.
    """
    shown = decimate(scene, min(budget, HARD_BUDGET), seed)
    sizes = plan_chunks(scene.count(), min(budget, HARD_BUDGET), coarse, refine)
    if not 0 <= index < len(sizes):
        raise ValueError(f"chunk {index} of {len(sizes)}")
    start = sum(sizes[:index])
    r = F.row_number().over(Window.orderBy("_stage", keyed_hash(seed, "scene"), "id"))
    return shown.withColumn("_r", r).filter((F.col("_r") > start) & (F.col("_r") <= start + sizes[index])).drop("_r", "_stage")


def classify(points: DataFrame, hubs: DataFrame, antihubs: DataFrame) -> DataFrame:
    """``point_class`` from tables of ids of any length: tombstone before hub before anti-hub, else ordinary.

    A null ``deleted`` counts as live; an id may be listed more than once.
    """
    marks = hubs.select("id", F.lit(CLASSES["hub"]).alias("_m")).unionByName(antihubs.select("id", F.lit(CLASSES["antihub"]).alias("_m")))
    marks = marks.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("_m").alias("_m"))
    cls = F.when(F.col("deleted"), CLASSES["tombstone"]).otherwise(F.coalesce("_m", F.lit(CLASSES["ordinary"])))
    return points.join(broadcast_if_small(marks), "id", "left").withColumn("point_class", cls.cast("tinyint")).drop("_m")


def with_centroid_distance(scene: DataFrame) -> DataFrame:
    """Distance of each point to the mean position; null for points with unusable coordinates."""
    use = lambda a: F.when(~F.isnan(a), F.col(a))
    c = scene.agg(*[F.avg(use(a)).alias(a) for a in "xyz"]).first()
    d = sum(((use(a) - F.lit(c[a])) * (use(a) - F.lit(c[a])) for a in "xyz"), F.lit(0.0))
    return scene.withColumn("dist_centroid", F.sqrt(d))


def colour_attribute(scene: DataFrame, by: str) -> tuple[DataFrame, str | None]:
    """``(id, value)`` with the attribute scaled to [0, 1], and the reason if it is not there.

    ``by`` is point_class, partition_id, nk or dist_centroid; nulls stay null, and equal values are all 0.
    """
    if by not in ("point_class", "partition_id", "nk", "dist_centroid"):
        raise ValueError(f"unknown attribute {by}")
    if by not in scene.columns:
        return scene.select("id", F.lit(None).cast("double").alias("value")), f"{by} is UNAVAILABLE for this target"
    v = F.col(by).cast("double")
    low, high = scene.agg(F.min(v), F.max(v)).first()
    return scene.select("id", min_max(v, F.lit(low), F.lit(high)).alias("value")), None


def worst_partition(scene: DataFrame) -> DataFrame:
    """One row ``(partition_id, n)``: the partition with most points, the lowest id of equal ones."""
    n = scene.filter(F.col("partition_id").isNotNull()).groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "partition_id").limit(1)


def distribution_charts(scene: DataFrame, nk: DataFrame | None = None) -> dict[str, DataFrame]:
    """Histograms for charts: partition sizes and, if known, N_k."""
    from plumbline.operators.hubness import histogram

    charts = {}
    if "partition_id" in scene.columns:
        charts["partition_sizes"] = histogram(scene.filter("partition_id IS NOT NULL").groupBy("partition_id").agg(F.count(F.lit(1)).alias("n")), "n")
    if nk is not None:
        charts["nk"] = histogram(nk, "n_k")
    return charts


# --- camera ---------------------------------------------------------------------------------------------------------

FOV, MARGIN, MIN_RADIUS = 45.0, 1.25, 0.15
#: What each preset looks at, from where, and what it says.
PRESETS = {
    "overview": ((1.0, 0.8, 1.0), "The whole index", "the scene contains no points"),
    "hub_cluster": ((0.6, 0.4, 1.0), "Hubs that turn up in too many lists", "no hubs were found in this scene"),
    "antihub_periphery": ((-1.0, 0.6, 0.8), "Points that nobody finds", "no anti-hubs were found in this scene"),
    "worst_partition": ((1.0, 0.3, -0.8), "The largest partition", "partition data is UNAVAILABLE for this target"),
}


@dataclass(frozen=True)
class Preset:
    name: str
    position: tuple[float, float, float]
    target: tuple[float, float, float]
    caption: str
    reason: str | None = None

    @property
    def available(self) -> bool:
        return self.reason is None


def camera_presets(scene: DataFrame, fov: float = FOV) -> dict[str, Preset]:
    """Camera presets from aggregates of the scene: centre and radius of what each looks at, in one pass."""
    worst = worst_partition(scene).first() if "partition_id" in scene.columns else None
    which = {
        "overview": F.lit(True), "hub_cluster": F.col("point_class") == CLASSES["hub"], "antihub_periphery": F.col("point_class") == CLASSES["antihub"],
        "worst_partition": (F.col("partition_id") == worst["partition_id"]) if worst else F.lit(False),
    }
    fine = scene.filter(" AND ".join(f"{a} IS NOT NULL AND NOT isnan({a})" for a in "xyz"))
    centre = fine.agg(*[F.avg(F.when(c, F.col(a))).alias(f"{n}_{a}") for n, c in which.items() for a in "xyz"]).first()
    out, radius_of = {}, []
    for n, c in which.items():
        if centre[f"{n}_x"] is not None:
            d2 = sum(((F.col(a) - centre[f"{n}_{a}"]) ** 2 for a in "xyz"), F.lit(0.0))
            radius_of.append(F.max(F.when(c, F.sqrt(d2))).alias(n))
    radii = fine.agg(*radius_of).first() if radius_of else {}
    for n, (direction, caption, missing) in PRESETS.items():
        if centre[f"{n}_x"] is None:
            out[n] = Preset(n, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), caption, missing)
            continue
        target = tuple(centre[f"{n}_{a}"] for a in "xyz")
        away = max(MIN_RADIUS, radii[n]) / math.tan(math.radians(fov) / 2) * MARGIN
        length = math.sqrt(sum(v * v for v in direction))
        out[n] = Preset(n, tuple(t + away * v / length for t, v in zip(target, direction)), target, caption)
    return out


def tour_frames(presets: dict[str, Preset], fps: int = 30, fly: float = 1.6, hold: float = 2.4) -> list[dict]:
    """Frames of a tour over the available presets: eased flights with stops, the first without a flight."""
    stops = [p for p in presets.values() if p.available]
    if fps < 1 or not stops:
        raise ValueError("a tour needs a frame rate of 1 or more and an available preset")
    frames, last = [], stops[0]
    for i, stop in enumerate(stops):
        n_fly = round(fly * fps) if i else 0
        for j in range(n_fly + round(hold * fps)):
            t = min(1.0, (j + 1) / n_fly) if j < n_fly else 1.0
            t = t * t * (3 - 2 * t)
            mix = lambda a, b: tuple(x + (y - x) * t for x, y in zip(a, b))  # noqa: B023, E731
            frames.append({"seconds": len(frames) / fps, "eye": mix(last.position, stop.position), "look_at": mix(last.target, stop.target), "stop": stop.name, "text": stop.caption, "arrived": j >= n_fly})
        last = stop
    return frames
