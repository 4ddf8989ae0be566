"""A scene from a source: projected, classified, measured, thinned and guarded, ready for a viewer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import probe, projection, scene, validate
from plumbline.plans import scene_codec
from plumbline.plans.report import Report
from plumbline.session import broadcast_if_small, materialise
from plumbline.sources.base import Source


@dataclass(frozen=True)
class Built:
    """``points(id, x, y, z, point_class, partition_id, nk, dist_centroid)`` within the budget, and what goes with them."""

    points: DataFrame
    lod: dict
    presets: dict
    charts: dict[str, DataFrame]
    explained: tuple[float, ...]

    def encoded(self) -> bytes:
        return scene_codec.encode(scene_codec.collect(self.points, self.lod))


def findings(report: Report | None, spark) -> tuple[DataFrame, DataFrame]:
    """``(hubs(id), antihubs(id))`` that a report names."""
    detail = next((m.detail for m in report.metrics if m.id == "hub_share_top1pct"), {}) if report else {}
    frame = lambda ids: spark.createDataFrame([(int(i),) for i in ids or []], "id bigint")
    return frame(detail.get("top_offenders")), frame(detail.get("antihubs"))


def assemble(source: Source, report: Report | None = None, nk: DataFrame | None = None, budget: int | None = None, seed: int = 1337) -> Built:
    """Build the scene of ``source``.

    The projection is fitted on the live rows and applied to all, once. Classes come from the neighbour counts
    ``nk(id, n_k)`` if they are given (every hub of the top percent and every anti-hub), else from the report's lists.
    Tombstones are shown only if the source can name the deleted rows; otherwise dead rows are left out. A row whose
    vector cannot be projected has no point.
    """
    spark = source.corpus().sparkSession
    can, counts = source.capabilities(), source.counts()
    show, reason = probe.resolve_tombstone_layer(can.deleted_counts, counts.get("deleted"), can.deleted_rows)
    rows = source.corpus()
    rows = rows if show else rows.filter(~F.col("deleted"))
    p = projection.fit(rows.filter(~F.col("deleted")))
    points = projection.transform(rows, p).join(rows.select("id", "deleted", *[c for c in ("cell",) if c in rows.columns]), "id")
    if nk is not None:
        total = nk.count()
        hubs = nk.filter("n_k > 0").orderBy(F.desc("n_k"), "id").limit(-(-total // 100)).select("id")
        antihubs = nk.filter("n_k = 0").select("id")
        points = points.join(broadcast_if_small(nk.select("id", F.col("n_k").cast("int").alias("nk"))), "id", "left")
    else:
        hubs, antihubs = findings(report, spark)
        points = points.withColumn("nk", F.lit(None).cast("int"))
    points = scene.classify(points, hubs, antihubs).drop("deleted")
    points = _with_partitions(points)
    points = materialise(scene.with_centroid_distance(points).withColumn("dist_centroid", F.col("dist_centroid").cast("float")), "scene")
    probe.assert_no_fabricated_tombstones(points, show)
    available = points.count()
    room = scene.resolve_budget(budget)
    shown = materialise(scene.decimate(points, room, seed).drop("_stage"), "shown")
    n = shown.count()
    lod = {
        "requested_budget": room, "actual_count": n, "decimation_method": "none" if n == available else "voxel", "complete": n == available, "has_tombstones": show, "chunk_index": 0, "chunk_count": 1,
        "total_available": available, "tombstone_count": points.filter(F.col("point_class") == scene.CLASSES["tombstone"]).count() if show else None, "tombstone_reason": reason,
    }
    return Built(shown, lod, scene.camera_presets(shown), scene.distribution_charts(points, nk), p.explained)


def _with_partitions(points: DataFrame) -> DataFrame:
    """``partition_id`` from the cells: numbers as they are, anything else numbered in order; null where there are none."""
    if "cell" not in points.columns:
        return points.withColumn("partition_id", F.lit(None).cast("int"))
    if points.schema["cell"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return points.withColumn("partition_id", F.col("cell").cast("int")).drop("cell")
    table = validate.encode_ids(points.select(F.col("cell").cast("string").alias("key"))).select(F.col("key").alias("_key"), F.col("id").cast("int").alias("partition_id"))
    return points.join(broadcast_if_small(table), F.col("cell").cast("string") == F.col("_key"), "left").drop("_key", "cell")
