"""Sources that Spark reads itself: Parquet directories with an optional sidecar of index metadata.

A target is ``parquet:///path?column=vec&id=id&metric=COSINE&cell=label&deleted=deleted&fragment=part``. ``path/index.json``
may give engine, name, kind, metric and version. With cells, :meth:`TableSource.search` is an IVF search over them,
otherwise exact search.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import ivf, knn
from plumbline.operators.validate import UsageError
from plumbline.sources.base import Capabilities, Descriptor, options_of, register, vector_column


class TableSource:
    """``centroids(cell, centroid)`` are those of the time when the index was built; without them they follow the live rows.
    ``snapshot`` says that the rows cannot change while they are read."""

    def __init__(self, frame: DataFrame, location: str, options: dict[str, str], meta: dict | None = None, centroids: DataFrame | None = None, snapshot: bool = True):
        self.meta, self.options, self.location = meta or {}, options, location
        self.centroids, self.snapshot = centroids, snapshot
        self.frame = frame
        self.vec = vector_column(frame.schema, options.get("column"))
        self.id = options.get("id") or next((c for c in ("id", "vec_id", "_rowid") if c in frame.columns), None)
        if not self.id or self.id not in frame.columns:
            raise UsageError("the id column must be named")
        self.metric = (options.get("metric") or self.meta.get("metric") or "L2").upper()
        if self.metric not in ("COSINE", "L2", "DOT"):
            raise UsageError(f"unknown metric {self.metric}")
        first = frame.select(F.size(self.vec).alias("d")).filter("d > 0").first()
        self.dimension = first["d"] if first else 0

    def descriptor(self) -> Descriptor:
        kind = self.meta.get("kind") or ("IVF" if self.options.get("cell") else "FLAT")
        return Descriptor(self.meta.get("engine", "table"), self.meta.get("name", os.path.basename(self.location.rstrip("/"))), kind, self.metric, self.dimension, self.location, str(self.meta.get("version", "")))

    def capabilities(self) -> Capabilities:
        dead = bool(self.options.get("deleted"))
        return Capabilities(exact_counts=True, deleted_counts=dead, deleted_rows=dead, partitions=bool(self.options.get("cell")), filtered_search=True, search=True)

    def corpus(self) -> DataFrame:
        o = self.options
        cols = [F.col(self.id).cast("bigint").alias("id"), F.col(self.vec).alias("vec")]
        cols.append(F.coalesce(F.col(o["deleted"]), F.lit(False)).alias("deleted") if o.get("deleted") else F.lit(False).alias("deleted"))
        for name in ("cell", "fragment"):
            if o.get(name):
                cols.append(F.col(o[name]).alias(name))
        return self.frame.select(*cols)

    def payload(self, field: str) -> DataFrame:
        if field not in self.frame.columns:
            raise UsageError(f"no payload field {field}")
        return self.frame.select(F.col(self.id).cast("bigint").alias("id"), F.col(field).alias(field))

    def counts(self) -> dict:
        dead = F.coalesce(F.col("deleted"), F.lit(False)).cast("bigint")
        r = self.corpus().agg(F.count(F.lit(1)).alias("total"), F.sum(dead).alias("dead")).first()
        known = self.capabilities().deleted_counts
        return {"live": r["total"] - (r["dead"] or 0), "deleted": r["dead"] or 0 if known else None, "total": r["total"], "indexed": r["total"], "exact": True}

    def search(self, queries: DataFrame, k: int, params: dict | None = None) -> DataFrame:
        """An index's answers by its own metric: under COSINE corpus, queries and centroids are scaled to norm 1."""
        p = params or {}
        rows = self.corpus()
        if self.metric == "COSINE":
            rows, queries = ivf.normalised(rows), ivf.normalised(queries)
        if "cell" not in rows.columns:
            return knn.exact_knn(rows.filter("NOT deleted"), queries, k, self.metric, exclude_self=False)
        centroids = self.centroids if self.centroids is not None else ivf.partition_centroids(rows)
        if self.metric == "COSINE":
            centroids = ivf.normalised(centroids.withColumnRenamed("centroid", "vec")).withColumnRenamed("vec", "centroid")
        if p.get("ef_budget"):
            return ivf.ivf_tombstoned(rows, centroids, queries, k, int(p.get("nprobe", 1)), int(p["ef_budget"]), self.metric)
        return ivf.ivf_search(rows, centroids, queries, k, int(p.get("nprobe", 1)), self.metric)

    def partitions(self) -> DataFrame | None:
        from plumbline.operators.health import cell_sizes

        rows = self.corpus()
        return cell_sizes(rows) if "cell" in rows.columns else None


def sidecar(spark: SparkSession, path: str) -> dict:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/index.json")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return {}
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/index.json", wholetext=True).collect()))


def open_parquet(spark: SparkSession, uri: str) -> TableSource:
    """A folder of Parquet files, or one that was saved as an index: ``corpus``, ``centroids`` and ``index.json``."""
    path, options = options_of(uri)
    reader = spark.read.option("pathGlobFilter", options.get("glob", "*.parquet"))
    meta = sidecar(spark, path)
    if "columns" not in meta:
        return TableSource(reader.parquet(path), path, options, meta)
    frozen = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/centroids")
    there = frozen.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(frozen)
    return TableSource(reader.parquet(f"{path}/corpus"), path, meta["columns"] | {"id": "id", "column": "vec"} | options, meta, spark.read.parquet(f"{path}/centroids") if there else None)


register("parquet", open_parquet)
