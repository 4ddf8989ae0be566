"""Tables of lake formats, pinned to a version, through whatever Spark reader is installed.

``lance:///data/set.lance?column=vec&version=7`` (also a bare ``*.lance`` path or a folder that holds one), and
``delta:///path?version=3`` or ``iceberg:///catalog.db.table?version=...``. ``format`` names another reader. What an index
is like comes from ``index.json`` beside the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.validate import UsageError
from plumbline.sources.base import Capabilities, options_of, register
from plumbline.sources.engines import fragment_counts, version_in_range
from plumbline.sources.tables import TableSource, sidecar

#: The option by which a reader pins a version, and the range of library versions that is known to work.
PINS = {"lance": "version", "delta": "versionAsOf", "iceberg": "snapshot-id"}
KNOWN = {"lance": ("0.11", "12.0")}


class LakeSource(TableSource):
    """A table with fragment statistics ``(physical_rows, num_deletions)`` and partition sizes from its sidecar, where it has them."""

    def __init__(self, frame: DataFrame, location: str, options: dict[str, str], meta: dict):
        super().__init__(frame, location, options, meta)
        self.warnings: list[str] = []
        low_high = KNOWN.get(options.get("_scheme", ""))
        if low_high and meta.get("library") and not version_in_range(str(meta["library"]), *low_high):
            self.warnings.append(f"library version {meta['library']} is outside {low_high[0]} to {low_high[1]}, which is what was tried")

    def capabilities(self) -> Capabilities:
        can = super().capabilities()
        return Capabilities(**{**can.__dict__, "deleted_counts": can.deleted_counts or bool(self.meta.get("fragments")), "partitions": can.partitions or len(self.meta.get("partition_sizes") or []) > 1})

    def counts(self) -> dict:
        if not self.meta.get("fragments"):
            return super().counts()
        rows = [(f.get("physical_rows"), f.get("num_deletions")) for f in self.meta["fragments"]]
        r = fragment_counts(self.frame.sparkSession.createDataFrame(rows, "physical_rows bigint, num_deletions bigint")).first()
        return {"live": r["live"], "deleted": r["deleted"], "total": r["live"] + r["deleted"], "indexed": self.meta.get("indexed", r["live"]), "exact": True}

    def partitions(self) -> DataFrame | None:
        """Sizes as the index states them, deleted rows included; a single partition is none."""
        sizes = self.meta.get("partition_sizes")
        if not sizes:
            return super().partitions()
        if len(sizes) <= 1:
            return None
        return self.frame.sparkSession.createDataFrame(list(enumerate(int(s) for s in sizes)), "cell bigint, size bigint")

    def search(self, queries: DataFrame, k: int, params: dict | None = None) -> DataFrame:
        """``refine_factor`` asks for that many times k candidates and keeps the k nearest; probes are called nprobes here too."""
        p = dict(params or {})
        p.setdefault("nprobe", p.pop("nprobes", 1))
        wide = max(1, int(p.pop("refine_factor", 1) or 1))
        return super().search(queries, k * wide, p).filter(F.col("rank") < k)


def resolve(spark: SparkSession, path: str) -> str:
    """The data set itself: the path if it is one, else ``data.lance`` or the one ``*.lance`` child of a folder."""
    if path.rstrip("/").endswith(".lance"):
        return path.rstrip("/")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise UsageError(f"nothing is at {path}")
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".lance"))
    if "data.lance" in names:
        return f"{path.rstrip('/')}/data.lance"
    if len(names) != 1:
        raise UsageError(f"the data set must be named; found: {names}")
    return f"{path.rstrip('/')}/{names[0]}"


def opener(scheme: str):
    def open_(spark: SparkSession, uri: str) -> LakeSource:
        path, options = options_of(uri if "://" in uri else f"{scheme}://{uri}")
        if scheme == "lance":
            path = resolve(spark, path)
        kind = options.pop("format", scheme)
        reader = spark.read.format(kind)
        if kind == "parquet":
            reader = reader.option("pathGlobFilter", "*.parquet")
        version = options.pop("version", None) or options.pop("dataset_version", None)
        if version is not None:
            reader = reader.option(PINS[scheme], version)
        try:
            frame = reader.load(path)
        except Exception as e:
            raise UsageError(f"cannot read {path} as {kind}: {str(e).splitlines()[0][:200]}") from None
        meta = sidecar(spark, path)
        return LakeSource(frame, path, {**options, "_scheme": scheme}, {"engine": scheme, **meta, **({"version": version} if version is not None else {})})

    return open_


for _scheme in PINS:
    register(_scheme, opener(_scheme))
