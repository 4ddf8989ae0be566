"""Generated indexes as targets: ``synthetic://tombstoned?size=small`` (exact, IVF or IVF with tombstones as the scenario says)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import generate, ivf
from plumbline.operators.validate import UsageError
from plumbline.session import materialise
from plumbline.sources.base import options_of, register
from plumbline.sources.tables import TableSource


class SyntheticSource(TableSource):
    """Searches with the scenario's own parameters unless others are given; cells keep the centroids of the time before anything was done to the rows."""

    def __init__(self, name: str, frame: DataFrame, centroids: DataFrame | None):
        self.defaults = generate.SCENARIOS[name].search
        options = {"id": "id", "column": "vec", "metric": "L2"} | ({"cell": "cell"} if self.defaults else {}) | ({} if name == "capability_limited" else {"deleted": "deleted"})
        super().__init__(frame, f"synthetic://{name}", options, {"engine": "synthetic", "name": name}, centroids if self.defaults else None)

    def search(self, queries: DataFrame, k: int, params: dict | None = None) -> DataFrame:
        return super().search(queries, k, {**(self.defaults or {}), **(params or {})})


def open_synthetic(spark: SparkSession, uri: str) -> SyntheticSource:
    name, options = options_of(uri)
    name = name.strip("/")
    if name not in generate.SCENARIOS:
        raise UsageError(f"unknown scenario {name}; known: {', '.join(generate.SCENARIOS)}")
    size = options.get("size", "small")
    if size not in generate.SIZES:
        raise UsageError(f"unknown size {size}; known: {', '.join(generate.SIZES)}")
    built, rows = generate.scenario_parts(spark, name, int(options["rows"]) if "rows" in options else None, size)
    return SyntheticSource(name, rows, materialise(ivf.partition_centroids(built), "centroids"))


register("synthetic", open_synthetic)
