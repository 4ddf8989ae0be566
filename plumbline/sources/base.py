"""The contract of read-only sources and a registry by URI scheme.

A source gives DataFrames and never writes. ``corpus()`` has ``(id, vec)`` and, where known, ``deleted``, ``fragment`` and
``cell``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol, runtime_checkable
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.validate import UsageError
from plumbline.plans.redact import redact
from plumbline.session import broadcast_if_small


@dataclass(frozen=True)
class Capabilities:
    """What a source can tell; whatever it cannot makes a metric unavailable."""

    exact_counts: bool = False
    deleted_counts: bool = False
    deleted_rows: bool = False
    partitions: bool = False
    filtered_search: bool = False
    search: bool = False
    graph_stats: bool = False
    proxy_counts: bool = False


@dataclass(frozen=True)
class Descriptor:
    engine: str
    index_name: str
    index_kind: str
    metric_space: str
    dimension: int
    location: str
    version: str = ""

    def to_dict(self) -> dict:
        return {**self.__dict__, "location": redact(self.location)}


@runtime_checkable
class Source(Protocol):
    def descriptor(self) -> Descriptor: ...

    def capabilities(self) -> Capabilities: ...

    def counts(self) -> dict: ...

    def corpus(self) -> DataFrame: ...

    def payload(self, field: str) -> DataFrame: ...

    def search(self, queries: DataFrame, k: int, params: dict | None = None) -> DataFrame: ...

    def partitions(self) -> DataFrame | None: ...


Opener = Callable[[SparkSession, str], Source]
_OPENERS: dict[str, Opener] = {}


def register(scheme: str, opener: Opener) -> None:
    """Add a source for a scheme; a scheme can be taken once."""
    if scheme in _OPENERS:
        raise ValueError(f"the scheme {scheme} is taken")
    _OPENERS[scheme] = opener


def schemes() -> list[str]:
    return sorted(_OPENERS)


def open_target(spark: SparkSession, uri: str) -> Source:
    """Open a target by its scheme; a bare path is a Parquet directory. Errors do not repeat credentials."""
    from plumbline.sources import files, lake, postgres, rest, synthetic, tables  # noqa: F401 - each registers its schemes

    bare = uri.partition("?")[0].rstrip("/")
    scheme = uri.split("://", 1)[0] if "://" in uri else "lance" if bare.endswith(".lance") else "parquet"
    if scheme not in _OPENERS:
        raise UsageError(f"unknown scheme {scheme} in {redact(uri)}; known: {', '.join(schemes())}")
    try:
        source = _OPENERS[scheme](spark, uri)
        assert_read_only(source)
        return source
    except (UsageError, ConnectionError):
        raise
    except Exception as e:
        raise UsageError(f"cannot open {redact(uri)}: {redact(str(e))[:300]}") from None


def options_of(uri: str) -> tuple[str, dict[str, str]]:
    """Path and query options of a target."""
    parts = urlsplit(uri if "://" in uri else f"parquet://{uri}")
    return parts.netloc + parts.path, dict(parse_qsl(parts.query))


def vector_column(schema: T.StructType, wanted: str | None = None) -> str:
    """The one column of float arrays, or the wanted one; several or none is a usage error that names them."""
    found = [f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.FloatType | T.DoubleType)]
    if wanted:
        if wanted not in found:
            raise UsageError(f"{wanted} is no vector column; vector columns: {found}")
        return wanted
    if len(found) != 1:
        raise UsageError(f"the vector column must be named; candidates: {found}")
    return found[0]


def fetch_vectors(corpus: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    """``(place, id, vec)`` of the given ids in their order: that of a list, or of the column ``place`` of a table.

    An id that is given twice comes twice; one that the corpus lacks is a usage error. The ids meet the corpus where it is
    scanned, unless they are too many to broadcast.
    """
    if not isinstance(ids, DataFrame):
        ids = corpus.sparkSession.createDataFrame(list(enumerate(ids)), "place bigint, id bigint")
    if "place" not in ids.columns:
        ids = ids.withColumn("place", F.col("id"))
    wanted = broadcast_if_small(ids.select("place", "id"))
    found = corpus.select("id", "vec").join(broadcast_if_small(ids.select("id").distinct()), "id", "left_semi").dropDuplicates(["id"])
    missing = ids.join(found.select("id"), "id", "left_anti").limit(20).collect()
    if missing:
        raise UsageError("unknown ids", [r["id"] for r in missing])
    return found.join(wanted, "id").select("place", "id", "vec").orderBy("place")


#: Beginnings of method names that write, which no source may have.
WRITES = ("add", "alter", "append", "compact", "create", "delete", "drop", "insert", "merge", "optimize", "overwrite", "remove", "reindex", "set", "truncate", "update", "upsert", "vacuum", "write")


def assert_read_only(source: object) -> None:
    """Raise UsageError if an object that is to be used as a source offers methods that write."""
    bad = [n for n in dir(source) if not n.startswith("_") and callable(getattr(source, n, None)) and n.split("_")[0].lower() in WRITES]
    if bad:
        raise UsageError(f"a source must be read only; it has {', '.join(sorted(bad))}")
