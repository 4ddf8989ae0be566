"""Collections of a vector engine that is spoken to over HTTP, page by page.

A target is ``qdrant://host:6333/collection?vector=name&api_key=...`` (``tls=1`` for https). Page borders are listed first,
ids only; the pages with their vectors are then fetched by the tasks. Searches are sent by the tasks too.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.validate import UsageError, encode_ids
from plumbline.plans.redact import remember
from plumbline.session import broadcast_if_small, default_tasks, materialise
from plumbline.sources import engines as E
from plumbline.sources.base import Capabilities, Descriptor, register

#: Points of a page, and seconds that an answer may take.
PAGE, PATIENCE = 1_000, 60


def call(base: str, key: str | None, path: str, body: dict | None = None) -> dict:
    """The decoded answer; reading only: GET, or POST to the paths that search and scroll."""
    request = urllib.request.Request(base + path, method="POST" if body is not None else "GET")
    request.add_header("Content-Type", "application/json")
    if key:
        request.add_header("api-key", key)
    try:
        with urllib.request.urlopen(request, json.dumps(body).encode() if body is not None else None, timeout=PATIENCE) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise UsageError(f"{path}: status {e.code}") from None
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise ConnectionError(f"{path}: {e}") from None


class RestSource:
    snapshot = False

    def __init__(self, spark: SparkSession, target: E.HttpTarget, tls: bool = False):
        if target.mode != "remote":
            raise UsageError("only a running server can be opened; export embedded collections to Parquet")
        self.spark, self.target = spark, target
        remember(target.api_key)
        self.base = f"{'https' if tls else 'http'}://{target.location}"
        self.info = call(self.base, target.api_key, f"/collections/{target.collection}")["result"]
        sizes = self.info["config"]["params"]["vectors"]
        named = "size" not in sizes
        if named and target.vector_name not in sizes and len(sizes) != 1:
            raise UsageError(f"the vector must be named; vectors: {sorted(sizes)}")
        self.vector = (target.vector_name or next(iter(sizes))) if named else None
        self.space = sizes[self.vector] if named else sizes
        self._pages: list | None = None
        self._numbers: DataFrame | None = None

    def descriptor(self) -> Descriptor:
        kind = "HNSW" if self.info.get("indexed_vectors_count", 0) else "FLAT"
        return Descriptor("qdrant", self.target.collection, kind, E.metric_of_distance(self.space["distance"]), int(self.space["size"]), f"qdrant://{self.target.location}/{self.target.collection}")

    def capabilities(self) -> Capabilities:
        known = self.counts()["deleted"] is not None
        return Capabilities(exact_counts=known, deleted_counts=known, filtered_search=True, search=True)

    def counts(self) -> dict:
        """Points of the collection; deleted ones as the server's telemetry has them, unknown if it has not."""
        live = int(self.info.get("points_count") or 0)
        try:
            doc = call(self.base, self.target.api_key, "/telemetry?details_level=10")
            mine = [c for c in doc.get("result", {}).get("collections", {}).get("collections", []) if c.get("id") == self.target.collection]
            deleted = E.deleted_in_telemetry(mine or None)
        except (UsageError, ConnectionError):
            deleted = None
        return {"live": live, "deleted": deleted, "total": live + deleted if deleted is not None else None, "indexed": self.info.get("indexed_vectors_count"), "exact": deleted is not None}

    def _scroll(self, start, limit: int, vectors, payload) -> dict:
        body = {"limit": limit, "with_vector": vectors, "with_payload": payload} | ({"offset": start} if start is not None else {})
        return call(self.base, self.target.api_key, f"/collections/{self.target.collection}/points/scroll", body)["result"]

    def pages(self) -> list:
        """The first id of each page: a walk over the ids alone, one short request a page."""
        if self._pages is None:
            starts, at = [], None
            while True:
                answer = self._scroll(at, PAGE, False, False)
                if not answer["points"]:
                    break
                starts.append(answer["points"][0]["id"])
                at = answer.get("next_page_offset")
                if at is None:
                    break
            self._pages = starts
        return self._pages

    def _fetched(self, schema: str, vectors, payload, row) -> DataFrame:
        """Rows of all points, fetched by the tasks; ``row(point)`` gives the columns after the key."""
        base, key, path = self.base, self.target.api_key, f"/collections/{self.target.collection}/points/scroll"
        names = [c.split()[0] for c in schema.split(", ")]

        def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in pdf["start"]:
                    points = call(base, key, path, {"limit": PAGE, "with_vector": vectors, "with_payload": payload, "offset": json.loads(start)})["result"]["points"]
                    yield pd.DataFrame([(str(p["id"]), *row(p)) for p in points], columns=names)

        starts = self.spark.createDataFrame([(json.dumps(s),) for s in self.pages()], "start string")
        return starts.repartition(max(1, min(len(self.pages()), 4 * default_tasks(self.spark)))).mapInPandas(fetch, schema)

    def _identified(self, rows: DataFrame) -> DataFrame:
        """``key`` as ``id``: numbers as they are; names are numbered in order, after all numbers, so that the two cannot meet."""
        if all(isinstance(s, int) for s in self.pages()[-1:] + self.pages()[:1]):  # numbers come before names in a scroll
            return rows.select(F.col("key").cast("bigint").alias("id"), *[c for c in rows.columns if c != "key"])
        joined = rows.join(broadcast_if_small(self.numbers()), "key")
        return joined.select("id", *[c for c in rows.columns if c != "key"])

    def numbers(self) -> DataFrame:
        """``(key, id)`` of every point."""
        if self._numbers is None:
            keys = self._fetched("key string", False, False, lambda p: ())
            digits = keys.filter(F.col("key").rlike("^[0-9]+$")).select("key", F.col("key").cast("bigint").alias("id"))
            top = (digits.agg(F.max("id")).first()[0] or 0) + 1
            names = encode_ids(keys.filter(~F.col("key").rlike("^[0-9]+$"))).select("key", (F.col("id") + top).alias("id"))
            self._numbers = materialise(digits.unionByName(names), "keys")
        return self._numbers

    def corpus(self) -> DataFrame:
        name = self.vector
        rows = self._fetched("key string, vec array<float>", [name] if name else True, False, lambda p: (p["vector"][name] if name else p["vector"],))
        return self._identified(rows).withColumn("deleted", F.lit(False))

    def payload(self, field: str) -> DataFrame:
        rows = self._fetched("key string, value string", False, [field], lambda p: (_text((p.get("payload") or {}).get(field)),))
        return self._identified(rows).withColumnRenamed("value", field)

    def partitions(self) -> None:
        return None

    def search(self, queries: DataFrame, k: int, params: dict | None = None) -> DataFrame:
        """``(qid, rank, id, dist)``; ``params`` may have hnsw_ef, exact and filter (``{field: value}``); ``dist`` is the rank."""
        p = params or {}
        base, key, path, name = self.base, self.target.api_key, f"/collections/{self.target.collection}/points/search", self.vector
        extra: dict = {"limit": int(k), "with_payload": False, "params": {n: p[n] for n in ("hnsw_ef", "exact") if n in p}}
        if p.get("filter"):
            extra["filter"] = {"must": [{"key": f, "match": {"value": v}} for f, v in p["filter"].items()]}

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for qid, vec in zip(pdf["qid"], pdf["vec"]):
                    v = [float(x) for x in vec]
                    found = call(base, key, path, extra | {"vector": {"name": name, "vector": v} if name else v})["result"]
                    yield pd.DataFrame([(qid, r, str(f["id"])) for r, f in enumerate(found)], columns=["qid", "rank", "key"])

        found = queries.select("qid", "vec").repartition(default_tasks(self.spark)).mapInPandas(ask, "qid bigint, rank int, key string")
        return self._identified(found).select("qid", "rank", "id", F.col("rank").cast("double").alias("dist"))


def _text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def open_rest(spark: SparkSession, uri: str) -> RestSource:
    target = E.parse_http_target(uri)
    return RestSource(spark, target, "tls=1" in uri.partition("?")[2].split("&"))


register("qdrant", open_rest)
