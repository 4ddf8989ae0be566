"""File formats of public vector sets: fvecs, word vectors as text, and reports as JSON."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.validate import encode_ids
from plumbline.plans.export import unpack
from plumbline.plans.report import Report, from_json
from plumbline.session import broadcast_if_small
from plumbline.sources.base import options_of, register
from plumbline.sources.tables import TableSource


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """``(id, vec)`` of .fvecs files (each row: int32 dimension, then float32 values); ids number the rows of a file.

    A file is read by one task, so sets of many files are read in parallel; files of one set should be of moderate size.
    A row that is cut off or of another dimension raises.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                raw = np.frombuffer(data, "<i4")
                d = int(raw[0]) if len(raw) else 0
                if len(data) % 4 or (d and (d < 0 or len(raw) % (d + 1) or (raw.reshape(-1, d + 1)[:, 0] != d).any())):
                    raise ValueError(f"{name} is no whole fvecs file")
                rows = raw.reshape(-1, d + 1)[:, 1:].copy().view("<f4") if d else np.empty((0, 0), np.float32)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * d, pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(np.arange(len(rows), dtype=np.int64)), vec], names=["path", "id", "vec"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "path string, id bigint, vec array<float>").select("id", "vec")


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(token, vec)`` of text lines ``token v1 ... vd``; lines without a number after the token are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") > 1)
    vec = F.transform(F.slice("p", 2, 1_000_000), lambda x: x.cast("float"))
    return rows.filter(F.element_at("p", 2).rlike(r"^[-+]?[0-9.]")).select(F.element_at("p", 1).alias("token"), vec.alias("vec"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``(id, vec)`` of a two-dimensional .npy file."""
    import io

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content").to_pylist():
                rows = np.load(io.BytesIO(data), allow_pickle=False)
                if rows.ndim != 2:
                    raise ValueError("the array must have two dimensions")
                rows = rows.astype(np.float32)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int64)), vec], names=["id", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "id bigint, vec array<float>")


def read_report(path: str) -> Report:
    with open(path, encoding="utf-8") as f:
        return from_json(f.read())


def _words(spark: SparkSession, path: str) -> DataFrame:
    rows = read_word_vectors(spark, path)
    table = encode_ids(rows.select(F.col("token").alias("key")))
    return rows.join(broadcast_if_small(table), F.col("token") == F.col("key")).select("id", "vec", "token")


READERS = {"fvecs": read_fvecs, "npy": read_npy, "words": _words}


def _opener(scheme: str):
    def open_(spark: SparkSession, uri: str) -> TableSource:
        """``fvecs:///path``, ``npy:///path`` or ``words:///path`` with ``metric``; ``member`` is a glob inside an archive."""
        path, options = options_of(uri)
        if path.endswith((".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2")):
            path = f"{unpack(spark, path)}/{options.pop('member', '*')}"
        return TableSource(READERS[scheme](spark, path), path, {"id": "id", "column": "vec", **options}, {"engine": scheme})

    return open_


for _scheme in READERS:
    register(_scheme, _opener(_scheme))
