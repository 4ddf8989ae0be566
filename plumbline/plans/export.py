"""What is written besides reports: kept indexes, vector files and unpacked archives. Sources themselves only read."""

from __future__ import annotations

import json
import posixpath
import tarfile
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.validate import UsageError
from plumbline.session import new_folder


def save_index(source, path: str) -> None:
    """Keep an index as a folder: corpus, the centroids its cells were made with, and what it is; ``parquet://path`` opens it again."""
    d = source.descriptor()
    rows = source.corpus()
    rows.write.parquet(f"{path}/corpus")
    if source.centroids is not None:
        source.centroids.write.parquet(f"{path}/centroids")
    meta = {"engine": d.engine, "name": d.index_name, "kind": d.index_kind, "metric": d.metric_space, "version": d.version, "columns": {c: c for c in ("deleted", "cell", "fragment") if c in rows.columns and (c != "deleted" or source.options.get("deleted"))}}
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/index.json")
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    stream.write(bytearray(json.dumps(meta, sort_keys=True).encode()))
    stream.close()


def fvecs_bytes(rows: np.ndarray) -> bytes:
    """Rows in the fvecs format."""
    rows = np.ascontiguousarray(rows, "<f4")
    out = np.empty((len(rows), rows.shape[1] + 1), "<i4")
    out[:, 0], out[:, 1:] = rows.shape[1], rows.view("<i4")
    return out.tobytes()


def write_fvecs(rows: DataFrame, path: str) -> None:
    """``(id, vec)`` of a bounded set as one .fvecs file, ordered by id; it is built on the driver."""
    t = rows.orderBy("id").select("vec").toArrow().column("vec").combine_chunks()
    x = t.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) if len(t) else np.empty((0, 0), np.float32)
    with open(path, "wb") as f:
        f.write(fvecs_bytes(x) if len(t) else b"")


def unpack(spark: SparkSession, archive: str) -> str:
    """The regular files of a local .zip, .tar, .tar.gz or .tgz in a folder that all executors share; returns the folder.

    Members that would leave the folder are refused.
    """
    folder = new_folder(spark, "archive")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def put(name: str, data) -> None:
        clean = posixpath.normpath(name)
        if clean.startswith(("/", "..")):
            raise UsageError(f"the archive holds {name}, which is outside it")
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{clean}")
        stream = at.getFileSystem(conf).create(at, True)
        try:
            while block := data.read(1 << 22):
                stream.write(bytearray(block))
        finally:
            stream.close()

    if archive.endswith(".zip"):
        with zipfile.ZipFile(archive) as z:
            for m in z.infolist():
                if not m.is_dir():
                    with z.open(m) as data:
                        put(m.filename, data)
    elif archive.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2")):
        with tarfile.open(archive) as t:
            for m in t:
                if m.isfile():
                    put(m.name, t.extractfile(m))
    else:
        raise UsageError(f"{archive} is no archive that is known")
    return folder
