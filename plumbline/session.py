"""Session-level helpers: the shared work folder, materialised cuts and size-checked broadcasts.

Lineage is cut with Parquet tables in the folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor costs a re-read and never the result.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows and most bytes, as the values take them, of a side that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Most rows of narrow columns that are kept as a local relation instead of being written.
SETTLED_ROWS = 100_000

_local_root: str | None = None
_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster.

    Where ``spark.checkpoint.dir`` is unset, a master on this machine alone gets a temporary folder; a cluster is refused,
    since its executors would not see that folder.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(_local_root)
    return _local_root


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context, unless their search path has it already."""
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="plumbline-code-")  # the driver hands the file out as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"{folder}/plumbline-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted((root / "plumbline").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(name)


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder of our own below the shared one; it is removed when the process ends."""
    path = f"{shared_root(spark)}/plumbline/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_folder` through the Hadoop file system, whatever its scheme."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        try:
            drop_folder(spark, path)
        except Exception:  # noqa: BLE001 - the context may be gone already
            pass


def materialise(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: a cut that survives executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Evaluate ``df`` once: up to SETTLED_ROWS rows of fixed-width columns become a local relation, all else is written."""
    if all(isinstance(f.dataType, T.NumericType | T.BooleanType | T.TimestampType | T.DateType) for f in df.schema.fields):
        rows = df.limit(SETTLED_ROWS + 1).toArrow()
        if rows.num_rows <= SETTLED_ROWS:
            return df.sparkSession.createDataFrame(rows, df.schema)
    return materialise(df, label)


def _width(kind: T.DataType, c: Column) -> Column:
    """Bytes that a value takes, about."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType | T.MapType):
            return F.coalesce(F.aggregate(c, F.lit(16).cast("bigint"), lambda s, x: s + _width(kind.elementType, x)), F.lit(16))
        return F.greatest(F.size(c), F.lit(0)) * 8 + 16
    if isinstance(kind, T.MapType):
        return F.greatest(F.size(c), F.lit(0)) * 64 + 16
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, c.getField(f.name)) for f in kind.fields), F.lit(8))
    return F.lit(8)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table may be broadcast: its rows and bytes are counted, no further than the bound."""
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    width = sum((_width(f.dataType, F.col(quoted(f.name))) for f in df.schema.fields), F.lit(0))
    r = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width.cast("bigint")), F.lit(0)).alias("b")).first()
    return r["n"] <= rows and r["b"] <= size


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small, else as it is: Spark then shuffles for the join."""
    return F.broadcast(df) if small_enough(df) else df


def rows_up_to(df: DataFrame, bound: int) -> int:
    """Row count, counted no further than ``bound + 1``."""
    return df.limit(bound + 1).count()


def default_tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hash_unit(*parts: Column | str) -> Column:
    """Uniform number in [0, 1) from the md5 of the parts joined by ':'; 52 bits, the same in any SQL engine.

    A null part makes the result null.
    """
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = cols[0].cast("string")
    for c in cols[1:]:
        text = F.concat(text, F.lit(":"), c.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))
