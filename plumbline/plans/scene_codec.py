"""Binary form of a scene for viewers, and a JSON dump.

The display budget bounds what is encoded.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.scene import HARD_BUDGET

# Fixed values, the wire format: u32 length of the header (little endian), the header as JSON, padded with blanks so that
# prefix and header fill a multiple of 8 bytes, then the buffers in this order, each padded with zeros to a multiple of 8.
# The header names n_points, lod and buffers; a buffer has offset (after the header), byte_length, dtype and shape.
BUFFERS = {"positions": "float32", "classes": "uint8", "ids": "int64", "partition_id": "int32", "nk": "int32", "dist_centroid": "float32"}
REQUIRED = ("positions", "classes", "ids")
LOD = ("requested_budget", "actual_count", "decimation_method", "complete", "has_tombstones", "chunk_index", "chunk_count", "total_available", "tombstone_count", "tombstone_reason")
ALIGN = 8

#: Columns of a scene that a viewer may colour by, and what stands for a null.
OPTIONAL = {"partition_id": -1, "nk": -1, "dist_centroid": float("nan")}


class CodecError(ValueError):
    """Bytes that are not a whole scene."""


@dataclass(frozen=True)
class Scene:
    """Buffers by name, the level-of-detail record and whatever else a header holds."""

    buffers: dict[str, np.ndarray]
    lod: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    @property
    def n_points(self) -> int:
        return len(self.buffers["ids"])


def collect(points: DataFrame, lod: dict | None = None) -> Scene:
    """The points of a scene ordered by id; more than the hard display budget are refused.

    Optional columns that are absent or null throughout are left out.
    """
    optional = [c for c in OPTIONAL if c in points.columns]
    rows = points.select("id", "x", "y", "z", "point_class", *optional).orderBy("id").limit(HARD_BUDGET + 1).toArrow()
    if rows.num_rows > HARD_BUDGET:
        raise CodecError(f"more than {HARD_BUDGET} points")
    column = lambda c: rows.column(c).combine_chunks()
    buffers = {
        "positions": np.stack([column(a).to_numpy(zero_copy_only=False) for a in "xyz"], axis=1).astype(np.float32).reshape(-1, 3),
        "classes": column("point_class").to_numpy(zero_copy_only=False).astype(np.uint8), "ids": column("id").to_numpy(zero_copy_only=False).astype(np.int64),
    }
    for c in optional:
        if column(c).null_count < rows.num_rows:
            buffers[c] = column(c).fill_null(OPTIONAL[c]).to_numpy(zero_copy_only=False).astype(BUFFERS[c])
    return Scene(buffers, {"actual_count": rows.num_rows, **(lod or {})})


def _padded(data: bytes, fill: bytes, before: int = 0) -> bytes:
    return data + fill * (-(before + len(data)) % ALIGN)


def encode(scene: Scene) -> bytes:
    table, body = {}, bytearray()
    for name, kind in BUFFERS.items():
        if name in scene.buffers:
            a = np.ascontiguousarray(scene.buffers[name], np.dtype(kind).newbyteorder("<"))
            table[name] = {"offset": len(body), "byte_length": a.nbytes, "dtype": kind, "shape": list(a.shape)}
            body += _padded(a.tobytes(), b"\0")
    lod = {k: scene.lod.get(k) for k in LOD}
    header = json.dumps({**scene.extra, "n_points": scene.n_points, "lod": lod, "buffers": table}, separators=(",", ":")).encode()
    header = _padded(header, b" ", struct.calcsize("<I"))
    return struct.pack("<I", len(header)) + header + bytes(body)


def decode(data: bytes) -> Scene:
    """The scene of a whole message; anything else raises CodecError."""
    start = struct.calcsize("<I")
    if len(data) < start or len(data) < start + (n := struct.unpack_from("<I", data)[0]):
        raise CodecError("the header is cut off")
    try:
        header = json.loads(data[start : start + n])
        points, table = header.pop("n_points"), header.pop("buffers")
        lod = header.pop("lod")
        if not isinstance(points, int) or any(name not in table for name in REQUIRED):
            raise CodecError("the header names too little")
        buffers = {name: _buffer(data, start + n, name, table[name], points) for name in table if name in BUFFERS}
    except (KeyError, TypeError, ValueError, AttributeError) as e:
        raise e if isinstance(e, CodecError) else CodecError("the header is damaged") from e
    return Scene(buffers, lod, header)


def _buffer(data: bytes, at: int, name: str, entry: dict, points: int) -> np.ndarray:
    kind = np.dtype(BUFFERS[name]).newbyteorder("<")
    shape = tuple(entry["shape"])
    if entry["dtype"] != BUFFERS[name] or shape != ((points, 3) if name == "positions" else (points,)):
        raise CodecError(f"the buffer {name} has another type or shape")
    count = int(np.prod(shape))
    offset, length = entry["offset"], entry["byte_length"]
    if offset < 0 or length != count * kind.itemsize or at + offset + length > len(data):
        raise CodecError(f"the buffer {name} is cut off")
    return np.frombuffer(data, kind, count, at + offset).reshape(shape)


def to_json_lines(points: DataFrame) -> DataFrame:
    """One JSON object a point, for debugging."""
    columns = [c for c in ("id", "x", "y", "z", "point_class", *OPTIONAL) if c in points.columns]
    return points.select(F.to_json(F.struct(*columns)).alias("value"))
