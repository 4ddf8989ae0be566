"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Short texts are encoded as they are, in Arrow batches and without a shuffle. A long text is cut into halves until every
leaf is short; the leaves are encoded in parallel and joined in a tree. Where a cut lies between a word and a single
space, no token can span it and the join is plain concatenation. Elsewhere the join starts from the last piece of the
left half and scans on until its piece boundaries meet those of the right half; within a piece that spans the join,
growing windows of tokens around it are re-encoded until both sides agree. The result equals encoding the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: where the vocabulary files of the public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the published pre-tokenization pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which a text is cut into leaves.
LONG = 16_384
#: Bytes from which a single piece is encoded by halves.
LONG_PIECE = 4_096
#: Tokens on each side that must agree before a join is accepted.
AGREE = 4

_scan = regex.compile(PATTERN)
_safe = regex.compile(r"(?<=\S) (?=\S)")
_ready: dict[int, Encoder] = {}


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    """The vocabulary file of a byte-level tokenizer as ranks; under 1 MB, so it travels with the tasks."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


class Part(NamedTuple):
    """A text encoded on its own: where its pieces start, how many ids each has, and the ids."""

    text: str
    starts: list[int]
    counts: list[int]
    ids: list[int]


class Encoder:
    def __init__(self, ranks_file: bytes):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks_file.splitlines() if line)}
        self._bytes = {rank: token for token, rank in ranks.items()}
        self._bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._single = self._bpe._core_bpe.encode_single_piece

    @classmethod
    def of(cls, ranks_file: bytes) -> Encoder:
        """One encoder per Python worker."""
        key = hash(ranks_file)
        if key not in _ready:
            _ready[key] = cls(ranks_file)
        return _ready[key]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; a null or empty text has none. Special tokens in the text are ordinary text."""
        return self._bpe.encode_ordinary(text) if text else []

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece; a long piece by halves."""
        if len(data) <= LONG_PIECE:
            return self._single(data)
        half = len(data) // 2
        return self.join_ids(self.piece(data[:half]), self.piece(data[half:]))

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of two stretches of one piece."""
        w = 4 * AGREE
        while True:
            a, b = left[-w:], right[:w]
            new = self._single(b"".join(self._bytes[i] for i in a + b))
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if (whole_left or new[:AGREE] == a[:AGREE]) and (whole_right or new[-AGREE:] == b[-AGREE:]):
                return left[: len(left) - len(a)] + new + right[len(b) :]
            w *= 2

    def part(self, text: str) -> Part:
        starts, counts, ids = [], [], []
        for m in _scan.finditer(text):
            new = self.piece(m.group().encode())
            starts.append(m.start())
            counts.append(len(new))
            ids += new
        return Part(text, starts, counts, ids)

    def join(self, a: Part, b: Part) -> Part:
        """The concatenation of two texts, encoded on its own."""
        if not a.text or not b.text:
            return a if a.text else b
        text, cut = a.text + b.text, len(a.text)
        at = a.starts[-1]  # all pieces of a but the last stand: none of them reached the end of a
        known = {cut + s: i for i, s in enumerate(b.starts)}
        starts, counts, ids = [], [], []
        tail = a.ids[len(a.ids) - a.counts[-1] :]
        head_end = cut + (b.starts[1] if len(b.starts) > 1 else len(b.text))
        while at < len(text) and (at < cut or at not in known):
            m = _scan.match(text, at)
            if at == a.starts[-1] and m.end() == head_end:  # one piece over the join: its halves are encoded already
                new = self.join_ids(tail, b.ids[: b.counts[0]])
            elif at == a.starts[-1] and m.end() == cut:
                new = tail
            else:
                new = self.piece(m.group().encode())
            starts.append(at)
            counts.append(len(new))
            ids += new
            at = m.end()
        i = known.get(at, len(b.starts))
        skip = sum(b.counts[:i])
        return Part(text, a.starts[:-1] + starts + [cut + s for s in b.starts[i:]], a.counts[:-1] + counts + b.counts[i:], a.ids[: len(a.ids) - a.counts[-1]] + ids + b.ids[skip:])

    def tree(self, parts: list[Part]) -> Part:
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]


def halves(text: str, size: int = LONG) -> list[tuple[str, bool]]:
    """Leaves of at most about ``size`` characters, each with whether its end is a safe cut."""
    if len(text) <= size:
        return [(text, True)]
    half = len(text) // 2
    safe = _safe.search(text, half, min(len(text), half + size // 8))
    cut = safe.start() if safe else half
    left, right = halves(text[:cut], size), halves(text[cut:], size)
    return [*left[:-1], (left[-1][0], bool(safe)), *right]


_IDS = pa.list_(pa.int32())


def encode_texts(documents: DataFrame, ranks_file: bytes, key: str = "doc_id", text: str = "text", long: int = LONG) -> DataFrame:
    """``(key, ids)``: one row per row of ``documents``, repeated rows included.

    Null and empty texts have an empty list; blank texts are encoded like any other. A null key stays null. Other
    columns of any name are ignored.
    """
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(ranks_file)
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = documents.schema[key].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(held.value)
        for b in batches:
            ids = [enc.encode(t) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(ids, type=_IDS)], names=["k", "ids"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t, h in zip(pdf["k"], pdf["t"], pdf["h"]):
                leaves = halves(t, long)
                out += [(k, h, len(t), i, len(leaves), leaf, safe) for i, (leaf, safe) in enumerate(leaves)]
            yield pd.DataFrame(out, columns=["k", "h", "size", "no", "n", "leaf", "safe"])

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder.of(held.value)
        for pdf in batches:
            parts = [enc.part(t) for t in pdf["leaf"]]
            yield pdf.assign(starts=[p.starts for p in parts], counts=[p.counts for p in parts], ids=[p.ids for p in parts])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = Encoder.of(held.value)
        pdf = pdf.sort_values("no")
        copies = len(pdf) // int(pdf["n"].iloc[0])  # equal rows under one key share their leaves
        runs: list[list[Part]] = [[]]
        for r in pdf.iloc[::copies].itertuples():
            runs[-1].append(Part(r.leaf, [int(x) for x in r.starts], [int(x) for x in r.counts], [int(x) for x in r.ids]))
            if r.safe:
                runs.append([])
        ids = [i for run in runs if run for i in enc.tree(run).ids]
        return pd.DataFrame({"k": [pdf["k"].iloc[0]] * copies, "ids": [ids] * copies})

    out = f"k {kind}, ids array<int>"
    plain = rows.filter(F.col("t").isNull() | (F.length("t") <= long)).mapInArrow(short, out)
    leaves = rows.filter(F.length("t") > long).withColumn("h", F.md5("t")).mapInPandas(cut, f"k {kind}, h string, size int, no int, n int, leaf string, safe boolean")
    spread = leaves.repartition("k", "h", "no").mapInPandas(leaf, leaves.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", starts array<int>, counts array<int>, ids array<int>")
    joined = spread.groupBy("k", "h", "size").applyInPandas(grow, out)
    return plain.unionByName(joined).withColumnRenamed("k", key)


def count_tokens(documents: DataFrame, ranks_file: bytes, keep: list[str], text: str = "text", long: int = LONG) -> DataFrame:
    """``documents`` reduced to ``keep`` and ``n_tokens``; null and empty texts have 0. The ids of short texts do not leave the
    Python workers; long texts are encoded in parallel by the tree, each different one once."""
    held = documents.sparkSession.sparkContext.broadcast(ranks_file)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(held.value)
        for b in batches:
            n = pa.array([len(enc.encode(t)) for t in b.column(b.num_columns - 1).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    rows = documents.select(*keep, F.col(text).alias("_text"))
    schema = rows.select(*keep, F.lit(0).cast("bigint").alias("n_tokens")).schema
    short = rows.filter(F.col("_text").isNull() | (F.length("_text") <= long)).mapInArrow(count, schema)
    lengthy = rows.filter(F.length("_text") > long).withColumn("_h", F.md5("_text"))
    each = encode_texts(lengthy.groupBy("_h").agg(F.first("_text").alias("_text")), ranks_file, "_h", "_text", long)
    counted = lengthy.drop("_text").join(each.select("_h", F.size("ids").cast("bigint").alias("n_tokens")), "_h")
    return short.unionByName(counted.select(*keep, "n_tokens"))
