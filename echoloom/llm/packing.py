"""Sequence packing along a Hilbert curve over hashed document vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, in_ranges, map_arrow, partitions, prefix_sums, table

#: Tokens of a sequence; hashed features of a document; dimensions of the curve and bits of each.
LENGTH, FEATURES, DIMENSIONS, BITS = 2048, 512, 4, 8
#: Bytes hashed at a time.
BLOCK = 1 << 20
_SEED = 20_240_607


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _projection() -> np.ndarray:
    return np.random.default_rng(_SEED).choice([-1.0, 1.0], (FEATURES, DIMENSIONS))


def document_vector(text: str | None) -> np.ndarray:
    """Counts of a text's hashed runs of 4 bytes over the whole text, scaled to unit length; zeros for a short one."""
    raw = (text or "").encode()
    counts = np.zeros(FEATURES)
    for start in range(0, max(0, len(raw) - 3), BLOCK):
        runs = np.ndarray(min(BLOCK, len(raw) - 3 - start), "<u4", raw, start, (1,))  # the four bytes from each byte on
        counts += np.bincount((runs * np.uint32(2654435761)) >> np.uint32(23), minlength=FEATURES)
    norm = np.sqrt(counts @ counts)
    return counts / norm if norm else counts


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of rows of grid coordinates (below 2**bits), by Skilling's transform (2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(set_, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    projection = _projection()
    for batch in batches:
        vectors = np.array([document_vector(t.as_py()) for t in batch.column("text")]).reshape(-1, FEATURES)
        # a common direction holds most of every count vector; the logistic curve spreads what is left over the grid
        low = (vectors - vectors.sum(1, keepdims=True) / FEATURES) @ projection
        grid = np.minimum((1 << BITS) - 1, ((1 << BITS) / (1 + np.exp(-3.0 * low))).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(hilbert_keys(grid))], ["doc_id", "text", "curve"])


def curve_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text and curve: the place of a document's projected vector on the Hilbert curve."""
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), _keys, "doc_id long, text string, curve long")


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from echoloom.llm.pieces import encoder, slices

        encode, start, part = encoder(tokenizer), 0, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        narrow = encode.size <= 1 << 16 and end_id < 1 << 16
        for batch in batches:
            for a, b in slices(batch.column("text")):
                ids = [x + end for x in encode.ids(batch.column("text").slice(a, b - a).to_pylist())]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(counts)
                if narrow:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(start + ends - counts), pa.array(counts), pa.array(ids, pa.binary())], ["doc_id", "part", "part_start", "doc_tokens", "ids"])
                start += int(ends[-1])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, at, count, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "doc_tokens", "ids"))):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * count else "<u4").astype("<u4", copy=False)
                start = 0
                while start < count:
                    sequence, offset = divmod(at + start, length)
                    n = min(length - offset, count - start)
                    out.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), count, sequence, offset))
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_along_curve(docs: DataFrame, scratch: Scratch, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Documents encoded in curve order: doc_id, at (tokens of all documents before it on the curve), doc_tokens, ids.

    Rows are dealt to tasks by ranges of (curve, doc_id, hash of text, place), so equal documents, however many and
    whatever their ids, are spread.
    """
    rows = in_ranges(curve_keys(docs), partitions(docs), "curve", "doc_id")
    rows = map_arrow(rows.select("doc_id", "text"), _encode(tokenizer or byte_vocabulary(), end_id), "doc_id long, part int, part_start long, doc_tokens long, ids binary")
    rows = scratch.save(rows, "encoded", compression="zstd")
    before = prefix_sums(rows.select("part", "doc_tokens"), "part", "doc_tokens", "before")  # a row per task
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("part_start") + F.col("before")).alias("at"), "doc_tokens", "ids")


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Neighbours along the curve share sequences. Documents follow one another without gaps and are cut where a sequence
    is full, so only the last sequence of all needs padding. A null or empty text is its end id; null doc_ids are kept;
    repeated rows are packed as often as they come; an empty table gives no pieces; further columns are ignored.
    """
    return map_arrow(encode_along_curve(docs, Scratch(docs.sparkSession), tokenizer, end_id), _cut(length), PIECE)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
