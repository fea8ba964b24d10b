"""SimHash near-duplicates: popcount embedding, grid range-join under Manhattan distance, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free, map_arrow, partitions, table
from .graphs import components

#: Words of a shingle, seed of its hash, and differing bits up to which two fingerprints are linked.
SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Rows of a grid cell that one task compares at once; a fuller cell is cut into chunks of this size, compared pair by pair.
CHUNK = 16384
#: Rows of a cell up to which all shifts of a batch are compared together.
SHIFTS = 1024
#: Lower-cases A-Z and makes white space spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text: each bit is set in over half of its shingles' XXH64 hashes.

    Words are runs without ASCII white space, A-Z lower-cased; with fewer words than a shingle the whole sequence is
    the only one; a text without words (or null) has fingerprint 0.
    """
    from xxhash import xxh64_intdigest

    raw = np.frombuffer((text or "").encode().translate(_PLAIN), np.uint8)
    inner = raw != 32
    inner[1:] |= inner[:-1].copy()  # and the one space after a word
    joined = raw[inner].tobytes().strip(b" ")
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = len(gaps) + 1
    count = max(1, n - SHINGLE + 1)
    starts = np.concatenate([[0], gaps + 1])[:count]
    stops = np.concatenate([gaps, [len(joined)]])[min(SHINGLE, n) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 15):
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)].tolist(), stops[at : at + (1 << 15)].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(found)], ["doc_id", "hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text) and fp, the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    return map_arrow(rows, _fingerprints, "doc_id long, hash long, fp long")


def embed(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments of each fingerprint, packed in place: a vector of counts from 0 to 2."""
    even = np.uint64(0x5555555555555555)
    return (fps & even) + ((fps >> np.uint64(1)) & even)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grid cells within Manhattan distance 1 of each half of a fingerprint's embedding.

    Fingerprints at 4 or fewer differing bits are at Manhattan distance 4 or less (a bit moves one count by one), so at
    2 or less in one half of the segments, and two vectors that near have a grid point at distance 1 or less of both.
    """
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for start in range(0, len(fps), 1 << 14):
            part = fps[start : start + (1 << 14)]
            packed = embed(part)
            for half in range(2):
                own = (packed >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                cells, rows = [own], [part]
                for segment in range(16):
                    shift = np.uint64(2 * segment)
                    count, step = (own >> shift) & np.uint64(3), np.uint64(1) << shift
                    up, down = count < 2, count > 0
                    cells += [own[up] + step, own[down] - step]
                    rows += [part[up], part[down]]
                cell = np.concatenate(cells) | (np.uint64(half) << np.uint64(32))
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(np.concatenate(rows).view(np.int64))], ["cell", "fp"])


def _root(labels: np.ndarray) -> np.ndarray:
    while True:
        above = labels[labels]
        if np.array_equal(above, labels):
            return labels
        labels = above


def _unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each row's smallest known fellow) after the pairs (i, j) are joined."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j = i[apart], j[apart]
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        labels = _root(labels)
    return labels


def _near_by_shifts(cell: np.ndarray, fps: np.ndarray, distance: int) -> np.ndarray:
    """Labels of rows sorted by cell, all pairs of a cell compared: row against the next, the one after, and so on."""
    labels, at, shift = np.arange(len(fps)), np.arange(len(fps)), 0
    while True:
        shift += 1
        at = at[at < len(fps) - shift]
        at = at[cell[at] == cell[at + shift]]
        if not len(at):
            return labels
        near = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= distance]
        labels = _unite(labels, near, near + shift)


def _near_in_block(fps: np.ndarray, distance: int) -> np.ndarray:
    """Labels of the rows of one full cell, compared a strip at a time."""
    labels = np.arange(len(fps))
    for start in range(0, len(fps), 64):
        strip = np.bitwise_count(fps[start : start + 64, None] ^ fps[None, start:]) <= distance
        i, j = np.nonzero(strip)
        labels = _unite(labels, i + start, j + start)
    return labels


def _links(fps: np.ndarray, labels: np.ndarray) -> pa.RecordBatch | None:
    """Each row linked to its class's first row; nothing else of a class leaves the task."""
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    if not len(moved):
        return None
    a, b = fps[moved].view(np.int64), fps[labels[moved]].view(np.int64)
    none = pa.nulls(len(moved), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.array(a), pa.array(b)], ["cell", "place", "a", "b"])


def _full(cell: int, first: int, fps: np.ndarray) -> pa.RecordBatch:
    n = len(fps)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, cell)), pa.array(np.arange(first, first + n)), pa.array(fps.view(np.int64)), pa.nulls(n, pa.int64())], ["cell", "place", "a", "b"])


def _join_cells(distance: int, chunk: int):
    """Links inside each cell of rows sorted by cell. Rows of a cell with over chunk rows are passed on, numbered."""

    def flush(cell: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        sizes = np.diff(edges)
        for k in np.flatnonzero(sizes > SHIFTS):
            part = fps[edges[k] : edges[k + 1]]
            if (found := _links(part, _near_in_block(part, distance))) is not None:
                yield found
        small = np.repeat((sizes > 1) & (sizes <= SHIFTS), sizes)
        if small.any() and (found := _links(fps[small], _near_by_shifts(cell[small], fps[small], distance))) is not None:
            yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        full, passed = None, 0  # the cell whose rows are being passed on, and how many were
        for batch in batches:
            cell = np.concatenate([held_cell, batch.column("cell").to_numpy()])
            fps = np.concatenate([held, batch.column("fp").to_numpy().view(np.uint64)])
            if full is not None:
                same = int(np.searchsorted(cell, full, side="right"))
                yield _full(full, passed, fps[:same])
                passed += same
                cell, fps = cell[same:], fps[same:]
                if not len(cell):
                    held_cell, held = cell, fps
                    continue
                full = None
            last = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            if last:
                yield from flush(cell[:last], fps[:last])
            held_cell, held = cell[last:], fps[last:]
            if len(held) > chunk:
                full, passed = int(held_cell[0]), len(held)
                yield _full(full, 0, held)
                held_cell, held = held_cell[:0], held[:0]
        if len(held):
            yield from flush(held_cell, held)

    return run


def _join_chunks(distance: int):
    """Links inside each pair of chunks; rows come sorted by pair."""

    def links(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        part = np.concatenate(held) if held else np.zeros(0, np.uint64)
        if (found := _links(part, _near_in_block(part, distance))) is not None:
            yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("cell", "i", "j")]
            fps = batch.column("a").to_numpy().view(np.uint64)
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for start, stop in zip([0, *change.tolist()], [*change.tolist(), len(fps)]):
                pair = tuple(int(c[start]) for c in columns)
                if pair != key:
                    yield from links(held)
                    key, held = pair, []
                held.append(fps[start:stop])
        yield from links(held)

    return run


_LINK = "cell long, place long, a long, b long"


def near_links(distinct: DataFrame, scratch: Scratch, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between different fingerprints whose components are those of all pairs within the distance.

    distinct has each fingerprint once, so a group of equal texts of any size is one row here. Every pair of a cell is
    compared; a class found in a cell leaves it as links to its first row. A cell with over chunk rows is never held by
    one task: its rows are numbered, cut into chunks, and each pair of chunks is a piece of work of its own.
    """
    if distance > 4:
        raise ValueError("the grid covers distances up to 4")
    cells = map_arrow(distinct.select("fp"), _cells, "cell long, fp long")
    count = partitions(distinct, mb=1)
    cells = cells.repartition(count, "cell").sortWithinPartitions("cell", "fp")
    found = scratch.save(map_arrow(cells, _join_cells(distance, chunk), _LINK), "cells")
    links = found.filter("cell is null").select("a", "b")
    full = found.filter("cell is not null")
    if full.limit(1).count():
        chunks = full.withColumn("k", F.floor(F.col("place") / chunk).cast("int"))
        last = chunks.groupBy("cell").agg(F.max("k").alias("last"))
        pairs = chunks.join(last, "cell").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
        pairs = pairs.select("cell", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), "a").repartition(count, "cell", "i", "j")
        more = scratch.save(map_arrow(pairs.sortWithinPartitions("cell", "i", "j"), _join_chunks(distance), _LINK), "chunks")
        links = links.unionByName(more.select("a", "b"))
    return links


def _classes(docs: DataFrame, distance: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(rows of fingerprints(), labels: fp, root, component_id); root is one fingerprint of the class."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(fingerprints(docs), "fingerprints")
    count = rows.count()
    distinct = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", count)
    stars = components(near_links(distinct, scratch, distance, chunk), scratch)
    members = stars.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    members = scratch.save(members.join(distinct, "fp"), "members", count)
    roots = scratch.save(members.groupBy("root").agg(F.min("least").alias("component_id")), "roots", count)
    linked = members.join(roots, "root").select("fp", "root", "component_id")
    labels = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    labels = scratch.save(labels, "labels", count)
    for old in ("cells", "chunks", "distinct", "members", "roots"):
        scratch.drop(old)
    return rows, labels


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Every document with its near-duplicate class: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at `distance` or fewer differing bits are linked, equal ones always; component_id is the smallest
    doc_id that can be reached over links, a document's own included. Null and empty texts have fingerprint zero and are
    linked like others. A null doc_id is kept and never the smallest; a class of null doc_ids alone has a null
    component_id. Rows that repeat a doc_id are classed by their own text. An empty table gives no rows; further
    columns are ignored.
    """
    rows, labels = _classes(docs, distance, chunk)
    return rows.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document of each class, with all its columns: that of the smallest doc_id, nulls last, then of the smallest text hash.

    A class keeps exactly one row whatever its ids are: rows without a doc_id, or that repeat one with another text, are
    told apart by their texts, and of rows alike in both one stays. Ids are joined and numbered in the same dealing by
    (doc_id, text hash), so a text is shuffled once.
    """
    from pyspark.sql import Window

    rows, labels = _classes(docs, distance, CHUNK)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    first = rows.join(labels, "fp").groupBy("root").agg(F.min(order).alias("first"))
    key, copy = free("row_key", docs), free("row_copy", docs)
    name = lambda doc_id, hash_: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), hash_.cast("string"))
    kept = first.select(name(F.col("first.doc_id"), F.col("first.hash")).alias(key))
    named = docs.withColumn(key, name(F.col("doc_id").cast("long"), F.xxhash64("text"))).join(kept, key, "left_semi")
    named = named.withColumn(copy, F.row_number().over(Window.partitionBy(key).orderBy(key))).filter(F.col(copy) == 1)
    return named.select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
