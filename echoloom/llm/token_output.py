"""Token ids as Parquet list columns: delta or dictionary encoding, bounded row groups, page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, in_ranges, map_arrow, partitions, prefix_sums, table

#: What the writer of the files is told: pages of few rows, so that the page index can skip; row groups of bounded size;
#: format 2 with plain dictionaries off encodes integers by deltas, and "dictionary" keeps an id dictionary per chunk.
LAYOUT = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "parquet.page.write-checksum.enabled": "true", "compression": "zstd"}
ENCODINGS = {"delta": {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}, "dictionary": {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)}}
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from echoloom.llm.pieces import encoder, slices

        encode, start, part = encoder(tokenizer), 0, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a, b in slices(batch.column("text")):
                ids = [x + end for x in encode.ids(batch.column("text").slice(a, b - a).to_pylist())]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(start + ends - counts), pa.array(counts), lists], ["doc_id", "part", "part_start", "n_tokens", "ids"])
                start += int(ends[-1])

    return run


def write_token_table(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, encoding: str = "dictionary") -> None:
    """Encode whole texts and write doc_id, part, part_start, n_tokens, ids in ascending doc_id order.

    Files follow one another in doc_id order and so do the rows in them; part is a file's place and part_start the ids
    before a document in its file, so a reader of the narrow columns alone can place every document. A null text is an
    empty one and gets the end id only; null doc_ids come first; rows that repeat a doc_id follow one another, in
    the order of their texts' hashes, over several files where they are many; an empty table gives empty files; further columns are not written.
    """
    tokenizer = tokenizer or word_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    map_arrow(in_ranges(rows, partitions(rows), "doc_id"), _encode(tokenizer, end_id), SCHEMA).write.mode("overwrite").options(**LAYOUT, **ENCODINGS[encoding]).parquet(path)


def read_token_table(spark: SparkSession, path: str, ids: bool = True, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and, unless only metadata are asked for, ids. start counts the ids of all documents before.

    The parts' totals (a row per file) come from two narrow columns; no id is decoded for them. first and last ask for the
    documents of doc_ids from one to the other, both included; the condition reaches the scan, and as files are in
    doc_id order the statistics of files, row groups and pages skip what lies outside. Rows without a doc_id come only
    where neither is given.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    before = prefix_sums(rows.select("part", "n_tokens"), "part", "n_tokens", "before")
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    found = rows.join(F.broadcast(before), "part").withColumn("start", F.col("part_start") + F.col("before"))
    return found.select("doc_id", "start", "n_tokens", *(["ids"] if ids else []))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest_token_table(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files alone."""
    return map_arrow(read_token_table(spark, path), _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("tokens")
    write_token_table(table(spark, sf_dir, "documents"), path)
    return digest_token_table(spark, path)
