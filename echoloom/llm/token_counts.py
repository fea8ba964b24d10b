"""Token counts of a document's sections, from one encoding of the whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table
from .packing import byte_vocabulary

#: Rules that allocate a token whose characters lie in two or more sections.
RULES = ("first", "last", "most")


def sections(text: str) -> np.ndarray:
    """Half-open character spans of a text's lines, each with its line break; an empty text is one line of no characters."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    ends = np.array(ends, np.int64)
    return np.stack([np.concatenate([[0], ends[:-1]]), ends], 1)


def allocate(spans: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, those of them that cross a boundary) for sorted adjoining spans and token characters.

    An interval join of two sorted lists: a token meets the sections from that of its first character to that of its
    last. It counts once: in the first, in the last, or in the one with most of its characters (ties: the first).
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {', '.join(RULES)}")
    ends = spans[:, 1]
    low = np.searchsorted(ends, first, side="right")
    high = np.searchsorted(ends, last - 1, side="right")
    owner = {"first": low, "last": high, "most": low.copy()}[rule]
    if rule == "most":
        for k in np.flatnonzero(high > low):
            shares = np.minimum(ends[low[k] : high[k] + 1], last[k]) - np.maximum(spans[low[k] : high[k] + 1, 0], first[k])
            owner[k] = low[k] + int(np.argmax(shares))
    return np.bincount(owner, minlength=len(spans)), np.bincount(owner[high > low], minlength=len(spans))


def _count(tokenizer: str, rule: str):
    names = ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from echoloom.llm.pieces import encoder, slices

        encode = encoder(tokenizer)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                columns: list[list[np.ndarray]] = [[] for _ in names[1:]]
                repeats = []
                for text in batch.column("text").slice(a, b - a).to_pylist():
                    spans = sections(text or "")
                    repeats.append(len(spans))
                    ids, first, last = encode.ids_and_spans(text)
                    own, crossing = allocate(spans, first, last, rule)
                    for column, values in zip(columns, (np.arange(len(spans)), spans[:, 0], spans[:, 1], own, crossing, np.full(len(spans), len(ids)))):
                        column.append(values)
                doc_id = batch.column("doc_id").slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), repeats)))
                yield pa.RecordBatch.from_arrays([doc_id, *(pa.array(np.concatenate(c).astype(np.int64)) for c in columns)], names)

    return run


def count_section_tokens(docs: DataFrame, tokenizer: str | None = None, rule: str = "first") -> DataFrame:
    """Tokens of each line of every document: doc_id, section, char_start, char_end, n_tokens, n_crossing, doc_tokens.

    Each whole document is encoded once and each token counted in one section, by the rule where it crosses a boundary,
    so a document's sections add up to doc_tokens. No row is shuffled. A null or empty text is one
    section of no characters and no tokens; null doc_ids and repeated rows are counted like others; further columns are
    ignored.
    """
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(text, '') as text")
    return map_arrow(rows, _count(tokenizer or byte_vocabulary(), rule), "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_section_tokens(table(spark, sf_dir, "documents"))
