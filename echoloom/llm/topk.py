"""Exact top-k inner-product search by a three-phase uniform threshold over lists of partial scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, table

#: Results of a query, lists that a vector's dimensions are dealt to, queries sent to the tasks at once.
K, LISTS, QUERIES = 5, 2, 2048
#: Candidates scored against a block of queries at once.
CANDIDATES = 2048


def quantize(vectors: DataFrame) -> DataFrame:
    """vec_id and v, 256 times each component, in doubles; readers round it down, so large components stay exact.

    Vectors that are null or hold null or non-finite parts are left out, as are those of which 256 x is no longer finite
    (beyond 1e305) and rows without a vec_id, which neither ask nor can be named in a result. Further columns, however
    called, are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") * 256).alias("v"))
    return rows.filter("vec_id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as rows of equal length, rounded down; shorter vectors end in zeros."""
    offsets, values = column.offsets.to_numpy(), np.floor(column.values.to_numpy(zero_copy_only=False).astype(float, copy=False))
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == sizes[0]).all() and (width is None or sizes[0] == width):
        return values[offsets[0] : offsets[-1]].reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), width or 0)))
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[i, : b - a] = values[a:b]
    return out


class _Block:
    """Queries as the tasks get them: ids, one matrix, and later each query's cutoff."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cutoffs: np.ndarray | None = None):
        self.ids, self.vectors, self.cutoffs = ids, vectors, cutoffs


def _exact(a: np.ndarray, b: np.ndarray) -> np.dtype:
    """A type in which sums of products of these whole numbers are exact: Python's integers where 64 bits don't do."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.dtype(np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**63 else object)


def _as(values: np.ndarray, kind: np.dtype) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape) if kind == object else values.astype(kind)


def _as_long(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; one beyond 64 bits is the largest (or smallest) long."""
    return np.array([min(max(int(s), -(2**63) + 1), 2**63 - 1) for s in scores], np.int64) if scores.dtype == object else scores.astype(np.int64)


def _below(score: int) -> float:
    """A double that is no larger than a long."""
    return float(score) if abs(score) < 1 << 53 else float(np.nextafter(float(score), -np.inf))


def _parts(width: int, lists: int) -> list[slice]:
    cuts = [width * i // lists for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of each query's k best scores, ties to the smaller vec_id."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - first < k]


def _scores(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact scores of pairs of rows; q and c are of a type that holds them."""
    return _as_long((q[i] * c[j]).sum(1) if q.dtype == object else np.einsum("ij,ij->i", q[i], c[j]))


_OUT = "query_id long, vec_id long, score long"


def _rows(block: _Block, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block.ids[query]), pa.array(vec.astype(np.int64)), pa.array(score)], ["query_id", "vec_id", "score"])


def _local_lists(block_of, k: int, lists: int):
    """Phase 1: from every list of partial scores the k best entries of a task, with their exact scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block_of.value
        query, vec, score = (np.zeros(0, np.int64) for _ in range(3))
        for ids, vectors, queries in _candidates(batches, block):
            kind = _exact(queries, vectors)
            q, c = _as(queries, kind), _as(vectors, kind)
            own = block.ids[:, None] == ids[None, :]
            found = [np.zeros((0, 2), np.int64)]
            for part in _parts(q.shape[1], lists):
                partial = q[:, part] @ c[:, part].T
                partial[own] = np.iinfo(np.int64).min if kind.kind == "i" else -np.inf
                n = min(k, len(ids))
                top = np.argsort(-partial, axis=1)[:, :n] if kind == object else np.argpartition(-partial if kind.kind == "f" else ~partial, n - 1, axis=1)[:, :n]
                found.append(np.stack([np.repeat(np.arange(len(q)), n), top.ravel()], 1))
            pairs = np.unique(np.concatenate(found), axis=0)
            pairs = pairs[~own[pairs[:, 0], pairs[:, 1]]]
            exact = _scores(q, c, pairs[:, 0], pairs[:, 1])
            query, vec, score = np.concatenate([query, pairs[:, 0]]), np.concatenate([vec, ids[pairs[:, 1]]]), np.concatenate([score, exact])
            best = _best(query, vec, score, k)
            query, vec, score = query[best], vec[best], score[best]
        if len(query):
            yield _rows(block, query, vec, score)

    return run


def _above_cutoff(block_of, k: int, lists: int):
    """Phases 2 and 3: entries whose partial score in some list reaches the query's cutoff over the number of lists, then
    their exact scores. A candidate below that in every list has a smaller sum than the cutoff and can't be in the top k.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block_of.value
        query, vec, score = (np.zeros(0, np.int64) for _ in range(3))
        for ids, vectors, queries in _candidates(batches, block):
            kind = _exact(queries, vectors)
            q, c = _as(queries, kind), _as(vectors, kind)
            parts = _parts(q.shape[1], lists)
            least = np.floor(block.cutoffs / max(1, len(parts)))
            enough = np.zeros((len(q), len(ids)), bool)
            for part in parts or [slice(0, 0)]:
                enough |= (q[:, part] @ c[:, part].T) >= least[:, None]
            enough &= block.ids[:, None] != ids[None, :]
            i, j = np.nonzero(enough)
            for at in range(0, len(i), 1 << 18):
                a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                exact = _scores(q, c, a, b)
                keep = exact >= block.cutoffs[a]
                query, vec, score = np.concatenate([query, a[keep]]), np.concatenate([vec, ids[b[keep]]]), np.concatenate([score, exact[keep]])
                best = _best(query, vec, score, k)
                query, vec, score = query[best], vec[best], score[best]
        if len(query):
            yield _rows(block, query, vec, score)

    return run


def _candidates(batches: Iterator[pa.RecordBatch], block: _Block):
    for batch in batches:
        for start in range(0, batch.num_rows, CANDIDATES):
            part = batch.slice(start, CANDIDATES)
            vectors = _matrix(part.column("v"), block.vectors.shape[1])
            queries = block.vectors
            if vectors.shape[1] > queries.shape[1]:
                queries = np.pad(queries, ((0, 0), (0, vectors.shape[1] - queries.shape[1])))
            yield part.column("vec_id").to_numpy(), vectors, queries


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, lists: int = LISTS, block: int = QUERIES) -> DataFrame:
    """Each query's k best candidates by integer inner product: query_id, rank, vec_id, score; both tables as quantize() gives.

    Queries go to the tasks in blocks dealt by their hashed ids, of `block` at most but for chance (four fifths of it in the
    mean). A block is two passes over the candidates, after which its results are written and what was broadcast is
    freed, so neither the plan nor the memory of a machine grows with the number of blocks. Phase 1 gathers each task's
    best entries of each list of partial scores; the k-th best exact score among them is a safe cutoff, as the k-th best
    of all is no smaller. Phase 2 broadcasts it and collects the entries that can still reach it; phase 3 scores those
    exactly. A task hands on k rows a query at most.

    Ties go to the smaller vec_id. A query's own row, known by its vec_id, is no candidate. Fewer than k candidates are
    all returned; shorter vectors count as ended by zeros; repeated vec_ids are candidates each, and one query. A score
    that exceeds 64 bits is the largest or smallest long. No queries or no candidates give no rows.
    """
    spark, scratch = candidates.sparkSession, Scratch(candidates.sparkSession)
    stored = scratch.save(candidates.select("vec_id", "v"), "candidates")
    asked = scratch.save(queries.groupBy(F.col("vec_id")).agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-asked.count() * 5 // (4 * block)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scratch.save(spark.createDataFrame([], _OUT), "best")
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow()
        if not rows.num_rows:
            continue
        rows = rows.combine_chunks()
        ids, vectors = rows.column("vec_id").to_numpy(), _matrix(rows.column("v").chunk(0))
        sent = spark.sparkContext.broadcast(_Block(ids, vectors))
        local = map_arrow(stored, _local_lists(sent, k, lists), _OUT)
        kth = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("query_id", "score").toArrow()
        sent.destroy()
        cutoffs = np.full(len(ids), -np.inf)  # a query with fewer than k candidates has none
        place = {int(q): n for n, q in enumerate(ids)}
        for q, s in zip(kth.column("query_id").to_pylist(), kth.column("score").to_pylist()):
            cutoffs[place[q]] = _below(s)
        sent = spark.sparkContext.broadcast(_Block(ids, vectors, cutoffs))
        found = map_arrow(stored, _above_cutoff(sent, k, lists), _OUT)
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank").write.mode("append").parquet(scratch.path("best"))
        sent.destroy()
    scratch.drop("candidates")
    best = spark.read.schema(_OUT).parquet(scratch.path("best"))
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantize(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
