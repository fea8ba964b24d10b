"""Approximate nearest neighbours by query-aware collision counting (after Huang and others, VLDB 2015).

Every vector is projected on PROJECTIONS random lines; a line's values, sorted, are an array. A query opens a window around
its own value in each array, of half width WIDTH / 2 times a radius, and widens all windows radius by radius (virtual
rehashing), counting how many windows hold each vector. A vector that COLLISIONS windows hold is verified: its exact
inner product is taken. A query is done once its k-th best verified vector lies within the radius: one nearer than that would
have collided often enough with high probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, partitions, table

#: Results of a query; lines; window width at radius 1; collisions that a vector needs; growth of the radius.
K, PROJECTIONS, WIDTH, COLLISIONS, GROWTH = 20, 48, 2.0, 29, 1.2
#: Radii from the smallest, 2 / GROWTH^14, to 2, the largest distance of scaled vectors, and windows over everything.
RADII = np.append(2 * GROWTH ** np.arange(-14.0, 1.0), np.inf)
#: Rows of an index shard, at least (unless the table is smaller) and at most, and queries that a task works for at most.
LEAST, MOST, QUERIES = 1024, 65_536, 65_536
#: Cells of shards and query groups are dealt to this many tasks at most.
TASKS = 100_000
#: Components beyond this in size would overflow in products.
LARGEST = 1e150
SEED = 20_150


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v of the vectors that take part: not null or zero, without null or non-finite components.

    Rows without a vec_id can't be named in a result and are left out, as are vectors with a component beyond 1e150 in
    size. Further columns are ignored.
    """
    v = F.col(column)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    return rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST)) & F.exists("v", lambda x: x != 0))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of doubles of one width, shorter ones ending in zeros."""
    sizes, values = np.diff(lists.offsets.to_numpy()), lists.values.to_numpy(zero_copy_only=False).astype(float)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, without overflow of very small or large ones."""
    high = np.abs(x).max(1, initial=0)
    return high * np.sqrt(((x / np.where(high, high, 1)[:, None]) ** 2).sum(1))


class Shard:
    """Vectors of one shard and the sorted array of each line.

    Largest inner product becomes least distance: vectors are divided by the largest length of all and get one more
    component that fills each up to length 1; queries are divided by their own length and get a zero there.
    """

    def __init__(self, ids: np.ndarray, places: np.ndarray, vectors: np.ndarray, longest: float):
        self.ids, self.places, self.vectors, self.longest = ids, places, vectors, longest
        self.lines = np.random.default_rng(SEED).normal(size=(vectors.shape[1] + 1, PROJECTIONS))
        scaled = vectors / longest
        rest = np.sqrt(np.maximum(0.0, 1 - (scaled * scaled).sum(1)))
        at = scaled @ self.lines[:-1] + rest[:, None] * self.lines[-1]
        self.order = np.ascontiguousarray(np.argsort(at, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.sort(at, axis=0).T)

    def windows(self, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every query's window in each array at each radius."""
        at = (queries / lengths[:, None]) @ self.lines[:-1]
        begin = np.empty((len(queries), len(RADII), PROJECTIONS), np.int64)
        end = begin.copy()
        reach = WIDTH / 2 * RADII
        for j in range(PROJECTIONS):
            begin[:, :, j] = np.searchsorted(self.sorted[j], at[:, j, None] - reach, "left")
            end[:, :, j] = np.searchsorted(self.sorted[j], at[:, j, None] + reach, "right")
        return begin, end

    def search(self, query: np.ndarray, place: int, length: float, begin: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k best vectors found for a query and their inner products; the row of `place` is left out."""
        n = len(self.ids)
        # k vectors need k times COLLISIONS collisions: smaller windows have no answer
        at = min(int(np.searchsorted((end - begin).sum(1), COLLISIONS * k)), len(RADII) - 1)
        lack = np.full(n, COLLISIONS)
        best, score = np.zeros(0, np.int64), np.zeros(0)
        old = None
        while True:
            left, right = begin[at].tolist(), end[at].tolist()
            if old is None:
                parts = [self.order[j, a:b] for j, (a, b) in enumerate(zip(left, right))]
            else:
                parts = [self.order[j, a:b] for j, (a, b) in enumerate(zip(left, old[0])) if b > a] + [self.order[j, a:b] for j, (a, b) in enumerate(zip(old[1], right)) if b > a]
            old = left, right
            if parts:
                lack -= np.bincount(np.concatenate(parts), minlength=n)
                found = np.flatnonzero(lack <= 0)
                lack[found] = 1 << 40
                best, score = self._verified(query, place, length, found, best, score, k)
            if at == len(RADII) - 1 or len(best) == k and 2 - 2 * score.min() / (length * self.longest) <= RADII[at] ** 2:
                return best, score
            at += 1

    def _verified(self, query, place, length, found, best, score, k):
        """The k best of those before and the newly found. Ties go to smaller ids; equal vectors have equal scores, as
        those near the k-th best are summed row by row, whatever a matrix product made of them."""
        rough = self.vectors[found] @ query
        least = score.min() if len(score) == k else -np.inf
        if len(rough) > k:
            least = max(least, np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1])  # one more, as the query may be among them
        found = found[rough >= least - 1e-9 * length * self.longest]
        found = found[self.places[found] != place]
        best, score = np.concatenate([best, found]), np.concatenate([score, (self.vectors[found] * query).sum(1)])
        if len(best) > k:
            first = np.lexsort((self.places[best], self.ids[best], -score))[:k]
            best, score = best[first], score[first]
        return best, score


_FOUND = "query_id long, query_place long, vec_id long, place long, score double"


def _cells(width: int, longest: float, k: int):
    """Rows in order of (cell, asks): a cell's vectors become a shard, then its queries are answered as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, shard = None, [], None
        for batch in batches:
            cells, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1, [len(cells)]]) if len(cells) else [0]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if cells[a] != cell:
                    cell, held, shard = cells[a], [], None
                if not asks[a]:
                    held.append((part.column("vec_id").to_numpy(), part.column("place").to_numpy(), _matrix(part.column("v"), width)))
                    continue
                if shard is None and held:
                    shard, held = Shard(*(np.concatenate(x) for x in zip(*held)), longest), []
                for start in range(0, b - a, 256) if shard else ():
                    some = part.slice(start, 256)
                    ids, places, queries = some.column("vec_id").to_numpy(), some.column("place").to_numpy(), _matrix(some.column("v"), width)
                    lengths = norms(queries)
                    windows = shard.windows(queries, lengths)
                    found = [shard.search(queries[i], places[i], lengths[i], windows[0][i], windows[1][i], k) for i in range(len(ids))]
                    sizes = [len(rows) for rows, _ in found]
                    rows = np.concatenate([rows for rows, _ in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (np.repeat(ids, sizes), np.repeat(places, sizes), shard.ids[rows], shard.places[rows], np.concatenate([s for _, s in found]))], ["query_id", "query_place", "vec_id", "place", "score"]
                    )

    return run


def nearest(vectors: DataFrame, asks: str, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the condition `asks` holds for, the k rows of largest inner product found.

    vectors as usable() gives; every row is indexed, and is a candidate of every query but itself; of repeated vec_ids each
    row asks and is a candidate. Score is the inner product in double precision; ties go to the smaller vec_id, then to
    the row met first. Fewer than k candidates are all returned. Shorter vectors end in zeros. No queries, no rows.

    Rows are dealt to shards by their hash, LEAST to MOST a shard; queries in groups of QUERIES go to every shard. A task
    builds its shard's arrays and answers one query at a time, so its memory is bounded by MOST rows; it hands on k rows
    a query. A query's shards meet in one window over k rows a shard. Work is queries times rows: windows of vectors as far
    from each other as these hold much of each array, which only the counting and verifying of a shard's rows tells.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    stored = scratch.save(vectors.select("vec_id", F.monotonically_increasing_id().alias("place"), "v"), "vectors")
    high = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    asked = F.coalesce(F.expr(asks), F.lit(False))
    rows, queries, width, longest = stored.agg(F.count("*"), F.count_if(asked), F.max(F.size("v")), F.greatest(F.sqrt(F.max(squares)), F.max(high))).first()
    if not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = max(1, min(max(partitions(stored), -(-rows // MOST)), rows // LEAST))
    groups = -(-queries // QUERIES)
    columns = ["cell", "asks", "vec_id", "place", "v"]
    own = F.pmod(F.xxhash64("vec_id", "place"), F.lit(shards))
    indexed = stored.withColumn("cell", F.explode(F.transform(F.expr(f"sequence(0L, {groups - 1}L)"), lambda g: g * shards + own))).withColumn("asks", F.lit(False))
    group = F.pmod(F.xxhash64("place", "vec_id"), F.lit(groups)) * shards
    sent = stored.filter(asked).withColumn("cell", F.explode(F.transform(F.expr(f"sequence(0L, {shards - 1}L)"), lambda s: s + group))).withColumn("asks", F.lit(True))
    both = indexed.select(columns).unionByName(sent.select(columns))
    tasks = min(shards * groups, TASKS)
    dealt = both.repartitionById(tasks, (F.col("cell") % tasks).cast("int")).sortWithinPartitions("cell", "asks", "vec_id", "place")
    found = map_arrow(dealt, _cells(width, longest, k), _FOUND)
    order = Window.partitionBy("query_id", "query_place").orderBy(F.desc("score"), "vec_id", "place")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(usable(table(spark, sf_dir, "embeddings")), "vec_id % 20 = 0")
