"""Exact top-k search by inner product over integer vectors.

Method: Fagin's threshold algorithm over sorted per-dimension lists.

1. A vector's components become floor(64 x). Rows are dealt into shards of
   bounded size by a hash of the id; each shard sorts one list per dimension.
2. A query reads its dimensions' lists from the end that its component's sign
   prefers, to doubling depths, each list in proportion to the component's size;
   rows seen for the first time are scored in full
   (a product of some queries with the shard has the scores that they look up). The threshold is the highest
   score of a row that stands at or behind the present depth of every list and is
   no longer than the shard's longest row: at each component the smaller of the
   list's value and a multiple of the query's component, with the multiple that
   spends the whole length. No unseen row exceeds it. When it is below the k-th
   score found, the search in the shard ends; it ends too when every row has been
   seen. A task searches some shards one after the other and starts each with the
   k-th score of those before.
3. The k best of each group of shards are merged: any of the k best of all is
   among the k best of its group.

Rank order is score descending, then smaller vec_id; the search goes on while
the threshold equals the k-th score, so ties are exact.

Defined results: vectors that are null, empty or hold null or non-finite
components, and rows without vec_id, take no part. Shorter vectors are
continued with zeros. Rows that repeat both vec_id and vector are one. A query
is never its own candidate. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.vectors import matrix, shape, usable_vectors
from wordloom.storage import settle

K = 20
SCALE = 64
#: Rows of a shard, shards that a task searches in turn, and queries that it holds.
SHARD_ROWS = 16_384
GROUP_SHARDS = 8
BLOCK_QUERIES = 8192
#: Queries whose scores are computed at a time: looking scores up one by one gathers rows, which costs more than all of a product.
SCORED_QUERIES = 32
#: Fewer queries are not dealt over more tasks, however many cores there are.
LEAST_QUERIES = 64
FIRST_DEPTH = 16

_FOUND = "query_id long, vec_id long, score long"


def narrow(rows: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them all, after a byte with its size."""
    low, high = int(rows.min(initial=0)), int(rows.max(initial=0))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + rows.astype(kind).tobytes()


def widened(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(-1, width)


def _packed(width: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        own = np.floor(SCALE * matrix(table.column("v"), width)).astype(np.int64)[order]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "data": pa.array([narrow(own)], pa.binary())})

    return run


def threshold(limits: np.ndarray, weights: np.ndarray, length: float) -> float:
    """The highest sum of weights * v over v <= limits with a norm of at most `length`; weights are positive."""
    free = limits > 0
    squares = limits**2
    budget = length**2 - squares[~free].sum()
    if budget < 0:
        return -np.inf  # no such row
    fixed = float(limits[~free] @ weights[~free])
    limits, weights, squares = limits[free], weights[free], squares[free]
    order = np.argsort(limits / weights)
    limits, weights, squares = limits[order], weights[order], squares[order]
    # with the first i limits reached, the others are the same multiple of their weights
    left = np.maximum(budget - np.concatenate(([0.0], np.cumsum(squares))), 0)
    rest = np.concatenate((np.cumsum((weights**2)[::-1])[::-1], [0.0]))
    with np.errstate(divide="ignore"):
        multiple = np.sqrt(left[:-1] / rest[:-1])
    open_ = np.flatnonzero(multiple <= limits / weights)
    if not len(open_):
        return fixed + float(limits @ weights)
    i = int(open_[0])
    return fixed + float(limits[:i] @ weights[:i]) + float(multiple[i] * rest[i])


class Shard:
    """The rows of a shard and, for each dimension, the list of that component in descending order and each row's place in it."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows  # ids ascend
        lists = np.argsort(-rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, lists, axis=0).T.copy()
        # places below 2**24 are exact in single precision
        places = np.empty(rows.shape, np.float32 if len(rows) < 1 << 22 else np.float64)
        np.put_along_axis(places, lists, np.arange(len(rows), dtype=places.dtype)[:, None], axis=0)
        self.places = places.T.copy()
        self.most = int(np.abs(rows).max(initial=0))
        self.length = float(np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) * (1 + 1e-9)
        self.floats = rows.astype(np.float32 if self.most**2 * rows.shape[1] < 1 << 24 else np.float64)
        self.scored = 0

    def scores(self, queries: np.ndarray) -> np.ndarray | None:
        """(queries, rows): the scores that some queries' searches look up, in one product; None if its numbers would not be exact."""
        # integer sums below 2**24 are exact in single precision, below 2**53 in double
        largest = self.most * int(np.abs(queries).max(initial=0)) * queries.shape[1]
        if largest >= 1 << (24 if self.floats.dtype == np.float32 else 53):
            return None
        return queries.astype(self.floats.dtype) @ self.floats.T

    def top(self, query_id: int, query: np.ndarray, k: int, least: float = -np.inf, scores: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, scores) of the k best rows but the query's own; those below `least` may be left out. Its row of `scores` may be given."""
        n = len(self.ids)
        score = (lambda at: self.rows[at] @ query) if scores is None else (lambda at: scores[at].astype(np.int64))
        used = np.flatnonzero(query)
        rising = query[used] < 0
        weights = np.abs(query[used]).astype(np.float64)
        # the depth behind which each row is seen: a list is read in proportion to its weight
        first, read = np.full(n, np.inf if len(used) else 0, self.places.dtype), np.empty(n, self.places.dtype)
        for d, up, slower in zip(used.tolist(), rising.tolist(), (weights.max(initial=1) / weights).tolist(), strict=True):
            np.multiply(np.subtract(n - 1, self.places[d], out=read) if up else self.places[d], slower, out=read)
            np.minimum(first, read, out=first)
        first[np.searchsorted(self.ids, query_id) : np.searchsorted(self.ids, query_id, side="right")] = np.inf
        left = int(np.count_nonzero(np.isfinite(first)))
        at, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, depth = -1, FIRST_DEPTH
        while left:
            to = np.minimum(n, np.ceil(depth * weights / weights.max(initial=1))).astype(np.int64)
            new = np.flatnonzero((first >= done) & (first < depth))
            left -= len(new)
            self.scored += len(new)
            at, best = np.concatenate((at, new)), np.concatenate((best, score(new)))
            if len(at) > 4 * k:
                some = np.flatnonzero(best >= np.partition(best, len(best) - k)[len(best) - k])
                at, best = at[some], best[some]
            if len(at) > k:
                keep = np.lexsort((self.ids[at], -best))[:k]
                at, best = at[keep], best[keep]
            if len(at) == k:
                least = max(least, float(best.min()))
            here = np.where(rising, -self.values[used, n - to], self.values[used, to - 1]).astype(np.float64)
            bound = threshold(here, weights, self.length)
            if bound + 1e-9 * (1 + abs(bound)) < least:
                break
            done, depth = depth, depth * 2
        return at, best


def _search(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = vectors = None
        best: list[tuple[np.ndarray, np.ndarray]] = []

        def found() -> pa.RecordBatch:
            sizes = [len(ids) for ids, _ in best]
            columns = np.repeat(queries, sizes), np.concatenate([ids for ids, _ in best]), np.concatenate([scores for _, scores in best])
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                rows = widened(batch.column("data")[i].as_py(), width)
                if not batch.column("shard")[i].as_py():  # the queries precede the shards that they meet
                    if queries is not None:
                        yield found()
                    queries, vectors = ids, rows
                    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
                    continue
                if queries is None:
                    continue  # a block that no query fell into
                shard = Shard(ids, rows)
                for q, (query_id, query) in enumerate(zip(queries.tolist(), vectors, strict=True)):
                    if q % SCORED_QUERIES == 0:
                        product = shard.scores(vectors[q : q + SCORED_QUERIES])
                    have, scores = best[q]
                    at, more = shard.top(query_id, query, k, float(scores.min()) if len(have) == k else -np.inf, None if product is None else product[q % SCORED_QUERIES])
                    have, scores = np.concatenate((have, shard.ids[at])), np.concatenate((scores, more))
                    keep = np.lexsort((have, -scores))[:k]
                    best[q] = have[keep], scores[keep]
        if queries is not None and len(queries):
            yield found()

    return run


def top_k(embeddings: DataFrame, k: int = K, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, its k best others."""
    vectors = usable_vectors(embeddings).distinct()
    rows, width = shape(vectors)
    shards = max(1, -(-rows // SHARD_ROWS))
    groups = -(-shards // GROUP_SHARDS)
    # blocks of bounded size, and of a small table as many as keep the cores busy
    asked = max(1, rows // every)
    cores = embeddings.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-asked // BLOCK_QUERIES), min(-(-asked // LEAST_QUERIES), -(-4 * cores // groups)))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    schema = "part int, ids binary, data binary"
    data = settle(vectors.withColumn("part", part(shards)).groupBy("part").applyInArrow(_packed(width), schema))
    queries = settle(vectors.where(F.col("vec_id") % every == 0).withColumn("part", part(blocks)).groupBy("part").applyInArrow(_packed(width), schema))
    # each block of queries meets each group of shards in a partition of its own
    met_by = queries.select((F.col("part") * groups).alias("base"), F.lit(False).alias("shard"), F.lit(0).alias("part"), "ids", "data", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    met = data.select(F.floor(F.col("part") / GROUP_SHARDS).cast("int").alias("group"), F.lit(True).alias("shard"), "part", "ids", "data")
    met = met.withColumn("base", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) * groups), F.lit(max(1, groups)))))
    pairs = met_by.unionByName(met).withColumn("meeting", F.col("base") + F.col("group"))
    pairs = pairs.repartitionById(blocks * groups, "meeting").sortWithinPartitions("meeting", "shard", "part")
    found = pairs.mapInArrow(_search(width, k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
