"""Exact top-k inner products by no-random-access aggregation.

Candidates and queries are dealt into blocks by a hash of their id, and each pair of a candidate block and a query
block is one bounded task. A score is a sum over dimensions. A candidate block has one list for each dimension, its
components in descending order of magnitude, sorted once for all queries of the task, and one list of the candidates'
lengths, which is read whole. The lists by dimension are read side by side, a run of rows of each at a time, runs
growing, and never elsewhere. What was read of a candidate gives its partial score. What its other lists still hold is
bounded by Cauchy and Schwarz: the query's length over those dimensions times the candidate's, which is what the
components read leave of its length (lists are read equally deep by all queries, so this is kept by depth). Since large
components of either sign come first, the rest is short long before the lists end: lower and upper bounds close in. A
candidate whose upper bound is under the k-th best lower bound is an outsider; reading stops when no outsider can
qualify any more, that is, when k candidates are left, or at the lists' ends (ties at the k-th place). The scores of
those left are then resolved, and the blocks' best are merged by query.

Ties go to the smaller id, and bounds are compared so that equal scores stay in. Scores are integers, exact as long as
components times scale and the sums of products fit in 64 bits; components beyond that saturate.

Edge cases: vectors that are null, or hold null or non-finite components, take no part; vectors of another length
than the query's are no candidates for it; an empty vector has score 0 with other empty ones; repeated ids are
candidates each, but never for a query of the same id; fewer than k candidates: all of them; an empty table gives an
empty table. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted

SCHEMA = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    x = quoted(vector)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf"))
    return vectors.filter(x.isNotNull() & quoted(key).isNotNull() & ~F.exists(x, bad)).select(quoted(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("v"))


class Lists:
    """A block's candidates; by dimension, their rows and components in descending order of magnitude; and the squared
    lengths that components beyond a depth have."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        plain = np.ascontiguousarray(vectors.T).astype(float)
        self.rows = np.argsort(-np.abs(plain), axis=1, kind="stable")
        self.values = np.take_along_axis(plain, self.rows, axis=1)
        self.lengths = (plain * plain).sum(axis=0)
        self._rest: dict[int, np.ndarray] = {}

    def rest(self, depth: int) -> np.ndarray:
        if depth not in self._rest:
            beyond = self.values[:, depth:]
            self._rest[depth] = np.bincount(self.rows[:, depth:].ravel(), (beyond * beyond).ravel(), len(self.ids))
        return self._rest[depth]


def nearest(lists: Lists, q: np.ndarray, own: int, k: int, step: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Ids and scores of the k best for one query, how deep the lists were read, and how many scores were resolved.
    Bounds are doubles, widened by more than their rounding."""
    n, d = lists.vectors.shape
    live, depth = np.flatnonzero(lists.ids != own), 0
    plain = q.astype(float)
    seen, known = np.zeros(n), np.zeros(n)
    whole = float((plain * plain).sum())
    slack = 1e-13 * (d + 1) * np.sqrt(whole * lists.lengths.max(initial=0.0))
    while d and depth < n and len(live) > k:
        to = min(n, depth + step)
        rows = lists.rows[:, depth:to].ravel()
        seen += np.bincount(rows, (lists.values[:, depth:to] * plain[:, None]).ravel(), n)
        known += np.bincount(rows, np.repeat(plain * plain, to - depth), n)
        depth, step = to, step + step // 8
        left = np.maximum(whole - known[live], 0.0) + 1e-15 * (d + 1) * whole
        reach = np.sqrt(left * lists.rest(depth)[live]) + slack
        low, high = seen[live] - reach, seen[live] + reach
        live = live[high >= np.partition(low, len(live) - k)[len(live) - k]]
    scores = lists.vectors[live] @ q  # resolved
    best = np.lexsort((lists.ids[live], -scores))[:k]
    return lists.ids[live][best], scores[best], depth, len(live)


def matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) by length of the vectors."""
    ids = table.column("id").to_numpy()
    lists = table.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy()
    values, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
    out = {}
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        out[size] = ids[mine], values[(ends[mine] - size)[:, None] + np.arange(size)].reshape(len(mine), size).astype(np.int64)
    return out


def block(queries: pa.Table, candidates: pa.Table, k: int, step: int) -> pa.Table:
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 3]
    if len(queries) and len(candidates):
        asked = matrices(queries)
        for size, (ids, vectors) in matrices(candidates).items():
            if size not in asked:
                continue
            lists = Lists(ids, vectors)
            for own, q in zip(*asked[size], strict=True):
                best, scores, *_ = nearest(lists, q, own, k, step)
                found.append((np.full(len(best), own), best, scores))
    return pa.table({name: np.concatenate(c).astype(np.int64) for name, c in zip(("query_id", "vec_id", "score"), zip(*found, strict=True), strict=True)})


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, block_rows: int = 4096, query_rows: int = 1024, step: int = 256) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) for the rows of `vectors` where is_query holds, against all other rows.
    A candidate is sent once for every `query_rows` queries, a query once for every `block_rows` candidates."""
    rows = usable(vectors, key, vector, scale)
    asked = usable(vectors.filter(is_query), key, vector, scale)
    n, m = rows.count(), asked.count()
    deal = lambda df, size, total: df.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // size)))))
    span = lambda size, total: F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-total // size)) - 1)).cast("array<long>"))
    right = deal(rows, block_rows, n).withColumn("cb", F.col("own")).withColumn("qb", span(query_rows, m)).select("cb", "qb", "id", "v")
    left = deal(asked, query_rows, m).withColumn("qb", F.col("own")).withColumn("cb", span(block_rows, n)).select("cb", "qb", "id", "v")
    best = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(lambda a, b: block(a, b, k, step), SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
