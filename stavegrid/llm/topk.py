"""Exact top-k inner products with multi-resolution segment statistics.

A vector is split into equal segments, and each segment is kept as its mean
and standard deviation.  For two segments of m components the sum of products
is at most m * (mean * mean + deviation * deviation), which is the lower bound
of their distance turned into an upper bound of their product.  Bounds are
taken over 1, 4 and 16 segments, then over pairs, then over half the components
one by one and pairs of the rest; only pairs that could still enter the query's
k best meet the next finer level, and only survivors get exact scores.  A query
starts with the k-th best of the queries of its own block, so rows are dropped
from the first on.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stavegrid.llm.common import batch_of, column, discard, materialize

#: Levels of equal segments; two finer ones follow, see :func:`levels`.
SEGMENTS = (1, 4, 16)
#: Queries of a block at most, and blocks that are searched for in one scan.
QUERY_BLOCK, AT_ONCE = 4096, 8
_CHUNK = 1024


def scaled_vectors(column: pa.Array, scale: float = 256.0) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a usable vector, and these rows' floor(scale * x).

    Null vectors and vectors with a null or non-finite component are left out;
    shorter vectors are filled up with zeros.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    values = column.flatten()
    size = np.zeros(n, np.int64)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    size[there] = np.diff(column.offsets.to_numpy())[there]
    x = values.cast(pa.float64()).to_numpy(zero_copy_only=False) if len(values) else np.zeros(0)
    bad = np.zeros(n, bool)
    owner = np.repeat(np.arange(n), size)
    bad[owner[~np.isfinite(x)]] = True
    usable = np.flatnonzero(there & ~bad)
    out = np.zeros((n, int(size.max(initial=0))))
    start = np.cumsum(size) - size
    out[owner, np.arange(len(x)) - np.repeat(start, size)] = np.floor(scale * np.where(np.isfinite(x), x, 0))
    return usable, out[usable]


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def levels(d: int) -> list[np.ndarray]:
    """Edges of the segments of d components, coarse to fine."""
    d = max(d, 1)
    out = [np.linspace(0, d, min(n, d) + 1).astype(int) for n in SEGMENTS]
    out.append(np.unique(np.r_[np.arange(0, d, 2), d]))
    out.append(np.unique(np.r_[np.arange(d // 2), np.arange(d // 2, d, 2), d]))
    return out


def statistics(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Segment means and deviations side by side, weighted so that the inner
    product of two vectors' statistics bounds their inner product.  A segment
    of one component has no deviation."""
    size = np.diff(edges)
    if not x.shape[1]:
        return np.zeros((len(x), 1))
    total = np.add.reduceat(x, edges[:-1], axis=1)
    mean = total / size
    wide = np.flatnonzero(size > 1)
    spread = np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, edges[:-1], axis=1)[:, wide]
    return np.concatenate([mean * np.sqrt(size), np.sqrt(spread)], 1)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond a long they stay at its ends."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in q], object).reshape(q.shape), np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return np.clip(whole[0].dot(whole[1].T), -(2**63), 2**63 - 1).astype(np.int64)


def _pairwise(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (a, b) of rows of q and x."""
    out = [np.einsum("ij,ij->i", q[a[k : k + 65536]], x[b[k : k + 65536]]) for k in range(0, len(a), 65536)]
    return np.concatenate(out) if out else np.zeros(0)


def starting_scores(queries: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the other queries, which are rows too."""
    least = np.full(len(queries), -(2**63), np.int64)
    if len(queries) > k:
        for low in range(0, len(queries), 512):
            score = _exact(queries[low : low + 512], queries)
            score[np.arange(len(score)), low + np.arange(len(score))] = -(2**63)
            least[low : low + 512] = np.partition(score, len(queries) - k, axis=1)[:, len(queries) - k]
    return least


class Searcher:
    """The k best of each query over chunks of rows.  ``met`` and ``scored``
    count the pairs offered and those that got an exact score."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.queries, self.k = ids, queries, k
        self.edges = levels(queries.shape[1])
        self.levels = [statistics(queries, e) for e in self.edges]
        self.least = np.full(len(ids), -(2**63), np.int64) if least is None else least.copy()  # the k-th best so far
        self.found = [np.zeros(0, np.int64)] * 3  # query's row, score, id
        self.met = self.scored = 0
        self.step = 64  # few rows at first, which raise the scores to beat

    def offer_all(self, ids: np.ndarray, rows: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            self.offer(ids[at : at + self.step], rows[at : at + self.step])
            at, self.step = at + self.step, min(2 * self.step, _CHUNK)

    def offer(self, ids: np.ndarray, rows: np.ndarray) -> None:
        width = max(self.queries.shape[1], rows.shape[1])
        queries, rows = _widened(self.queries, width), _widened(rows, width)
        if width != self.queries.shape[1]:
            self.queries, self.edges = queries, levels(width)
            self.levels = [statistics(queries, e) for e in self.edges]
        self.met += len(self.ids) * len(ids)
        reach = lambda bound: bound * (1 + 1e-9 * np.sign(bound)) + 1
        mask, a, b = np.ones((len(self.ids), len(ids)), bool), None, None
        for held, edges in zip(self.levels, self.edges):
            of = statistics(rows, edges)
            if a is None and mask.any():
                mask &= reach(held @ of.T) >= self.least[:, None]
                if mask.mean() < 0.05:  # few pairs are cheaper one by one
                    a, b = np.nonzero(mask)
            elif a is not None:
                ok = reach(_pairwise(held, of, a, b)) >= self.least[a]
                a, b = a[ok], b[ok]
        if a is None:
            a, b = np.nonzero(mask)
        other = self.ids[a] != ids[b]
        a, b = a[other], b[other]
        self.scored += len(a)
        if not len(a):
            return
        bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * width
        score = _pairwise(queries, rows, a, b).astype(np.int64) if bound < 2**53 else _exact(queries, rows)[a, b]
        ok = score >= self.least[a]
        a, b, score = a[ok], b[ok], score[ok]
        of, value, which = (np.concatenate(p) for p in zip(self.found, (a, score, ids[b])))
        order = np.lexsort((which, -value.astype(np.float64) if np.abs(value).max(initial=0) < 2**53 else ~value, of))
        of, value, which = of[order], value[order], which[order]
        first = np.searchsorted(of, of)
        keep = np.arange(len(of)) - first < self.k
        self.found = [of[keep], value[keep], which[keep]]
        full = np.flatnonzero(np.bincount(self.found[0], minlength=len(self.ids)) >= self.k)
        self.least[full] = np.maximum(self.least[full], self.found[1][np.searchsorted(self.found[0], full, "right") - 1])


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all other rows.

    ``is_query``: a column that is true for the rows to search for.  Rows
    without a key or without a usable vector take no part; a repeated key's
    queries are one query (its least vector), and a query meets no row of its
    own key; equal (vec_id, score) of repeated rows take a rank each.
    Queries are written once, in blocks of a bounded size with the scores they
    start with, which a task finds for its blocks.  AT_ONCE blocks go out in one
    scan of all rows; a task sends at most k rows a query to the merge.
    """
    spark = vectors.sparkSession
    id_, value = column(key).cast("long"), column(vector).cast("array<double>")
    rows = vectors.where(id_.isNotNull()).select(id_.alias("id"), value.alias("v"))
    asked = vectors.where(id_.isNotNull() & is_query).select(id_.alias("id"), value.alias("v"))
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = materialize(asked.where(usable).groupBy("id").agg(F.min("v").alias("v")), "topk-asked")
    blocks = max(1, -(-asked.count() // (QUERY_BLOCK // 2)))

    def start(block: pa.Table) -> pa.Table:
        _, queries = scaled_vectors(block.column("v"), scale)
        return block.append_column("least", pa.array(starting_scores(queries, k), pa.int64()))

    placed = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    started = materialize(placed.groupBy("block").applyInArrow(start, "id long, v array<double>, block int, least long"), "topk-started")
    discard(asked)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    parts = []
    for first in range(0, blocks, AT_ONCE):
        held = started.where(F.col("block").between(first, first + AT_ONCE - 1)).toArrow()  # at most AT_ONCE blocks
        of, ids, least = (held.column(c).to_numpy() for c in ("block", "id", "least"))
        _, queries = scaled_vectors(held.column("v"), scale)
        shared = spark.sparkContext.broadcast([(ids[of == b], queries[of == b], least[of == b]) for b in np.unique(of)])

        def run(batches, shared=shared):
            searchers = [Searcher(ids, queries, k, least) for ids, queries, least in shared.value]
            for batch in batches if searchers else ():
                usable, x = scaled_vectors(batch.column("v"), scale)
                ids = batch.column("id").to_numpy()[usable]
                for searcher in searchers:
                    searcher.offer_all(ids, x)
            for searcher in searchers:
                of, value, which = searcher.found
                yield batch_of(schema, query_id=searcher.ids[of], vec_id=which, score=value)

        found = rows.mapInArrow(run, "query_id long, vec_id long, score long")
        parts.append(materialize(found, "topk") if blocks > AT_ONCE else found)
    discard(started)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
