"""Hard negatives by norm-bucketed search.

Rows are sorted by label and falling norm and cut into buckets of one label,
which are written once.  A search offers buckets to blocks of anchors: a bucket
whose largest norm times the anchor's norm (Cauchy-Schwarz) stays below what all
the anchor's windows still want is left out.  A window wants scores from its
lower limit to its upper one, and from its k-th best score on once it has k.

There are two searches.  The first has one window an anchor, without limits,
over rows of the anchor's label, and finds its positives; the second has a
window for each positive, over rows of other labels.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavegrid.llm.common import batch_of, column, materialize, shuffle_width, unused
from stavegrid.llm.topk import _exact, _widened, scaled_vectors

#: Rows of a bucket, anchors that meet a bucket in one product, anchors of one
#: scan of all buckets, and scans in one job.
BUCKET, TOGETHER, BLOCK, AT_ONCE = 512, 1024, 65536, 8
_LEAST, _MOST = -(2**63), 2**63 - 1


class WindowSearch:
    """The k best rows within each window of each anchor.

    ``low`` and ``high`` have a row an anchor and a column a window; ``same``
    says whether rows of the anchor's label or of other labels count.  ``met``
    and ``scored`` count the pairs offered and those that got a score."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.queries, self.k, self.same = ids, labels, queries, k, same
        self.norms = np.sqrt(np.einsum("ij,ij->i", queries, queries)) * (1 + 1e-9)
        self.least, self.high = low.copy(), high  # what a score must reach by now, and may be at most
        self.least[low > high] = _MOST
        self.found = [np.zeros(0, np.int64)] * 3  # window (anchor * windows + place), score, id
        self.met = self.scored = 0
        self.step = 32  # few rows at first, which raise the scores to reach

    def offer(self, label: int, ids: np.ndarray, rows: np.ndarray) -> None:
        """Rows of one label, by falling norm."""
        mine = np.flatnonzero((self.labels == label) == self.same)
        self.met += len(mine) * len(ids)
        at = 0
        while at < len(ids):
            part = rows[at : at + self.step]
            top = float(np.sqrt((part * part).sum(axis=1)).max(initial=0)) * (1 + 1e-9)
            wanted = self.least[mine].min(axis=1)
            near = mine[(self.norms[mine] * top + 1 >= wanted) & (wanted < _MOST)]
            for low in range(0, len(near), TOGETHER):
                self._score(near[low : low + TOGETHER], ids[at : at + self.step], part)
            at, self.step = at + self.step, min(2 * self.step, BUCKET)

    def _score(self, anchors: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        width = max(self.queries.shape[1], rows.shape[1])
        self.queries = _widened(self.queries, width)
        score = _exact(self.queries[anchors], _widened(rows, width))
        self.scored += score.size
        a, b = np.nonzero(score >= self.least[anchors].min(axis=1)[:, None])
        a, b, value = anchors[a], b, score[a, b]
        other = self.ids[a] != ids[b]
        a, b, value = a[other], b[other], value[other]
        windows = self.least.shape[1]
        new = [[], [], []]
        for w in range(windows):
            ok = (value >= self.least[a, w]) & (value <= self.high[a, w])
            for held, more in zip(new, (a[ok] * windows + w, value[ok], ids[b[ok]])):
                held.append(more)
        if sum(map(len, new[0])):
            self._keep([np.concatenate(n) for n in new])

    def _keep(self, new: list[np.ndarray]) -> None:
        touched = np.unique(new[0])
        again = np.isin(self.found[0], touched, kind="sort")
        of, value, which = (np.concatenate([f[again], n]) for f, n in zip(self.found, new))
        order = np.lexsort((which, ~value, of))
        of, value, which = of[order], value[order], which[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep, full = place < self.k, place == self.k - 1
        self.least.reshape(-1)[of[full]] = value[full]
        self.found = [np.concatenate([f[~again], n[keep]]) for f, n in zip(self.found, (of, value, which))]


def _prepared(vectors: DataFrame, label: Column, scale: float, key: str, vector: str) -> DataFrame:
    """(id, label, norm, v): rows that take part, whole components as doubles."""
    id_, of, value = unused([], "id", "label", "v")
    rows = vectors.select(column(key).cast("long").alias(id_), label.cast("long").alias(of), column(vector).cast("array<double>").alias(value))
    rows = rows.where("id is not null and label is not null and v is not null")

    def run(batches):
        for batch in batches:
            usable, x = scaled_vectors(batch.column("v"), scale)
            at = pa.array(usable)
            kind = "<i2" if np.abs(x).max(initial=0) < 2**15 else "<f8"  # a batch's rows take 2 or 8 bytes a component
            blobs = [kind[2].encode() + row.astype(kind).tobytes() for row in x]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("label").take(at), pa.array(np.sqrt((x * x).sum(axis=1))), pa.array(blobs, pa.binary())], ["id", "label", "norm", "v"])

    return rows.mapInArrow(run, "id long, label long, norm double, v binary")


def _matrix(blobs: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(b, "<i2" if b[:1] == b"2" else "<f8", offset=1) for b in blobs]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def norm_buckets(rows: DataFrame, width: int) -> DataFrame:
    """(label, ids, vectors): rows by label and falling norm, at most BUCKET to a bucket.

    Equal norms are split by hash of the id, so that a label or a norm that many
    rows share fills as many partitions as it needs."""
    dealt = rows.withColumn("h", F.xxhash64("id")).repartitionByRange(width, F.col("label"), F.col("norm").desc(), F.col("h"))
    dealt = dealt.sortWithinPartitions("label", F.col("norm").desc(), "id").select("id", "label", "v")

    def run(batches):
        label, ids, blobs = None, [], []
        schema = pa.schema([("label", pa.int64()), ("ids", pa.binary()), ("vectors", pa.list_(pa.binary()))])
        flush = lambda: batch_of(schema, label=[label], ids=[np.array(ids, "<i8").tobytes()], vectors=[blobs])
        for batch in batches:
            for i, of, v in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (of != label or len(ids) == BUCKET):
                    yield flush()
                    ids, blobs = [], []
                label = of
                ids.append(i)
                blobs.append(v)
        if ids:
            yield flush()

    return dealt.mapInArrow(run, "label long, ids binary, vectors array<binary>")


def _search(buckets: DataFrame, blocks: list[DataFrame], k: int, same: bool, name: str) -> DataFrame:
    """(anchor_id, place, score, id): the k best rows of each window.

    Blocks are tables (id, label, v, low, high), low and high a limit for each
    window; each goes out to all tasks of one scan of the buckets.  A task sends
    at most k rows a window to the merge."""
    spark = buckets.sparkSession
    schema = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])
    parts, waiting = [], []
    for n, block in enumerate(blocks):
        held = block.toArrow()  # BLOCK anchors or so
        ids, labels = held.column("id").to_numpy(), held.column("label").to_numpy()
        limits = [np.array(held.column(c).to_pylist(), np.int64).reshape(len(ids), -1 if len(ids) else 1) for c in ("low", "high")]
        shared = spark.sparkContext.broadcast((ids, labels, held.column("v").to_pylist(), *limits, k, same))

        def run(batches, shared=shared):
            ids, labels, blobs, *limits = shared.value
            search = WindowSearch(ids, labels, _matrix(blobs), *limits)
            for batch in batches:
                for label, found, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                    if len(ids):
                        search.offer(label, np.frombuffer(found, "<i8"), _matrix(vectors))
            window, score, which = search.found
            windows = max(1, search.least.shape[1])
            yield batch_of(schema, anchor_id=ids[window // windows], place=(window % windows).astype(np.int32), score=score, id=which)

        waiting.append(buckets.mapInArrow(run, "anchor_id long, place int, score long, id long"))
        if len(waiting) == AT_ONCE or n == len(blocks) - 1:
            parts.append(materialize(reduce(DataFrame.unionByName, waiting), name))
            waiting = []
    order = Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its integer inner product with the anchor, of components
    floor(scale * x).  An anchor's positives are its best other rows of the same
    label; for each of them the best rows of other labels count whose score is
    ``low`` to ``high`` hundredths of the positive's.  Ties go to the smaller id.

    Rows with a null id, label or vector, or a component null or not finite, take
    no part; shorter vectors count as filled up with zeros.  The rows of a
    repeated anchor id are one anchor (the one with the least vector and label),
    which meets no row of its own id; other repeated rows take a place each.
    Scores that a long cannot hold stay at its end.  No anchors, no positives or
    no rows within a window give no rows.
    """
    label = column("label") if label is None else label
    spark = vectors.sparkSession
    rows = materialize(_prepared(vectors, label, scale, key, vector), "negatives-rows")
    buckets = materialize(norm_buckets(rows, shuffle_width(spark, rows)), "negatives-buckets")
    marked = vectors.where(is_anchor).select(column(key).cast("long").alias("id")).where("id is not null").distinct()
    anchors = rows.join(marked, "id", "left_semi").groupBy("id").agg(F.min(F.struct("v", "label")).alias("r")).select("id", "r.label", "r.v")
    anchors = materialize(anchors, "negatives-anchors")
    n = max(1, -(-anchors.count() // BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(n))
    whole = lambda v: F.array(F.lit(v).cast("long"))
    free = anchors.withColumn("low", whole(_LEAST)).withColumn("high", whole(_MOST))
    first = _search(buckets, [free.where(block == b) for b in range(n)], positives, True, "negatives-positives")
    first = materialize(first.select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-windows")
    score = F.col("positive_score").cast("decimal(24,0)")
    bounded = first.select("*", F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))
    empty = F.struct(F.lit(_MOST).cast("long").alias("low"), F.lit(_LEAST).cast("long").alias("high"))
    listed = bounded.groupBy(F.col("anchor_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("low", "high")))).alias("m"))
    each = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda p: F.coalesce(F.element_at("m", p), empty))
    windows = anchors.join(listed, "id").withColumn("w", each).select("id", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    second = _search(buckets, [windows.where(block == b) for b in range(n)], negatives, False, "negatives-found")
    found = second.join(first, ["anchor_id", "place"])
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
