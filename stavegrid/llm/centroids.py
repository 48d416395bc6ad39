"""Centroids of integer vectors, screened in float32 and decided exactly.

An assignment compares |c|**2 - 2 x.c over the centroids.  The products come
from one float32 matrix product; the error of such a product of d components is
at most gamma * |x| * |c| with gamma = m*u / (1 - m*u), u = 2**-24 and m = d + 4,
in whatever order it is added up and with the inputs themselves rounded.  That
gives each centroid an interval.  A vector whose least interval meets no other
is assigned; for the rest the centroids of the meeting intervals are compared
in exact integers, and the smaller number wins a tie.

A round is one job: tasks add up their own vectors by centroid, and the driver
gets k * (d + 2) sums.  Sums travel as 32-bit digits, so they stay exact however
large the components are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavegrid.llm.common import batch_of, column, materialize

_UNIT = 2.0**-24
_ROWS = 8192
_LONG = 2**63 - 1


def pack_vectors(x: np.ndarray) -> pa.Array:
    """A binary value for each row of whole numbers: 32-bit integers, or doubles where those are too small."""
    kind = "<i4" if np.abs(x).max(initial=0) < 2**31 else "<f8"
    data, size = x.astype(kind).tobytes(), x.shape[1] * int(kind[2])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1, dtype=np.int64) * size).tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def unpack_vectors(values: pa.Array, d: int) -> np.ndarray:
    """The rows of :func:`pack_vectors` as doubles; a batch may hold both kinds."""
    blobs = values.to_pylist()
    if all(len(b) == 4 * d for b in blobs):
        return np.frombuffer(b"".join(blobs), "<i4").reshape(-1, d).astype(float)
    return np.array([np.frombuffer(b, "<i4" if len(b) == 4 * d else "<f8").astype(float) for b in blobs]).reshape(-1, d)


def whole_vectors(vectors: DataFrame, d: int, scale: float, key: str, vector: str) -> DataFrame:
    """(id, v): floor(scale * x) of the vectors with d components, none null or not
    finite (times ``scale``, as a double)."""
    value = column(vector).cast("array<double>")
    usable = value.isNotNull() & (F.size(value) == d) & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))

    def run(batches):
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pack_vectors(np.floor(scale * x))], ["id", "v"])

    return vectors.where(usable).select(column(key).cast("long").alias("id"), value.alias("v")).mapInArrow(run, "id long, v binary")


def exact_distances(x: np.ndarray, centroids: list[list[int]], of: np.ndarray) -> list[int] | np.ndarray:
    """Squared distance of each row to the centroid ``of`` names for it, in whole numbers."""
    if not len(x):
        return np.zeros(0, np.int64)
    most = int(np.abs(x).max()) + max(abs(v) for c in centroids for v in c)
    if x.shape[1] * most * most < 2**63:
        gap = x.astype(np.int64) - np.array(centroids, np.int64)[of]
        return np.einsum("ij,ij->i", gap, gap)
    return [sum((int(a) - b) ** 2 for a, b in zip(row, centroids[k])) for row, k in zip(x.tolist(), of.tolist())]


class Screen:
    """Assignment to the nearest of some centroids.  ``asked`` and ``unsure``
    count the vectors met and those that float32 alone did not decide."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = centroids
        near = np.array(centroids, float)
        squares = [sum(v * v for v in c) for c in centroids]
        self.square = np.array([float(s) if s < 1 << 1023 else np.inf for s in squares])
        self.length = np.sqrt(self.square) * (1 + 2.0**-40)
        with np.errstate(over="ignore"):
            self.single = near.astype(np.float32).T.copy()
        self.asked = self.unsure = 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        if len(self.exact) == 1 or not len(x):
            self.asked += len(x)
            return np.zeros(len(x), np.int64)
        m = x.shape[1] + 4
        gamma = m * _UNIT / (1 - m * _UNIT)
        with np.errstate(over="ignore", invalid="ignore"):
            product = (x.astype(np.float32) @ self.single).astype(float)
            reach = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] * (1 + 2.0**-40) * self.length
            wide = 2 * gamma * reach + 2.0**-50 * (self.square + 2 * reach)
            middle = self.square - 2 * product
            low, high = middle - wide, middle + wide
        lost = ~(np.isfinite(low) & np.isfinite(high))  # beyond float32: nothing is known
        low[lost], high[lost] = -np.inf, np.inf
        open_ = low <= high.min(axis=1)[:, None]
        best = np.argmin(low, axis=1)
        unsure = np.flatnonzero(open_.sum(axis=1) > 1)
        self.asked, self.unsure = self.asked + len(x), self.unsure + len(unsure)
        if len(unsure):
            row, k = np.nonzero(open_[unsure])
            distance = exact_distances(x[unsure[row]], self.exact, k)
            order = sorted(range(len(row)), key=lambda i: (row[i], distance[i], k[i])) if isinstance(distance, list) else np.lexsort((k, distance, row))
            order = np.asarray(order)
            first = np.flatnonzero(np.r_[True, row[order][1:] != row[order][:-1]])
            best[unsure[row[order][first]]] = k[order][first]
        return best


def _digits(value: int):
    """(place, digit) in base 2**32, the last digit with the sign."""
    place = 0
    while not -(2**31) <= value < 2**31:
        yield place, value & 0xFFFFFFFF
        value, place = value >> 32, place + 1
    if value or not place:
        yield place, value


def _add_up(totals: list[list[int]], x: np.ndarray, of: np.ndarray, distance) -> None:
    """Add the rows, their number and their distances to their centroids' totals."""
    small = np.abs(x).max(initial=0) * len(x) < 2**53
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(len(totals) + 1))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if a == b:
            continue
        rows = x[order[a:b]]
        sums = [int(v) for v in rows.sum(axis=0)] if small else [sum(int(v) for v in c) for c in rows.T.tolist()]
        for j, v in enumerate([*sums, int(b - a), sum(int(distance[i]) for i in order[a:b])]):
            totals[k][j] += v


def totals(rows: DataFrame, d: int, centroids: list[list[int]], measured: bool) -> list[list[int]]:
    """For each centroid the sums of its vectors' components, their number and
    (if ``measured``) the sum of their distances: one job, k * (d + 2) numbers."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)
    schema = pa.schema([("k", pa.int32()), ("j", pa.int32()), ("place", pa.int32()), ("digit", pa.int64())])

    def run(batches):
        screen = Screen(held.value)
        own = [[0] * (d + 2) for _ in held.value]
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                x = unpack_vectors(batch.column("v").slice(at, _ROWS), d)
                of = screen.assign(x)
                _add_up(own, x, of, exact_distances(x, held.value, of) if measured else np.zeros(len(x), np.int64))
        out = [(k, j, place, digit) for k, row in enumerate(own) if row[d] for j, v in enumerate(row) for place, digit in _digits(v)]
        if out:
            yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*out)))))

    sums = [[0] * (d + 2) for _ in centroids]
    dealt = rows.mapInArrow(run, "k int, j int, place int, digit long")
    for r in dealt.groupBy("k", "j", "place").agg(F.sum("digit").alias("digit")).collect():  # k * (d + 2) sums
        sums[r.k][r.j] += r.digit << (32 * r.place)
    return sums


def first_centroids(rows: DataFrame, d: int, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes, in that order; null ids
    come last, and equal ids go by their vectors."""
    hashed = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    return [[int(x) for x in unpack_vectors(pa.array([bytes(r.v)]), d)[0]] for r in hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, d: int = 64, scale: float = 1024.0, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of
    every vector with exactly ``d`` usable components.

    Components are floor(scale * x).  Centroids start as the vectors with the
    smallest hashes of ``seed:id``, all vectors if there are fewer than k; each
    round assigns all vectors and replaces the centroids that have any by the
    floors of their means; then vectors are assigned once more.  Repeated rows
    count each time, null ids are rows like any other, ties go to the smaller
    number, other columns play no part.  Distances and their sums that a long
    cannot hold stay at its end.  No usable vectors give no rows.

    The vectors are written once, in whole numbers; every round reads them.
    """
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = materialize(whole_vectors(vectors, d, scale, key, vector), "centroids")
    centroids = first_centroids(rows, d, k, seed)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], names)
    for _ in range(rounds):
        sums = totals(rows, d, centroids, False)
        centroids = [[v // row[d] for v in row[:d]] if row[d] else c for c, row in zip(centroids, sums)]
    own = [row[d + 1] for row in totals(rows, d, centroids, True)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    held = vectors.sparkSession.sparkContext.broadcast((centroids, [min(v, _LONG) for v in own], min(sum(own), _LONG), digests))
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string())])

    def run(batches):
        centers, each, inertia, sha = held.value
        screen = Screen(centers)
        each, sha = np.array(each, np.int64), np.array(sha, object)
        for batch in batches:
            x = unpack_vectors(batch.column("v"), d)
            of = screen.assign(x)
            distance = [min(int(v), _LONG) for v in exact_distances(x, centers, of)]
            yield batch_of(schema, vec_id=batch.column("id"), cluster=of.astype(np.int32), distance=distance, cluster_inertia=each[of], inertia=np.full(len(of), inertia), centroid_sha256=sha[of])

    return rows.mapInArrow(run, names)
