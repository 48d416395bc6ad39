"""Packing along a space-filling curve.

A document's hashed vector is the sum of pseudo-random code rows of its token
ids, scaled by the square root of its length: a random projection of its
bag-of-tokens vector to a few dimensions.  Its place on a Hilbert curve through
that space is its sort key, so that documents alike are neighbours.  The token
stream along the curve is cut every ``length`` ids: only the very last sequence
can be short.

One small pass finds key ranges of like numbers of ids and the ids before each; the
second pass deals ids by range, sorts each range and cuts it on its own.
Texts are tokenized in both, which costs less than keeping all ids in the
shared folder between them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavegrid.llm.common import batch_of, column, discard, materialize, shuffle_width, slices
from stavegrid.llm.tokens import byte_level_encoding

DIMENSIONS, BITS = 4, 10
#: Edges to choose from for each range of ids.
_FINER = 8


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows), each 0 to 2**bits - 1.

    Works on the transposed key: fold the quadrants from the top bit down,
    Gray-decode, then interleave the coordinates' bits.
    """
    x = points.T.astype(np.int64).copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        top = np.int64(1) << level
        low = top - 1
        for i in range(n):
            flip = (x[i] & top) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        carry ^= np.where(x[n - 1] >> level & 1 > 0, (np.int64(1) << level) - 1, 0)
    x ^= carry
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> level & 1)
    return key


def _codes(size: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((DIMENSIONS, size)).astype(np.float32)


def curve_keys(ids: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given their ids end to end; empty ones get the origin's."""
    count = np.diff(at)
    some = count > 0
    total = np.zeros((len(count), DIMENSIONS))
    if some.any():
        for d in range(DIMENSIONS):
            total[some, d] = np.add.reduceat(codes[d][ids], at[:-1][some], dtype=np.float64)
    spread = total / np.sqrt(np.maximum(count, 1))[:, None] / 8
    return hilbert_keys(np.clip((np.tanh(spread) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def pack(docs: DataFrame, path: str, length: int = 2048, end: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian
    uint32), doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone.  Null or repeated keys are rows
    like any other; equal keys of equal documents are told apart by nothing
    and share no piece.  Other columns are not carried.
    """
    spark = docs.sparkSession
    rows = docs.select(column(key).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    parts = max(2, shuffle_width(spark, rows))
    low = -(1 << 63)

    def tokenized(batches):
        encoding = byte_level_encoding(path)
        codes = _codes(encoding.max_token_value + 1)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [encoding.encode_to_numpy(t or "", allowed_special="all") for t in batch.column("text").to_pylist()]
                at = np.r_[0, np.cumsum([len(f) for f in found])]
                yield batch.column("doc_id"), found, curve_keys(np.concatenate(found), at, codes)

    def keys(batches):
        schema = pa.schema([("doc", pa.int64()), ("curve", pa.int64()), ("n", pa.int64())])
        for doc, found, curve in tokenized(batches):
            yield batch_of(schema, doc=doc.fill_null(low), curve=curve, n=[len(f) + 1 for f in found])

    small = materialize(rows.mapInArrow(keys, "doc long, curve long, n long"), "keys")  # else sampling the ranges tokenizes again
    every = small.agg(F.sum("n")).first()[0] or 0
    edges, before = _ranges(small, parts, max(1, every // (_FINER * parts)))
    discard(small)
    homes = _homes(spark, parts)

    def deal(batches):
        from bisect import bisect_right

        schema = pa.schema([("home", pa.int32()), ("part", pa.int32()), ("wide", pa.bool_()), ("curve", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
        for doc, found, curve in tokenized(batches):
            place = [max(0, bisect_right(edges, (c, low if d is None else d)) - 1) for c, d in zip(curve.tolist(), doc.to_pylist())]
            kind = "<u2" if byte_level_encoding(path).max_token_value < 1 << 16 and end < 1 << 16 else "<u4"
            yield batch_of(schema, home=[homes[k] for k in place], part=place, wide=[kind == "<u4"] * len(place), curve=curve, doc_id=doc, ids=[np.append(f, end).astype(kind).tobytes() for f in found])

    def cut(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        here, position = None, 0
        for batch in batches:
            out: list[tuple] = []
            for part, wide, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "wide", "doc_id", "ids"))):
                if part != here:
                    here, position = part, before[part]
                ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    take = min(len(ids) - start, length - position % length)
                    out.append((doc, start, take, ids[start : start + take].tobytes(), len(ids), position // length, position % length))
                    start, position = start + take, position + take
                if len(out) >= 2000:
                    yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*out)))))
                    out = []
            if out:
                yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*out)))))

    dealt = rows.mapInArrow(deal, "home int, part int, wide boolean, curve long, doc_id long, ids binary").repartition(parts, "home")
    dealt = dealt.sortWithinPartitions("part", "curve", F.col("doc_id").asc_nulls_first(), F.octet_length("ids"), "ids")
    return dealt.select("part", "wide", "doc_id", "ids").mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _ranges(small: DataFrame, parts: int, quantum: int) -> tuple[list[tuple[int, int]], list[int]]:
    """First (curve, doc) of each range of about equal ids along the curve, and
    the ids before it.  Rows are dealt in ranges of equal rows, each of which
    names a possible edge after every ``quantum`` ids; the driver gets a few
    edges for each part."""
    schema = pa.schema([("range", pa.int32()), ("curve", pa.int64()), ("doc", pa.int64()), ("n", pa.int64())])

    def mark(batches):
        open_, held, last = None, 0, None
        for batch in batches:
            for r, c, d, n in zip(*(batch.column(k).to_pylist() for k in ("range", "curve", "doc", "n"))):
                if held >= quantum and (c, d) != last:
                    yield batch_of(schema, range=[open_[0]], curve=[open_[1]], doc=[open_[2]], n=[held])
                    held = 0
                if not held:
                    open_ = (r, c, d)
                held, last = held + n, (c, d)
        if held:
            yield batch_of(schema, range=[open_[0]], curve=[open_[1]], doc=[open_[2]], n=[held])

    fine = small.repartitionByRange(parts, "curve", "doc").withColumn("range", F.spark_partition_id()).sortWithinPartitions("curve", "doc")
    found = sorted(map(tuple, fine.select("range", "curve", "doc", "n").mapInArrow(mark, "range int, curve long, doc long, n long").collect()))
    share = sum(n for *_, n in found) / parts
    edges, before, total = [], [], 0
    for _, c, d, n in found:
        if total >= share * len(edges):  # ids before it reach the next part's share
            edges.append((c, d))
            before.append(total)
        total += n
    return edges, before


def _homes(spark, parts: int) -> list[int]:
    """A number for each partition that hash partitioning puts there, so that no two ranges meet in one task."""
    out: dict[int, int] = {}
    begin = 0
    while len(out) < parts:
        some = spark.range(begin, begin + 16 * parts).select(F.col("id").cast("int").alias("k"))
        for r in some.select("k", F.pmod(F.hash("k"), F.lit(parts)).alias("p")).collect():  # a few for each partition
            out.setdefault(r.p, r.k)
        begin += 16 * parts
    return [out[p] for p in range(parts)]
