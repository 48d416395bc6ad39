"""Exact n-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are distinct shingle sets, columns are shingles.
Two sets can reach the similarity only if they share a column among their
first n - need + 1 in one common order, so only these entries enter the
product of column blocks.  Where up to SMALL rows share a column, it names the
row pairs that their sizes and the entries' places admit; where more do, each
row and one pivot.  Rows of a column that these pairs leave in different
components meet as a block of rows, in which the product over all columns is
accumulated.  Pairs below the bound that their sizes imply are discarded.
Columns that HOT sets hold, counted over all entries, come last in the order:
a passage that many texts quote admits a pair only if it is most of both.  See
``links``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavegrid.llm.common import batch_of, bucket_rows, column, discard, in_filter, materialize, mix, repeat_filter, shuffle_width, slices, unused, window_hashes, word_hashes
from stavegrid.llm.links import PAIR_SCHEMA, SMALL, fetched, filtered, linked, members, pair_batches

WIDTH = 5
SHARE = (75, 100)
#: A column that so many sets hold goes last.
HOT = 32
#: Bytes of a shingle's hash that are kept to count overlaps.
_KEPT = 5


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Letters A-Z are folded.  A text with fewer words than the width has its
    whole sequence as one shingle; one without words has none.
    """
    words, first = word_hashes(column, lower=True)
    every = window_hashes(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            x = np.sort(every[a : b - width + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif b > a:
            out.append(mix(window_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(elements: np.ndarray) -> int:
    """64-bit name of a set; equal sets have equal names."""
    total = int(mix(elements + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) + len(elements) * 0x9E3779B97F4A7C15
    return int(mix(np.array([total & (1 << 64) - 1], np.uint64)).view(np.int64)[0])


def _distinct_sets(batches, width):
    """(key, set) of each set that the task meets for the first time."""
    seen: set[int] = set()
    for whole in batches:
        for batch in slices(whole, "text"):
            for x in shingle_sets(batch.column("text"), width):
                if len(x) and (k := set_key(x)) not in seen:
                    seen.add(k)
                    yield k, x


def _head(n: int, share) -> int:
    return n - -(-share[0] * n // share[1]) + 1


def joined(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, share: tuple[int, int] = SHARE) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): rows has each document's doc_id, text_hash, n_shingles and
    set name ``cls`` (null without words); roots has (node, root) for linked sets.

    Null texts have no words.  Repeated rows and equal sets share a name; null
    keys are kept.
    """
    spark = docs.sparkSession
    whole = column(text).cast("string")
    texts = docs.select(whole.alias("text"))
    named = docs.select(column(key).cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(F.coalesce(whole, F.lit(""))).alias("text_hash"))
    buckets = max(64, shuffle_width(spark, texts))
    row_schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64())])

    def name(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), width)
                yield batch_of(row_schema, doc_id=batch.column("doc_id"), text_hash=batch.column("text_hash"), n_shingles=[len(x) for x in sets], cls=[set_key(x) if len(x) else None for x in sets])

    rows = materialize(named.mapInArrow(name, "doc_id long, text_hash long, n_shingles long, cls long"), "sets")

    def entries(batches):
        held, size = [], 0
        for _, x in _distinct_sets(batches, width):
            held.append(x)
            size += len(x)
            if size > 1 << 21:
                yield np.concatenate(held)
                held, size = [], 0
        if held:
            yield np.concatenate(held)

    hot = spark.sparkContext.broadcast(repeat_filter(texts, entries, HOT))

    def head(x):
        """The entries that enter the product, hot columns last."""
        late = in_filter(hot.value, x)
        return np.concatenate([x[~late], x[late]])[: _head(len(x), share)]

    table = [("key", "<i8"), ("n", "<u4")]
    entry = [("h", "<u4"), ("row", "<u2"), ("pos", "<u2")]
    sent = pa.schema([("bucket", pa.int32()), ("entries", pa.binary()), ("rows", pa.binary())])

    def deal(batches):
        def flush():
            h, row, pos = (np.concatenate(p) for p in zip(*held))
            entries = np.empty(len(h), entry)
            entries["h"], entries["row"], entries["pos"] = h & np.uint64(0xFFFFFFFF), row, np.minimum(pos, 65535)
            names = np.array(keys, table)
            out = []
            for b, blob in bucket_rows(entries, ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), buckets):
                own = np.frombuffer(blob, entry).copy()
                used, own["row"] = np.unique(own["row"], return_inverse=True)
                out.append((b, own.tobytes(), names[used].tobytes()))
            return batch_of(sent, **dict(zip(sent.names, map(list, zip(*out)))))

        held, keys, size = [], [], 0
        for k, x in _distinct_sets(batches, width):
            first = head(x)
            held.append((first, np.full(len(first), len(keys), np.uint16), np.arange(len(first))))
            keys.append((k, len(x)))
            size += len(first)
            if size > 3 << 20 or len(keys) == 65000:
                yield flush()
                held, keys, size = [], [], 0
        if held:
            yield flush()

    def multiply(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, entries, names in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(b, []).append((np.frombuffer(entries, entry), np.frombuffer(names, table)))
        while held:
            b, parts = held.popitem()
            records = np.empty(sum(len(e) for e, _ in parts), [("h", "<u4"), ("key", "<i8"), ("n", "<u4"), ("pos", "<u4")])
            at = 0
            for e, t in parts:
                own = records[at : at + len(e)]
                own["h"], own["pos"] = e["h"], e["pos"]
                own["key"], own["n"] = t["key"][e["row"]], t["n"][e["row"]]
                at += len(e)
            yield from pair_batches(b, records, share)

    pairs = texts.mapInArrow(deal, "bucket int, entries binary, rows binary").repartition(shuffle_width(spark, texts), "bucket").mapInArrow(multiply, PAIR_SCHEMA)
    pairs = materialize(pairs, "overlaps")
    element_schema = pa.schema([("key", pa.int64()), ("elements", pa.binary())])

    def sets_of(bits):
        shared = spark.sparkContext.broadcast(bits)

        def run(batches):
            keys, elements, size = [], [], 0
            for k, x in _distinct_sets(batches, width):
                if filtered(shared.value, np.array([k], np.int64))[0]:
                    keys.append(k)
                    elements.append(_short(x))
                    size += len(elements[-1])
                if size > 4 << 20:
                    yield batch_of(element_schema, key=keys, elements=elements)
                    keys, elements, size = [], [], 0
            yield batch_of(element_schema, key=keys, elements=elements)

        return texts.mapInArrow(run, "key long, elements binary")

    sets = fetched(members(pairs), sets_of, "wholes")
    roots = linked(pairs, sets, _long, share, SMALL)
    discard(pairs, sets)
    return rows, roots


def _short(x: np.ndarray) -> bytes:
    """The leading bytes of each hash."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :_KEPT].tobytes()


def _long(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a column of ``_short`` sets, and where each set begins."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(-1, _KEPT)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :_KEPT] = raw
    return out.view(">u8").ravel().astype(np.uint64), (at - at[0]) // _KEPT


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    component_id: the smallest doc_id reachable by links, its own included; a
    document without words is alone.  A null doc_id never names a component
    unless all its members' are null.
    """
    rows, roots = joined(docs, text, key, width, share)
    least = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    group = least.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = group.groupBy("root").agg(F.min("least").alias("component_id"))
    named = group.join(ids, "root").select("cls", "component_id")
    return rows.join(named, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest
    doc_id (null comes last), with its copies in repeated rows of that id and
    text.  Documents without words all stay.  All columns stay, whatever their
    names.
    """
    rows, roots = joined(docs, text, key)
    # rows are named by content, so a set's name finds its texts again
    rank = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("text_hash"))
    named = rows.where("cls is not null").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    first = named.groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min(rank).alias("first")).select("first.*")
    keep = first.select("doc_id", "text_hash").unionByName(rows.where("cls is null").select("doc_id", "text_hash").distinct())
    own, of, its = unused(docs.columns, "own_hash", "kept_id", "kept_hash")
    keep = keep.select(F.col("doc_id").alias(of), F.col("text_hash").alias(its))
    hashed = docs.withColumn(own, F.xxhash64(F.coalesce(column(text).cast("string"), F.lit(""))))
    same = column(key).cast("long").eqNullSafe(F.col(of)) & (F.col(own) == F.col(its))
    return hashed.join(keep, same, "left_semi").select([column(c) for c in docs.columns])
