"""Near-duplicate lines by MinHash.

Distinct lines get MinHash signatures over character shingles, cut into bands;
lines that share a band are candidates, verified by the exact Jaccard
similarity of their shingle sets, and linked lines form components by
distributed union-find.  The first line of each component stays, in the order
of (doc_id, line number).

With 16 bands of 4 hashes a pair of similarity 0.75 is a candidate with
probability 0.998, one of 0.85 with 0.99999.  Lines of fewer characters than a
shingle are duplicates only of themselves; lines of white space alone are no
lines: they stay, and two line feeds around a removed line become one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavegrid.llm.common import batch_of, bucket_rows, column, discard, mapped, materialize, mix, shuffle_width, slices, span_hashes, text_bytes, unused
from stavegrid.llm.links import PAIR_SCHEMA, fetched, filtered, linked, members, pair_batches

SHINGLE = 8
BANDS, ROWS = 16, 4
SHARE = (75, 100)
_SALT = np.random.default_rng(11).integers(1, 1 << 31, (2, BANDS * ROWS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes or shingles that are worked on at once, so that they stay in the cache.
_CHUNK = 1 << 16
_POINT = np.uint64(0x1F83D9AB)
#: Hashes of the code points of the first plane.
_POINTS = mix(np.arange(1 << 16, dtype=np.uint64) + _POINT)


def line_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document and line number of all lines with a word."""
    n_docs = len(at) - 1
    feeds = np.flatnonzero(raw == 0x0A)
    before = np.searchsorted(feeds, at)  # line feeds before each document
    many = np.diff(before) + 1  # its lines
    first = np.cumsum(many) - many
    doc = np.repeat(np.arange(n_docs), many)
    starts, ends = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    opens = np.zeros(len(doc), bool)
    opens[first] = True
    closes = np.r_[opens[1:], True][: len(doc)]
    starts[opens], starts[~opens] = at[:-1], feeds + 1
    ends[closes], ends[~closes] = at[1:], feeds
    number = np.arange(len(doc)) - first[doc]
    some = ends > starts
    blank = np.flatnonzero(some)[_BLANK[raw[starts[some]]]]  # only lines that begin with white space can be white space alone
    for k in blank.tolist():
        some[k] = not _BLANK[raw[starts[k] : ends[k]]].all()
    return starts[some], ends[some], doc[some], number[some]


def _stretches(edge: np.ndarray, most: int):
    """Ranges of lines that hold about ``most`` of what ``edge`` sums up (one line at least)."""
    low, n = 0, len(edge) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(edge, edge[low] + most, "right")) - 1)
        yield low, high
        low = high


def _shingles_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = raw
    if len(raw) and raw.max() >= 0x80:
        points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        place = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        starts, ends = place[starts], place[ends]
    count = np.maximum(ends - starts - SHINGLE + 1, 0)
    if len(points) < SHINGLE:
        return np.zeros(0, np.uint64), count
    h = _POINTS[points] if points is raw or points.max() < len(_POINTS) else mix(points.astype(np.uint64) + _POINT)
    span = 1
    for factor in (0x9E6C63D0876A9A47, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9):
        longer = h[:-span] * np.uint64(factor)
        longer += h[span:]
        h = longer
        span *= 2
    turns = np.zeros(len(h) + 1, np.int8)
    some = count > 0
    turns[starts[some]] = 1
    turns[starts[some] + count[some]] -= 1
    return mix(h[np.cumsum(turns[:-1], dtype=np.int8).view(bool)]), count


def _character_shingles(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all lines end to end, and each line's count; lines ascend."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for low, high in _stretches(np.r_[starts, ends[-1:]], _CHUNK):
        base = starts[low]
        out.append(_shingles_of(raw[base : ends[high - 1]], starts[low:high] - base, ends[low:high] - base))
    shingles, count = zip(*out)
    return np.concatenate(shingles), np.concatenate(count)


def signatures(shingles: np.ndarray, count: np.ndarray) -> np.ndarray:
    """MinHash signatures (lines x BANDS * ROWS); each line has a shingle."""
    out = np.empty((len(count), BANDS * ROWS), np.uint32)
    edge = np.r_[0, np.cumsum(count)]
    for low, high in _stretches(edge, _CHUNK):
        h = (shingles[edge[low] : edge[high]] >> np.uint64(32)).astype(np.uint32)
        where = edge[low:high] - edge[low]
        turned = np.empty_like(h)
        for k in range(BANDS * ROWS):
            np.multiply(h, _SALT[0, k], out=turned)
            turned += _SALT[1, k]
            out[low:high, k] = np.minimum.reduceat(turned, where)
    return out


def _sizes(shingles: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many different shingles each line has (65535 at most, which admits no fewer pairs)."""
    out = np.zeros(len(count), np.int64)
    edge = np.r_[0, np.cumsum(count)]
    for low, high in _stretches(edge, _CHUNK):
        z = np.repeat(np.arange(high - low, dtype=np.uint64) << np.uint64(44), count[low:high])
        z |= shingles[edge[low] : edge[high]] >> np.uint64(20)
        z.sort()
        z = z[np.r_[True, z[1:] != z[:-1]]] if len(z) else z
        out[low:high] = np.bincount((z >> np.uint64(44)).astype(np.int64), minlength=high - low)
    return np.minimum(out, 65535)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """lines x BANDS hashes."""
    out = np.empty((len(signature), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(signature), band + 1, np.uint64)
        for k in range(ROWS):
            h = mix(h * np.uint64(0x9E6C63D0876A9A47) + signature[:, band * ROWS + k].astype(np.uint64))
        out[:, band] = h
    return out


def line_sets(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a column of lines end to end, and where each line's begin."""
    raw, at = text_bytes(lines)
    shingles, count = _character_shingles(raw, at[:-1], at[1:])
    return shingles, np.r_[0, np.cumsum(count)]


def _new_lines(batches):
    """Of each slice: raw bytes, spans and keys of lines the task has not met."""
    seen: set[int] = set()
    for whole in batches:
        for batch in slices(whole, "text"):
            raw, at = text_bytes(batch.column("text"))
            starts, ends, _, _ = line_spans(raw, at)
            every = span_hashes(raw, starts, ends)
            keys, where = np.unique(every, return_index=True)
            fresh = np.fromiter((k not in seen for k in keys.tolist()), bool, len(keys))
            seen.update(keys[fresh].tolist())
            where = np.sort(where[fresh])
            if len(where):
                yield raw, starts[where], ends[where], every[where]


def line_components(texts: DataFrame) -> DataFrame:
    """(node, root) of lines, by key, that have a near duplicate."""
    spark = texts.sparkSession
    buckets = shuffle_width(spark, texts)
    entry = [("h", "<u4"), ("n", "<u2"), ("key", "<i8")]
    sent = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])

    def deal(batches):
        def flush():
            h = np.concatenate([b.ravel() for b, _, _ in held])
            entries = np.empty(len(h), entry)
            entries["h"], entries["key"] = h & np.uint64(0xFFFFFFFF), np.repeat(np.concatenate([k for _, k, _ in held]), BANDS)
            entries["n"] = np.repeat(np.concatenate([c for _, _, c in held]), BANDS)
            out = list(bucket_rows(entries, ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), buckets))
            return batch_of(sent, bucket=[b for b, _ in out], entries=[e for _, e in out])

        held, n = [], 0
        for raw, starts, ends, keys in _new_lines(batches):
            shingles, count = _character_shingles(raw, starts, ends)
            some = count > 0
            if some.any():
                held.append((band_hashes(signatures(shingles, count[some])), keys[some].view(np.int64), _sizes(shingles, count[some])))
                n += int(some.sum())
            if n > 1 << 17:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def meet(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            for b, entries in zip(*(c.to_pylist() for c in batch.columns)):
                parts.setdefault(b, []).append(np.frombuffer(entries, entry))
        while parts:
            b, own = parts.popitem()
            own = np.concatenate(own)
            records = np.zeros(len(own), [("h", "<u4"), ("key", "<i8"), ("n", "<u4"), ("pos", "<u4")])
            records["h"], records["key"], records["n"] = own["h"], own["key"], own["n"]
            yield from pair_batches(b, records, SHARE)

    pairs = texts.mapInArrow(deal, "bucket int, entries binary").repartition(buckets, "bucket").mapInArrow(meet, PAIR_SCHEMA)
    schema = pa.schema([("key", pa.int64()), ("elements", pa.binary())])

    def lines_of(bits):
        shared = spark.sparkContext.broadcast(bits)

        def run(batches):
            for raw, starts, ends, keys in _new_lines(batches):
                keys = keys.view(np.int64)
                want = filtered(shared.value, keys)
                if not want.any():
                    continue
                lines = [raw[a:b].tobytes() for a, b in zip(starts[want], ends[want])]
                yield batch_of(schema, key=keys[want], elements=lines)

        return texts.mapInArrow(run, "key long, elements binary")

    rows = materialize(pairs, "bands")
    lines = fetched(members(rows), lines_of, "texts")
    roots = linked(rows, lines, line_sets, SHARE, 16)
    discard(rows, lines)
    return roots


_LINE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("number", pa.int32()), ("key", pa.int64())])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, numbers): lines of ``docs`` (doc_id, text,
    text_hash) that are not the first of their component."""

    def lines(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, at = text_bytes(batch.column("text"))
                starts, ends, doc, number = line_spans(raw, at)
                which = pa.array(doc)
                yield batch_of(_LINE, doc_id=batch.column("doc_id").take(which), text_hash=batch.column("text_hash").take(which), number=number.astype(np.int32), key=span_hashes(raw, starts, ends).view(np.int64))

    every = materialize(docs.mapInArrow(lines, "doc_id long, text_hash long, number int, key long"), "lines")
    roots = line_components(docs.select("text"))
    # a line that occurs once and has no near duplicate stays, so only the others are ranked
    groups = every.groupBy("key").agg(F.count("*").alias("n")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    # written by itself, so that a very common line's rows can be split in the join
    groups = materialize(groups.where("n > 1 OR root IS NOT NULL").select("key", F.coalesce("root", "key").alias("root")), "groups")
    again = materialize(every.join(groups.hint("merge"), "key").drop("key"), "again")
    discard(every, groups)
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash", "number")
    leads = again.groupBy("root").agg(F.min(rank).alias("lead"))
    later = again.join(leads, "root").where(rank != F.col("lead"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("number").alias("numbers"))


def with_repeats(docs: DataFrame, text: str, key: str, numbers: str) -> DataFrame:
    """``docs`` with a column ``numbers``: line numbers to remove, null if none."""
    own, of, its = unused([*docs.columns, numbers], "own_hash", "line_id", "line_hash")
    whole, id_ = column(text).cast("string"), column(key).cast("long")
    hashed = docs.withColumn(own, F.xxhash64(F.coalesce(whole, F.lit(""))))
    found = repeated_lines(hashed.select(id_.alias("doc_id"), whole.alias("text"), column(own).alias("text_hash")))
    found = found.select(F.col("doc_id").alias(of), F.col("text_hash").alias(its), F.col("numbers").alias(numbers))
    same = id_.eqNullSafe(F.col(of)) & (F.col(own) == F.col(its))
    # the same plan at all sizes: what is found outgrows a broadcast
    return hashed.join(found.hint("merge"), same, "left").select(*[column(c) for c in docs.columns], numbers)


def _cut(text: str | None, numbers) -> str | None:
    if not numbers:
        return text
    gone = set(numbers)
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", drop_empty: bool = True) -> DataFrame:
    """``docs`` without repeated lines; all columns stay.

    A document that loses its last word to this goes as a whole, unless
    ``drop_empty`` is false; one that had none to begin with stays as it is.
    Order: doc_id (null comes last), text hash among repeated ids, line number.
    Fully equal rows are one document: both keep or lose the same lines.
    """
    names, at = docs.columns, docs.columns.index(text)
    rows = with_repeats(docs, text, key, *unused(names, "gone_lines"))

    def run(batches):
        for batch in batches:
            numbers = batch.column(len(names)).to_pylist()
            out = [_cut(t, n) for t, n in zip(batch.column(at).to_pylist(), numbers)]
            keep = pa.array([not (drop_empty and n and not t.strip(" \t\n\v\f\r")) for t, n in zip(out, numbers)], pa.bool_())
            columns = [pa.array(out, batch.column(k).type) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(len(names))]).filter(keep)

    return mapped(rows, run, docs.schema)


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, kept_sha256 of the text left."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            texts, numbers = batch.column("text").to_pylist(), batch.column("numbers").to_pylist()
            lines = [sum(1 for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")) for t in texts]
            kept = [hashlib.sha256((_cut(t, n) or "").encode("utf-8", "surrogatepass")).hexdigest() for t, n in zip(texts, numbers)]
            yield batch_of(schema, doc_id=batch.column("doc_id"), n_lines=lines, n_removed=[len(n or ()) for n in numbers], kept_sha256=kept)

    rows = with_repeats(docs.select(column(key).cast("long").alias("doc_id"), column(text).cast("string").alias("text")), "text", "doc_id", "numbers")
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")
