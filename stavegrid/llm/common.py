"""Shared pieces of the corpus operators: durable cut points, Arrow slicing,
vectorised word hashing and hash-partitioned blobs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Text bytes handled at once by a Python worker; bounds its memory.
SLICE_BYTES = 2 << 20
_BLOCK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


# ----------------------------------------------------------------- durability
def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent on one machine (tests) is a folder made;
    on a cluster it has to be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = known or "file://" + tempfile.mkdtemp(prefix="stavegrid-")
        if not known:
            spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    This cuts the lineage with a copy that outlives any executor, and later
    reads fetch only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()  # Spark deletes the files of shuffles that nothing refers to any more only then
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` returned, once no lazy result reads them."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a source table that one shuffle partition stands for, where the session asks for fewer partitions.
PARTITION_BYTES = 64 << 20


def shuffle_width(spark: SparkSession, source: DataFrame | None = None) -> int:
    """The session's number of shuffle partitions, or as many as the size of
    ``source`` asks for (where Spark knows it), so that a partition's share of
    the input is bounded."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if source is not None:
        size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if size < 1 << 60:  # larger: not known
            width = max(width, -(-size // PARTITION_BYTES))
    return width


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be no
    column's name, in any letter case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def mapped(rows: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` for columns of any name: batches have
    their places for names, which mapInArrow would not find with a dot in them."""
    places = StructType([StructField(str(k), f.dataType, f.nullable) for k, f in enumerate(schema.fields)])
    return rows.toDF(*map(str, range(len(rows.columns)))).mapInArrow(run, places).toDF(*schema.names)


# -------------------------------------------------------------------- batches
def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` text bytes each (one row at least)."""
    _, at = text_bytes(batch.column(text))
    low, n = 0, batch.num_rows
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


# ---------------------------------------------------------------- word hashes
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _BLOCK_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), ascending and disjoint."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _BLOCK_BYTES, "right")))
        base, top = int(starts[low]), int(ends[high - 1])
        up, down = _power_tables(top - base + 1)
        run = np.zeros(top - base + 1, np.uint64)
        np.cumsum(_BYTE_CODES[raw[base:top]] * up[: top - base], out=run[1:])
        s, e = starts[low:high] - base, ends[low:high] - base
        out[low:high] = (run[e] - run[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        low = high
    return mix(out)


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each
    document the index of its first word (n + 1 entries)."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~_SEPARATOR[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column of texts, and each text's first word.

    ``lower`` folds the letters A-Z only.
    """
    raw, at = text_bytes(column)
    starts, ends, first = word_spans(raw, at)
    return span_hashes(_LOWER[raw] if lower else raw, starts, ends), first


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one sequence of word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total *= np.uint64(0x9E6C63D0876A9A47)
        total += words[k : k + n]
    return mix(total)


# ---------------------------------------------------------------------- blobs
def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of runs laid end to end."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts.astype(np.int64) - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def bucket_rows(records: np.ndarray, bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, bytes) of the records of each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    held = records[order]
    for k in np.flatnonzero(edges[1:] > edges[:-1]):
        yield int(k), held[edges[k] : edges[k + 1]].tobytes()


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


# ----------------------------------------------------------- repeated hashes
def repeat_filter(
    hashed: DataFrame, emit: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], least: int, log2_bits: int = 27
) -> np.ndarray:
    """A bit for each 64-bit hash that is emitted at least ``least`` times (255 at most).

    ``emit`` turns a task's batches into arrays of hashes.  They are dealt by
    bit range, so each task of the second stage counts whole keys and returns
    its own slice of the bit map: the driver gets exactly 2**log2_bits bits
    whatever the input.  A hash is sent as 32 bits besides its part, and a set
    bit may be shared by other hashes, so it means "perhaps"; users must not
    depend on a clear answer for correctness.
    """
    spark = hashed.sparkSession
    split = max(4, min(12, int(np.ceil(np.log2(2 * shuffle_width(spark))))))  # bits that name a part
    parts, bits = 1 << split, max(log2_bits, split + 3)
    shift_part, shift_low = np.uint64(64 - split), np.uint64(32 - split)
    sent, got = pa.schema([("part", pa.int32()), ("blob", pa.binary())]), pa.schema([("part", pa.int32()), ("bits", pa.binary())])

    def deal(batches):
        for hashes in emit(batches):
            value, count = np.unique(hashes, return_counts=True)
            if not len(value):
                continue
            part, low = (value >> shift_part).astype(np.int64), (value >> shift_low).astype(np.uint32)
            many = np.minimum(count, 255).astype(np.uint8)
            edges = np.searchsorted(part, np.arange(parts + 1))
            rows = [(k, low[edges[k] : edges[k + 1]].tobytes() + (many[edges[k] : edges[k + 1]].tobytes() if least > 1 else b"")) for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist()]
            yield batch_of(sent, part=[k for k, _ in rows], blob=[b for _, b in rows])

    def count(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, b in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
                held.setdefault(k, []).append(b)
        while held:
            k, blobs = held.popitem()
            size = [len(b) // (5 if least > 1 else 4) for b in blobs]
            low = np.concatenate([np.frombuffer(b, "<u4", n) for b, n in zip(blobs, size)])
            if least > 1:
                many = np.concatenate([np.frombuffer(b, "u1", n, 4 * n) for b, n in zip(blobs, size)])
                both = np.sort(low.astype(np.uint64) << np.uint64(8) | many)
                low, many = (both >> np.uint64(8)).astype(np.uint32), (both & np.uint64(255)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
                low = low[first][np.add.reduceat(many, first) >= least]
            own = np.zeros((1 << bits) // parts, bool)
            own[(low.astype(np.uint64) << np.uint64(8) >> np.uint64(40 - bits + split)).astype(np.int64)] = True
            yield batch_of(got, part=[k], bits=[np.packbits(own, bitorder="little").tobytes()])

    out = hashed.mapInArrow(deal, "part int, blob binary").repartition(min(parts, 4 * shuffle_width(spark)), "part").mapInArrow(count, "part int, bits binary")
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for row in out.collect():  # 2**bits bits in all, in one job
        whole[row.part * (len(whole) // parts) : (row.part + 1) * (len(whole) // parts)] = np.frombuffer(row.bits, np.uint8)
    return whole


def in_filter(whole: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - int(np.log2(len(whole) * 8)))
    return (whole[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
