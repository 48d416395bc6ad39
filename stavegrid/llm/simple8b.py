"""Simple-8b: ids packed into 64-bit words.

The low four bits of a word select how many ids it holds, at how many bits
each; selector 14 says that the next word is one id as it is, for ids of more
than 60 bits.  A block holds the ids of some whole documents in lanes of
``LANE`` ids.  Lanes begin at word borders, and the block keeps each lane's
first word, so that lanes are encoded side by side and any run of lanes can be
decoded alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavegrid.llm.common import batch_of, column, materialize, ragged, shuffle_width, slices

LANE = 1024
#: Ids per word, by selector: each count for which 60 bits have a new width.
COUNTS = np.array(sorted({60 // b for b in range(1, 61)}, reverse=True))
WIDTHS = 60 // COUNTS
ESCAPE = len(COUNTS)


def encode(ids: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) and each lane's first word."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    need = np.zeros(n + int(COUNTS[0]), np.uint8)  # bits of each id; what lies behind a lane's end counts as zero
    high, low = (ids >> np.uint64(32)).astype(np.float64), (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    need[:n] = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])
    best = np.full(n, ESCAPE, np.uint8)
    left = lane - np.arange(n) % lane  # ids left in the lane
    widest = need.copy()
    span = 1
    for selector in range(ESCAPE - 1, -1, -1):
        while span < COUNTS[selector]:
            step = min(span, int(COUNTS[selector]) - span)
            widest[:-step] = np.maximum(widest[:-step], widest[step:])
            span += step
        fits = widest[:n] <= WIDTHS[selector]
        best[fits & (COUNTS[selector] <= left)] = selector
    takes = np.r_[COUNTS, 1][best]
    lanes = np.arange(0, n, lane)
    at, end = lanes.copy(), np.minimum(lanes + lane, n)
    chosen, owner = [], []
    alive = np.arange(len(lanes))
    while len(alive):
        here = at[alive]
        chosen.append(here)
        owner.append(alive)
        at[alive] = here + takes[here]
        alive = alive[at[alive] < end[alive]]
    where, of = np.concatenate(chosen), np.concatenate(owner)
    order = np.argsort(where, kind="stable")
    where, of = where[order], of[order]
    selector = best[where]
    escaped = selector == ESCAPE
    size = 1 + escaped
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = selector
    words[place[escaped] + 1] = ids[where[escaped]]
    padded = np.concatenate([ids, np.zeros(int(COUNTS[0]), np.uint64)])
    for s in range(ESCAPE):
        mine = np.flatnonzero(selector == s)
        for k in range(int(COUNTS[s])) if len(mine) else ():
            words[place[mine]] |= padded[where[mine] + k] << np.uint64(4 + k * int(WIDTHS[s]))
    return words, place[np.searchsorted(of, np.arange(len(lanes)))]


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of all words, with no loop over words."""
    words = np.asarray(words, np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    maybe = np.flatnonzero(selector == ESCAPE)
    if len(maybe):  # a raw word may look like an escape: along a run of such words, every second is raw
        opens = np.r_[True, np.diff(maybe) > 1]
        rank = np.arange(len(maybe)) - np.maximum.accumulate(np.where(opens, np.arange(len(maybe)), 0))
        raw[maybe[rank % 2 == 0] + 1] = True
    keep = ~raw
    place = np.flatnonzero(keep)
    selector = selector[place]
    count = np.r_[COUNTS, 1][selector]
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in range(ESCAPE):
        mine = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(int(COUNTS[s])) if len(mine) else ():
            out[start[mine] + k] = words[place[mine]] >> np.uint64(4 + k * int(WIDTHS[s])) & mask
    mine = np.flatnonzero(selector == ESCAPE)
    out[start[mine]] = words[place[mine] + 1]
    return out[:n]


def decode_lanes(words: np.ndarray, lanes: np.ndarray, n: int, first: int = 0, many: int | None = None, lane: int = LANE) -> np.ndarray:
    """The ids of the lanes ``first`` to ``first + many`` of a block of n ids, from their own words alone."""
    last = len(lanes) if many is None else min(len(lanes), first + many)
    if first >= last:
        return np.zeros(0, np.uint64)
    end = lanes[last] if last < len(lanes) else len(words)
    return decode(words[lanes[first] : end], min(n, last * lane) - first * lane)


#: Lanes that a reader decodes at once, which bounds its memory.
_RUN = 256

FILE_SCHEMA = "part int, before long, doc_id array<long>, n_ids array<long>, lanes array<long>, words binary"


def write_ids(docs: DataFrame, encoder, end: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode all documents in ascending key order and write block rows.

    ``encoder()`` gives a worker's ``encode(column, end)``.  Returns the written
    table (FILE_SCHEMA).  A null text is empty; null keys come first; equal
    keys are in the order of their texts.  The key and the text's first signs
    are sampled to find the ranges, so that a key of many rows fills as many as
    it needs; a range is a part of the files, and their number grows with the
    table.
    """
    rows = docs.select(column(key).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    width = max(2, shuffle_width(docs.sparkSession, docs))
    rows = rows.repartitionByRange(width, F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int64())), ("lanes", pa.list_(pa.int64())), ("words", pa.binary())])

    def run(batches):
        part, before, encode_texts = TaskContext.get().partitionId(), 0, encoder()
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = encode_texts(batch.column("text"), end)
                words, lanes = encode(ids)
                yield batch_of(schema, part=[part], before=[before], doc_id=[batch.column("doc_id").to_pylist()], n_ids=[np.diff(at).tolist()], lanes=[lanes.tolist()], words=[words.astype("<u8").tobytes()])
                before += len(ids)

    return materialize(rows.mapInArrow(run, FILE_SCHEMA), "simple8b")


def read_ids(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids
    (little-endian uint32) of written blocks."""
    totals = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect())  # as many as parts
    base = dict(zip((p for p, _ in totals), np.r_[0, np.cumsum([n for _, n in totals])].tolist()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                count = np.array(row["n_ids"], np.int64)
                words, lanes, n = np.frombuffer(row["words"], "<u8"), np.array(row["lanes"], np.int64), int(count.sum())
                runs = [decode_lanes(words, lanes, n, k, _RUN).astype("<u4") for k in range(0, len(lanes), _RUN)]
                ids = np.concatenate(runs) if runs else np.zeros(0, "<u4")
                at = np.r_[0, np.cumsum(count)]
                yield batch_of(
                    schema,
                    doc_id=row["doc_id"],
                    start=base[row["part"]] + row["before"] + at[:-1],
                    n_tokens=count,
                    ids=[ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
