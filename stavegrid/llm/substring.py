"""Repeated passages by prefix-partitioned suffix trees.

The suffixes are those that start a window of ``WINDOW`` words.  An edge of four
words leads from the root, and a second one down to the whole window.  The second
is labelled by two hashes of all its words, 96 bits: the first is linear in the
words' 64-bit hashes, so windows that differ in one word never share it.

1.  A window's minimizer (its least hash of ten words in a row) also names
    every other place of the same window, so only windows whose minimizer is
    found twice can repeat; the others are left out.  The filter is a bit map
    of fixed size, and a false bit only lets a suffix through.
2.  Suffixes are split by prefix: the leading bits of the first edge, and
    where those have too many suffixes as many bits of the second as the count
    asks for, so that each group fits in memory.  A task first drops
    what it has itself seen earlier, so a passage that everyone quotes costs
    one suffix a task.
3.  Each group's suffixes are sorted, which with the common prefix lengths of
    neighbours is its suffix tree.  Below an internal node of window depth all
    leaves but the first are repeats; those that follow one another in a document
    make up its maximal repeated passages (:func:`passages`).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavegrid.llm.common import batch_of, bucket_rows, column, in_filter, mapped, mix, repeat_filter, shuffle_width, slices, unused, window_hashes, word_hashes

WINDOW, SYMBOL, ANCHOR = 20, 4, 10
#: Edges from the root to a whole window.
DEPTH = 2
#: Suffixes that one group may have.
GROUP = 1 << 21
_TOP = 12

#: As sent: the first edge, and the second one's two hashes.
SUFFIX = np.dtype([("s0", "<u4"), ("s1", "<u8"), ("s2", "<u4"), ("doc", "<u2"), ("pos", "<u4")])
GONE = np.dtype([("doc", "<u2"), ("pos", "<u4")])
DOC = np.dtype([("null", "u1"), ("doc", "<i8"), ("text", "<i8")])


def _slide(x: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) over each run of ``width`` values."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = take(x[:-step], x[step:])
        span += step
    return x


def _starts(first: np.ndarray, total: int, width: int) -> np.ndarray:
    """Which word begins a window within one document."""
    valid = np.zeros(total, bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            valid[a : b - width + 1] = True
    return valid


def _minimizers(words: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ten words by start, and each valid window's least one (0 elsewhere)."""
    grams = window_hashes(words, ANCHOR)
    least = np.zeros(len(words), np.uint64)
    if len(words) >= WINDOW:
        low = _slide(grams, WINDOW - ANCHOR + 1, np.minimum)
        least[: len(low)] = np.where(valid[: len(low)], low, 0)
    return grams, least


def _text_words(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            words, first = word_hashes(batch.column("text"))
            yield batch, words, first, _starts(first, len(words), WINDOW)


def _anchors(batches):
    for _, words, _, valid in _text_words(batches):
        grams, least = _minimizers(words, valid)
        if not valid.any():
            continue
        reach = WINDOW - ANCHOR
        top = _slide(np.concatenate([np.zeros(reach, np.uint64), least[: len(grams)]]), reach + 1, np.maximum)
        yield grams[top == grams]


def prefix_plan(counts: np.ndarray, tasks: int, group: int = GROUP) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the first symbol's leading bits: further bits to
    split by, and the first of its groups' tasks; and how many tasks there are."""
    more = np.maximum(0, np.ceil(np.log2(np.maximum(counts, 1) / group))).astype(np.int64)
    size = max(1, min(group, int(counts.sum()) // max(tasks, 1) + 1))
    first, task, load = np.zeros(len(counts), np.int64), 0, 0
    for k, c in enumerate(counts.tolist()):
        if more[k] or load + c > size and load:
            task, load = task + bool(load), 0
        first[k] = task
        if more[k]:
            task += 1 << int(more[k])
        else:
            load += c
    return more, first, task + 1


def _group(s: np.ndarray, more: np.ndarray, first: np.ndarray) -> np.ndarray:
    top = (s["s0"] >> np.uint32(32 - _TOP)).astype(np.int64)
    return first[top] + (s["s1"] & ((np.uint64(1) << more[top].astype(np.uint64)) - np.uint64(1))).astype(np.int64)


def _tree(suffixes: np.ndarray, docs: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted suffixes and their documents with the common prefix length (in edges) of each
    with the one before: the tree's internal nodes are its intervals."""
    rank = np.empty(len(docs), np.int64)
    rank[np.lexsort((docs["text"], docs["doc"], docs["null"]))] = np.arange(len(docs))
    order = np.lexsort((suffixes["pos"], rank[doc], suffixes["s2"], suffixes["s1"], suffixes["s0"]))
    s = suffixes[order]
    common, same = np.zeros(len(s), np.int64), np.ones(max(0, len(s) - 1), bool)
    for edge in (("s0",), ("s1", "s2")):
        for part in edge:
            same = same & (s[part][1:] == s[part][:-1])
        common[1:] += same
    return s, doc[order], common


def _leaves(s: np.ndarray, doc: np.ndarray, common: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted suffixes: each deep node's first leaf, and the leaves that are
    later than it.  The same place of equal rows is no later place."""
    head = np.flatnonzero(common < DEPTH)
    of = head[np.cumsum(common < DEPTH) - 1] if len(s) else head
    d, f = docs[doc], docs[doc[of]]
    return head, (common >= DEPTH) & ((s["pos"] != s["pos"][of]) | (d != f))


_SENT = pa.schema([("task", pa.int32()), ("suffixes", pa.binary()), ("docs", pa.binary()), ("gone", pa.bool_())])
_PLACES = pa.schema([("bucket", pa.int32()), ("places", pa.binary()), ("docs", pa.binary())])
_GONE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("starts", pa.binary())])
PLACE = np.dtype([("doc", "<u4"), ("pos", "<u4")])


def _place_blobs(doc: np.ndarray, pos: np.ndarray, docs: np.ndarray, buckets: int):
    """Places to remove, dealt by document."""
    places = np.empty(len(doc), PLACE)
    places["doc"], places["pos"] = doc, pos
    home = (mix(docs["text"].view(np.uint64) + docs["doc"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    out = []
    for k, blob in bucket_rows(places, home[doc], buckets):
        own = np.frombuffer(blob, PLACE).copy()
        used, own["doc"] = np.unique(own["doc"], return_inverse=True)
        out.append((k, own.tobytes(), docs[used].tobytes()))
    if out:
        yield batch_of(_PLACES, **dict(zip(_PLACES.names, map(list, zip(*out)))))


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records of (records, documents) parts, each one's document, all documents."""
    records, docs = np.concatenate([r for r, _ in parts]), np.concatenate([d for _, d in parts])
    base = np.cumsum([0, *(len(d) for _, d in parts[:-1])])
    return records, records["doc"].astype(np.int64) + np.repeat(base, [len(r) for r, _ in parts]), docs


def _by_document(batches):
    """One row a document from the blobs of its bucket."""
    held: dict[int, list] = {}
    for batch in batches:
        for k, places, docs in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(k, []).append((np.frombuffer(places, PLACE), np.frombuffer(docs, DOC)))
    while held:
        places, doc, docs = _joined(held.popitem()[1])
        docs, same = np.unique(docs, return_inverse=True)
        both = np.unique(same[doc].astype(np.uint64) << np.uint64(32) | places["pos"])
        doc, pos = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype("<u4")
        edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        own = docs[doc[edge]]
        starts = [pos[a:b].tobytes() for a, b in zip(edge, np.r_[edge[1:], len(doc)])]
        yield batch_of(_GONE, doc_id=pa.array(own["doc"], pa.int64(), mask=own["null"] > 0), text_hash=own["text"], starts=starts)


def repeats(docs: DataFrame, log2_bits: int = 27) -> DataFrame:
    """(doc_id, text_hash, starts): windows of ``docs`` (doc_id, text,
    text_hash) that also start earlier, a row a document, as a blob of word
    positions.  ``log2_bits``: size of the filter's bit map."""
    spark = docs.sparkSession
    texts = docs.select("text")
    wanted = spark.sparkContext.broadcast(repeat_filter(texts, _anchors, 2, log2_bits))

    def histogram(batches):
        total = np.zeros(1 << _TOP, np.int64)
        for _, words, _, valid in _text_words(batches):
            _, least = _minimizers(words, valid)
            at = np.flatnonzero(valid)
            at = at[in_filter(wanted.value, least[at])]
            if len(at):
                total += np.bincount((window_hashes(words, SYMBOL)[at] >> np.uint64(64 - _TOP)).astype(np.int64), minlength=1 << _TOP)
        some = np.flatnonzero(total)
        yield batch_of(pa.schema([("top", pa.int32()), ("n", pa.int64())]), top=some, n=total[some])

    counts = np.zeros(1 << _TOP, np.int64)
    for r in texts.mapInArrow(histogram, "top int, n long").groupBy("top").agg(F.sum("n").alias("n")).collect():  # at most 2**_TOP
        counts[r.top] = r.n
    buckets = max(2, shuffle_width(spark, texts))
    more, first, tasks = prefix_plan(counts, buckets)

    def deal(batches):
        def flush():
            known = np.concatenate(tables)
            s, doc, common = _tree(every := np.concatenate(held), known, every["doc"])
            head, later = _leaves(s, doc, common, known)
            lost = np.empty(int(later.sum()), GONE)
            lost["doc"], lost["pos"] = doc[later], s["pos"][later]
            out = []
            for records, task, gone in ((s[head], _group(s[head], more, first), False), (lost, lost["doc"].astype(np.int64) % tasks, True)):
                for t, blob in bucket_rows(records, task, tasks):
                    own = np.frombuffer(blob, records.dtype).copy()
                    used, own["doc"] = np.unique(own["doc"], return_inverse=True)
                    out.append((t, own.tobytes(), known[used].tobytes(), gone))
            for k in range(0, len(out), 64):
                yield batch_of(_SENT, **dict(zip(_SENT.names, map(list, zip(*out[k : k + 64])))))

        held, tables, n, rows = [], [], 0, 0
        for batch, words, first_word, valid in _text_words(batches):
            _, least = _minimizers(words, valid)
            at = np.flatnonzero(valid)
            at = at[in_filter(wanted.value, least[at])]
            if not len(at):
                continue
            s = np.empty(len(at), SUFFIX)
            s["s0"] = window_hashes(words, SYMBOL)[at] >> np.uint64(32)
            s["s1"] = window_hashes(words, WINDOW)[at]
            s["s2"] = window_hashes(mix(words + np.uint64(1)), WINDOW)[at] >> np.uint64(32)
            of = np.searchsorted(first_word, at, "right") - 1
            s["pos"] = at - first_word[of]
            used, of = np.unique(of, return_inverse=True)
            if held and (n > 1 << 21 or rows + len(used) > 65000):
                yield from flush()
                held, tables, n, rows = [], [], 0, 0
            s["doc"] = of + rows
            table = np.empty(len(used), DOC)
            ids = batch.column("doc_id")
            table["null"] = ids.is_null().to_numpy(zero_copy_only=False)[used]
            table["doc"] = ids.fill_null(0).to_numpy()[used]
            table["text"] = batch.column("text_hash").to_numpy()[used]
            held.append(s)
            tables.append(table)
            n, rows = n + len(s), rows + len(used)
        if held:
            yield from flush()

    def grow(batches):
        """Trees of the groups one after the other: rows come sorted by group."""

        def tree(group):
            s, doc, d = _joined(group)
            s, doc, common = _tree(s, d, doc)
            later = _leaves(s, doc, common, d)[1]
            return _place_blobs(doc[later], s["pos"][later], d, buckets)

        group, here = [], None
        for batch in batches:
            for t, records, table, lost in zip(*(c.to_pylist() for c in batch.columns)):
                s, d = np.frombuffer(records, GONE if lost else SUFFIX), np.frombuffer(table, DOC)
                if lost:
                    yield from _place_blobs(s["doc"].astype(np.int64), s["pos"], d, buckets)
                    continue
                if t != here and group:
                    yield from tree(group)
                    group = []
                here = t
                group.append((s, d))
        if group:
            yield from tree(group)

    dealt = docs.select("doc_id", "text", "text_hash").mapInArrow(deal, "task int, suffixes binary, docs binary, gone boolean")
    dealt = dealt.repartition(max(2, min(tasks, 4 * buckets)), "task").sortWithinPartitions("task")
    places = dealt.mapInArrow(grow, "bucket int, places binary, docs binary")
    return places.repartition(buckets, "bucket").mapInArrow(_by_document, "doc_id long, text_hash long, starts binary")


def _cut(text: str | None, starts: bytes | None) -> tuple[int, list[bytes] | None]:
    """Word count, and the words that no repeated window covers (None: all)."""
    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes.split cuts at exactly 0x20 and 0x09-0x0D
    if not starts:
        return len(words), None
    change = np.zeros(len(words) + 1, np.int64)
    at = np.frombuffer(starts, "<u4")
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    keep = np.cumsum(change[:-1]) == 0
    return len(words), [w for w, k in zip(words, keep.tolist()) if k]


def with_repeats(docs: DataFrame, text: str, key: str, starts: str, log2_bits: int = 27) -> DataFrame:
    """``docs`` with a column ``starts`` (null if none)."""
    own, of, its = unused([*docs.columns, starts], "own_hash", "window_id", "window_hash")
    whole, id_ = column(text).cast("string"), column(key).cast("long")
    hashed = docs.withColumn(own, F.xxhash64(F.coalesce(whole, F.lit(""))))
    found = repeats(hashed.select(id_.alias("doc_id"), whole.alias("text"), column(own).alias("text_hash")), log2_bits)
    found = found.select(F.col("doc_id").alias(of), F.col("text_hash").alias(its), F.col("starts").alias(starts))
    same = id_.eqNullSafe(F.col(of)) & (F.col(own) == F.col(its))
    return hashed.join(found, same, "left").select(*[column(c) for c in docs.columns], starts)


def passages(docs: DataFrame, text: str = "text", key: str = "doc_id", log2_bits: int = 27) -> DataFrame:
    """doc_id, start, n_words: the maximal passages of every row that its repeated
    windows cover, places and lengths in words.  Rows without any give none; the
    order of rows is that of :func:`digest`."""
    rows = with_repeats(docs.select(column(key).cast("long").alias("doc_id"), column(text).cast("string").alias("text")), "text", "doc_id", "starts", log2_bits)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64())])

    def run(batches):
        for batch in batches:
            out = []
            for i, starts in zip(batch.column("doc_id").to_pylist(), batch.column("starts").to_pylist()):
                at = np.sort(np.frombuffer(starts, "<u4").astype(np.int64))
                edge = np.flatnonzero(np.r_[True, np.diff(at) > WINDOW])
                out += [(i, int(a), int(b - a) + WINDOW) for a, b in zip(at[edge], at[np.r_[edge[1:], len(at)] - 1])]
            if out:
                yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*out)))))

    return rows.where("starts is not null").select("doc_id", "starts").mapInArrow(run, "doc_id long, start long, n_words long")


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id", log2_bits: int = 27) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row.

    Earlier: smaller doc_id (null comes last), then smaller text hash among
    repeated ids, then smaller start.  Fully equal rows are one document.  A
    null or empty text has no words.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for t, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                n, kept = _cut(t, starts)
                kept = (t or "").encode("utf-8", "surrogatepass").split() if kept is None else kept
                out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, sha = map(list, zip(*out)) if out else ([], [], [])
            yield batch_of(schema, doc_id=batch.column("doc_id"), n_words=n, n_removed=removed, kept_sha256=sha)

    rows = with_repeats(docs.select(column(key).cast("long").alias("doc_id"), column(text).cast("string").alias("text")), "text", "doc_id", "starts", log2_bits)
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", drop_empty: bool = False, log2_bits: int = 27) -> DataFrame:
    """``docs`` with repeated words taken out of the text; a text that changes
    has its kept words joined by one space.  All columns stay, whatever their
    names, and all rows; with ``drop_empty`` a row goes that loses its last
    word to this.  The order of rows is that of :func:`digest`."""
    names, at = docs.columns, docs.columns.index(text)
    rows = with_repeats(docs, text, key, *unused(names, "gone_words"), log2_bits)

    def run(batches):
        for batch in batches:
            out, keep = [], []
            for t, starts in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                _, kept = _cut(t, starts)
                out.append(t if kept is None else b" ".join(kept).decode("utf-8", "surrogatepass"))
                keep.append(kept is None or bool(kept) or not drop_empty)
            columns = [pa.array(out, batch.column(k).type) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(len(names))]).filter(pa.array(keep, pa.bool_()))

    return mapped(rows, run, docs.schema)
