"""Candidate pairs, exact verification and connected components, distributed.

Keys are 64-bit names of distinct contents (classes), so copies never meet.
Nothing here is collected but counts.

Candidates come from postings: the members that share a column.

1.  Members that no other member of a posting admits by size and place leave it.
2.  Small postings name their pairs; a large one only its star, all members
    against one pivot.  These pairs are verified and linked members joined.
3.  Postings whose members are all in one component by then are done; of
    postings with the same members one is kept.  The members of the others
    meet in blocks of at most twice BLOCK rows, where a blocked product of
    the block's incidence matrix counts all overlaps at once.  Only edges
    between components leave a block, fewer than it has members.  Where the
    caller says so, postings of few members name their admitted pairs instead.

So no link between components is missed.  Rows grow with the members of postings
but for step 3, where m members that are still apart take m * m / BLOCK rows if
they are more than BLOCK.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavegrid.llm.common import batch_of, discard, in_filter, materialize, mix, repeat_filter, shuffle_width

#: Members of a posting up to which all its admitted pairs are made at once.
SMALL = 3
#: Edges up to which one task ends the search for components.
ALONE = 1 << 18
#: Members of one side of a block.
BLOCK = 512
#: Columns of the incidence matrix in one step of the blocked product.
COLUMNS = 4096

_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its tree) for the nodes of edges that are not least themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _stars(batches):
    """A task's edges as the stars of its own trees: (least node, node)."""
    held, n = [], 0

    def star():
        node, root = forest(*(np.concatenate(p) for p in zip(*held)))
        return root, node

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += batch.num_rows
        if n > 1 << 20:
            held = [star()]
            n = len(held[0][0])
    if held:
        a, b = star()
        for k in range(0, len(a), 1 << 16):
            yield batch_of(_EDGE, a=a[k : k + (1 << 16)], b=b[k : k + (1 << 16)])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for the nodes of edges (a, b).

    Tasks first join what they can by themselves.  Then each node points to its
    least neighbour, chains of pointers are halved until they end, and the
    edges between different roots go into the next round; the rounds are few
    because every round at least halves what is left.  Once the edges fit in
    one task (ALONE of them, 16 bytes each) it ends the work.  Hot nodes are
    summed before they move.  No edges give an empty table.
    """
    left = materialize(edges.where("a != b").select("a", "b").mapInArrow(_stars, "a long, b long"), "edges")
    levels: list[DataFrame] = []
    while True:
        if left.count() <= ALONE:
            star = left.coalesce(1).mapInArrow(_stars, "a long, b long")
            top = F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("a").alias("root")), F.struct(F.col("a").alias("node"), F.col("a").alias("root"))))
            levels.append(materialize(star.select(top.alias("both")).select("both.*").distinct(), "parents"))
            break
        left, narrow = materialize(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"), left
        discard(narrow)
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"), F.lit(True).alias("moved")), "parents")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            halved = materialize(parent.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "parents")
            discard(parent)
            parent = halved
            if not parent.where("moved").limit(1).count():
                break
        levels.append(parent)
        a, b = parent.select(F.col("node").alias("a"), F.col("root").alias("ra")), parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = left.join(a, "a").join(b, "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        rest = materialize(rest.mapInArrow(_stars, "a long, b long"), "edges")
        discard(left)
        left = rest
    discard(left)
    if len(levels) == 1:
        return levels[0]
    out = levels[0].select("node", "root")
    for level in levels[1:]:
        up = level.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = out.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = materialize(out, "components")
    discard(*levels)
    return out


def need(n_a, n_b, share: tuple[int, int]):
    """Least intersection of sets of these sizes for a Jaccard similarity of share."""
    s, t = share
    return -(-s * (n_a + n_b) // (s + t))


def _partnered(n: np.ndarray, pos: np.ndarray, of: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Which members of postings (``of``, ascending) another member admits.

    Members i and j admit each other when neither size passes the other's
    limit.  So in the order of sizes a member needs someone up to its own limit
    whose limit reaches its size: a running maximum, or the second one where
    the member itself holds it.
    """
    s, t = share
    wide = np.int64(1) << 33
    order = np.lexsort((n, of))
    n, of = n[order], of[order]
    limit = np.maximum((s + t) * (n - pos[order]) // s - n, 0)
    value, place = of * wide + limit, np.arange(len(n))
    top = np.maximum.accumulate(value)
    before = np.r_[np.int64(-1), top[:-1]]
    second = np.maximum.accumulate(np.where(value > before, before, value))
    last = np.searchsorted(of * wide + n, value, "right") - 1
    own = (place <= last) & (value == top[last])
    out = np.zeros(len(n), bool)
    out[order] = (last >= 0) & (np.where(own, second[last], top[last]) >= of * wide + n)
    return out


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and length of runs of equal values, and the run of each value."""
    edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.r_[edge, len(h)])
    return edge, size, np.repeat(np.arange(len(edge)), size)


def _repeated(h: np.ndarray) -> np.ndarray:
    """Where values of 32 bits are that occur more than once."""
    z = np.sort(h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64))
    same = z[1:] >> np.uint64(32) == z[:-1] >> np.uint64(32)
    return (z[np.r_[False, same] | np.r_[same, False]] & np.uint64(0xFFFFFFFF)).astype(np.int64) if len(h) else np.zeros(0, np.int64)


def postings_pairs(records: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) from records (h, key, n, pos) of whole postings, and the
    records of the large postings, of which only star pairs are among them.

    n: size of the member's set; pos: the shared entry's place in its order (0
    where there is none).  A pair is made only if the sizes and what is left
    behind the shared entry admit the needed overlap.
    """
    r = records[_repeated(records["h"])]
    r = r[np.lexsort((r["key"], r["h"]))]
    if len(r):
        r = r[np.r_[True, (r["h"][1:] != r["h"][:-1]) | (r["key"][1:] != r["key"][:-1])]]
        r = r[_runs(r["h"])[1][_runs(r["h"])[2]] > 1]
    if len(r):
        r = r[_partnered(r["n"].astype(np.int64), r["pos"].astype(np.int64), _runs(r["h"])[2], share)]
    edge, size, of = _runs(r["h"])
    n, pos = r["n"].astype(np.int64), r["pos"].astype(np.int64)

    def pairs(i, j):
        ok = (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need(n[i], n[j], share)) & (i != j)
        out = np.empty(int(ok.sum()), [("a", "<i8"), ("b", "<i8")])
        a, b = r["key"][i[ok]], r["key"][j[ok]]
        out["a"], out["b"] = np.minimum(a, b), np.maximum(a, b)
        return out

    small = (size <= SMALL)[of]
    found = []
    i, d = np.flatnonzero(small), 1
    while len(i):  # a member that has none d places on has none further on
        i = i[i + d < len(r)]
        i = i[of[i] == of[i + d]]
        found.append(pairs(i, i + d))
        d += 1
    big = np.flatnonzero(~small)
    if len(big):
        by = big[np.lexsort((r["key"][big], pos[big], of[big]))]
        begin, many, _ = _runs(of[by])
        found.append(pairs(np.repeat(by[begin], many), by))
    return np.unique(np.concatenate(found)) if found else np.empty(0, [("a", "<i8"), ("b", "<i8")]), r[big]


PAIR_SCHEMA = "kind int, a long, b long, n int, pos int"
_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def pair_batches(bucket: int, records: np.ndarray, share: tuple[int, int]):
    """Rows of PAIR_SCHEMA: 0 pairs, 1 members of large postings (a: posting, b: key)."""
    pairs, big = postings_pairs(records, share)
    if len(pairs):
        yield batch_of(_ARROW, kind=np.zeros(len(pairs), np.int32), a=pairs["a"], b=pairs["b"], n=pa.nulls(len(pairs), pa.int32()), pos=pa.nulls(len(pairs), pa.int32()))
    if len(big):
        posting = (mix(big["h"].astype(np.uint64) + (np.uint64(bucket) << np.uint64(32)))).view(np.int64)
        yield batch_of(_ARROW, kind=np.ones(len(big), np.int32), a=posting, b=big["key"], n=big["n"].astype(np.int32), pos=big["pos"].astype(np.int32))


def fetched(wanted: DataFrame, contents_of: Callable[[np.ndarray], DataFrame], name: str) -> DataFrame:
    """(key, elements), once for each key of ``wanted``.  ``contents_of(filter)``
    gives them for the keys whose bit is set in a filter of the keys wanted; it
    may repeat a key or give others."""

    def keys(batches):
        for batch in batches:
            yield mix(batch.column("key").to_numpy().view(np.uint64))

    return materialize(contents_of(repeat_filter(wanted, keys, 1)).dropDuplicates(["key"]), name)


def members(rows: DataFrame) -> DataFrame:
    """All keys of the pairs; large postings' members are among them or have no partner yet."""
    return rows.select(F.explode(F.when(F.col("kind") == 0, F.array("a", "b")).otherwise(F.array("b"))).alias("key"))


#: Turns a column of contents into (hashes, offsets): each row's set, repeats allowed.
Decoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
#: Pairs that are counted together: their number must fit in the bits that tag an element.
_TAG_BITS = 12
_TOGETHER = 128


def _tagged(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct elements with their row in the top bits, and each row's size."""
    rows = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    z = np.sort(rows << np.uint64(64 - _TAG_BITS) | hashes >> np.uint64(_TAG_BITS))
    z = z[np.r_[True, z[1:] != z[:-1]]] if len(z) else z
    return z, np.bincount((z >> np.uint64(64 - _TAG_BITS)).astype(np.int64), minlength=len(at) - 1)


def similar_rows(x: pa.Array, y: pa.Array, decode: Decoder, share: tuple[int, int]) -> np.ndarray:
    """Whether the sets of two columns reach the similarity, row by row, by one
    sort for many rows."""
    s, t = share
    out = np.zeros(len(x), bool)
    for low in range(0, len(x), _TOGETHER):
        (p, n), (q, m) = _tagged(*decode(x.slice(low, _TOGETHER))), _tagged(*decode(y.slice(low, _TOGETHER)))
        both = np.sort(np.concatenate([p, q]))
        both = both[1:][both[1:] == both[:-1]]
        common = np.bincount((both >> np.uint64(64 - _TAG_BITS)).astype(np.int64), minlength=len(n))
        out[low : low + _TOGETHER] = t * common >= s * (n + m - common)
    return out


def checked(pairs: DataFrame, contents: DataFrame, decode: Decoder, share: tuple[int, int]) -> DataFrame:
    """Of rows (a, b, x, y) the edges (x, y), as (a, b), whose keys a and b are similar."""
    one = contents.select(F.col("key").alias("a"), F.col("elements").alias("of_a"))
    two = contents.select(F.col("key").alias("b"), F.col("elements").alias("of_b"))

    def check(batches):
        for batch in batches:
            kept = pa.array(similar_rows(batch.column("of_a"), batch.column("of_b"), decode, share), pa.bool_())
            yield batch_of(_EDGE, a=batch.column("x").filter(kept), b=batch.column("y").filter(kept))

    return pairs.join(two, "b").join(one, "a").select("x", "y", "of_a", "of_b").mapInArrow(check, "a long, b long")


def overlaps(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the rows' sets, and the matrix of their overlaps.

    The rows are an incidence matrix of rows by columns.  Its product with
    itself is summed over blocks of columns; columns of a single row add to the
    sizes alone.
    """
    bits = np.uint64(max(_TAG_BITS, (len(at) - 1).bit_length()))
    z = np.sort(hashes >> bits << bits | np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at)))
    z = z[np.r_[True, z[1:] != z[:-1]]] if len(z) else z
    rows = (z & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    n = np.bincount(rows, minlength=len(at) - 1)
    _, size, of = _runs(z >> bits)
    shared = (size > 1)[of]
    rows, of = rows[shared], of[shared]
    of = np.cumsum(np.r_[False, of[1:] != of[:-1]]) if len(of) else of
    total = np.zeros((len(n), len(n)), np.float64)
    edges = np.searchsorted(of, np.arange(0, (int(of[-1]) if len(of) else -1) + 1 + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if b > a:
            block = np.zeros((len(n), int(of[b - 1]) - k * COLUMNS + 1), np.float32)
            block[rows[a:b], of[a:b] - k * COLUMNS] = 1
            total += block @ block.T  # sums of at most COLUMNS ones are exact
    return n, total.astype(np.int64)


def block_edges(root: np.ndarray, hashes: np.ndarray, at: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the roots of similar rows, fewer than there are rows."""
    s, t = share
    n, both = overlaps(hashes, at)
    i, j = np.nonzero(np.triu(t * both >= s * (n[:, None] + n[None, :] - both), 1) & (root[:, None] != root[None, :]))
    node, top = forest(root[i], root[j])
    return top, node


_CROSS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])


def _groups(batches, names):
    """Consecutive rows with equal values of ``names``, whole groups at a time, as tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value = np.stack([batch.column(c).to_numpy() for c in names])
        edge = np.r_[0, np.flatnonzero((value[:, 1:] != value[:, :-1]).any(0)) + 1, batch.num_rows]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in names):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _cross_pairs(share: tuple[int, int]):
    """Admitted pairs of keys of one posting in different components, with their roots."""

    def run(batches):
        for batch in batches:
            key, root, n, pos = (batch.column(c).flatten().to_numpy() for c in ("keys", "roots", "n", "pos"))
            size = np.diff(batch.column("keys").offsets.to_numpy())
            end = np.repeat(np.cumsum(size), size)
            found, i, d = [], np.arange(len(key)), 1
            while len(i):
                i = i[i + d < end[i]]
                x, j = i, i + d
                ok = (root[x] != root[j]) & (np.minimum(n[x] - pos[x], n[j] - pos[j]) >= need(n[x], n[j], share))
                x, j = x[ok], j[ok]
                found.append(np.stack([np.minimum(key[x], key[j]), np.maximum(key[x], key[j]), root[x], root[j]], 1))
                d += 1
            out = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
            out = out[np.unique(out[:, :2], axis=0, return_index=True)[1]] if len(out) else out
            for k in range(0, len(out), 1 << 16):
                yield batch_of(_CROSS, **dict(zip(_CROSS.names, out[k : k + (1 << 16)].T)))

    return run


def linked(rows: DataFrame, contents: DataFrame, decode: Decoder, share: tuple[int, int], some: int) -> DataFrame:
    """Components (node, root) of the links among materialized rows of
    PAIR_SCHEMA; see the module's docstring.  ``some``: members up to which an
    open posting names its pairs; SMALL for none."""
    spark = rows.sparkSession
    pairs = materialize(rows.where("kind = 0").select("a", "b").distinct(), "pairs")
    links = materialize(checked(pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), contents, decode, share), "links")
    roots = components(links)
    discard(links)
    large = rows.where("kind = 1").select(F.col("a").alias("posting"), F.col("b").alias("key"), "n", "pos")
    if not large.limit(1).count():
        discard(pairs)
        return roots
    placed = large.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed = materialize(placed, "placed")
    by_root = placed.groupBy("posting", "root").agg(F.count("*").alias("m"), F.sum("pos").alias("place"), F.bit_xor(F.xxhash64("key")).alias("name"))
    mixed = by_root.groupBy("posting").agg(F.count("*").alias("roots"), F.sum("m").alias("m"), F.sum("place").alias("place"), F.bit_xor("name").alias("name")).where("roots > 1")
    # of the same members' postings the one whose column comes first in the common order admits the most
    kept = mixed.groupBy("name", "m").agg(F.min_by("posting", F.struct("place", "posting")).alias("posting")).select("posting", "m")
    still = materialize(placed.join(kept, "posting"), "open")
    discard(placed)
    sides = F.ceil(F.col("m") / BLOCK).cast("int")
    many = still.where(F.col("m") > some).select("posting", "key", "root", sides.alias("sides"), F.pmod(F.xxhash64("key"), sides.cast("long")).cast("int").alias("side"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    many = many.select("posting", "key", "root", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))

    def multiply(batches):
        for group in _groups(batches, ["posting", "low", "high"]):
            root = group.column("root").to_numpy()
            if (root != root[0]).any():
                a, b = block_edges(root, *decode(group.column("elements").combine_chunks()), share)
                if len(a):
                    yield batch_of(_EDGE, a=a, b=b)

    blocks = many.join(contents.select("key", "elements"), "key").select("posting", "low", "high", "root", "elements")
    blocks = blocks.repartition(shuffle_width(spark), "posting", "low", "high").sortWithinPartitions("posting", "low", "high")
    more = blocks.mapInArrow(multiply, "a long, b long")
    if some > SMALL:
        each = F.collect_list(F.struct("key", "root", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos")))
        few = still.where(F.col("m") <= some).groupBy("posting").agg(each.alias("all")).select(F.col("all.key").alias("keys"), F.col("all.root").alias("roots"), "all.n", "all.pos")
        few = few.mapInArrow(_cross_pairs(share), "a long, b long, x long, y long").dropDuplicates(["a", "b"]).join(pairs, ["a", "b"], "left_anti")
        more = more.unionByName(checked(few, contents, decode, share))
    more = materialize(more, "links")
    joined = components(more)
    up = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    lone = joined.join(roots.select("node"), "node", "left_anti")
    out = materialize(roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(lone), "components")
    discard(pairs, still, more)
    return out


def filtered(whole: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return in_filter(whole, mix(keys.view(np.uint64)))
