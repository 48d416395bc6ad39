"""Best-fit-decreasing packing of indivisible groups into fixed-capacity shards.

Groups enter by falling size, each into the tightest shard that still has room,
found in a balanced tree of remaining capacities; a new shard opens only when
none has room.  Groups of one size class form a run, and a run goes in as a
whole: equal items that follow each other go to the same tightest shard until
it is full, so a run costs one tree step per shard it touches.

The plan needs only how many groups each size class has.  Classes are exact
below 2**16 and 1/4096 wide above, so their number is bounded whatever the
input.  Rows find their shard by rank among their class, and nothing but
counts leaves the executors.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stavegrid.llm.common import column, materialize

_FINE, _STEPS = 1 << 16, 12
#: Parts of a size class in which groups are ranked side by side.
SALTS = 8


class CapacityTree:
    """A balanced tree (AVL) of (remaining capacity, shard)."""

    def __init__(self):
        self._root = None

    def add(self, room: int, shard: int) -> None:
        self._root = self._add(self._root, (room, shard))

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and give the least entry with room for ``size``; ties: the lowest shard."""
        best, at = None, self._root
        while at:
            if at[0][0] >= size:
                best, at = at[0], at[1]
            else:
                at = at[2]
        if best:
            self._root = self._drop(self._root, best)
        return best

    @staticmethod
    def _node(key, low, high):
        return (key, low, high, 1 + max(low[3] if low else 0, high[3] if high else 0))

    @classmethod
    def _level(cls, key, low, high):
        tall = lambda n: n[3] if n else 0
        if tall(low) > tall(high) + 1:
            if tall(low[1]) >= tall(low[2]):
                return cls._node(low[0], low[1], cls._node(key, low[2], high))
            mid = low[2]
            return cls._node(mid[0], cls._node(low[0], low[1], mid[1]), cls._node(key, mid[2], high))
        if tall(high) > tall(low) + 1:
            if tall(high[2]) >= tall(high[1]):
                return cls._node(high[0], cls._node(key, low, high[1]), high[2])
            mid = high[1]
            return cls._node(mid[0], cls._node(key, low, mid[1]), cls._node(high[0], mid[2], high[2]))
        return cls._node(key, low, high)

    def _add(self, at, key):
        if not at:
            return self._node(key, None, None)
        if key < at[0]:
            return self._level(at[0], self._add(at[1], key), at[2])
        return self._level(at[0], at[1], self._add(at[2], key))

    def _drop(self, at, key):
        if key < at[0]:
            return self._level(at[0], self._drop(at[1], key), at[2])
        if key > at[0]:
            return self._level(at[0], at[1], self._drop(at[2], key))
        if not at[1] or not at[2]:
            return at[1] or at[2]
        heir = at[2]
        while heir[1]:
            heir = heir[1]
        return self._level(heir[0], at[1], self._drop(at[2], heir[0]))


def size_class(size: int) -> int:
    """The largest size of a size's class."""
    if size < _FINE:
        return size
    step = 1 << (size.bit_length() - 1 - _STEPS)
    return -(-size // step) * step


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """For each run (size, count), given by falling size: [(shard, how many), ...].

    Raises ValueError when a size exceeds the capacity.
    """
    tree, shards, plan = CapacityTree(), 0, []
    for size, count in runs:
        if size > capacity:
            raise ValueError(f"a group of {size} exceeds the capacity {capacity}")
        placed = []
        while count:
            found = tree.take_tightest(size)
            if not found:
                found, shards = (capacity, shards), shards + 1
            room, shard = found
            many = min(count, room // size) if size else count
            tree.add(room - many * size, shard)
            placed.append((shard, many))
            count -= many
        plan.append(placed)
    return plan


def even_plan(runs: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """Best-fit-decreasing into at most ``shards`` shards of the least capacity that does.

    A group above the even share gets a shard of its own and leaves the rest to
    the others; the capacity is searched among the even share and what exceeds
    it by ever larger steps.
    """
    total, alone, single = sum(s * c for s, c in runs), 0, []
    runs = list(runs)
    while runs and shards - alone > 1 and runs[0][0] * (shards - alone) > total:
        size, count = runs[0]
        single.append((len(single), alone))
        alone, total = alone + 1, total - size
        runs[0] = (size, count - 1)
        if count == 1:
            runs.pop(0)
    left = shards - alone
    low = max([-(-total // left), *(s for s, _ in runs[:1])])

    def used(capacity):
        plan = best_fit_decreasing(runs, capacity)
        return plan, 1 + max((s for p in plan for s, _ in p), default=-1)

    step, (plan, n) = 0, used(low)
    while n > left:
        step = max(1, step * 2)
        plan, n = used(low + step)
    bottom, top = step // 2, step
    while top - bottom > 1:
        middle = (bottom + top) // 2
        other, n = used(low + middle)
        if n <= left:
            plan, top = other, middle
        else:
            bottom = middle
    return single, [[(alone + s, many) for s, many in p] for p in plan]


def shard_rows(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, group (two 64-bit hashes of the text), shard, slot.

    Equal texts are one indivisible group; a null text counts as an empty one.
    Size: UTF-8 bytes plus 1.  Null and repeated keys are rows like others; an
    empty table gives an empty result.  Texts do not leave the scan: only
    hashes and sizes are shuffled, and a group is summed before it moves.
    """
    return _sharded(docs, lambda runs: even_plan(runs, shards), text, key)[0]


def shard_rows_by_capacity(docs: DataFrame, capacity: int, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, int]:
    """The rows of :func:`shard_rows` in shards of at most ``capacity``, and how
    many shards best fit decreasing opened.  Raises ValueError when a group
    exceeds the capacity."""
    return _sharded(docs, lambda runs: ([], best_fit_decreasing(runs, capacity)), text, key, capacity)


def _sharded(docs: DataFrame, planned, text: str, key: str, capacity: int | None = None) -> tuple[DataFrame, int]:
    content = F.coalesce(column(text).cast("string"), F.lit(""))
    rows = docs.select(
        column(key).cast("long").alias("doc_id"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.xxhash64(content).alias("g1"),
        F.xxhash64(F.lit(1), content).alias("g2"),
    )
    rows = materialize(rows, "sizes")
    total = F.sum("size")
    wide = F.pow(F.lit(2.0), F.floor(F.log2("weight")) - _STEPS)
    cls = F.when(F.col("weight") < _FINE, F.col("weight")).otherwise((F.ceil(F.col("weight") / wide) * wide).cast("long"))
    if capacity:  # rounding up must not lift a group over the capacity
        cls = F.when(F.col("weight") <= capacity, F.least(cls, F.lit(capacity))).otherwise(cls)
    groups = rows.groupBy("g1", "g2").agg(total.alias("weight")).withColumn("cls", cls).withColumn("salt", F.pmod(F.col("g1"), F.lit(SALTS)))
    groups = materialize(groups.withColumn("rank", F.row_number().over(Window.partitionBy("cls", "salt").orderBy("g1", "g2")) - 1), "groups")
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in groups.groupBy("cls", "salt").agg(F.count("*").alias("n")).toLocalIterator():  # SALTS for each of the bounded classes at most
        counts.setdefault(r.cls, []).append((r.salt, r.n))
    runs = sorted(((c, sum(n for _, n in parts)) for c, parts in counts.items()), reverse=True)
    single, plan = planned(runs) if runs else ([], [])
    opened = 1 + max([shard for _, shard in single] + [shard for p in plan for shard, _ in p], default=-1)
    spans: list[tuple[int, int, int, int]] = []  # class, salt, first rank, shard
    alone = iter(single)
    after: dict[int, list[list[int]]] = {}
    rest = {}
    taken = len(single)
    for size, count in runs:  # the largest groups went alone, in order
        many = min(taken, count)
        after[size] = [[next(alone)[1], 1] for _ in range(many)]
        taken -= many
        if count > many:
            rest[len(rest)] = size
    for k, placed in enumerate(plan):
        after[rest[k]] += [list(p) for p in placed]
    for size, placed in after.items():
        queue = [p for p in placed if p[1]]
        for salt, n in sorted(counts[size]):
            first = 0
            while first < n:
                shard, many = queue[0]
                spans.append((size, salt, first, shard))
                use = min(many, n - first)
                first += use
                queue[0][1] -= use
                if not queue[0][1]:
                    queue.pop(0)
    spark = docs.sparkSession
    table = spark.createDataFrame(spans, "cls long, salt long, first long, shard int") if spans else spark.createDataFrame([], "cls long, salt long, first long, shard int")
    table = table.groupBy("cls", "salt").agg(F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("spans"))
    placed = groups.join(table, ["cls", "salt"])
    placed = placed.select("g1", "g2", F.element_at(F.filter("spans", lambda s: s["first"] <= F.col("rank")), -1)["shard"].alias("shard"))
    sharded = rows.join(placed, ["g1", "g2"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "g1"), F.lit(512)))
    sharded = materialize(sharded, "sharded")
    sizes = sharded.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # shards x 512 rows
    base = sizes.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("base"))
    ranked = sharded.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "g1", "g2")) - 1)
    base = base if capacity else F.broadcast(base)
    return ranked.join(base, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "g1", "g2", "shard", (F.col("base") + F.col("at")).cast("long").alias("slot")), opened
