"""Box predicates, merging, and greedy suppression."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intersects(a: Callable[[str], Column], b: Callable[[str], Column], margin: float = 0) -> Column:
    """Whether box a meets box b, of which only b is widened by the margin."""
    x = F.least(a("x1"), b("x1") + margin) > F.greatest(a("x0"), b("x0") - margin)
    return x & (F.least(a("y1"), b("y1") + margin) > F.greatest(a("y0"), b("y0") - margin))


def holds_point(box: Callable[[str], Column], x: Column, y: Column, margin: Column | float) -> Column:
    """Whether the point is in the widened box, its border included."""
    return x.between(box("x0") - margin, box("x1") + margin) & y.between(box("y0") - margin, box("y1") + margin)


def near_pairs(a: DataFrame, b: DataFrame, keys: list[str], near: Callable, reach: float, cell: int = 64) -> DataFrame:
    """Pairs of rows of a and b (aliased so) with equal keys that are near.

    ``near`` is held only against rows that share a strip of ``cell`` columns, a's
    widened by ``reach``; a pair counts in the first strip that both are in."""

    def stripped(rows: DataFrame, wide: float) -> DataFrame:
        first = F.floor((F.col("x0") - wide) / cell)
        return rows.withColumn("_first", first).withColumn("_cell", F.explode(F.sequence(first, F.floor((F.col("x1") + wide) / cell))))

    same = (F.col("a._cell") == F.col("b._cell")) & (F.col("a._cell") == F.greatest("a._first", "b._first"))
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    of = lambda alias: lambda name: F.col(f"{alias}.{name}")
    return stripped(a, reach).alias("a").join(stripped(b, 0).alias("b"), same & near(of("a"), of("b")))


def hull(*also: Column) -> list[Column]:
    """Aggregates: the box around boxes."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), *also]


def suppress(items: DataFrame, keys: list[str], fields: list[str], conflict: Callable[[Column, Column], Column], score: str = "score", seq: str = "seq", reach: tuple[Column, Column] | None = None) -> DataFrame:
    """Greedy suppression: by falling score (ties: rising seq) an item stays
    unless it conflicts with one that already stays.

    A suppressed item suppresses nothing, so this is an ordered fold over the
    group's sorted array, with no Python.  A group is what one page and staff
    hold, which the paper bounds.

    ``reach``: an item's low and high end, where items that conflict overlap.
    Runs of items that overlap in a chain are then folded each by itself, which
    takes a sort of the group but no further shuffle.
    """
    cols = list(dict.fromkeys([score, seq, *fields]))
    if reach:
        by = Window.partitionBy(*keys).orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)
        items = items.withColumn("_low", reach[0]).withColumn("_high", reach[1]).withColumn("_opens", (F.col("_low") > F.max("_high").over(by)).cast("int"))
        items = items.withColumn("_run", F.coalesce(F.sum("_opens").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    row = F.struct((-F.col(score)).alias("_down"), F.col(seq).alias("_seq"), *[F.col(c) for c in cols])
    grouped = items.groupBy(*keys, *["_run"] * bool(reach)).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    fold = F.aggregate("_all", F.slice("_all", 1, 0), lambda kept, item: F.when(F.exists(kept, lambda k: conflict(item, k)), kept).otherwise(F.concat(kept, F.array(item))))
    return grouped.select(*keys, F.explode(fold).alias("_k")).select(*keys, *[F.col(f"_k.{c}") for c in cols])


def pieces(batch: pa.RecordBatch, lists: pa.ListArray, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """``batch`` in stretches of rows whose lists hold ``most`` items together, or one row's."""
    ends, start = lists.offsets.to_numpy(), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, int(ends[start]) + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _conflicts(group: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, margin: float, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(worse, better): boxes of one group that meet, of which the earlier is the
    better and widened.  A sweep looks right from each box as far as it reaches,
    over about ``most`` pairs at once; an unknown side meets all."""
    known = np.concatenate([c[~np.isnan(c)] for c in (x0, x1)])
    least, last = known.min(initial=0), known.max(initial=0)
    shift = group * (last - least + 2 * abs(margin) + 4)
    low = np.where(np.isnan(x0), least, x0) + shift
    order = np.argsort(low, kind="stable")
    ends = np.searchsorted(low[order], (np.where(np.isnan(x1), last, x1) + shift)[order] + margin + 1, "right")
    n = np.maximum(ends - np.arange(len(order)) - 1, 0)
    upto = np.r_[0, np.cumsum(n)]
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    start = 0
    while start < len(order):
        stop = max(start + 1, int(np.searchsorted(upto, upto[start] + most, "right")) - 1)
        i = np.repeat(np.arange(start, stop), n[start:stop])
        j = np.arange(len(i)) - np.repeat(upto[start:stop] - upto[start], n[start:stop]) + i + 1
        i, j = order[i], order[j]
        a, b = np.maximum(i, j), np.minimum(i, j)
        meet = (group[a] == group[b]) & (np.fmin(x1[a], x1[b] + margin) > np.fmax(x0[a], x0[b] - margin)) & (np.fmin(y1[a], y1[b] + margin) > np.fmax(y0[a], y0[b] - margin))
        out.append((a[meet], b[meet]))
        start = stop
    return np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])


def unconflicted(n: int, worse: np.ndarray, better: np.ndarray) -> np.ndarray:
    """Which of n items stay: in rounds, those that no better one left conflicts
    with; what they conflict with goes."""
    stays, left = np.zeros(n, bool), np.ones(n, bool)
    while left.any():
        free = left.copy()
        free[worse] = False
        stays |= free
        left &= ~free
        left[worse[free[better]]] = False
        live = left[worse] & left[better]
        worse, better = worse[live], better[live]
    return stays


def suppress_boxes(items: DataFrame, keys: list[str], fields: list[str], margin: float, score: str = "score", seq: str = "seq") -> DataFrame:
    """What :func:`suppress` keeps by :func:`one_sided_conflict`, for groups of many
    boxes of which few meet: the fold holds each box against all kept ones of its
    group, here a sweep finds those that meet."""
    cols = list(dict.fromkeys([score, seq, *fields]))
    row = F.struct((-F.col(score)).alias("_down"), F.col(seq).alias("_seq"), *[F.col(c) for c in cols])
    grouped = items.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    types = dict(items.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, *cols])

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(len(keys))
        flat = lists.flatten()
        group = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        held = dict(zip(cols, flat.flatten()[2:]))
        sides = [held[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")]
        stays = np.flatnonzero(unconflicted(len(group), *_conflicts(group, *sides, margin)))
        at, of = pa.array(stays), pa.array(group[stays])
        return pa.RecordBatch.from_arrays([*[batch.column(k).take(of) for k in range(len(keys))], *[held[c].take(at) for c in cols]], [*keys, *cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, batch.column(len(keys))):
                yield kept(piece)

    return grouped.mapInArrow(run, schema)


def boxes_conflict(margin: int) -> Callable[[Column, Column], Column]:
    """Both boxes widened by the margin meet."""

    def test(a: Column, b: Column) -> Column:
        x = F.least(a["x1"], b["x1"]) + margin > F.greatest(a["x0"], b["x0"]) - margin
        return x & (F.least(a["y1"], b["y1"]) + margin > F.greatest(a["y0"], b["y0"]) - margin)

    return test


def one_sided_conflict(margin: int) -> Callable[[Column, Column], Column]:
    """Only the box that stays is widened."""
    return lambda a, b: intersects(lambda c: a[c], lambda c: b[c], margin)


def points_conflict(min_dx: float) -> Callable[[Column, Column], Column]:
    return lambda a, b: (F.abs(a["x"] - b["x"]) <= min_dx) & (F.abs(a["y"] - b["y"]) <= max(4.0, 1.10 * min_dx))


def centers_conflict(dx: float, dy: float) -> Callable[[Column, Column], Column]:
    def test(a: Column, b: Column) -> Column:
        near = lambda lo, hi, d: F.abs((a[lo] + a[hi]) * 0.5 - (b[lo] + b[hi]) * 0.5) <= d
        return near("x0", "x1", dx) & near("y0", "y1", dy)

    return test


def ends_conflict(reach: float) -> Callable[[Column, Column], Column]:
    return lambda a, b: (F.abs(a["x0"] - b["x0"]) <= reach) & (F.abs(a["x1"] - b["x1"]) <= reach)


class Hulls:
    """Groups of boxes, each with the box around it, in arrays with room for n."""

    def __init__(self, n: int, px: float, py: float):
        self.pad = np.array([-px, -py, px, py])
        self.hull, self.wide = np.zeros((n, 4)), np.zeros((n, 4))
        self.members: list[list] = []

    def open(self, box: np.ndarray, members: list) -> None:
        self.members.append(members)
        self._set(len(self.members) - 1, box)

    def absorb(self, k: int, box: np.ndarray, members: list) -> None:
        self.members[k] += members
        own = self.hull[k]
        self._set(k, np.r_[np.minimum(own[:2], box[:2]), np.maximum(own[2:], box[2:])])

    def _set(self, k: int, hull: np.ndarray) -> None:
        self.hull[k], self.wide[k] = hull, np.trunc(hull + self.pad)


def _meeting(boxes: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Places of the boxes that share area with one."""
    return np.flatnonzero((np.minimum(boxes[:, 2:], one[2:]) > np.maximum(boxes[:, :2], one[:2])).all(1))


def _meeting_pairs(b: np.ndarray, px: float, py: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of boxes, sorted by left side, whose gaps are at most the pads: a
    sweep that looks right from each box as far as it reaches."""
    ends = np.searchsorted(b[:, 0], b[:, 2] + px, "right")
    n = np.maximum(ends - np.arange(len(b)) - 1, 0)
    i = np.repeat(np.arange(len(b)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1
    close = (b[j, 1] <= b[i, 3] + py) & (b[i, 1] <= b[j, 3] + py)
    return i[close], j[close]


def closed_sets(b: np.ndarray, px: float, py: float) -> np.ndarray:
    """The number of each box's set, where no two sets' hulls come within the pads.

    Meeting sets are joined by their least number and their hulls drawn anew,
    all at once, until none meet: hulls grow, so this closure is the only one."""
    of = np.arange(len(b))
    while True:
        used, of = np.unique(of, return_inverse=True)
        hulls = np.concatenate([np.full((len(used), 2), np.inf), np.full((len(used), 2), -np.inf)], 1)
        np.minimum.at(hulls, of, np.c_[b[:, :2], np.full((len(b), 2), np.inf)])
        np.maximum.at(hulls, of, np.c_[np.full((len(b), 2), -np.inf), b[:, 2:]])
        order = np.argsort(hulls[:, 0], kind="stable")
        i, j = _meeting_pairs(hulls[order], px, py)
        if not len(i):
            return of
        i, j = order[i], order[j]
        root = np.arange(len(used))
        while True:
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
            if (root == before).all():
                break
        of = root[of]


def cluster_boxes(boxes: list, px: float, py: float) -> list[list]:
    """Groups of boxes by closure over padded hulls.  From left to right a box
    joins the first group whose padded hull it meets.  Then each group in turn
    looks along the later ones for the next that its padded hull, as grown by
    then, meets, until a pass over all groups joins none.

    Boxes are first parted by a closure with pads no smaller on any side, so that
    only boxes that can come together at all are held against each other.
    """
    rows = sorted(boxes, key=lambda b: (b[0], b[1]))
    of = closed_sets(np.array([b[:4] for b in rows], float).reshape(-1, 4), px + 1, py + 1)
    sets: dict[int, list] = {}
    for k, row in zip(of.tolist(), rows):
        sets.setdefault(k, []).append(row)
    return [group for members in sets.values() for group in _clustered(members, px, py)]


def _clustered(rows: list, px: float, py: float) -> list[list]:
    """The groups of one stretch; rows in order."""
    if len(rows) < 2:
        return [[r] for r in rows]
    found = Hulls(len(rows), px, py)
    for row, box in zip(rows, np.array([b[:4] for b in rows], float).reshape(-1, 4)):
        home = _meeting(found.wide[: len(found.members)], box)
        if len(home):
            found.absorb(int(home[0]), box, [row])
        else:
            found.open(box, [row])
    while True:
        count = len(found.members)
        passed, left = Hulls(count, px, py), np.arange(count)
        while len(left):
            head, left = left[0], left[1:]
            passed.open(found.hull[head], found.members[head])
            mine, at = len(passed.members) - 1, 0
            while len(hits := _meeting(found.hull[left[at:]], passed.wide[mine])):
                at += int(hits[0])
                passed.absorb(mine, found.hull[left[at]], found.members[left[at]])
                left = np.delete(left, at)
        found = passed
        if len(found.members) == count:
            return found.members


def merge_boxes(boxes: DataFrame, keys: list[str], px: Column | float, py: Column | float) -> DataFrame:
    """(keys, seq, grp): ``grp`` is the least seq of the box's cluster; pads may
    differ by group.

    Some groups of a batch are closed at once, laid side by side along x; only sets
    of several boxes are walked through in order.  Boxes hold whole numbers.
    """
    types = dict(boxes.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", seq long, grp long"
    fields = ["x0", "y0", "x1", "y1", "seq"]
    listed = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in fields]))).alias("b"), *[F.first(p if isinstance(p, Column) else F.lit(p)).cast("double").alias(n) for n, p in (("pad_x", px), ("pad_y", py))])

    def closed(batch: pa.RecordBatch) -> pa.RecordBatch:
        pads = [batch.column(len(keys) + 1 + k).to_numpy() for k in range(2)]
        wide, tall = (p.max(initial=0) + 1 for p in pads)  # a larger pad for some only leaves larger sets to walk through
        lists = batch.column(len(keys))
        flat = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        b = np.stack([c.to_numpy(zero_copy_only=False) for c in flat.flatten()], 1) if len(flat) else np.zeros((0, 5), np.int64)
        span = (b[:, :4].max(initial=0) - b[:, :4].min(initial=0) + 4 * (wide + 2)) * row
        of = closed_sets(b[:, :4] + np.c_[span, np.zeros(len(b)), span, np.zeros(len(b))], wide, tall)
        order = np.argsort(of, kind="stable")
        edge = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]]) if len(b) else []
        group = b[:, 4].copy()
        for low, high in zip(edge, [*edge[1:], len(b)]):
            if high - low > 1:
                own = order[low:high]
                place = {tuple(r): k for k, r in zip(own.tolist(), b[own].tolist())}
                of_group = row[own[0]]
                for members in _clustered([tuple(r) for r in b[own].tolist()], *(float(p[of_group]) for p in pads)):
                    least = min(m[4] for m in members)
                    for m in members:
                        group[place[m]] = least
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(len(keys))], pa.array(b[:, 4]), pa.array(group)], [*keys, "seq", "grp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, batch.column(len(keys))):
                yield closed(piece)

    return listed.mapInArrow(run, schema)
