"""Centroids, hard negatives and mixing against brute force, on awkward rows."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stavegrid.llm import centroids, mixing, negatives

from .cases import awkward_documents, awkward_texts, no_documents, repeated_documents

VECTORS = "vec_id long, embedding array<double>, label int, id long, v string, h long"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, label, 1, "x", 2) for i, v, label in rows], VECTORS).repartition(parts)


def unusable(d):
    good = [0.5] * d
    return [(None, good, 1), (900, None, 1), (901, [], 1), (902, [float("nan"), *good[1:]], 2), (903, [*good[1:], float("inf")], 2), (904, [None, *good[1:]], 2)]


# ------------------------------------------------------------------- centroids
def brute_clusters(rows, k, rounds, d, scale=1024, seed=3):
    """Lloyd's rounds in Python's integers."""
    usable = [(i, [int(np.floor(scale * x)) for x in v]) for i, v, _ in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    by_hash = sorted(usable, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()))
    centers = [v for _, v in by_hash[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centers)), key=lambda c: (gap(v, centers[c]), c))
    for _ in range(rounds):
        of = [nearest(v) for _, v in usable]
        for c in range(len(centers)):
            own = [v for (_, v), o in zip(usable, of) if o == c]
            if own:
                centers[c] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, nearest(v), gap(v, centers[nearest(v)])) for i, v in usable]
    sums = Counter()
    for _, c, g in out:
        sums[c] += g
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, g, sums[c], sum(sums.values()), sha[c]) for i, c, g in out), key=str)


def awkward_vectors(d, n=300, seed=2):
    r = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in r.normal(size=d)], k % 4) for k in range(n)]
    rows += [(n + k, [0.25] * d, 1) for k in range(60)] + [(n + k, [0.25] * d, 2) for k in range(10)]  # copies, repeated ids
    rows += [(2 * n + k, [float(x) * 2.0**-9 for x in r.integers(-3, 3, d)], k % 3) for k in range(80)]  # many ties
    return rows


@pytest.mark.parametrize("d, k", [(3, 5), (8, 8)])
def test_clusters(spark, d, k):
    rows = awkward_vectors(d) + unusable(d) + [(5, [1.0] * (d + 1), 1)]
    found = centroids.cluster(table(spark, rows), k=k, rounds=4, d=d).collect()
    assert sorted(map(tuple, found), key=str) == brute_clusters(rows, k, 4, d)


def test_clusters_of_huge_components(spark):
    """Beyond float32, beyond what a long holds in sums, and side by side."""
    rows = [(k, [2.0 ** (40 + k % 3) + k, -(2.0**41), 1e30 if k % 5 == 0 else 3.0], 0) for k in range(50)] + [(99, [1e300, 0.0, 0.0], 1)]
    want = brute_clusters(rows, 4, 3, 3)
    found = centroids.cluster(table(spark, rows), k=4, rounds=3, d=3).collect()
    most = 2**63 - 1
    assert sorted(map(tuple, found), key=str) == sorted(((i, c, min(a, most), min(b, most), min(t, most), s) for i, c, a, b, t, s in want), key=str)


def test_few_or_no_vectors(spark):
    assert centroids.cluster(table(spark, unusable(3)[1:]), d=3).collect() == []
    one = centroids.cluster(table(spark, [(1, [0.1, 0.2, 0.3], 0)]), d=3).collect()
    assert [(r.vec_id, r.cluster, r.distance) for r in one] == [(1, 0, 0)]


def test_intervals_hold():
    """Centroids a unit apart at 2**24 are beyond float32: exact integers decide, and ties go to the smaller number."""
    x = np.array([[2.0**24 + 1, 0], [2.0**24, 1], [5, 5]])
    centers = [[2**24 + 2, 0], [2**24, 0], [2**24, 2], [2**24, 0]]
    screen = centroids.Screen(centers)
    gaps = [[sum((int(a) - b) ** 2 for a, b in zip(row, c)) for c in centers] for row in x.tolist()]
    assert screen.assign(x).tolist() == [min(range(4), key=lambda c: (g[c], c)) for g in gaps]
    assert screen.unsure >= 2
    r = np.random.default_rng(1)
    rows, own = np.floor(1024 * r.normal(size=(4000, 64))), [[int(v) for v in np.floor(1024 * r.normal(size=64))] for _ in range(8)]
    screen = centroids.Screen(own)
    exact = ((rows[:, None, :] - np.array(own)[None]) ** 2).sum(-1)
    assert (screen.assign(rows) == exact.argmin(1)).all() and screen.unsure < 40


# ------------------------------------------------------------- hard negatives
def brute_negatives(rows, anchor, positives=5, negatives=10, low=30, high=90):
    usable = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = {}
    for i, label, v in usable:
        if anchor(i):
            first[i] = min(first.get(i, (v, label)), (v, label))
    out = []
    for i, (v, label) in first.items():
        score = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in usable if j != i]
        for s, j, _ in sorted(t for t in score if t[2] == label)[:positives]:
            hits = sorted(t for t in score if t[2] != label and low * -s <= 100 * -t[0] <= high * -s)[:negatives]
            out += [(i, j, rank, h[1], -s, -h[0]) for rank, h in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives(spark, seed, monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET", 16)
    monkeypatch.setattr(negatives, "BLOCK", 20)  # several scans
    r = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in np.abs(r.normal(size=4)) * r.choice([0.01, 1, 30])], int(r.integers(0, 3))) for k in range(400)]
    rows += [(1000 + k, [0.5, 0.5, 0.5, 0.5], k % 3) for k in range(150)] + [(3, [1.0, 0.0, 0.0, 0.0], 1), (2000, [0.0] * 4, 0), (2005, [-1.0] * 4, 0)]
    rows += unusable(4)[:2] + unusable(4)[3:] + [(905, [0.5] * 4, None)]
    found = negatives.mine(table(spark, rows), F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, found)) == brute_negatives(rows, lambda i: i % 5 == 0)


def test_no_negatives(spark):
    assert negatives.mine(table(spark, unusable(4)), F.col("vec_id") % 5 == 0).collect() == []
    alone = [(0, [1.0, 0.0], 1), (5, [0.0, 1.0], 2)]
    assert negatives.mine(table(spark, alone), F.col("vec_id") % 5 == 0).collect() == []


def test_norms_leave_out_buckets():
    """Where norms differ, most pairs get no score."""
    r = np.random.default_rng(3)
    n = 4096
    x = np.floor(256 * r.normal(size=(n, 16)) * np.exp(-6 * np.arange(n) / n)[:, None])
    order = np.argsort(-np.sqrt((x * x).sum(1)), kind="stable")
    low, high = np.full((20, 1), -(2**63)), np.full((20, 1), 2**63 - 1)
    search = negatives.WindowSearch(np.arange(20) + 10**6, np.zeros(20, np.int64), x[:20], low, high, 5, True)
    for at in range(0, n, 512):
        search.offer(0, order[at : at + 512], x[order[at : at + 512]])
    assert search.scored < 0.5 * search.met
    for a in range(20):
        want = sorted(zip(-(x @ x[a]).astype(int), range(n)))[:5]
        assert [(-s, i) for w, s, i in zip(*search.found) if w == a] == want


def test_values_beyond_a_long(spark):
    rows = [(0, [1e18, 1e18], 1), (1, [1e18, 1.0], 1), (2, [2e17, 0.0], 2), (3, [5e17, 1.0], 3)]
    found = negatives.mine(table(spark, rows), F.col("vec_id") == 0)
    assert all(r.positive_score == 2**63 - 1 for r in found.collect())


# ---------------------------------------------------------------------- mixing
def brute_targets(sizes, most=3):
    """Share by weight, cut what is above, share again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, over = {s: 0.0 for s in names}, set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in over)
        free = sum(weight[s] for s in names if s not in over)
        target = {s: most * sizes[s] if s in over else weight[s] * rest / free for s in names}
        more = {s for s in names if s not in over and target[s] > most * sizes[s]}
        if not more:
            return target
        over |= more


def words(text):
    return len((text or "").encode("utf-8", "surrogatepass").split())


def test_mix(spark):
    docs = awkward_documents(spark)
    rows, names = mixing.copies(docs, docs.columns)
    assert rows.columns == [*docs.columns, *names]
    found = [(r[: len(docs.columns)], *r[len(docs.columns) :]) for r in map(tuple, rows.collect())]
    assert sorted(r[0][0] for r in found) == list(range(len(awkward_texts())))
    sizes, taken, longest = Counter(), Counter(), Counter()
    for (_, text, _, source, *_), size, *_, times in found:
        assert size == words(text)
        sizes[source] += size
        taken[source] += size * times
        longest[source] = max(longest[source], size)
    target = brute_targets(dict(sizes))
    for (_, _, _, source, *_), size, whole, want, times in found:
        assert whole == sizes[source] and want == pytest.approx(target[source])
        rate = want / whole if whole else 0
        assert int(rate) <= times <= min(3, int(rate) + 1)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)
    again = [tuple(r) for r in mixing.copies(docs.repartition(2), docs.columns)[0].collect()]
    assert sorted(again, key=str) == sorted((tuple([*r[0], *r[1:]]) for r in found), key=str)


def test_mix_emits_copies(spark):
    docs = awkward_documents(spark)
    rows, (*_, times) = mixing.copies(docs, ["doc_id"])
    want = {r.doc_id: r[times] for r in rows.collect() if r[times]}
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy"]
    assert Counter(r.doc_id for r in out.collect()) == want


def test_mix_of_repeats_and_nothing(spark):
    rows, (size, whole, target, times) = mixing.copies(repeated_documents(spark), ["doc_id", "source"])
    found = rows.collect()
    assert len(found) == 6 and all(0 <= r[times] <= 3 for r in found)
    assert sum(r[size] for r in found) == pytest.approx(sum({r.source: r[target] for r in found}.values()))
    assert mixing.copies(no_documents(spark), ["doc_id"])[0].collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    rows, names = mixing.copies(blank, ["doc_id"])
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_targets_stop_at_three_times(spark):
    """One source holds nearly all words, so small ones are capped one after the other."""
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 900, "e": 40, "f": 100000, None: 7}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(table, (1, 2, 3), 3).collect()}
    assert found == pytest.approx(brute_targets(sizes)) and sum(found.values()) == pytest.approx(sum(sizes.values()))


def test_one_source_over_many_partitions(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.col("id").cast("int") % 50 + 1).alias("text"), F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("hot").alias("source"))
    rows, (size, _, target, times) = mixing.copies(docs, ["doc_id", "source"])
    hot = rows.where("source = 'hot'").agg(F.sum(F.col(size) * F.col(times)).alias("n"), F.first(target).alias("t")).first()
    assert abs(hot.n - hot.t) <= 50
