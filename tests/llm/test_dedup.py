"""Line, substring and n-gram deduplication against brute force."""

import hashlib
import tracemalloc
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from stavegrid.llm import jaccard, linededup, links, substring

from . import cases

SPACES = " \t\n\v\f\r"


def words_of(text):
    return (text or "").encode().split()


def brute_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute_sets(texts, width=5):
    sets = {}
    for k, t in texts.items():
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words_of(t)]
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return sets


def brute_classes(texts):
    sets = brute_sets(texts)
    edges = [(a, b) for a, b in combinations(sets, 2) if (both := len(sets[a] & sets[b])) and 100 * both >= 75 * len(sets[a] | sets[b])]
    return sets, brute_components(sets, edges)


def test_jaccard_classes(spark):
    docs = cases.awkward_documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets, roots = brute_classes(texts)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()}
    assert found == {k: (len(sets[k]), roots[k]) for k in texts}


def test_jaccard_star_of_near_copies(spark):
    """A centre whose leaves link with it alone, more leaves than a small posting has."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(400)]
    texts = {}
    for k in range(80):
        w = list(base)
        for i in rng.choice(400, 9, replace=False):
            w[i] = f"e{k}_{i}"
        texts[k] = " ".join(w)
    texts[80] = " ".join(base)
    sets, roots = brute_classes(texts)
    assert len(set(roots.values())) < 5
    found = jaccard.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == roots


def test_jaccard_edges(spark):
    assert jaccard.classes(cases.no_documents(spark)).count() == 0
    found = sorted(map(tuple, jaccard.classes(cases.repeated_documents(spark)).collect()), key=str)
    assert sorted(r[2] for r in found if r[0] == 1) == [1, 1, 1]
    assert [r[2] for r in found if r[0] == 7] == [1]  # the text of another row with id 1
    assert {r[1]: r[2] for r in found if r[0] is None} == {0: None, 10: 1}
    kept = jaccard.keep_first(cases.repeated_documents(spark)).collect()
    assert len(kept) == 4  # both equal rows, the other text of id 1, the row without text
    docs = cases.awkward_documents(spark)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    _, roots = brute_classes({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in kept.collect()} == set(roots.values())


def brute_substrings(texts):
    first, gone = {}, defaultdict(set)
    for k in sorted(texts):
        w = words_of(texts[k])
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in first:
                gone[k].update(range(i, i + 20))
            first.setdefault(window, (k, i))
    return {k: [w for i, w in enumerate(words_of(t)) if i not in gone[k]] for k, t in texts.items()}


def test_substrings(spark):
    docs = cases.awkward_documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = brute_substrings(texts)
    for r in substring.digest(docs).collect():
        n = len(words_of(texts[r.doc_id]))
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, n - len(kept[r.doc_id]), hashlib.sha256(b" ".join(kept[r.doc_id])).hexdigest()), r.doc_id
    changed = substring.deduplicate(docs)
    assert changed.schema == docs.schema
    for r in changed.collect():
        assert words_of(r.text) == kept[r.doc_id]


def test_substring_edges(spark):
    assert substring.digest(cases.no_documents(spark)).count() == 0
    found = sorted(((r.doc_id or -1, r.n_words, r.n_removed) for r in substring.digest(cases.repeated_documents(spark)).collect()))
    texts = {1: next(r.text for r in cases.repeated_documents(spark).collect() if r.text and r.text.startswith("alpha"))}
    own = 40 - len(brute_substrings(texts)[1])
    assert found == [(-1, 0, 0), (-1, 40, 40), (1, 2, 0), (1, 40, own), (1, 40, own), (7, 2, 0)]  # equal rows are one document


def test_windows_that_differ_in_one_word(spark):
    """Also where any four of their words share their first 16 bits of hash."""
    import pyarrow as pa

    from stavegrid.llm.common import window_hashes, word_hashes

    lead = " ".join(f"lead{k}" for k in range(16))
    seen, rows = {}, []
    for k in range(3000):
        words, _ = word_hashes(pa.array([f"same words here v{k}"]))
        short = int(window_hashes(words, 4)[0] >> np.uint64(48))
        if short in seen:
            n = len(rows) // 2
            rows += [(2 * n, f"{n} {lead} {seen[short]}"), (2 * n + 1, f"{n} {lead} same words here v{k}")]
        seen.setdefault(short, f"same words here v{k}")
    assert len(rows) > 40
    docs = spark.createDataFrame([(i, " ".join(t.split()[:1] + t.split()[2:])) for i, t in rows], "doc_id long, text string")
    assert {r.n_removed for r in substring.digest(docs).collect()} == {0}


def test_passages(spark):
    docs = cases.awkward_documents(spark)
    want = []
    for k, kept in brute_substrings({r.doc_id: r.text for r in docs.collect()}).items():
        want.append((k, len(words_of(cases.awkward_texts()[k])) - len(kept)))
    found = defaultdict(int)
    for r in substring.passages(docs).collect():
        assert r.n_words >= 20
        found[r.doc_id] += r.n_words
    assert dict(found) == {k: n for k, n in want if n}
    assert substring.passages(cases.no_documents(spark)).count() == 0


def test_prefix_plan_splits_heavy_prefixes():
    counts = np.array([5, 900, 3, 0, 40])
    more, first, tasks = substring.prefix_plan(counts, 4, group=100)
    assert more.tolist() == [0, 4, 0, 0, 0]
    assert tasks == first[-1] + 1
    spans = [set(range(first[k], first[k] + (1 << more[k]))) for k in range(5)]
    assert not spans[1] & (spans[0] | spans[2] | spans[4])


def brute_lines(texts, width=linededup.SHINGLE):
    """Kept lines by exact pairwise similarity."""
    lines = [(k, i, x) for k in sorted(texts) for i, x in enumerate((texts[k] or "").split("\n")) if x.strip(SPACES)]
    distinct = sorted({x for *_, x in lines})
    sets = {x: {x[i : i + width] for i in range(len(x) - width + 1)} for x in distinct}
    edges = [(a, b) for a, b in combinations(distinct, 2) if (both := len(sets[a] & sets[b])) and 100 * both >= 75 * len(sets[a] | sets[b])]
    roots, seen, gone = brute_components(distinct, edges), set(), defaultdict(set)
    for k, i, x in lines:
        if roots[x] in seen:
            gone[k].add(i)
        seen.add(roots[x])
    return gone


def test_lines(spark):
    docs = cases.awkward_documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    gone = brute_lines(texts)
    found = {r.doc_id: r for r in linededup.digest(docs).collect()}
    assert len(found) == len(texts)
    wrong = 0
    for k, t in texts.items():
        kept = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[k])
        wrong += (found[k].n_removed, found[k].kept_sha256) != (len(gone[k]), hashlib.sha256(kept.encode()).hexdigest())
    assert wrong <= 1  # banding misses a pair at the threshold with probability 0.002
    changed = linededup.deduplicate(docs)
    assert changed.columns == docs.columns
    assert all(r.text is None or r.text.strip(SPACES) or not (texts[r.doc_id] or "").strip(SPACES) for r in changed.collect())


def test_line_edges(spark):
    assert linededup.digest(cases.no_documents(spark)).count() == 0
    found = sorted((r.doc_id or -1, r.n_lines, r.n_removed) for r in linededup.digest(cases.repeated_documents(spark)).collect())
    assert found == [(-1, 0, 0), (-1, 1, 1), (1, 1, 0), (1, 1, 0), (1, 1, 0), (7, 1, 1)]


def test_minhash_recall():
    rng = np.random.default_rng(0)
    hit = total = 0
    for _ in range(150):
        n = 80
        extra = int(n * 0.3 / 2)  # similarity about 0.77
        common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, extra, dtype=np.uint64)]) for _ in range(2))
        x, y = (linededup.band_hashes(linededup.signatures(s, np.array([len(s)])))[0] for s in (a, b))
        hit += (x == y).any()
        total += 1
    assert hit >= 0.97 * total


@pytest.mark.parametrize("alone", [0, links.ALONE])
def test_components(spark, monkeypatch, alone):
    monkeypatch.setattr(links, "ALONE", alone)
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    found = {r.node: r.root for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e}
    roots = brute_components(nodes, edges)
    assert found == {n: r for n, r in roots.items() if n in found}
    assert all(roots[n] == n for n in nodes - found.keys())
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_postings_lose_no_link(spark, monkeypatch):
    """More members in one posting than a block's side, near copies, members
    linked with one of them alone, and members that are linked with none."""
    rng = np.random.default_rng(12)
    base = [f"w{k}" for k in range(100)]
    texts = {}
    for k in range(700):
        w = list(base)
        for i in rng.choice(100, (2, 3, 4, 5)[k % 4], replace=False):  # 3 edits and more are far from most others
            w[i] = f"e{k}_{i}"
        texts[k] = " ".join(w)
    for k in range(700, 1000):  # the same passage in other texts
        texts[k] = " ".join([f"a{k}_{i}" for i in range(60)] + base[:55] + [f"b{k}_{i}" for i in range(10)])
    _, roots = brute_classes(texts)
    assert 310 < len(set(roots.values())) < 990
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (links.BLOCK, 64):
        monkeypatch.setattr(links, "BLOCK", block)
        found = jaccard.classes(docs).collect()
        assert {r.doc_id: r.component_id for r in found} == roots


def test_only_lines_that_recur_are_ranked(spark, monkeypatch):
    """A line that occurs once and has no near duplicate is not ranked."""
    rows, real = {}, linededup.materialize

    def counted(df, name):
        out = real(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(linededup, "materialize", counted)
    near = "the quick brown fox jumps over the lazy dog and runs away " * 3
    texts = [f"line {hashlib.md5(str(k).encode()).hexdigest()} of its own" for k in range(50)] + ["twice", "twice", near, near + "!"]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, text_hash long")
    found = linededup.repeated_lines(docs).collect()
    assert {(r.doc_id, *r.numbers) for r in found} == {(51, 0), (53, 0)}
    assert rows["lines"] == 54 and rows["again"] == 4


def test_shingles_are_made_by_stretches(monkeypatch):
    """The same for any length of stretch, and little memory besides what comes out."""
    lines = ["", "short", "1234567", "12345678", "é" * 9, "\U0001F600" * 11 + "end", "x" * 300, "more of it, and more of it", "Ж€" * 40]
    raw = np.frombuffer("\n".join(lines).encode(), np.uint8)
    ends = np.cumsum([len(x.encode()) + 1 for x in lines]) - 1
    starts = ends - [len(x.encode()) for x in lines]
    some = np.array([len(x) >= linededup.SHINGLE for x in lines])
    found = []
    for most in (1, 20, 1 << 16):
        monkeypatch.setattr(linededup, "_CHUNK", most)
        shingles, count = linededup._character_shingles(raw, starts, ends)
        found.append((shingles.tolist(), count.tolist(), linededup.signatures(shingles, count[some]).tolist(), linededup._sizes(shingles, count[some]).tolist()))
    assert found[0] == found[1] == found[2]
    assert found[0][1] == [max(0, len(x) - 7) for x in lines]
    assert found[0][3] == [len({x[k : k + 8] for k in range(len(x) - 7)}) for x in lines if len(x) >= 8]
    raw = np.tile(np.frombuffer(b"a line of thirty-two characters\n", np.uint8), 1 << 15)
    starts = np.arange(0, len(raw), 32)
    tracemalloc.start()
    shingles, count = linededup._character_shingles(raw, starts, starts + 31)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(shingles) == 24 << 15 and most < 3 * shingles.nbytes


def test_values_that_repeat():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 50, 1000):
        h = rng.integers(0, 600, n).astype(np.uint32) * np.uint32(7_000_000)
        value, many = np.unique(h, return_counts=True)
        assert sorted(links._repeated(h).tolist()) == np.flatnonzero(np.isin(h, value[many > 1])).tolist()


def test_partnered_members():
    rng = np.random.default_rng(5)
    for _ in range(200):
        m = int(rng.integers(1, 40))
        of = np.sort(rng.integers(0, 4, m))
        n = rng.integers(1, 60, m)
        pos = rng.integers(0, n // 3 + 1)
        want = [any(j != i and of[j] == of[i] and min(n[i] - pos[i], n[j] - pos[j]) >= links.need(n[i], n[j], (75, 100)) for j in range(m)) for i in range(m)]
        assert links._partnered(n, pos, of, (75, 100)).tolist() == want


def test_overlaps_and_similar_rows():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64)[:n]) for n in rng.integers(0, 60, 30)]
    sets += [np.concatenate([s[: len(s) // 2], t[len(t) // 2 :]]) for s, t in zip(sets, sets[1:])]
    at = np.r_[0, np.cumsum([len(s) for s in sets])]
    n, both = links.overlaps(np.concatenate(sets), at)
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    assert n.tolist() == [len(set(s.tolist())) for s in sets]
    assert (both - np.diag(both.diagonal()) == np.array(want) - np.diag(np.diagonal(want))).all()
    column = pa.array([jaccard._short(s) for s in sets], pa.binary())
    other = column.take(pa.array(rng.permutation(len(sets))))
    again = [set(s.tolist()) for s in np.split(*(lambda h, a: (h, a[1:-1]))(*jaccard._long(other)))]
    one = [set(s.tolist()) for s in np.split(*(lambda h, a: (h, a[1:-1]))(*jaccard._long(column)))]
    assert links.similar_rows(column, other, jaccard._long, (75, 100)).tolist() == [100 * len(x & y) >= 75 * len(x | y) for x, y in zip(one, again)]
