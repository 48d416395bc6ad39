"""The relational path over whole pages against the dense one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stavegrid.operators import boxes, page, symbols
from stavegrid.operators.page import PageDetector
from stavegrid.plans import relational
from stavegrid.schema import RECORDS
from stavegrid.sources import images


def marked_page(seed: int, staves: int = 2) -> np.ndarray:
    """A score page with words, sharps, rests, slurs, specks and ledger notes besides."""
    r = np.random.default_rng(seed)
    page, _ = images.score_page(seed, staves=staves, width=420)
    for k in range(staves):
        y0 = 96 + 168 * k
        for n in range(5):  # words above the staff
            x, y = 190 + 14 * n, y0 - 44 + int(r.integers(0, 3))
            page[y : y + 9, x : x + 8] = 0
            page[y + 2 : y + 6, x + 2 : x + 6] = 255
        x, y = 96, y0 + 4  # a sharp
        for dx in (0, 1, 7, 8):
            page[y : y + 32, x + dx + 2] = 0
        for dy in (3, 4, 15, 16, 26, 27):
            page[y + dy, x : x + 13] = 0
        page[y0 + 15 : y0 + 20, 290:304] = 0  # a rest between lines
        page[y0 + 66 : y0 + 70, 240:275] = 0  # a beam below
        for dx in range(60):  # a slur
            page[y0 + 62 + int(0.02 * (dx - 30) ** 2) : y0 + 63 + int(0.02 * (dx - 30) ** 2), 330 + dx] = 0
        yy, xx = np.mgrid[: page.shape[0], : page.shape[1]]
        page[((xx - 150) / 8.6) ** 2 + ((yy - (y0 + 73)) / 5.6) ** 2 <= 1] = 0  # a note on a ledger line
        page[y0 + 72 : y0 + 74, 138:163] = 0
    page[r.integers(0, page.shape[0], 40), r.integers(0, page.shape[1], 40)] = 90  # specks
    return page


@pytest.fixture(scope="module")
def both(spark):
    seeds = [4]
    dense = {f"page-{s}": PageDetector(marked_page(s)).run() for s in seeds}
    rows = [(f"page-{s}", y, x, int(v)) for s in seeds for y, line in enumerate(marked_page(s)) for x, v in enumerate(line)]
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["page_id", "y", "x", "g"])).cache()
    pages = frame.groupBy("page_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.lit(None).alias("threshold"))
    ink = relational.cut(relational.ink_of(frame))
    candidates, staves = relational.found_staves(ink, pages, 420)
    tables = relational.detect(ink, pages, staves)
    return dense, {r.page_id: r for r in relational.assembled(tables, pages, candidates).collect()}


def plain(value):
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, np.ndarray)):
        return [plain(v) for v in value]
    return round(float(value), 9) if isinstance(value, (float, np.floating)) else int(value) if isinstance(value, (int, np.integer)) else value


@pytest.mark.parametrize("name", list(RECORDS))
def test_records_equal_the_dense_ones(both, name):
    dense, found = both
    fields = [f.split(" ")[0] for f in RECORDS[name].split(", ")]
    for page, want in dense.items():
        rows = [{f: plain(r[f]) for f in fields} for r in found[page][name]]
        assert rows == [{f: plain(w[f]) for f in fields} for w in want.records[name]], page
    if name not in ("accidentals", "rests"):
        assert any(found[p][name] for p in found), "nothing to compare"


def test_first_fit_takes_the_first_row():
    """Row medians move as boxes join, and the first row in reach is taken, not the nearest."""
    assert symbols.first_fit([0.0, 3.0, 4.5, 5.0, 9.0], 3.0) == [0, 0, 0, 0, 1]
    r = np.random.default_rng(6)
    centers = sorted(r.integers(0, 300, 120) / 2)
    rows, want = [], []
    for c in centers:
        home = next((k for k, row in enumerate(rows) if abs(c - np.median(row)) <= 4.3), None)
        if home is None:
            rows.append([])
            home = len(rows) - 1
        rows[home].append(c)
        want.append(home)
    assert symbols.first_fit(centers, 4.3) == want
    assert symbols.first_fit([], 1.0) == []


@pytest.mark.parametrize("share", [0.1, 0.3, 0.45, 0.7])
def test_connected_runs_equal_components(share):
    mask = np.random.default_rng(int(100 * share)).random((40, 50)) < share
    runs = page.row_runs(mask)
    label = symbols.connected_runs(runs[:, 0], runs[:, 1], runs[:, 2] - 1)
    found = []
    for k in np.unique(label):
        own = runs[label == k]
        found.append((int(own[:, 1].min()), int(own[:, 0].min()), int(own[:, 2].max()), int(own[:, 0].max()) + 1, int((own[:, 2] - own[:, 1]).sum())))
    assert sorted(found) == sorted(tuple(map(int, b)) for b in page.components(mask))


def test_flags_and_pairs_by_strips(spark):
    """Marks strips apart, and one box over many strips."""
    r = np.random.default_rng(8)
    rows = [(int(r.integers(0, 2)), k, int(x), int(y), int(x + w), int(y + 9)) for k, (x, y, w) in enumerate(zip(r.integers(-300, 900, 90), r.integers(0, 60, 90), r.integers(1, 400, 90)))]
    boxes_ = spark.createDataFrame(rows, "page_id int, seq int, x0 int, y0 int, x1 int, y1 int")
    a, b = boxes_.where("seq % 2 = 0"), boxes_.where("seq % 2 = 1")
    near = lambda p, q: boxes.intersects(p, q, 3)
    meet = {(p[1], q[1]) for p in rows for q in rows if p[1] % 2 == 0 and q[1] % 2 == 1 and p[0] == q[0] and min(p[4], q[4] + 3) > max(p[2], q[2] - 3) and min(p[5], q[5] + 3) > max(p[3], q[3] - 3)}
    pairs = [(x.a, x.b) for x in boxes.near_pairs(a, b, ["page_id"], near, 3).select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b")).collect()]
    assert sorted(pairs) == sorted(meet)
    flags = {x.seq for x in symbols.flagged(a, symbols.spans(b), near, F.lit(3), "hit", ["page_id"]).where("hit").collect()}
    assert flags == {p for p, _ in meet}
