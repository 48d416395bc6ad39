"""Operators on hand-made cases, each pinning one rule."""

import json
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stavegrid.operators import beams, boxes, durable, marks, masks, notes, page, raster, runs, staves
from stavegrid.params import DEFAULTS
from stavegrid.plans import mark_queries, page_queries, pipeline, registry, sinks
from stavegrid.schema import RECORDS
from stavegrid.sources import images


def ink(spark, pixels):
    return spark.createDataFrame([(1, int(y), int(x)) for y, x in pixels], "page_id int, y int, x int")


@pytest.mark.parametrize("levels,want", [([(10, 5), (200, 5)], 10), ([(77, 9)], 180), ([(0, 1), (100, 1), (200, 1)], 0)])
def test_otsu(spark, levels, want):
    pixels = [(1, 0, k, g) for k, g in enumerate(g for g, n in levels for _ in range(n))]
    found = raster.otsu_threshold(spark.createDataFrame(pixels, "page_id int, y int, x int, g int")).first().otsu
    assert found == want == page.otsu(np.array([[p[3] for p in pixels]], np.uint8), 180)


def test_threshold_clamp(spark):
    frame = spark.createDataFrame([(100,), (150,), (200,)], "o int").select(raster.ink_threshold(F.col("o")).alias("t"))
    assert [r.t for r in frame.collect()] == [170, 185, 212]


def test_islands_and_gap_kinds(spark):
    column = [(y, 0) for y in [0, 1, 9, 10, 11, 20, 21]]  # seven blanks, then eight
    found = runs.longest_column_run(ink(spark, column)).first()
    assert (found.start, found.end, found.length) == (0, 11, 12)
    assert page.longest_island(np.isin(np.arange(30), [c[0] for c in column]), 8) == (0, 11)
    two = runs.islands(ink(spark, [(1, 0), (2, 0), (4, 0)]), ["page_id"], "y", 1).orderBy("start").collect()
    assert [(r.start, r.end) for r in two] == [(1, 2), (4, 4)]
    first = runs.longest_run(ink(spark, [(0, 0), (0, 1), (0, 5), (0, 6)]), ["page_id", "y"], "x").first()
    assert (first.start, first.end) == (0, 1)
    assert page.longest_island(np.zeros(4, bool)) == (0, -1)


def test_long_runs_are_cut_before_they_are_measured(spark):
    r = spark.createDataFrame([(1, 5, 0, 30), (1, 6, 10, 14)], "page_id int, y int, x0 int, x1 int")
    region = spark.createDataFrame([(1, 28, 0, 60, 10)], "page_id int, x0 int, y0 int, x1 int, y1 int")
    assert runs.long_runs(r, region, 4).count() == 0
    assert runs.long_runs(r, region, 3).collect()[0][2:] == (28, 30)


def brute_components(mask):
    seen, out = set(), []
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) in seen:
            continue
        stack, own = [(y, x)], set()
        while stack:
            p = stack.pop()
            if p in own:
                continue
            own.add(p)
            stack += [(p[0] + dy, p[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if 0 <= p[0] + dy < mask.shape[0] and 0 <= p[1] + dx < mask.shape[1] and mask[p[0] + dy, p[1] + dx]]
        seen |= own
        ys, xs = zip(*own)
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(own)))
    return out


def test_components(spark):
    rng = np.random.default_rng(0)
    for density in (0.2, 0.45, 0.6):
        mask = rng.random((40, 50)) < density
        want = brute_components(mask)
        assert page.components(mask) == want  # also the order
        found = masks.component_boxes(masks.label_runs(runs.ink_runs(ink(spark, np.argwhere(mask)))))
        assert sorted((r.x0, r.y0, r.x1, r.y1, r.area) for r in found.collect()) == sorted(want)
    assert page.components(np.zeros((3, 3), bool)) == [] == page.components(np.ones((3, 3), bool), 5, 5, 9, 9)


def test_specks_are_eight_connected(spark):
    pixels = [(0, 0), (1, 1), (10, 0), (11, 1), (12, 2)]
    mask = np.zeros((20, 5), bool)
    mask[tuple(zip(*pixels))] = True
    assert page.without_specks(mask, 3).sum() == 3
    assert masks.drop_specks(runs.ink_runs(ink(spark, pixels)), 3).count() == 3


def test_suppressed_boxes_suppress_nothing(spark):
    rows = [("p", 1, 0, 0, 10, 10, 0.9), ("p", 2, 8, 0, 18, 10, 0.8), ("p", 3, 16, 0, 26, 10, 0.7), ("p", 4, 100, 0, 110, 10, 0.7), ("p", 5, 100, 0, 110, 10, 0.7)]
    frame = spark.createDataFrame(rows, "page string, seq int, x0 int, y0 int, x1 int, y1 int, score double")
    kept = boxes.suppress(frame, ["page"], ["x0", "y0", "x1", "y1"], boxes.boxes_conflict(1))
    assert sorted(r.seq for r in kept.collect()) == [1, 3, 4]
    items = [{"staff": 0, "bbox": list(r[2:6]), "score": r[6], "seq": r[1]} for r in rows]
    assert sorted(i["seq"] for i in page.kept(items, page.boxes_clash(1), page.by_box)) == [1, 3, 4]


def test_runs_of_suppression(spark):
    """Chains that meet, touch and lie apart, nested and inverted boxes, no columns: the same with and without runs."""
    r = np.random.default_rng(3)
    rows = [(k % 4, k, int(x), int(y), int(x + w), int(y + h), float(r.integers(0, 9))) for k, (x, y, w, h) in enumerate(zip(r.integers(0, 900, 240), r.integers(0, 40, 240), r.integers(-4, 40, 240), r.integers(1, 30, 240)))]
    rows += [(0, 500, None, 0, None, 5, 1.0), (5, 501, 7, 0, 7, 5, 1.0), (5, 502, 13, 0, 20, 5, 1.0)]
    frame = spark.createDataFrame(rows, "page int, seq int, x0 int, y0 int, x1 int, y1 int, score double")
    for conflict, reach in ((boxes.boxes_conflict(3), (F.col("x0") - 3, F.col("x1") + 3)), (boxes.ends_conflict(60.5), (F.col("x0"), F.col("x0") + 61))):
        whole, runs_ = (sorted(map(tuple, boxes.suppress(frame, ["page"], ["x0", "y0", "x1", "y1"], conflict, reach=by).collect()), key=str) for by in (None, reach))
        assert runs_ == whole and len(whole) < len(rows)
    assert boxes.suppress(frame.where("page = 9"), ["page"], ["x0", "x1"], boxes.ends_conflict(1), reach=(F.col("x0"), F.col("x0") + 2)).count() == 0


def test_margins(spark):
    apart = spark.createDataFrame([(0, 0, 10, 10, 12, 0, 22, 10)], "ax0 int, ay0 int, ax1 int, ay1 int, bx0 int, by0 int, bx1 int, by1 int")
    a, b = (lambda c: F.col("a" + c)), (lambda c: F.col("b" + c))
    got = apart.select(boxes.intersects(a, b, 2).alias("two"), boxes.intersects(a, b, 3).alias("three"), boxes.holds_point(a, F.lit(12.0), F.lit(5), 2.0).alias("edge"), marks.near_group(a, b, 2).alias("touch")).first()
    assert tuple(got) == (False, True, True, True)


def brute_clusters(rows, px, py):
    groups = [[r] for r in sorted(rows)]
    hull = lambda g: (min(r[0] for r in g), min(r[1] for r in g), max(r[2] for r in g), max(r[3] for r in g))
    meet = lambda a, b: min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])
    while True:
        for i, g in enumerate(groups):
            for j, other in enumerate(groups):
                h, o = hull(g), hull(other)
                if i != j and meet((int(h[0] - px), int(h[1] - py), int(h[2] + px), int(h[3] + py)), o):
                    groups = [x for k, x in enumerate(groups) if k not in (i, j)] + [g + other]
                    break
            else:
                continue
            break
        else:
            return {frozenset(g) for g in groups}


def test_cluster_boxes():
    rng = np.random.default_rng(1)
    for _ in range(20):
        rows = [(int(x), int(y), int(x + w), int(y + h), k) for k, (x, y, w, h) in enumerate(rng.integers(1, 60, (14, 4)) // np.array([1, 1, 6, 6]) + 1)]
        assert {frozenset(g) for g in boxes.cluster_boxes(rows, 3.0, 3.0)} == brute_clusters(rows, 3.0, 3.0)


def test_six_lines_are_one_staff(spark):
    lines = spark.createDataFrame([(1, 10.0 * k, 10.0) for k in range(6)], "page_id int, y double, space double")
    assert [(r.staff, r.top, r.bottom) for r in staves.group_staves(lines).collect()] == [(0, 0.0, 40.0)]
    assert staves.staff_space(lines).first().space == 10.0
    assert staves.staff_space(lines.where("y = 0")).first().space is None


def test_bars_need_company(spark):
    rows = [(1, 0, 1, 50, 100), (1, 1, 2, 51, 200), (1, 0, 3, 90, 100), (2, 0, 4, 50, 100)]
    bars = spark.createDataFrame(rows, "page_id int, staff int, seq int, x int, top int")
    assert sorted(r.seq for r in marks.confirmed_bars(bars, 10.0).collect()) == [1, 2, 4]


def test_look_ahead_is_four(spark):
    stems = spark.createDataFrame([(1, k, 10.0 * k, 0.0) for k in range(6)], "staff int, seq int, x double, y double")
    pairs = marks.stem_pairs(stems, ["staff"], 1, 1000, 5, 0.85)
    assert {(r.left, r.right) for r in pairs.collect()} == {(a, b) for a in range(6) for b in range(a + 1, min(6, a + 5))}


def test_slope_break(spark):
    rows = [(1, k, k + 1, 1, 100 * k, 0, 100 * (k + 1), d, 0.9, 0.9, 0.9) for k, d in enumerate([0, 0, 30, 31])]
    links = spark.createDataFrame(rows, "staff int, left int, right int, gap int, x0 int, y0 int, x1 int, y1 int, score double, hit_ratio double, density double")
    split = beams.split_paths(beams.label_paths(beams.chosen_links(links, ["staff"], F.lit(100.0)), ["staff"]), ["staff"])
    assert [(r.path, r.place, r.segment) for r in split.orderBy("place").collect()] == [(0, 0, 0), (0, 1, 0), (0, 2, 1), (0, 3, 1)]
    groups = beams.beam_groups(split, ["staff"], F.lit(10.0)).orderBy("segment").collect()
    assert [g.stems for g in groups] == [[0, 1, 2], [2, 3, 4]]
    assert [(g.x0, g.y0, g.x1, g.y1) for g in groups] == [(-4, -4, 204, 4), (196, -4, 404, 35)]


def test_beam_limits_and_disjoint_paths(spark):
    """A skipped stem costs quality, two skipped ones or a steep or long link are out; ends are shared by none."""
    rows = [
        (1, 0, 1, 1, 0, 0, 30, 0, 0.80), (1, 0, 2, 2, 0, 0, 60, 0, 0.81), (1, 2, 3, 3, 60, 0, 90, 0, 0.9), (1, 3, 4, 1, 90, 0, 120, 29, 0.9),
        (1, 4, 5, 1, 120, 0, 620, 0, 0.9), (1, 5, 6, 1, 0, 0, 30, 0, 0.57), (1, 7, 1, 1, 10, 0, 30, 0, 0.7), (2, 1, 2, 1, 0, 0, 10, 0, 0.9),
    ]
    links = spark.createDataFrame(rows, "staff int, left int, right int, gap int, x0 int, y0 int, x1 int, y1 int, score double")
    found = beams.label_paths(beams.chosen_links(links, ["staff"], F.lit(100.0)), ["staff"])
    assert sorted((r.staff, r.left, r.right, r.path, r.place) for r in found.collect()) == [(1, 0, 1, 0, 0), (2, 1, 2, 1, 0)]
    long = [(1, k, k + 1, 1, 10 * k, 0, 10 * k + 10, 0, 0.9) for k in range(40) if k != 17]
    found = beams.label_paths(beams.chosen_links(spark.createDataFrame(long, links.schema), ["staff"], F.lit(100.0)), ["staff"])
    assert {r.left: (r.path, r.place) for r in found.collect()} == {k: (0, k) if k < 17 else (18, k - 18) for k in range(40) if k != 17}


def test_stencil_sizes():
    parts = page.Stencils.of(16.75)
    assert (parts.rx, parts.ry) == (13, 8)
    assert page.near(2.5) == 2 and page.near(3.5) == 4
    assert page.near(2.1 * 16.75) == 35 and page.near(4.8 * 16.75) == 80 and page.near(4.2 * 16.75) == 70


# ---------------------------------------------------------------------- pages
def test_generated_pages_are_read(spark):
    detected = pipeline.detect(images.score_pages(spark, 2)).cache()
    for seed in range(2):
        _, truth = images.score_page(seed)
        notes = pipeline.records(detected.where(F.col("page_id") == f"page-{seed}"), "noteheads").collect()
        hit = sum(any(n.staff == t["staff"] and n.pitch_step == t["pitch_step"] and abs(n.x - t["x"]) <= 4 and n.kind == t["kind"] for n in notes) for t in truth)
        assert hit >= 0.9 * len(truth)  # the rules also find heads on thick beams
    for r in pipeline.summary(detected).collect():
        assert r.status == "ok" and r.staves == 2 and r.staff_line_candidates == 10
        assert r.filled_noteheads + r.open_noteheads == r.noteheads >= r.stems
    document = json.loads(pipeline.documents(detected).first().document)
    assert list(document) == ["input", "threshold", *RECORDS, "counts"]
    shapes = {r.shape for r in pipeline.overlay(detected).select("shape").distinct().collect()}
    assert {"line", "box", "circle", "polyline"} <= shapes
    labels = [r.label for r in pipeline.notehead_regions(detected).where("shape = 'text'").collect()]
    assert all(len(label.split(":")) == 3 for label in labels)
    again = sinks.rasterize(pipeline.reconstruction(detected), detected)
    assert all(bytes(r.png[:4]) == b"\x89PNG" for r in again.collect())


def test_a_page_without_staves_does_not_fail():
    found = page.PageDetector(np.full((60, 80), 255, np.uint8)).run()
    assert found.status == "no staff spacing" and found.records["staff_line_candidates"] == []
    assert page.PageDetector(np.full((60, 80), 255, np.uint8), replace(DEFAULTS, speck_area=1)).run().threshold == 212


def test_images(spark, tmp_path):
    gray = np.random.default_rng(0).integers(0, 256, (20, 30)).astype(np.uint8)
    color = np.random.default_rng(1).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(images.png_bytes(gray))
    (tmp_path / "in" / "b.png").write_bytes(images.png_bytes(color))
    pages = {r.page_id[-5:]: r for r in images.read_pages(spark, "", str(tmp_path / "in")).collect()}
    a, b = pages["a.png"], pages["b.png"]
    assert (images.luma(a.data, a.height, a.width, a.channels) == gray).all()
    red, green, blue = (color[..., k].astype(int) for k in range(3))
    want = (19595 * red + 38470 * green + 7471 * blue + 32768) >> 16
    assert (images.luma(b.data, b.height, b.width, b.channels) == want).all()
    with pytest.raises(ValueError):
        images.read_pages(spark, "score.pdf")
    assert sinks.pdf_bytes([gray, color]).startswith(b"%PDF")


def test_pages_against_what_was_drawn():
    """Staves, notes with their kind, stems, bars and beams of generated pages.
    The rules also take some stems for bars, and beams' ends for notes, so the
    share of true ones is bounded from below."""
    good = found = 0
    for seed in range(8):
        sheet, truth = images.score_page(seed)
        records = page.PageDetector(sheet).run().records
        assert len(records["staves"]) == 2
        near = lambda kind, staff, x, reach: [r for r in records[kind] if r["staff"] == staff and abs(r["x"] - x) <= reach]
        for note in truth:
            assert any(n["kind"] == note["kind"] for n in near("noteheads", note["staff"], note["x"], 4))
            assert near("stems", note["staff"], note["x"] + 8, 4)
        for staff in range(2):
            for bar in (320, 616):
                assert near("barlines", staff, bar, 3)
        good += sum(any(t["staff"] == n["staff"] and abs(t["x"] - n["x"]) <= 4 for t in truth) for n in records["noteheads"])
        found += len(records["noteheads"])
    assert good >= 0.75 * found


def test_unreadable_images_and_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sheet, _ = images.score_page(3)
    (tmp_path / "in" / "p.png").write_bytes(images.png_bytes(sheet))
    (tmp_path / "in" / "q.png").write_bytes(b"no image")
    status = {r.page_id[-5:]: r.readable for r in images.page_status(spark, str(tmp_path / "in")).collect()}
    assert status == {"p.png": True, "q.png": False}
    assert images.read_pages(spark, str(tmp_path / "in")).count() == 1
    pages = images.score_pages(spark, 5).selectExpr("*", "cast(right(page_id, 1) as long) as number").selectExpr("*", "number div 2 as document")
    made = {r.document: r for r in sinks.pdf_documents(pages).collect()}
    assert {k: r.pages for k, r in made.items()} == {0: 2, 1: 2, 2: 1}
    assert all(bytes(r.pdf).count(b"/Type /Page ") == r.pages for r in made.values())


def test_arrivals_are_detected_once(spark, tmp_path):
    from stavegrid.streaming import detect_arrivals

    (tmp_path / "in").mkdir()
    sheet, _ = images.score_page(3)
    (tmp_path / "in" / "p.png").write_bytes(images.png_bytes(sheet))
    for _ in range(2):
        detect_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


@pytest.mark.parametrize(
    "name,keys,meet",
    [
        ("nms1_boxes", 2, lambda a, b: min(a[5], b[5]) + 3 > max(a[3], b[3]) - 3 and min(a[6], b[6]) + 3 > max(a[4], b[4]) - 3),
        ("nms3_ledger_lines", 2, lambda a, b: abs(a[3] + a[5] - b[3] - b[5]) <= 160 and abs(a[4] + a[6] - b[4] - b[6]) <= 80),
        ("nms4_beam_links", 2, lambda a, b: abs(a[3] - b[3]) <= 60.5 and abs(a[5] - b[5]) <= 60.5),
        ("nms5_text_regions", 1, lambda a, b: min(a[5], b[5] + 3) > max(a[3], b[3] - 3) and min(a[6], b[6] + 3) > max(a[4], b[4] - 3)),
    ],
)
def test_suppression_holds_every_page(spark, monkeypatch, name, keys, meet):
    """Brute force on pages of which a tenth has a number that ten divides."""
    r = np.random.default_rng(8)
    rows = []
    for seq in range(600):
        x, y = map(int, r.integers(0, 400, 2))
        w, h = map(int, r.integers(1, 30, 2))
        rows.append((int(r.integers(1, 21)), int(r.integers(1, 3)), seq, x, y, x + w, y + h, float(r.integers(0, 50))))
    frame = spark.createDataFrame(rows, "page_id long, staff int, seq long, x0 int, y0 int, x1 int, y1 int, score double")
    monkeypatch.setattr(registry, "_boxes", lambda spark, sf: frame)
    kept = {}
    for b in sorted(rows, key=lambda b: (-b[7], b[2])):
        group = kept.setdefault(b[:keys], [])
        if not any(meet(b, k) for k in group):
            group.append(b)
    want = sorted((*key, b[2]) for key, group in kept.items() for b in group)
    assert len(want) < len(rows) and {w[0] for w in want} == set(range(1, 21))
    assert sorted(map(tuple, registry.queries()[name](spark, "").collect())) == want


def test_whole_pages_of_a_table(spark, tmp_path):
    """A page for each hundred vectors; the document holds what the counts say."""
    r = np.random.default_rng(4)
    rows = [(k, [float(v) for v in np.clip(r.normal(0, 0.12, 64), -1, 1)], 0) for k in range(130)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    queries = page_queries.queries()
    assert queries["snk1_binary_png"](spark, str(tmp_path)).count() == 2
    counts = {r.page_id: r for r in queries["drv2_counts"](spark, str(tmp_path)).collect()}
    documents = {r.page_id: json.loads(r.document) for r in queries["snk2_documents"](spark, str(tmp_path)).collect()}
    assert counts.keys() == documents.keys() == {"0", "1"}
    for page, document in documents.items():
        assert all(len(document[name]) == counts[page][name] == document["counts"][name] for name in RECORDS)
        assert len(document["staves"]) == 2
    assert sum(c.noteheads for c in counts.values()) > 0


def test_sweep_keeps_what_the_fold_keeps(spark):
    """Meeting, nested, inverted and unknown boxes, chains and copies, on pages of many sizes."""
    r = np.random.default_rng(12)
    rows = [(int(k % 7) ** 2, k, int(x), int(y), int(x + w), int(y + h), float(r.integers(0, 9))) for k, (x, y, w, h) in enumerate(zip(r.integers(-200, 500, 500), r.integers(0, 300, 500), r.integers(-4, 40, 500), r.integers(1, 30, 500)))]
    rows += [(50, 600 + k, 10 * k, 0, 10 * k + 12, 5, float(-k)) for k in range(40)] + [(51, 700 + k, 3, 3, 9, 9, 1.0) for k in range(20)]
    rows += [(0, 800, None, 0, None, 5, 1.0), (50, 801, 7, None, 9, None, 1.0), (52, 802, None, None, None, None, 1.0)]
    frame = spark.createDataFrame(rows, "page int, seq int, x0 int, y0 int, x1 int, y1 int, score double")
    fields = ["x0", "y0", "x1", "y1"]
    fold, sweep = (sorted(map(tuple, found.collect()), key=str) for found in (boxes.suppress(frame, ["page"], fields, boxes.one_sided_conflict(3)), boxes.suppress_boxes(frame, ["page"], fields, 3)))
    assert sweep == fold and len(fold) < len(rows)
    assert boxes.suppress_boxes(frame.where("page = 99"), ["page"], fields, 3).count() == 0


def test_text_regions_hold_no_box_against_all_others(spark, monkeypatch):
    """On a page of boxes far apart the fold, which holds each against all kept ones, has no part."""
    monkeypatch.setattr(registry, "_boxes", lambda spark, sf: spark.range(3000).selectExpr("1L as page_id", "1 as staff", "id as seq", "cast(id * 20 as int) as x0", "0 as y0", "cast(id * 20 + 9 as int) as x1", "9 as y1", "1D as score"))
    monkeypatch.setattr(boxes, "one_sided_conflict", None)
    assert registry.queries()["nms5_text_regions"](spark, "").count() == 3000


def test_batches_are_parted_by_what_their_lists_hold():
    """Stretches hold few items, or one long list; their rows are all of the batch's, also of a slice."""
    lists = [[0] * n for n in (3, 0, 4, 9, 1, 0, 0, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists)], ["k", "b"]).slice(1)
    parts = list(boxes.pieces(batch, batch.column("b"), 5))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(1, 8))
    assert all(p.num_rows == 1 or sum(map(len, p.column("b").to_pylist())) <= 5 for p in parts) and len(parts) == 3


def test_written_tables_are_joined_by_shuffles(spark):
    """What a step writes is planned without broadcasts of written tables, small as their files are; the settings come back, also after a fault."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before, pixels = spark.conf.get(name), durable.cut(spark.range(20000).selectExpr("id div 6400 as page_id", "cast(id % 100 as int) as x"))
    plans = []

    class Noted:
        sparkSession, schema, write = spark, pixels.schema, property(lambda self: self)

        def parquet(self, path):
            joined = pixels.join(pixels.withColumnRenamed("x", "z"), "page_id").select("page_id", "x").limit(3)
            plans.append(joined._jdf.queryExecution().executedPlan().toString())
            joined.write.parquet(path)
            if len(plans) > 1:
                raise OSError("no room")

    assert durable.cut(Noted()).count() == 3
    with pytest.raises(OSError):
        durable.cut(Noted())
    assert all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
    assert spark.conf.get(name) == before and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None


def test_stencil_counts_stay_arrow(spark):
    """Counts of heads of several sizes equal those of the pixels one by one; rows reach the task as Arrow's
    tables, a few at once, and not as lists of objects."""
    r = np.random.default_rng(2)
    mask, cleaned = r.random((2, 60, 50)) < 0.4, r.random((2, 60, 50)) < 0.3
    staff_rows = spark.createDataFrame([(p, k, 14.0 + 10 * k, space, 2, 48, 4) for p in range(2) for k, space in enumerate((6.0, 9.0))], "page_id long, staff int, top double, space double, x0 int, x1 int, scan_x0 int")
    pages = spark.createDataFrame([(p, 60, 50) for p in range(2)], "page_id long, height int, width int")
    table = lambda m: notes.integral_rows(spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(m)], "page_id long, y int, x int"), pages)
    rows, spans = notes.note_rows(staff_rows, pages), notes.stencil_spans(notes.radii(staff_rows)).cache()
    tables = table(cleaned), table(mask)
    counts = notes.stencil_counts(rows, notes.candidate_columns(rows, tables[0]), *tables, spans)
    plan = counts._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    at = {(w.page_id, w.staff, w.pitch_step): w for w in rows.collect()}
    parts = {}
    for s in spans.collect():
        parts.setdefault((s.rx, s.ry, s.part), []).append((s.dy, s.x0, s.x1))
    found = counts.collect()
    assert len(found) > 2 * notes.ROWS_AT_ONCE and len({(at[c[:3]].rx, at[c[:3]].ry) for c in found}) == 2
    for c in found:
        w = at[c[:3]]
        under = lambda m, name: int(sum(m[c.page_id, w.y + dy, c.x + a : c.x + b + 1].sum() for dy, a, b in parts[w.rx, w.ry, name]))
        outer = np.zeros((2 * w.ry + 1, 2 * w.rx + 1), bool)
        for dy, a, b in parts[w.rx, w.ry, "outer"]:
            outer[dy + w.ry, a + w.rx : b + w.rx + 1] = True
        window = cleaned[c.page_id, w.y - w.ry : w.y + w.ry + 1, c.x - w.rx : c.x + w.rx + 1] & outer
        lines = [int((window.sum(axis) >= max(2, int(0.18 * (2 * k + 1)))).sum()) for axis, k in ((1, w.rx), (0, w.ry))]
        assert c.n == [*(under(cleaned, p) for p in notes.PARTS), *lines] and c.raw == [under(mask, p) for p in ("outer", "inner", "core")]


@pytest.mark.parametrize("name", ["txt4_phrases", "txt5_phrase_scores"])
def test_phrases_are_sorted_in_parts_that_follow_the_splits(spark, monkeypatch, name):
    """Eight partitions for each split, and no further shuffle into the session's few."""
    monkeypatch.setattr(registry, "_boxes", lambda spark, sf: spark.range(0, 60, 1, 3).selectExpr("id % 4 as page_id", "cast(id % 2 as int) as staff", "id as seq", "cast(id * 5 as int) as x0", "0 as y0", "cast(id * 5 + 4 as int) as x1", "9 as y1"))
    found = registry.queries()[name](spark, "")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and ", 24), REPARTITION_BY_NUM" in plan
    assert found.count() == 4


def test_regions_are_sorted_in_parts_that_follow_the_splits(spark, monkeypatch):
    """Pages are dealt twice, before rows and after them, eight partitions for each split."""
    for module in (registry, mark_queries):
        monkeypatch.setattr(module, "_boxes", lambda spark, sf: spark.range(0, 60, 1, 3).selectExpr("id % 4 as page_id", "cast(id % 2 as int) as staff", "id as seq", "cast(id * 5 as int) as x0", "0 as y0", "cast(id * 5 + 19 as int) as x1", "19 as y1", "200 as area"))
    found = registry.queries()["txt7_table_regions"](spark, "")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == plan.count(", 24), REPARTITION_BY_NUM") == 2
    assert found.count() == 4
