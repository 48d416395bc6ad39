"""Dense work on one page's raster, in NumPy.

A page is a few megabytes and independent of all others, so its pixels stay in
one task; what leaves it are records.  The relational operators of this package
say the same over tables of runs, points and boxes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from stavegrid.operators.boxes import cluster_boxes
from stavegrid.params import DEFAULTS, Params


def near(v: float) -> int:
    return int(np.rint(v))


# ------------------------------------------------------------- runs and islands
def island_bounds(positions: np.ndarray, max_gap: int = 1) -> np.ndarray:
    """(k, 2): first and last position of each island of ascending positions."""
    if not len(positions):
        return np.zeros((0, 2), int)
    cut = np.flatnonzero(np.diff(positions) > max_gap)
    return np.stack([positions[np.r_[0, cut + 1]], positions[np.r_[cut, len(positions) - 1]]], 1)


def longest_island(flags: np.ndarray, max_gap: int = 1) -> tuple[int, int]:
    """The first of the longest islands, ends included; (0, -1) if none."""
    bounds = island_bounds(np.flatnonzero(flags), max_gap)
    return tuple(map(int, bounds[np.argmax(bounds[:, 1] - bounds[:, 0])])) if len(bounds) else (0, -1)


def row_runs(mask: np.ndarray) -> np.ndarray:
    """(k, 3): y, first x, end x (excluded) of all runs in raster order."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, start = np.nonzero(edge == 1)
    return np.stack([y, start, np.nonzero(edge == -1)[1]], 1)


def label(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs, and for each run the first run of its 8-connected component."""
    runs = row_runs(mask)
    root = np.arange(len(runs))
    first = np.searchsorted(runs[:, 0], np.arange(mask.shape[0] + 1))
    pairs = []
    for y in range(mask.shape[0] - 1):
        a, b = runs[first[y] : first[y + 1]], runs[first[y + 1] : first[y + 2]]
        if len(a) and len(b):
            low, high = np.searchsorted(b[:, 2], a[:, 1], "left"), np.searchsorted(b[:, 1], a[:, 2], "right")
            for k in np.flatnonzero(high > low):
                pairs += [(first[y] + k, first[y + 1] + j) for j in range(low[k], high[k])]

    def find(n: int) -> int:
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    for u, v in pairs:
        u, v = sorted((find(u), find(v)))
        root[v] = u
    return runs, np.fromiter((find(n) for n in range(len(runs))), int, len(runs))


def components(mask: np.ndarray, x0: int = 0, y0: int = 0, x1: int | None = None, y1: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(x0, y0, x1, y1, area), half-open, of components within a clamped region,
    in raster order of their first pixels."""
    x0, y0 = max(0, x0), max(0, y0)
    x1 = mask.shape[1] if x1 is None else min(mask.shape[1], x1)
    y1 = mask.shape[0] if y1 is None else min(mask.shape[0], y1)
    if x1 <= x0 or y1 <= y0:
        return []
    runs, root = label(mask[y0:y1, x0:x1])
    if not len(runs):
        return []
    order = np.argsort(root, kind="stable")
    r, edge = runs[order], np.flatnonzero(np.r_[True, np.diff(root[order]) > 0])
    low, high = np.minimum.reduceat(r, edge), np.maximum.reduceat(r, edge)
    area = np.add.reduceat(r[:, 2] - r[:, 1], edge)
    return [(int(x0 + a[1]), int(y0 + a[0]), int(x0 + b[2]), int(y0 + b[0] + 1), int(n)) for a, b, n in zip(low, high, area)]


def without_specks(mask: np.ndarray, least: int) -> np.ndarray:
    runs, root = label(mask)
    out = mask.copy()
    area = np.bincount(root, runs[:, 2] - runs[:, 1], minlength=len(runs)) if len(runs) else []
    for (y, a, b), r in zip(runs, root):
        if area[r] < least:
            out[y, a:b] = False
    return out


def otsu(gray: np.ndarray, default: int) -> int:
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    wb, sb = np.cumsum(n), np.cumsum(n * np.arange(256))
    wf = wb[-1] - wb
    ok = (wb > 0) & (wf > 0)
    if not ok.any():
        # a page of one level parts nowhere
        return default
    between = np.full(256, -1.0)
    between[ok] = wb[ok] * wf[ok] * (sb[ok] / wb[ok] - (sb[-1] - sb[ok]) / wf[ok]) ** 2
    return int(np.argmax(between))


# --------------------------------------------------------------------- records
def kept(items: list[dict], clash, order) -> list[dict]:
    """Greedy suppression by falling score; equals keep their order."""
    out: list[dict] = []
    for item in sorted(items, key=lambda i: -i["score"]):
        if not any(clash(item, other) for other in out):
            out.append(item)
    return sorted(out, key=order)


def boxes_clash(margin: int):
    def test(a, b):
        p, q = a["bbox"], b["bbox"]
        return a["staff"] == b["staff"] and all(min(p[k + 2], q[k + 2]) + margin > max(p[k], q[k]) - margin for k in (0, 1))

    return test


def meets(a, b, margin: float = 0) -> bool:
    return all(min(a[k + 2], b[k + 2] + margin) > max(a[k], b[k] - margin) for k in (0, 1))


def by_box(item: dict):
    return item["staff"], item["bbox"][0], item["bbox"][1]


@dataclass
class Stencils:
    """Elliptical parts of a notehead, as rows of weights over one window."""

    rx: int
    ry: int
    parts: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, space: float) -> Stencils:
        rx, ry = max(5, near(space * 0.78)), max(4, near(space * 0.50))
        y, x = np.mgrid[-ry : ry + 1, -rx : rx + 1]

        def disc(a: float, b: float) -> np.ndarray:
            return (x / max(1, rx * a)) ** 2 + (y / max(1, ry * b)) ** 2 <= 1.0

        outer, inner = (x / rx) ** 2 + (y / ry) ** 2 <= 1.0, disc(0.50, 0.48)
        ring = outer & ~inner
        parts = {"outer": outer, "inner": inner, "ring": ring, "around": disc(1.35, 1.35) & ~outer, "core": disc(0.34, 0.30)}
        parts |= {"left": ring & (x <= -0.18 * rx), "right": ring & (x >= 0.18 * rx), "top": ring & (y <= -0.15 * ry), "bottom": ring & (y >= 0.15 * ry)}
        return cls(rx, ry, parts)

    def windows(self, mask: np.ndarray, xs: np.ndarray, y: int) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(mask[y - self.ry : y + self.ry + 1], 2 * self.rx + 1, axis=1)
        return view[:, xs - self.rx].transpose(1, 0, 2).astype(float)

    def density(self, windows: np.ndarray, part: str) -> np.ndarray:
        p = self.parts[part]
        return (windows * p).sum((1, 2)) / p.sum() if p.any() else np.zeros(len(windows))


class PageDetector:
    """All detections of one gray raster; ``records`` has a list for each type."""

    def __init__(self, gray: np.ndarray, params: Params = DEFAULTS):
        self.p, self.gray = params, gray
        self.height, self.width = gray.shape
        self.records: dict[str, list[dict]] = {}
        self.status, self.space = "ok", None

    def run(self) -> PageDetector:
        p = self.p
        self.threshold = min(p.ink_high, max(p.ink_low, otsu(self.gray, p.otsu_default) + p.ink_offset))
        self.ink = without_specks(self.gray < self.threshold, p.speck_area)
        lines = self.records["staff_line_candidates"] = self.find_lines()
        self.space = self.find_space([line["y"] for line in lines])
        if self.space is None:  # one page must not fail the job
            self.status, self.staves = "no staff spacing", []
            return self
        self.staves = self.records["staves"] = self.find_staves(lines)
        self.cleaned = self.erase_lines()
        self.find_clefs()
        rec = self.records
        first_text = self.find_text([])
        rec["accidentals"] = self.find_accidentals(first_text)
        rec["text_regions"] = self.find_text(rec["accidentals"])
        notes_on = self.cleaned & ~self.long_runs() & ~self.regions(rec["accidentals"]) & ~self.regions(rec["text_regions"])
        rec["noteheads"] = self.find_notes(notes_on)
        rec["stems"] = self.find_stems()
        rec["ledger_lines"] = self.find_ledgers()
        rec["barlines"] = self.find_bars()
        rec["beam_links"] = self.find_links()
        rec["beam_groups"] = self.find_groups()
        rec["rests"], rec["beams"], rec["slurs_or_ties"] = self.find_symbols()
        return self

    # ------------------------------------------------------------------ staves
    def find_lines(self) -> list[dict]:
        ink, p = self.ink, self.p
        rows = ink.sum(1)
        limit = max(self.width * p.line_width_share, np.percentile(rows, 100 * p.line_percentile) * p.line_peak_share)
        out = []
        for top, bottom in island_bounds(np.flatnonzero(rows > limit)):
            x0, x1 = longest_island(ink[top : bottom + 1].any(0))
            if x1 > x0 and x1 - x0 + 1 >= self.width * p.line_run_share:
                w = rows[top : bottom + 1]
                out.append({"y": float(w @ np.arange(top, bottom + 1) / max(1, w.sum())), "thickness": int(bottom - top + 1), "x0": x0, "x1": x1, "strength": int(w.max())})
        return sorted(out, key=lambda line: line["y"])

    def find_space(self, ys: list[float]) -> float | None:
        gaps = np.diff(ys)
        gaps = gaps[(gaps >= self.p.space_low_px) & (gaps <= self.p.space_high_px)]
        if not len(gaps):
            return None
        value, count = np.unique(np.rint(gaps), return_counts=True)
        return float(np.median(gaps[np.abs(gaps - value[np.argmax(count)]) <= self.p.space_near_px]))

    def find_staves(self, lines: list[dict]) -> list[dict]:
        s, out, at = self.space, [], 0
        tolerance = max(self.p.staff_tolerance_px, s * self.p.staff_tolerance)
        fits = np.abs(np.diff([line["y"] for line in lines]) - s) <= tolerance
        while at + 5 <= len(lines):
            if not fits[at : at + 4].all():
                at += 1
                continue
            five = lines[at : at + 5]
            x0, x1 = (int(np.median([line[k] for line in five])) for k in ("x0", "x1"))
            ys = [line["y"] for line in five]
            out.append({"index": len(out), "lines": ys, "x0": x0, "x1": x1, "y0": ys[0], "y1": ys[-1], "space": s, "clef_bbox": None, "clef_type": None, "scan_x0": x0 + near(self.p.scan_offset * s)})
            at += 5
        return out

    def erase_lines(self) -> np.ndarray:
        out, s = self.ink.copy(), self.space
        band = max(1, near(s * self.p.line_erase))
        for st in self.staves:
            for y in map(near, st["lines"]):
                out[max(0, y - band) : y + band + 1, max(0, st["x0"] - near(s)) : max(0, st["x1"] + near(s))] = False
        return out

    def find_clefs(self) -> None:
        s = self.space
        for st in self.staves:
            found = components(self.cleaned, near(st["x0"] - 0.25 * s), near(st["y0"] - 3.2 * s), near(st["x0"] + 4.2 * s), near(st["y1"] + 3.2 * s))
            found = [b for b in found if b[2] >= st["x0"] - 0.05 * s]
            big = [b for b in found if b[3] - b[1] >= 2.0 * s and b[2] - b[0] >= 0.55 * s and b[4] >= 0.55 * s * s]
            some = [b for b in found if b[4] >= 0.12 * s * s and b[2] - b[0] >= 0.18 * s and b[3] - b[1] >= 0.45 * s]
            box = max(big, key=lambda b: b[4])[:4] if big else None
            if not big and some:
                x0, y0, x1, y1, _ = zip(*some)
                hull = (min(x0), min(y0), max(x1), max(y1))
                box = hull if hull[2] - hull[0] >= 0.75 * s and hull[3] - hull[1] >= 1.6 * s else None
            if box:
                st["clef_bbox"], st["scan_x0"] = list(box), max(st["scan_x0"], int(box[2] + 1.1 * s))
            st["clef_type"] = "bass" if st["index"] % 2 else "treble"

    def pitch_distance(self, st: dict, y: float) -> float:
        steps = np.arange(self.p.pitch_first, self.p.pitch_last + 1)
        return float(np.abs(y - (st["lines"][0] + steps * self.space / 2)).min())

    # ------------------------------------------------------------------- masks
    def long_runs(self) -> np.ndarray:
        out, s = np.zeros_like(self.cleaned), self.space
        least = max(self.p.long_run_px, near(self.p.long_run * s))
        for st in self.staves:
            y0, x0 = max(0, near(st["y0"] - 5 * s)), max(0, near(st["scan_x0"] - 2 * s))
            for y, a, b in row_runs(self.cleaned[y0 : max(0, near(st["y1"] + 5 * s)), x0 : max(0, near(st["x1"] + s))]):
                if b - a >= least:
                    out[max(0, y0 + y - 1) : y0 + y + 2, x0 + a : x0 + b] = True
        return out

    def regions(self, items: list[dict], pad: int = 2) -> np.ndarray:
        out = np.zeros_like(self.cleaned)
        for item in items:
            x0, y0, x1, y1 = item["bbox"]
            out[max(0, y0 - pad) : y1 + pad, max(0, x0 - pad) : x1 + pad] = True
        return out

    # -------------------------------------------------------- text, accidentals
    def is_text(self, b) -> bool:
        w, h, s = b[2] - b[0], b[3] - b[1], self.space
        if not (0.10 * s <= w <= 1.85 * s and 0.25 * s <= h <= 1.75 * s):
            return False
        return 0.08 <= b[4] / (w * h) <= 0.82 and not (w <= 0.22 * s and h >= 1.45 * s)

    def find_text(self, accidentals: list[dict]) -> list[dict]:
        s, found = self.space, []
        source = self.cleaned & ~self.regions(accidentals)
        for st in self.staves:
            parts = components(source, near(st["scan_x0"] - 0.5 * s), near(st["y0"] - 4.3 * s), near(st["x1"] + 0.5 * s), near(st["y1"] + 4.3 * s))
            rows: list[list] = []
            for b in sorted(filter(self.is_text, parts), key=lambda b: (b[1] + b[3], b[0])):
                level = 0.5 * (b[1] + b[3])
                home = next((r for r in rows if abs(level - np.median([0.5 * (m[1] + m[3]) for m in r])) <= 0.58 * s), None)
                rows.append([b]) if home is None else home.append(b)
            for row in rows:
                row.sort(key=lambda b: b[0])
                joins = [b[0] - a[2] <= 1.35 * s and min(b[3], a[3]) - max(b[1], a[1]) >= -0.25 * s for a, b in zip(row, row[1:])]
                cuts = [0, *(k + 1 for k, j in enumerate(joins) if not j), len(row)]
                found += filter(None, (self.text_region(st, row[a:b]) for a, b in zip(cuts, cuts[1:])))
        clash = lambda a, b: meets(a["bbox"], b["bbox"], 3)  # noqa: E731  of all staves
        return kept(found, clash, lambda r: (r["staff"], r["bbox"][1], r["bbox"][0]))

    def text_region(self, st: dict, phrase: list) -> dict | None:
        """No label is recognised: that needs rendered templates of fonts."""
        s = self.space
        if len(phrase) < 3:
            return None
        x0, y0, x1, y1, _ = zip(*phrase)
        box = [min(x0), min(y0), max(x1), max(y1)]
        w, level = box[2] - box[0], 0.5 * (box[1] + box[3])
        if w < 1.8 * s or box[3] - box[1] > 2.15 * s:
            return None
        if st["y0"] - 0.35 * s <= level <= st["y1"] + 0.35 * s and self.pitch_distance(st, level) <= 0.22 * s:
            return None
        score = 0.34 + 0.08 * min(5, len(phrase)) + 0.20 * min(1.0, w / max(1.0, 5 * s))
        return {"staff": st["index"], "bbox": box, "text": "text", "score": float(min(1.0, score)), "component_count": len(phrase)}

    def in_text_cluster(self, box, others: list) -> bool:
        s = self.space
        if not self.is_text(box):
            return False
        beside = [o for o in others if o is not box and self.is_text(o) and abs(o[1] + o[3] - box[1] - box[3]) <= 2 * 0.68 * s and max(0, o[0] - box[2], box[0] - o[2]) <= 1.75 * s]
        return len(beside) >= 2

    def find_accidentals(self, text: list[dict]) -> list[dict]:
        s, found = self.space, []
        margin = near(0.15 * s)
        in_text = lambda b: any(meets(b, t["bbox"], margin) for t in text)
        for st in self.staves:
            every = components(self.cleaned, near(st["scan_x0"] - 0.7 * s), near(st["y0"] - 3.2 * s), near(st["x1"] + 0.25 * s), near(st["y1"] + 3.2 * s))
            parts = [
                b
                for b in every
                if b[4] >= max(5, int(0.025 * s * s)) and b[2] - b[0] <= 2.4 * s and b[3] - b[1] <= 3.9 * s and not (st["clef_bbox"] and meets(b, st["clef_bbox"], near(0.2 * s))) and not in_text(b)
            ]
            for group in cluster_boxes(parts, 0.28 * s, 0.38 * s):
                x0, y0, x1, y1, area = zip(*group)
                box = [min(x0), min(y0), max(x1), max(y1)]
                kind, score, density = self.accidental(box, sum(area))
                cx, cy = 0.5 * (box[0] + box[2]), 0.5 * (box[1] + box[3])
                placed = st["scan_x0"] - 0.8 * s <= cx <= st["x1"] + 0.3 * s and self.pitch_distance(st, cy) <= 1.35 * s
                if kind and placed and not in_text(box) and not any(self.in_text_cluster(b, every) for b in group):
                    found.append({"staff": st["index"], "bbox": box, "kind": kind, "score": score, "density": density})
        return kept(found, boxes_clash(4), by_box)

    def accidental(self, box, area: int) -> tuple[str | None, float, float]:
        s, crop = self.space, self.cleaned[box[1] : box[3], box[0] : box[2]]
        h, w = crop.shape
        density = area / (w * h)
        if not (0.35 * s <= w <= 2.15 * s and 1.65 * s <= h <= 3.65 * s and 0.08 <= density <= 0.82):
            return None, 0.0, density
        across, down = crop.sum(1), crop.sum(0)
        rows = len(island_bounds(np.flatnonzero(across >= max(2, near(0.34 * w)))))
        columns = len(island_bounds(np.flatnonzero(down >= max(2, near(0.26 * h)))))
        tall = int((down >= max(2, near(0.48 * h))).sum())
        if 0.50 * s <= w <= 1.55 * s and rows >= 3 and tall >= 4 and (columns >= 1 or density >= 0.32):
            return "sharp", min(1.0, 0.45 + 0.10 * rows + 0.10 * columns + 0.25 * density), density
        if rows >= 2 and columns >= 2 and tall >= 3 and density >= 0.18:
            return "natural", min(1.0, 0.34 + 0.09 * rows + 0.12 * columns + 0.22 * density), density
        return None, 0.0, density

    # --------------------------------------------------------------- noteheads
    def note_columns(self, mask: np.ndarray, st: dict, cy: float) -> np.ndarray:
        s = self.space
        first, last = max(0, st["scan_x0"]), min(self.width, near(st["x1"] - s))
        xs = set(range(first, last, max(2, near(s / 4))))
        y0, y1 = max(0, near(cy - 0.72 * s)), min(self.height, near(cy + 0.72 * s) + 1)
        if y1 > y0 and last > first:
            ink = mask[y0:y1, first:last].sum(0)
            for a, b in island_bounds(np.flatnonzero(ink >= max(2, near(0.10 * (y1 - y0)))), 2):
                if max(4, near(0.26 * s)) <= b - a + 1 <= near(3.2 * s):
                    w = ink[a : b + 1]
                    center = near(float(w @ np.arange(first + a, first + b + 1) / w.sum()))
                    xs |= {x for x in (center, near(center - 0.18 * s), near(center + 0.18 * s)) if first <= x < last}
        return np.array(sorted(xs), int)

    def find_notes(self, mask: np.ndarray) -> list[dict]:
        s, parts, every = self.space, Stencils.of(self.space), []
        least = max(5, near(0.72 * s))
        clash = lambda dx: lambda a, b: a["staff"] == b["staff"] and abs(a["x"] - b["x"]) <= dx and abs(a["y"] - b["y"]) <= max(4.0, 1.10 * dx)
        order = lambda n: (n["staff"], n["x"], n["y"])
        for st in self.staves:
            for step in range(self.p.pitch_first, self.p.pitch_last + 1):
                cy = st["lines"][0] + step * s / 2
                y = near(cy)
                if y - parts.ry < 0 or y + parts.ry >= self.height:
                    continue
                xs = self.note_columns(mask, st, cy)
                xs = xs[(xs >= parts.rx) & (xs + parts.rx < self.width)]
                if len(xs):
                    every += kept(self.score_notes(mask, st, step, cy, xs, parts), clash(least), order)
        return kept(every, clash(8), order)

    def score_notes(self, mask: np.ndarray, st: dict, step: int, cy: float, xs: np.ndarray, parts: Stencils) -> list[dict]:
        """All candidates of one pitch row at once: densities of the stencils'
        parts, then the first of three rules that holds, then the refined kind."""
        y = near(cy)
        view = parts.windows(mask, xs, y)
        d = {k: parts.density(view, k) for k in parts.parts}
        black = view * parts.parts["outer"]
        rows = (black.sum(2) >= max(2, int(0.18 * view.shape[2]))).mean(1)
        columns = (black.sum(1) >= max(2, int(0.18 * view.shape[1]))).mean(1)
        wide, narrow = np.maximum(d["left"], d["right"]), np.minimum(d["left"], d["right"])
        balance = narrow / np.maximum(wide, 1e-6)
        filled = d["outer"] - 0.38 * d["around"]
        hollow = 0.72 * d["ring"] + 0.30 * np.maximum(0, 0.35 - d["inner"]) - 0.22 * d["around"]
        covered = (rows >= 0.30) & (columns >= 0.30)
        strict = covered & (filled >= 0.36) & (d["inner"] >= 0.30) & (narrow >= 0.20) & (balance >= 0.25)
        ringed = covered & (hollow >= 0.31) & (d["ring"] >= 0.31) & (d["inner"] <= 0.28) & (narrow >= 0.23) & (np.maximum(d["top"], d["bottom"]) >= 0.18) & (balance >= 0.30)
        relaxed = covered & (filled >= 0.34) & (d["outer"] >= 0.34) & (d["inner"] >= 0.30) & (wide >= 0.20) & (d["around"] <= 0.42) & (balance >= 0.24)
        score = np.where(strict, filled, np.where(ringed, hollow, filled))
        raw_view = parts.windows(self.ink, xs, y)
        raw = {k: parts.density(raw_view, k) for k in ("outer", "inner", "core")}
        solid = (raw["core"] >= 0.68) & (raw["inner"] >= 0.58) & (raw["outer"] >= 0.62)
        erased = solid & ((raw["core"] - d["core"] >= 0.42) | (raw["inner"] - d["inner"] >= 0.42))
        open_trust = 0.70 * d["ring"] + 0.45 * np.maximum(0, 0.28 - d["core"]) + 0.30 * np.maximum(0, d["ring"] - d["core"])
        filled_trust = 0.70 * d["core"] + 0.35 * d["inner"] + 0.20 * d["outer"]
        is_open = ~erased & (open_trust >= 0.43) & (d["core"] <= 0.24) & (d["ring"] >= 0.31) & (open_trust >= 0.92 * filled_trust)
        outer, inner = np.where(erased, raw["outer"], d["outer"]), np.where(erased, raw["inner"], d["inner"])
        return [
            {"staff": st["index"], "x": int(xs[k]), "y": float(cy), "pitch_step": step, "kind": "open" if is_open[k] else "filled", "score": float(score[k]), "black_density": float(outer[k]), "center_density": float(inner[k])}
            for k in np.flatnonzero(strict | ringed | relaxed)
        ]

    # ------------------------------------------------ stems, ledgers, barlines
    def find_stems(self) -> list[dict]:
        s, p, out = self.space, self.p, []
        least, most, behind = near(p.stem_least * s), near(p.stem_most * s), near(0.65 * s)
        for k, n in enumerate(self.records["noteheads"]):
            y, found = near(n["y"]), []
            for direction, side, top, bottom in (("up", 1, y - most, y + behind), ("down", -1, y - behind, y + most)):
                a, b = sorted((near(n["x"] + side * 0.25 * s), near(n["x"] + side * 1.10 * s)))
                top, bottom = max(0, top), min(self.height, bottom)
                for x in range(max(0, a), min(self.width - 1, b) + 1):
                    first, last = longest_island(self.cleaned[top:bottom, x], p.stem_gap_px + 1)
                    found.append((last - first + 1, direction, x, top + first, top + last))
            best = max(found, key=lambda f: f[0], default=(0,))
            if best[0] >= least and best[0] > 0:
                length, direction, x, y0, y1 = best
                out.append({"staff": n["staff"], "note_index": k, "x": x, "y0": y0, "y1": y1, "direction": direction, "length": length, "score": length / max(1.0, most)})
        return out

    def find_ledgers(self) -> list[dict]:
        s, out = self.space, []
        band = max(1, near(0.14 * s))
        for k, n in enumerate(self.records["noteheads"]):
            st = self.staves[n["staff"]]
            if n["y"] < st["y0"] - 0.45 * s:
                side, base, way = "above", st["y0"], -1
            elif n["y"] > st["y1"] + 0.45 * s:
                side, base, way = "below", st["y1"], 1
            else:
                continue
            far = abs(n["y"] - base)
            for number in range(1, int(np.ceil(far / s)) + 2):
                line = base + way * number * s
                y = near(line)
                if abs(line - n["y"]) > max(1.25 * s, far + s) or not 0 <= y < self.height:
                    continue
                x0, y0, y1 = max(0, near(n["x"] - 1.45 * s)), max(0, y - band), min(self.height, y + band + 1)
                runs = x0 + island_bounds(np.flatnonzero(self.ink[y0:y1, x0 : max(0, near(n["x"] + 1.45 * s))].any(0)))
                runs = runs[(runs[:, 0] <= n["x"] + 0.35 * s) & (runs[:, 1] >= n["x"] - 0.35 * s)]
                if not len(runs):
                    continue
                a, b = runs[np.argmax(runs[:, 1] - runs[:, 0])]
                length = int(b - a + 1)
                if 0.75 * s <= length <= 3.0 * s:
                    out.append({"staff": n["staff"], "note_index": k, "bbox": [int(a), y0, int(b), y1], "side": side, "line_number": number, "score": min(1.0, length / max(1.0, 1.8 * s))})

        def clash(a, b):
            (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a["bbox"], b["bbox"]
            return a["staff"] == b["staff"] and a["side"] == b["side"] and abs(ax0 + ax1 - bx0 - bx1) <= 16 and abs(ay0 + ay1 - by0 - by1) <= 8

        return kept(out, clash, lambda i: (i["staff"], i["note_index"], i["line_number"]))

    def find_bars(self) -> list[dict]:
        s, p, out = self.space, self.p, []
        least = near(p.bar_least * s)
        for st in self.staves:
            y0, y1 = max(0, near(st["y0"] - 0.35 * s)), min(self.height, near(st["y1"] + 0.35 * s))
            spans = {}
            for x in range(max(0, near(st["scan_x0"] - 0.8 * s)), min(self.width, near(st["x1"] + 0.4 * s))):
                a, b = longest_island(self.ink[y0:y1, x], p.bar_gap_px + 1)
                if b - a + 1 >= least:
                    spans[x] = (y0 + a, y0 + b)
            for a, b in island_bounds(np.array(sorted(spans), int), 2):
                own = [x for x in spans if a <= x <= b]
                x, top, bottom = near(np.median(own)), min(spans[o][0] for o in own), max(spans[o][1] for o in own)
                kind = "system_start" if abs(x - st["x0"]) <= 1.2 * s else "barline"
                out.append({"staff": st["index"], "x": x, "y0": top, "y1": bottom, "kind": kind, "score": (bottom - top + 1) / max(1.0, y1 - y0)})
        if len(self.staves) < 2:
            return out
        top = [st["y0"] for st in self.staves]
        again = [b for b in out if b["kind"] == "system_start" or any(o["staff"] != b["staff"] and abs(o["x"] - b["x"]) <= max(p.bar_match_px, p.bar_match * s) and abs(top[o["staff"]] - top[b["staff"]]) <= p.bar_reach * s for o in out)]
        return again or out

    # ------------------------------------------------------------------- beams
    def corridor(self, x0: int, y0: int, x1: int, y1: int) -> tuple[float, float]:
        """Share of columns with ink along a line, and share of ink around it."""
        half, dx = max(2, near(0.22 * self.space)), x1 - x0
        margin = max(2, near(dx * 0.08))
        xs = np.arange(max(0, x0 + margin), min(self.width, x1 - margin + 1))
        if dx <= 0 or len(xs) < max(6, dx * 0.45):
            return 0.0, 0.0
        ys = np.rint(y0 + (y1 - y0) * ((xs - x0) / dx)).astype(int)[:, None] + np.arange(-half, half + 1)
        there = (ys >= 0) & (ys < self.height)
        black = self.cleaned[np.clip(ys, 0, self.height - 1), xs[:, None]] & there
        some = there.any(1)
        if not some.any():
            return 0.0, 0.0
        return float(black.any(1).sum() / some.sum()), float(black.sum() / there.sum())

    def ends(self, direction: str, staff: int, least: float = 0) -> list[tuple[int, int, int]]:
        """(stem index, x, y of the free end) from left to right."""
        return sorted(((k, t["x"], t["y0"] if direction == "up" else t["y1"]) for k, t in enumerate(self.records["stems"]) if (t["staff"], t["direction"]) == (staff, direction) and t["length"] >= least), key=lambda e: e[1])

    def find_links(self) -> list[dict]:
        s, p, out = self.space, self.p, []
        good = lambda hd: hd[0] >= p.beam_hit and hd[1] >= p.beam_density
        for st in self.staves:
            for direction in ("up", "down"):
                stems = self.ends(direction, st["index"], 1.85 * s)
                for at, (left, lx, ly) in enumerate(stems):
                    best = None
                    for right, rx, ry in stems[at + 1 : at + 1 + p.beam_ahead]:
                        dx, dy = rx - lx, ry - ly
                        if not 1.10 * s <= dx <= 7.50 * s or abs(dy) > 2.60 * s or abs(dy / max(1, dx)) > 0.85:
                            continue
                        shift, found = 0.0, self.corridor(lx, ly, rx, ry)
                        for offset in () if good(found) else (-0.38 * s, 0.38 * s, -0.72 * s, 0.72 * s):
                            other = self.corridor(lx, near(ly + offset), rx, near(ry + offset))
                            if sum(other) > sum(found):
                                shift, found = offset, other
                        score = min(1.0, 0.72 * found[0] + 0.55 * found[1])
                        if good(found) and (best is None or score > best["score"]):
                            best = {"staff": st["index"], "stem_indices": [left, right], "x0": lx, "y0": near(ly + shift), "x1": rx, "y1": near(ry + shift), "direction": direction, "score": score, "hit_ratio": found[0], "density": found[1]}
                    out += [best] if best else []
        clash = lambda a, b: (a["staff"], a["direction"]) == (b["staff"], b["direction"]) and abs(a["x0"] - b["x0"]) <= 0.45 * s and abs(a["x1"] - b["x1"]) <= 0.45 * s
        return kept(out, clash, lambda i: (i["staff"], i["x0"], i["x1"], i["y0"]))

    def find_groups(self) -> list[dict]:
        s, links, out = self.space, self.records["beam_links"], []
        slope = lambda link: (link["y1"] - link["y0"]) / max(1, link["x1"] - link["x0"])
        for st in self.staves:
            for direction in ("up", "down"):
                rank = {k: r for r, (k, *_) in enumerate(self.ends(direction, st["index"]))}
                rated = []
                for k, link in enumerate(links):
                    if (link["staff"], link["direction"]) != (st["index"], direction):
                        continue
                    a, b = link["stem_indices"]
                    gap, dx = rank[b] - rank[a], max(1, link["x1"] - link["x0"])
                    quality = link["score"] - 0.14 * (gap - 1) - 0.015 * max(0.0, dx / s - 2.8)
                    if gap in (1, 2) and dx <= 4.8 * s and abs(slope(link)) <= 0.75 and quality >= 0.58:
                        rated.append((quality, k))
                for end in (0, 1):  # the best link of each left stem, then of each right stem
                    best: dict[int, tuple] = {}
                    for q, k in sorted(rated, key=lambda r: -r[0]):
                        best.setdefault(links[k]["stem_indices"][end], (q, k))
                    rated = list(best.values())
                onward = {links[k]["stem_indices"][0]: k for _, k in rated}
                reached = {links[k]["stem_indices"][1] for _, k in rated}
                for at in sorted(onward.keys() - reached, key=rank.get):
                    part: list[int] = []
                    while at in onward:
                        k = onward[at]
                        if part and abs(slope(links[k]) - np.median([slope(links[o]) for o in part])) > self.p.slope_break:
                            out.append(self.group(st, part, slope))
                            part = []
                        part.append(k)
                        at = links[k]["stem_indices"][1]
                    out.append(self.group(st, part, slope))
        return out

    def group(self, st: dict, part: list[int], slope) -> dict:
        own = [self.records["beam_links"][k] for k in part]
        stems = [own[0]["stem_indices"][0], *(link["stem_indices"][1] for link in own)]
        points = [[own[0]["x0"], own[0]["y0"]], *([link["x1"], link["y1"]] for link in own)]
        (x, y), pad = zip(*points), max(2, near(0.35 * self.space))
        means = {k: float(np.mean([link[k] for link in own])) for k in ("score", "hit_ratio", "density")}
        return {"staff": st["index"], "direction": own[0]["direction"], "stem_indices": stems, "link_indices": list(part), "points": points, "bbox": [min(x) - pad, min(y) - pad, max(x) + pad, max(y) + pad], "slope": float(np.median([slope(link) for link in own])), **means}

    # --------------------------------------------------------- other symbols
    def erased(self) -> np.ndarray:
        out, s = self.cleaned.copy(), self.space
        rx, ry = max(5, near(0.95 * s)), max(4, near(0.65 * s))
        y, x = np.mgrid[-ry : ry + 1, -rx : rx + 1]
        dy, dx = np.nonzero((x / rx) ** 2 + (y / ry) ** 2 <= 1.0)
        for n in self.records["noteheads"]:
            ys, xs = near(n["y"]) - ry + dy, n["x"] - rx + dx
            ok = (ys >= 0) & (ys < self.height) & (xs >= 0) & (xs < self.width)
            out[ys[ok], xs[ok]] = False
        for t in self.records["stems"]:
            out[max(0, t["y0"] - 2) : t["y1"] + 3, max(0, t["x"] - 2) : t["x"] + 3] = False
        return out

    def find_symbols(self) -> tuple[list[dict], list[dict], list[dict]]:
        s, source, rec = self.space, self.erased(), self.records
        rests, beams, slurs = [], [], []
        for st in self.staves:
            own = {k: [r for r in rec[k] if r["staff"] == st["index"]] for k in ("noteheads", "stems", "barlines", "beam_groups")}
            for x0, y0, x1, y1, area in components(source, near(st["scan_x0"]), near(st["y0"] - 3 * s), near(st["x1"] + s), near(st["y1"] + 3 * s)):
                w, h, cx, cy = x1 - x0, y1 - y0, 0.5 * (x0 + x1), 0.5 * (y0 + y1)
                density = area / (w * h)
                if area < max(4, int(0.08 * s * s)) or any(abs(b["x"] - cx) <= 0.45 * s for b in own["barlines"]):
                    continue
                touches = lambda g: min(x1, g[2] + 0.2 * s) >= max(x0, g[0] - 0.2 * s) and min(y1, g[3] + 0.2 * s) >= max(y0, g[1] - 0.2 * s)  # noqa: E731, B023
                if any(touches(g["bbox"]) for g in own["beam_groups"]):
                    continue
                by_stem = any(
                    x0 - 0.75 * s <= t["x"] <= x1 + 0.75 * s and min(t["y1"], y1 + 0.8 * s) >= max(t["y0"], y0 - 0.8 * s) or abs(t["x"] - cx) <= 0.45 * s and t["y0"] - s <= cy <= t["y1"] + s for t in own["stems"]
                )
                sized = 0.55 * s <= w <= 1.75 * s and 0.38 * s <= h <= 1.10 * s and self.pitch_distance(st, cy) <= 0.24 * s
                if by_stem and w <= 2.2 * s or sized and (0.75 <= w / h <= 2.20 and density >= 0.42 or by_stem):
                    continue
                item = {"staff": st["index"], "bbox": [x0, y0, x1, y1], "density": density}
                close = any(x0 - 0.35 * s <= n["x"] <= x1 + 0.35 * s and y0 - 0.35 * s <= n["y"] <= y1 + 0.35 * s for n in own["noteheads"])
                if not close and st["y0"] - 1.15 * s <= cy <= st["y1"] + 1.15 * s:
                    middle = st["lines"][1] - 0.35 * s <= cy <= st["lines"][3] + 0.35 * s
                    if 0.55 * s <= w <= 2.2 * s and 0.14 * s <= h <= 0.52 * s and w / h >= 2.05 and density >= 0.35 and middle:
                        rests.append({**item, "kind": "whole_or_half_rest", "score": density})
                        continue
                    if 0.25 * s <= w <= 1.45 * s and 0.9 * s <= h <= 3.2 * s and density <= 0.62:
                        rests.append({**item, "kind": "quarter_or_eighth_rest", "score": area / (s * s) / max(1.0, h / s)})
                        continue
                if w >= 1.45 * s and h <= 0.95 * s and density >= 0.38:
                    beams.append({**item, "kind": "beam_candidate", "score": min(1.0, w / max(1.0, 4 * s) * density)})
                elif w >= 1.8 * s and 0.18 * s <= h <= 1.7 * s and 0.035 <= density <= 0.36:
                    slurs.append({**item, "kind": "tie_or_slur_candidate" if w <= 6.5 * s else "slur_candidate", "score": min(1.0, w / max(1.0, 5 * s) * (0.45 - density))})
        return tuple(kept(found, boxes_clash(3), by_box) for found in (rests, beams, slurs))
