"""Record types of a page's detections (every table also has page_id)."""

from __future__ import annotations

_BOX = "staff INT, bbox ARRAY<INT>, kind STRING, score DOUBLE, density DOUBLE"

#: Field names and types of the emitted records, in document order.
RECORDS: dict[str, str] = {
    "staff_line_candidates": "y DOUBLE, thickness INT, x0 INT, x1 INT, strength INT",
    "staves": "index INT, lines ARRAY<DOUBLE>, x0 INT, x1 INT, y0 DOUBLE, y1 DOUBLE, space DOUBLE, clef_bbox ARRAY<INT>, clef_type STRING, scan_x0 INT",
    "accidentals": _BOX,
    "text_regions": "staff INT, bbox ARRAY<INT>, text STRING, score DOUBLE, component_count INT",
    "noteheads": "staff INT, x INT, y DOUBLE, pitch_step INT, kind STRING, score DOUBLE, black_density DOUBLE, center_density DOUBLE",
    "stems": "staff INT, note_index INT, x INT, y0 INT, y1 INT, direction STRING, length INT, score DOUBLE",
    "ledger_lines": "staff INT, note_index INT, bbox ARRAY<INT>, side STRING, line_number INT, score DOUBLE",
    "barlines": "staff INT, x INT, y0 INT, y1 INT, kind STRING, score DOUBLE",
    "rests": _BOX,
    "beams": _BOX,
    "beam_links": "staff INT, stem_indices ARRAY<INT>, x0 INT, y0 INT, x1 INT, y1 INT, direction STRING, score DOUBLE, hit_ratio DOUBLE, density DOUBLE",
    "beam_groups": "staff INT, direction STRING, stem_indices ARRAY<INT>, link_indices ARRAY<INT>, points ARRAY<ARRAY<INT>>, bbox ARRAY<INT>, slope DOUBLE, score DOUBLE, hit_ratio DOUBLE, density DOUBLE",
    "slurs_or_ties": _BOX,
}

PAGE = "page_id STRING, status STRING, threshold INT, staff_space DOUBLE, width INT, height INT, " + ", ".join(
    f"{name} ARRAY<STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in ddl.split(', '))}>>" for name, ddl in RECORDS.items()
)
