"""Thresholds of the page geometry, in units of the staff space unless noted."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults that results must agree on.  Lengths named *_px are pixels."""

    otsu_default: int = 180
    ink_offset: int = 35
    ink_low: int = 170
    ink_high: int = 212
    speck_area: int = 3
    line_width_share: float = 0.22
    line_peak_share: float = 0.62
    line_percentile: float = 0.995
    line_run_share: float = 0.35
    space_low_px: float = 6.0
    space_high_px: float = 80.0
    space_near_px: float = 2.0
    staff_tolerance_px: float = 2.4
    staff_tolerance: float = 0.22
    scan_offset: float = 4.2
    line_erase: float = 0.10
    long_run_px: int = 18
    long_run: float = 1.75
    pitch_first: int = -10
    pitch_last: int = 18
    stem_least: float = 2.1
    stem_most: float = 4.8
    stem_gap_px: int = 7
    bar_least: float = 3.55
    bar_gap_px: int = 1
    bar_match: float = 0.60
    bar_match_px: float = 2.0
    bar_reach: float = 13.0
    beam_ahead: int = 4
    beam_hit: float = 0.58
    beam_density: float = 0.16
    slope_break: float = 0.22


DEFAULTS = Params()
