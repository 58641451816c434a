"""Parameters of the study. Every default is a fixed value that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

# Clocks.
RAW_ZONE = "America/Chicago"
EVENT_ZONE = "Europe/Berlin"
ANALYSIS_ZONE = "UTC"
CLOCK_SCHEMA = "timezone_v1"
TIME_COLUMN = "Time"
LATE_CLOCK_FROM = date(2022, 7, 21)
PURCHASES_FROM = date(2015, 3, 1)
HIKES_FROM = date(2022, 7, 1)

# Raw file format.
RAW_HEADER = "Time,Open,High,Low,Latest,Change,%Change,Volume"
FOOTER_MARK = "downloaded from barchart"
RAW_NAME_PATTERN = (
    r"^([a-z]+)([hmuz])(\d{2})_intraday-(\d+)min_historical-data-(\d{2})-(\d{2})-(\d{4})"
    r"(?:_clean)?\.csv$"
)
RAW_TIME_FORMAT = "yyyy-MM-dd HH:mm"
ROOTS = ("fx", "gg")
EXPIRIES = ("H", "M", "U", "Z")
STUDY_YEARS = (2013, 2025)


@dataclass(frozen=True)
class CleaningRules:
    spike_ratio: float = 5.0
    spike_log_jump: float = 1.0
    spike_gap_minutes: float = 60.0
    low_volume: float = 1.0
    raw_zone: str = RAW_ZONE


@dataclass(frozen=True)
class DayQualityRules:
    bar_minutes: float = 5.0
    low_volume: float = 1.0
    long_gap_minutes: float = 15.0
    very_long_gap_minutes: float = 60.0


@dataclass(frozen=True)
class SelectionRules:
    min_bars: float = 24
    min_total_volume: float = 1
    max_share_low_volume: float = 0.80
    min_pct_expected_gaps: float = 0.40
    weight_volume: float = 0.35
    weight_bars: float = 0.20
    weight_lowvol: float = 0.25
    weight_gaps: float = 0.20


@dataclass(frozen=True)
class WindowRules:
    bar_minutes: int = 5
    low_volume: float = 1.0
    pr_pre: int = 15
    pr_post: int = 30
    pc_pre: int = 15
    pc_post: int = 75
    ann_pre_from_pr: int = 15
    ann_post_from_pc: int = 75
    min_pct_expected: float = 0.80
    max_share_low_volume: float = 0.50
    max_gap_minutes: float = 15.0


@dataclass(frozen=True)
class GridRules:
    """Exact-grid windows around a release, in minutes relative to it."""

    bar_minutes: int = 5
    pre_ends: tuple[int, int] = (-55, -5)
    post_ends: tuple[int, int] = (0, 45)
    volume_range: tuple[int, int] = (-60, -5)
    min_coverage: float = 0.80
    min_returns: int = 5
    min_pairs: int = 4
    slow_days: int = 5

    def scaled(self, factor: int) -> "GridRules":
        two = lambda t: (t[0] * factor, t[1] * factor)
        return replace(
            self,
            bar_minutes=self.bar_minutes * factor,
            pre_ends=two(self.pre_ends),
            post_ends=two(self.post_ends),
            volume_range=two(self.volume_range),
        )


@dataclass(frozen=True)
class MatchRules:
    neighbours: int = 10
    min_neighbours: int = 2
    max_year_gap: int = 2
    calendar_weight: float = 0.20
    calendar_scale: float = 5.0
    min_events: int = 30
    min_controls: int = 100


@dataclass(frozen=True)
class DrawRules:
    draws: int = 999
    seed: int = 20260717
    block: int = 5
    blocks_of_draws: int = 8


@dataclass(frozen=True)
class Study:
    cleaning: CleaningRules = field(default_factory=CleaningRules)
    quality: DayQualityRules = field(default_factory=DayQualityRules)
    selection: SelectionRules = field(default_factory=SelectionRules)
    window: WindowRules = field(default_factory=WindowRules)
    grid: GridRules = field(default_factory=GridRules)
    match: MatchRules = field(default_factory=MatchRules)
    draw: DrawRules = field(default_factory=DrawRules)
