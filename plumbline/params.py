"""Parameters shared by the coverage plans."""

from __future__ import annotations

from dataclasses import dataclass

# Default thresholds and limits of the coverage report.
DEFAULT_THRESHOLDS = (1, 5, 10, 20, 30, 50, 100)
DEFAULT_MAX_TARGETS = 2_000
DEFAULT_MAX_TOTAL_BP = 50_000_000
DEFAULT_MAX_BED_BYTES = 50 * 1024 * 1024

# Width of the position bins that partition every axis. It bounds each window group, whatever the input.
DEFAULT_BIN_SIZE = 1 << 14


@dataclass(frozen=True)
class CoverageParams:
    """What to measure per target."""

    thresholds: tuple[int, ...] = DEFAULT_THRESHOLDS
    low_threshold: int = 10
    low_min_len: int = 50
    median: str = "interp"  # "interp" averages the two middles, "low" takes the lower one
    bin_size: int = DEFAULT_BIN_SIZE


@dataclass(frozen=True)
class ClassifyParams:
    """Cut-offs of the ordered status rules."""

    pass_pct_ge_20: float = 95.0
    pass_max_pct_zero: float = 1.0
    dropout_pct_zero: float = 5.0
    dropout_zero_block_bp: int = 500
    uneven_cv: float = 1.0
    exon_pct_ge_20: float = 90.0
    exon_max_pct_zero: float = 5.0


def parse_thresholds(spec: str) -> tuple[int, ...]:
    """``"30, 1,5"`` -> ``(1, 5, 30)``; a custom list replaces the default one."""
    try:
        values = [int(part) for part in spec.split(",")]
    except ValueError as exc:
        raise ValueError("thresholds must be comma-separated non-negative integers") from exc
    if any(v < 0 for v in values):
        raise ValueError("thresholds must be comma-separated non-negative integers")
    return tuple(sorted(set(values)))
