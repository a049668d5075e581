"""Query constants as parameters, with the defaults every bundled query uses."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class QueryParams:
    """Thresholds and windows of the five questions. Days are inclusive ``YYYY/MM/DD`` text."""

    excluded_format: str = "reinvestment"
    usd_name: str = "US Dollar"
    small_above: float = 0.0
    small_below: float = 50.0
    reference_from: str = "2022/09/01"
    reference_to: str = "2022/09/05"
    candidate_from: str = "2022/09/06"
    candidate_to: str = "2022/09/15"
    average_factor: float = 0.01
    min_peers: int = 5
    converted_formats: tuple[str, ...] = ("ACH", "Wire")
    tiny_above: float = 0.0
    tiny_below: float = 1.0
    unnamed_bank: str = "Unknown"


DEFAULTS = QueryParams()
