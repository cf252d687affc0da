"""Rule constants of grading, as one frozen value that operators take as a parameter.

The defaults are fixed values: dates and tolerances that results depend on.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class GradingRules:
    """Windows, regimes and documented exceptions."""

    #: Reference area of each bank, and days after an announcement in which its event may fall.
    ref_area: dict[str, str] = field(default_factory=lambda: {"FED": "US", "ECB": "XM"})
    window_days: dict[str, int] = field(default_factory=lambda: {"FED": 5, "ECB": 10})
    level_tolerance: float = 0.005
    trap_doc_types: tuple[str, ...] = ("minutes", "non_decision")
    #: Start of each area's audited window; earlier shifts are kept but excluded.
    window_start: dict[str, dt.date] = field(default_factory=lambda: {"US": dt.date(2000, 1, 1), "XM": dt.date(1999, 1, 1)})
    #: Instruments of the regime area by start date; dates before the first belong to the first.
    regimes: tuple[tuple[dt.date, str], ...] = (
        (dt.date(1999, 1, 1), "MRO"),
        (dt.date(2000, 6, 28), "MRO"),
        (dt.date(2008, 10, 15), "MRO"),
        (dt.date(2024, 9, 18), "DFR"),
    )
    regime_area: str = "XM"
    other_instrument: str = "FFTR_MID"
    #: Dates on which the regime area's series was redefined (excluded) or is noted for audit.
    redefinition_dates: tuple[dt.date, ...] = (dt.date(2024, 9, 18),)
    redefinition_reason: str = "series redefinition (MRO -> DFR), not a policy decision"
    audit_dates: tuple[dt.date, ...] = (dt.date(2000, 6, 28), dt.date(2008, 10, 15))
    audit_note: str = "coincides with an MRO tender-procedure change; cross-check against the ECB FM series"
    #: Announcements that moved one edge of the corridor only, and those where a point became a range.
    corridor_only: dict[str, tuple[dt.date, ...]] = field(default_factory=lambda: {"ECB": (dt.date(2015, 12, 3), dt.date(2019, 9, 12))})
    range_transition: dict[str, tuple[dt.date, ...]] = field(default_factory=lambda: {"FED": (dt.date(2008, 12, 16),)})


DEFAULT_RULES = GradingRules()
