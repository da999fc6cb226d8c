"""Parameters of a build. Thresholds are parameters whose defaults are the published methodology's."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from dataclasses import dataclass, field

SCHEMA_VERSION = "2.0.0"
WINDOW_DAYS = 7


@dataclass(frozen=True)
class Thresholds:
    index_panel: int = 500
    overlap_panel: int = 500
    overlap_containment: float = 20.0
    health_share: float = 0.80
    dispersion_stores: int = 20
    dispersion_banners: int = 3
    dispersion_directional: int = 10
    entity_publishable: int = 100
    entity_directional: int = 30
    basket_stores: int = 20
    basket_stores_directional: int = 5
    basket_banners: int = 3
    basket_banners_directional: int = 2
    warning: tuple[float, float] = (0.667, 1.5)
    critical: tuple[float, float] = (0.5, 2.0)
    scale_tolerance: float = 1.05
    presentation_tolerance: float = 0.02
    stale_days: int = 14
    low_days: int = 30
    healthy_share: float = 0.80
    geography_prefix: str = "AR-"
    drivers: int = 15
    sample_rows: int = 10_000


@dataclass(frozen=True)
class BuildContext:
    as_of: dt.date
    window_start: dt.date
    build_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    source_set_hash: str = ""
    validation_date: dt.date | None = None
    days: int = WINDOW_DAYS
    #: Unit of the window's dates: observations of neighbouring units are consecutive.
    unit: str = "day"
    thresholds: Thresholds = Thresholds()


def resolve_window(dates: list[dt.date], as_of: dt.date | None = None, days: int = WINDOW_DAYS) -> tuple[dt.date, dt.date]:
    """First and last date of the window that ends at as_of, or at the last date; all of its days must be there."""
    have = sorted({d for d in dates if as_of is None or d <= as_of})
    if not have or (as_of is not None and have[-1] != as_of):
        raise ValueError(f"no active snapshot for {as_of or 'any date'}")
    end = have[-1]
    start = end - dt.timedelta(days=days - 1)
    wanted = [start + dt.timedelta(days=k) for k in range(days)]
    missing = [str(d) for d in wanted if d not in set(have)]
    if missing:
        raise ValueError(f"the window needs {days} consecutive snapshots; missing: {', '.join(missing)}")
    return start, end


def source_set_hash(inputs: list[tuple[dt.date, str, str]]) -> str:
    """SHA-256 over date, run and file hash of each input, in order of date."""
    return hashlib.sha256("\n".join("|".join(map(str, row)) for row in sorted(inputs)).encode()).hexdigest()
