"""A page of charts over the exported tables: two key figures and six bar charts, one HTML file without scripts.

Every chart shows the last date that may be published of its own table and says which that is; narrow screens stack
the charts.
"""

from __future__ import annotations

from html import escape
from pathlib import Path

import pandas as pd

from gondola.plans.context import BuildContext

STYLE = (
    "body{font-family:sans-serif;margin:1rem auto;max-width:72rem;color:#222}main{display:grid;grid-template-columns:1fr 1fr;gap:1rem}"
    "section{border:1px solid #ddd;border-radius:.5rem;padding:.8rem}svg{width:100%;height:auto}b.big{font-size:1.8rem;display:block}"
    "small{color:#666}@media(max-width:48rem){main{grid-template-columns:1fr}}"
)


def last(frame: pd.DataFrame, usable: str | None = None) -> tuple[pd.DataFrame, object]:
    """Rows of the last date among the usable ones, and that date."""
    if usable == "publishable":
        frame = frame[frame.publishable.astype(bool)]
    elif usable:
        frame = frame[frame.coverage_status == usable]
    if not len(frame):
        return frame, None
    date = frame.snapshot_date.max()
    return frame[frame.snapshot_date == date], date


def bars(rows: list[tuple[str, float]], middle: float = 0.0) -> str:
    """Horizontal bars from the middle value, as an SVG of one line each."""
    rows = [(str(label), float(v)) for label, v in rows if v is not None and v == v]
    if not rows:
        return "<p>Nothing to show.</p>"
    low, high = min([middle, *(v for _, v in rows)]), max([middle, *(v for _, v in rows)])
    x = lambda v: 220 + 300 * (v - low) / ((high - low) or 1)
    out = [f'<svg viewBox="0 0 600 {24 * len(rows)}" role="img">']
    for k, (label, v) in enumerate(rows):
        a, b = sorted((x(middle), x(v)))
        out.append(f'<text x="0" y="{24 * k + 16}" font-size="13">{escape(label[:30])}</text><rect x="{a:.1f}" y="{24 * k + 4}" width="{max(1.0, b - a):.1f}" height="16" fill="#3569a8"/><text x="595" y="{24 * k + 16}" font-size="13" text-anchor="end">{v:,.2f}</text>')
    return "".join([*out, "</svg>"])


def charts(frames: dict[str, pd.DataFrame]) -> list[tuple[str, object, str]]:
    """Title, date and drawing of each chart."""
    named = lambda f, label, value: sorted(zip(f[label], f[value]), key=lambda r: (r[1] is None, r[1])) if len(f) else []
    index, on_index = last(frames["index_daily"], "publishable")
    banner, on_banner = last(frames["basket_banner"], "PUBLISHABLE")
    province, on_province = last(frames["basket_province"], "PUBLISHABLE")
    spread = frames["dispersion_entity"]
    spread, on_spread = last(spread[spread.dispersion_level == "BANNER"], "PUBLISHABLE")
    health, on_health = last(frames["banner_health"])
    effect, on_effect = last(frames["index_sensitivity"])
    return [
        ("Price index, 100 is the common level", on_index, bars(named(index, "banner_label", "price_index"), 100.0)),
        ("Basket by banner", on_banner, bars(named(banner, "banner_label", "branch_median_cost"))),
        ("Basket by province", on_province, bars(named(province, "provincia_codigo", "branch_median_cost"))),
        ("Price dispersion by banner", on_spread, bars(named(spread, "banner_label", "median_dispersion_clean"))),
        ("Share of stores that reported", on_health, bars(named(health, "banner_label", "store_coverage_ratio"))),
        ("Effect of extreme products on the index", on_effect, bars(named(effect, "banner_label", "sensitivity_delta"))),
    ]


def page(ctx: BuildContext, frames: dict[str, pd.DataFrame]) -> str:
    health, checks = frames["banner_health"], frames["quality_checks"]
    share = float(health.source_healthy.astype(bool).mean()) if len(health) else float("nan")
    figures = [("Healthy banner-days", f"{100 * share:.0f} %" if share == share else "none"), ("High gates that failed", str(int(checks[checks.severity == "high"].failed_rows.sum())) if len(checks) else "0")]
    out = [f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width"><title>Prices {ctx.as_of}</title><style>{STYLE}</style></head><body><h1>Prices up to {ctx.as_of}</h1><main>']
    out += [f'<section><b class="big">{escape(value)}</b>{escape(label)}</section>' for label, value in figures]
    out += [f"<section><h2>{escape(title)}</h2>{drawing}<small>{'no publishable date' if date is None else escape(str(date)[:10])}</small></section>" for title, date, drawing in charts(frames)]
    return "".join([*out, "</main></body></html>"])


def write(ctx: BuildContext, frames: dict[str, pd.DataFrame], path: Path) -> None:
    path.write_text(page(ctx, frames), encoding="utf-8")
