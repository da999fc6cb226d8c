"""Reading a published build back: lineage, gates, metrics, a grade, a report."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from gondola.plans import gates
from gondola.plans.context import BuildContext, Thresholds
from gondola.plans.registry import Tables

HIGH, MEDIUM, LOW = "Alta", "Media", "Baja"
#: Marts that must be there, and those that must have rows.
REQUIRED = (
    "dim_banner_daily", "dim_store_daily", "dim_product_asof", "fct_global_price_store_daily", "mart_price_product_daily", "mart_quality_daily", "mart_snapshot_health", "dim_banner_scope", "mart_banner_day_health",
    "dim_basket_version", "dim_basket_component", "mart_basket_candidate_review", "mart_banner_index_daily", "mart_banner_index_7d", "quality_price_anomaly_daily", "mart_price_dispersion_daily", "mart_basket_store_daily", "mart_basket_banner_daily", "quality_checks",
)
MAY_BE_EMPTY = frozenset({"quality_price_anomaly_daily", "mart_basket_candidate_review", "mart_banner_index_daily", "mart_banner_index_7d", "dim_product_asof"})


class ValidationError(RuntimeError):
    """A high failure: the build must not be used."""


@dataclass
class Result:
    grade: str
    high: list[str]
    medium: list[str]
    lineage: list[str]
    metrics: dict[str, object] = field(default_factory=dict)

    @property
    def usable(self) -> bool:
        return not self.high and not self.lineage


def lineage_faults(ctx: BuildContext, t: Tables) -> list[str]:
    """Missing or empty marts, and rows of another build."""
    faults = [f"{name}: missing" for name in REQUIRED if name not in t]
    for name in REQUIRED:
        if name in t and "build_id" in t[name].columns:
            builds = [r["build_id"] for r in t[name].select("build_id").distinct().limit(3).collect()]
            if not builds and name not in MAY_BE_EMPTY:
                faults.append(f"{name}: empty")
            if builds and builds != [ctx.build_id]:
                faults.append(f"{name}: rows of other builds")
    return faults


def grade(high: bool, medium: bool, inputs_ok: bool, age: int, healthy_share: float, snapshots_healthy: bool, limits: Thresholds = Thresholds()) -> str:
    if high or not inputs_ok or age > limits.low_days or healthy_share < limits.healthy_share:
        return LOW
    return MEDIUM if medium or not snapshots_healthy or age > limits.stale_days else HIGH


def validate(ctx: BuildContext, t: Tables, today: dt.date | None = None) -> Result:
    today = today or ctx.validation_date or dt.date.today()
    lineage = lineage_faults(ctx, t)
    checks = [r.asDict() for r in t["quality_checks"].collect()]  # one row for each gate
    odd = {c["test_name"] for c in checks} ^ set(gates.GATES)
    lineage += [f"gate {name}: missing or unknown" for name in sorted(odd)]
    failed = [c for c in checks if c["failed_rows"] > 0]
    banner = t["mart_banner_day_health"].agg(F.count(F.lit(1)).alias("n"), F.count_if("source_healthy").alias("healthy")).first()
    source = t["mart_snapshot_health"].agg(F.count_if(~F.col("source_healthy")).alias("unhealthy")).first()
    inputs = t["build_inputs"].filter(F.col("build_id") == ctx.build_id).count()
    index = t["mart_banner_index_daily"].agg(F.count_distinct("snapshot_date").alias("days"), F.count_distinct(F.when(F.col("publishable"), F.col("snapshot_date"))).alias("published"), F.min("common_gtins").alias("panel")).first()
    basket = t["mart_basket_store_daily"].agg(F.count_if("complete_basket").alias("complete")).first()
    quality = t["mart_quality_daily"].agg(F.sum("source_rows").alias("rows"), F.sum("global_gtin_rows").alias("comparable"), F.sum("restricted_local_rows").alias("restricted")).first()
    high = [c["test_name"] for c in failed if c["severity"] == gates.HIGH]
    medium = [c["test_name"] for c in failed if c["severity"] == gates.MEDIUM]
    age = (today - ctx.as_of).days
    share = banner["healthy"] / banner["n"] if banner["n"] else 0.0
    metrics = {"inputs": inputs, "age_days": age, "healthy_banner_days": banner["healthy"], "banner_days": banner["n"], "unhealthy_snapshots": source["unhealthy"], "index_days": index["days"], "publishable_index_days": index["published"], "smallest_panel": index["panel"], "complete_baskets": basket["complete"], "source_rows": quality["rows"], "comparable_rows": quality["comparable"], "restricted_rows": quality["restricted"]}
    return Result(grade(bool(high or lineage), bool(medium), inputs == ctx.days, age, share, source["unhealthy"] == 0, ctx.thresholds), high, medium, lineage, metrics)


def report(ctx: BuildContext, result: Result) -> str:
    lines = [f"# Validation report {ctx.as_of}", "", f"- Build: `{ctx.build_id}`", f"- Window: {ctx.window_start} to {ctx.as_of}", f"- Confidence: **{result.grade}**", "", "| metric | value |", "|---|---:|"]
    lines += [f"| {k} | {v} |" for k, v in result.metrics.items()]
    for title, names in (("High failures", result.high), ("Medium failures", result.medium), ("Lineage", result.lineage)):
        lines += ["", f"## {title}", "", *([f"- {n}" for n in names] or ["None."])]
    return "\n".join(lines) + "\n"


def checked(ctx: BuildContext, t: Tables, write_report, today: dt.date | None = None) -> Result:
    """Validates, writes the report, and only then raises if the build may not be used."""
    result = validate(ctx, t, today)
    write_report(report(ctx, result))
    if not result.usable:
        raise ValidationError("; ".join(result.high + result.lineage))
    return result
