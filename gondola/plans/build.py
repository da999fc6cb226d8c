"""Building the marts of a window and publishing them if no high gate fails.

Marts whose dates stand alone (registry.Mart.daily) are built date by date and shared by builds: a date's rows are named
by the fingerprint of all they were made from (the archive's hash, the methodology, the fingerprints of the marts below,
and of the dates before it where the mart looks back). What has been stored under its fingerprint is read, only the other
dates are computed, from these dates' sources alone. What depends on the whole window is small and built each time; where a
daily mart reads it, the rows of its date take the place of a fingerprint.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.operators.facts import duplicate_grain
from gondola.plans import gates, registry
from gondola.plans.context import SCHEMA_VERSION, BuildContext, Thresholds, resolve_window, source_set_hash
from gondola.plans.registry import Mart, Tables
from gondola.plans.validate import ValidationError, lineage_faults
from gondola.plans.warehouse import Warehouse

SOURCES = ("commerce_snapshot", "store_snapshot", "fact_price", "ingestion_log")


class GrainError(ValueError):
    """Comparable prices with a repeated key."""


def source(store: Warehouse, name: str, inputs: list[tuple[dt.date, str, str]]) -> DataFrame:
    """A source's rows of the given runs: only their folders are read."""
    return store.spark.read.parquet(*[store.place("sources", run, name) for _, run, _ in inputs])


def check_grain(prices: DataFrame) -> None:
    comparable = prices.filter((F.col("product_code_scope") == "GLOBAL_GTIN") & F.col("precio_lista_valido"))
    first = duplicate_grain(comparable).limit(1).collect()
    if first:
        raise GrainError(f"repeated key: {first[0].asDict()}")


def _hash(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, default=str).encode()).hexdigest()


def content(rows: DataFrame, columns: tuple[str, ...], dates: list[dt.date]) -> dict[dt.date, str]:
    """A fingerprint of each date's rows of a small table, whatever their order; of all rows, where it has no dates."""
    dated = "snapshot_date" in rows.columns
    columns = columns or tuple(c for c in rows.columns if c != "build_id")
    day = F.col("snapshot_date") if dated else F.lit(None).cast("date")
    sums = rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), *columns)).alias("xor"))
    found = {r.day: _hash(r.n, r.sum, r.xor) for r in sums.collect()}  # a row for each date of the window
    return {d: found.get(d if dated else None, "none") for d in dates}


class Daily:
    """The daily marts of one build: which dates are there, which are computed, and where they are."""

    def __init__(self, store: Warehouse, ctx: BuildContext, inputs: list[tuple[dt.date, str, str]], fresh: bool):
        self.store, self.ctx, self.inputs, self.fresh = store, ctx, inputs, fresh
        self.dates = [d for d, _, _ in inputs]
        self.prints = {name: {d: sha for d, _, sha in inputs} for name in SOURCES}
        self.places: dict[str, dict] = {}
        #: Dates that were computed, by mart.
        self.computed: dict[str, list[dt.date]] = {}

    def _print(self, m: Mart, date: dt.date) -> str:
        back = [date - dt.timedelta(days=k) for k in range(m.lag + 1)]
        return _hash(SCHEMA_VERSION, m.name, repr(self.ctx.thresholds), [[n, [self.prints[n].get(d) for d in back]] for n in m.needs if n in self.prints])

    def _of(self, tables: Tables, name: str, dates: list[dt.date]) -> DataFrame:
        if name in SOURCES:
            return source(self.store, name, [i for i in self.inputs if i[0] in dates])
        rows = tables[name]
        return rows.filter(F.col("snapshot_date").isin(dates)) if "snapshot_date" in rows.columns else rows

    def build(self, m: Mart, tables: Tables) -> DataFrame:
        self.prints[m.name] = {d: self._print(m, d) for d in self.dates}
        keys = {d: f"{m.name}/{d}/{self.prints[m.name][d]}" for d in self.dates}
        have = {} if self.fresh else self.store.stored(keys.values())
        missing = [d for d in self.dates if keys[d] not in have]
        if missing:
            read = [d for d in self.dates if any(d + dt.timedelta(days=k) in missing for k in range(m.lag + 1))]
            if m.name == "fct_global_price_store_daily":
                check_grain(self._of(tables, "fact_price", missing))
            rows = m.build(self.ctx, Tables({n: self._of(tables, n, read) for n in m.needs}))
            self.store.write_daily(rows.filter(F.col("snapshot_date").isin(missing)), m.name, self.ctx.build_id, [keys[d] for d in missing])
            have |= dict.fromkeys((keys[d] for d in missing), f"daily/{m.name}/{self.ctx.build_id}")
        self.computed[m.name] = missing
        self.places[m.name] = self.store.layout(m.name) | {"dates": {str(d): have[keys[d]] for d in self.dates}}
        return self.store.read_daily(self.ctx.build_id, **self.places[m.name])

    def note(self, m: Mart, rows: DataFrame) -> None:
        """A mart of the whole window that daily ones read."""
        self.prints[m.name] = content(rows, m.windowed, self.dates)


def build(store: Warehouse, as_of: dt.date | None = None, thresholds: Thresholds = Thresholds(), today: dt.date | None = None, fail_after: str | None = None, fresh: bool = False) -> BuildContext:
    """All marts, gates and lineage under a new build id, which is published last. fresh: stored dates aren't used. fail_after: for tests."""
    run_id = store.start("build", as_of=as_of)
    try:
        states = {dt.date.fromisoformat(d): s for d, s in store.snapshots.items()}
        start, end = resolve_window(list(states), as_of)
        inputs = [(d, s["run_id"], s["sha256"]) for d, s in sorted(states.items()) if start <= d <= end]
        ctx = BuildContext(as_of=end, window_start=start, source_set_hash=source_set_hash(inputs), validation_date=today or dt.date.today(), thresholds=thresholds)
        store.log(run_id, "running", build_id=ctx.build_id)
        spark = store.spark
        pinned = spark.createDataFrame([(ctx.build_id, *i) for i in inputs], "build_id string, snapshot_date date, ingest_run_id string, raw_sha256 string")
        tables = Tables(build_inputs=pinned, ingestion_log=source(store, "ingestion_log", inputs), snapshot_state=store.snapshot_table())
        marts, daily = registry.ordered(), Daily(store, ctx, inputs, fresh)
        read_daily = {n for m in marts if m.daily for n in m.needs}
        for m in marts:
            began = time.monotonic()
            if m.daily:
                tables[m.name] = daily.build(m, tables)
            else:
                tables[m.name] = store.write(m.build(ctx, tables), "builds", ctx.build_id, m.name)
                if m.name in read_daily:
                    daily.note(m, tables[m.name])
            print(f"{m.name}: {time.monotonic() - began:.1f} s" + (f", {len(daily.computed[m.name])} dates" if m.daily else ""), flush=True)
            if m.name == fail_after:
                raise RuntimeError(f"stopped after {m.name}")
        tables["quality_checks"] = store.write(gates.quality_checks(ctx, tables).coalesce(1), "builds", ctx.build_id, "quality_checks")
        store.write(tables["build_inputs"].coalesce(1), "builds", ctx.build_id, "build_inputs")
        odd = gates.missing_or_unknown(tables["quality_checks"])
        failed = [r["test_name"] for r in tables["quality_checks"].filter("severity = 'high' AND failed_rows > 0").collect()]
        faults = lineage_faults(ctx, tables)
        if odd or failed or faults:
            raise ValidationError(f"not published: {sorted(odd)} {failed} {faults}")
        store.publish(ctx.build_id, daily.places, as_of=end, window_start=start, source_set_hash=ctx.source_set_hash, schema_version=SCHEMA_VERSION)
        store.log(run_id, "success")
        return ctx
    except BaseException as error:
        store.log(run_id, "failed", details=str(error)[:500])
        raise


def published(store: Warehouse, today: dt.date | None = None) -> tuple[BuildContext, Tables]:
    """The published build's context and tables."""
    state = store.published
    if not state:
        raise ValidationError("nothing is published")
    if state["schema_version"] != SCHEMA_VERSION:
        raise ValidationError(f"built with schema {state['schema_version']}, read with {SCHEMA_VERSION}")
    ctx = BuildContext(as_of=dt.date.fromisoformat(state["as_of"]), window_start=dt.date.fromisoformat(state["window_start"]), build_id=state["build_id"], source_set_hash=state["source_set_hash"], validation_date=today)
    return ctx, store.build_tables(state["build_id"])
