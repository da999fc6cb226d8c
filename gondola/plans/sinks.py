"""Writing what consumers read: small tables as CSV and Parquet, large ones as Parquet, a summary, a workbook."""

from __future__ import annotations

import io
import json
import math
import shutil
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gondola.plans import dashboard, exports
from gondola.plans.context import BuildContext
from gondola.plans.registry import Tables
from gondola.plans.validate import Result, checked
from gondola.plans.warehouse import now, replace_json


def small_csv(df: DataFrame, *folders: Path) -> pd.DataFrame:
    """A summary table as CSV with a byte-order mark, in each folder, and as Parquet in the first."""
    frame = df.toPandas()  # rows for dates, banners and provinces, or a sample with a limit
    for folder in folders:
        folder.mkdir(parents=True, exist_ok=True)
    return frame


def cell(value: object) -> object:
    """What may stand in a workbook: no missing numbers, no formulas, no time zones."""
    if value is None or isinstance(value, float) and math.isnan(value) or value is pd.NaT:
        return None
    if isinstance(value, pd.Timestamp) and value.tzinfo:
        return value.tz_localize(None)
    if isinstance(value, str) and value[:1] in ("=", "+", "-", "@"):
        return "'" + value
    return value if isinstance(value, (str, int, float, bool)) else str(value)


def workbook(path: Path, sheets: dict[str, pd.DataFrame]) -> None:
    """A plain workbook: header row frozen and filtered, widths of at most 45."""
    names = list(sheets)
    column = lambda k: (chr(64 + k // 26) if k >= 26 else "") + chr(65 + k % 26)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        for k, name in enumerate(names, 1):
            frame, out = sheets[name], io.StringIO()
            rows = [list(frame.columns), *frame.itertuples(index=False)]
            wide = [min(45, 2 + max(len(str(v)) for v in [c, *frame[c].head(200)])) for c in frame.columns]
            out.write('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>')
            out.write("".join(f'<col min="{c}" max="{c}" width="{w}" customWidth="1"/>' for c, w in enumerate(wide, 1)) + "</cols><sheetData>")
            for r, row in enumerate(rows, 1):
                out.write(f'<row r="{r}">')
                for c, value in enumerate(map(cell, row)):
                    if value is None:
                        continue
                    if isinstance(value, bool):
                        out.write(f'<c r="{column(c)}{r}" t="b"><v>{int(value)}</v></c>')
                    elif isinstance(value, (int, float)):
                        out.write(f'<c r="{column(c)}{r}"><v>{value}</v></c>')
                    else:
                        out.write(f'<c r="{column(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>')
                out.write("</row>")
            out.write(f'</sheetData><autoFilter ref="A1:{column(max(0, len(frame.columns) - 1))}{len(rows)}"/></worksheet>')
            z.writestr(f"xl/worksheets/sheet{k}.xml", out.getvalue())


def notice(label: str, date: object, as_of: object) -> str:
    """Says so when a table's last usable date isn't the build's."""
    if date is None:
        return f"{label}: no publishable date."
    return f"{label}: {date}." if date == as_of else f"{label}: last publishable date {date}, build of {as_of}."


def summary(ctx: BuildContext, result: Result, frames: dict[str, pd.DataFrame]) -> str:
    """A page of findings, each from the last date that may be published."""
    lines = [f"# Price summary {ctx.as_of}", "", f"Build `{ctx.build_id}`, confidence **{result.grade}**.", ""]
    index = frames["index_daily"]
    index = index[index.publishable.astype(bool)] if len(index) else index
    if len(index):
        last = index[index.snapshot_date == index.snapshot_date.max()].sort_values("price_index")
        low, high = last.iloc[0], last.iloc[-1]
        lines.append(f"- Index on {low.snapshot_date}: lowest {low.banner_label} ({low.price_index:.1f}), highest {high.banner_label} ({high.price_index:.1f}).")
    else:
        lines.append("- " + notice("Index", None, ctx.as_of))
    savings = frames["basket_savings"]
    for level in ("BANNER", "PROVINCE"):
        rows = savings[savings.comparison_level == level]
        if len(rows):
            row = rows.sort_values("snapshot_date").iloc[-1]
            lines.append(f"- Basket, {level.lower()}s on {row.snapshot_date}: saving {float(row.potential_saving_amount):.2f} ({float(row.potential_saving_pct):.1f} %).")
    sensitivity = frames["index_sensitivity"]
    widest = sensitivity.sensitivity_delta.max() if len(sensitivity) else float("nan")
    lines.append(f"- Largest effect of extreme products on an index: {widest:.2f} points." if widest == widest else "- No sensitivity to report.")
    lines.append(f"- Unhealthy days: {int((~frames['source_health'].source_healthy.astype(bool)).sum())}.")
    return "\n".join(lines) + "\n"


# Names under which earlier versions wrote tables.
LEGACY = ("basket_summary", "dispersion_product", "ingestion_log", "price_anomalies", "price_dispersion", "price_index_banner", "product_candidates")


def remove_stale(out: Path, folders: list[Path]) -> None:
    """Removes tables that an earlier export wrote, by its metadata or by name, and this one doesn't. Other files stay."""
    before = read_json(out / "run_metadata.json", {})
    for name in {*LEGACY, *before.get("rows", {}), *before.get("extracts", [])} - {*exports.VIEWS, *exports.EXTRACTS}:
        for folder in folders:
            (folder / f"{name}.csv").unlink(missing_ok=True)
        old = out / "parquet" / name
        if old.is_dir():
            shutil.rmtree(old)
        old.with_name(f"{name}.parquet").unlink(missing_ok=True)


def read_json(path: Path, default: dict) -> dict:
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else default


def read_exports(spark: SparkSession, folder: str, t: Tables, ctx: BuildContext) -> Tables:
    """The exported CSV files with the types of their views: nothing is inferred, so codes keep their zeros."""
    return Tables({name: typed_csv(spark, f"{folder}/{name}.csv", view(ctx, t).schema) for name, view in exports.VIEWS.items()})


def typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file of ours (byte-order mark, header, dates yyyy-MM-dd, points as decimal marks) in these types.

    Floats stand for whole numbers where a column had nulls; True and False for booleans."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    rows = spark.read.schema(text).csv(path, header=True, enforceSchema=False, quote='"', escape='"', multiLine=True, encoding="UTF-8", mode="FAILFAST")

    def typed(f: T.StructField):
        value = F.nullif(F.col(f"`{f.name}`"), F.lit(""))
        if isinstance(f.dataType, T.StringType):
            return value.alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            return value.cast("decimal(38,4)").cast(f.dataType).alias(f.name)
        return value.cast(f.dataType).alias(f.name)

    return rows.select(*map(typed, schema.fields))


def export_all(ctx: BuildContext, t: Tables, out: Path, portfolio: Path | None = None, today=None) -> Result:
    """Validates first: nothing is written if the build may not be used. The metadata is written last."""
    reports = out / "reports"
    reports.mkdir(parents=True, exist_ok=True)
    result = checked(ctx, t, lambda text: (reports / "validation_report.md").write_text(text, encoding="utf-8"), today)
    folders = [out / "csv", *([portfolio] if portfolio else [])]
    frames: dict[str, pd.DataFrame] = {}
    remove_stale(out, folders)
    for name, view in exports.VIEWS.items():
        frames[name] = small_csv(view(ctx, t), *folders, out / "parquet")
        for folder in folders:
            frames[name].to_csv(folder / f"{name}.csv", index=False, encoding="utf-8-sig")
        frames[name].to_parquet(out / "parquet" / f"{name}.parquet")
    for name, mart in exports.EXTRACTS.items():
        t[mart].write.mode("overwrite").option("compression", "zstd").parquet(str(out / "parquet" / name))
    dashboard.write(ctx, frames, out / "dashboard.html")
    readme = pd.DataFrame([("build", ctx.build_id), ("as of", str(ctx.as_of)), ("confidence", result.grade)], columns=["item", "value"])
    workbook(out / "summary.xlsx", {"README": readme, **{k: v for k, v in list(frames.items())[:16]}})
    (reports / "summary.md").write_text(summary(ctx, result, frames), encoding="utf-8")
    replace_json(out / "run_metadata.json", {"build_id": ctx.build_id, "as_of": ctx.as_of, "window_start": ctx.window_start, "source_set_hash": ctx.source_set_hash, "grade": result.grade, "rows": {k: len(v) for k, v in frames.items()}, "extracts": list(exports.EXTRACTS), "written_at": now()})
    return result
