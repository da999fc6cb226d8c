"""Command line: python -m gondola.cli download|ingest|build|export|validate|all"""

from __future__ import annotations

import argparse
import datetime as dt
import os
from pathlib import Path

from gondola.plans import build as building
from gondola.plans import sinks, validate
from gondola.plans.warehouse import Warehouse
from gondola.session import session
from gondola.sources import download as downloads
from gondola.sources import snapshots

STAGES = ("download", "ingest", "build", "export", "validate", "all")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gondola", description=__doc__)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--force", action="store_true", help="replace a loaded date")
    p.add_argument("--as-of", type=dt.date.fromisoformat)
    p.add_argument("--only-snapshot", metavar="DATE")
    p.add_argument("--root", type=Path, default=Path(os.environ.get("GONDOLA_ROOT", "data")))
    return p


def download(args: argparse.Namespace) -> None:
    for day, path in downloads.download(args.root / "raw", args.root / "manifests" / "raw_sources.jsonl", dt.date.today()).items():
        print(f"{day}: {path}")


def ingest(args: argparse.Namespace, store: Warehouse) -> None:
    as_of = args.as_of.isoformat() if args.as_of else None
    for date, path in snapshots.discover(args.root / "raw", as_of, args.only_snapshot).items():
        snapshots.load(store, path, date, args.force)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.stage == "download":
        download(args)
        return 0
    store = Warehouse(session(), args.root / "warehouse")
    if args.stage in ("ingest", "all"):
        ingest(args, store)
    if args.stage in ("build", "all"):
        building.build(store, args.as_of)
    if args.stage in ("export", "all"):  # validates before it writes anything
        ctx, tables = building.published(store)
        sinks.export_all(ctx, tables, args.root / "exports", args.root / "portfolio")
    if args.stage == "validate":
        ctx, tables = building.published(store)
        result = validate.checked(ctx, tables, print)
        print(result.grade)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
