"""Versioned storage: tables in folders of their run or build, and a log of commits that names them.

A folder is complete before a commit names it, so a failed run leaves the previous state as it was. The log is described
in commits.py; all files go through Hadoop's file systems, so the root may be a local folder, HDFS or an object store.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gondola.plans.commits import CommitLog, ConflictError, State, now
from gondola.plans.registry import Tables


def replace_json(path: Path, value: object) -> None:
    """Whole file or nothing."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(path.suffix + ".part")
    with part.open("w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1, default=str)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def read_manifest(path: Path) -> list[dict]:
    """JSON lines; blank ones are skipped."""
    return [json.loads(x) for x in path.read_text(encoding="utf-8").splitlines() if x.strip()] if path.exists() else []


def write_manifest(path: Path, rows: list[dict]) -> None:
    part = path.with_suffix(path.suffix + ".part")
    path.parent.mkdir(parents=True, exist_ok=True)
    with part.open("w", encoding="utf-8") as f:
        f.writelines(json.dumps(r, ensure_ascii=False, sort_keys=True, default=str) + "\n" for r in rows)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


class Warehouse:
    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, str(root).rstrip("/")
        self.commits = CommitLog(spark, self.place("commits"))

    # files

    def place(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _file(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.place(*parts))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    # tables

    def write(self, df: DataFrame, *place: str, by: list[str] | None = None) -> DataFrame:
        path = self.place(*place)
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*(by or [])).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *place: str) -> None:
        fs, path = self._file(*place)
        fs.delete(path, True)

    def read(self, *place: str) -> DataFrame:
        return self.spark.read.parquet(self.place(*place))

    # runs: the latest event of a run counts

    def log(self, run_id: str, status: str, **more: object) -> None:
        self.commits.commit([{"do": "run", "run_id": run_id, "status": status, "at": now(), **more}])

    def runs(self) -> dict[str, dict]:
        return self.commits.state().runs

    def start(self, stage: str, **more: object) -> str:
        """Marks runs of this stage that never ended as interrupted, and starts one."""
        for run_id, run in self.runs().items():
            if run["status"] == "running" and run.get("stage") == stage:
                self.log(run_id, "interrupted")
        run_id = str(uuid.uuid4())
        self.log(run_id, "running", stage=stage, **more)
        return run_id

    def runs_table(self) -> DataFrame:
        rows = [(k, r.get("stage"), r.get("snapshot_date"), r.get("build_id"), r["status"], r["started_at"], r["at"], r.get("details")) for k, r in self.runs().items()]
        return self.spark.createDataFrame(rows, "run_id string, stage string, snapshot_date string, build_id string, status string, started_at string, finished_at string, details string")

    # pointers

    @property
    def snapshots(self) -> dict[str, dict]:
        return self.commits.state().snapshots

    def activate(self, date: str, instead_of: str | None = None, **state: object) -> None:
        """Makes a run the date's active one. instead_of: the run that was active when this one began (none: no run was);
        if it no longer is, another writer has loaded the date, and this one must not hide it."""

        def unchanged(seen: State) -> None:
            active = (seen.snapshots.get(date) or {}).get("run_id")
            if active != instead_of:
                raise ConflictError(f"{date} was loaded by another run meanwhile: {active}")

        self.commits.commit([{"do": "activate", "date": date, **state, "activated_at": now()}], unchanged)

    @property
    def published(self) -> dict | None:
        return self.commits.state().published

    def publish(self, build_id: str, partitions: dict[str, dict], **state: object) -> None:
        """partitions: where the daily marts of the build are."""
        self.commits.commit([{"do": "build", "build_id": build_id, "partitions": partitions}, {"do": "publish", "build_id": build_id, **state, "published_at": now()}])

    def published_table(self) -> DataFrame:
        """One row: the published build; none if nothing is published."""
        names = ("build_id", "as_of", "window_start", "source_set_hash", "schema_version", "published_at")
        rows = [tuple(self.published.get(n) for n in names)] if self.published else []
        return self.spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))

    def snapshot_table(self) -> DataFrame:
        schema = T.StructType([T.StructField("snapshot_date", T.DateType()), *(T.StructField(c, T.StringType()) for c in ("active_ingest_run_id", "raw_sha256", "source_path"))])
        return self.spark.createDataFrame([(dt.date.fromisoformat(d), s["run_id"], s["sha256"], s.get("path")) for d, s in self.snapshots.items()], schema)

    # daily marts: partitions that builds share

    def stored(self, keys: Iterable[str]) -> dict[str, str]:
        """Folders of the partitions that are there, of those with these keys."""
        have = self.commits.state().partitions
        return {k: have[k] for k in keys if k in have}

    def write_daily(self, rows: DataFrame, mart: str, build_id: str, keys: list[str]) -> None:
        """Stores dates of a mart, without the build's id, in a folder of this writer's own; they count from the commit on."""
        folder, kept = f"daily/{mart}/{build_id}", rows.drop("build_id")
        kept.write.mode("overwrite").option("compression", "zstd").partitionBy("snapshot_date").parquet(self.place(folder))
        self.commits.commit([{"do": "partition", "mart": mart, "keys": keys, "folder": folder, "columns": rows.columns, "schema": kept.schema.json()}])

    def layout(self, mart: str) -> dict:
        return self.commits.state().marts[mart]

    def read_daily(self, build_id: str, columns: list[str], schema: str, dates: dict[str, str]) -> DataFrame:
        """A daily mart from the folders that hold its dates, with the build's id where the mart has it."""
        kind, by_folder, out = T.StructType.fromJson(json.loads(schema)), {}, None
        for date, folder in dates.items():
            by_folder.setdefault(folder, []).append(dt.date.fromisoformat(date))
        for folder, own in sorted(by_folder.items()):
            rows = self.spark.read.schema(kind).parquet(self.place(folder)).filter(F.col("snapshot_date").isin(own))
            out = rows if out is None else out.unionByName(rows)
        return out.withColumn("build_id", F.lit(build_id)).select(columns)

    def build_tables(self, build_id: str) -> Tables:
        fs, folder = self._file("builds", build_id)
        names = sorted(x.getPath().getName() for x in fs.listStatus(folder) if x.isDirectory())
        daily = self.commits.state().builds.get(build_id, {}).get("partitions", {})
        return Tables({name: self.read("builds", build_id, name) for name in names} | {name: self.read_daily(build_id, **at) for name, at in daily.items()})
