"""Nested-ZIP snapshots as a Spark data source, typed loaders, and the load of one date.

Reading has two steps. Python only unpacks: `spark.read.format("gondola_snapshot")` (an input partition for each inner
package of an outer archive whose path every executor can read) or `from_packages` (packages as rows of a table, from
any store) open each package once and stream its files as clean blocks of whole records, with what was counted on the way;
what breaks the contract is a row that says so. The rest is the JVM's: `records` splits the blocks and hands their lines
to Spark's CSV parser, strictly (FAILFAST), so one large file is parsed by as many tasks as it has blocks.

A load stages the blocks and observes, in the writes themselves, how many records went out and how many rows came in.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import os
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path, PurePosixPath
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gondola.functions import codes, units
from gondola.functions.text import blank_to_null, folded_upper, number
from gondola.plans.warehouse import Warehouse
from gondola.sources.contract import COLUMNS, QUOTE, SEPARATOR, ContractError, Sanitizer

FORMAT = "gondola_snapshot"
#: Packages that may be of zero bytes.
EMPTY_ALLOWED = r"comercio-sepa-36_"
MEMBERS = {"comercio.csv": "commerce_snapshot", "sucursales.csv": "store_snapshot", "productos.csv": "fact_price"}


@dataclass(frozen=True)
class Limits:
    """What an archive may unpack to; from_environment() reads MAX_ZIP_MEMBER_COUNT, MAX_ZIP_MEMBER_BYTES,
    MAX_ZIP_TOTAL_BYTES and MAX_ZIP_COMPRESSION_RATIO."""

    members: int = 10_000
    member_bytes: int = 4 << 30
    total_bytes: int = 32 << 30
    ratio: float = 200.0

    @classmethod
    def from_environment(cls) -> Limits:
        names = {"members": "MAX_ZIP_MEMBER_COUNT", "member_bytes": "MAX_ZIP_MEMBER_BYTES", "total_bytes": "MAX_ZIP_TOTAL_BYTES", "ratio": "MAX_ZIP_COMPRESSION_RATIO"}
        return cls(**{k: type(getattr(cls, k))(os.environ[n]) for k, n in names.items() if n in os.environ})


def check_archive(archive: zipfile.ZipFile, limits: Limits) -> None:
    infos = archive.infolist()
    if len(infos) > limits.members:
        raise ContractError(f"{len(infos)} members")
    if any(i.file_size > limits.member_bytes for i in infos):
        raise ContractError("a member is too large")
    if sum(i.file_size for i in infos) > limits.total_bytes:
        raise ContractError("the archive is too large")
    for i in infos:
        if i.file_size and i.file_size > limits.ratio * max(1, i.compress_size):
            raise ContractError(f"{i.filename}: suspicious compression ratio")


def packages(archive: zipfile.ZipFile, date: str) -> list[zipfile.ZipInfo]:
    """Inner packages by name; all lie in the date's folder, each once."""
    found = sorted((i for i in archive.infolist() if i.filename.lower().endswith(".zip")), key=lambda i: i.filename)
    if not found:
        raise ContractError("no packages")
    if any(PurePosixPath(i.filename).parts[0] != date for i in found):
        raise ContractError(f"packages outside of {date}")
    names = [PurePosixPath(i.filename).name for i in found]
    if len(set(names)) < len(names):
        raise ContractError("repeated packages")
    return found


def member(package: zipfile.ZipFile, name: str) -> zipfile.ZipInfo:
    """The one member of this name, whatever its folder and case."""
    found = [i for i in package.infolist() if PurePosixPath(i.filename).name.lower() == name]
    if len(found) != 1:
        raise ContractError(f"{name}: {'missing' if not found else 'more than one'}")
    return found[0]


@dataclass
class PackagePartition(InputPartition):
    path: str
    package: str
    size: int


#: A block of a file, with what its cleaning counted; fault says what breaks the contract, file_name is null for a whole package.
STAGED = "source_package string, file_name string, block long, records long, footer_rows long, null_bytes_removed long, reconstructed_lines long, fault string, text binary"
_STAGED = pa.schema([("source_package", pa.string()), ("file_name", pa.string()), *((c, pa.int64()) for c in ("block", "records", "footer_rows", "null_bytes_removed", "reconstructed_lines")), ("fault", pa.string()), ("text", pa.binary())])


def _row(*values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _STAGED)], schema=_STAGED)


def unpacked(package: str, source: Callable[[], BinaryIO], names: list[str], limits: Limits) -> Iterator[pa.RecordBatch]:
    """The blocks of a package's files, one row a batch; its compressed bytes are read once."""
    try:
        inner = zipfile.ZipFile(source())
        check_archive(inner, limits)
    except (ContractError, zipfile.BadZipFile) as error:
        yield _row(package, None, -1, 0, 0, 0, 0, str(error), None)
        return
    with inner:
        for name in names:
            cleaner, block, before = Sanitizer(COLUMNS[name]), 0, (0, 0, 0)
            counted = lambda: (cleaner.metrics.footer_rows, cleaner.metrics.null_bytes_removed, cleaner.metrics.reconstructed_lines)  # noqa: B023, E731
            try:
                with inner.open(member(inner, name)) as file:
                    for rows, text in cleaner.blocks(file):
                        now = counted()
                        yield _row(package, name, block, rows, *(b - a for a, b in zip(before, now)), None, text)
                        block, before = block + 1, now
                if counted() != before:  # a notice or null bytes after the last block
                    yield _row(package, name, block, 0, *(b - a for a, b in zip(before, counted())), None, None)
            except (ContractError, zipfile.BadZipFile) as error:
                yield _row(package, name, -1, 0, 0, 0, 0, str(error), None)


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.date, self.names = options["path"], options["date"], options["files"].split(",")
        self.limits = Limits(*(type(d)(options.get(k.replace("_", ""), d)) for k, d in vars(Limits()).items()))
        self.empty = options.get("emptyallowed", EMPTY_ALLOWED)

    def partitions(self) -> list[PackagePartition]:
        with zipfile.ZipFile(self.path) as outer:
            check_archive(outer, self.limits)
            out = []
            for info in packages(outer, self.date):
                if info.file_size == 0 and re.search(self.empty, info.filename):
                    continue
                out.append(PackagePartition(self.path, info.filename, info.file_size))
            return out

    def read(self, partition: PackagePartition):
        def source() -> BinaryIO:
            with zipfile.ZipFile(partition.path) as outer:
                return io.BytesIO(outer.read(partition.package))

        yield from unpacked(PurePosixPath(partition.package).name, source, self.names, self.limits)


class SnapshotSource(DataSource):
    """Options: path (of the outer archive), date, files (names, comma-joined), and the limits' names."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return STAGED

    def reader(self, schema: T.StructType) -> SnapshotReader:
        return SnapshotReader(dict(self.options))


def staged(spark: SparkSession, path: str, date: str, names: Iterable[str] = tuple(MEMBERS), **options: object) -> DataFrame:
    """Blocks of an archive's files."""
    spark.dataSource.register(SnapshotSource)
    return spark.read.format(FORMAT).options(date=date, files=",".join(names), **{k.replace("_", ""): str(v) for k, v in options.items()}).load(path)


def from_packages(rows: DataFrame, names: Iterable[str] = tuple(MEMBERS), limits: Limits = Limits()) -> DataFrame:
    """Blocks of the files of packages that are rows: source_package, content (the ZIP's bytes; of a binaryFile scan, for instance)."""
    names = list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from unpacked(package, lambda: io.BytesIO(content.as_buffer()), names, limits)  # noqa: B023

    return rows.select("source_package", "content").mapInArrow(run, STAGED)


#: A record whose quotes are closed and doubled within quoted fields; a quote within an unquoted field is a letter as any other.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^"|\r][^|\r]*+|)'
STRICT = rf"\A{_FIELD}(?:\|{_FIELD})*+\z"


def records(blocks: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """source_package and the columns of a file, all as text. Faults, quotes left open, other numbers of fields than columns
    and bytes that are no UTF-8 are errors."""
    columns = COLUMNS[name] if columns is None else columns
    rows = blocks.filter((F.col("file_name") == name) | F.col("file_name").isNull())
    said = F.concat_ws(": ", "source_package", F.coalesce("file_name", F.lit("package")), "fault")
    rows = rows.select("source_package", F.when(F.col("fault").isNotNull(), F.raise_error(said).cast("string")).otherwise(F.validate_utf8(F.col("text").cast("string"))).alias("text"))
    lines = rows.filter(F.col("text").isNotNull()).select("source_package", F.explode(F.split("text", "\n")).alias("line"))
    odd = (F.contains("line", F.lit(QUOTE)) | F.contains("line", F.lit("\r"))) & ~F.col("line").rlike(STRICT)
    line = F.when(odd, F.raise_error(F.concat(F.lit("record that can't be read: "), "source_package", F.lit("/" + name))).cast("string")).otherwise(F.col("line"))
    kind = ", ".join(f"`{c}` string" for c in columns)
    parsed = lines.select("source_package", F.from_csv(line, kind, {"sep": SEPARATOR, "quote": QUOTE, "escape": QUOTE, "mode": "FAILFAST", "maxCharsPerColumn": "-1"}).alias("parsed"))
    return parsed.select("source_package", *[F.coalesce(F.col("parsed")[c], F.lit("")).alias(c) for c in columns])


def scan(spark: SparkSession, path: str, date: str, name: str, **options: object) -> DataFrame:
    """The records of one file of all packages of an archive."""
    return records(staged(spark, path, date, [name], **options), name)


# Typing: structure is strict, values are tolerant ----------------------------------------------------------------------


def _tagged(run_id: str, date: str) -> list[Column]:
    return [F.lit(run_id).alias("ingest_run_id"), F.lit(dt.date.fromisoformat(date)).alias("snapshot_date"), F.col("source_package")]


def text(column: str, name: str | None = None) -> Column:
    return blank_to_null(F.col(column)).alias(name or column)


def commerce(rows: DataFrame, run_id: str, date: str) -> DataFrame:
    when = F.nullif(F.trim("comercio_ultima_actualizacion"), F.lit("")).try_cast("timestamp").alias("comercio_ultima_actualizacion")
    return rows.select(*_tagged(run_id, date), *[when if c == "comercio_ultima_actualizacion" else text(c) for c in COLUMNS["comercio.csv"]])


def stores(rows: DataFrame, run_id: str, date: str) -> DataFrame:
    latitude, longitude = number(F.col("sucursales_latitud")), number(F.col("sucursales_longitud"))
    inside = F.coalesce(latitude.between(-90, 90) & longitude.between(-180, 180), F.lit(False))
    days = [c for c in COLUMNS["sucursales.csv"] if c.endswith("_horario_atencion")]
    plain = ["calle", "numero", "observaciones", "barrio", "codigo_postal", "localidad"]
    return rows.select(
        *_tagged(run_id, date), text("id_comercio"), text("id_bandera"), text("id_sucursal"), text("sucursales_nombre", "sucursal_nombre"), text("sucursales_tipo", "sucursal_tipo"),
        *[text(f"sucursales_{c}", c) for c in plain], latitude.alias("latitud"), longitude.alias("longitud"), text("sucursales_provincia", "provincia_codigo"),
        *[text(c, c.removeprefix("sucursales_").removesuffix("_atencion")) for c in days], inside.alias("coordenadas_validas"),
    )


def prices(rows: DataFrame, run_id: str, date: str) -> DataFrame:
    money = lambda c, name: number(F.col(c), "decimal(18,4)").alias(name)
    rows = rows.withColumns({"is_ean": F.coalesce(codes.is_yes(F.col("productos_ean")), F.lit(False)), "gtin14": codes.normalize_gtin14(F.col("id_producto"), F.col("productos_ean")), "list_price": number(F.col("productos_precio_lista"), "decimal(18,4)")})
    rows = rows.withColumn("gtin_valido", codes.is_valid_gtin14(F.col("gtin14")))
    return rows.select(
        *_tagged(run_id, date), text("id_comercio"), text("id_bandera"), text("id_sucursal"), text("id_producto"), F.col("is_ean").alias("productos_ean"), "gtin14", "gtin_valido",
        codes.classify(F.col("id_producto"), F.col("is_ean"), F.col("gtin_valido")).alias("product_code_scope"), text("productos_descripcion", "producto_descripcion"),
        folded_upper(blank_to_null(F.col("productos_descripcion"))).alias("producto_descripcion_normalizada"), number(F.col("productos_cantidad_presentacion")).alias("cantidad_presentacion"),
        units.normalize_unit(F.col("productos_unidad_medida_presentacion")).alias("unidad_presentacion"), text("productos_marca", "marca"), F.col("list_price").alias("precio_lista"),
        money("productos_precio_referencia", "precio_referencia"), number(F.col("productos_cantidad_referencia")).alias("cantidad_referencia"), units.normalize_unit(F.col("productos_unidad_medida_referencia")).alias("unidad_referencia"),
        money("productos_precio_unitario_promo1", "precio_promo_general"), text("productos_leyenda_promo1", "leyenda_promo_general"), money("productos_precio_unitario_promo2", "precio_promo_segmentada"), text("productos_leyenda_promo2", "leyenda_promo_segmentada"),
        F.coalesce(F.col("list_price") > 0, F.lit(False)).alias("precio_lista_valido"),
    )


LOADERS = {"comercio.csv": commerce, "sucursales.csv": stores, "productos.csv": prices}
LOG = "ingest_run_id string, snapshot_date date, source_package string, file_name string, source_rows long, loaded_rows long, footer_rows long, null_bytes_removed long, reconstructed_lines long, status string"


def reconciled(blocks: DataFrame, tables: dict[str, DataFrame], run_id: str, date: str) -> DataFrame:
    """The ingestion log: for each package and file what the cleaning counted, and the rows its table has. tables: by file name."""
    counts = [F.sum(c).alias(n) for c, n in (("records", "source_rows"), ("footer_rows", "footer_rows"), ("null_bytes_removed", "null_bytes_removed"), ("reconstructed_lines", "reconstructed_lines"))]
    source = blocks.filter("fault IS NULL").groupBy("source_package", "file_name").agg(*counts)
    have = None
    for name, rows in tables.items():
        n = rows.groupBy("source_package").agg(F.count(F.lit(1)).alias("loaded_rows")).withColumn("file_name", F.lit(name))
        have = n if have is None else have.unionByName(n)
    joined = source.join(have, ["source_package", "file_name"], "full_outer")
    none = F.lit(0).cast("long")
    return joined.select(
        F.lit(run_id).alias("ingest_run_id"), F.lit(dt.date.fromisoformat(date)).alias("snapshot_date"), "source_package", "file_name", F.coalesce("source_rows", none).alias("source_rows"),
        F.coalesce("loaded_rows", none).alias("loaded_rows"), "footer_rows", "null_bytes_removed", "reconstructed_lines", F.lit("success").alias("status"),
    )


def load_tables(blocks: DataFrame, write: Callable[[DataFrame, str], DataFrame], run_id: str, date: str) -> DataFrame:
    """Writes the typed tables of staged blocks; returns the ingestion log.

    blocks is handed on by write() first, with the records of each file observed in that write; each table's write
    observes its rows. A table that has more or fewer rows than records is an error, whatever lost them."""
    out = Observation()
    sums = [F.sum(F.when(F.col("file_name") == name, F.col("records")).otherwise(0)).alias(name) for name in MEMBERS]
    blocks = write(blocks.observe(out, F.count("fault").alias("faults"), *sums), "staging")
    if out.get["faults"]:
        first = blocks.filter("fault IS NOT NULL").orderBy("source_package", "file_name").limit(20).collect()
        raise ContractError("; ".join(f"{r.source_package}/{r.file_name or ''}: {r.fault}" for r in first))
    tables = {}
    for name, table in MEMBERS.items():
        into = Observation()
        tables[name] = write(LOADERS[name](records(blocks, name), run_id, date).observe(into, F.count(F.lit(1)).alias("rows")), table)
        if into.get["rows"] != (out.get[name] or 0):
            raise ContractError(f"{name}: {out.get[name]} records, {into.get['rows']} loaded")
    log = write(reconciled(blocks, tables, run_id, date), "ingestion_log")
    for r in log.filter("source_rows <> loaded_rows").limit(1).collect():
        raise ContractError(f"{r.source_package}/{r.file_name}: {r.source_rows} records, {r.loaded_rows} loaded")
    return log


def sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def load(store: Warehouse, path: str, date: str, force: bool = False, limits: Limits | None = None) -> str:
    """Loads one date's archive and activates it last; returns the run id. The same file again is no work."""
    limits = limits or Limits.from_environment()
    digest, active = sha256(path), store.snapshots.get(date)
    if active and active["sha256"] == digest and not force:
        return active["run_id"]
    if active and active["sha256"] != digest and not force:
        raise ContractError(f"{date} is loaded from another file; force replaces it")
    run_id, spark = store.start("ingest", snapshot_date=date), store.spark
    try:
        with zipfile.ZipFile(path) as outer:
            check_archive(outer, limits)
            if outer.testzip():
                raise ContractError("damaged archive")
            found = packages(outer, date)
        empty = [p for p in found if p.file_size == 0]
        for p in empty:
            if not re.search(EMPTY_ALLOWED, p.filename):
                raise ContractError(f"{p.filename}: empty")
        gone = [(run_id, dt.date.fromisoformat(date), PurePosixPath(p.filename).name, "", 0, 0, 0, 0, 0, "source_empty") for p in empty]

        def write(rows: DataFrame, name: str) -> DataFrame:
            if name == "ingestion_log":
                rows = rows.unionByName(spark.createDataFrame(gone, LOG))
            return store.write(rows, "sources", run_id, name, by=["file_name"] if name == "staging" else [])

        load_tables(staged(spark, path, date, **vars(limits)), write, run_id, date)
        store.drop("sources", run_id, "staging")
        store.activate(date, active and active["run_id"], run_id=run_id, sha256=digest, path=str(path), packages=len(found))
        store.log(run_id, "success")
        return run_id
    except BaseException as error:
        store.log(run_id, "failed", details=str(error)[:500])
        raise


def discover(raw: str | Path, as_of: str | None = None, only: str | None = None) -> dict[str, str]:
    """Archives by date: one for each dated folder."""
    found: dict[str, str] = {}
    for path in sorted(Path(raw).glob("20??-??-??/sepa_*.zip")):
        date = path.parent.name
        if date in found:
            raise ContractError(f"{date}: more than one archive")
        if (as_of is None or date <= as_of) and (only is None or date == only):
            found[date] = str(path)
    if not found:
        raise ContractError("no snapshot matches")
    return found
