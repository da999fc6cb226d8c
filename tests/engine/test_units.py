import datetime as dt
import io
import random
import zipfile

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gondola.functions import codes, stats, text, units
from gondola.functions.selection import quantiles_by
from gondola.operators import sketches
from gondola.plans import sinks, validate
from gondola.plans.context import resolve_window
from gondola.sources import download, snapshots
from gondola.sources.contract import ContractError, Sanitizer, is_notice


@pytest.mark.parametrize("code,valid", [("96385074", True), ("036000291452", True), ("4006381333931", True), ("10012345000017", True), ("96385075", False), ("036000291453", False), ("4006381333932", False), ("10012345000018", False)])
def test_check_digit(spark, code, valid):
    codes.register(spark)
    row = spark.createDataFrame([(code,)], "c string").select(codes.normalize_gtin14(F.col("c"), F.lit("Si")).alias("g")).select("g", codes.is_valid_gtin14(F.col("g")).alias("v"), F.expr("is_valid_gtin14(normalize_gtin14(ltrim('0', g), '1'))").alias("w")).first()
    assert row.g == code.rjust(14, "0") and row.v is valid


@pytest.mark.parametrize("code", ["1234567", "123456789", "12345678901", "123456789012345", "ABC", "96385074\n"])
def test_no_code(spark, code):
    assert spark.createDataFrame([(code,)], "c string").select(codes.normalize_gtin14(F.col("c"), F.lit("1"))).first()[0] is None


def test_classes_and_units(spark):
    row = spark.range(1).select(codes.classify(F.lit("20000000"), F.lit(True), F.lit(True)), codes.classify(F.lit("x"), F.lit(None).cast("boolean"), F.lit(True)), codes.is_valid_gtin14(F.lit(None).cast("string")), units.normalize_unit(F.lit(" cm3 ")), units.base_quantity(F.lit(1.5), F.lit("L")), text.number(F.lit("1_000")), text.number(F.lit("1d")), text.number(F.lit(" 12.5 ")), text.folded_upper(F.lit("Ñandú ß º"))).first()
    assert list(row) == ["RESTRICTED_LOCAL", "INTERNAL_LOCAL", False, "ML", 1500.0, None, None, 12.5, "NANDU ẞ º"]


def test_quantiles(spark):
    df = spark.createDataFrame([(80.0,)] * 5 + [(120.0,)] * 5, "x double")
    median, low, high = df.agg(stats.quantiles(F.col("x"), [0.5, 0.1, 0.9]).alias("q")).first().q
    assert (low, median, high, (high - low) / median) == (80, 100, 120, 0.4)
    cut = spark.createDataFrame([("25.0000",), ("25.0001",)], "x string").select(F.col("x").cast("decimal(18,4)").alias("x"))
    assert str(cut.agg(stats.median(F.col("x"), stats.kind(cut, "x"))).first()[0]) == "25.0000"


def test_selection_equals_percentiles(spark):
    rng, rows = random.Random(3), []
    for g, n in (("one", 1), ("two", 2), ("few", 7), ("hot", 4000), (None, 30)):
        rows += [(g, k % 2, rng.choice([0.0, -1.5, 1e-300, -1e300, 7.25]) if rng.random() < 0.1 else rng.lognormvariate(3, 2) * rng.choice((1, 1, -1))) for k in range(n)]
    rows += [("hot", 0, 12.5)] * 3000 + [("none", 0, None)] * 3
    df = spark.createDataFrame(rows, "g string, h int, x double").withColumn("d", F.when(F.abs("x") < 1e9, F.col("x")).cast("decimal(18,4)"))
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    for value in ("x", "d"):
        for keys in (["g"], ["g", "h"]):
            want = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), stats.quantiles(F.col(value), shares, stats.kind(df, value)).alias("quantiles"))
            got = quantiles_by(df, keys, value, shares)
            assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    got = quantiles_by(df, ["g"], "x", [0.5])
    got.collect()
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert quantiles_by(df.limit(0), ["g"], "d", [0.5]).count() == 0


def test_sketches_merge_upward(spark):
    rng = random.Random(1)
    rows = [(f"2026-08-0{d}", "p", f"{b}", "1", f"AR-{c}", float(rng.randrange(100_000))) for d in range(1, 5) for b in range(3) for c in "AB" for _ in range(900)]
    df = spark.createDataFrame(rows, "snapshot_date string, gtin14 string, id_comercio string, id_bandera string, provincia_codigo string, list_price double")
    for r in sketches.of_levels(sketches.daily(df), ["gtin14"]).select("dispersion_level", "id_comercio", "provincia_codigo", sketches.rows().alias("n"), sketches.quantile(0.5).alias("m"), F.length("sketch").alias("bytes")).collect():
        own = [x[5] for x in rows if r.id_comercio in (None, x[2]) and r.provincia_codigo in (None, x[4])]
        assert r.n == len(own) and abs(sum(x < r.m for x in own) / len(own) - 0.5) <= 2 * sketches.rank_error() and r.bytes < 12_000


def run(spark, data: bytes, columns, size=7):
    """The records, in order, by way of blocks of some bytes and Spark's parser; and the metrics."""
    s = Sanitizer(columns)
    blocks = [("p", "f", None, bytearray(b)) for _, b in s.blocks(io.BytesIO(data), size)]
    rows = snapshots.records(spark.createDataFrame(blocks, "source_package string, file_name string, fault string, text binary").coalesce(1), "f", columns)
    return [list(r)[1:] for r in rows.collect()], s.metrics


def test_sanitizer(spark):
    for size in (3, 1 << 20):
        rows, m = run(spark, b"\xef\xbb\xbfid|value\n1|o\0k\n\n2|also_ok\nUltima actualizacion: 2026\n", ["id", "value"], size)
        assert rows == [["1", "ok"], ["2", "also_ok"]] and (m.source_rows, m.footer_rows, m.null_bytes_removed, m.reconstructed_lines) == (2, 1, 1, 0)
        rows, m = run(spark, "a|b|c|d\n1|2\n|3\n|4\n Última  actualización : hoy\n".encode(), list("abcd"), size)
        assert rows == [["1", "2", "3", "4"]] and m.reconstructed_lines == 2
    assert run(spark, b"a|b\n1|2\nactualizacion pendiente|\n", ["a", "b"])[0][1] == ["actualizacion pendiente", ""]
    quoted = b'a|b|c\r\n"x|""y"""|5" pipe|""\r\n"1|2\r\n'
    with pytest.raises(PySparkException, match="can't be read"):
        run(spark, quoted, list("abc"))
    rows, m = run(spark, quoted[:-6] + b'"1|2"\r\n|\xc3\xb1\r\n|\\\r\n', list("abc"))
    assert rows == [['x|"y"', '5" pipe', ""], ["1|2", "ñ", "\\"]] and m.reconstructed_lines == 2
    for bad in (b"b|a\n1|2\n", b"a\n1\n", b"a|b|c\n1|2|3\n", b"a|a\n1|2\n", b"", b"a|b\n"):
        with pytest.raises(ContractError):
            run(spark, bad, ["a", "b"])
    for bad in (b'a|b\n1|"x\n', b"a|b\nUltima actualizacion: x\n1|2\n", b"a|b\n1|2|3\n", b"a|b\n1|\xff\n", b'a|b\n1|"x"y\n', b"a|b\n1|x\ry\n"):
        with pytest.raises((PySparkException, Py4JJavaError)):
            run(spark, bad, ["a", "b"])
    assert not is_notice(b"actualizacion pendiente") and not is_notice(b"ultima actualizacion:") and not is_notice(b"la ultima actualizacion: x")
    assert is_notice("  \u00daLTIMA\tactualizaci\u00f3n :2026-08-02T06:00:00".encode()) and not is_notice(b"ultima actualizacion: a|b")


def test_archive_limits():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 100_000)
        z.writestr("b", "y")
    with zipfile.ZipFile(data) as z:
        snapshots.check_archive(z, snapshots.Limits(ratio=1e9))
        for limits in (snapshots.Limits(members=1), snapshots.Limits(member_bytes=10), snapshots.Limits(total_bytes=10), snapshots.Limits(ratio=2)):
            with pytest.raises(ContractError):
                snapshots.check_archive(z, limits)


@pytest.mark.parametrize("age,share,medium,healthy,grade", [(14, 0.8, False, True, "Alta"), (15, 0.8, False, True, "Media"), (30, 0.8, False, True, "Media"), (31, 0.8, False, True, "Baja"), (0, 0.75, False, True, "Baja"), (0, 1, True, True, "Media"), (0, 1, False, False, "Media")])
def test_grades(age, share, medium, healthy, grade):
    assert validate.grade(False, medium, True, age, share, healthy) == grade


def test_window():
    days = [dt.date(2026, 8, d) for d in range(1, 9)]
    assert resolve_window(days) == (dt.date(2026, 8, 2), dt.date(2026, 8, 8)) and resolve_window(days, days[6]) == (days[0], days[6])
    for bad in (days[:6], days[:3] + days[4:], []):
        with pytest.raises(ValueError):
            resolve_window(bad)


def test_cells():
    assert [sinks.cell(x) for x in ("=1", "+1", "-a", "@b", "ok", float("nan"), None, True)] == ["'=1", "'+1", "'-a", "'@b", "ok", None, None, True]


class Reply:
    def __init__(self, body=b"", status=200, **headers):
        self.body, self.status_code, self.headers = body, status, {k.replace("_", "-"): v for k, v in headers.items()}

    def iter_content(self, n):
        yield self.body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


class Session:
    def __init__(self, reply):
        self.reply, self.gets = reply, 0

    def head(self, url, **_):
        return self.reply

    def get(self, url, **_):
        self.gets += 1
        return self.reply


def test_limits_from_the_environment(monkeypatch):
    assert snapshots.Limits.from_environment() == snapshots.Limits()
    monkeypatch.setenv("MAX_ZIP_MEMBER_COUNT", "3")
    monkeypatch.setenv("MAX_ZIP_COMPRESSION_RATIO", "1.5")
    assert snapshots.Limits.from_environment() == snapshots.Limits(members=3, ratio=1.5)
    monkeypatch.setenv("MAX_HTTP_DOWNLOAD_BYTES", "7")
    assert download.public_policy().most_bytes == 7
    monkeypatch.delenv("MAX_HTTP_DOWNLOAD_BYTES")
    assert download.public_policy().most_bytes == 8 << 30


def test_slug():
    assert download.slug("  S\u00c1BADO -- (ma\u00f1ana) ") == "sabado_manana"


def test_retries():
    class Flaky:
        def __init__(self, *replies):
            self.replies = list(replies)

        def get(self, url, **_):
            reply = self.replies.pop(0)
            if isinstance(reply, Exception):
                raise reply
            return reply

    waits = []
    session = download.Retrying(Flaky(Reply(status=503), ConnectionError(), Reply(status=429, Retry_After="9"), Reply(b"ok")), wait=waits.append)
    assert session.get("u").body == b"ok" and waits == [1.0, 2.0, 9.0]
    assert download.Retrying(Flaky(Reply(status=404)), wait=waits.append).get("u").status_code == 404
    last = download.Retrying(Flaky(*[Reply(status=500)] * 9), wait=waits.append)
    assert last.get("u").status_code == 500 and len(last.transport.replies) == 3
    with pytest.raises(OSError):
        download.Retrying(Flaky(*[ConnectionError()] * 9), wait=waits.append).get("u")


ARCHIVE = "https://datos.produccion.gob.ar/dataset/6f47ec76-d1ce-4e34-a7e1-621fe9b1d0b5/resource/01234567-89ab-cdef-0123-456789abcdef/download/sepa_{}.zip"


def test_allow_list():
    policy = download.public_policy()
    assert download.archive_url(ARCHIVE.format("lunes"), "lunes", policy)
    for url, day in ((ARCHIVE.format("lunes"), "martes"), (ARCHIVE.format("lunes") + "?x=1", "lunes"), (ARCHIVE.format("lunes").replace("resource/0", "resource/x"), "lunes"), (ARCHIVE.format("hoy"), "hoy"), (ARCHIVE.format("lunes").replace("produccion", "otro"), "lunes")):
        with pytest.raises(download.DownloadError):
            download.archive_url(url, day, policy)
    with pytest.raises(download.DownloadError):
        download.catalog(Session(Reply()), download.CATALOG + "&x=1", policy)


def test_download_of_the_catalog(tmp_path):
    class Site:
        def head(self, url, **_):
            return Reply(ETag=url[-12:])

        def get(self, url, **_):
            if url == download.CATALOG:
                reply = Reply()
                reply.json = lambda: {"result": {"resources": [{"name": f"Precios {d.upper()}", "format": "zip", "url": ARCHIVE.format(d)} for d in download.SLOTS] + [{"name": "notes", "format": "PDF"}]}}
                return reply
            return Reply(url.encode())

    found = download.download(tmp_path / "raw", tmp_path / "m.jsonl", dt.date(2026, 8, 2), Site())
    assert set(found) == set(download.SLOTS) and found["jueves"].read_bytes() == ARCHIVE.format("jueves").encode()


def test_download(tmp_path):
    policy, url, day = download.Policy(frozenset({"data.example.org"}), 100), "https://data.example.org/a.zip", dt.date(2026, 8, 1)
    s = Session(Reply(b"abc", ETag="1"))
    path = download.fetch(s, url, "lunes", tmp_path, tmp_path / "m.jsonl", policy, day)
    assert path.read_bytes() == b"abc" and download.fetch(s, url, "lunes", tmp_path, tmp_path / "m.jsonl", policy, day) == path and s.gets == 1
    s.reply = Reply(b"abc", ETag="2")
    assert download.fetch(s, url, "martes", tmp_path, tmp_path / "m.jsonl", policy, day) == path
    for bad in ("http://data.example.org/a", "https://other.org/a", "https://u@data.example.org/a", "https://data.example.org:1/a", "https://data.example.org/a#x"):
        with pytest.raises(download.DownloadError):
            download.check_url(bad, policy)
    for reply in (Reply(status=302), Reply(status=404), Reply(b"x" * 101, ETag="3"), Reply(ETag="4", Content_Length="1000")):
        with pytest.raises(download.DownloadError):
            download.fetch(Session(reply), url, "jueves", tmp_path, tmp_path / "m.jsonl", policy, day)
    assert not list(tmp_path.rglob("*.part"))


def test_small_median(spark):
    """Equal to SQL's median to the last bit, for odd, even, null and empty groups."""
    rows = [(k % 400, None if k % 11 == 0 else (k * 7919 % 30011) / 100) for k in range(1500)] + [(900, None)]
    df = spark.createDataFrame(rows, "k long, v double")
    found = df.groupBy("k").agg(stats.small_median("v").alias("a"), F.median("v").alias("b"))
    assert found.filter("NOT a <=> b").count() == 0 and found.filter("a IS NULL").count() == 1


def test_quantiles_of_counts(spark):
    """Counted values give the quantiles of the rows they stand for."""
    rows = spark.range(3000).select((F.col("id") % 5).alias("k"), (F.col("id") * 7 % 40 / 8).alias("v"))
    counted = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("times"))
    a, b = quantiles_by(rows, ["k"], "v", [0.1, 0.5, 0.9]), quantiles_by(counted, ["k"], "v", [0.1, 0.5, 0.9], "times")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.first().n == 600
