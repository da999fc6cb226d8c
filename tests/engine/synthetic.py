"""Seven days of seven banners with twenty stores and eight products, as archives in the contract's layout."""

import io
import zipfile
from pathlib import Path

from gondola.sources.contract import COLUMNS

BANNERS = [("10", "1"), ("12", "1"), ("11", "2"), ("15", "1"), ("2", "1"), ("9", "3"), ("13", "1")]
FACTORS = [0.94, 0.96, 0.98, 1.00, 1.02, 1.04, 1.06]
PRODUCTS = [
    ("7790272001029", "Aceite de girasol Natura", "1.5", "LT", 1500), ("7791120031557", "Arroz blanco Ala", "1", "KG", 1000), ("7792540250450", "Azúcar Ledesma superior", "1", "kg", 1200), ("7790550022234", "Café tostado molido Cabrales", "250", "GR", 2000),
    ("7790070320285", "Fideos secos Favorita", "500", "grs", 700), ("7790070562258", "Harina de trigo 000 Favorita", "1", "KG", 800), ("7790742363008", "Leche entera UHT La Serenísima", "1", "L", 1300), ("7792710000182", "Yerba mate tradicional Amanda", "500", "G", 900),
]
DATES = [f"2026-07-{d}" for d in range(27, 32)] + ["2026-08-01", "2026-08-02"]


def csv(name: str, rows: list[list[str]]) -> bytes:
    lines = ["|".join(COLUMNS[name]), *("|".join(r) for r in rows), "", "Última actualización: 2026-08-02T06:00:00-03:00"]
    return ("﻿" + "\r\n".join(lines) + "\r\n").encode()


def package(k: int, date: str) -> dict[str, list[list[str]]]:
    commerce, banner = BANNERS[k]
    day = int(date[-2:])
    stores, prices = [], []
    for s in range(1, 21):
        stores.append([commerce, banner, str(s), f"Sucursal {s}", "Super", "Calle", "1", "-34.6", "-58.4", "", "Centro", "1000", "CABA", "AR-C", *["9-21"] * 7])
        for code, text, size, unit, base in PRODUCTS:
            price = f"{round(base * FACTORS[k] * (1 + (day % 3 - 1) * 0.005), 2):.2f}"
            prices.append([commerce, banner, str(s), code, "1", text, size, unit, "Marca", price, price, "1", "UN", "", "", "", ""])
    return {"comercio.csv": [[commerce, banner, "30-1", "Firma SA", f"Cadena {k}", "https://x", "2026-08-02T06:00:00-03:00", "1.0"]], "sucursales.csv": stores, "productos.csv": prices}


def archive(raw: Path, date: str, change=None, more: dict[str, bytes] | None = None, banners=range(len(BANNERS))) -> Path:
    """change(k, files) may alter a package's rows in place; values that are bytes are written as they are."""
    folder = raw / date
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / "sepa_x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as outer:
        for k in banners:
            files = package(k, date)
            if change:
                change(k, files)
            inner = io.BytesIO()
            with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
                for name, rows in files.items():
                    z.writestr(name, rows if isinstance(rows, bytes) else csv(name, rows))
            outer.writestr(f"{date}/sepa_1_comercio-sepa-{k}_{date}.zip", inner.getvalue())
        for name, data in (more or {}).items():
            outer.writestr(name, data)
    return path
