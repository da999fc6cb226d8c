"""Units of measure and presentation sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that the source uses for each unit.
ALIASES = {
    "G": "G GR GR. GRM GRS GRAMOS",
    "KG": "KG KGS KGM KGR KG. KILO KILOGRAMOS",
    "L": "L LT LT. LTR LTS LITRO LITROS",
    "ML": "ML ML. CC CC. CM3",
    "UN": "UN UN. UNI UNIDAD UNIDADES EA",
}
#: Unit -> base unit and how many of these it is.
BASE = {"KG": ("G", 1000), "G": ("G", 1), "L": ("ML", 1000), "ML": ("ML", 1), "UN": ("UN", 1)}


def normalize_unit(unit: Column) -> Column:
    """The unit's name; other spellings in upper case; null if blank."""
    clean = F.upper(F.trim(unit))
    known = F.create_map(*[F.lit(x) for name, spellings in ALIASES.items() for s in spellings.split() for x in (s, name)])
    return F.coalesce(F.try_element_at(known, clean), F.nullif(clean, F.lit("")))


def base_unit(unit: Column) -> Column:
    return F.coalesce(*[F.when(unit == u, b) for u, (b, _) in BASE.items()])


def base_quantity(quantity: Column, unit: Column) -> Column:
    return F.coalesce(*[F.when(unit == u, quantity * n) for u, (_, n) in BASE.items()])
