"""Product codes: normalising, checking and classifying trade item numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The contract's spellings of "yes", code lengths and the prefixes of codes that only one shop uses.
YES = ("1", "true", "t", "si", "sí")
CODE = r"\A(?:[0-9]{8}|[0-9]{12}|[0-9]{13}|[0-9]{14})\z"
RESTRICTED = r"\A(?:2[0-9]{7}|02[0-9]{10}|2[0-9]{12}|02[0-9]{12})\z"

RESTRICTED_LOCAL, INTERNAL_LOCAL, GLOBAL_GTIN, INVALID = "RESTRICTED_LOCAL", "INTERNAL_LOCAL", "GLOBAL_GTIN", "INVALID"


def is_yes(flag: Column) -> Column:
    return F.lower(F.trim(flag)).isin(*YES)


def normalize_gtin14(product_id: Column, is_ean: Column) -> Column:
    """The code padded to 14 digits if it is flagged as a trade item number and has one of their lengths."""
    code = F.trim(product_id)
    return F.when(is_yes(is_ean) & code.rlike(CODE), F.lpad(code, 14, "0"))


def is_valid_gtin14(code: Column) -> Column:
    """Whether the last of 14 digits is the mod-10 check digit of the others; false for null."""
    digit = [F.substring(code, k, 1).try_cast("int") for k in range(1, 15)]
    weighted = sum((d * (3 if k % 2 == 0 else 1) for k, d in enumerate(digit[:13])), F.lit(0))
    return F.coalesce(code.rlike(r"\A[0-9]{14}\z") & (digit[13] == (10 - weighted % 10) % 10), F.lit(False))


def classify(product_id: Column, is_ean: Column, valid: Column) -> Column:
    return (
        F.when(F.trim(product_id).rlike(RESTRICTED), RESTRICTED_LOCAL)
        .when(~F.coalesce(is_ean, F.lit(False)), INTERNAL_LOCAL)
        .when(F.coalesce(valid, F.lit(False)), GLOBAL_GTIN)
        .otherwise(INVALID)
    )


def register(spark: SparkSession) -> None:
    """The four scalar functions as SQL functions, for ad-hoc queries."""
    from gondola.functions.units import ALIASES

    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION normalize_gtin14(product_id STRING, is_ean STRING) RETURNS STRING RETURN
        CASE WHEN lower(trim(is_ean)) IN ({", ".join(f"'{y}'" for y in YES)}) AND rlike(trim(product_id), r'{CODE}') THEN lpad(trim(product_id), 14, '0') END""")
    total = " + ".join(f"{3 if k % 2 else 1} * try_cast(substr(code, {k}, 1) AS INT)" for k in range(1, 14))
    spark.sql(rf"""CREATE OR REPLACE TEMPORARY FUNCTION is_valid_gtin14(code STRING) RETURNS BOOLEAN RETURN
        coalesce(rlike(code, r'\A[0-9]{{14}}\z') AND try_cast(substr(code, 14, 1) AS INT) = (10 - ({total}) % 10) % 10, false)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION classify_product_code(product_id STRING, is_ean BOOLEAN, valid BOOLEAN) RETURNS STRING RETURN
        CASE WHEN rlike(trim(product_id), r'{RESTRICTED}') THEN '{RESTRICTED_LOCAL}' WHEN NOT coalesce(is_ean, false) THEN '{INTERNAL_LOCAL}'
             WHEN coalesce(valid, false) THEN '{GLOBAL_GTIN}' ELSE '{INVALID}' END""")
    pairs = " ".join(f"WHEN '{a}' THEN '{u}'" for u, names in ALIASES.items() for a in names.split())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_unit(unit STRING) RETURNS STRING RETURN CASE upper(trim(unit)) {pairs} ELSE upper(nullif(trim(unit), '')) END")
