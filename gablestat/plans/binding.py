"""Order tables seen as a property roll: one line item is one assessed record.

Only the joins that the asked columns need are built. Every line item has its part,
order and supplier, so a join left out changes no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The two ship years that stand for the earlier and the later snapshot.
OLD, NEW = 1998, 2000

_MONEY = "decimal(18,4)"


# A condition label for each order priority, finished and open items apart.
_CONDITIONS = {
    "1-URGENT": ("EX - Excellent", "E - Excellent"),
    "2-HIGH": ("VG - Very Good", "G - Good"),
    "3-MEDIUM": ("AVG - Default - Average", "A - Average"),
    "4-NOT SPECIFIED": ("F - Fair", "U - Unknown"),
    "5-LOW": ("VP - Very Poor", "P - Poor"),
}


def _condition() -> Column:
    out = F.when(F.lit(False), "")
    for priority, (finished, still_open) in _CONDITIONS.items():
        label = F.when(F.col("l_linestatus") == "F", finished).otherwise(still_open)
        out = out.when(F.col("o_orderpriority") == priority, label)
    return out


def _share_of(price: Column, rate: Column) -> Column:
    """Price times a whole-percent rate, rounded half up to cents in whole numbers."""
    cents = F.round(price * 100).cast("bigint") * F.round(rate * 100).cast("bigint")
    return F.floor((cents + 50) / 100) / 100


def _columns() -> dict[str, tuple[Column, tuple[str, ...]]]:
    price = F.col("l_extendedprice")
    land = _share_of(price, F.col("l_discount"))
    return {
        "pid": (F.col("l_partkey"), ()),
        "record_id": (F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ()),
        "order_key": (F.col("l_orderkey"), ()),
        "fiscal_year": (F.year("l_shipdate"), ()),
        "city": (F.col("n_name"), ("supplier", "nation")),
        "zip_code": (F.lpad(F.col("l_suppkey").cast("string"), 5, "0"), ()),
        "bldg_type": (F.concat(F.substring("p_type", 1, 1), F.lit(" - "), F.col("p_type")), ("part",)),
        "lu_desc": (F.col("p_name"), ("part",)),
        "yr_built": (F.year("o_orderdate"), ("orders",)),
        "bed_rms": (F.nullif(F.col("l_linenumber"), F.lit(7)), ()),
        "full_bth": (F.col("p_size") % 6, ("part",)),
        "hlf_bth": (F.col("p_size") % 3, ("part",)),
        "num_parking": (F.col("p_size") % 8, ("part",)),
        "fireplaces": ((F.col("l_quantity") % 4).cast("int"), ()),
        "own_occ": (F.when(F.col("l_linestatus") == "F", "Y").otherwise("N"), ()),
        "overall_cond": (_condition(), ("orders",)),
        "total_value": (price, ()),
        "land_value": (land, ()),
        "bldg_value": (price - land, ()),
        "living_area": (F.col("l_quantity"), ()),
        "gross_area": (F.col("l_quantity") + F.col("p_size"), ("part",)),
        "land_sf": (F.col("p_size").cast("double"), ("part",)),
        "gross_tax": (_share_of(price, F.col("l_tax")), ()),
    }


#: All columns of the view.
EVERY = [
    "pid", "record_id", "fiscal_year", "city", "zip_code", "bldg_type", "lu_desc", "yr_built", "bed_rms", "full_bth", "hlf_bth", "num_parking",
    "fireplaces", "own_occ", "overall_cond", "total_value", "land_value", "bldg_value", "living_area", "gross_area", "land_sf", "gross_tax",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _in_years(column: str, years: Sequence[int]) -> Column:
    """Whether a date falls in one of the years, as ranges that the scan can skip by."""
    first = lambda year: F.lit(f"{year}-01-01").cast("date")
    return reduce(or_, ((F.col(column) >= first(y)) & (F.col(column) < first(y + 1)) for y in years), F.lit(False))


def assessments(
    spark: SparkSession, folder: str, columns: Sequence[str], years: Sequence[int] | None = None
) -> DataFrame:
    """The asked columns for every line item, or for those of some ship years."""
    known = _columns()
    needed = {t for c in columns for t in known[c][1]}
    df = table(spark, folder, "lineitem")
    if years is not None:
        df = df.filter(_in_years("l_shipdate", years))
    if "part" in needed:
        df = df.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if "supplier" in needed:
        df = df.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if "nation" in needed:
        df = df.join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    if "orders" in needed:  # last, so that rows lie by order_key where this join moves them
        df = df.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return df.select(*[known[c][0].alias(c) for c in columns])


def dirty_assessments(spark: SparkSession, folder: str, columns: Sequence[str], years=None) -> DataFrame:
    """The same records as a text file would hold them: separators, currency signs, blanks."""
    need = list(dict.fromkeys([*columns, "pid"]))
    df = assessments(spark, folder, need, years)
    blank = F.col("pid") % 10 == 0
    text = {}
    for c in columns:
        if c in ("total_value", "land_value", "bldg_value"):
            text[c] = F.when(blank & F.lit(c == "total_value"), "").otherwise(F.format_number(c, 2))
        elif c == "gross_tax":
            text[c] = F.when(blank, "").otherwise(F.concat(F.lit("$"), F.format_number(c, 2)))
        elif c in ("living_area", "land_sf", "gross_area"):
            text[c] = F.format_number(c, 0)
        elif c != "fiscal_year":
            text[c] = F.col(c).cast("string")
    return df.withColumns(text).select(*columns)


PAIR_MEASURES = ["total_value", "gross_tax", "land_value", "bldg_value", "living_area"]


def exact_sum(c: Column) -> Column:
    return F.sum(c.cast(_MONEY)).cast("double")


def paired_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per property and snapshot, measures summed as exact decimals."""
    rows = assessments(spark, folder, ["pid", "fiscal_year", *PAIR_MEASURES], (OLD, NEW))
    sums = [exact_sum(F.col(c)).alias(c) for c in PAIR_MEASURES]
    return rows.groupBy("pid", "fiscal_year").agg(*sums)


# DuckDB text of the same view, for the side-by-side check.
SQL_VIEW = """a AS (
  SELECT l_partkey AS pid,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record_id,
         CAST(year(l_shipdate) AS INTEGER) AS fiscal_year,
         n_name AS city,
         lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS zip_code,
         substr(p_type, 1, 1) || ' - ' || p_type AS bldg_type,
         p_name AS lu_desc,
         CAST(year(o_orderdate) AS INTEGER) AS yr_built,
         nullif(l_linenumber, 7) AS bed_rms,
         p_size % 6 AS full_bth,
         p_size % 3 AS hlf_bth,
         p_size % 8 AS num_parking,
         CAST(l_quantity % 4 AS INTEGER) AS fireplaces,
         CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END AS own_occ,
         CASE o_orderpriority || l_linestatus
           WHEN '1-URGENTF' THEN 'EX - Excellent' WHEN '1-URGENTO' THEN 'E - Excellent'
           WHEN '2-HIGHF' THEN 'VG - Very Good' WHEN '2-HIGHO' THEN 'G - Good'
           WHEN '3-MEDIUMF' THEN 'AVG - Default - Average' WHEN '3-MEDIUMO' THEN 'A - Average'
           WHEN '4-NOT SPECIFIEDF' THEN 'F - Fair' WHEN '4-NOT SPECIFIEDO' THEN 'U - Unknown'
           WHEN '5-LOWF' THEN 'VP - Very Poor' WHEN '5-LOWO' THEN 'P - Poor' END AS overall_cond,
         l_extendedprice AS total_value,
         floor(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) + 50 AS DOUBLE) / 100) / 100 AS land_value,
         l_extendedprice - floor(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) + 50 AS DOUBLE) / 100) / 100 AS bldg_value,
         l_quantity AS living_area,
         l_quantity + p_size AS gross_area,
         CAST(p_size AS DOUBLE) AS land_sf,
         floor(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) + 50 AS DOUBLE) / 100) / 100 AS gross_tax
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
)"""

SQL_PAIR = """p AS (
  SELECT pid, fiscal_year,
         CAST(sum(CAST(total_value AS DECIMAL(18,4))) AS DOUBLE) AS total_value,
         CAST(sum(CAST(gross_tax AS DECIMAL(18,4))) AS DOUBLE) AS gross_tax,
         CAST(sum(CAST(land_value AS DECIMAL(18,4))) AS DOUBLE) AS land_value,
         CAST(sum(CAST(bldg_value AS DECIMAL(18,4))) AS DOUBLE) AS bldg_value,
         CAST(sum(CAST(living_area AS DECIMAL(18,4))) AS DOUBLE) AS living_area
  FROM a WHERE fiscal_year IN (1998, 2000) GROUP BY pid, fiscal_year
)"""
