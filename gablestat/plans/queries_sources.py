"""Reading and lining up text snapshots (ids S). The text files are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gablestat.plans.binding import EVERY, NEW, OLD, assessments, dirty_assessments, exact_sum
from gablestat.plans.catalog import over_view, register
from gablestat.plans.cleaning import parse_roll
from gablestat.operators.snapshots import stack_snapshots, with_snapshot
from gablestat.session import fresh_path
from gablestat.sources import assessment as S

_HEADER = {"gross_tax": " GROSS_TAX ", "total_value": "Total Value", "zip_code": "ZIP_CODE", "city": "City", "yr_built": "YR_BUILT"}


def _written(spark, folder, columns, years=None):
    """A text snapshot of the roll with an untidy header, in the shared folder."""
    rows = dirty_assessments(spark, folder, columns, years)
    return S.write_assessment(rows.toDF(*[_HEADER.get(c, c.upper()) for c in columns]), fresh_path(spark, "roll"))


@register(
    "s1_csv_scan",
    over_view(
        "SELECT city, count(*) AS n, count(*) FILTER (pid % 10 <> 0) AS n_value, "
        "CAST(sum(CAST(total_value AS DECIMAL(18,4))) FILTER (pid % 10 <> 0) AS DOUBLE) AS total_value, "
        "CAST(sum(CAST(gross_tax AS DECIMAL(18,4))) FILTER (pid % 10 <> 0) AS DOUBLE) AS gross_tax FROM a GROUP BY 1"
    ),
)
def s1(spark, folder):
    path = _written(spark, folder, ["city", "total_value", "gross_tax"])
    rows = parse_roll(S.normalize_columns(S.read_assessment(spark, path)))
    return rows.groupBy("city").agg(
        F.count(F.lit(1)).alias("n"), F.count("total_value").alias("n_value"),
        exact_sum(F.col("total_value")).alias("total_value"), exact_sum(F.col("gross_tax")).alias("gross_tax"),
    )


@register("s2_scan_with_types", over_view("SELECT zip_code, yr_built, count(*) AS n FROM a GROUP BY 1, 2"))
def s2(spark, folder):
    path = _written(spark, folder, ["zip_code", "yr_built"])
    rows = S.read_assessment(spark, path, types={"ZIP_CODE": "string", "YR_BUILT": "int"})
    return S.normalize_columns(rows).groupBy("zip_code", "yr_built").agg(F.count(F.lit(1)).alias("n"))


@register("s3_normalize_columns", over_view("SELECT pid AS parcel_id, gross_tax, city AS city_2, bldg_type AS city FROM a"))
def s3(spark, folder):
    rows = assessments(spark, folder, ["pid", "gross_tax", "bldg_type", "city"])
    return S.normalize_columns(rows.toDF("Parcel-ID", " GROSS_TAX ", "City", "CITY"), "clean")


@register("s4_resolve_column", over_view("SELECT pid, gross_tax, fireplaces FROM a"))
def s4(spark, folder):
    rows = assessments(spark, folder, ["pid", "gross_tax", "fireplaces"]).toDF("pid", "fy_gross_tax_usd", "fire_place")
    rows = S.resolve_column(rows, ["gross_tax"], "gross_tax", contains=True)
    return S.resolve_column(rows, ["fireplaces", "fire_place"], "fireplaces")


@register(
    "s5_harmonize_snapshots",
    over_view(
        "SELECT fiscal_year, zip_code, CAST(fireplaces AS VARCHAR) AS fireplaces, "
        f"CASE WHEN fiscal_year = {NEW} THEN own_occ END AS corner_unit, CAST(NULL AS VARCHAR) AS sfyi_value, count(*) AS n "
        f"FROM a WHERE fiscal_year IN ({OLD}, {NEW}) GROUP BY ALL"
    ),
)
def s5(spark, folder):
    old = assessments(spark, folder, ["zip_code", "fireplaces"], (OLD,)).toDF("zipcode", "fire_place")
    new = assessments(spark, folder, ["zip_code", "fireplaces", "own_occ"], (NEW,)).withColumnRenamed("own_occ", "corner_unit")
    both = stack_snapshots(with_snapshot(S.harmonize(old), OLD), with_snapshot(S.harmonize(new), NEW))
    keys = ["fiscal_year", "zip_code", "fireplaces", "corner_unit", "sfyi_value"]
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@register("s6_shape", over_view(f"SELECT count(*) AS n_rows, {len(EVERY)} AS n_columns FROM a"))
def s6(spark, folder):
    return S.shape(assessments(spark, folder, EVERY))


@register("s7_preview", over_view("SELECT total_value, land_sf, gross_tax FROM a ORDER BY total_value DESC, pid LIMIT 3"))
def s7(spark, folder):
    rows = assessments(spark, folder, ["pid", "total_value", "land_sf", "gross_tax"])
    return S.preview(rows, ["total_value", "land_sf", "gross_tax"], [F.col("total_value").desc(), F.col("pid")], 3)


@register("s8_result_hand_off", over_view("SELECT city, count(*) AS n FROM a GROUP BY 1"))
def s8(spark, folder):
    path = fresh_path(spark, "result")
    assessments(spark, folder, ["city"]).groupBy("city").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.parquet(path)
