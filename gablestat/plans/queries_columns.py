"""Column expressions and row selection (ids E, P, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gablestat.functions import columns as C
from gablestat.functions import levels
from gablestat.operators import encoding, filters
from gablestat.operators.profile import distinct_values
from gablestat.plans.binding import NEW, assessments, dirty_assessments, table
from gablestat.plans.catalog import over_view, register
from gablestat.sources.assessment import blank_strings_to_null, harmonize

_DIRTY = """d AS (
  SELECT pid, CASE WHEN pid % 10 = 0 THEN '' ELSE format('{:,.2f}', total_value) END AS total_text,
         CASE WHEN pid % 10 = 0 THEN '' ELSE '$' || format('{:,.2f}', gross_tax) END AS tax_text FROM a
)"""


@register(
    "e1_parse_number",
    over_view("SELECT pid, try_cast(replace(total_text, ',', '') AS DOUBLE) AS total_value FROM d", _DIRTY),
)
def e1(spark, folder):
    rows = dirty_assessments(spark, folder, ["pid", "total_value"])
    return rows.select(F.col("pid").cast("bigint").alias("pid"), C.parse_number("total_value").alias("total_value"))


@register(
    "e2_parse_currency",
    over_view(
        "SELECT pid, try_cast(regexp_replace(tax_text, '[^0-9.]', '', 'g') AS DOUBLE) AS gross_tax FROM d", _DIRTY
    ),
)
def e2(spark, folder):
    rows = dirty_assessments(spark, folder, ["pid", "gross_tax"])
    return rows.select(F.col("pid").cast("bigint").alias("pid"), C.parse_currency("gross_tax").alias("gross_tax"))


@register(
    "e3_blank_to_null",
    over_view(
        "SELECT nullif(total_text, '') AS total_value, nullif(tax_text, '') AS gross_tax, count(*) AS n "
        "FROM d GROUP BY 1, 2", _DIRTY,
    ),
)
def e3(spark, folder):
    rows = blank_strings_to_null(dirty_assessments(spark, folder, ["total_value", "gross_tax"]))
    return rows.groupBy("total_value", "gross_tax").agg(F.count(F.lit(1)).alias("n"))


_UNIT_SQL = "CAST(l_linenumber AS VARCHAR) || CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END"


@register(
    "e4_try_double",
    f"SELECT {_UNIT_SQL} AS unit_num, try_cast({_UNIT_SQL} AS DOUBLE) AS unit_value, count(*) AS n "
    "FROM lineitem GROUP BY 1, 2",
)
def e4(spark, folder):
    letter = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))
    rows = table(spark, folder, "lineitem").select(F.concat(F.col("l_linenumber").cast("string"), letter).alias("unit_num"))
    return (
        rows.withColumn("unit_value", C.try_double("unit_num"))
        .groupBy("unit_num", "unit_value").agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "e5_cast_to_text",
    over_view(
        "SELECT CAST(pid AS VARCHAR) AS pid, CAST(fiscal_year AS VARCHAR) AS fiscal_year, "
        "CAST(bed_rms AS VARCHAR) AS bed_rms, city FROM a"
    ),
)
def e5(spark, folder):
    return harmonize(assessments(spark, folder, ["pid", "fiscal_year", "bed_rms", "city"]), {}, [])


@register(
    "e6_zip5",
    over_view("SELECT CAST(zip_code AS INTEGER) AS raw, zip_code AS zip5, count(*) AS n FROM a GROUP BY 1, 2"),
)
def e6(spark, folder):
    raw = assessments(spark, folder, ["zip_code"]).select(F.col("zip_code").cast("int").alias("raw"))
    return raw.withColumn("zip5", C.zip5("raw")).groupBy("raw", "zip5").agg(F.count(F.lit(1)).alias("n"))


_RECODE_SQL = (
    "CASE WHEN overall_cond IN ('EX - Excellent', 'E - Excellent') THEN 'E - Excellent' "
    "WHEN overall_cond IN ('VG - Very Good', 'G - Good') THEN 'G - Good' "
    "WHEN overall_cond IN ('AVG - Default - Average', 'A - Average') THEN 'A - Average' "
    "WHEN overall_cond IN ('VP - Very Poor', 'P - Poor', 'US - Unsound') THEN 'P - Poor' ELSE overall_cond END"
)


@register(
    "e7_recode_condition",
    over_view(f"SELECT overall_cond, {_RECODE_SQL} AS condition, count(*) AS n FROM a GROUP BY 1, 2"),
)
def e7(spark, folder):
    rows = assessments(spark, folder, ["overall_cond"])
    return (
        rows.withColumn("condition", C.recode("overall_cond", levels.CONDITION_SYNONYMS))
        .groupBy("overall_cond", "condition").agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "e8_strip_prefix",
    over_view("SELECT bldg_type, regexp_replace(bldg_type, '^.* - ', '') AS bldg_type_clean, count(*) AS n FROM a GROUP BY 1, 2"),
)
def e8(spark, folder):
    rows = assessments(spark, folder, ["bldg_type"]).withColumn("bldg_type_clean", C.strip_prefix("bldg_type"))
    return rows.groupBy("bldg_type", "bldg_type_clean").agg(F.count(F.lit(1)).alias("n"))


@register(
    "e9_strip_prefix_all",
    over_view(
        "SELECT pid, regexp_replace(bldg_type, '^.* - ', '') AS bldg_type, "
        "regexp_replace(overall_cond, '^.* - ', '') AS overall_cond, city FROM a"
    ),
)
def e9(spark, folder):
    return encoding.strip_prefix_all(assessments(spark, folder, ["pid", "bldg_type", "overall_cond", "city"]))


_TITLE_SQL = (
    "array_to_string(list_transform(string_split(part, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
)


@register(
    "e10_title_trim",
    over_view(
        f"SELECT raw, array_to_string(list_transform(string_split(trim(raw), '-'), lambda part: {_TITLE_SQL}), '-') "
        "AS city_clean, n FROM (SELECT '  ' || upper(lu_desc) || '-' || lower(city) || ' ' AS raw, count(*) AS n FROM a GROUP BY 1)"
    ),
)
def e10(spark, folder):
    rows = assessments(spark, folder, ["lu_desc", "city"])
    raw = F.concat(F.lit("  "), F.upper("lu_desc"), F.lit("-"), F.lower("city"), F.lit(" "))
    counts = rows.groupBy(raw.alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("city_clean", C.title_trim("raw"))


@register(
    "e11_ordinal_encode",
    over_view(
        "SELECT condition, CASE condition WHEN 'P - Poor' THEN 1 WHEN 'F - Fair' THEN 2 WHEN 'A - Average' THEN 3 "
        "WHEN 'G - Good' THEN 4 WHEN 'E - Excellent' THEN 5 END AS rank, count(*) AS n "
        f"FROM (SELECT {_RECODE_SQL} AS condition FROM a) GROUP BY 1, 2"
    ),
)
def e11(spark, folder):
    rows = assessments(spark, folder, ["overall_cond"])
    rows = rows.select(C.recode("overall_cond", levels.CONDITION_SYNONYMS).alias("condition"))
    rows = rows.withColumn("rank", C.ordinal_encode("condition", levels.CONDITION_LEVELS))
    return rows.groupBy("condition", "rank").agg(F.count(F.lit(1)).alias("n"))


@register(
    "e12_nominal_encode",
    over_view(
        "SELECT a.city, c.code AS city_code, a.lu_desc, u.code AS lu_desc_code, count(*) AS n FROM a "
        "JOIN (SELECT city, dense_rank() OVER (ORDER BY city) AS code FROM (SELECT DISTINCT city FROM a)) c ON a.city = c.city "
        "JOIN (SELECT lu_desc, dense_rank() OVER (ORDER BY lu_desc) AS code FROM (SELECT DISTINCT lu_desc FROM a)) u "
        "ON a.lu_desc = u.lu_desc GROUP BY ALL"
    ),
)
def e12(spark, folder):
    rows = assessments(spark, folder, ["city", "lu_desc"])
    coded = encoding.nominal_encode(rows, ["city", "lu_desc"], base=1)
    return coded.groupBy("city", "city_code", "lu_desc", "lu_desc_code").agg(F.count(F.lit(1)).alias("n"))


@register(
    "e13_nominal_inverse",
    over_view(
        "SELECT code AS bldg_type_code, bldg_type AS bldg_type_label, n FROM (SELECT bldg_type, "
        "dense_rank() OVER (ORDER BY bldg_type) - 1 AS code, count(*) AS n FROM a GROUP BY bldg_type)"
    ),
)
def e13(spark, folder):
    rows = assessments(spark, folder, ["bldg_type"])
    codes = encoding.NominalCodes(rows, ["bldg_type"], base=0)
    coded = codes.transform(rows).groupBy("bldg_type_code").agg(F.count(F.lit(1)).alias("n"))
    return codes.inverse(coded)


@register(
    "e12_nominal_encode_many_levels",
    over_view("SELECT record_id, dense_rank() OVER (ORDER BY record_id) - 1 AS record_id_code FROM a"),
)
def e12_many(spark, folder):
    return encoding.nominal_encode(assessments(spark, folder, ["record_id"]), ["record_id"])


@register("e14_price_per_sqft", over_view(
    # Half up on the decimal digits of the quotient, as Spark rounds a double.
    "SELECT pid, total_value, CAST(round(CAST(CAST(total_value / living_area AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE) "
    "AS price_per_sqft FROM a"
))
def e14(spark, folder):
    rows = assessments(spark, folder, ["pid", "total_value", "living_area"])
    return rows.select("pid", "total_value", C.price_per_area("total_value", "living_area", 2).alias("price_per_sqft"))


@register("e15_age", over_view(f"SELECT yr_built, {NEW} - yr_built AS age_of_property, count(*) AS n FROM a GROUP BY 1, 2"))
def e15(spark, folder):
    rows = assessments(spark, folder, ["yr_built"]).withColumn("age_of_property", C.age(NEW, "yr_built"))
    return rows.groupBy("yr_built", "age_of_property").agg(F.count(F.lit(1)).alias("n"))


@register(
    "e16_tax_ratio",
    over_view("SELECT pid, gross_tax, round(gross_tax / total_value * 100, 4) AS tax_to_value_ratio, "
              "CASE WHEN land_value <> 0 THEN round(gross_tax / land_value * 100, 6) END AS tax_to_land_ratio FROM a"),
)
def e16(spark, folder):
    rows = assessments(spark, folder, ["pid", "gross_tax", "total_value", "land_value"])
    return rows.select(
        "pid", "gross_tax", C.ratio_pct("gross_tax", "total_value", 4).alias("tax_to_value_ratio"),
        C.ratio_pct("gross_tax", "land_value", 6).alias("tax_to_land_ratio"),
    )


@register(
    "e17_natural_log",
    over_view(
        "SELECT pid, round(ln(total_value), 9) AS log_total_value, round(ln(land_sf), 9) AS log_land_sf, "
        "CASE WHEN land_value > 0 THEN round(ln(land_value), 9) END AS log_land_value FROM a"
    ),
)
def e17(spark, folder):
    rows = assessments(spark, folder, ["pid", "total_value", "land_sf", "land_value"])
    return rows.select(
        "pid", *[F.round(C.ln_pos(c), 9).alias(f"log_{c}") for c in ("total_value", "land_sf", "land_value")]
    )


@register(
    "e18_log10",
    over_view("SELECT pid, round(log10(total_value), 9) AS log10_value, "
              "CASE WHEN gross_tax > 0 THEN round(log10(gross_tax), 9) END AS log10_tax FROM a"),
)
def e18(spark, folder):
    rows = assessments(spark, folder, ["pid", "total_value", "gross_tax"])
    return rows.select(
        "pid", F.round(C.log10_pos("total_value"), 9).alias("log10_value"), F.round(C.log10_pos("gross_tax"), 9).alias("log10_tax")
    )


@register(
    "e22_two_group",
    over_view("SELECT CASE WHEN bed_rms >= 3 THEN '3+ bedrooms' WHEN bed_rms < 3 THEN '< 3 bedrooms' END AS bedroom_group, "
              "count(*) AS n FROM a GROUP BY 1"),
)
def e22(spark, folder):
    rows = assessments(spark, folder, ["bed_rms"])
    group = C.two_group("bed_rms", 3, "3+ bedrooms", "< 3 bedrooms").alias("bedroom_group")
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


@register("e23_unit_scaling", over_view("SELECT pid, round(total_value / 1000000, 9) AS value_millions FROM a"))
def e23(spark, folder):
    rows = assessments(spark, folder, ["pid", "total_value"])
    return rows.select("pid", F.round(F.col("total_value") / 1e6, 9).alias("value_millions"))


@register(
    "e24_decision_label",
    "SELECT l_tax, CASE WHEN l_tax < 0.05 THEN 'Reject H0' ELSE 'Fail to Reject H0' END AS decision, "
    "CASE WHEN l_tax < 0.05 THEN 'Significant' ELSE 'Not Significant' END AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3",
)
def e24(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy("l_tax").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumns(
        {"decision": C.decision("l_tax"), "flag": C.decision("l_tax", 0.05, "Significant", "Not Significant")}
    )


@register(
    "e25_absolute_gap",
    over_view("SELECT pid, round(abs(land_value - gross_tax), 6) AS gap FROM a"),
)
def e25(spark, folder):
    rows = assessments(spark, folder, ["pid", "land_value", "gross_tax"])
    return rows.select("pid", F.round(F.abs(F.col("land_value") - F.col("gross_tax")), 6).alias("gap"))


@register(
    "e26_coerce_mostly_numeric",
    over_view(
        "SELECT try_cast(zip_code AS DOUBLE) AS zip_code, "
        "CASE WHEN own_occ = 'Y' THEN CAST(pid AS VARCHAR) ELSE city END AS mixed, city, count(*) AS n FROM a GROUP BY 1, 2, 3"
    ),
)
def e26(spark, folder):
    rows = assessments(spark, folder, ["zip_code", "city", "pid", "own_occ"])
    mixed = F.when(F.col("own_occ") == "Y", F.col("pid").cast("string")).otherwise(F.col("city"))
    rows = rows.select("zip_code", "city", mixed.alias("mixed"))
    out = encoding.coerce_mostly_numeric(rows, ["zip_code", "city", "mixed"], 0.6)
    return out.groupBy("zip_code", "mixed", "city").agg(F.count(F.lit(1)).alias("n"))


@register("p1_select_existing", over_view("SELECT pid, city, bed_rms FROM a"))
def p1(spark, folder):
    rows = assessments(spark, folder, ["pid", "city", "bed_rms", "total_value"])
    return filters.select_existing(rows, ["pid", "city", "kitchens", "bed_rms", "tt_rms"])


@register(
    "p2_add_columns",
    over_view(f"SELECT pid, total_value * 2 AS total_value, {NEW} - yr_built AS age_of_property FROM a"),
)
def p2(spark, folder):
    rows = assessments(spark, folder, ["pid", "total_value", "yr_built"])
    return rows.withColumns(
        {"total_value": F.col("total_value") * 2, "age_of_property": C.age(NEW, "yr_built")}
    ).drop("yr_built")


@register("p3_drop_columns", over_view("SELECT pid, bed_rms FROM a"))
def p3(spark, folder):
    return assessments(spark, folder, ["pid", "bed_rms", "total_value", "city"]).drop("total_value", "city")


@register("p4_rename_columns", over_view("SELECT pid AS parcel, bed_rms AS bedrooms FROM a"))
def p4(spark, folder):
    return assessments(spark, folder, ["pid", "bed_rms"]).withColumnsRenamed({"pid": "parcel", "bed_rms": "bedrooms"})


@register("f1_not_null", over_view("SELECT pid, bed_rms FROM a WHERE bed_rms IS NOT NULL"))
def f1(spark, folder):
    return assessments(spark, folder, ["pid", "bed_rms"]).filter(F.col("bed_rms").isNotNull())


_BASE_VALID = f"total_value > 0 AND living_area > 0 AND land_sf > 0 AND yr_built > 1700 AND yr_built <= {NEW}"


@register("f2_valid_records", over_view(f"SELECT pid, total_value, yr_built FROM a WHERE {_BASE_VALID}"))
def f2(spark, folder):
    rows = assessments(spark, folder, ["pid", "total_value", "yr_built", "living_area", "land_sf"])
    return filters.valid_records(rows, NEW).select("pid", "total_value", "yr_built")


@register(
    "f2_valid_with_tax_and_rooms",
    over_view(
        f"SELECT pid, bed_rms, full_bth, gross_tax FROM a WHERE {_BASE_VALID} AND gross_tax > 0 "
        "AND bed_rms BETWEEN 0 AND 10 AND full_bth BETWEEN 0 AND 8"
    ),
)
def f2_rooms(spark, folder):
    rows = assessments(
        spark, folder, ["pid", "total_value", "gross_tax", "yr_built", "living_area", "land_sf", "bed_rms", "full_bth"]
    )
    kept = filters.valid_records(
        rows, NEW, ("total_value", "gross_tax", "living_area", "land_sf"), {"bed_rms": (0, 10), "full_bth": (0, 8)}
    )
    return kept.select("pid", "bed_rms", "full_bth", "gross_tax")


@register(
    "f2_valid_for_boosting",
    over_view(
        f"SELECT pid, num_parking, gross_tax FROM a WHERE gross_tax > 0 AND living_area > 0 AND land_sf > 0 "
        f"AND yr_built > 1700 AND yr_built <= {NEW} AND num_parking >= 0"
    ),
)
def f2_boosting(spark, folder):
    rows = assessments(spark, folder, ["pid", "gross_tax", "yr_built", "living_area", "land_sf", "num_parking"])
    kept = filters.valid_records(rows, NEW, ("gross_tax", "living_area", "land_sf")).filter("num_parking >= 0")
    return kept.select("pid", "num_parking", "gross_tax")


@register("f3_psf_open_range", over_view("SELECT pid, total_value, living_area FROM a WHERE total_value / living_area > 0 AND total_value / living_area < 1500"))
def f3_psf(spark, folder):
    rows = assessments(spark, folder, ["pid", "total_value", "living_area"])
    psf = C.price_per_area("total_value", "living_area")
    return rows.filter(C.between_open(psf, 0, 1500))


@register("f3_ratio_open_range", over_view("SELECT pid, gross_tax FROM a WHERE gross_tax / total_value * 100 > 0 AND gross_tax / total_value * 100 < 6.5"))
def f3_ratio(spark, folder):
    rows = assessments(spark, folder, ["pid", "gross_tax", "total_value"])
    return rows.filter(C.between_open(C.ratio_pct("gross_tax", "total_value"), 0, 6.5)).drop("total_value")


@register("f3_beds_closed_range", over_view("SELECT pid, bed_rms FROM a WHERE bed_rms BETWEEN 2 AND 5"))
def f3_beds(spark, folder):
    return assessments(spark, folder, ["pid", "bed_rms"]).filter(C.between_closed("bed_rms", 2, 5))


@register("f3_baths_closed_range", over_view("SELECT pid, full_bth FROM a WHERE full_bth BETWEEN 1 AND 5"))
def f3_baths(spark, folder):
    return assessments(spark, folder, ["pid", "full_bth"]).filter(C.between_closed("full_bth", 1, 5))


@register("f3_parking_closed_range", over_view("SELECT pid, num_parking FROM a WHERE num_parking BETWEEN 0 AND 5"))
def f3_parking(spark, folder):
    return assessments(spark, folder, ["pid", "num_parking"]).filter(C.between_closed("num_parking", 0, 5))


@register("f3_year_half_open_range", over_view(f"SELECT pid, yr_built FROM a WHERE yr_built > 1996 AND yr_built <= {NEW}"))
def f3_year(spark, folder):
    return assessments(spark, folder, ["pid", "yr_built"]).filter(C.half_open_year("yr_built", 1996, NEW))


@register(
    "f4_iqr_filter",
    over_view(
        "SELECT pid, gross_tax FROM a, (SELECT quantile_cont(gross_tax, 0.25) AS q1, quantile_cont(gross_tax, 0.75) AS q3 FROM a) "
        "WHERE gross_tax BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    ),
)
def f4(spark, folder):
    return filters.iqr_filter(assessments(spark, folder, ["pid", "gross_tax"]), "gross_tax")


@register(
    "f4_iqr_filter_by_year",
    over_view(
        "SELECT pid, a.fiscal_year, gross_tax FROM a JOIN (SELECT fiscal_year, quantile_cont(gross_tax, 0.25) AS q1, "
        "quantile_cont(gross_tax, 0.75) AS q3 FROM a GROUP BY 1) f ON a.fiscal_year = f.fiscal_year "
        "WHERE gross_tax BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    ),
)
def f4_year(spark, folder):
    rows = assessments(spark, folder, ["pid", "fiscal_year", "gross_tax"])
    return filters.iqr_filter(rows, "gross_tax", by=["fiscal_year"])


@register("f5_targeted_not_null", over_view("SELECT pid, bed_rms, city FROM a WHERE bed_rms IS NOT NULL AND city IS NOT NULL"))
def f5(spark, folder):
    return filters.complete_cases(assessments(spark, folder, ["pid", "bed_rms", "city"]), ["bed_rms", "city"])


@register(
    "f6_complete_cases",
    over_view("SELECT pid, bed_rms, gross_tax / nullif(land_value, 0) AS ratio FROM a WHERE bed_rms IS NOT NULL AND land_value <> 0"),
)
def f6(spark, folder):
    rows = assessments(spark, folder, ["pid", "bed_rms", "gross_tax", "land_value"])
    return filters.complete_cases(rows.select("pid", "bed_rms", F.try_divide("gross_tax", "land_value").alias("ratio")))


@register("f7_membership", over_view("SELECT pid, bldg_type FROM a WHERE bldg_type IN ('E - ECONOMY', 'S - SMALL')"))
def f7(spark, folder):
    return assessments(spark, folder, ["pid", "bldg_type"]).filter(F.col("bldg_type").isin("E - ECONOMY", "S - SMALL"))


@register("a25_distinct_values", over_view("SELECT DISTINCT lu_desc FROM a WHERE lu_desc IS NOT NULL"))
def a25(spark, folder):
    return distinct_values(assessments(spark, folder, ["lu_desc"]), "lu_desc")
