"""Grouped questions over one roll (ids A1-A13, A18-A20, T, J3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gablestat.functions import columns as C
from gablestat.operators import groups
from gablestat.operators.profile import overview
from gablestat.operators.quantiles import quantiles
from gablestat.plans.binding import NEW, assessments, dirty_assessments
from gablestat.plans.catalog import over_view, register
from gablestat.plans.cleaning import derive_ratios, parse_roll

# Half up on the decimal digits of the quotient, as Spark rounds a double.
_PSF = "CAST(round(CAST(CAST(total_value / living_area AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE)"
_RATIO = "round(gross_tax / total_value * 100, 4)"


def value_by_city(spark, folder, min_n: int = 100):
    """Typed text to top cities: parse, derive, group, keep large groups, best fifteen."""
    raw = dirty_assessments(spark, folder, ["city", "total_value", "gross_tax", "living_area", "yr_built"])
    rows = derive_ratios(parse_roll(raw), NEW, rounded=True).filter(F.col("total_value").isNotNull())
    metrics = {
        "avg_value": F.round(F.avg("total_value"), 6),
        "avg_tax": F.round(F.avg("gross_tax"), 6),
        "avg_psf": F.round(F.avg("price_per_sqft"), 6),
    }
    return groups.group_profile(rows, "city", metrics, min_n=min_n, order="avg_value", top=15)

@register(
    "a1_value_by_city",
    over_view(
        "SELECT city, round(avg(total_value), 6) AS avg_value, round(avg(gross_tax), 6) AS avg_tax, "
        f"round(avg({_PSF}), 6) AS avg_psf, count(*) AS n FROM a WHERE pid % 10 <> 0 "
        "GROUP BY city HAVING count(*) >= 100 ORDER BY avg_value DESC, city LIMIT 15"
    ),
)
def a1(spark, folder):
    return value_by_city(spark, folder)

@register(
    "a2_value_by_building_type",
    over_view(
        "SELECT bldg_type, round(avg(total_value), 6) AS avg_value, count(*) AS n FROM a "
        "WHERE total_value IS NOT NULL AND bldg_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, bldg_type LIMIT 15"
    ),
)
def a2(spark, folder):
    rows = assessments(spark, folder, ["bldg_type", "total_value"]).dropna()
    return groups.group_profile(rows, "bldg_type", {"avg_value": F.round(F.avg("total_value"), 6)}, order="n", top=15)

@register(
    "a3_psf_summary",
    over_view(
        "SELECT round(avg(psf), 6) AS mean_psf, round(stddev_samp(psf), 6) AS stddev_psf, round(min(psf), 6) AS min_psf, "
        f"round(max(psf), 6) AS max_psf FROM (SELECT {_PSF} AS psf FROM a) WHERE psf > 0 AND psf < 10000"
    ),
)
def a3(spark, folder):
    rows = assessments(spark, folder, ["total_value", "living_area"])
    rows = rows.select(C.price_per_area("total_value", "living_area", 2).alias("psf"))
    out = groups.summary_stats(rows, "psf", 0, 10000, "psf")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])

@register(
    "a4_count_by_year_built",
    over_view(f"SELECT yr_built, count(*) AS n FROM a WHERE yr_built > 1700 AND yr_built <= {NEW} GROUP BY 1"),
)
def a4(spark, folder):
    rows = assessments(spark, folder, ["yr_built"]).filter(C.half_open_year("yr_built", 1700, NEW))
    return groups.count_by(rows, "yr_built")

@register(
    "a5_value_by_bedrooms",
    over_view("SELECT bed_rms, round(avg(total_value), 6) AS avg_value, count(*) AS n FROM a WHERE bed_rms BETWEEN 1 AND 8 GROUP BY 1"),
)
def a5(spark, folder):
    rows = assessments(spark, folder, ["bed_rms", "total_value"])
    out = groups.premium(rows, [], "bed_rms", 1, 8, "total_value")
    return out.withColumn("avg_value", F.round("avg_value", 6))

@register(
    "a6_tax_burden_by_city",
    over_view(
        "SELECT city, round(avg(ratio), 8) AS avg_tax_ratio, count(*) AS n "
        f"FROM (SELECT city, {_RATIO} AS ratio FROM a) WHERE ratio > 0 AND ratio < 10 "
        "GROUP BY 1 HAVING count(*) >= 100 ORDER BY avg(ratio) DESC, city LIMIT 15"
    ),
)
def a6(spark, folder):
    rows = assessments(spark, folder, ["city", "gross_tax", "total_value"])
    rows = rows.withColumn("ratio", C.ratio_pct("gross_tax", "total_value", 4)).filter(C.between_open("ratio", 0, 10))
    out = groups.group_profile(rows, "city", {"avg_tax_ratio": F.avg("ratio")}, min_n=100, order="avg_tax_ratio", top=15)
    return out.withColumn("avg_tax_ratio", F.round("avg_tax_ratio", 8))

@register(
    "a7_overview",
    over_view(
        "SELECT round(avg(total_value), 6) AS avg_total_value, round(avg(gross_area), 6) AS avg_gross_area, "
        "round(avg(land_value), 6) AS avg_land_value, round(avg(bldg_value), 6) AS avg_bldg_value, "
        "count(DISTINCT lu_desc) AS unique_property_types, count(DISTINCT city) AS unique_cities, "
        "count(DISTINCT zip_code) AS unique_zip_codes FROM a"
    ),
)
def a7(spark, folder):
    rows = assessments(
        spark, folder, ["total_value", "gross_area", "land_value", "bldg_value", "lu_desc", "city", "zip_code"]
    )
    out = overview(
        rows, ["total_value", "gross_area", "land_value", "bldg_value"],
        {"unique_property_types": "lu_desc", "unique_cities": "city", "unique_zip_codes": "zip_code"},
    )
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("avg_") else F.col(c) for c in out.columns])

@register(
    "a11_value_by_zip",
    over_view(
        "SELECT zip_code, round(avg(total_value), 6) AS avg_value, count(*) AS n FROM a GROUP BY 1 "
        "HAVING count(*) >= 50 ORDER BY avg_value DESC, zip_code LIMIT 20"
    ),
)
def a11(spark, folder):
    rows = assessments(spark, folder, ["zip_code", "total_value"])
    metrics = {"avg_value": F.round(F.avg("total_value"), 6)}
    return groups.group_profile(rows, "zip_code", metrics, min_n=50, order="avg_value", top=20)

_CLEAN = "regexp_replace(bldg_type, '^.* - ', '')"

@register(
    "a12_top_building_types",
    over_view(f"SELECT {_CLEAN} AS bldg_type_clean, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, 1 LIMIT 4"),
)
def a12(spark, folder):
    rows = assessments(spark, folder, ["bldg_type"]).select(C.strip_prefix("bldg_type").alias("bldg_type_clean"))
    return groups.top_categories(rows, "bldg_type_clean", n=4)

@register(
    "a12_frequent_use_codes",
    over_view("SELECT lu_desc, count(*) AS n FROM a GROUP BY 1 HAVING count(*) >= 900"),
)
def a12_frequent(spark, folder):
    return groups.top_categories(assessments(spark, folder, ["lu_desc"]), "lu_desc", min_n=900)

def _median_premium(step, lo, hi):
    def run(spark, folder):
        rows = assessments(spark, folder, ["fiscal_year", step, "total_value"])
        # Years and steps within [lo, hi] bound the number of groups.
        out = groups.premium(rows, ["fiscal_year"], step, lo, hi, "total_value", agg="median")
        return out.withColumn("median_value", F.round("median_value", 6))

    return run

for _name, _step, _lo, _hi in (
    ("a13_median_by_bedrooms", "bed_rms", 1, 6),
    ("a13_median_by_bathrooms", "full_bth", 1, 5),
    ("a13_median_by_parking", "num_parking", 0, 5),
):
    register(
        _name,
        over_view(
            f"SELECT fiscal_year, {_step}, round(median(total_value), 6) AS median_value FROM a "
            f"WHERE {_step} BETWEEN {_lo} AND {_hi} GROUP BY 1, 2"
        ),
    )(_median_premium(_step, _lo, _hi))

@register(
    "a13_median_by_building_type",
    over_view(
        f"SELECT fiscal_year, {_CLEAN} AS bldg_type_clean, round(median(total_value), 6) AS median_value FROM a "
        f"WHERE {_CLEAN} IN (SELECT {_CLEAN} FROM a WHERE fiscal_year = {NEW} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4) "
        "GROUP BY 1, 2"
    ),
)
def a13_type(spark, folder):
    rows = assessments(spark, folder, ["fiscal_year", "bldg_type", "total_value"])
    rows = rows.withColumn("bldg_type_clean", C.strip_prefix("bldg_type"))
    top = groups.top_categories(rows.filter(F.col("fiscal_year") == NEW), "bldg_type_clean", n=4)
    kept = groups.keep_categories(rows, "bldg_type_clean", top, at_most=4)
    out = quantiles(kept, "total_value", [0.5], ["fiscal_year", "bldg_type_clean"], names=["median_value"])
    return out.withColumn("median_value", F.round("median_value", 6))

@register("a18_value_range", over_view("SELECT min(total_value) AS low, max(total_value) AS high, min(gross_tax) AS low_tax, max(gross_tax) AS high_tax FROM a"))
def a18(spark, folder):
    rows = assessments(spark, folder, ["total_value", "gross_tax"])
    return rows.agg(
        F.min("total_value").alias("low"), F.max("total_value").alias("high"),
        F.min("gross_tax").alias("low_tax"), F.max("gross_tax").alias("high_tax"),
    )

@register(
    "a19_extreme_city",
    over_view(
        "SELECT city, avg_value FROM (SELECT city, round(avg(total_value), 6) AS avg_value FROM a GROUP BY 1) "
        "ORDER BY avg_value DESC, city LIMIT 1"
    ),
)
def a19(spark, folder):
    rows = assessments(spark, folder, ["city", "total_value"])
    means = rows.groupBy("city").agg(F.round(F.avg("total_value"), 6).alias("avg_value"))
    return groups.extreme_label(means, "city", "avg_value")

@register(
    "a20_conditional_aggregates",
    over_view(
        "SELECT fiscal_year, count(*) FILTER (own_occ = 'Y') AS n_owner, count(*) FILTER (own_occ = 'N') AS n_other, "
        "round(avg(total_value) FILTER (own_occ = 'Y'), 6) AS mean_owner, "
        "round(avg(total_value) FILTER (bed_rms >= 3), 6) AS mean_large FROM a GROUP BY 1"
    ),
)
def a20(spark, folder):
    rows = assessments(spark, folder, ["fiscal_year", "own_occ", "bed_rms", "total_value"])
    owner = F.col("own_occ") == "Y"
    return rows.groupBy("fiscal_year").agg(
        F.count_if(owner).alias("n_owner"), F.count_if(F.col("own_occ") == "N").alias("n_other"),
        F.round(F.avg(F.when(owner, F.col("total_value"))), 6).alias("mean_owner"),
        F.round(F.avg(F.when(F.col("bed_rms") >= 3, F.col("total_value"))), 6).alias("mean_large"),
    )

@register("a26_mean_age", over_view(f"SELECT round(avg({NEW} - yr_built), 9) AS mean_age FROM a"))
def a26(spark, folder):
    return assessments(spark, folder, ["yr_built"]).agg(F.round(F.avg(C.age(NEW, "yr_built")), 9).alias("mean_age"))

@register(
    "f8_having_group_size",
    over_view("SELECT city, round(avg(total_value), 6) AS avg_value, count(*) AS n FROM a GROUP BY 1 HAVING count(*) >= 1800"),
)
def f8(spark, folder):
    rows = assessments(spark, folder, ["city", "total_value"])
    return groups.group_profile(rows, "city", {"avg_value": F.round(F.avg("total_value"), 6)}, min_n=1800)

@register(
    "j3_keep_top_categories",
    over_view(
        "SELECT pid, city FROM a WHERE city IN (SELECT city FROM a GROUP BY 1 ORDER BY count(*) DESC, city LIMIT 5)"
    ),
)
def j3(spark, folder):
    rows = assessments(spark, folder, ["pid", "city"])
    return groups.keep_categories(rows, "city", groups.top_categories(rows, "city", n=5), at_most=5)

@register(
    "t1_top_properties",
    over_view("SELECT pid, total_value FROM a ORDER BY total_value DESC, pid LIMIT 25"),
)
def t1(spark, folder):
    rows = assessments(spark, folder, ["pid", "total_value"])
    return rows.orderBy(F.col("total_value").desc(), "pid").limit(25)

@register("t2_order_by_key", over_view("SELECT num_parking, count(*) AS n FROM a GROUP BY 1 ORDER BY 1"))
def t2(spark, folder):
    return groups.count_by(assessments(spark, folder, ["num_parking"]), "num_parking")

@register(
    "t4_order_by_metric",
    over_view("SELECT bldg_type, round(avg(total_value) / 1000000, 9) AS value_millions, count(*) AS n FROM a GROUP BY 1 ORDER BY 2"),
)
def t4(spark, folder):
    rows = assessments(spark, folder, ["bldg_type", "total_value"])
    metrics = {"value_millions": F.round(F.avg("total_value") / 1e6, 9)}
    return groups.group_profile(rows, "bldg_type", metrics, order="value_millions", descending=False)

@register(
    "w1_share_within_year",
    over_view(
        "SELECT fiscal_year, bldg_type, count(*) AS count, "
        "round(count(*) / sum(count(*)) OVER (PARTITION BY fiscal_year) * 100, 9) AS pct FROM a GROUP BY 1, 2"
    ),
)
def w1(spark, folder):
    rows = assessments(spark, folder, ["fiscal_year", "bldg_type"])
    out = groups.share_within(rows, ["fiscal_year"], "bldg_type")
    return out.withColumn("pct", F.round("pct", 9))
