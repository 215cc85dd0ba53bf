"""Data quality and descriptive profiles (ids A8-A10, A14-A17, A24, U3, U5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gablestat.functions import columns as C
from gablestat.functions.levels import BOOSTED_FEATURES
from gablestat.operators import filters, groups, profile
from gablestat.operators.quantiles import medians
from gablestat.plans.binding import EVERY, NEW, assessments
from gablestat.plans.catalog import over_view, register
from gablestat.session import cut_lineage

NUMBERS = ["total_value", "land_value", "bldg_value", "gross_tax", "land_sf", "living_area", "bed_rms", "full_bth", "yr_built"]


def _stack(template: str, cols, joiner=" UNION ALL ") -> str:
    return joiner.join(template.format(c=c) for c in cols)


def _rounded(df, scales):
    return df.select(*[F.round(c, scales[c]).alias(c) if c in scales else F.col(c) for c in df.columns])


@register(
    "a8_describe",
    over_view(
        _stack(
            "SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, "
            "CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM a", NUMBERS
        )
    ),
)
def a8(spark, folder):
    out = profile.describe_numeric(assessments(spark, folder, NUMBERS), NUMBERS).drop("missing")
    return _rounded(out, {"mean": 6, "stddev": 6})


@register(
    "a9_summary",
    over_view(
        _stack(
            "SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1, "
            "round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median, round(avg({c}), 6) AS mean, "
            "round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3, CAST(max({c}) AS DOUBLE) AS max, "
            "count(*) - count({c}) AS missing FROM a", NUMBERS
        )
    ),
)
def a9(spark, folder):
    out = profile.summary_r(assessments(spark, folder, NUMBERS), NUMBERS)
    return _rounded(out, {"q1": 6, "median": 6, "mean": 6, "q3": 6})


@register(
    "a10_medians",
    over_view(
        "SELECT round(median(total_value), 6) AS total_value, round(median(gross_tax), 6) AS gross_tax, "
        "round(median(total_value / living_area), 6) AS price_per_sqft, "
        "round(median(gross_tax / total_value * 100), 6) AS tax_to_value_ratio FROM a"
    ),
)
def a10(spark, folder):
    rows = assessments(spark, folder, ["total_value", "gross_tax", "living_area"]).withColumns(
        {"price_per_sqft": C.price_per_area("total_value", "living_area"),
         "tax_to_value_ratio": C.ratio_pct("gross_tax", "total_value")}
    )
    cols = ["total_value", "gross_tax", "price_per_sqft", "tax_to_value_ratio"]
    return _rounded(medians(rows, cols), {c: 6 for c in cols})


_GAPPY = [*EVERY, "land_ratio", "unit"]
_GAPPY_SQL = """g AS (
  SELECT *, gross_tax / nullif(land_value, 0) AS land_ratio,
         CASE WHEN num_parking < 6 THEN 'P' END AS unit FROM a
)"""


def _gappy(spark, folder):
    return assessments(spark, folder, EVERY).select(
        "*", F.try_divide("gross_tax", "land_value").alias("land_ratio"),
        F.when(F.col("num_parking") < 6, "P").alias("unit"),
    )


_MISSING = _stack(
    "SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
    "round((count(*) - count({c})) * 100.0 / count(*), 9) AS missing_pct FROM g", _GAPPY
)


@register(
    "a14_missing_profile",
    over_view(f"SELECT \"column\", missing_count, CAST(missing_pct AS DOUBLE) AS missing_pct FROM ({_MISSING}) WHERE missing_count > 0", _GAPPY_SQL),
)
def a14(spark, folder):
    return _rounded(profile.missing_profile(_gappy(spark, folder)), {"missing_pct": 9})


@register(
    "a15_columns_over_missing",
    over_view(
        f"SELECT \"column\", CAST(round(missing_pct / 100, 9) AS DOUBLE) AS missing_fraction FROM ({_MISSING}) WHERE missing_pct > 10",
        _GAPPY_SQL,
    ),
)
def a15(spark, folder):
    return _rounded(profile.columns_over_missing(_gappy(spark, folder), 0.1), {"missing_fraction": 9})


_DUP_SQL = (
    "SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows "
    "FROM (SELECT count(*) AS n FROM a GROUP BY pid, fiscal_year, bed_rms, own_occ)"
)
_DUP_COLS = ["pid", "fiscal_year", "bed_rms", "own_occ"]


@register("a16_duplicate_rows", over_view(_DUP_SQL))
def a16(spark, folder):
    return profile.duplicate_count(assessments(spark, folder, _DUP_COLS))


@register("a16_duplicate_rows_by_digest", over_view(_DUP_SQL))
def a16_digest(spark, folder):
    return profile.duplicate_count(assessments(spark, folder, _DUP_COLS), digest=True)


@register(
    "a16_duplicate_whole_rows",
    over_view(
        "SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows "
        f"FROM (SELECT count(*) AS n FROM a GROUP BY {', '.join(EVERY)})"
    ),
)
def a16_whole(spark, folder):
    return profile.duplicate_count(assessments(spark, folder, EVERY), digest=True)


_SKEWED = ["total_value", "land_value", "gross_tax", "tax_squared", "bed_rms"]
_SKEWED_SQL = "k AS (SELECT total_value, land_value, gross_tax, gross_tax * gross_tax AS tax_squared, bed_rms FROM a)"
_FENCE = (
    "SELECT '{c}' AS \"column\", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - (q3 - q1) * 1.5, 6) AS lo, "
    "round(q3 + (q3 - q1) * 1.5, 6) AS hi, "
    "(SELECT count(*) FROM k WHERE {c} < q1 - (q3 - q1) * 1.5 OR {c} > q3 + (q3 - q1) * 1.5) AS n_outliers "
    "FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM k)"
)


def _skewed(spark, folder):
    rows = assessments(spark, folder, ["total_value", "land_value", "gross_tax", "bed_rms"])
    return rows.withColumn("tax_squared", F.col("gross_tax") * F.col("gross_tax"))


@register("a17_outlier_profile", over_view(_stack(_FENCE, _SKEWED), _SKEWED_SQL))
def a17(spark, folder):
    out = profile.outlier_profile(_skewed(spark, folder), _SKEWED)
    return _rounded(out, {c: 6 for c in ("q1", "q3", "lo", "hi")})


@register(
    "a17_most_outliers",
    over_view(
        f"SELECT \"column\", n_outliers FROM ({_stack(_FENCE, _SKEWED)}) ORDER BY n_outliers DESC, \"column\" LIMIT 1", _SKEWED_SQL
    ),
)
def a17_most(spark, folder):
    return groups.extreme_label(profile.outlier_profile(_skewed(spark, folder), _SKEWED), "column", "n_outliers")


_MODES = ["city", "bldg_type", "bed_rms", "overall_cond"]


@register(
    "a24_modes",
    over_view(
        _stack(
            "SELECT * FROM (SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS mode, count(*) AS n FROM a WHERE {c} IS NOT NULL "
            "GROUP BY {c} ORDER BY n DESC, mode LIMIT 1)", _MODES
        )
    ),
)
def a24(spark, folder):
    return profile.value_modes(assessments(spark, folder, _MODES), _MODES)


@register("u3_distinct_rows", over_view("SELECT DISTINCT pid, fiscal_year, bed_rms, own_occ FROM a"))
def u3(spark, folder):
    return assessments(spark, folder, _DUP_COLS).dropDuplicates()


@register("u3_distinct_whole_rows", over_view("SELECT DISTINCT * FROM a"))
def u3_whole(spark, folder):
    # order_key is part of record_id, so it parts no equal rows; with it they meet where the join with orders put them
    return assessments(spark, folder, [*EVERY, "order_key"]).dropDuplicates().drop("order_key")


@register(
    "u5_unpivot",
    over_view("SELECT \"column\", value FROM (SELECT CAST(min(total_value) AS DOUBLE) AS low, CAST(max(total_value) AS DOUBLE) AS high, "
              "CAST(count(*) AS DOUBLE) AS size FROM a) UNPIVOT (value FOR \"column\" IN (low, high, size))"),
)
def u5(spark, folder):
    rows = assessments(spark, folder, ["total_value"])
    one = rows.agg(
        F.min("total_value").alias("low"), F.max("total_value").alias("high"), F.count(F.lit(1)).cast("double").alias("size")
    )
    return one.unpivot([], ["low", "high", "size"], "column", "value")


@register(
    "t3_sorted_profile",
    over_view(f"SELECT \"column\", missing_count FROM ({_MISSING}) WHERE missing_count > 0 ORDER BY 2 DESC, 1 LIMIT 2", _GAPPY_SQL),
)
def t3(spark, folder):
    return profile.missing_profile(_gappy(spark, folder)).select("column", "missing_count").limit(2)


_DISTINCTS = ["pid", "city", "zip_code", "lu_desc", "bldg_type"]


@register(
    "a7_distinct_sketches",
    over_view(_stack(
        f"SELECT '{{c}}' AS \"column\", count(DISTINCT {{c}}) FILTER (fiscal_year = {NEW}) AS of_last, count(DISTINCT {{c}}) AS of_all, true AS near_last, true AS near_all FROM a",
        _DISTINCTS)),
)
def a7_sketches(spark, folder):
    """Exact distinct counts of the last snapshot and of all, and whether the stored sketches of the snapshots come within four standard errors."""
    rows = assessments(spark, folder, ["fiscal_year", *_DISTINCTS])
    sketches = cut_lineage(profile.distinct_sketches(rows, "fiscal_year", _DISTINCTS))
    last = profile.merged_distincts(sketches.where(F.col("fiscal_year") == NEW)).withColumnRenamed("estimate", "e_last")
    every = profile.merged_distincts(sketches).withColumnRenamed("estimate", "e_all")
    new = F.col("fiscal_year") == NEW
    exact = rows.agg(*[F.struct(F.countDistinct(F.when(new, F.col(c))).alias("of_last"), F.countDistinct(c).alias("of_all")).alias(c) for c in _DISTINCTS])
    exact = exact.unpivot([], _DISTINCTS, "column", "n").select("column", "n.*")
    error = 4 * 1.04 / 2 ** (profile.SKETCH_BITS / 2)

    def near(estimate, count):
        return (F.abs(F.col(estimate) - F.col(count)) <= F.col(count) * error + 1).alias(f"near_{count[3:]}")

    return exact.join(last, "column").join(every, "column").select("column", "of_last", "of_all", near("e_last", "of_last"), near("e_all", "of_all"))


_ROLL = [c for c in EVERY if c not in ("pid", "record_id", "fiscal_year", "total_value", "lu_desc")]


@register(
    "u4_wanted_columns",
    over_view(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {'true' if c in _ROLL else 'false'} AS present, {f'count({c}) AS filled FROM a' if c in _ROLL else 'CAST(NULL AS BIGINT) AS filled'}"
        for c in BOOSTED_FEATURES)),
)
def u4(spark, folder):
    """Which of the boosted model's columns the roll has, and how many of its rows fill them."""
    rows = assessments(spark, folder, _ROLL)
    found, absent = filters.split_names(rows, BOOSTED_FEATURES)
    have = rows.agg(*[F.count(c).alias(c) for c in found]).unpivot([], found, "column", "filled")
    lost = spark.createDataFrame([(c,) for c in absent], "column string").select("column", F.lit(None).cast("long").alias("filled"))
    return have.unionByName(lost).select("column", F.col("filled").isNotNull().alias("present"), "filled")
