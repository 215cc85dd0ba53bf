"""The data behind the charts (ids V, A23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gablestat.functions import columns as C
from gablestat.operators import distributions as D
from gablestat.operators.groups import count_by
from gablestat.functions import levels
from gablestat.plans.binding import NEW, OLD, assessments
from gablestat.plans.catalog import over_pair, over_view, register
from gablestat.plans.queries_comparison import _CHANGED, _JOINED, _changes


def _rounded(df, **scales):
    return df.select(*[F.round(c, scales[c]).alias(c) if c in scales else F.col(c) for c in df.columns])


def _width_sql(x: str, w: float, source: str) -> str:
    return (
        f"SELECT CAST(ceil({x} / {w}::DOUBLE - 0.5::DOUBLE) AS BIGINT) AS bin_index, "
        f"round(ceil({x} / {w}::DOUBLE - 0.5::DOUBLE) * {w}::DOUBLE, 9) AS bin_center, count(*) AS count "
        f"FROM {source} WHERE {x} IS NOT NULL GROUP BY 1, 2"
    )


@register("v1_log_value_histogram", over_view(_width_sql("log10(total_value)", 0.1, "a")))
def v1_log(spark, folder):
    rows = assessments(spark, folder, ["total_value"]).select(C.log10_pos("total_value").alias("x"))
    return _rounded(D.histogram_width(rows, "x", 0.1), bin_center=9)


@register("v1_change_histogram", over_pair(_width_sql("value_change_pct", 2.0, "y"), _JOINED, _CHANGED))
def v1_change(spark, folder):
    return _rounded(D.histogram_width(_changes(spark, folder), "value_change_pct", 2.0), bin_center=9)


@register("v1_value_histogram", over_view(_width_sql("total_value", 5000.0, "a")))
def v1_value(spark, folder):
    rows = assessments(spark, folder, ["total_value"])
    return _rounded(D.histogram_width(rows, "total_value", 5000.0), bin_center=9)


def _bins_sql(x: str, n: int) -> str:
    return (
        f"SELECT bin, round(lo + bin * ((hi - lo) / {n}), 6) AS lower, round(lo + (bin + 1) * ((hi - lo) / {n}), 6) AS upper, "
        f"coalesce(c, 0) AS count FROM range({n}) r(bin) CROSS JOIN (SELECT min({x}) AS lo, max({x}) AS hi FROM a) "
        f"LEFT JOIN (SELECT least(CAST(floor(({x} - lo) / (hi - lo) * {n}) AS BIGINT), {n - 1}) AS b, count(*) AS c "
        f"FROM a, (SELECT min({x}) AS lo, max({x}) AS hi FROM a) GROUP BY 1) ON bin = b"
    )


@register("v2_value_histogram_50", over_view(_bins_sql("total_value", 50)))
def v2(spark, folder):
    return _rounded(D.histogram_bins(assessments(spark, folder, ["total_value"]), "total_value", 50), lower=6, upper=6)


@register("v2_tax_histogram_60", over_view(_bins_sql("gross_tax", 60)))
def v2_tax(spark, folder):
    return _rounded(D.histogram_bins(assessments(spark, folder, ["gross_tax"]), "gross_tax", 60), lower=6, upper=6)


def _density_sql(x: str, points: int, where: str) -> str:
    """Linear binning on an even grid between the extremes, then the Gaussian sum."""
    return over_view(
        f"SELECT k.fiscal_year, grid, round(lo + grid * step, 9) AS x, "
        f"round(sum(w * exp(-0.5 * pow((grid - g) * step / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 9) AS density "
        f"FROM k JOIN z ON k.fiscal_year = z.fiscal_year, e, (SELECT CAST(unnest(range({points})) AS INTEGER) AS grid) "
        "GROUP BY k.fiscal_year, grid, lo, step",
        f"r AS (SELECT fiscal_year, {x} AS x FROM a WHERE {where})",
        f"e AS (SELECT min(x) AS lo, (max(x) - min(x)) / {points - 1} AS step FROM r)",
        "z AS (SELECT fiscal_year, count(*) AS n, 0.9 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) "
        "* pow(count(*), -0.2) AS bw FROM r GROUP BY 1)",
        f"b AS (SELECT fiscal_year, least(floor((x - lo) / step), {points - 2}) AS cell, (x - lo) / step - least(floor((x - lo) / step), {points - 2}) AS part FROM r, e)",
        "k AS (SELECT fiscal_year, g, sum(w) AS w FROM (SELECT fiscal_year, cell AS g, 1 - part AS w FROM b UNION ALL "
        "SELECT fiscal_year, cell + 1, part FROM b) GROUP BY 1, 2)",
    )


@register(
    "v3_log_value_density",
    _density_sql("log10(total_value)", 512, f"fiscal_year IN ({OLD}, {NEW})"),
)
def v3(spark, folder):
    rows = assessments(spark, folder, ["fiscal_year", "total_value"], (OLD, NEW))
    rows = rows.select("fiscal_year", C.log10_pos("total_value").alias("x"))
    return _rounded(D.density(rows, "x", ["fiscal_year"], points=512), x=9, density=9)


@register(
    "v3_tax_ratio_density",
    _density_sql("gross_tax / total_value * 100", 512, f"fiscal_year IN ({OLD}, {NEW}) AND gross_tax / total_value * 100 < 5"),
)
def v3_ratio(spark, folder):
    rows = assessments(spark, folder, ["fiscal_year", "total_value", "gross_tax"], (OLD, NEW))
    rows = rows.select("fiscal_year", C.ratio_pct("gross_tax", "total_value").alias("x")).filter("x < 5")
    return _rounded(D.density(rows, "x", ["fiscal_year"], points=512), x=9, density=9)


_COND = (
    "CASE overall_cond WHEN 'P - Poor' THEN 1 WHEN 'VP - Very Poor' THEN 1 WHEN 'F - Fair' THEN 2 WHEN 'A - Average' THEN 3 "
    "WHEN 'AVG - Default - Average' THEN 3 WHEN 'G - Good' THEN 4 WHEN 'VG - Very Good' THEN 4 "
    "WHEN 'E - Excellent' THEN 5 WHEN 'EX - Excellent' THEN 5 END"
)


@register(
    "v4_condition_bars",
    over_view(f"SELECT {_COND} AS level, count(*) AS n FROM a WHERE {_COND} IS NOT NULL GROUP BY 1"),
)
def v4(spark, folder):
    rows = assessments(spark, folder, ["overall_cond"])
    label = C.recode("overall_cond", levels.CONDITION_SYNONYMS)
    return count_by(rows.select(C.ordinal_encode(label, levels.CONDITION_LEVELS).alias("level")), "level")


def _line_sql(x, y, by, source):
    keys = f"{by}, " if by else ""
    return (
        f"SELECT {keys}round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 8) AS intercept, "
        f"round(regr_r2(y, x), 9) AS r2, regr_count(y, x)::BIGINT AS n, "
        f"round(sqrt(greatest(regr_syy(y, x) - pow(regr_slope(y, x), 2) * regr_sxx(y, x), 0) / (regr_count(y, x) - 2)), 8) AS sigma "
        f"FROM (SELECT {keys}{x} AS x, {y} AS y FROM {source}) {'GROUP BY ' + by if by else ''}"
    )


def _fit(rows, by=()):
    out = D.line_fit(rows, "x", "y", by).drop("x_mean", "sxx")
    return _rounded(out, slope=9, intercept=8, r2=9, sigma=8)


@register("v5_value_by_land_line", over_view(_line_sql("log10(land_sf)", "log10(total_value)", "", "a")))
def v5(spark, folder):
    rows = assessments(spark, folder, ["land_sf", "total_value"])
    return _fit(rows.select(C.log10_pos("land_sf").alias("x"), C.log10_pos("total_value").alias("y")))


@register("v5_value_by_area_line_per_type", over_view(_line_sql("ln(living_area)", "ln(total_value)", "bldg_type", "a")))
def v5_type(spark, folder):
    rows = assessments(spark, folder, ["bldg_type", "living_area", "total_value"])
    return _fit(rows.select("bldg_type", C.ln_pos("living_area").alias("x"), C.ln_pos("total_value").alias("y")), ["bldg_type"])


@register(
    "v5_tax_change_line",
    over_pair(
        _line_sql("value_change_pct", "tax_change_pct", "", "(SELECT * FROM y WHERE abs(value_change_pct) < 50 AND abs(tax_change_pct) < 50)"),
        _JOINED, _CHANGED,
    ),
)
def v5_change(spark, folder):
    from gablestat.operators.filters import symmetric_bound

    rows = symmetric_bound(_changes(spark, folder), ["value_change_pct", "tax_change_pct"], 50)
    return _fit(rows.select(F.col("value_change_pct").alias("x"), F.col("tax_change_pct").alias("y")))


@register(
    "v5_line_band",
    over_view(
        "SELECT fiscal_year, round(x, 9) AS x, round(i + s * x, 8) AS fit, round(i + s * x - 1.96 * e * sqrt(1.0 / n + pow(x - xm, 2) / sxx), 8) AS lower, "
        "round(i + s * x + 1.96 * e * sqrt(1.0 / n + pow(x - xm, 2) / sxx), 8) AS upper FROM ("
        "SELECT *, sqrt((syy - s * s * sxx) / (n - 2)) AS e FROM (SELECT fiscal_year, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, "
        "regr_count(y, x) AS n, regr_avgx(y, x) AS xm, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy "
        "FROM (SELECT fiscal_year, ln(land_sf) AS x, ln(total_value) AS y FROM a) GROUP BY 1)), "
        "(SELECT 0.0 + unnest(range(9)) * (4.0 - 0.0) / 8 AS x)"
    ),
)
def v5_band(spark, folder):
    rows = assessments(spark, folder, ["fiscal_year", "land_sf", "total_value"])
    rows = rows.select("fiscal_year", C.ln_pos("land_sf").alias("x"), C.ln_pos("total_value").alias("y"))
    return _rounded(D.line_band(D.line_fit(rows, "x", "y", ["fiscal_year"]), 0.0, 4.0, 9), x=9, fit=8, lower=8, upper=8)


@register(
    "v6_beds_baths_pairs",
    over_view("SELECT bed_rms, full_bth, count(*) AS n FROM a WHERE bed_rms IS NOT NULL AND full_bth IS NOT NULL GROUP BY 1, 2"),
)
def v6(spark, folder):
    return D.pair_counts(assessments(spark, folder, ["bed_rms", "full_bth"]), "bed_rms", "full_bth")


@register(
    "v7_value_tax_grid",
    over_view(
        "SELECT CAST(floor(total_value / 2500) AS BIGINT) AS x_bin, CAST(floor(gross_tax / 250) AS BIGINT) AS y_bin, "
        "count(*) AS n FROM a GROUP BY 1, 2"
    ),
)
def v7(spark, folder):
    return D.grid_counts(assessments(spark, folder, ["total_value", "gross_tax"]), "total_value", "gross_tax", 2500, 250)


_CORR = ["total_value", "land_value", "bldg_value", "gross_tax", "land_sf", "living_area", "bed_rms", "full_bth", "fireplaces", "num_parking"]
_CORR_SQL = " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, " + ("1.0::DOUBLE" if x == y else f"corr({x}, {y})") + " AS r, count(*) AS n FROM a WHERE bed_rms IS NOT NULL"
    for x in _CORR for y in _CORR
)


@register("a23_correlation_matrix", over_view(f"SELECT x, y, round(r, 9) AS r, n FROM ({_CORR_SQL})"))
def a23(spark, folder):
    return _rounded(D.corr_matrix(assessments(spark, folder, _CORR), _CORR), r=9)


@register(
    "a23_strongest_predictor",
    over_view(
        f"SELECT y AS variable, round(r, 9) AS r FROM ({_CORR_SQL}) WHERE x = 'total_value' AND y <> 'total_value' "
        "ORDER BY r DESC LIMIT 1"
    ),
)
def a23_strongest(spark, folder):
    matrix = D.corr_matrix(assessments(spark, folder, _CORR), _CORR)
    return _rounded(D.strongest_correlate(matrix, "total_value"), r=9)


@register(
    "a23_strongest_absolute",
    over_view(
        f"SELECT y AS variable, round(r, 9) AS r FROM ({_CORR_SQL}) WHERE x = 'num_parking' AND y <> 'num_parking' "
        "ORDER BY abs(r) DESC LIMIT 1"
    ),
)
def a23_absolute(spark, folder):
    matrix = D.corr_matrix(assessments(spark, folder, _CORR), _CORR)
    return _rounded(D.strongest_correlate(matrix, "num_parking", absolute=True), r=9)
