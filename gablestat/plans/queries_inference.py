"""Hypothesis tests (ids H). The checks integrate the t and F densities numerically in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gablestat.functions import columns as C
from gablestat.operators import inference as I
from gablestat.operators.quantiles import medians
from gablestat.plans.binding import NEW, OLD, assessments
from gablestat.plans.catalog import over_view, register
from gablestat.plans.cleaning import clean_for_tests
from gablestat.session import cut_lineage

_COLUMNS = ["fiscal_year", "total_value", "gross_tax", "living_area", "land_sf", "yr_built", "bldg_type", "own_occ", "bed_rms"]
_TESTED = (
    "q AS (SELECT fiscal_year, total_value, gross_tax, bed_rms, own_occ, regexp_replace(bldg_type, '^.* - ', '') AS bldg_type_clean, "
    "total_value / living_area AS price_per_sqft, gross_tax / total_value * 100 AS tax_to_value_ratio FROM a "
    f"WHERE total_value > 0 AND gross_tax > 0 AND living_area > 0 AND land_sf > 0 AND yr_built > 1700 AND yr_built <= {NEW} "
    "AND total_value / living_area < 5000)"
)
_STEPS = 20000


def _pair(spark, folder):
    return clean_for_tests(assessments(spark, folder, _COLUMNS, (OLD, NEW)), NEW)


def _current(spark, folder):
    return clean_for_tests(assessments(spark, folder, _COLUMNS, (NEW,)), NEW)


def _simpson(lower: str, density: str, source: str) -> str:
    """Simpson's rule from ``lower`` to pi/2 over columns of a one-row source."""
    h = f"((pi() / 2 - {lower}) / {_STEPS})"
    return (
        f"(SELECT sum((CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({density.format(x=f'({lower} + i * {h})')})) "
        f"* any_value({h}) / 3 FROM {source}, range({_STEPS} + 1) r(i))"
    )


def welch_sql(value: str, group: str, g1: str, g2: str, alternative: str, where: str, prefix: str = "") -> list[str]:
    """CTEs ending in ``<prefix>w``: the finished test as one row."""
    t = f"{prefix}t"
    tail = _simpson(
        "atan(abs(t) / sqrt(df))", "pow(greatest(cos({x}), 0), df - 1)", t
    ) + f" / (SELECT exp(lgamma(0.5) + lgamma(df / 2) - lgamma((df + 1) / 2)) FROM {t})"
    p = {
        "two.sided": "2 * tail", "less": "CASE WHEN t < 0 THEN tail ELSE 1 - tail END",
        "greater": "CASE WHEN t > 0 THEN tail ELSE 1 - tail END",
    }[alternative]
    stats = ", ".join(
        f"count({value}) FILTER ({group} = {g}) AS n{i}, avg({value}) FILTER ({group} = {g}) AS mean{i}, "
        f"var_samp({value}) FILTER ({group} = {g}) AS var{i}" for i, g in ((1, g1), (2, g2))
    )
    return [
        f"{prefix}m AS (SELECT {stats} FROM q WHERE {where})",
        f"{t} AS (SELECT *, (mean1 - mean2) / sqrt(var1 / n1 + var2 / n2) AS t, pow(var1 / n1 + var2 / n2, 2) / "
        f"(pow(var1 / n1, 2) / (n1 - 1) + pow(var2 / n2, 2) / (n2 - 1)) AS df FROM {prefix}m)",
        f"{prefix}w AS (SELECT *, {p} AS p_value FROM (SELECT *, {tail} AS tail FROM {t}))",
    ]


_LABEL = "CASE WHEN p_value < 0.05 THEN 'Reject H0' ELSE 'Fail to Reject H0' END AS decision"
_SHOWN = (
    "SELECT n1, round(mean1, 6) AS mean1, round(sqrt(var1), 5) AS sd1, n2, round(mean2, 6) AS mean2, round(sqrt(var2), 5) AS sd2, "
    f"round(t, 8) AS t, round(df, 4) AS df, round(p_value, 6) AS p_value, {_LABEL} FROM w"
)


def _shown(result):
    scales = {"mean1": 6, "mean2": 6, "sd1": 5, "sd2": 5, "t": 8, "df": 4, "p_value": 6}
    return result.select(*[F.round(c, scales[c]).alias(c) if c in scales else F.col(c) for c in result.columns])


_YEARS = f"fiscal_year IN ({OLD}, {NEW})"
_BEDS = "CASE WHEN bed_rms >= 3 THEN 'more' ELSE 'less' END"


def _h1(spark, folder):
    return I.welch_t(_pair(spark, folder), "total_value", "fiscal_year", OLD, NEW)


def _h2(spark, folder):
    return I.welch_t(_pair(spark, folder), "gross_tax", "fiscal_year", OLD, NEW, "less")


def _h3(spark, folder):
    rows = _current(spark, folder).filter(C.between_closed("bed_rms", 1, 8))
    rows = rows.withColumn("bedroom_group", C.two_group("bed_rms", 3, "3+ bedrooms", "< 3 bedrooms"))
    return I.welch_t(rows, "total_value", "bedroom_group", "3+ bedrooms", "< 3 bedrooms", "greater")


def _h4(spark, folder):
    rows = _current(spark, folder).filter(F.col("own_occ").isin("Y", "N"))
    return I.welch_t(rows, "total_value", "own_occ", "N", "Y")


def _h5(spark, folder):
    return I.welch_t(_pair(spark, folder), "tax_to_value_ratio", "fiscal_year", OLD, NEW, "less")


def _h6(spark, folder):
    return I.welch_t(_pair(spark, folder), "price_per_sqft", "fiscal_year", OLD, NEW)


def _h7(spark, folder):
    return I.anova_oneway(_current(spark, folder), "total_value", "bldg_type_clean", min_n=200)


_WELCH = {
    "h1_value_changed": (_h1, ("total_value", "fiscal_year", str(OLD), str(NEW), "two.sided", _YEARS)),
    "h2_tax_increased": (_h2, ("gross_tax", "fiscal_year", str(OLD), str(NEW), "less", _YEARS)),
    "h3_bedrooms_raise_value": (
        _h3, ("total_value", _BEDS, "'more'", "'less'", "greater", f"fiscal_year = {NEW} AND bed_rms BETWEEN 1 AND 8")
    ),
    "h4_owner_differs": (_h4, ("total_value", "own_occ", "'N'", "'Y'", "two.sided", f"fiscal_year = {NEW}")),
    "h5_ratio_increased": (_h5, ("tax_to_value_ratio", "fiscal_year", str(OLD), str(NEW), "less", _YEARS)),
    "h6_psf_changed": (_h6, ("price_per_sqft", "fiscal_year", str(OLD), str(NEW), "two.sided", _YEARS)),
}
for _name, (_run, _spec) in _WELCH.items():
    register(_name, over_view(_SHOWN, _TESTED, *welch_sql(*_spec)))(
        lambda spark, folder, _run=_run: _shown(_run(spark, folder))
    )


@register(
    "h2_tax_medians",
    over_view(f"SELECT fiscal_year, round(median(gross_tax), 6) AS gross_tax, round(median(tax_to_value_ratio), 8) AS tax_to_value_ratio FROM q WHERE {_YEARS} GROUP BY 1", _TESTED),
)
def h2_medians(spark, folder):
    out = medians(_pair(spark, folder), ["gross_tax", "tax_to_value_ratio"], ["fiscal_year"])
    return out.select("fiscal_year", F.round("gross_tax", 6).alias("gross_tax"), F.round("tax_to_value_ratio", 8).alias("tax_to_value_ratio"))


_ANOVA = [
    f"g AS (SELECT bldg_type_clean, count(*) AS n, avg(total_value) AS mean, var_samp(total_value) AS var FROM q "
    f"WHERE fiscal_year = {NEW} GROUP BY 1 HAVING count(*) >= 200)",
    "o AS (SELECT sum(n * mean) / sum(n) AS grand FROM g)",
    "av AS (SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, sum(n * pow(mean - grand, 2)) AS ss_between, "
    "sum((n - 1) * var) AS ss_within FROM g, o)",
    "af AS (SELECT *, groups - 1 AS df_between, n - groups AS df_within, "
    "(ss_between / (groups - 1)) / (ss_within / (n - groups)) AS f_value FROM av)",
    "aw AS (SELECT *, 2 * " + _simpson(
        "atan(sqrt(df_between * f_value / df_within))", "pow(greatest(cos({x}), 0), df_within - 1) * pow(sin({x}), df_between - 1)", "af"
    ) + " / (SELECT exp(lgamma(df_between / 2) + lgamma(df_within / 2) - lgamma((df_between + df_within) / 2)) FROM af) AS p_value FROM af)",
]


@register(
    "h7_anova_building_type",
    over_view(
        "SELECT groups, n, df_between, df_within, round(ss_between / 1000000, 3) AS ss_between_millions, "
        f"round(ss_within / 1000000, 2) AS ss_within_millions, round(f_value, 8) AS f_value, round(p_value, 6) AS p_value, {_LABEL} FROM aw",
        _TESTED, *_ANOVA,
    ),
)
def h7(spark, folder):
    return _h7(spark, folder).select(
        "groups", "n", "df_between", "df_within", F.round(F.col("ss_between") / 1e6, 3).alias("ss_between_millions"),
        F.round(F.col("ss_within") / 1e6, 2).alias("ss_within_millions"), F.round("f_value", 8).alias("f_value"),
        F.round("p_value", 6).alias("p_value"), "decision",
    )


# Normal distribution function by its odd power series, whose n-th term is x^(2n+1) / (2n+1)!!.
_TUKEY = [
    "u AS (SELECT a.bldg_type_clean AS group1, b.bldg_type_clean AS group2, b.mean - a.mean AS diff, "
    "abs(b.mean - a.mean) / sqrt(ss_within / df_within / 2 * (1.0 / a.n + 1.0 / b.n)) AS q, groups AS k, df_within AS df "
    "FROM g a JOIN g b ON a.bldg_type_clean < b.bldg_type_clean, af)",
    "zz AS (SELECT -8.0 + i * 0.08 AS z, (CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 0.08 / 3 "
    "* exp(-0.5 * pow(-8.0 + i * 0.08, 2)) / sqrt(2 * pi()) AS wz FROM range(201) r(i))",
    "ss AS (SELECT 1 + (i - 16) / 2.0 / sqrt(2 * df) AS s, (CASE WHEN i IN (0, 32) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) AS c, df "
    "FROM range(33) r(i), (SELECT df_within AS df FROM af))",
    "sw AS (SELECT s, c * exp((df - 1) * ln(s) - df * (s * s - 1) / 2) AS ws FROM ss)",
    "pt AS (SELECT group1, group2, z, wz, s, ws / (SELECT sum(ws) FROM sw) AS ws, k, z - q * s AS x FROM u, zz, sw)",
    "xs AS (SELECT DISTINCT x FROM (SELECT x FROM pt UNION ALL SELECT z FROM zz))",
    "cdf AS (SELECT x, CASE WHEN x <= -8.5 THEN 0 ELSE 0.5 + sign(x) * exp(-0.5 * x * x) / sqrt(2 * pi()) * "
    "(SELECT sum(exp((2 * n + 1) * ln(abs(x) + 1e-300) - ((n + 1) * ln(2) + lgamma(n + 1.5) - 0.5 * ln(pi())))) FROM range(160) r(n)) END AS phi FROM xs)",
    "pr AS (SELECT group1, group2, sum(ws * k * wz * pow(greatest(hi.phi - lo.phi, 0), k - 1)) AS inside FROM pt "
    "JOIN cdf lo ON pt.x = lo.x JOIN cdf hi ON pt.z = hi.x GROUP BY 1, 2)",
]


@register(
    "h8_tukey_pairs",
    over_view(
        "SELECT u.group1, u.group2, round(diff, 6) AS diff, round(q, 8) AS q, round(1 - inside, 5) AS p_adj "
        "FROM u JOIN pr ON u.group1 = pr.group1 AND u.group2 = pr.group2",
        _TESTED, *_ANOVA, *_TUKEY,
    ),
)
def h8(spark, folder):
    out = I.tukey_hsd(_current(spark, folder), "total_value", "bldg_type_clean", min_n=200)
    return out.select("group1", "group2", F.round("diff", 6).alias("diff"), F.round("q", 8).alias("q"), F.round("p_adj", 5).alias("p_adj"))


@register("h8_tukey_intervals")
def h8_intervals(spark, folder):
    out = I.tukey_hsd(_current(spark, folder), "total_value", "bldg_type_clean", min_n=200)
    return out.select("group1", "group2", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


_REPORT = {
    "H1: Property values changed": "h1_value_changed",
    "H2: Gross tax increased": "h2_tax_increased",
    "H3: 3+ bedrooms command higher values": "h3_bedrooms_raise_value",
    "H4: Owner-occupied differ in value": "h4_owner_differs",
    "H5: Tax-to-value ratio increased": "h5_ratio_increased",
}
_REPORT_CTES = [cte for i, key in enumerate(_REPORT.values()) for cte in welch_sql(*_WELCH[key][1], prefix=f"x{i}")]
_REPORT_SQL = " UNION ALL ".join(
    [f"SELECT '{label}' AS hypothesis, round(p_value, 6) AS p_value, {_LABEL} FROM x{i}w" for i, label in enumerate(_REPORT)]
    + [f"SELECT 'ANOVA: Building type affects value' AS hypothesis, round(p_value, 6) AS p_value, {_LABEL} FROM aw"]
)


@register("h9_hypothesis_report", over_view(_REPORT_SQL, _TESTED, *_REPORT_CTES, *_ANOVA))
def h9(spark, folder):
    new = F.col("fiscal_year") == NEW
    groupings = {
        "snapshot": F.col("fiscal_year"),
        "bedrooms": F.when(new & C.between_closed("bed_rms", 1, 8), C.two_group("bed_rms", 3, "3+ bedrooms", "< 3 bedrooms")),
        "owner": F.when(new & F.col("own_occ").isin("Y", "N"), F.col("own_occ")),
        "type": F.when(new, F.col("bldg_type_clean")),
    }
    table = cut_lineage(I.moment_table(_pair(spark, folder), groupings, ["total_value", "gross_tax", "tax_to_value_ratio"]))
    old, now = str(OLD), str(NEW)
    tests = [
        ("snapshot", "total_value", old, now, "two.sided"), ("snapshot", "gross_tax", old, now, "less"),
        ("bedrooms", "total_value", "3+ bedrooms", "< 3 bedrooms", "greater"), ("owner", "total_value", "N", "Y", "two.sided"),
        ("snapshot", "tax_to_value_ratio", old, now, "less"),
    ]
    results = {label: I.welch_from(table, *test) for label, test in zip(_REPORT, tests)}
    results["ANOVA: Building type affects value"] = I.anova_from(table, "type", "total_value", min_n=200)
    return I.hypothesis_report(results)


# The critical value by halving an interval, the coverage of each middle integrated as for the p-values.
_PHI = (
    "(CASE WHEN {x} <= -8.5 THEN 0 ELSE 0.5 + sign({x}) * exp(-0.5 * {x} * {x}) / sqrt(2 * pi()) * "
    "list_sum(list_transform(range(120), lambda m: exp((2 * m + 1) * ln(abs({x}) + 1e-300) - ((m + 1) * ln(2) + lgamma(m + 1.5) - 0.5 * ln(pi()))))) END)"
)
_CRITICAL = [
    f"zp AS MATERIALIZED (SELECT z, wz, {_PHI.format(x='z')} AS hi FROM zz)",
    "bis(it, lo, up) AS (SELECT 0, 0.0::DOUBLE, 16.0::DOUBLE UNION ALL SELECT it + 1, CASE WHEN inside < 0.95 THEN mid ELSE lo END, "
    "CASE WHEN inside < 0.95 THEN up ELSE mid END FROM (SELECT it, any_value(lo) AS lo, any_value(up) AS up, any_value(mid) AS mid, "
    "sum(ws / (SELECT sum(ws) FROM sw) * k * wz * pow(greatest(hi - " + _PHI.format(x="(z - mid * s)") + ", 0), k - 1)) AS inside "
    "FROM (SELECT it, lo, up, (lo + up) / 2 AS mid FROM bis WHERE it < 34), zp, sw, (SELECT groups AS k FROM af) GROUP BY it))",
    "cv AS (SELECT (lo + up) / 2 AS c FROM bis WHERE it = 34)",
]


@register(
    "h8_tukey_bounds",
    over_view(
        "SELECT group1, group2, round(c, 4) AS critical, sign(diff - c * noise) AS lower_sign, sign(diff + c * noise) AS upper_sign, "
        "CAST(round((diff + c * noise) / 10) AS BIGINT) AS upper_tens FROM (SELECT *, abs(diff) / q AS noise FROM u), cv",
        _TESTED, *_ANOVA, *[c for c in _TUKEY if c.split(" ")[0] in ("u", "zz", "ss", "sw")], *_CRITICAL,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def h8_bounds(spark, folder):
    """The bounds of the intervals against a critical value that SQL finds by itself."""
    out = I.tukey_hsd(_current(spark, folder), "total_value", "bldg_type_clean", min_n=200)
    noise = F.abs("diff") / F.col("q")
    return out.select(
        "group1", "group2", F.round((F.col("upper") - F.col("diff")) / noise, 4).alias("critical"), F.signum("lower").cast("tinyint").alias("lower_sign"),
        F.signum("upper").cast("tinyint").alias("upper_sign"), F.round(F.col("upper") / 10).cast("bigint").alias("upper_tens"))
