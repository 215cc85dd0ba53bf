"""Linear models (ids R, J4, E27). The checks orthogonalise the predictors one by one in SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import functions as F

from gablestat.functions import columns as C
from gablestat.functions.levels import REGRESSION_FEATURES
from gablestat.operators import distributions, groups, regression as R
from gablestat.plans.binding import NEW, OLD, assessments
from gablestat.plans.catalog import over_view, register
from gablestat.plans.cleaning import clean_for_regression

_COLUMNS = [
    "pid", "fiscal_year", "total_value", "gross_tax", "living_area", "land_sf", "yr_built", "bed_rms", "full_bth", "hlf_bth",
    "num_parking", "fireplaces", "bldg_type",
]
_Y = "log_total_value"
_MODELED = (
    "q AS (SELECT pid, fiscal_year, ln(total_value) AS log_total_value, ln(land_sf) AS log_land_sf, ln(living_area) AS log_living_area, "
    "bed_rms, full_bth, hlf_bth, fireplaces, num_parking, fiscal_year - yr_built AS age_of_property, "
    f"regexp_replace(bldg_type, '^.* - ', '') AS bldg_type_clean FROM a WHERE fiscal_year IN ({OLD}, {NEW}) AND total_value > 0 "
    f"AND gross_tax > 0 AND living_area > 0 AND land_sf > 0 AND yr_built > 1700 AND yr_built <= {NEW} "
    "AND bed_rms BETWEEN 0 AND 10 AND full_bth BETWEEN 0 AND 8)"
)


def _rows(spark, folder, years=(OLD, NEW)):
    return clean_for_regression(assessments(spark, folder, _COLUMNS, years), NEW)


def ols_sql(source: str, y: str, xs: Mapping[str, str], by: str = "", prefix: str = "") -> list[str]:
    """CTEs ending in ``<prefix>coef``: the coefficient table of a least-squares fit.

    Each predictor is cleared of the ones before it; the triangle of projections is then
    solved backwards. ``xs`` maps term names to expressions.
    """
    k = len(xs)
    keys = f"{by}, " if by else ""
    window = f"WINDOW w AS ({'PARTITION BY ' + by if by else ''})"
    names = [f"v{i}" for i in range(k + 1)]
    exprs = [y, *xs.values()]
    base = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for e, n in zip(exprs, names))
    ctes = [
        f"{prefix}b AS (SELECT * FROM (SELECT {keys}{base} FROM {source}) WHERE {' AND '.join(n + ' IS NOT NULL' for n in names)})",
        f"{prefix}h0 AS (SELECT {keys}" + ", ".join(f"avg({n}) OVER w AS mu{n[1:]}, {n} - avg({n}) OVER w AS {n}" for n in names)
        + f" FROM {prefix}b {window})",
    ]
    for j in range(1, k + 1):
        later = [*range(j + 1, k + 1), 0]
        total = ", sum(v0 * v0) OVER w AS syy" if j == 1 else ""
        ratios = ", ".join(f"sum(v{j} * v{i}) OVER w / sum(v{j} * v{j}) OVER w AS r{j}_{i}" for i in later)
        ctes.append(f"{prefix}g{j} AS (SELECT *{total}, {ratios} FROM {prefix}h{j - 1} {window})")
        ctes.append(
            f"{prefix}h{j} AS (SELECT * REPLACE (" + ", ".join(f"v{i} - r{j}_{i} * v{j} AS v{i}" for i in later) + f") FROM {prefix}g{j})"
        )
    carried = [f"any_value(mu{i}) AS mu{i}" for i in range(k + 1)]
    carried += [f"any_value(r{j}_{i}) AS r{j}_{i}" for j in range(1, k + 1) for i in [*range(j + 1, k + 1), 0]]
    carried += [f"sum(v{j} * v{j}) AS d{j}" for j in range(1, k + 1)]
    ctes.append(
        f"{prefix}t AS (SELECT {keys}count(*) AS n, sum(v0 * v0) AS rss, any_value(syy) AS syy, {', '.join(carried)} "
        f"FROM {prefix}h{k} {'GROUP BY ' + by if by else ''})"
    )
    # One subquery per step, so that no expression repeats the ones below it.
    last = f"{prefix}t"

    def step(name: str, columns: list[str]) -> None:
        nonlocal last
        ctes.append(f"{prefix}{name} AS (SELECT *, {', '.join(columns)} FROM {last})")
        last = f"{prefix}{name}"

    for j in range(k, 0, -1):
        step(f"bk{j}", [f"r{j}_0" + "".join(f" - r{j}_{i} * b{i}" for i in range(j + 1, k + 1)) + f" AS b{j}"])
    step("ud0", [f"1.0::DOUBLE AS u{i}_{i}" for i in range(1, k + 1)])
    for gap in range(1, k):
        step(f"ud{gap}", [
            "-(" + " + ".join(f"r{j}_{m} * u{m}_{j + gap}" for m in range(j + 1, j + gap + 1)) + f") AS u{j}_{j + gap}"
            for j in range(1, k - gap + 1)
        ])
    step("sv", [f"rss / (n - {k + 1}) AS s2"])
    solved = []
    solved.append(f"n - {k + 1} AS free")
    solved.append("mu0" + "".join(f" - b{j} * mu{j}" for j in range(1, k + 1)) + " AS b0")
    spread = " + ".join(
        "pow(" + " + ".join(f"mu{j} * u{j}_{i}" for j in range(1, i + 1)) + f", 2) / d{i}" for i in range(1, k + 1)
    )
    solved.append(f"sqrt(s2 * (1.0 / n + {spread})) AS e0")
    for j in range(1, k + 1):
        solved.append("sqrt(s2 * (" + " + ".join(f"u{j}_{i} * u{j}_{i} / d{i}" for i in range(j, k + 1)) + f")) AS e{j}")
    solved.append("1 - rss / syy AS r2")
    solved.append("1 - (1 - r2) * (n - 1) / free AS adj_r2")
    solved.append(f"(syy - rss) / {k} / s2 AS f_value")
    ctes.append(f"{prefix}s AS (SELECT *, {', '.join(solved)} FROM {last})")
    terms = " UNION ALL ".join(
        f"SELECT {keys}{i} AS position, '{term}' AS term, b{i} AS estimate, e{i} AS std_error, b{i} / e{i} AS t_value, n, free, r2, adj_r2, "
        f"sqrt(s2) AS sigma, f_value FROM {prefix}s" for i, term in enumerate(["(Intercept)", *xs])
    )
    ctes.append(f"{prefix}l AS ({terms})")
    ctes.append(
        f"{prefix}coef AS (SELECT {keys}position, any_value(term) AS term, any_value(estimate) AS estimate, any_value(std_error) AS std_error, "
        "any_value(t_value) AS t_value, any_value(n) AS n, any_value(r2) AS r2, any_value(adj_r2) AS adj_r2, any_value(sigma) AS sigma, "
        "any_value(f_value) AS f_value, 2 * sum((CASE WHEN i IN (0, 10000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * "
        "pow(greatest(cos(lo + i * (pi() / 2 - lo) / 10000), 0), free - 1)) * any_value((pi() / 2 - lo) / 10000) / 3 / "
        "any_value(exp(lgamma(0.5) + lgamma(free / 2) - lgamma((free + 1) / 2))) AS p_value "
        f"FROM (SELECT *, atan(abs(t_value) / sqrt(free)) AS lo FROM {prefix}l), range(10001) r(i) GROUP BY {keys}position)"
    )
    return ctes


_SCALES = {"estimate": 8, "std_error": 8, "t_value": 5, "p_value": 6, "r2": 8, "adj_r2": 8, "sigma": 8, "f_value": 5,
           "ci_lower": 8, "ci_upper": 8, "change": 8, "estimate_old": 8, "estimate_new": 8}


def _rounded(df, *cols):
    return df.select(*[F.round(c, _SCALES[c]).alias(c) if c in _SCALES else F.col(c) for c in (cols or df.columns)])


def _pick(*cols):
    return "SELECT " + ", ".join(f"round({c}, {_SCALES[c]}) AS {c}" if c in _SCALES else c for c in cols)


_TABLE = ("fiscal_year", "term", "estimate", "std_error", "t_value", "p_value", "n", "r2", "adj_r2")
_EIGHT = {c: c for c in REGRESSION_FEATURES}


def _eight(spark, folder, **options):
    return R.ols(_rows(spark, folder), _Y, REGRESSION_FEATURES, by=["fiscal_year"], **options)


for _name, _x in (("r1_value_on_land", "log_land_sf"), ("r1_value_on_living_area", "log_living_area")):
    register(_name, over_view(_pick(*_TABLE) + " FROM coef", _MODELED, *ols_sql("q", _Y, {_x: _x}, "fiscal_year")))(
        lambda spark, folder, _x=_x: _rounded(R.ols(_rows(spark, folder), _Y, [_x], by=["fiscal_year"]), *_TABLE)
    )


@register("r2_eight_features", over_view(_pick(*_TABLE) + " FROM coef", _MODELED, *ols_sql("q", _Y, _EIGHT, "fiscal_year")))
def r2(spark, folder):
    return _rounded(_eight(spark, folder), *_TABLE)


@register(
    "r2_model_summary",
    over_view(
        _pick("fiscal_year", "n", "r2", "adj_r2", "sigma", "f_value") + " FROM coef WHERE position = 0", _MODELED,
        *ols_sql("q", _Y, _EIGHT, "fiscal_year"),
    ),
)
def r2_summary(spark, folder):
    return _rounded(R.fit_summary(_eight(spark, folder), ["fiscal_year"]), "fiscal_year", "n", "r2", "adj_r2", "sigma", "f_value")


_FIRE = {**{c: c for c in REGRESSION_FEATURES if c != "fireplaces"},
         **{f"fireplaces{i}": f"CASE WHEN fireplaces = {i} THEN 1 ELSE 0 END" for i in (1, 2, 3)}}


@register(
    "r2_fireplaces_as_category",
    over_view(_pick(*_TABLE) + " FROM coef", _MODELED, *ols_sql("q", _Y, _FIRE, "fiscal_year")),
)
def r2_category(spark, folder):
    numeric = [c for c in REGRESSION_FEATURES if c != "fireplaces"]
    return _rounded(R.ols(_rows(spark, folder), _Y, numeric, ["fireplaces"], by=["fiscal_year"]), *_TABLE)


_SEVEN = [c for c in REGRESSION_FEATURES if c != "hlf_bth"]
_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _type_terms(ref):
    out = {c: c for c in _SEVEN}
    for level in _TYPES:
        if level != ref:
            out[f"bldg_type_clean{level}"] = f"CASE WHEN bldg_type_clean = '{level}' THEN 1 ELSE 0 END"
    return out


_FREQUENT = (
    f"qt AS (SELECT * FROM q WHERE fiscal_year = {NEW} AND bldg_type_clean IN "
    f"(SELECT bldg_type_clean FROM q WHERE fiscal_year = {NEW} GROUP BY 1 HAVING count(*) >= 200))"
)
_TYPED = ("term", "estimate", "std_error", "t_value", "p_value", "n", "r2", "adj_r2")


def _typed(spark, folder, ref):
    return R.ols(_rows(spark, folder, (NEW,)), _Y, _SEVEN, ["bldg_type_clean"], {"bldg_type_clean": ref}, min_level_n=200)


@register("r3_type_dummies", over_view(_pick(*_TYPED) + " FROM coef", _MODELED, _FREQUENT, *ols_sql("qt", _Y, _type_terms("STANDARD"))))
def r3(spark, folder):
    return _rounded(_typed(spark, folder, "STANDARD"), *_TYPED)


# City and ZIP in coarse bands, since SQL clears one dummy after the other.
_PLACE_COLUMNS = [*_COLUMNS, "city", "zip_code"]
_PLACED = (
    "qp AS (SELECT ln(total_value) AS log_total_value, ln(living_area) AS log_living_area, fiscal_year - yr_built AS age_of_property, "
    "regexp_replace(bldg_type, '^.* - ', '') AS bldg_type_clean, CASE WHEN city < 'NATION_16' THEN 'A' WHEN city < 'NATION_3' THEN 'B' ELSE 'C' END AS city_band, "
    f"CAST(CAST(zip_code AS INTEGER) % 4 AS VARCHAR) AS zip_band FROM a WHERE fiscal_year = {NEW} AND total_value > 0 "
    f"AND gross_tax > 0 AND living_area > 0 AND land_sf > 0 AND yr_built > 1700 AND yr_built <= {NEW} AND bed_rms BETWEEN 0 AND 10 AND full_bth BETWEEN 0 AND 8)"
)
_PLACE_TERMS = {
    "log_living_area": "log_living_area", "age_of_property": "age_of_property",
    **{f"bldg_type_clean{v}": f"CASE WHEN bldg_type_clean = '{v}' THEN 1 ELSE 0 END" for v in _TYPES[1:]},
    **{f"city_band{v}": f"CASE WHEN city_band = '{v}' THEN 1 ELSE 0 END" for v in "BC"},
    **{f"zip_band{v}": f"CASE WHEN zip_band = '{v}' THEN 1 ELSE 0 END" for v in "123"},
}


@register("r3_type_city_and_zip", over_view(_pick(*_TYPED) + " FROM coef", _PLACED, *ols_sql("qp", _Y, _PLACE_TERMS)))
def r3_places(spark, folder):
    rows = clean_for_regression(assessments(spark, folder, _PLACE_COLUMNS, (NEW,)), NEW)
    rows = rows.withColumns({
        "city_band": F.when(F.col("city") < "NATION_16", "A").when(F.col("city") < "NATION_3", "B").otherwise("C"),
        "zip_band": (F.col("zip_code").cast("int") % 4).cast("string"),
    })
    return _rounded(R.ols(rows, _Y, ["log_living_area", "age_of_property"], ["bldg_type_clean", "city_band", "zip_band"]), *_TYPED)


@register("r7_other_reference_level", over_view(_pick(*_TYPED) + " FROM coef", _MODELED, _FREQUENT, *ols_sql("qt", _Y, _type_terms("PROMO"))))
def r7(spark, folder):
    return _rounded(_typed(spark, folder, "PROMO"), *_TYPED)


@register(
    "r4_tidy_coefficients",
    over_view(
        "SELECT fiscal_year, term, round(estimate, 8) AS estimate, round(estimate - std_error * 1.96, 8) AS ci_lower, "
        "round(estimate + std_error * 1.96, 8) AS ci_upper, p_value < 0.05 AS significant FROM coef WHERE position > 0",
        _MODELED, *ols_sql("q", _Y, _EIGHT, "fiscal_year"),
    ),
)
def r4(spark, folder):
    tidy = R.tidy_coefficients(_eight(spark, folder))
    return _rounded(tidy, "fiscal_year", "term", "estimate", "ci_lower", "ci_upper", "significant")


@register(
    "r4_significant_count",
    over_view(
        "SELECT fiscal_year, count(*) FILTER (p_value < 0.05) AS significant, count(*) AS terms FROM coef WHERE position > 0 GROUP BY 1",
        _MODELED, *ols_sql("q", _Y, _EIGHT, "fiscal_year"),
    ),
)
def r4_count(spark, folder):
    return R.significant_count(_eight(spark, folder), by=["fiscal_year"])


_COMPARED = (
    f"cc AS (SELECT o.term, o.estimate AS estimate_old, n.estimate AS estimate_new, n.estimate - o.estimate AS change "
    f"FROM coef o JOIN coef n ON o.term = n.term AND o.fiscal_year = {OLD} AND n.fiscal_year = {NEW} WHERE o.position > 0)"
)


def _compared(spark, folder):
    # The earlier snapshot names this column differently; the comparison renames its terms.
    old_names = ["fire_place" if c == "fireplaces" else c for c in REGRESSION_FEATURES]
    old = _rows(spark, folder, (OLD,)).withColumnRenamed("fireplaces", "fire_place")
    return R.compare_coefficients(
        R.ols(old, _Y, old_names), R.ols(_rows(spark, folder, (NEW,)), _Y, REGRESSION_FEATURES), {"fire_place": "fireplaces"}
    )


@register(
    "j4_e27_compare_coefficients",
    over_view(_pick("term", "estimate_old", "estimate_new", "change") + " FROM cc", _MODELED, *ols_sql("q", _Y, _EIGHT, "fiscal_year"), _COMPARED),
)
def j4(spark, folder):
    return _rounded(_compared(spark, folder))


for _name, _largest in (("r5_largest_increase", True), ("r5_largest_decrease", False)):
    register(
        _name,
        over_view(
            f"SELECT term, round(change, 8) AS change FROM cc ORDER BY cc.change {'DESC' if _largest else 'ASC'}, term LIMIT 1",
            _MODELED, *ols_sql("q", _Y, _EIGHT, "fiscal_year"), _COMPARED,
        ),
    )(lambda spark, folder, _largest=_largest: _rounded(groups.extreme_label(_compared(spark, folder), "term", "change", _largest)))


_FITTED = (
    "rr AS (SELECT pid, log_total_value AS actual, (SELECT estimate FROM coef WHERE position = 0)"
    + "".join(f" + (SELECT estimate FROM coef WHERE term = '{c}') * {c}" for c in REGRESSION_FEATURES)
    + f" AS fitted FROM q WHERE fiscal_year = {NEW})"
)
_NEW_FIT = [f"qn AS (SELECT * FROM q WHERE fiscal_year = {NEW})", *ols_sql("qn", _Y, _EIGHT)]


def _residuals(spark, folder):
    rows = _rows(spark, folder, (NEW,))
    return R.residuals(rows, R.ols(rows, _Y, REGRESSION_FEATURES), _Y, REGRESSION_FEATURES, keep=["pid"])


@register(
    "r6_residual_rows",
    over_view("SELECT pid, round(actual, 7) AS actual, round(fitted, 7) AS fitted, round(actual - fitted, 7) AS residual FROM rr",
              _MODELED, *_NEW_FIT, _FITTED),
)
def r6(spark, folder):
    return _residuals(spark, folder).select("pid", *[F.round(c, 7).alias(c) for c in ("actual", "fitted", "residual")])


@register(
    "r6_residual_summary",
    over_view("SELECT count(*) AS n, round(abs(avg(actual - fitted)), 6) AS mean, round(stddev_samp(actual - fitted), 8) AS sd FROM rr",
              _MODELED, *_NEW_FIT, _FITTED),
)
def r6_summary(spark, folder):
    return R.residual_summary(_residuals(spark, folder)).select("n", F.round(F.abs("mean"), 6).alias("mean"), F.round("sd", 8).alias("sd"))


@register(
    "v1_residual_histogram",
    over_view(
        "SELECT CAST(ceil((actual - fitted) / 0.05::DOUBLE - 0.5::DOUBLE) AS BIGINT) AS bin_index, count(*) AS count FROM rr GROUP BY 1",
        _MODELED, *_NEW_FIT, _FITTED,
    ),
)
def v1_residual(spark, folder):
    return distributions.histogram_width(_residuals(spark, folder), "residual", 0.05).select("bin_index", "count")


@register(
    "v7_residual_grid",
    over_view(
        "SELECT CAST(floor(fitted / 0.05::DOUBLE) AS BIGINT) AS x_bin, CAST(floor((actual - fitted) / 0.1::DOUBLE) AS BIGINT) AS y_bin, "
        "count(*) AS n FROM rr GROUP BY 1, 2", _MODELED, *_NEW_FIT, _FITTED,
    ),
)
def v7_residual(spark, folder):
    return distributions.grid_counts(_residuals(spark, folder), "fitted", "residual", 0.05, 0.1)


@register(
    "r8_rows_used",
    over_view(
        "SELECT count(*) AS loaded, count(*) FILTER (bed_rms IS NOT NULL AND gross_tax <> 0 AND land_value <> 0) AS fitted FROM a"
    ),
)
def r8(spark, folder):
    rows = assessments(spark, folder, ["total_value", "bed_rms", "gross_tax", "land_value"]).withColumns(
        {"log_value": C.ln_pos("total_value"), "log_tax": C.ln_pos("gross_tax"), "log_land": C.ln_pos("land_value")}
    )
    used = R.fit_summary(R.ols(rows, "log_value", ["bed_rms", "log_tax", "log_land"])).select(F.col("n")).scalar()
    return rows.agg(F.count(F.lit(1)).alias("loaded")).withColumn("fitted", used)
