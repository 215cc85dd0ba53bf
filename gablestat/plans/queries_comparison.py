"""Two snapshots side by side (ids E19-E21, F9, J1-J2, J5, U1-U2, A21-A22, A27, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gablestat.functions import columns as C
from gablestat.operators import filters, groups, snapshots
from gablestat.operators.quantiles import medians
from gablestat.plans.binding import (
    NEW, OLD, PAIR_MEASURES, assessments, dirty_assessments, exact_sum, paired_panel,
)
from gablestat.plans.catalog import over_pair, over_view, register
from gablestat.plans.cleaning import clean_for_comparison, clean_for_regression, clean_for_tests, parse_roll
from gablestat.session import cut_lineage

SUFFIXES = (f"_{OLD}", f"_{NEW}")
CHANGES = {
    "total_value": "value_change_pct", "gross_tax": "tax_change_pct",
    "land_value": "land_change_pct", "bldg_value": "bldg_change_pct",
}

_JOINED = (
    f"m AS (SELECT o.pid, " + ", ".join(f"o.{c} AS {c}_{OLD}, n.{c} AS {c}_{NEW}" for c in PAIR_MEASURES)
    + f" FROM p o JOIN p n ON o.pid = n.pid AND o.fiscal_year = {OLD} AND n.fiscal_year = {NEW})"
)
_CHANGED = (
    "y AS (SELECT *, " + ", ".join(
        f"CASE WHEN {c}_{OLD} <> 0 THEN ({c}_{NEW} - {c}_{OLD}) / {c}_{OLD} * 100 END AS {name}" for c, name in CHANGES.items()
    ) + " FROM m)"
)


def _snapshot(spark, folder, year, columns):
    return assessments(spark, folder, columns, (year,))


@register("j1_match_snapshots", over_pair("SELECT * FROM m", _JOINED))
def j1(spark, folder):
    panel = paired_panel(spark, folder)
    old = panel.filter(F.col("fiscal_year") == OLD)
    new = panel.filter(F.col("fiscal_year") == NEW)
    return snapshots.match_snapshots(old, new, "pid", PAIR_MEASURES, SUFFIXES)


@register("j1_pair_up_panel", over_pair("SELECT * FROM m", _JOINED))
def j1_panel(spark, folder):
    rows = assessments(spark, folder, ["pid", "fiscal_year", *PAIR_MEASURES], (OLD, NEW))
    return snapshots.pair_up(rows, "pid", "fiscal_year", (OLD, NEW), PAIR_MEASURES, exact_sum)


@register(
    "j2_keep_matched",
    over_view(
        f"SELECT pid, total_value FROM a WHERE fiscal_year = {OLD} AND pid IN (SELECT pid FROM a WHERE fiscal_year = {NEW})"
    ),
)
def j2(spark, folder):
    old = _snapshot(spark, folder, OLD, ["pid", "total_value"])
    new = _snapshot(spark, folder, NEW, ["pid"])
    return snapshots.keep_matched(old, new, "pid")


@register(
    "j5_gap_to_median",
    over_view("SELECT pid, round(total_value - m, 6) AS gap FROM a, (SELECT median(total_value) AS m FROM a)"),
)
def j5(spark, folder):
    rows = assessments(spark, folder, ["pid", "total_value"])
    middle = medians(rows, ["total_value"]).scalar()
    return rows.select("pid", F.round(F.col("total_value") - middle, 6).alias("gap"))


@register(
    "u1_stack_snapshots",
    over_view(
        f"SELECT pid, total_value, NULL::INTEGER AS num_parking, fiscal_year FROM a WHERE fiscal_year = {OLD} UNION ALL "
        f"SELECT pid, total_value, num_parking, fiscal_year FROM a WHERE fiscal_year = {NEW}"
    ),
)
def u1(spark, folder):
    old = snapshots.with_snapshot(_snapshot(spark, folder, OLD, ["pid", "total_value"]), OLD)
    new = snapshots.with_snapshot(_snapshot(spark, folder, NEW, ["pid", "total_value", "num_parking"]), NEW)
    return snapshots.stack_snapshots(old, new)


@register("u2_matched_keys", over_view(f"SELECT pid FROM a WHERE fiscal_year = {OLD} INTERSECT SELECT pid FROM a WHERE fiscal_year = {NEW}"))
def u2(spark, folder):
    return snapshots.matched_keys(_snapshot(spark, folder, OLD, ["pid"]), _snapshot(spark, folder, NEW, ["pid"]), "pid")


@register(
    "a27_matched_count",
    over_view(
        f"SELECT count(*) AS matched FROM (SELECT pid FROM a WHERE fiscal_year = {OLD} INTERSECT "
        f"SELECT pid FROM a WHERE fiscal_year = {NEW})"
    ),
)
def a27(spark, folder):
    return snapshots.matched_count(_snapshot(spark, folder, OLD, ["pid"]), _snapshot(spark, folder, NEW, ["pid"]), "pid")


@register("e21_snapshot_label", over_view(f"SELECT fiscal_year, city, count(*) AS n FROM a WHERE fiscal_year IN ({OLD}, {NEW}) GROUP BY 1, 2"))
def e21(spark, folder):
    parts = [snapshots.with_snapshot(_snapshot(spark, folder, y, ["city"]), y) for y in (OLD, NEW)]
    return snapshots.stack_snapshots(*parts).groupBy("fiscal_year", "city").agg(F.count(F.lit(1)).alias("n"))


def _changes(spark, folder):
    rows = assessments(spark, folder, ["pid", "fiscal_year", *PAIR_MEASURES], (OLD, NEW))
    pairs = snapshots.pair_up(rows, "pid", "fiscal_year", (OLD, NEW), PAIR_MEASURES, exact_sum)
    return snapshots.pct_change_cols(pairs, CHANGES, SUFFIXES)


@register(
    "e19_percent_changes",
    over_pair("SELECT pid, " + ", ".join(f"round({n}, 6) AS {n}" for n in CHANGES.values()) + " FROM y", _JOINED, _CHANGED),
)
def e19(spark, folder):
    return _changes(spark, folder).select("pid", *[F.round(n, 6).alias(n) for n in CHANGES.values()])


@register(
    "a22_median_matched_changes",
    over_pair("SELECT " + ", ".join(f"round(median({n}), 6) AS {n}" for n in CHANGES.values()) + " FROM y", _JOINED, _CHANGED),
)
def a22(spark, folder):
    names = list(CHANGES.values())
    out = snapshots.matched_change_medians(_changes(spark, folder), names)
    return out.select(*[F.round(n, 6).alias(n) for n in names])


@register(
    "f9_symmetric_bound",
    over_pair(
        "SELECT pid, round(value_change_pct, 6) AS value_change_pct, round(tax_change_pct, 6) AS tax_change_pct FROM y "
        "WHERE abs(value_change_pct) < 50 AND abs(tax_change_pct) < 50", _JOINED, _CHANGED,
    ),
)
def f9(spark, folder):
    kept = filters.symmetric_bound(_changes(spark, folder), ["value_change_pct", "tax_change_pct"], 50)
    return kept.select("pid", *[F.round(n, 6).alias(n) for n in ("value_change_pct", "tax_change_pct")])


METRICS = {
    "total_value": "med_value", "gross_tax": "med_tax", "price_per_sqft": "med_psf", "tax_to_value_ratio": "med_ratio",
}
_SUMMARY = (
    "s AS (SELECT fiscal_year, count(*) AS n, median(total_value) AS med_value, median(gross_tax) AS med_tax, "
    "median(total_value / living_area) AS med_psf, median(gross_tax / total_value * 100) AS med_ratio FROM a "
    f"WHERE fiscal_year IN ({OLD}, {NEW}) GROUP BY 1)"
)


def _summary(spark, folder):
    rows = assessments(spark, folder, ["fiscal_year", "total_value", "gross_tax", "living_area"], (OLD, NEW)).withColumns(
        {"price_per_sqft": C.price_per_area("total_value", "living_area"),
         "tax_to_value_ratio": C.ratio_pct("gross_tax", "total_value")}
    )
    return snapshots.snapshot_summary(rows, METRICS)


@register(
    "a21_snapshot_summary",
    over_view("SELECT fiscal_year, n, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS.values()) + " FROM s", _SUMMARY),
)
def a21(spark, folder):
    return _summary(spark, folder).select("fiscal_year", "n", *[F.round(m, 6).alias(m) for m in METRICS.values()])


_CHANGE_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(o.{m}, 6) AS old, round(w.{m}, 6) AS new, "
    f"round((w.{m} - o.{m}) / o.{m} * 100, 2) AS pct_change, round(w.{m} - o.{m}, 2) AS pp_change "
    f"FROM s o JOIN s w ON o.fiscal_year = {OLD} AND w.fiscal_year = {NEW}" for m in METRICS.values()
)


@register("a21_snapshot_change", over_view(_CHANGE_SQL, _SUMMARY))
def a21_change(spark, folder):
    out = snapshots.snapshot_change(_summary(spark, folder), (OLD, NEW), list(METRICS.values()))
    return out.select("metric", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"), "pct_change", "pp_change")


@register(
    "e20_percent_change",
    over_view(
        f"SELECT round((n - o) / o * 100, 2) AS pct_change FROM (SELECT avg(total_value) FILTER (fiscal_year = {OLD}) AS o, "
        f"avg(total_value) FILTER (fiscal_year = {NEW}) AS n FROM a)"
    ),
)
def e20(spark, folder):
    rows = assessments(spark, folder, ["fiscal_year", "total_value"], (OLD, NEW))
    means = rows.agg(
        *[F.avg(F.when(F.col("fiscal_year") == y, F.col("total_value"))).alias(name) for y, name in ((OLD, "o"), (NEW, "n"))]
    )
    return means.select(C.pct_change("o", "n", 2).alias("pct_change"))


_POSITIVE = f"total_value > 0 AND gross_tax > 0 AND living_area > 0 AND land_sf > 0 AND yr_built > 1700 AND yr_built <= {NEW}"
_PARSED = (
    "d AS (SELECT a.* REPLACE (CASE WHEN pid % 10 = 0 THEN NULL ELSE total_value END AS total_value, "
    "CASE WHEN pid % 10 = 0 THEN NULL ELSE gross_tax END AS gross_tax) FROM a)"
)
_C1 = (
    f"v AS (SELECT * FROM d WHERE fiscal_year IN ({OLD}, {NEW}) AND {_POSITIVE})",
    "f AS (SELECT fiscal_year, quantile_cont(total_value, 0.25) AS q1, quantile_cont(total_value, 0.75) AS q3 FROM v GROUP BY 1)",
    "c AS (SELECT v.*, upper(city[1]) || lower(city[2:]) AS city_clean, regexp_replace(bldg_type, '^.* - ', '') AS bldg_type_clean "
    "FROM v JOIN f ON v.fiscal_year = f.fiscal_year WHERE total_value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))",
)
_ALL = ["pid", "fiscal_year", "city", "bldg_type", "yr_built", "own_occ", "bed_rms", "full_bth", "hlf_bth", "num_parking",
        "total_value", "land_value", "bldg_value", "living_area", "land_sf", "gross_tax"]


# What the cleaning reads; text that nothing reads is not parsed or stored.
_READ = ["fiscal_year", "city", "bldg_type", "yr_built", "total_value", "land_value", "bldg_value", "living_area", "land_sf", "gross_tax"]


@register(
    "c1_clean_for_comparison",
    over_view(
        "SELECT fiscal_year, city_clean, bldg_type_clean, count(*) AS n, "
        "CAST(sum(CAST(total_value AS DECIMAL(18,4))) AS DOUBLE) AS total_value, "
        "round(avg(gross_tax / total_value * 100), 8) AS ratio, round(avg(fiscal_year - yr_built), 8) AS age FROM c GROUP BY 1, 2, 3",
        _PARSED, *_C1,
    ),
)
def c1(spark, folder):
    # Text is parsed once and kept typed: the fences read it several times.
    typed = cut_lineage(parse_roll(dirty_assessments(spark, folder, _READ, (OLD, NEW))))
    rows = clean_for_comparison(typed, NEW)
    return rows.groupBy("fiscal_year", "city_clean", "bldg_type_clean").agg(
        F.count(F.lit(1)).alias("n"), exact_sum(F.col("total_value")).alias("total_value"),
        F.round(F.avg("tax_to_value_ratio"), 8).alias("ratio"), F.round(F.avg("age_of_property"), 8).alias("age"),
    )


@register(
    "c2_clean_for_tests",
    over_view(
        "SELECT fiscal_year, own_occ, count(*) AS n, CAST(sum(CAST(total_value AS DECIMAL(18,4))) AS DOUBLE) AS total_value, "
        "round(avg(total_value / living_area), 6) AS psf FROM d "
        f"WHERE {_POSITIVE} AND total_value / living_area < 5000 GROUP BY 1, 2", _PARSED,
    ),
)
def c2(spark, folder):
    rows = clean_for_tests(dirty_assessments(spark, folder, _ALL), NEW)
    return rows.groupBy("fiscal_year", "own_occ").agg(
        F.count(F.lit(1)).alias("n"), exact_sum(F.col("total_value")).alias("total_value"),
        F.round(F.avg("price_per_sqft"), 6).alias("psf"),
    )


@register(
    "c3_clean_for_regression",
    over_view(
        "SELECT fiscal_year, regexp_replace(bldg_type, '^.* - ', '') AS bldg_type_clean, count(*) AS n, "
        "round(avg(ln(total_value)), 9) AS log_value, round(avg(ln(living_area)), 9) AS log_area FROM d "
        f"WHERE {_POSITIVE} AND bed_rms BETWEEN 0 AND 10 AND full_bth BETWEEN 0 AND 8 GROUP BY 1, 2", _PARSED,
    ),
)
def c3(spark, folder):
    rows = clean_for_regression(dirty_assessments(spark, folder, _ALL), NEW)
    return rows.groupBy("fiscal_year", "bldg_type_clean").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("log_total_value"), 9).alias("log_value"),
        F.round(F.avg("log_living_area"), 9).alias("log_area"),
    )


@register(
    "w1_type_share_of_top_types",
    over_view(
        "SELECT fiscal_year, bldg_type_clean, count(*) AS count, "
        "round(count(*) / sum(count(*)) OVER (PARTITION BY fiscal_year) * 100, 9) AS pct FROM c WHERE bldg_type_clean IN "
        f"(SELECT bldg_type_clean FROM c WHERE fiscal_year = {NEW} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4) GROUP BY 1, 2",
        _PARSED, *_C1,
    ),
)
def w1_top(spark, folder):
    typed = cut_lineage(parse_roll(dirty_assessments(spark, folder, _READ, (OLD, NEW))))
    rows = cut_lineage(clean_for_comparison(typed, NEW).select("fiscal_year", "bldg_type_clean"))
    top = groups.top_categories(rows.filter(F.col("fiscal_year") == NEW), "bldg_type_clean", n=4)
    out = groups.share_within(groups.keep_categories(rows, "bldg_type_clean", top, at_most=4), ["fiscal_year"], "bldg_type_clean")
    return out.withColumn("pct", F.round("pct", 9))
