import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gablestat.functions import levels
from gablestat.operators import distributions as D
from gablestat.operators import encoding, filters, groups, profile, snapshots


def rows_of(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def homes(spark):
    rng = np.random.default_rng(11)
    n = 2000
    city = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdef"), n))
    rows = [
        (int(i), str(city[i]), int(2023 + 2 * (i % 2)), float(np.round(rng.lognormal(13, 0.8), 2)), int(rng.integers(1, 9)))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "pid int, city string, fiscal_year int, total_value double, bed_rms int").cache()


def test_missing_profile_counts_null_and_nan(spark):
    df = spark.createDataFrame([(1, "a", float("nan")), (None, "b", 1.0), (None, None, None)], "n int, t string, d double")
    assert rows_of(profile.missing_profile(df).select("column", "missing_count")) == [("d", 2), ("n", 2), ("t", 1)]
    assert rows_of(profile.columns_over_missing(df, 0.5).select("column")) == [("d",), ("n",)]


@pytest.mark.parametrize("digest", [False, True])
def test_duplicates(spark, digest):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x"), (None, "x")], "a int, b string")
    assert tuple(profile.duplicate_count(df, digest).first()) == (5, 3, 2)


def test_mode_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("a", 3), (None, None)], "t string, n int")
    assert rows_of(profile.value_modes(df, ["t", "n"]), "column") == [("n", "3", 2), ("t", "a", 2)]


def test_outliers_at_the_fence(spark):
    # Quartiles 2 and 4, fences -1 and 7: the value on the fence is inside.
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 7]] + [(None,)], "x double")
    row = profile.outlier_profile(df, ["x"]).first()
    assert (row.q1, row.q3, row.lo, row.hi, row.n_outliers) == (2.0, 4.0, -1.0, 7.0, 0)
    assert filters.iqr_filter(df, "x").count() == 5
    wider = df.union(spark.createDataFrame([(50.0,)], "x double"))
    assert profile.outlier_profile(wider, ["x"]).first().n_outliers == 1


def test_summaries_agree(homes):
    described = profile.describe_numeric(homes, ["total_value", "bed_rms"])
    summary = profile.summary_r(homes, ["total_value", "bed_rms"])
    values = np.array([r.total_value for r in homes.collect()])
    got = described.filter("column = 'total_value'").first()
    assert got["count"] == 2000 and got.mean == pytest.approx(values.mean()) and got.stddev == pytest.approx(values.std(ddof=1))
    row = summary.filter("column = 'total_value'").first()
    assert (row.min, row.max, row.missing) == (values.min(), values.max(), 0)
    assert (row.q1, row.median, row.q3) == pytest.approx(tuple(np.quantile(values, [0.25, 0.5, 0.75])))


def test_valid_records(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 1.0, 1900), (0.0, 1.0, 1.0, 1900), (1.0, None, 1.0, 1900), (1.0, 1.0, 1.0, 1700), (1.0, 1.0, 1.0, 2026)],
        "total_value double, living_area double, land_sf double, yr_built int",
    )
    assert filters.valid_records(df, 2025).count() == 1


def test_select_existing(spark):
    df = spark.createDataFrame([(1, 2)], ["a", "b"])
    assert filters.split_names(df, ["b", "c"]) == (["b"], ["c"])
    assert filters.select_existing(df, ["b", "c"]).columns == ["b"]


def test_fences_per_group_keep_null_group(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4, 100)] + [(None, float(v)) for v in (10, 11, 12, 13, 500)]
    df = spark.createDataFrame(rows, "g string, x double")
    kept = filters.iqr_filter(df, "x", by=["g"])
    assert sorted(r.x for r in kept.collect()) == [1, 2, 3, 4, 10, 11, 12, 13]


def test_group_profile_order_and_size(homes):
    out = groups.group_profile(homes, "city", {"avg_value": F.avg("total_value")}, min_n=150, order="avg_value", top=3)
    rows = out.collect()
    assert len(rows) <= 3 and all(r.n >= 150 for r in rows)
    assert [r.avg_value for r in rows] == sorted((r.avg_value for r in rows), reverse=True)


def test_extreme_label_ties(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 1.0), ("d", None)], "t string, m double")
    assert tuple(groups.extreme_label(df, "t", "m").first()) == ("a", 2.0)
    assert tuple(groups.extreme_label(df, "t", "m", largest=False).first()) == ("c", 1.0)


def test_shares_sum_to_hundred(homes):
    out = groups.share_within(homes, ["fiscal_year"], "city")
    for r in out.groupBy("fiscal_year").agg(F.sum("pct").alias("s"), F.sum("count").alias("c")).collect():
        assert r.s == pytest.approx(100) and r.c == 1000


def test_duplicate_key_pairs_up(spark):
    old = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 5.0), (None, 1.0)], "pid int, v double")
    new = spark.createDataFrame([(1, 30.0), (3, 7.0), (None, 2.0)], "pid int, v double")
    for salts in (1, 4):
        out = snapshots.match_snapshots(old, new, "pid", ["v"], ("_o", "_n"), salts)
        assert rows_of(out, "v_o") == [(1, 10.0, 30.0), (1, 20.0, 30.0)]
    assert rows_of(snapshots.matched_keys(old, new, "pid")) == [(1,)]
    assert snapshots.keep_matched(old, snapshots.matched_keys(old, new, "pid"), "pid").count() == 2


def test_salted_match_of_a_hot_key(spark):
    old = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("pid"), F.col("id").alias("v"))
    new = spark.range(3000).select(F.col("id").alias("pid"), (F.col("id") * 2).alias("v"))
    plain = snapshots.match_snapshots(old, new, "pid", ["v"], ("_o", "_n"))
    salted = snapshots.match_snapshots(old, new, "pid", ["v"], ("_o", "_n"), 8)
    assert rows_of(plain, "pid", "v_o") == rows_of(salted, "pid", "v_o")


def test_panel_pairs_equal_joined_pairs(spark):
    rows = [(i, y, float(i * y)) for i in range(50) for y in (2023, 2025) if (i + y) % 7]
    panel = spark.createDataFrame(rows, "pid int, fiscal_year int, v double")
    paired = snapshots.pair_up(panel, "pid", "fiscal_year", (2023, 2025), ["v"])
    joined = snapshots.match_snapshots(
        panel.filter("fiscal_year = 2023"), panel.filter("fiscal_year = 2025"), "pid", ["v"], ("_2023", "_2025")
    )
    assert rows_of(paired, "pid") == rows_of(joined, "pid")


def test_snapshot_change(spark):
    df = spark.createDataFrame(
        [(2023, 100.0, 1.0), (2023, 300.0, 1.2), (2025, 220.0, 1.3), (2025, 240.0, 1.5)], "fiscal_year int, v double, r double"
    )
    summary = snapshots.snapshot_summary(df, {"v": "med_v", "r": "med_r"})
    out = {r.metric: r for r in snapshots.snapshot_change(summary, (2023, 2025), ["med_v", "med_r"]).collect()}
    assert (out["med_v"].old, out["med_v"].new, out["med_v"].pct_change) == (200.0, 230.0, 15.0)
    assert (out["med_r"].pct_change, out["med_r"].pp_change) == (27.27, 0.3)


def test_histograms_hold_every_row(homes):
    logs = homes.select(F.log10("total_value").alias("x"))
    assert D.histogram_width(logs, "x", 0.1).agg(F.sum("count")).first()[0] == 2000
    bins = D.histogram_bins(homes, "total_value", 50)
    values = np.array([r.total_value for r in homes.collect()])
    counts, edges = np.histogram(values, bins=50)
    got = bins.orderBy("bin").collect()
    assert [r["count"] for r in got] == list(counts)
    assert [r.lower for r in got] == pytest.approx(list(edges[:-1]))


def test_bin_edges_belong_to_the_lower_bin(spark):
    df = spark.createDataFrame([(0.9,), (1.0,), (1.1,), (3.0,)], "x double")
    assert {r.bin_center: r["count"] for r in D.histogram_width(df, "x", 2.0).collect()} == {0.0: 2, 2.0: 2}
    constant = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r["count"] for r in D.histogram_bins(constant, "x", 3).orderBy("bin").collect()] == [2, 0, 0]


def test_density_follows_the_exact_sum(homes):
    out = D.density(homes.select(F.log10("total_value").alias("x")), "x", points=256).orderBy("grid").collect()
    x = np.log10([r.total_value for r in homes.collect()])
    q1, q3 = np.quantile(x, [0.25, 0.75])
    bw = 0.9 * min(x.std(ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    for r in out[::25]:
        exact = np.exp(-0.5 * ((r.x - x) / bw) ** 2).sum() / (len(x) * bw * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(exact, abs=2e-3)


def test_line_fit_and_band(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    y = 3 * x + 1 + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit = D.line_fit(df, "x", "y")
    row = fit.first()
    slope, intercept = np.polyfit(x, y, 1)
    assert (row.slope, row.intercept, row.n) == (pytest.approx(slope), pytest.approx(intercept), 200)
    residual = y - slope * x - intercept
    assert row.sigma == pytest.approx(math.sqrt((residual**2).sum() / 198))
    band = D.line_band(fit, -1, 1, 3).orderBy("x").collect()
    assert [r.x for r in band] == [-1, 0, 1] and all(r.lower < r.fit < r.upper for r in band)


def test_correlations(homes):
    rows = homes.withColumn("half", F.col("total_value") / -2 + F.col("bed_rms")).withColumn("flat", F.lit(1.0))
    out = D.corr_matrix(rows, ["total_value", "bed_rms", "half", "flat"])
    cells = {(r.x, r.y): r.r for r in out.collect()}
    assert cells["total_value", "half"] == pytest.approx(-1.0)
    assert cells["bed_rms", "bed_rms"] == 1.0 and cells["flat", "flat"] is None and cells["flat", "half"] is None
    assert all(cells[a, b] == cells[b, a] for a, b in cells)
    assert D.strongest_correlate(out, "total_value", absolute=True).first().variable == "half"
    assert D.strongest_correlate(out, "total_value").first().variable == "bed_rms"


def test_grid_and_pairs(homes):
    assert D.grid_counts(homes, "bed_rms", "total_value", 2, 1e5).agg(F.sum("n")).first()[0] == 2000
    assert D.pair_counts(homes, "bed_rms", "city").agg(F.sum("n")).first()[0] == 2000


def test_nominal_codes_count_on_across_partitions(spark):
    df = spark.range(5000).selectExpr("concat('k', lpad(id, 5, '0')) as t", "concat('m', lpad(id % 700, 5, '0')) as u", "id")
    levels = df.select("t", "u").unpivot([], ["t", "u"], "column", "level").distinct().repartition(7)
    counted = encoding.numbered_levels(levels).groupBy("column").agg(F.min("at"), F.max("at"), F.countDistinct("at"), F.count("at"))
    assert sorted(tuple(r) for r in counted.collect()) == [("t", 0, 4999, 5000, 5000), ("u", 0, 699, 700, 700)]
    out = encoding.nominal_encode(df, ["t", "u"])
    assert out.where("t_code <> id or u_code <> id % 700").count() == 0 and out.count() == 5000


def test_nominal_codes_both_ways(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,), ("a",)], "t string")
    codes = encoding.NominalCodes(df, ["t"], base=1)
    out = codes.inverse(codes.transform(df))
    assert sorted(((r.t, r.t_code, r.t_label) for r in out.collect()), key=str) == sorted(
        [("b", 2, "b"), ("a", 1, "a"), ("c", 3, "c"), (None, None, None), ("a", 1, "a")], key=str
    )
    unseen = codes.transform(spark.createDataFrame([("zz",)], "t string"))
    assert unseen.first().t_code is None


def test_coerce_mostly_numeric(spark):
    df = spark.createDataFrame([("1", "1"), ("2", "x"), ("y", None), (None, "z")], "a string, b string")
    out = encoding.coerce_mostly_numeric(df.union(spark.createDataFrame([("3", "q")], df.schema)), ["a", "b"])
    assert dict(out.dtypes) == {"a": "double", "b": "string"}


def test_encode_all(spark):
    df = spark.createDataFrame([("G - Good", "S - Special"), ("F - Fair", "bad")], "overall_cond string, prop_view string")
    ranked = encoding.ordinal_encode_all(df, levels.ORDINAL_LEVELS)
    assert rows_of(ranked, "overall_cond") == [(2, None), (4, 6)]
    plain = encoding.ordinal_encode_all(encoding.strip_prefix_all(df), levels.MODEL_ORDINAL_LEVELS)
    assert rows_of(plain, "overall_cond") == [(2, None), (4, 6)]


def test_top_categories_semi_join(homes):
    top = groups.top_categories(homes, "city", n=2)
    kept = groups.keep_categories(homes, "city", top)
    assert kept.count() == sum(r.n for r in top.collect())


def test_symmetric_bound(spark):
    df = spark.createDataFrame([(49.0, -49.0), (50.0, 0.0), (0.0, -51.0), (None, 0.0)], "a double, b double")
    assert filters.symmetric_bound(df, ["a", "b"], 50).count() == 1


def test_cleaning_parses_a_text_once_however_many_filters_read_it(spark):
    from gablestat.plans.cleaning import clean_for_comparison, clean_for_regression, clean_for_tests

    rows = [("1,000.00", "$10.00", "50", "70", "1990", "F - X", "Y", "2"), ("", "$10.00", "50", "70", "1990", "F - X", "Y", "2"), ("9.00", "$1", "0", "70", "1990", "F - X", "Y", "2")]
    df = spark.createDataFrame(rows, "raw string, gross_tax string, living_area string, land_sf string, yr_built string, bldg_type string, own_occ string, bed_rms string")
    df = df.withColumns({"total_value": F.reverse(F.reverse("raw")), "fiscal_year": F.lit(2000), "land_value": F.col("raw"), "bldg_value": F.col("raw"),
                         "city": F.lit("a"), **{c: F.lit("1") for c in ("full_bth", "hlf_bth", "num_parking")}})
    for clean in (clean_for_tests, clean_for_regression, clean_for_comparison):
        out = clean(df, 2000)
        assert [(r.total_value, r.price_per_sqft) for r in out.select("total_value", "price_per_sqft").collect()] == [(1000.0, 20.0)]
    plan = clean_for_tests(df, 2000).groupBy("own_occ").agg(F.sum("total_value"), F.avg("price_per_sqft"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(reverse(") == 1


def test_distinct_whole_rows_move_no_whole_rows(spark):
    from __spark_entry__ import queries

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries()["u3_distinct_whole_rows"](spark, "/root/testdata/sf0.001")
        assert "order_key" not in df.columns and df.count() == df.distinct().count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        top = plan[: plan.index("SortMergeJoin")]
        assert "Exchange" not in top  # rows meet where the last join put them
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
