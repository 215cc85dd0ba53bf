import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gablestat.functions import probability as P
from gablestat.operators import inference as I
from gablestat.operators import modeling as M
from gablestat.operators import regression as R


def test_distribution_functions():
    assert 1 - P.t_sf(2.0, 10) == pytest.approx(0.9633059826, abs=1e-10)
    assert 1 - P.f_sf(2.0, 3, 20) == pytest.approx(0.8535611970, abs=1e-10)
    assert P.t_sf(-2.0, 10) == pytest.approx(0.9633059826, abs=1e-10)
    assert P.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    # Two-sided normal tail for many degrees of freedom.
    assert 2 * P.t_sf(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6)
    # Published upper 5 % points of the studentized range.
    for k, df, q in ((3, 10, 3.877), (2, 3, 4.501), (5, 20, 4.232), (10, 60, 4.646), (6, 1e6, 4.030)):
        assert P.studentized_range_quantile(0.95, k, float(df)) == pytest.approx(q, abs=1.5e-3)
    # With two groups the range is |t| * sqrt(2).
    assert P.studentized_range_sf(3.0, 2, 12.0) == pytest.approx(2 * P.t_sf(3.0 / math.sqrt(2), 12), abs=1e-7)


@pytest.mark.parametrize("df", [1e6, 1e7, 1e8, 1e9, 1e10, 1e11, 1e12])
@pytest.mark.parametrize("t", [0.01, 0.5, 1.0, 1.959963985, 5.0, 12.0])
def test_tails_of_many_rows_meet_their_limits(t, df):
    # the first term of the expansion by 1 / df, with the normal tail and density
    normal, density = 0.5 * math.erfc(t / math.sqrt(2)), math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    assert P.t_sf(t, df) == pytest.approx(normal + density * (t**3 + t) / (4 * df), rel=1e-7)
    # F with 2 and df degrees of freedom has a closed form
    assert P.f_sf(t, 2.0, df) == pytest.approx(math.exp(-df / 2 * math.log1p(2 * t / df)), rel=1e-7)
    assert P.f_sf(t * t, 1.0, df) == pytest.approx(2 * P.t_sf(t, df), rel=1e-9)


def test_both_forms_of_the_tail_agree_where_they_meet():
    for b in (0.5, 1.5, 4.0, 60.0):
        below, above = (P.beta_cdf(1 / (1 + 1.1 * b / a), a, b, 1.1 * b / a / (1 + 1.1 * b / a)) for a in (0.999999e8, 1e8))
        assert below == pytest.approx(above, rel=1e-6)


def test_residuals_ask_for_reference_levels(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 3.0), ("b", 1.0, 5.0), ("b", 2.0, 6.5), ("a", 4.0, 5.5)], "kind string, x double, y double")
    model = R.ols(rows, "y", ["x"], ["kind"])
    with pytest.raises(ValueError):
        R.residuals(rows, model, "y", ["x"], ["kind"])
    unseen = spark.createDataFrame([("zz", 1.0, 2.0)], "kind string, x double, y double")
    assert R.residuals(unseen, model, "y", ["x"], ["kind"], {"kind": "a"}).first().fitted is None


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, n, mean, sd in (("a", 400, 10.0, 2.0), ("b", 150, 10.6, 3.0), ("c", 50, 12.0, 1.0)):
        rows += [(g, float(x)) for x in rng.normal(mean, sd, n)]
    return spark.createDataFrame(rows, "g string, x double").repartition(4).cache(), rows


def test_welch(samples):
    df, rows = samples
    a = np.array([x for g, x in rows if g == "a"])
    b = np.array([x for g, x in rows if g == "b"])
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    t = (a.mean() - b.mean()) / math.sqrt(va + vb)
    free = (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
    both = I.welch_t(df, "x", "g", "a", "b").first()
    less = I.welch_t(df, "x", "g", "a", "b", "less").first()
    more = I.welch_t(df, "x", "g", "a", "b", "greater").first()
    assert (both.t, both.df) == (pytest.approx(t), pytest.approx(free))
    assert both.p_value == pytest.approx(2 * min(less.p_value, more.p_value))
    assert less.p_value + more.p_value == pytest.approx(1.0)
    assert less.p_value < more.p_value and both.n1 == 400 and both.n2 == 150


def test_anova_of_two_groups_is_the_pooled_t_squared(samples):
    df, rows = samples
    out = I.anova_oneway(df.filter("g <> 'c'"), "x", "g").first()
    a = np.array([x for g, x in rows if g == "a"])
    b = np.array([x for g, x in rows if g == "b"])
    pooled = (a.var(ddof=1) * (len(a) - 1) + b.var(ddof=1) * (len(b) - 1)) / (len(a) + len(b) - 2)
    t = (a.mean() - b.mean()) / math.sqrt(pooled * (1 / len(a) + 1 / len(b)))
    assert out.f_value == pytest.approx(t * t)
    assert out.p_value == pytest.approx(2 * P.t_sf(abs(t), len(a) + len(b) - 2), abs=1e-12)


def test_small_groups_stay_out(samples):
    df, _ = samples
    assert I.anova_oneway(df, "x", "g", min_n=100).first().groups == 2
    assert I.anova_oneway(df, "x", "g").first().groups == 3


def test_tukey(samples):
    df, rows = samples
    out = {(r.group1, r.group2): r for r in I.tukey_hsd(df, "x", "g").collect()}
    assert set(out) == {("a", "b"), ("a", "c"), ("b", "c")}
    means = {g: np.mean([x for k, x in rows if k == g]) for g in "abc"}
    for (g1, g2), r in out.items():
        assert r["diff"] == pytest.approx(means[g2] - means[g1])
        assert (r.lower > 0 or r.upper < 0) == (r.p_adj < 0.05)
        assert (r.lower + r.upper) / 2 == pytest.approx(r["diff"])


def test_report(samples):
    df, _ = samples
    out = I.hypothesis_report({"one": I.welch_t(df, "x", "g", "a", "c"), "two": I.anova_oneway(df, "x", "g")}).collect()
    assert [(r.hypothesis, r.decision) for r in out] == [("one", "Reject H0"), ("two", "Reject H0")]


def design(n=500, seed=9):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(5, 2, n), rng.normal(1e6, 1e3, n)
    kind = rng.choice(["hot", "mild", "cold"], n, p=[0.7, 0.2, 0.1])
    y = 2 + 0.5 * x1 - 1e-4 * x2 + np.where(kind == "cold", 3, 0) + np.where(kind == "mild", -1, 0) + rng.normal(0, 1, n)
    return x1, x2, kind, y


def test_ols_equals_least_squares(spark):
    x1, x2, kind, y = design()
    df = spark.createDataFrame([(float(a), float(b), str(k), float(c)) for a, b, k, c in zip(x1, x2, kind, y)], "x1 double, x2 double, kind string, y double").repartition(6)
    coef = R.ols(df, "y", ["x1", "x2"], ["kind"], {"kind": "hot"})
    rows = {r.term: r for r in coef.collect()}
    X = np.column_stack([np.ones(len(y)), x1, x2 - 1e6, kind == "cold", kind == "mild"]).astype(float)
    b, _, _, _ = np.linalg.lstsq(X, y, rcond=None)
    residual = y - X @ b
    s2 = residual @ residual / (len(y) - 5)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(X.T @ X)))
    for i, term in ((1, "x1"), (2, "x2"), (3, "kindcold"), (4, "kindmild")):
        assert rows[term].estimate == pytest.approx(b[i], rel=1e-7)
        assert rows[term].std_error == pytest.approx(se[i], rel=1e-7)
    assert rows["(Intercept)"].estimate == pytest.approx(b[0] - b[2] * 1e6, rel=1e-7)
    summary = R.fit_summary(coef).first()
    assert summary.r2 == pytest.approx(1 - residual @ residual / ((y - y.mean()) ** 2).sum(), rel=1e-9)
    fitted = R.residuals(df, coef, "y", ["x1", "x2"], ["kind"], {"kind": "hot"})
    stats = R.residual_summary(fitted).first()
    assert stats.n == len(y) and abs(stats["mean"]) < 1e-8 and stats.sd == pytest.approx(residual.std(ddof=1), rel=1e-9)


def test_ols_leaves_out_determined_columns_and_missing_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(2 * a + 1), 4.0, float(3 * a + rng.normal())) for a in rng.normal(size=100)] + [(None, 1.0, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, twin double, flat double, y double")
    out = {r.term: r for r in R.ols(df, "y", ["a", "twin", "flat"]).collect()}
    assert out["a"].estimate == pytest.approx(3, abs=0.5) and out["a"].n == 100
    assert out["twin"].estimate is None and out["flat"].estimate is None and out["twin"].p_value is None
    assert R.significant_count(R.ols(df, "y", ["a", "twin"])).first().terms == 1


def test_ols_per_group_equals_separate_fits(spark):
    x1, x2, kind, y = design(300)
    rows = [(int(i % 2), float(a), float(c)) for i, (a, c) in enumerate(zip(x1, y))]
    df = spark.createDataFrame(rows, "p int, x double, y double")
    joint = {(r.p, r.term): r.estimate for r in R.ols(df, "y", ["x"], by=["p"]).collect()}
    for p in (0, 1):
        alone = {r.term: r.estimate for r in R.ols(df.filter(F.col("p") == p), "y", ["x"]).collect()}
        assert joint[p, "x"] == pytest.approx(alone["x"], rel=1e-12)


def test_unknown_reference_level_is_an_error(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 3.0), ("b", 3.0, 3.5)], "k string, x double, y double")
    with pytest.raises(Exception, match="reference level"):
        R.ols(df, "y", ["x"], ["k"], {"k": "z"}).collect()


def test_coefficient_comparison(spark):
    old = spark.createDataFrame([("(Intercept)", 1.0), ("fire_place", 2.0), ("x", 1.0), ("gone", 1.0)], "term string, estimate double")
    new = spark.createDataFrame([("(Intercept)", 2.0), ("fireplaces", 2.5), ("x", 0.25)], "term string, estimate double")
    out = {r.term: r.change for r in R.compare_coefficients(old, new, {"fire_place": "fireplaces"}).collect()}
    assert out == {"fireplaces": 0.5, "x": -0.75}


@pytest.fixture(scope="module")
def homes(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1200):
        area, beds = float(rng.uniform(500, 4000)), int(rng.integers(1, 7))
        rows.append((
            i, area, beds if rng.random() > 0.2 else None, str(rng.choice(["brick", "wood"])) if rng.random() > 0.1 else None,
            "x" if rng.random() > 0.8 else None, str(2100 + i % 20), 200 * area + 1e4 * beds + float(rng.normal(0, 1e4)),
        ))
    return spark.createDataFrame(
        rows, "pid int, living_area double, bed_rms int, kind string, rare string, zip_code string, total_value double"
    ).cache()


def test_drop_sparse_and_impute(homes):
    assert "rare" not in M.drop_sparse(homes).columns
    filled = M.impute(homes, ["bed_rms"], ["kind"])
    assert filled.filter("bed_rms IS NULL OR kind IS NULL").count() == 0
    known = [r.bed_rms for r in homes.filter("bed_rms IS NOT NULL").collect()]
    middle = filled.join(homes.filter("bed_rms IS NULL").select("pid"), "pid").select("bed_rms").distinct().collect()
    assert [r.bed_rms for r in middle] == [float(np.median(known))]


def test_hash_split_does_not_depend_on_partitioning(homes):
    one = {r.pid: r.split for r in M.split_hash(homes.repartition(1), ["pid"]).collect()}
    many = {r.pid: r.split for r in M.split_hash(homes.repartition(13), ["pid"]).collect()}
    assert one == many and len(one) == 1200
    assert 0.74 < sum(s == "train" for s in one.values()) / 1200 < 0.86


def test_stratified_split_has_the_share_in_every_band(homes):
    out = M.split_stratified(homes, "total_value", ["pid"])
    assert out.count() == 1200
    for r in out.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("t")).collect():
        assert r.n == 300 and r.t == math.ceil(0.8 * r.n)
    again = M.split_stratified(homes.repartition(9), "total_value", ["pid"])
    assert sorted(map(tuple, out.select("pid", "split").collect())) == sorted(map(tuple, again.select("pid", "split").collect()))


def test_patience_rule():
    assert M.first_best_round([5, 4, 3, 3.5, 3.2, 2.9], patience=2) == 3
    assert M.first_best_round([5, 4, 3, 3.5, 3.2, 2.9], patience=3) == 6
    assert M.first_best_round([1.0], patience=3) == 1


def test_trees_end_to_end(spark, homes):
    data, names = M.prepare(homes, ["living_area", "bed_rms", "kind", "rare", "zip_code", "absent"], "total_value", ["pid"])
    assert names == ["living_area", "bed_rms", "kind_code", "zip_code"]
    parts = M.split_hash(data, ["pid"])
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    tree = M.fit_tree(train, "total_value", depth=8)
    boosted, rounds = M.fit_gbt_early(train, "total_value", ["pid"], rounds=5, patience=2, depth=4, step=0.5)
    assert 1 <= rounds <= 5
    table = {r.model: r for r in M.compare_models({"tree": tree.transform(test), "boosted": boosted.transform(test)}, "total_value").collect()}
    assert table["tree"].r2 > 0.9 and table["tree"].r2 <= table["tree"].r2_corr + 1e-9
    assert table["boosted"].r2 > 0.6
    weights = M.importances(tree, names, spark).collect()
    assert weights[0].feature == "living_area" and sum(r.importance for r in weights) == pytest.approx(1.0)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.5), (4.0, 4.0), (5.0, None)], "y double, prediction double")
    out = M.regression_metrics(df, "y").first()
    assert (out.n, out.mae, out.rmse) == (3, pytest.approx(1 / 3), pytest.approx(math.sqrt(0.5 / 3)))
    y = np.array([1.0, 2.0, 4.0])
    assert out.r2 == pytest.approx(1 - 0.5 / ((y - y.mean()) ** 2).sum())
    assert [r.residual for r in M.prediction_errors(df, "y").collect()] == [-0.5, 0.5, 0.0, None]
