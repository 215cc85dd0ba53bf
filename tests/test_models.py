"""Boosting, preparation, block least squares, moment tables and hot keys against plain computations."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gablestat.operators import boosting, inference, snapshots
from gablestat.operators.boosting import Settings, bin_borders, fit_boosted
from gablestat.operators.preparation import RollPreparation, RollPreparationModel
from gablestat.operators.regression import ols
from gablestat.session import drop_stored, fresh_path, store


def table(spark, n=3000, seed=5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.normal(0, 1, n), rng.integers(0, 3, n)]).astype(float)
    y = 3 * x[:, 0] + 5 * (x[:, 1] > 0.3) * x[:, 2] + rng.normal(0, 0.5, n)
    rows = [(i, float(a), float(b), float(c), float(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(4), x, y


def brute_trees(x, y, borders, s, start):
    """The same trees, one node and one border at a time."""
    codes = np.column_stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(borders)])
    score = np.full(len(y), start)
    soft = lambda g: np.sign(g) * max(abs(g) - s.l1, 0)
    for _ in range(s.rounds):
        g, step = score - y, np.zeros(len(y))

        def grow(rows, depth):
            best = None
            worth = lambda r: soft(g[r].sum()) ** 2 / (len(r) + s.l2) / 2
            for f in range(x.shape[1]) if depth else []:
                for b in range(len(borders[f])):
                    left, right = rows[codes[rows, f] <= b], rows[codes[rows, f] > b]
                    if min(len(left), len(right)) >= s.min_rows:
                        gain = worth(left) + worth(right) - worth(rows)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = gain, left, right
            if best is None:
                step[rows] = -s.step * soft(g[rows].sum()) / (len(rows) + s.l2)
            else:
                grow(best[1], depth - 1)
                grow(best[2], depth - 1)

        grow(np.arange(len(y)), s.depth)
        score = score + step
    return score


@pytest.mark.parametrize("small", [boosting.SMALL, 0])
def test_trees_are_those_of_a_plain_search(spark, monkeypatch, small):
    monkeypatch.setattr(boosting, "SMALL", small)
    monkeypatch.setattr(boosting, "KEEP", 2)
    df, x, y = table(spark)
    s = Settings(rounds=3, depth=3, step=0.4, rows=1.0, columns=1.0, min_rows=4, bins=16)
    model = fit_boosted(df, ["a", "b", "c"], "y", ["id"], s)
    got = {r.id: r.prediction for r in model.transform(df).collect()}
    want = brute_trees(x, y, model.borders, s, y.mean())
    assert [got[i] for i in range(len(y))] == pytest.approx(list(want), rel=1e-9)
    assert len(model.losses) == 3 and model.losses[-1][1] == pytest.approx(np.sqrt(np.mean((want - y) ** 2)))


def test_large_and_small_nodes_give_the_same_sampled_trees(spark, monkeypatch):
    df, _, _ = table(spark)
    s = Settings(rounds=4, depth=4, rows=0.7, columns=0.7, bins=32)
    found, borders = [], None
    for small in (boosting.SMALL, 300, 0):
        monkeypatch.setattr(boosting, "SMALL", small)
        model = fit_boosted(df, ["a", "b", "c"], "y", ["id"], s, borders=borders)
        borders = model.borders
        found.append((model.losses, [(t.feature.tolist(), t.border.tolist(), t.cover.tolist()) for t in model.trees]))
    assert found[0][1] == found[1][1] == found[2][1]
    assert np.array(found[0][0], dtype=float)[:, :2] == pytest.approx(np.array(found[2][0], dtype=float)[:, :2])


def test_state_is_blocks_of_rows_and_no_round_deals_out_too_many(spark, monkeypatch):
    df, _, _ = table(spark)
    s = Settings(rounds=3, depth=4, rows=0.7, columns=0.7, bins=32)
    states, found, kept, borders = [], [], boosting._kept, None
    monkeypatch.setattr(boosting, "_kept", lambda state, *n: states.append(state.count()) or kept(state, *n))
    finished = []
    run = boosting._Level.run
    monkeypatch.setattr(boosting._Level, "run", lambda self, *a, **k: finished.append(bool(k.get("finish"))) or run(self, *a, **k))
    for most in (boosting.DEALT, 0):
        monkeypatch.setattr(boosting, "DEALT", most)
        finished.clear()
        model = fit_boosted(df, ["a", "b", "c"], "y", ["id"], s, borders=borders)
        borders = model.borders
        assert any(finished) == (most > 0)
        found.append([(t.feature.tolist(), t.border.tolist(), t.cover.tolist()) for t in model.trees])
    assert found[0] == found[1]
    assert max(states) <= 16  # batches of the 3,000 rows, not rows


def test_training_stops_when_held_out_rows_gain_no_more(spark):
    df, _, _ = table(spark, 800)
    noise = df.withColumn("y", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double")).withColumn("valid", F.col("id") % 3 == 0)
    model = fit_boosted(noise, ["a", "b"], "y", ["id"], Settings(rounds=40, depth=4, step=0.5, patience=3), "valid")
    losses = [r[2] for r in model.losses]
    best = int(np.argmin(losses))
    assert len(losses) < 40 and len(losses) == best + 1 + 3 and len(model.trees) == best + 1
    assert model.importances(spark).agg(F.sum("gain")).first()[0] == pytest.approx(1.0)


def test_one_task_grows_the_trees_of_the_passes(spark, monkeypatch):
    df, _, _ = table(spark)
    df = df.withColumn("valid", F.col("id") % 10 == 0).withColumn("one", F.lit(1.0))
    for s in (Settings(rounds=4, depth=5, rows=0.7, columns=0.7, bins=32, min_rows=3), Settings(rounds=2, depth=0), Settings(rounds=3, depth=3, columns=0.1)):
        found, values, borders = [], [], None
        for least, cores in ((1 << 20, 1), (1000, 1), (1000, 3)):
            monkeypatch.setattr(boosting, "LEAST", least)
            monkeypatch.setattr(boosting, "PROCESSES", cores)
            model = fit_boosted(df, ["a", "one", "b", "c"], "y", ["id"], s, "valid", borders=borders)
            borders = model.borders
            found.append((model.losses, [(t.feature.tolist(), t.border.tolist(), t.cover.tolist()) for t in model.trees]))
            values.append([x for t in model.trees for x in t.value.tolist()])
        assert found[0][1] == found[1][1] == found[2][1]
        for i in (1, 2):
            assert values[i] == pytest.approx(values[0]) and np.array(found[i][0]) == pytest.approx(np.array(found[0][0]))


@pytest.mark.parametrize("processes, nodes", [(1, 64), (3, 1), (5, 64)])
def test_shards_in_processes_and_small_pieces_make_the_same_trees(monkeypatch, processes, nodes):
    monkeypatch.setattr(boosting, "NODES", nodes)
    monkeypatch.setattr(boosting, "PIECE", 100)
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 12, 3000), rng.normal(0, 1, 3000), rng.integers(0, 3, 3000)]).astype(float)
    y = 3 * x[:, 0] + 5 * (x[:, 1] > 0.3) * x[:, 2] + rng.normal(0, 0.5, 3000)
    s = Settings(rounds=3, depth=4, step=0.4, rows=1.0, columns=1.0, min_rows=4)
    borders = [np.arange(11.0), np.quantile(x[:, 1], np.arange(1, 16) / 16), np.array([0.0, 1.0])]
    codes = np.stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(borders)])
    cuts = [slice(0, 1700), slice(1700, 1701), slice(1701, 3000)]
    blocks = [boosting._block(codes[:, c], y[c], np.arange(3000)[c], np.zeros(3000, dtype=bool)[c], np.zeros(3000)[c]) for c in reversed(cuts)]
    found = list(boosting._Held(s, [12, 16, 3], processes).run(iter(blocks)))
    got = brute_trees(x, y, borders, s, 0.0) - y
    assert [b.column("round")[0].as_py() for b in found] == [0, 1, 2]
    assert found[-1].column("errors")[0].as_py() == pytest.approx([(got**2).sum(), 3000, 0, 0])


def test_rounds_of_a_fit_that_one_task_holds_are_no_jobs(spark):
    df, x, y = table(spark, 20_000)
    s = Settings(rounds=25, depth=3, step=0.4, rows=1.0, columns=1.0, min_rows=4, bins=16)
    spark.sparkContext.setJobGroup("held", "a fit")
    try:
        model = fit_boosted(df, ["a", "b", "c"], "y", ["id"], s)
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("held"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.trees) == len(model.losses) == 25 and 0 < jobs < 25
    got = {r.id: r.prediction for r in model.transform(df).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(list(brute_trees(x, y, model.borders, s, y.mean())), rel=1e-6)


def test_one_task_stops_when_held_out_rows_gain_no_more(spark, monkeypatch):
    monkeypatch.setattr(boosting, "LEAST", 100)
    df, _, _ = table(spark, 800)
    noise = df.withColumn("y", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double")).withColumn("valid", F.col("id") % 3 == 0)
    model = fit_boosted(noise, ["a", "b"], "y", ["id"], Settings(rounds=40, depth=4, step=0.5, patience=3), "valid")
    best = int(np.argmin([r[2] for r in model.losses]))
    assert len(model.losses) < 40 and len(model.losses) == best + 1 + 3 and len(model.trees) == best + 1


def test_bins_take_awkward_columns(spark):
    rows = [(float(i), None, 1.0, float("nan") if i % 2 else 2.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "x double, none double, one double, odd double")
    borders = bin_borders(df, ["x", "none", "one", "odd"], 16)
    assert len(borders[0]) == 15 and [len(b) for b in borders[1:]] == [0, 0, 0]
    model = fit_boosted(df.withColumn("id", F.col("x")).withColumn("y", F.col("x") * 2), ["x", "none", "one", "odd"], "y", ["id"], Settings(rounds=2, depth=2))
    assert model.transform(df).where("prediction is null").count() == 0
    empty = fit_boosted(df.limit(0).withColumn("y", F.col("x")), ["x"], "y", ["x"], Settings(rounds=1, depth=2))
    assert empty.transform(df).first().prediction == 0.0


def test_preparation_is_read_back_as_it_was(spark):
    old = spark.createDataFrame(
        [(1, "10", "E - Excellent", "Ab", None), (2, None, "P - Poor", "Ab", None), (3, "30", "P - Poor", None, None), (4, "x", "odd", "Zz", 1.0)],
        "id int, area string, cond string, city string, sparse double")
    fitted = RollPreparation(["area", "sparse", "absent"], {"cond": ["Poor", "Excellent"]}, ["city"]).fit(old)
    path = fresh_path(spark, "preparation")
    fitted.save(path)
    read = RollPreparationModel.load(spark, path)
    assert read.columns == ["area", "cond", "city"]
    new = spark.createDataFrame([(7, "5", "E - Excellent", "Zz", 1.0), (8, None, None, "new", None), (9, " ", "", "", None)], old.schema)
    for model in (fitted, read):
        assert {tuple(r) for r in model.transform(new).select("id", "area", "cond", "city").collect()} == {
            (7, 5.0, 2.0, 2.0), (8, 20.0, 1.0, 1.0), (9, 20.0, 1.0, 1.0)}
    assert read.transform(new.limit(0)).count() == 0


@pytest.mark.parametrize("by", [[], ["g"]])
def test_blocks_hold_a_model_of_three_categories(spark, by):
    rng = np.random.default_rng(2)
    n = 1500
    x, kinds = rng.normal(50, 9, (n, 2)), [rng.integers(0, k, n) for k in (6, 9, 25)]
    y = x @ [0.4, -0.2] + kinds[0] * 0.3 - (kinds[2] == 3) * 2 + rng.normal(0, 1, n)
    rows = [(1, *map(float, a), *(f"v{k[i]:02d}" for k in kinds), float(y[i])) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "g int, x1 double, x2 double, k1 string, k2 string, k3 string, y double").repartition(3)
    got = {r.term: r for r in ols(df, "y", ["x1", "x2"], ["k1", "k2", "k3"], {"k3": "v05"}, by=by).collect()}
    columns, names = [np.ones(n), *x.T], ["(Intercept)", "x1", "x2"]
    for j, k in enumerate(kinds):
        for v in sorted(set(k.tolist())):
            if v != (5 if j == 2 else 0):
                columns.append((k == v).astype(float))
                names.append(f"k{j + 1}v{v:02d}")
    a = np.column_stack(columns)
    beta, rss, *_ = np.linalg.lstsq(a, y, rcond=None)
    assert set(got) == set(names)
    errors = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * rss[0] / (n - len(names)))
    for name, b, e in zip(names, beta, errors):
        assert got[name].estimate == pytest.approx(b, rel=1e-7, abs=1e-8) and got[name].std_error == pytest.approx(e, rel=1e-6)


def test_small_levels_leave_by_their_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [("rare" if i < 5 else f"k{i % 3}", float(x), float(2 * x + (i % 3) + (100 if i < 5 else 0) + e)) for i, (x, e) in enumerate(rng.normal(0, 1, (600, 2)))]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.term: (r.estimate, r.n) for r in ols(df, "y", ["x"], ["k"], min_level_n=50).collect()}
    want = {r.term: (r.estimate, r.n) for r in ols(df.where("k <> 'rare'"), "y", ["x"], ["k"]).collect()}
    assert set(got) == set(want) and all(got[t] == pytest.approx(want[t]) for t in got)


def test_moment_table_holds_every_test(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 2), "u" if i % 5 else None, float(v)) for i, v in enumerate(rng.normal(10, 2, 400))]
    df = spark.createDataFrame(rows, "year int, kind string, v double").cache()
    moments = inference.moment_table(df, {"year": F.col("year"), "kind": F.col("kind")}, ["v"])
    assert {(r.grouping, r.level, r.n) for r in moments.collect()} == {("year", "0", 200), ("year", "1", 200), ("kind", "u", 320)}
    one, other = inference.welch_from(moments, "year", "v", "0", "1").first(), inference.welch_t(df, "v", "year", 0, 1).first()
    assert tuple(one)[:-1] == pytest.approx(tuple(other)[:-1])
    assert tuple(inference.anova_from(moments, "year", "v").first())[:-1] == pytest.approx(tuple(inference.anova_oneway(df, "v", "year").first())[:-1])


@pytest.mark.parametrize("block", [1000, 3])
def test_every_pair_of_means_comes_once(spark, block):
    means = spark.createDataFrame([(f"g{i:02d}", i) for i in range(14)], "group string, n int")
    got = [(r.a.group, r.b.group) for r in inference.pairs_of(means, "group", block).collect()]
    assert sorted(got) == sorted((f"g{i:02d}", f"g{j:02d}") for i in range(14) for j in range(i + 1, 14))


def test_a_hot_key_is_found_and_spread(spark):
    rows = [(7 if i % 3 == 0 else i, float(i)) for i in range(6000)] + [(None, 1.0)] * 50
    a = spark.createDataFrame(rows, "pid long, v double").repartition(6)
    b = spark.createDataFrame([(i, float(i)) for i in range(0, 6000, 2)] + [(7, 7.0), (None, 2.0)], "pid long, v double")
    hot = {r.pid: r for r in snapshots.hot_keys(a, "pid").collect()}
    assert hot[7].n == 2001 or hot[7].n == 2000
    assert hot[7].salts > 100 and all(r.salts <= 2 for k, r in hot.items() if k != 7)
    matched = snapshots.match_snapshots(a, b, "pid", ["v"], ("_o", "_n"))
    plain = a.join(b.withColumnRenamed("v", "w"), "pid").select("pid", "v", "w")
    assert sorted(map(tuple, matched.select("pid", "v_o", "v_n").collect())) == sorted(map(tuple, plain.collect()))
    # no task meets more than a small share of the hot key's rows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = snapshots.match_snapshots(a, b, "pid", ["v"], ("_o", "_n")).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
        most = dealt.agg(F.max("n")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert most < 0.4 * matched.count()


def test_stored_tables_are_deleted_and_nothing_else(spark, tmp_path):
    df, path = store(spark.range(5))
    assert df.count() == 5
    drop_stored(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    with pytest.raises(ValueError):
        drop_stored(spark, str(tmp_path))


def test_settings_are_those_of_the_roll():
    assert replace(Settings()) == Settings(300, 0.05, 8, 0.8, 0.8, 1.0, 0.5, 1, 256, 15, 42)


def test_model_rows_are_split_before_they_are_stored(spark):
    from gablestat.operators import filters
    from gablestat.operators.modeling import split_hash
    from gablestat.plans import queries_models
    from gablestat.plans.binding import NEW

    folder = "/root/testdata/sf0.001"
    train, test, _ = queries_models._prepared(spark, folder)
    assert "md5" not in train._jdf.queryExecution().optimizedPlan().toString()
    rows = filters.valid_records(queries_models._roll(spark, folder, "record_id"), NEW)
    want = {r["split"]: r["n"] for r in split_hash(rows, ["record_id"]).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {"train": train.count(), "test": test.count()} == want
