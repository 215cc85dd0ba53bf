"""The spread-out rank search against numpy, on inputs chosen to be hard for it."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gablestat.operators import quantiles as Q
from gablestat.operators.quantiles import column_quantiles, medians, nth_smallest, quantiles
from gablestat.session import store

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def one_group(spark, values, probs=PROBS):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(5)
    return list(quantiles(df, "x", probs).first())


def cases():
    rng = np.random.default_rng(7)
    yield "few", [1.0, 2.0, 4.0, 10.0]
    yield "single", [3.25]
    yield "same", [5.5] * 1000
    yield "normal", list(rng.normal(0, 1, 4001))
    yield "money", list(np.round(rng.lognormal(13, 1.5, 5000), 2))
    yield "negative", list(-rng.lognormal(3, 2, 1000))
    yield "narrow band", list(1.7e9 + rng.random(5000))
    yield "one bucket", list(1.0 + rng.random(3000) * 1e-9)
    yield "zeros and ties", [0.0] * 500 + [-0.0] * 10 + list(rng.integers(-3, 4, 1000).astype(float))
    yield "magnitudes", [10.0 ** e for e in range(-300, 300, 7)] + [-(10.0 ** e) for e in range(-300, 300, 11)]
    yield "subnormal", [5e-324, 1e-323, 1e-310, 2.2e-308, 0.0, 1.0]
    yield "neighbours", list(np.nextafter(1.0, 2.0) + np.arange(2000) * 2.220446049250313e-16)


@pytest.mark.parametrize("few", [Q.FEW_COUNTS, 0])
@pytest.mark.parametrize("name, values", list(cases()), ids=[n for n, _ in cases()])
def test_matches_interpolated_quantiles(spark, monkeypatch, name, values, few):
    monkeypatch.setattr(Q, "FEW_COUNTS", few)
    got = one_group(spark, values)
    want = np.quantile(np.array(values), PROBS)
    assert got == pytest.approx(list(want), rel=1e-12, abs=0.0 if name == "subnormal" else 1e-300)


def test_infinities_rank_at_the_ends(spark):
    got = one_group(spark, [math.inf, -math.inf, 1.0, 2.0, 3.0], [0.0, 0.25, 0.5, 0.75, 1.0])
    assert got == [-math.inf, 1.0, 2.0, 3.0, math.inf]


def test_missing_values_are_left_out(spark):
    assert one_group(spark, [1.0, None, float("nan"), 3.0], [0.5]) == [2.0]


def test_nothing_left(spark):
    df = spark.createDataFrame([("a", None)], "g string, x double")
    assert quantiles(df, "x", [0.5], ["g"]).count() == 0
    assert medians(df, ["x"]).first().x is None


@pytest.mark.parametrize("bounded", [True, False])
def test_hot_group_and_null_group(spark, bounded):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.lognormal(10, 1, 6000)]
    rows += [(f"g{i % 40}", float(x)) for i, x in enumerate(rng.normal(0, 50, 3000))] + [(None, 1.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r.g: (r.q0, r.q1) for r in quantiles(df, "x", [0.5, 0.9], ["g"], bounded_groups=bounded).collect()}
    groups = {}
    for g, x in rows:
        groups.setdefault(g, []).append(x)
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g] == pytest.approx(tuple(np.quantile(xs, [0.5, 0.9])), rel=1e-12)


def test_same_answer_when_every_join_is_a_shuffle(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 3), float(x)) for i, x in enumerate(rng.normal(100, 15, 3000))]
    df = spark.createDataFrame(rows, "g int, x double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.g: r.q0 for r in quantiles(df, "x", [0.5], ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for g in range(3):
        assert got[g] == pytest.approx(np.median([x for k, x in rows if k == g]), rel=1e-12)


def test_columns_together(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 30.0), (None, 20.0)], "a int, b double")
    got = {r.column: (r.lo, r.hi) for r in column_quantiles(df, ["a", "b"], [0.25, 0.75], names=["lo", "hi"]).collect()}
    assert got == {"a": (1.5, 2.5), "b": (15.0, 25.0)}
    assert tuple(medians(df, ["a", "b"]).first()) == (2.0, 20.0)


def test_approximate_switch(spark):
    df = spark.range(1, 10001).select(F.col("id").cast("double").alias("x"))
    assert quantiles(df, "x", [0.5], approx=True).first().q0 == pytest.approx(5000, abs=5)


def test_nth_smallest(spark):
    df = spark.createDataFrame([(g, float(v)) for g in "ab" for v in range(10)], "g string, x double")
    got = {r.g: (r.total, r.value) for r in nth_smallest(df, "x", lambda n: n - 3, ["g"]).collect()}
    assert got == {"a": (10, 7.0), "b": (10, 7.0)}


def test_two_reads_of_key_and_value_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    wide = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"), F.lit("pad").alias("rest"))
    wide.write.parquet(path)
    rows = Q.numbers(spark.read.parquet(path), "x", ["g"])

    def scans(df):
        text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "SortMergeJoin" not in text
        return [line.split("ReadSchema: ")[1].strip() for line in text.splitlines() if "ReadSchema" in line]

    targets = [lambda total: F.floor(total / 2)]
    state = Q.sketched(rows, ["g"])
    assert scans(state) == ["struct<g:bigint,x:double>"]
    stored, _ = store(state)
    second = Q.bracketed(rows, ["g"], Q._brackets(stored, targets, [(0, 0)], Q.SLACK), True)
    second.collect()
    assert [s for s in scans(second) if s.startswith("struct<g:")] == ["struct<g:bigint,x:double>"]
    # what the call gives reads stored counts, never the rows again
    assert all("x:double" not in s for s in scans(quantiles(spark.read.parquet(path), "x", [0.5], ["g"])))


def test_second_read_keeps_few_values(spark):
    df = spark.range(400000).select((F.col("id") * 7919 % 400009).cast("double").alias("v"))
    state, _ = store(Q.sketched(df, []))

    targets = [lambda total: F.floor(total / 2)]
    kept = Q.bracketed(df, [], Q._brackets(state, targets, [(0, 0)], Q.SLACK), True)
    assert kept.count() < 400000 * 0.02 and kept.agg(F.sum("n")).first()[0] == 400000


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    values = np.random.default_rng(1).lognormal(3, 2, 30000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    # brackets far from the ranks: all of them miss until they are wide enough
    calls = []
    true = Q._brackets

    def shifted(state, targets, spans, slack):
        calls.append(slack)
        return true(state, [lambda total: F.lit(0)] * len(targets), spans, slack)

    monkeypatch.setattr(Q, "_brackets", shifted)
    assert tuple(quantiles(df, "x", [0.25, 0.9]).first()) == pytest.approx(tuple(np.quantile(values, [0.25, 0.9])))
    assert len(calls) > 1


def test_hot_value_settles_in_its_bucket(spark):
    rows = [(0.0,)] * 5000 + [(float(i),) for i in range(1, 2001)]
    df = spark.createDataFrame(rows, "x double").repartition(4)
    assert tuple(quantiles(df, "x", [0.1, 0.5, 0.9]).first()) == pytest.approx(tuple(np.quantile([r[0] for r in rows], [0.1, 0.5, 0.9])))
