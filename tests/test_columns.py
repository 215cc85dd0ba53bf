import math

import pytest
from pyspark.sql import functions as F

from gablestat.functions import columns as C
from gablestat.functions import levels


def value(spark, make, x, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, expected",
    [("1,150,000", 1150000.0), (" 12 ", 12.0), ("", None), ("1A", None), ("1D", None), ("2F", None), ("NaN", None),
     ("0x1p3", None), ("-3.5", -3.5), ("1.0E7", 1e7), (".5", 0.5), ("1-2", None), (None, None)],
)
def test_parse_number(spark, text, expected):
    assert value(spark, C.parse_number, text) == expected


@pytest.mark.parametrize(
    "text, expected", [("$9,252.42", 9252.42), ("-$5.00", 5.0), ("", None), ("n/a", None), ("1.2.3", None), (None, None)]
)
def test_parse_currency(spark, text, expected):
    assert value(spark, C.parse_currency, text) == expected


@pytest.mark.parametrize(
    "text, expected", [("2128", "02128"), ("02128", "02128"), ("2128.0", "02128"), ("123456", "123456"), ("1A", None), (None, None)]
)
def test_zip5(spark, text, expected):
    assert value(spark, C.zip5, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("AVG - Default - Average", "Average"), ("RE - Row End", "Row End"), ("Plain", "Plain"), ("A-B", "A-B"), (None, None)],
)
def test_strip_prefix(spark, text, expected):
    assert value(spark, C.strip_prefix, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("  EAST HARBOR ", "East Harbor"), ("east harbor-south o'neil", "East Harbor-South O'neil"), ("front/STREET", "Front/Street"), (None, None)],
)
def test_title_trim(spark, text, expected):
    assert value(spark, C.title_trim, text) == expected


def test_recode_keeps_unknown(spark):
    recode = lambda c: C.recode(c, levels.CONDITION_SYNONYMS)
    assert value(spark, recode, "US - Unsound") == "P - Poor"
    assert value(spark, recode, "F - Fair") == "F - Fair"
    assert value(spark, recode, None) is None


def test_ordinal_rank(spark):
    rank = lambda c: C.ordinal_encode(c, levels.CONDITION_LEVELS)
    assert value(spark, rank, "P - Poor") == 1
    assert value(spark, rank, "E - Excellent") == 5
    assert value(spark, rank, "Z - Other") is None
    assert value(spark, rank, None) is None


def test_ratios_with_zero_base(spark):
    row = spark.createDataFrame([(10.0, 0.0)], "a double, b double").select(
        C.price_per_area("a", "b").alias("psf"), C.ratio_pct("a", "b").alias("ratio"), C.pct_change("b", "a").alias("change"),
        C.pct_change("b", "a", ieee=True).alias("up"), C.pct_change("b", "b", ieee=True).alias("none"), C.ln_pos("b").alias("ln"),
    ).first()
    assert row.psf is None and row.ratio is None and row.change is None and row.none is None and row.ln is None
    assert row.up == math.inf


def test_two_group_and_decision(spark):
    group = lambda c: C.two_group(c, 3, "many", "few")
    assert [value(spark, group, x, "int") for x in (2, 3, None)] == ["few", "many", None]
    assert [value(spark, C.decision, p, "double") for p in (0.01, 0.05, None)] == ["Reject H0", "Fail to Reject H0", None]


def test_change_helpers(spark):
    row = spark.createDataFrame([(1.088, 1.158)], "o double, n double").select(
        C.pct_change("o", "n", 1).alias("pct"), C.pp_change("o", "n", 3).alias("pp"), C.age(2025, F.lit(1900)).alias("age")
    ).first()
    assert (row.pct, row.pp, row.age) == (6.4, 0.07, 125)
