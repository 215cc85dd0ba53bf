from pyspark.sql import functions as F
from pyspark.sql import types as T

from gablestat.operators.snapshots import stack_snapshots
from gablestat.plans.cleaning import parse_roll
from gablestat.session import fresh_path
from gablestat.sources import assessment as S


def test_header_repair(spark):
    df = spark.createDataFrame([(1, 2)], [" GROSS_TAX ", "Total Value"])
    assert S.normalize_columns(df).columns == ["gross_tax", "total_value"]


def test_header_repair_with_repeats_and_marks(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Parcel-ID", "City", "CITY", "livingArea %"])
    assert S.normalize_columns(df, "clean").columns == ["parcel_id", "city", "city_2", "living_area_percent"]


def test_resolve_column(spark):
    df = spark.createDataFrame([(1, 2)], ["fy_gross_tax", "fire_place"])
    df = S.resolve_column(df, ["gross_tax"], "gross_tax", contains=True)
    df = S.resolve_column(df, ["fireplaces", "fire_place"], "fireplaces")
    assert df.columns == ["gross_tax", "fireplaces"]
    assert S.resolve_column(df, ["absent"], "other").columns == df.columns


def test_harmonize_lines_snapshots_up(spark):
    old = spark.createDataFrame([("2128", 1, "")], "zipcode string, kitchen int, city string")
    new = spark.createDataFrame([("02129", 2, "X", "Y")], "zip_code string, kitchens int, city string, corner_unit string")
    both = stack_snapshots(S.harmonize(old), S.harmonize(new))
    assert set(both.columns) == {"zip_code", "kitchens", "city", "corner_unit", "sfyi_value"}
    assert {t for _, t in both.dtypes} == {"string"}
    first = both.filter("zip_code = '2128'").first()
    assert first.city is None and first.corner_unit is None and first.kitchens == "1"


def test_text_round_trip(spark):
    rows = [("1,150", "$9,252.42", 'say "hi", there', "02128"), ("", "", " padded ", "00005"), (None, "$1.00", "a\\b", "1")]
    df = spark.createDataFrame(rows, "total_value string, ` GROSS_TAX ` string, note string, zip_code string")
    path = S.write_assessment(df, fresh_path(spark, "roundtrip"))
    back = parse_roll(S.normalize_columns(S.read_assessment(spark, path)))
    got = {r.zip_code: (r.total_value, r.gross_tax, r.note) for r in back.collect()}
    assert got["02128"] == (1150.0, 9252.42, 'say "hi", there')
    assert got["00005"][:2] == (None, None)
    assert got["1"] == (None, 1.0, "a\\b")


def test_declared_schema_and_types(spark):
    df = spark.createDataFrame([("02128", "7")], "ZIP string, N string")
    path = S.write_assessment(df, fresh_path(spark, "schema"))
    schema = T.StructType([T.StructField("ZIP", T.StringType()), T.StructField("N", T.StringType())])
    back = S.read_assessment(spark, path, schema, {"N": "int"})
    assert back.dtypes == [("ZIP", "string"), ("N", "int")]
    assert back.first().ZIP == "02128"


def test_shape_schema_preview(spark):
    df = spark.range(5).select("id", (F.col("id") * 2).alias("twice"))
    assert tuple(S.shape(df).first()) == (5, 2)
    assert [(r.column, r.type) for r in S.schema_table(df).orderBy("position").collect()] == [("id", "bigint"), ("twice", "bigint")]
    assert [r.twice for r in S.preview(df, ["twice"], ["id"], 2).collect()] == [0, 2]


def test_blank_strings(spark):
    df = S.blank_strings_to_null(spark.createDataFrame([("", 1), ("  ", 2), (" a", 3)], "t string, n int"))
    assert [r.t for r in df.orderBy("n").collect()] == [None, None, " a"]
