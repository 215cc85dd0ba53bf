"""Data quality and descriptive profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gablestat.operators.quantiles import column_name, column_quantiles, melt, numbers, quantiles, sketched_columns
from gablestat.session import cut_lineage


def is_missing(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_profile(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """``(column, missing_count, missing_pct)``, most missing first; one pass over the rows."""
    total = F.count(F.lit(1)).alias("__total")
    counts = df.agg(total, *[F.count_if(is_missing(f)).alias(f.name) for f in df.schema.fields])
    out = counts.unpivot(["__total"], df.columns, "column", "missing_count").select(
        "column",
        "missing_count",
        (F.try_divide(F.col("missing_count") * 100.0, F.col("__total"))).alias("missing_pct"),
    )
    if only_missing:
        out = out.filter("missing_count > 0")
    return out.orderBy(F.col("missing_count").desc(), "column")


def columns_over_missing(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Columns whose missing fraction exceeds the threshold."""
    profile = missing_profile(df, only_missing=False)
    return profile.withColumn("missing_fraction", F.col("missing_pct") / 100).filter(
        F.col("missing_fraction") > threshold
    ).select("column", "missing_fraction")


def duplicate_count(df: DataFrame, digest: bool = False) -> DataFrame:
    """One row: total, distinct and duplicate rows.

    Equal rows are combined before the shuffle. ``digest`` shuffles a SHA-256 of the
    row in place of its columns, for wide tables.
    """
    if digest:
        row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
        groups = df.groupBy(row.alias("row"))
    else:
        groups = df.groupBy(*df.columns)
    n = groups.agg(F.count(F.lit(1)).alias("n"))
    return n.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
    ).withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_rows"))


def _described(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.struct(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("stddev"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(F.col(c).isNull()).alias("missing"),
    )


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, count, mean, stddev, min, max, missing)`` for each column, from one aggregate."""
    return df.agg(*[_described(c).alias(c) for c in cols]).unpivot([], list(cols), "column", "s").select("column", "s.*")


def summary_r(df: DataFrame, cols: Sequence[str], *, approx: bool = False) -> DataFrame:
    """``(column, min, q1, median, mean, q3, max, missing)``; the figures come with the first read of the quartiles.

    A value that doesn't read as a number is no missing one.
    """
    probs, names = [0.25, 0.5, 0.75], ["q1", "median", "q3"]
    if approx:
        base, quart = describe_numeric(df, cols), column_quantiles(df, cols, probs, approx=True, names=names)
    else:
        first = cut_lineage(sketched_columns(df, cols, [], _described))
        base = first.select(column_name(cols, "t_place").alias("column"), "more.*")
        quart = column_quantiles(df, cols, probs, names=names, sketches=first.drop("more"))
    return base.join(quart, "column", "left").select("column", "min", "q1", "median", "mean", "q3", "max", "missing")


def outlier_profile(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """``(column, q1, q3, lo, hi, n_outliers)`` by Tukey fences; missing values do not count."""
    tall = melt(df, cols)
    width = (F.col("q3") - F.col("q1")) * k
    # One row per profiled column: the number of columns bounds these broadcasts.
    limits = quantiles(tall, "value", [0.25, 0.75], ["place"], names=["q1", "q3"], bounded_groups=True).select(
        F.col("place").alias("f_place"), "q1", "q3", (F.col("q1") - width).alias("lo"), (F.col("q3") + width).alias("hi")
    )
    joined = numbers(tall, "value", ["place"]).join(F.broadcast(limits), F.col("place").eqNullSafe(F.col("f_place")))
    outside = (F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))
    out = joined.groupBy("place", "q1", "q3", "lo", "hi").agg(
        F.count_if(outside).alias("n_outliers")
    )
    return out.select(column_name(cols).alias("column"), "q1", "q3", "lo", "hi", "n_outliers")


def value_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, mode, n)``: the most frequent value as text, the smallest among ties.

    Values are counted first, so no task ever holds the value map of a column.
    """
    tall = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "mode")
    counts = tall.filter(F.col("mode").isNotNull()).groupBy("column", "mode").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("mode"))).alias("best")
    return counts.groupBy("column").agg(best).select("column", "best.mode", (-F.col("best.n")).alias("n"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).dropna().distinct().orderBy(col)


def overview(df: DataFrame, averages: Sequence[str], distincts: dict[str, str], *, approx: bool = False) -> DataFrame:
    """One row of averages (``avg_*``) and distinct counts (``distincts``: result name -> column)."""
    count = F.approx_count_distinct if approx else F.countDistinct
    return df.agg(
        *[F.avg(c).alias(f"avg_{c}") for c in averages],
        *[count(c).alias(name) for name, c in distincts.items()],
    )


#: Binary logarithm of the registers of a distinct sketch; its relative standard error is 1.04 / 2 ** (SKETCH_BITS / 2).
SKETCH_BITS = 12


def distinct_sketches(df: DataFrame, period: str, cols: Sequence[str]) -> DataFrame:
    """``(period, column, sketch)``: distinct values of each column and period as sketches that merge.

    Stored once per period, they answer for any set of periods without reading the rows again; a sketch is a few kilobytes
    whatever the number of values. Missing values don't count.
    """
    counted = df.groupBy(period).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS).alias(c) for c in cols])
    return counted.unpivot([period], list(cols), "column", "sketch")


def merged_distincts(sketches: DataFrame) -> DataFrame:
    """``(column, estimate)``: distinct values of each column over all periods of the sketches."""
    merged = sketches.groupBy("column").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("column", F.hll_sketch_estimate("sketch").alias("estimate"))
