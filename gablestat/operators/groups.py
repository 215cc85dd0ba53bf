"""Grouped questions: profiles, premiums, counts, shares and extremes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gablestat.operators.quantiles import FEW_GROUPS, quantiles


def group_profile(
    df: DataFrame,
    keys: str | Sequence[str],
    metrics: Mapping[str, Column],
    *,
    min_n: int | None = None,
    order: str | None = None,
    descending: bool = True,
    top: int | None = None,
) -> DataFrame:
    """Aggregates per group with the group size ``n``, small groups left out, best ones first.

    Ties are ordered by the keys, so the answer does not depend on the input order.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    out = df.groupBy(*keys).agg(*[m.alias(name) for name, m in metrics.items()], F.count(F.lit(1)).alias("n"))
    if min_n is not None:
        out = out.filter(F.col("n") >= min_n)
    if order:
        out = out.orderBy(F.col(order).desc() if descending else F.col(order).asc(), *keys)
    return out.limit(top) if top is not None else out


def count_by(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Group sizes in key order, groups without a key left out."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys)


def top_categories(df: DataFrame, col: str, n: int | None = None, min_n: int | None = None) -> DataFrame:
    """Category counts, largest first, cut to the first ``n`` or to those of at least ``min_n`` rows."""
    return group_profile(df, col, {}, min_n=min_n, order="n", top=n)


def keep_categories(df: DataFrame, col: str, categories: DataFrame, at_most: int | None = None) -> DataFrame:
    """Rows whose category is listed; the list stays a DataFrame.

    ``at_most`` states how long the list can be, as for a top-n list: it is then broadcast
    and the rows stay where they are.
    """
    listed = categories.select(F.col(col).alias("__listed"))
    if at_most is not None and at_most <= FEW_GROUPS:
        listed = F.broadcast(listed)
    return df.join(listed, F.col(col) == F.col("__listed"), "left_semi")


def premium(
    df: DataFrame, keys: Sequence[str], step: str, lo: float, hi: float, value: str, agg: str = "avg",
    bounded_groups: bool | None = None,
) -> DataFrame:
    """Typical value at each step of an amenity count within [lo, hi], in key order.

    ``avg`` gives ``avg_value`` and ``n``; ``median`` gives the exact ``median_value``.
    """
    groups = [*keys, step]
    rows = df.filter(F.col(step).between(lo, hi))
    if agg == "median":
        out = quantiles(rows, value, [0.5], groups, names=["median_value"], bounded_groups=bounded_groups)
    else:
        out = rows.groupBy(*groups).agg(F.avg(value).alias("avg_value"), F.count(F.lit(1)).alias("n"))
    return out.orderBy(*groups)


def summary_stats(df: DataFrame, col: str, lo: float, hi: float, suffix: str) -> DataFrame:
    """Mean, deviation, smallest and largest value of a column within an open range."""
    x = F.col(col)
    return df.filter((x > lo) & (x < hi)).agg(
        F.avg(x).alias(f"mean_{suffix}"), F.stddev_samp(x).alias(f"stddev_{suffix}"),
        F.min(x).alias(f"min_{suffix}"), F.max(x).alias(f"max_{suffix}"),
    )


def extreme_label(df: DataFrame, label: str, metric: str, largest: bool = True) -> DataFrame:
    """One row: the label with the extreme metric, the smallest label among ties."""
    m = F.col(metric)
    best = F.min(F.struct((-m if largest else m).alias("m"), F.col(label).alias("label"))).alias("best")
    value = -F.col("best.m") if largest else F.col("best.m")
    return df.filter(m.isNotNull()).agg(best).select(F.col("best.label").alias(label), value.alias(metric))


def share_within(df: DataFrame, part: Sequence[str], key: str) -> DataFrame:
    """``(part..., key, count, pct)``: share of each category within its part.

    Totals are summed from the counts and joined back, so a part with very many
    categories is never gathered into one window partition.
    """
    part = list(part)
    counts = df.groupBy(*part, key).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(*part).agg(F.sum("count").alias("__total"))
    totals = totals.select(*[F.col(p).alias(f"t_{p}") for p in part], "__total")
    same = [F.col(p).eqNullSafe(F.col(f"t_{p}")) for p in part]
    return counts.join(totals, same).select(
        *part, key, "count", (F.col("count") / F.col("__total") * 100).alias("pct")
    )
