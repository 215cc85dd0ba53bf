"""Row and column selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablestat.functions.columns import half_open_year
from gablestat.operators.quantiles import quantiles


def split_names(df: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """Wanted names that exist, and those that do not."""
    have = set(df.columns)
    return [c for c in wanted if c in have], [c for c in wanted if c not in have]


def select_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*split_names(df, wanted)[0])


def valid_records(
    df: DataFrame,
    as_of_year: int,
    positive: Sequence[str] = ("total_value", "living_area", "land_sf"),
    ranges: dict[str, tuple[float, float]] | None = None,
    year_built: str = "yr_built",
    after: int = 1700,
) -> DataFrame:
    """Rows fit for modelling; a missing value in any tested column drops the row."""
    keep = half_open_year(year_built, after, as_of_year)
    for c in positive:
        keep = keep & (F.col(c) > 0)
    for c, (lo, hi) in (ranges or {}).items():
        keep = keep & F.col(c).between(lo, hi)
    return df.filter(keep)


def tukey_fences(
    df: DataFrame, col: str, k: float = 1.5, by: Sequence[str] = (), *, approx: bool = False, bounded_groups=None
) -> DataFrame:
    """``(by..., q1, q3, lo, hi)`` with lo/hi at k interquartile ranges outside the quartiles."""
    spread = (F.col("q3") - F.col("q1")) * k
    return quantiles(
        df, col, [0.25, 0.75], by, names=["q1", "q3"], approx=approx, bounded_groups=bounded_groups
    ).select("*", (F.col("q1") - spread).alias("lo"), (F.col("q3") + spread).alias("hi"))


def iqr_filter(
    df: DataFrame, col: str, k: float = 1.5, by: Sequence[str] = (), *, approx: bool = False, bounded_groups=None
) -> DataFrame:
    """Rows within the fences, bounds included. Fences come from ``df`` itself, per group if asked.

    The fences are a stored table, whose size decides whether they are broadcast unless ``bounded_groups`` says it.
    """
    fences = tukey_fences(df, col, k, by, approx=approx, bounded_groups=bounded_groups)
    if not by:
        pair = fences.select(F.struct("lo", "hi").alias("fence")).scalar()
        return df.filter((F.col(col) >= pair["lo"]) & (F.col(col) <= pair["hi"]))
    small = fences.select(*[F.col(b).alias(f"f_{b}") for b in by], F.col("lo").alias("f_lo"), F.col("hi").alias("f_hi"))
    same = [F.col(b).eqNullSafe(F.col(f"f_{b}")) for b in by]
    inside = (F.col(col) >= F.col("f_lo")) & (F.col(col) <= F.col("f_hi"))
    side = F.broadcast(small) if bounded_groups else small
    return df.join(side, same, "inner").filter(inside).select(*df.columns)


def complete_cases(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value (null or NaN) in the chosen columns."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def symmetric_bound(df: DataFrame, cols: Sequence[str], limit: float) -> DataFrame:
    """Rows where every column lies strictly within plus or minus ``limit``."""
    for c in cols:
        df = df.filter(F.abs(F.col(c)) < limit)
    return df
