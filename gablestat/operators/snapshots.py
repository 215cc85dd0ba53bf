"""Comparing yearly snapshots of the same roll."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gablestat.functions.columns import pct_change, pp_change
from gablestat.operators.quantiles import medians
from gablestat.session import cut_lineage


def with_snapshot(df: DataFrame, year: int, name: str = "fiscal_year") -> DataFrame:
    return df.withColumn(name, F.lit(year))


def stack_snapshots(*frames: DataFrame) -> DataFrame:
    """Union by name; a column one snapshot lacks is null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def matched_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys present in both snapshots."""
    return a.select(key).intersect(b.select(key)).dropna()


def matched_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return matched_keys(a, b, key).agg(F.count(F.lit(1)).alias("matched"))


def keep_matched(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; ``keys`` may repeat keys, so the other snapshot itself will do."""
    listed = keys.select(F.col(key).alias("__key"))
    return df.join(listed, F.col(key) == F.col("__key"), "left_semi")


#: A key is hot with one in so many of all rows; a hot key's rows are dealt to a task for about every such share.
HOT_SHARE = 400


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """``(key, n, salts)``: every key with one in ``share`` of the rows, and some with half of that, from one scan.

    Each task reports the keys with at least half that share of a batch of its rows. Of a hot key, less than half its share goes
    unreported, so those reported for half the share overall include it, and are ``2 share`` keys at most: that bounds
    what is shuffled of a batch and the result. ``salts`` is the number of tasks that the key's rows deserve.
    """
    name = df.schema[key].dataType.simpleString()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = batch.column(0).value_counts()
            often = pc.greater_equal(counted.field(1), pa.scalar(max(1, -(-batch.num_rows // (2 * share))), pa.int64()))
            found = counted.filter(often)
            yield pa.record_batch([found.field(0), found.field(1), pa.nulls(len(found), pa.int64())], names=["key", "n", "total"])
            yield pa.record_batch([pa.nulls(1, batch.schema.field(0).type), pa.nulls(1, pa.int64()), pa.array([batch.num_rows])], names=["key", "n", "total"])

    reported = df.select(F.col(key).alias("key")).where("key is not null").mapInArrow(report, f"key {name}, n long, total long")
    sums = cut_lineage(reported.groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    total = sums.agg(F.sum("total")).first()[0] or 0
    kept = sums.where(F.col("key").isNotNull() & (F.col("n") * (2 * share) >= F.lit(total)))
    return kept.select(F.col("key").alias(key), "n", F.ceil(F.col("n") * share / F.lit(max(total, 1))).cast("int").alias("salts"))


def match_snapshots(
    a: DataFrame, b: DataFrame, key: str, cols: Sequence[str], suffixes: tuple[str, str], salts: int | None = None
) -> DataFrame:
    """One row per pair of records with the same key, columns suffixed by snapshot.

    A missing key matches nothing. A key repeated on both sides pairs up as in any
    relational join. The hot keys of ``a`` are found by a scan: the rows of each spread over as many tasks as their number
    asks for, and each meets a copy of the matching rows of ``b``; other keys stay as they are. ``salts`` spreads all keys alike.
    """
    left = a.select(F.col(key), *[F.col(c).alias(c + suffixes[0]) for c in cols]).filter(F.col(key).isNotNull())
    right = b.select(F.col(key), *[F.col(c).alias(c + suffixes[1]) for c in cols]).filter(F.col(key).isNotNull())
    row = F.xxhash64(*left.columns)  # of the contents, so that a task that runs again deals its rows alike
    if salts is None:
        hot = F.broadcast(cut_lineage(hot_keys(a, key)).select(F.col(key).alias("__hot"), "salts"))  # 2 HOT_SHARE rows at most
        own = F.coalesce("salts", F.lit(1))
        left = left.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.pmod(row, own).cast("int")).drop("__hot", "salts")
        right = right.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), own - 1))).drop("__hot", "salts")
        return left.join(right, [key, "__salt"], "inner").drop("__salt")
    if salts <= 1:
        return left.join(right, key, "inner")
    left = left.withColumn("__salt", F.pmod(row, F.lit(salts)).cast("int"))
    right = right.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "__salt"], "inner").drop("__salt")


def pair_up(
    df: DataFrame, key: str, period: str, periods: tuple[int, int], cols: Sequence[str],
    combine: Callable[[Column], Column] = F.max,
) -> DataFrame:
    """Long panel to matched pairs with a single shuffle and no join.

    Each key gets its value in either period; ``combine`` folds several records of one
    key and period into one (the default suits panels with at most one). Keys missing
    from a period are left out. Rows combine before the shuffle, so a hot key is no burden.
    """
    old, new = periods
    rows = df.filter(F.col(period).isin(old, new) & F.col(key).isNotNull())
    aggs = [F.count_if(F.col(period) == p).alias(f"__n_{p}") for p in periods]
    for c in cols:
        for p in periods:
            aggs.append(combine(F.when(F.col(period) == p, F.col(c))).alias(f"{c}_{p}"))
    out = rows.groupBy(key).agg(*aggs)
    return out.filter((F.col(f"__n_{old}") > 0) & (F.col(f"__n_{new}") > 0)).drop(*[f"__n_{p}" for p in periods])


def pct_change_cols(
    df: DataFrame, names: Mapping[str, str], suffixes: tuple[str, str], ieee: bool = False
) -> DataFrame:
    """Adds a percent-change column per entry of ``names`` (base column -> new column)."""
    return df.withColumns(
        {new: pct_change(base + suffixes[0], base + suffixes[1], ieee=ieee) for base, new in names.items()}
    )


def matched_change_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: exact median of each change column."""
    return medians(df, cols)


def snapshot_summary(
    df: DataFrame, metrics: Mapping[str, str], period: str = "fiscal_year", *, approx: bool = False
) -> DataFrame:
    """``(period, n, ...)``: group size and median of each metric (column -> result name)."""
    middle = medians(df, list(metrics), [period], approx=approx)
    middle = middle.select(F.col(period).alias("__p"), *[F.col(c).alias(name) for c, name in metrics.items()])
    sizes = df.groupBy(period).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(middle, F.col(period).eqNullSafe(F.col("__p"))).drop("__p")


def snapshot_change(
    summary: DataFrame, periods: tuple[int, int], metrics: Sequence[str], period: str = "fiscal_year", scale: int = 2
) -> DataFrame:
    """``(metric, old, new, pct_change, pp_change)`` between two rows of a snapshot summary."""
    def at(p: int, m: str):
        return F.max(F.when(F.col(period) == p, F.col(m)))

    wide = summary.agg(*[F.struct(at(periods[0], m).alias("old"), at(periods[1], m).alias("new")).alias(m) for m in metrics])
    return wide.unpivot([], list(metrics), "metric", "s").select(
        "metric", "s.old", "s.new",
        pct_change("s.old", "s.new", scale).alias("pct_change"),
        pp_change("s.old", "s.new", scale).alias("pp_change"),
    )
