"""Exact interpolated quantiles from two reads, that never hold a whole group in one task.

Spark's own ``percentile`` keeps every distinct value of a group in one hash map, which one hot group of a large table
outgrows. Here the rows are read twice:

1. a mergeable sketch of each group gives, for every wanted rank, a bracket of two values around it. The sketch's ranks are
   off by less than ``SLACK`` but for odds of about one in 10^8;
2. rows between brackets are only counted; the values inside them, about one in a hundred of the rows for each
   quantile, are counted one by one and stored.

The rank is then searched for among the stored counts. Up to ``FEW_COUNTS`` of them are sorted and summed up per group. If there
are more, values fall into buckets that depend on the value alone (1024 per
power of two), the running count over the buckets of a group tells which bucket holds a rank; that bucket is counted again
in 2**20 equal slices between its extremes, and the values in the one slice left one by one. A step is left out for a rank
whose bucket or slice holds a single value. A bucket is at most 0.07 % wide and a slice at most 6.6e-10 of its value
wide, so a slice holds fewer than six million different doubles whatever the input is: every window below sorts
a bounded number of counts. The counts before a bracket are exact, so a bracket that misses its rank is noticed, and the second read
is repeated with wider ones until none does. Only counts are shuffled, combined before the shuffle, so neither a
hot group nor a hot value loads one task. Both reads run when the function is called; put a costly pipeline behind
``session.cut_lineage`` first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gablestat.session import drop_stored, store

BUCKETS_PER_OCTAVE = 1024
# Up to this many groups, one small row per group and rank may be broadcast.
FEW_GROUPS = 20000
# Accuracy of the sketch, the values of it that are looked at, and four times the rank error of one standard bound.
SKETCH_K = 4000
# Up to this many stored counts, a group's are summed up in one window.
FEW_COUNTS = 1 << 20
GRID = 256
SLACK = 4 * 2.296 / SKETCH_K**0.9723
SLICES = 1 << 20
# Exponents of doubles lie in -1074..1024; the offset makes every bucket of |v| positive.
_OFFSET = 1100 * BUCKETS_PER_OCTAVE


def _value_bucket(value: Column) -> Column:
    """Integer bucket that never decreases as the value grows."""
    exponent = F.least(F.log2(F.abs(value)), F.lit(1024.0))
    size = F.floor(exponent * BUCKETS_PER_OCTAVE) + F.lit(_OFFSET)
    return F.when(value == 0, F.lit(0)).when(value < 0, -size).otherwise(size)


def _slice(value: Column, lo: Column, hi: Column) -> Column:
    position = F.try_divide(value - lo, hi - lo)
    inside = position.isNotNull() & ~F.isnan(position)
    return F.when(inside, F.floor(position * SLICES)).otherwise(F.when(value > lo, F.lit(SLICES)).otherwise(0))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def numbers(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., v)``: the non-missing values as doubles."""
    return df.select(*[F.col(b) for b in by], _number(F.col(value)).alias("v")).filter(F.col("v").isNotNull())


def _running(part: Sequence[str], order: str) -> Column:
    frame = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum("n").over(frame)


def _number(value: Column) -> Column:
    # Adding zero turns -0.0 into 0.0, so equal values are the same value everywhere.
    number = value.cast("double") + F.lit(0.0)
    return F.when(~F.isnan(number), number)


def _grid(sketch: str) -> Column:
    ranks = ", ".join(f"{i / GRID!r}D" for i in range(GRID + 1))
    return F.expr(f"kll_sketch_get_quantile_double({sketch}, array({ranks}))")


def sketched(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(t_by..., t_total, grid)``: group sizes and ``GRID + 1`` evenly spaced quantiles by a sketch; the first read."""
    keys = [F.col(b).alias(f"t_{b}") for b in by]
    sketches = rows.groupBy(*keys).agg(F.count("v").alias("t_total"), F.expr(f"kll_sketch_agg_double(v, {SKETCH_K})").alias("sketch"))
    return sketches.where("t_total > 0").select(*[f"t_{b}" for b in by], "t_total", _grid("sketch").alias("grid"))


def sketched_columns(df: DataFrame, cols: Sequence[str], by: Sequence[str], more=None) -> DataFrame:
    """As ``sketched`` for columns stacked by ``melt``, without stacking them: ``(t_by..., t_place, t_total, grid)``.

    ``more`` makes a struct of further aggregates of a column, found in the same read and returned as ``more``.
    """
    rows = df.select(*[F.col(b).alias(f"t_{b}") for b in by], *cols, *[_number(F.col(c)).alias(f"v{i}") for i, c in enumerate(cols)])
    found = rows.groupBy(*[f"t_{b}" for b in by]).agg(*[x for i, c in enumerate(cols) for x in (
        F.count(f"v{i}").alias(f"n{i}"), F.expr(f"kll_sketch_agg_double(v{i}, {SKETCH_K})").alias(f"k{i}"), *([more(c).alias(f"m{i}")] if more else []))])
    tall = F.array(*[F.struct(F.lit(i).alias("t_place"), F.col(f"n{i}").alias("t_total"), F.col(f"k{i}").alias("sketch"),
                              *([F.col(f"m{i}").alias("more")] if more else [])) for i in range(len(cols))])
    out = found.select(*[f"t_{b}" for b in by], F.inline(tall))
    grid = F.when(F.col("t_total") > 0, _grid("sketch")).alias("grid")
    return out.select(*[f"t_{b}" for b in by], "t_place", "t_total", grid, *(["more"] if more else []))


def _wanted(targets, total: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("slot"), rank(total).cast("bigint").alias("rank")) for i, rank in enumerate(targets)])


def _brackets(state: DataFrame, targets, spans: Sequence[tuple[int, int]], slack: float) -> DataFrame:
    """``(t_by..., lo0, hi0, ..)``: two values around the ranks of every span, given by its first and last target."""
    total = F.col("t_total").cast("double")
    cells = {}
    for i, (first, last) in enumerate(spans):
        low = F.greatest(F.floor((targets[first](F.col("t_total")) / total - slack) * GRID), F.lit(0))
        high = F.least(F.ceil(((targets[last](F.col("t_total")) + 1) / total + slack) * GRID), F.lit(GRID))
        cells |= {f"lo{i}": F.element_at("grid", low.cast("int") + 1), f"hi{i}": F.element_at("grid", high.cast("int") + 1)}
    return state.withColumns(cells).drop("grid", "t_total")


def bracketed(rows: DataFrame, by: Sequence[str], brackets: DataFrame, bounded: bool) -> DataFrame:
    """``(by..., v, n, top)``: values inside brackets with their counts, and one row for each gap between them, whose
    values reach from ``v`` to ``top``; the second read."""
    names = [c for c in brackets.columns if c.startswith("lo")]
    if by:
        side = F.broadcast(brackets) if bounded else brackets
        met = rows.join(side, _same(by, [f"t_{b}" for b in by]), "inner")
        ends = [(F.col(c), F.col(f"hi{c[2:]}")) for c in names]
    else:
        found = brackets.collect()  # one row, or none without values
        met = rows if found else rows.where(F.lit(False))
        ends = [(F.lit(r[c]), F.lit(r[f"hi{c[2:]}"])) for r in found for c in names]
    inside = reduce(or_, [(F.col("v") >= lo) & (F.col("v") <= hi) for lo, hi in ends], F.lit(False))
    gap = reduce(add, [(hi < F.col("v")).cast("int") for _, hi in ends], F.lit(0))
    keys = [gap.alias("gap"), F.when(inside, F.col("v")).alias("kept")]
    counts = met.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return counts.select(*by, F.col("lo").alias("v"), "n", F.col("hi").alias("top"))


def _searched(rows: DataFrame, by: Sequence[str], targets, bounded: bool) -> DataFrame:
    """``(by..., slot, total, value, top)`` at wanted 0-based ranks of counted values ``(by..., v, n, top)``."""
    by = list(by)
    keys = [f"t_{b}" for b in by]
    rows = rows.withColumn("bucket", _value_bucket(F.col("v")))
    found = [F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("top").alias("top")]
    place = [*keys, "t_bucket"]
    state = [*place, "t_total", "t_start", "t_lo", "t_hi", "t_top", "wanted"]

    def holding(pieces: DataFrame) -> DataFrame:
        """The pieces that hold a wanted rank, given their counts up to and including them."""
        start = F.col("upto") - F.col("n")
        inside = F.filter(_wanted(targets, F.col("t_total")), lambda t: (t["rank"] >= start) & (t["rank"] < F.col("upto")))
        bounds = [start.alias("t_start"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"), F.col("top").alias("t_top")]
        kept = pieces.withColumn("wanted", inside).filter(F.size("wanted") > 0)
        return kept.select(*place, "t_total", *bounds, "wanted").select(*state)

    def split_up(parents: DataFrame, piece: Column) -> DataFrame:
        """Values within the bounds of a parent, counted per piece of it."""
        side = F.broadcast(parents) if bounded else parents
        within = rows.join(side.drop("wanted", "t_top"), _same([*by, "bucket"], place), "inner").filter(
            (F.col("v") >= F.col("t_lo")) & (F.col("v") <= F.col("t_hi"))
        )
        carried = [*place, "t_lo", "t_start", "t_total"]
        counts = within.groupBy(*carried, piece.alias("piece")).agg(*found)
        return holding(counts.withColumn("upto", _running([*place, "t_lo"], "piece") + F.col("t_start")))

    buckets = rows.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col("bucket").alias("t_bucket")).agg(*found)
    total = F.sum("n").over(Window.partitionBy(*keys))
    chosen = holding(buckets.withColumns({"upto": _running(keys, "t_bucket"), "t_total": total}))
    slices = split_up(chosen.filter("t_lo < t_hi"), _slice(F.col("v"), F.col("t_lo"), F.col("t_hi")))
    values = split_up(slices.filter("t_lo < t_hi"), F.col("v"))
    settled = chosen.filter("t_lo = t_hi").unionByName(slices.filter("t_lo = t_hi")).unionByName(values)
    return settled.select(
        *[F.col(k).alias(b) for b, k in zip(by, keys)],
        F.col("t_total").alias("total"), F.col("t_lo").alias("value"), F.col("t_top").alias("top"), F.explode("wanted.slot").alias("slot"),
    )


def _summed(rows: DataFrame, by: Sequence[str], targets) -> DataFrame:
    """As ``_searched``, with all counts of a group in one window."""
    start = F.col("upto") - F.col("n")
    placed = rows.withColumns({"upto": _running(by, "v"), "total": F.sum("n").over(Window.partitionBy(*by))})
    inside = F.filter(_wanted(targets, F.col("total")), lambda t: (t["rank"] >= start) & (t["rank"] < F.col("upto")))
    return placed.select(*by, "total", F.col("v").alias("value"), "top", F.explode(F.transform(inside, lambda t: t["slot"])).alias("slot"))


def ranked_values(
    rows: DataFrame, by: Sequence[str], targets, bounded: bool | None = None, spans: Sequence[tuple[int, int]] | None = None,
    sketches: DataFrame | None = None, slack: float = SLACK,
) -> DataFrame:
    """Values at wanted 0-based ranks.

    ``rows`` comes from ``numbers``; each of ``targets`` gives a rank from the group size, ``slot`` is its place; ``spans``
    puts neighbouring targets into one bracket. ``sketches`` are those of the rows, if there is a cheaper way to them. What
    is kept of each group is broadcast if the sketches, once stored, turn out to be of at most ``FEW_GROUPS``
    groups; ``bounded`` says so beforehand. Result: ``(by..., slot, total, value)``.
    """
    by, spark = list(by), rows.sparkSession
    spans = spans or [(i, i) for i in range(len(targets))]
    state, state_path = store(sketched(rows, by) if sketches is None else sketches.where("t_total > 0"))
    bounded = bounded or not by or state.count() <= FEW_GROUPS
    while True:
        pieces, pieces_path = store(bracketed(rows, by, _brackets(state, targets, spans, slack), bounded))
        few = pieces.count() <= FEW_COUNTS
        out, out_path = store(_summed(pieces, by, targets) if few else _searched(pieces, by, targets, bounded))
        drop_stored(spark, pieces_path)
        if slack >= 1 or out.where("value < top").isEmpty():
            break
        drop_stored(spark, out_path)
        slack = min(1.0, slack * 16)
    drop_stored(spark, state_path)
    return out.drop("top")


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    *,
    approx: bool = False,
    accuracy: int = 10000,
    bounded_groups: bool | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One row per group with one column per probability (``names``, default ``q0..``).

    Linear interpolation between order statistics, position ``(n - 1) * p``; missing
    values are left out. ``approx=True`` uses Spark's bounded quantile sketch instead.
    ``bounded_groups`` says that the groups are few enough to broadcast something for each; without it they are counted
    once the first read has stored them.
    """
    by = list(by)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    if approx:
        number = F.col(value).cast("double")
        sketch = F.percentile_approx(F.when(~F.isnan(number), number), F.lit([float(p) for p in probs]), accuracy)
        return (
            df.groupBy(*by)
            .agg(sketch.alias("sketch"))
            .select(*by, *[F.col("sketch")[i].alias(name) for i, name in enumerate(names)])
        )

    return _interpolated(numbers(df, value, by), probs, by, names, bounded_groups)


def _position(p: float, total: Column) -> Column:
    return (total - 1) * F.lit(float(p))


def _interpolated(rows: DataFrame, probs: Sequence[float], by: Sequence[str], names: Sequence[str], bounded, sketches=None) -> DataFrame:
    targets, spans = [], []
    for i, p in enumerate(probs):
        targets += [lambda total, p=p: F.floor(_position(p, total)), lambda total, p=p: F.ceil(_position(p, total))]
        spans.append((2 * i, 2 * i + 1))
    ranked = ranked_values(rows, by, targets, bounded, spans, sketches)
    picks = [F.max(F.when(F.col("slot") == s, F.col("value"))).alias(f"v{s}") for s in range(2 * len(probs))]
    wide = ranked.groupBy(*by).agg(F.max("total").alias("total"), *picks)
    columns = []
    for i, (p, name) in enumerate(zip(probs, names)):
        low, high = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        weight = _position(p, F.col("total")) - F.floor(_position(p, F.col("total")))
        columns.append(F.when(low == high, low).otherwise(low + (high - low) * weight).alias(name))
    return wide.select(*by, *columns)


def melt(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., place, value)``: numeric columns stacked into one double column.

    ``place`` is the position in ``cols``: a small integer groups faster than a name.
    """
    stacked = F.array(*[F.col(c).cast("double") for c in cols])
    return df.select(*by, F.posexplode(stacked).alias("place", "value"))


def column_name(cols: Sequence[str], place: str = "place") -> Column:
    """Name of the column at a position of ``cols``."""
    return F.element_at(F.array(*[F.lit(c) for c in cols]), F.col(place) + 1)


def column_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    *,
    approx: bool = False,
    names: Sequence[str] | None = None,
    bounded_groups: bool | None = None,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """``(by..., column, q...)`` for several columns in one search; ``sketches`` of ``sketched_columns`` save the first read."""
    names = list(names or [f"q{i}" for i in range(len(probs))])
    tall = melt(df, cols, by)
    if approx:
        out = quantiles(tall, "value", probs, [*by, "place"], approx=True, names=names)
    else:
        rows = numbers(tall, "value", [*by, "place"])
        out = _interpolated(rows, probs, [*by, "place"], names, bounded_groups, sketched_columns(df, cols, by) if sketches is None else sketches)
    return out.select(*by, column_name(cols).alias("column"), *names)


def medians(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), *, approx: bool = False) -> DataFrame:
    """One row per group with the median of each column under the column's own name."""
    by = list(by)
    tall = column_quantiles(df, cols, [0.5], by, approx=approx, names=["median"])
    picks = [F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in cols]
    return tall.groupBy(*by).agg(*picks)


def nth_smallest(df: DataFrame, value: str, rank, by: Sequence[str] = (), *, bounded_groups: bool | None = None) -> DataFrame:
    """``(by..., total, value)``: the value at a 0-based rank given as a function of the group size."""
    return ranked_values(numbers(df, value, by), by, [rank], bounded_groups).drop("slot")
