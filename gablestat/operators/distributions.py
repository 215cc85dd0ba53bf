"""The numbers behind each chart: histograms, densities, fits, grids, correlations."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablestat.operators.filters import complete_cases
from gablestat.operators.quantiles import quantiles


def histogram_width(df: DataFrame, col: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., bin, count)`` with bins centred on multiples of the width, upper edge included."""
    x = F.col(col).cast("double")
    index = F.ceil(x / F.lit(float(width)) - 0.5)
    return (
        df.filter(x.isNotNull() & ~F.isnan(x))
        .groupBy(*by, index.alias("bin_index"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(*by, "bin_index", (F.col("bin_index") * F.lit(float(width))).alias("bin_center"), "count")
    )


def histogram_bins(df: DataFrame, col: str, bins: int) -> DataFrame:
    """``(bin, lower, upper, count)``: equal bins between the extremes, empty ones included, the maximum in the last."""
    x = F.col(col).cast("double")
    rows = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    edges = rows.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("e")).scalar()
    place = F.try_divide(F.col("x") - edges["lo"], edges["hi"] - edges["lo"]) * bins
    index = F.least(F.coalesce(F.floor(place), F.lit(0)), F.lit(bins - 1))
    counts = rows.groupBy(index.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    step = (edges["hi"] - edges["lo"]) / bins
    ids = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return ids.join(counts, F.col("bin") == F.col("b"), "left").select(
        "bin",
        (edges["lo"] + F.col("bin") * step).alias("lower"),
        (edges["lo"] + (F.col("bin") + 1) * step).alias("upper"),
        F.coalesce("c", F.lit(0)).alias("count"),
    )


def bandwidth(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Rule-of-thumb Gaussian bandwidth per group: 0.9 min(sd, IQR / 1.34) n^(-1/5)."""
    x = F.col(col).cast("double")
    rows = df.filter(x.isNotNull() & ~F.isnan(x))
    spread = rows.groupBy(*by).agg(F.stddev_samp(x).alias("sd"), F.count(x).alias("n"))
    quart = quantiles(rows, col, [0.25, 0.75], by, names=["q1", "q3"])
    if by:
        quart = quart.select(*[F.col(b).alias(f"q_{b}") for b in by], "q1", "q3")
        joined = spread.join(quart, [F.col(b).eqNullSafe(F.col(f"q_{b}")) for b in by])
    else:
        pair = quart.select(F.struct("q1", "q3").alias("q")).scalar()
        joined = spread.withColumns({"q1": pair["q1"], "q3": pair["q3"]})
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    scale = F.when(iqr > 0, F.least("sd", iqr)).otherwise(F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    return joined.select(*by, "n", (scale * 0.9 * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))


def density(
    df: DataFrame, col: str, by: Sequence[str] = (), points: int = 512, bw: float | None = None,
    lo: float | None = None, hi: float | None = None,
) -> DataFrame:
    """``(by..., grid, x, density)``: Gaussian kernel density at ``points`` places from lo to hi.

    The places span the data unless lo and hi are given. Rows are shared linearly between the two grid places next to them, then the grid
    weights are smoothed: work after the first aggregate is groups x points x points,
    whatever the number of rows. Rows outside [lo, hi] carry no weight on the grid but count in n.
    """
    by = list(by)
    x = F.col(col).cast("double")
    rows = df.filter(x.isNotNull() & ~F.isnan(x))
    if lo is None or hi is None:
        ends = rows.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("e")).scalar()
        lo_c, hi_c = ends["lo"], ends["hi"]
    else:
        lo_c, hi_c = F.lit(float(lo)), F.lit(float(hi))
    step = (hi_c - lo_c) / (points - 1)
    if bw is None:
        sizes = bandwidth(df, col, by)
    else:
        sizes = rows.groupBy(*by).agg(F.count(x).alias("n")).withColumn("bw", F.lit(float(bw)))
    place = F.try_divide(x - lo_c, step)
    cell = F.least(F.floor(place), F.lit(points - 2))
    binned = (
        rows.filter((x >= lo_c) & (x <= hi_c))
        .select(*by, cell.alias("cell"), (place - cell).alias("part"))
        .groupBy(*by, "cell")
        .agg(F.sum(1 - F.col("part")).alias("w_left"), F.sum("part").alias("w_right"))
    )
    weights = binned.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("cell").alias("g"), F.col("w_left").alias("w")),
                F.struct((F.col("cell") + 1).alias("g"), F.col("w_right").alias("w")),
            )
        ).alias("e"),
    ).groupBy(*by, F.col("e.g").alias("g")).agg(F.sum("e.w").alias("w"))
    if by:
        keyed = sizes.select(*[F.col(b).alias(f"s_{b}") for b in by], "n", "bw")
        weights = weights.join(keyed, [F.col(b).eqNullSafe(F.col(f"s_{b}")) for b in by])
    else:
        one = sizes.select(F.struct("n", "bw").alias("s")).scalar()
        weights = weights.withColumns({"n": one["n"], "bw": one["bw"]})
    places = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("grid")
    z = (F.col("grid") - F.col("g")) * step / F.col("bw")
    bump = F.col("w") * F.exp(z * z * -0.5) / (F.col("n") * F.col("bw") * F.sqrt(F.lit(2.0) * F.pi()))
    return (
        weights.select("*", places)
        .groupBy(*by, "grid")
        .agg(F.sum(bump).alias("density"))
        .select(*by, "grid", (lo_c + F.col("grid") * step).alias("x"), "density")
    )


def line_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., slope, intercept, r2, n, x_mean, sxx, sigma)`` of the straight line of y on x."""
    yc, xc = F.col(y).cast("double"), F.col(x).cast("double")
    fit = df.groupBy(*by).agg(
        F.regr_slope(yc, xc).alias("slope"), F.regr_intercept(yc, xc).alias("intercept"),
        F.regr_r2(yc, xc).alias("r2"), F.regr_count(yc, xc).alias("n"),
        F.regr_avgx(yc, xc).alias("x_mean"), F.regr_sxx(yc, xc).alias("sxx"), F.regr_syy(yc, xc).alias("__syy"),
    )
    unexplained = F.col("__syy") - F.col("slope") * F.col("slope") * F.col("sxx")
    sigma = F.when(F.col("n") > 2, F.sqrt(F.greatest(unexplained, F.lit(0.0)) / (F.col("n") - 2)))
    return fit.withColumn("sigma", sigma).drop("__syy")


def line_band(fit: DataFrame, lo: float, hi: float, points: int, z: float = 1.96) -> DataFrame:
    """Fitted line with its confidence band at evenly spaced places."""
    step = (hi - lo) / (points - 1)
    at = F.lit(float(lo)) + F.col("i") * F.lit(step)
    keys = [c for c in fit.columns if c not in ("slope", "intercept", "r2", "n", "x_mean", "sxx", "sigma")]
    wide = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("x", at)
    mid = F.col("intercept") + F.col("slope") * F.col("x")
    gap = F.col("x") - F.col("x_mean")
    half = F.col("sigma") * F.sqrt(1 / F.col("n") + gap * gap / F.col("sxx")) * z
    return wide.select(*keys, "x", mid.alias("fit"), (mid - half).alias("lower"), (mid + half).alias("upper"))


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def grid_counts(df: DataFrame, x: str, y: str, wx: float, wy: float) -> DataFrame:
    """``(x_bin, y_bin, n)``: a scatter reduced to cells of the given size."""
    xb = F.floor(F.col(x) / F.lit(float(wx)))
    yb = F.floor(F.col(y) / F.lit(float(wy)))
    return df.dropna(subset=[x, y]).groupBy(xb.alias("x_bin"), yb.alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(x, y, r, n)`` for every ordered pair, on complete cases.

    Means first, then one aggregate of products of centred values: plain sums stay in
    generated code where dozens of ``corr`` aggregates would not.
    """
    rows = complete_cases(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    means = rows.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("m")).scalar()
    centred = rows.withColumn("__m", means)
    centred = centred.select(*[(F.col(c) - F.col("__m")[c]).alias(f"z{i}") for i, c in enumerate(cols)])
    sums = [
        F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s_{i}_{j}")
        for i, j in itertools.combinations_with_replacement(range(len(cols)), 2)
    ]
    cells = []
    for i, j in itertools.product(range(len(cols)), repeat=2):
        r = F.try_divide(F.col(f"s_{min(i, j)}_{max(i, j)}"), F.sqrt(F.col(f"s_{i}_{i}")) * F.sqrt(F.col(f"s_{j}_{j}")))
        r = F.when(r.isNotNull(), F.lit(1.0)) if i == j else r
        cells.append(F.struct(F.lit(cols[i]).alias("x"), F.lit(cols[j]).alias("y"), r.alias("r")))
    out = centred.agg(F.count(F.lit(1)).alias("n"), *sums)
    return out.select("n", F.explode(F.array(*cells)).alias("c")).select("c.x", "c.y", "c.r", "n")


def correlates(matrix: DataFrame, target: str) -> DataFrame:
    """``(variable, r)`` of all other columns with the target, by absolute r, largest first; one row for each column."""
    others = matrix.filter((F.col("x") == target) & (F.col("y") != target) & F.col("r").isNotNull())
    return others.select(F.col("y").alias("variable"), "r").orderBy(F.abs("r").desc(), "variable")


def strongest_correlate(matrix: DataFrame, target: str, absolute: bool = False) -> DataFrame:
    """One row: the column most correlated with the target, by signed or absolute r."""
    rank = F.abs("r") if absolute else F.col("r")
    others = matrix.filter((F.col("x") == target) & (F.col("y") != target) & F.col("r").isNotNull())
    best = F.min(F.struct((-rank).alias("rank"), F.col("y").alias("variable"), F.col("r"))).alias("best")
    return others.agg(best).select("best.variable", "best.r")
