"""Ordinary least squares from sufficient statistics.

One pass aggregates counts, means and covariances of the numeric variables over blocks: all rows, the rows of each
category level, and those of each pair of levels of two categorical variables. They hold every entry of the cross-product
matrix of a least-squares fit, of which a level fills few: treatment-coded dummies are never materialised, and the
solving task gets one row per pair of levels that occurs, not one per combination of all categorical variables. Covariances
come from Spark's merging update formula, so money-sized values do not cancel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablestat.functions.probability import f_sf, t_sf

_RESULT = (
    "position int, term string, estimate double, std_error double, t_value double, p_value double, "
    "n bigint, r2 double, adj_r2 double, sigma double, f_value double, f_p_value double"
)


def _solve(scatter: np.ndarray, moment: np.ndarray, tolerance: float = 1e-10):
    """Coefficients and inverse, leaving out columns that earlier ones determine."""
    size = len(moment)
    kept: list[int] = []
    for j in range(size):
        own = scatter[j, j]
        if own <= 0:
            continue
        left = own
        if kept:
            block = scatter[np.ix_(kept, kept)]
            cross = scatter[kept, j]
            left = own - cross @ np.linalg.solve(block, cross)
        if left > tolerance * own:
            kept.append(j)
    beta = np.full(size, np.nan)
    inverse = np.zeros((size, size))
    if kept:
        grid = np.ix_(kept, kept)
        scale = np.sqrt(np.diag(scatter)[kept])
        scaled = np.linalg.inv(scatter[grid] / np.outer(scale, scale))
        inverse[grid] = scaled / np.outer(scale, scale)
        beta[kept] = inverse[grid] @ moment[kept]
    return beta, inverse, kept


def _cross_products(rows: pd.DataFrame, size: int, categorical: Sequence[str], levels: Mapping[str, Sequence[str]]):
    """Total, centre and centred cross products of numeric variables and dummies, the target last.

    ``rows`` are blocks: without a level, with one, or with a pair of levels of two variables.
    """
    given = rows[list(categorical)].notna().sum(axis=1) if categorical else pd.Series(0, index=rows.index)
    whole = rows[given == 0].iloc[0]
    total = float(whole["n"])
    middle = np.array([whole[f"m_{i}"] for i in range(size)], dtype=float)
    places = {(c, v): size - 1 + k for k, (c, v) in enumerate((c, v) for c in categorical for v in levels[c])}
    width = size + len(places)
    target = width - 1
    numeric = [*range(size - 1), target]
    center, scatter = np.zeros(width), np.zeros((width, width))
    center[numeric] = middle
    for i in range(size):
        for j in range(i, size):
            scatter[numeric[i], numeric[j]] = scatter[numeric[j], numeric[i]] = total * float(whole[f"c_{i}_{j}"])
    counts = np.zeros(width)
    for c in categorical:
        for row in rows[(given == 1) & rows[c].notna()].to_dict("records"):
            at = places.get((c, row[c]))
            if at is None:
                continue
            counts[at] = row["n"]
            center[at] = row["n"] / total
            for i in range(size):
                gap = row["n"] * (row[f"m_{i}"] - middle[i])
                scatter[at, numeric[i]] = scatter[numeric[i], at] = gap
    dummies = list(places.values())
    for at in dummies:
        for other in dummies:
            scatter[at, other] = -counts[at] * counts[other] / total
        scatter[at, at] += counts[at]
    for row in rows[given == 2].to_dict("records"):
        (c, v), (d, w) = [(c, row[c]) for c in categorical if isinstance(row[c], str)]
        if (c, v) in places and (d, w) in places:
            at, other = places[c, v], places[d, w]
            scatter[at, other] += row["n"]
            scatter[other, at] += row["n"]
    return total, center, scatter


def _with_whole(levels: pd.DataFrame, size: int, category: str) -> pd.DataFrame:
    """The blocks of levels and the one of all their rows."""
    n = levels["n"].to_numpy(float)
    means = levels[[f"m_{i}" for i in range(size)]].to_numpy(float)
    middle = n @ means / n.sum()
    whole = {**levels.iloc[0].to_dict(), category: None, "n": n.sum(), **{f"m_{i}": middle[i] for i in range(size)}}
    for i in range(size):
        for j in range(i, size):
            between = n @ ((means[:, i] - middle[i]) * (means[:, j] - middle[j]))
            whole[f"c_{i}_{j}"] = (n @ levels[f"c_{i}_{j}"].to_numpy(float) + between) / n.sum()
    return pd.concat([levels, pd.DataFrame([whole])], ignore_index=True)


def _fit(rows: pd.DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str], ref: Mapping[str, str]):
    size = len(numeric) + 1
    terms, levels = list(numeric), {}
    for c in categorical:
        found = sorted(rows[c].dropna().unique())
        base = ref.get(c, found[0])
        if base not in found:
            raise ValueError(f"reference level {base!r} of {c} has no rows")
        levels[c] = [v for v in found if v != base]
        terms += [f"{c}{v}" for v in levels[c]]
    total, center, scatter = _cross_products(rows, size, categorical, levels)
    xx, xy, yy = scatter[:-1, :-1], scatter[:-1, -1], scatter[-1, -1]
    beta, inverse, kept = _solve(xx, xy)
    used = np.nan_to_num(beta)
    residual = max(float(yy - 2 * used @ xy + used @ xx @ used), 0.0)
    rank, free = len(kept), int(total) - len(kept) - 1
    variance = residual / free if free > 0 else np.nan
    r2 = 1.0 - residual / yy if yy > 0 else np.nan
    adjusted = 1.0 - (1.0 - r2) * (total - 1) / free if free > 0 else np.nan
    f_value = (yy - residual) / rank / variance if rank and free > 0 and variance > 0 else np.nan
    middle = center[:-1]
    estimates = [float(center[-1] - used @ middle), *beta]
    errors = [np.sqrt(variance * (1.0 / total + middle @ inverse @ middle))]
    errors += [np.sqrt(variance * inverse[j, j]) if j in kept else np.nan for j in range(len(terms))]
    out = []
    for i, (term, b, se) in enumerate(zip(["(Intercept)", *terms], estimates, errors)):
        t = b / se if se and se > 0 else np.nan
        p = 2.0 * t_sf(abs(t), free) if np.isfinite(t) else np.nan
        out.append((i, term, b, se, t, p, int(total), r2, adjusted, np.sqrt(variance), f_value,
                    f_sf(f_value, rank, free) if np.isfinite(f_value) else np.nan))
    return out


def ols(
    df: DataFrame,
    y: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    ref: Mapping[str, str] | None = None,
    by: Sequence[str] = (),
    min_level_n: int = 1,
) -> DataFrame:
    """Coefficient table ``(by..., position, term, estimate, std_error, t_value, p_value, n, r2, ...)``.

    Rows with a missing model variable are left out. Each categorical variable enters as
    one dummy per level other than its reference (``ref``, default the first level). A
    column that earlier columns determine keeps its row, without an estimate. With one
    categorical variable, ``min_level_n`` leaves out the rows of levels with fewer rows, from their blocks alone.
    """
    ref, by, categorical = dict(ref or {}), list(by), list(categorical)
    if min_level_n > 1 and len(categorical) != 1:
        raise ValueError("levels are left out by their size with one categorical variable only")
    names = [*numeric, y]
    rows = df.select(
        *by, *[F.col(c).cast("string").alias(c) for c in categorical], *[F.col(c).cast("double").alias(c) for c in names]
    ).dropna()
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"m_{i}") for i, c in enumerate(names)]
    for i in range(len(names)):
        for j in range(i, len(names)):
            pair = F.var_pop(names[i]) if i == j else F.covar_pop(names[i], names[j])
            aggs.append(pair.alias(f"c_{i}_{j}"))
    if min_level_n > 1:
        # the blocks of the levels that stay make up the block of all rows
        moments = rows.groupBy(*by, *categorical).agg(*aggs).where(F.col("n") >= min_level_n)
    else:
        blocks = [[], *[[c] for c in categorical], *[list(pair) for pair in combinations(categorical, 2)]]
        moments = rows.groupingSets([[*by, *block] for block in blocks], *by, *categorical).agg(*aggs)
    types = dict(rows.dtypes)
    schema = ", ".join([f"`{b}` {types[b]}" for b in by] + [_RESULT])
    columns = [*by, *[part.split()[0] for part in _RESULT.split(", ")]]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        head = tuple(pdf[b].iloc[0] for b in by)
        pdf = _with_whole(pdf, len(names), categorical[0]) if min_level_n > 1 else pdf
        fitted = _fit(pdf, y, numeric, categorical, ref)
        table = pd.DataFrame([(*head, *row) for row in fitted], columns=columns)
        return table.astype(object).where(table.notna(), None)

    return moments.groupBy(*by).applyInPandas(solve, schema)


def fit_summary(coefficients: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per model: n, R2, adjusted R2, residual deviation, F and its p-value."""
    stats = ["n", "r2", "adj_r2", "sigma", "f_value", "f_p_value"]
    return coefficients.filter(F.col("position") == 0).select(*by, *stats)


def tidy_coefficients(coefficients: DataFrame, z: float = 1.96, alpha: float = 0.05) -> DataFrame:
    """Coefficients other than the intercept with their interval and a significance flag."""
    return coefficients.filter(F.col("term") != "(Intercept)").withColumns(
        {
            "ci_lower": F.col("estimate") - F.col("std_error") * z,
            "ci_upper": F.col("estimate") + F.col("std_error") * z,
            "significant": F.col("p_value") < alpha,
        }
    )


def significant_count(coefficients: DataFrame, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    tidy = coefficients.filter((F.col("term") != "(Intercept)") & F.col("estimate").isNotNull())
    return tidy.groupBy(*by).agg(
        F.count_if(F.col("p_value") < alpha).alias("significant"), F.count(F.lit(1)).alias("terms")
    )


def compare_coefficients(
    old: DataFrame, new: DataFrame, rename: Mapping[str, str] | None = None
) -> DataFrame:
    """``(term, estimate_old, estimate_new, change)`` for terms both models estimate.

    ``rename`` maps name prefixes of the old model to current ones.
    """
    term = F.col("term")
    for prefix, current in (rename or {}).items():
        term = F.regexp_replace(term, f"^{prefix}", current)
    a = old.select(term.alias("term"), F.col("estimate").alias("estimate_old"))
    b = new.select("term", F.col("estimate").alias("estimate_new"))
    return (
        a.join(b, "term")
        .filter((F.col("term") != "(Intercept)") & F.col("estimate_old").isNotNull() & F.col("estimate_new").isNotNull())
        .withColumn("change", F.col("estimate_new") - F.col("estimate_old"))
    )


def residuals(
    df: DataFrame,
    coefficients: DataFrame,
    y: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    ref: Mapping[str, str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(keep..., actual, fitted, residual)`` for rows with every model variable.

    ``ref`` names the reference level of every categorical variable, as the coefficients don't. A level that the model
    has not seen gives null.
    """
    ref = dict(ref or {})
    if unnamed := [c for c in categorical if c not in ref]:
        raise ValueError(f"name the reference levels of {unnamed}: without them an unseen level can't be told from the reference")
    pairs = F.map_from_entries(F.collect_list(F.struct("term", F.coalesce("estimate", F.lit(0.0)))))
    columns = list(dict.fromkeys([*keep, y, *numeric, *categorical]))
    rows = df.dropna(subset=[y, *numeric, *categorical]).select(*columns)
    rows = rows.withColumn("__b", coefficients.agg(pairs.alias("b")).scalar())
    b = F.col("__b")
    fitted = F.try_element_at(b, F.lit("(Intercept)"))
    for c in numeric:
        fitted = fitted + F.try_element_at(b, F.lit(c)) * F.col(c).cast("double")
    for c in categorical:
        own = F.try_element_at(b, F.concat(F.lit(c), F.col(c)))
        # The reference level has no term of its own, an unseen level no fitted value.
        fitted = fitted + F.when(F.col(c) == ref[c], 0.0).otherwise(own)
    out = rows.select(*keep, F.col(y).cast("double").alias("actual"), fitted.alias("fitted"))
    return out.withColumn("residual", F.col("actual") - F.col("fitted"))


def residual_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("residual").alias("n"), F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("sd")
    )
