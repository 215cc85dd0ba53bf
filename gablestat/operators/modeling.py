"""Preparing model inputs, fitting trees, and judging predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gablestat.operators.profile import columns_over_missing, missing_profile, value_modes
from gablestat.operators.quantiles import column_quantiles, nth_smallest, quantiles
from gablestat.session import cut_lineage, ensure_checkpoint_dir


def drop_sparse(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Without the columns that miss more than ``threshold`` of their values."""
    return df.drop(*[r["column"] for r in columns_over_missing(df, threshold).collect()])


def impute(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], *, approx: bool = False) -> DataFrame:
    """Missing numbers become the column's median, missing labels its most frequent value."""
    # Each set of fill values enters the plan once, as a column, however many columns use it.
    columns, fills = df.columns, {}
    if numeric:
        tall = column_quantiles(df.select(*numeric), numeric, [0.5], approx=approx, names=["m"])
        middle = tall.agg(F.map_from_entries(F.collect_list(F.struct("column", "m"))).alias("m")).scalar()
        df = df.withColumn("__middle", middle)
        for c in numeric:
            x = F.col(c).cast("double")
            fills[c] = F.coalesce(F.when(~F.isnan(x), x), F.try_element_at(F.col("__middle"), F.lit(c)))
    if categorical:
        found = value_modes(df.select(*categorical), categorical)
        common = found.agg(F.map_from_entries(F.collect_list(F.struct("column", "mode"))).alias("m")).scalar()
        df = df.withColumn("__common", common)
        for c in categorical:
            fills[c] = F.coalesce(F.col(c).cast("string"), F.try_element_at(F.col("__common"), F.lit(c)))
    return df.withColumns(fills).select(*columns)


def hash_number(keys: Sequence[str], seed: int, digits: int) -> Column:
    """Whole number made of the first hex digits of md5(key|...|seed)."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def split_hash(df: DataFrame, keys: Sequence[str], frac: float = 0.8, seed: int = 42, name: str = "split") -> DataFrame:
    """Adds ``train`` or ``test`` by a hash of the key: the same under any partitioning."""
    share = hash_number(keys, seed, 8) % 100
    return df.withColumn(name, F.when(share < int(round(frac * 100)), "train").otherwise("test"))


def split_stratified(
    df: DataFrame, y: str, keys: Sequence[str], frac: float = 0.8, groups: int = 5, seed: int = 42, name: str = "split"
) -> DataFrame:
    """``train``/``test`` with the same share in every quantile band of the target.

    Bands lie between ``groups`` evenly spaced quantiles, upper edge included. In each
    band the ceil(frac n) rows with the smallest key hash are train. The hash at that rank
    is searched for without sorting a band in one task; rows sharing a key share a side. The rows are stored with their hash first.
    """
    probs = [i / (groups - 1) for i in range(1, groups - 1)]
    rows = cut_lineage(df.withColumn("__h", hash_number(keys, seed, 13).cast("double")))
    cuts = quantiles(rows, y, probs)
    edges = cuts.select(F.array(*cuts.columns).alias("e")).scalar()
    stratum = F.size(F.filter("__edges", lambda e: F.col(y) > e))
    rows = rows.withColumn("__edges", edges).withColumn("stratum", stratum).drop("__edges")

    def rank(total: Column) -> Column:
        return F.greatest(F.ceil(total * F.lit(float(frac))) - 1, F.lit(0))

    # One row per band: the number of bands bounds this state and the broadcast.
    limit = nth_smallest(rows, "__h", rank, ["stratum"], bounded_groups=True)
    limit = limit.select(F.col("stratum").alias("__s"), F.col("value").alias("__limit"))
    out = rows.join(F.broadcast(limit), F.col("stratum").eqNullSafe(F.col("__s")), "left")
    side = F.when(F.col("__h") <= F.col("__limit"), "train").otherwise("test")
    return out.withColumn(name, side).drop("__h", "__s", "__limit")


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector without an intercept column; a missing input is an error."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def prepare(
    df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = (), threshold: float = 0.5
) -> tuple[DataFrame, list[str]]:
    """Selection, sparse columns out, imputation and label codes, as ``(keys..., features, target)``.

    The chosen columns are written to the shared folder first, since profiling reads them
    several times, and the finished vectors once more, since training does. Fill values
    are searched for only where something is missing.
    """
    from gablestat.operators.encoding import NominalCodes, coerce_mostly_numeric

    present = [c for c in features if c in df.columns]
    extra = [k for k in keys if k not in present and k != target]
    chosen = cut_lineage(df.select(*extra, *present, target))
    profile = missing_profile(chosen.select(*present), only_missing=False).collect()
    kept_names = {r["column"] for r in profile if r["missing_pct"] <= threshold * 100}
    gaps = {r["column"] for r in profile if r["missing_count"] > 0}
    kept = [c for c in present if c in kept_names]
    before = dict(chosen.dtypes)
    chosen = coerce_mostly_numeric(chosen.select(*extra, *kept, target), kept)
    gaps |= {c for c, t in chosen.dtypes if before[c] != t}
    text = [f.name for f in chosen.schema.fields if f.name in kept and isinstance(f.dataType, T.StringType)]
    numbers = [c for c in kept if c not in text]
    filled = impute(chosen, [c for c in numbers if c in gaps], [c for c in text if c in gaps])
    # Imputed labels are levels already, so the codes can be learned from the rows as they are.
    coded = NominalCodes(chosen, text).transform(filled, "_code")
    columns = [f"{c}_code" if c in text else c for c in kept]
    return cut_lineage(assemble(coded, columns).select(*extra, "features", target)), columns


def fit_tree(
    train: DataFrame, label: str, features: str = "features", depth: int = 15, min_leaf: int = 5,
    bins: int = 64, seed: int = 42,
):
    """Regression tree; two leaves of at least five rows imply ten rows at a split."""
    ensure_checkpoint_dir(train.sparkSession)
    return DecisionTreeRegressor(
        labelCol=label, featuresCol=features, maxDepth=depth, minInstancesPerNode=min_leaf, maxBins=bins, seed=seed,
        maxMemoryInMB=512, cacheNodeIds=True, checkpointInterval=10,
    ).fit(train)


def fit_gbt(
    train: DataFrame, label: str, features: str = "features", rounds: int = 300, step: float = 0.05, depth: int = 8,
    rows: float = 0.8, columns: float = 0.8, bins: int = 64, seed: int = 42,
) -> GBTRegressionModel:
    """Boosted trees on squared error. Column sampling is per node; leaves carry no penalty."""
    ensure_checkpoint_dir(train.sparkSession)
    return GBTRegressor(
        labelCol=label, featuresCol=features, maxIter=rounds, stepSize=step, maxDepth=depth, subsamplingRate=rows,
        featureSubsetStrategy=str(columns), maxBins=bins, seed=seed, maxMemoryInMB=512,
        cacheNodeIds=True, checkpointInterval=10,
    ).fit(train)


def first_best_round(losses: Sequence[float], patience: int = 15) -> int:
    """1-based round with the lowest loss before ``patience`` rounds pass without a better one."""
    best, at = float("inf"), 0
    for i, loss in enumerate(losses):
        if loss < best:
            best, at = loss, i
        elif i - at >= patience:
            break
    return at + 1


def best_round(model: GBTRegressionModel, valid: DataFrame, patience: int = 15) -> int:
    return first_best_round(model.evaluateEachIteration(valid, "squared"), patience)


def fit_gbt_early(
    train: DataFrame, label: str, keys: Sequence[str], rounds: int = 300, patience: int = 15,
    valid_frac: float = 0.1, seed: int = 42, **options,
) -> tuple[GBTRegressionModel, int]:
    """Boosting stopped on a slice carved from train, then refitted on all of train.

    The test rows play no part in choosing the number of rounds.
    """
    parts = split_hash(train, keys, 1.0 - valid_frac, seed + 1, "__part")
    fitting, valid = parts.filter("__part = 'train'"), parts.filter("__part = 'test'")
    trial = fit_gbt(fitting, label, rounds=rounds, seed=seed, **options)
    n = best_round(trial, valid, patience)
    return fit_gbt(train, label, rounds=n, seed=seed, **options), n


def regression_metrics(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row: n, mae, rmse, r2 (1 - SSE/SST) and r2_corr (squared correlation)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    sums = pred.filter(y.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.var_pop(y).alias("vy"), F.corr(y, p).alias("r"),
    )
    return sums.select(
        "n", "mae", F.sqrt("mse").alias("rmse"),
        (1 - F.try_divide("mse", "vy")).alias("r2"), (F.col("r") * F.col("r")).alias("r2_corr"),
    )


def importances(model, names: Sequence[str], spark, top: int | None = None) -> DataFrame:
    """``(feature, importance)``, largest first; the values sum to 1."""
    weights = model.featureImportances.toArray()
    rows = [(str(n), float(w)) for n, w in zip(names, weights)]
    out = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")
    return out.limit(top) if top is not None else out


def compare_models(predictions: Mapping[str, DataFrame], label: str, prediction: str = "prediction") -> DataFrame:
    """One row of metrics per named model."""
    out = None
    for name, pred in predictions.items():
        row = regression_metrics(pred, label, prediction).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def prediction_errors(pred: DataFrame, label: str, prediction: str = "prediction", keep: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return pred.select(*keep, y.alias("actual"), p.alias("predicted"), (y - p).alias("residual"))
