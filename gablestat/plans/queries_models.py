"""Predicting value (ids M). Fitted trees are checked by row only; what surrounds them by SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gablestat.functions import columns as C
from gablestat.functions import levels
from gablestat.operators import distributions, filters, modeling as M
from gablestat.operators.boosting import Settings, fit_boosted
from gablestat.operators.preparation import RollPreparation, RollPreparationModel
from gablestat.plans.binding import NEW, OLD, assessments
from gablestat.plans.catalog import over_view, register
from gablestat.session import cut_lineage, fresh_path

_HAVE = [
    "bldg_value", "land_value", "gross_area", "living_area", "land_sf", "yr_built", "bed_rms", "full_bth", "hlf_bth", "fireplaces",
    "num_parking", "gross_tax", "bldg_type", "city", "zip_code", "overall_cond", "own_occ",
]


def _roll(spark, folder, *extra):
    rows = assessments(spark, folder, [*_HAVE, "total_value", *extra])
    return rows.withColumn("age_of_property", C.age(NEW, "yr_built"))


@register(
    "m1_feature_selection",
    over_view(
        "SELECT bldg_value, land_value, gross_area, living_area, land_sf, yr_built, bed_rms, full_bth, hlf_bth, fireplaces, num_parking, "
        f"gross_tax, {NEW} - yr_built AS age_of_property, bldg_type, city, zip_code, overall_cond, own_occ, total_value FROM a"
    ),
)
def m1(spark, folder):
    rows = _roll(spark, folder).withColumn("price_per_sqft", C.price_per_area("total_value", "living_area"))
    return filters.select_existing(rows, [*levels.TREE_FEATURES, "total_value"])


_GAPPY_SQL = (
    "gp AS (SELECT record_id, bed_rms, CASE WHEN land_value > 0 THEN gross_tax / land_value END AS ratio, "
    "CASE WHEN num_parking < 6 THEN city END AS city, CASE WHEN num_parking = 0 THEN own_occ END AS sparse FROM a)"
)


def _gappy(spark, folder):
    rows = assessments(spark, folder, ["record_id", "bed_rms", "gross_tax", "land_value", "num_parking", "city", "own_occ"])
    return rows.select(
        "record_id", "bed_rms", F.try_divide("gross_tax", "land_value").alias("ratio"),
        F.when(F.col("num_parking") < 6, F.col("city")).alias("city"),
        F.when(F.col("num_parking") == 0, F.col("own_occ")).alias("sparse"),
    )


@register("m2_drop_sparse", over_view("SELECT record_id, bed_rms, round(ratio, 9) AS ratio, city FROM gp", _GAPPY_SQL))
def m2(spark, folder):
    return M.drop_sparse(_gappy(spark, folder)).withColumn("ratio", F.round("ratio", 9))


@register(
    "m3_impute_median",
    over_view(
        "SELECT record_id, coalesce(CAST(bed_rms AS DOUBLE), (SELECT median(bed_rms) FROM gp)) AS bed_rms, "
        "round(coalesce(ratio, (SELECT median(ratio) FROM gp)), 9) AS ratio FROM gp", _GAPPY_SQL,
    ),
)
def m3(spark, folder):
    rows = _gappy(spark, folder).select("record_id", "bed_rms", "ratio")
    return M.impute(rows, ["bed_rms", "ratio"], []).withColumn("ratio", F.round("ratio", 9))


@register(
    "m4_impute_mode",
    over_view(
        "SELECT record_id, coalesce(city, (SELECT city FROM gp WHERE city IS NOT NULL GROUP BY city ORDER BY count(*) DESC, city LIMIT 1)) AS city "
        "FROM gp", _GAPPY_SQL,
    ),
)
def m4(spark, folder):
    return M.impute(_gappy(spark, folder).select("record_id", "city"), [], ["city"])


def _hash_sql(key: str, digits: int) -> str:
    return f"CAST('0x' || substr(md5({key} || '|42'), 1, {digits}) AS BIGINT)"


@register(
    "m5_split_hash",
    over_view(f"SELECT pid, CASE WHEN {_hash_sql('CAST(pid AS VARCHAR)', 8)} % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM a"),
)
def m5(spark, folder):
    return M.split_hash(assessments(spark, folder, ["pid"]), ["pid"])


@register(
    "m6_split_stratified",
    over_view(
        "SELECT record_id, total_value, hs.stratum, CASE WHEN h <= lim THEN 'train' ELSE 'test' END AS split FROM hs JOIN "
        "(SELECT stratum, list_sort(list(h))[greatest(CAST(ceil(count(*) * 0.8::DOUBLE) AS BIGINT), 1)] AS lim FROM hs GROUP BY 1) l "
        "ON hs.stratum = l.stratum",
        "qs AS (SELECT quantile_cont(total_value, 0.25) AS c1, quantile_cont(total_value, 0.5) AS c2, quantile_cont(total_value, 0.75) AS c3 FROM a)",
        "hs AS (SELECT record_id, total_value, CAST(total_value > c1 AS INTEGER) + CAST(total_value > c2 AS INTEGER) + CAST(total_value > c3 AS INTEGER) "
        f"AS stratum, {_hash_sql('record_id', 13)} AS h FROM a, qs)",
    ),
)
def m6(spark, folder):
    return M.split_stratified(assessments(spark, folder, ["record_id", "total_value"]), "total_value", ["record_id"])


@register(
    "m7_design_matrix",
    over_view("SELECT record_id, living_area AS f0, land_sf AS f1, CAST(num_parking AS DOUBLE) AS f2 FROM a"),
)
def m7(spark, folder):
    names = ["living_area", "land_sf", "num_parking"]
    rows = M.assemble(assessments(spark, folder, ["record_id", *names]), names)
    parts = vector_to_array("features")
    return rows.select("record_id", *[parts[i].alias(f"f{i}") for i in range(3)])


def _prepared(spark, folder, features=levels.TREE_FEATURES):
    rows = filters.valid_records(_roll(spark, folder, "record_id"), NEW)
    # split before rows are stored: training reads them several times
    parts, names = M.prepare(M.split_hash(rows, ["record_id"]), features, "total_value", ["split"])
    return parts.filter("split = 'train'"), parts.filter("split = 'test'"), names


def _metrics(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_PREPARED = ["living_area", "bed_rms", "overall_cond", "city", "own_occ"]


def _rank_sql(c: str) -> str:
    names = levels.MODEL_ORDINAL_LEVELS["overall_cond"]
    return f"CASE regexp_replace({c}, '^.* - ', '') " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(names, 1)) + " END"


@register(
    "m3_stored_preparation",
    over_view(
        "SELECT record_id, living_area::DOUBLE AS living_area, coalesce(bed_rms::DOUBLE, (SELECT median(bed_rms) FROM old)) AS bed_rms, "
        f"coalesce({_rank_sql('overall_cond')}, (SELECT r FROM (SELECT {_rank_sql('overall_cond')} AS r FROM old) WHERE r IS NOT NULL GROUP BY r ORDER BY count(*) DESC, r::VARCHAR LIMIT 1))::DOUBLE AS overall_cond, "
        "coalesce(c.code, (SELECT code FROM c WHERE level = (SELECT city FROM old WHERE city IS NOT NULL GROUP BY city ORDER BY count(*) DESC, city LIMIT 1)))::DOUBLE AS city, "
        "coalesce(o.code, (SELECT code FROM o WHERE level = (SELECT own_occ FROM old GROUP BY own_occ ORDER BY count(*) DESC, own_occ LIMIT 1)))::DOUBLE AS own_occ "
        "FROM new LEFT JOIN c ON c.level = city LEFT JOIN o ON o.level = own_occ",
        f"old AS (SELECT * REPLACE (CASE WHEN city < 'NATION_3' THEN city END AS city) FROM a WHERE fiscal_year = {OLD})", f"new AS (SELECT * FROM a WHERE fiscal_year = {NEW})",
        "c AS (SELECT city AS level, row_number() OVER (ORDER BY city) AS code FROM (SELECT DISTINCT city FROM old WHERE city IS NOT NULL))",
        "o AS (SELECT own_occ AS level, row_number() OVER (ORDER BY own_occ) AS code FROM (SELECT DISTINCT own_occ FROM old))",
    ),
)
def stored_preparation(spark, folder):
    """The later snapshot's rows by what was learned on the earlier one, whose last cities it has not seen."""
    old = assessments(spark, folder, ["record_id", *_PREPARED], (OLD,)).withColumn("city", F.when(F.col("city") < "NATION_3", F.col("city")))
    ordered = {"overall_cond": levels.MODEL_ORDINAL_LEVELS["overall_cond"]}
    path = fresh_path(spark, "preparation")
    RollPreparation(["living_area", "bed_rms"], ordered, ["city", "own_occ"]).fit(old).save(path)
    new = assessments(spark, folder, ["record_id", *_PREPARED], (NEW,))
    return RollPreparationModel.load(spark, path).transform(new).select("record_id", *_PREPARED)


@register(
    "a23_prepared_by_strength",
    over_view(
        " UNION ALL ".join(f"SELECT '{c}' AS variable, round(corr({e}, total_value), 8) AS r FROM e" for c, e in (
            ("living_area", "living_area"), ("bed_rms", "bed"), ("overall_cond", "cond"), ("city", "c.code"), ("own_occ", "o.code"))).replace(
            "FROM e", "FROM e JOIN c ON c.level = city JOIN o ON o.level = own_occ"),
        f"e AS (SELECT a.*, coalesce(bed_rms, (SELECT median(bed_rms) FROM a)) AS bed, coalesce({_rank_sql('overall_cond')}, "
        f"(SELECT r FROM (SELECT {_rank_sql('overall_cond')} AS r FROM a) WHERE r IS NOT NULL GROUP BY r ORDER BY count(*) DESC, r::VARCHAR LIMIT 1)) AS cond FROM a)",
        "c AS (SELECT city AS level, row_number() OVER (ORDER BY city) AS code FROM (SELECT DISTINCT city FROM a))",
        "o AS (SELECT own_occ AS level, row_number() OVER (ORDER BY own_occ) AS code FROM (SELECT DISTINCT own_occ FROM a))",
    ),
)
def prepared_by_strength(spark, folder):
    """Correlation of every prepared column with the target, strongest first whatever its sign."""
    rows = assessments(spark, folder, ["total_value", *_PREPARED])
    ordered = {"overall_cond": levels.MODEL_ORDINAL_LEVELS["overall_cond"]}
    ready = cut_lineage(RollPreparation(["living_area", "bed_rms"], ordered, ["city", "own_occ"]).fit(rows).transform(rows))
    matrix = distributions.corr_matrix(ready, ["total_value", *_PREPARED])
    return distributions.correlates(matrix, "total_value").select("variable", F.round("r", 8).alias("r"))


@register("m8_decision_tree")
def m8(spark, folder):
    train, test, _ = _prepared(spark, folder)
    return _metrics(M.regression_metrics(M.fit_tree(train, "total_value").transform(test), "total_value"))


_NOMINAL = ["bldg_type", "city", "zip_code", "own_occ"]


def _roll_preparation(columns):
    """The boosted model's preparation of those of its features that the rows have."""
    features = [c for c in levels.BOOSTED_FEATURES if c in columns]
    ordered = {c: levels.MODEL_ORDINAL_LEVELS[c] for c in features if c in levels.MODEL_ORDINAL_LEVELS}
    nominal = [c for c in features if c in _NOMINAL]
    return RollPreparation([c for c in features if c not in ordered and c not in nominal], ordered, nominal)


def _boosting_rows(spark, folder):
    """Prepared rows, valid ones only, in a stratified split with a slice of the training rows to stop by."""
    rows = _roll(spark, folder, "record_id").withColumn("total_value", F.col("total_value").cast("double"))
    rows = cut_lineage(rows.select("record_id", "total_value", *[c for c in levels.BOOSTED_FEATURES if c in rows.columns]))
    fitted = _roll_preparation(rows.columns).fit(rows)
    # checked once stored: within the same read, Spark makes one method of both that is too long to be compiled
    ready = cut_lineage(fitted.transform(rows))
    parts = M.split_stratified(filters.valid_records(ready, NEW), "total_value", ["record_id"])
    parts = M.split_hash(parts, ["record_id"], 0.9, 43, "__part").withColumn("valid", F.col("__part") == "test").drop("__part")
    return cut_lineage(parts), fitted.columns


_models: dict[tuple[str, str], tuple] = {}


def _boosted(spark, folder):
    """The model at full settings, its rows and features; fitted once in a session, however many queries look at it."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _models:
        rows, features = _boosting_rows(spark, folder)
        model = fit_boosted(rows.where("split = 'train'"), features, "total_value", ["record_id"], Settings(), "valid")
        _models[key] = model, rows, features
    return _models[key]


@register("m9_m10_boosted_trees")
def m9(spark, folder):
    model, rows, _ = _boosted(spark, folder)
    return _metrics(M.regression_metrics(model.transform(rows.where("split = 'test'")), "total_value")).withColumn("rounds", F.lit(len(model.trees)))


@register("m10_losses")
def m10(spark, folder):
    return _metrics(_boosted(spark, folder)[0].loss_table(spark))


@register("m12_boosted_importances")
def m12_boosted(spark, folder):
    return _metrics(_boosted(spark, folder)[0].importances(spark, top=20))


@register("m13_compare_fitted")
def m13_fitted(spark, folder):
    model, rows, features = _boosted(spark, folder)
    parts = M.assemble(rows, features)
    tree = M.fit_tree(parts.where("split = 'train'"), "total_value")
    both = {"decision_tree": tree.transform(parts.where("split = 'test'")), "boosted_trees": model.transform(rows.where("split = 'test'"))}
    return _metrics(M.compare_models(both, "total_value"))


# Small exact fits that SQL repeats: columns of few values, so every value is a candidate border.
_SMALL = ["bldg_band", "num_parking", "yr_built", "bed_rms"]
_BAND = 5000
_STEP, _L1, _L2 = 0.3, 0.5, 1.0


def _small_rows(spark, folder):
    rows = assessments(spark, folder, ["record_id", "total_value", "bldg_value", *_SMALL[1:]]).withColumn("bldg_band", F.floor(F.col("bldg_value") / _BAND))
    cells = [F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in _SMALL]
    rows = rows.select("record_id", F.col("total_value").cast("double").alias("total_value"), *cells)
    return M.split_hash(rows, ["record_id"]).withColumn("valid", F.col("split") == "test").drop("split")


def _small_boosted(spark, folder):
    rows = cut_lineage(_small_rows(spark, folder))
    small = Settings(rounds=2, step=_STEP, depth=2, rows=1.0, columns=1.0, l1=_L1, l2=_L2)
    return fit_boosted(rows, _SMALL, "total_value", ["record_id"], small, "valid"), rows


def _grown_sql(name: str, source: str, target: str, depth: int, worth, least: int, train: str) -> list[str]:
    """Subqueries that grow one tree on ``source`` (record_id, f0.., node 0): ``name`` ends with the node of each row.

    Candidate borders are the distinct values; prefix sums over the counted values give the gain of each.
    """
    out, now = [], source
    for level in range(depth):
        cells = " UNION ALL ".join(f"SELECT node, {i} AS f, f{i} AS x, {target} AS g FROM {now} WHERE {train}" for i in range(len(_SMALL)))
        tag = f"{name}_{level}"
        out += [
            f"{tag}_c AS MATERIALIZED (SELECT node, f, x, sum(g) AS g, count(*)::DOUBLE AS n FROM ({cells}) GROUP BY ALL)",
            f"{tag}_p AS (SELECT *, sum(g) OVER w AS lg, sum(n) OVER w AS ln, sum(g) OVER t AS tg, sum(n) OVER t AS tn FROM {tag}_c "
            "WINDOW w AS (PARTITION BY node, f ORDER BY x), t AS (PARTITION BY node, f))",
            f"{tag}_g AS (SELECT *, {worth('lg', 'ln')} + {worth('(tg - lg)', '(tn - ln)')} - {worth('tg', 'tn')} AS gain FROM {tag}_p WHERE ln >= {least} AND tn - ln >= {least})",
            f"{tag}_b AS MATERIALIZED (SELECT * FROM {tag}_g WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, x) = 1)",
            f"{tag} AS MATERIALIZED (SELECT r.* REPLACE (CASE WHEN b.f IS NULL THEN r.node ELSE 2 * r.node + 1 + "
            f"(CASE b.f {' '.join(f'WHEN {i} THEN CAST(r.f{i} > b.x AS INTEGER)' for i in range(len(_SMALL)))} END) END AS node) FROM {now} r LEFT JOIN {tag}_b b ON b.node = r.node)",
        ]
        now = tag
    return out


def _small_source(valid: str) -> str:
    """The rows of the small fits: y, f0.., whether held out, and node 0."""
    cells = ", ".join(f"coalesce({c}, 0)::DOUBLE AS f{i}" for i, c in enumerate([f"floor(bldg_value / {_BAND})", *_SMALL[1:]]))
    return f"s AS MATERIALIZED (SELECT record_id, total_value::DOUBLE AS y, {cells}, {valid} AS valid, CAST(0 AS BIGINT) AS node FROM a)"


def _small_sql(body: str) -> str:
    """Two rounds of depth 2 over the view, then ``body`` over ``s2`` (y, valid, p0, p1, p2)."""
    soft = lambda g: f"sign({g}) * greatest(abs({g}) - {_L1}::DOUBLE, 0::DOUBLE)"
    worth = lambda g, n: f"pow({soft(g)}, 2) / ({n} + {_L2}::DOUBLE) / 2::DOUBLE"
    ctes = [
        _small_source(f"{_hash_sql('record_id', 8)} % 100 >= 80"),
        "s0 AS MATERIALIZED (SELECT *, (SELECT avg(y) FROM s WHERE NOT valid) AS p0 FROM s)",
    ]
    for r in range(2):
        ctes += _grown_sql(f"t{r}", f"s{r}", f"p{r} - y", 2, worth, 1, "NOT valid")
        ctes += [
            f"v{r} AS (SELECT node, sum(p{r} - y) AS g, count(*)::DOUBLE AS n FROM t{r}_1 WHERE NOT valid GROUP BY node)",
            f"s{r + 1} AS MATERIALIZED (SELECT t.* REPLACE (CAST(0 AS BIGINT) AS node), p{r} - {_STEP}::DOUBLE * {soft('v.g')} / (v.n + {_L2}::DOUBLE) AS p{r + 1} FROM t{r}_1 t JOIN v{r} v ON v.node = t.node)",
        ]
    return over_view(body, *ctes)


@register("m9_small_boosting", _small_sql("SELECT record_id, round(p2, 4) AS prediction FROM s2"))
def m9_small(spark, folder):
    model, rows = _small_boosted(spark, folder)
    return model.transform(rows).select("record_id", F.round("prediction", 4).alias("prediction"))


@register(
    "m10_small_losses",
    _small_sql(" UNION ALL ".join(
        f"SELECT {r} AS round, round(sqrt(avg(pow(p{r} - y, 2)) FILTER (NOT valid)), 6) AS train_rmse, round(sqrt(avg(pow(p{r} - y, 2)) FILTER (valid)), 6) AS valid_rmse FROM s2"
        for r in (1, 2))),
)
def m10_small(spark, folder):
    return _metrics(_small_boosted(spark, folder)[0].loss_table(spark))


@register(
    "m12_small_boosted_gain",
    _small_sql(
        "SELECT CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_SMALL)) + " END AS feature, round(sum(gain) / any_value(g), 9) AS gain, "
        "round(sum(tn) / any_value(c), 9) AS cover, round(count(*) / any_value(k)::DOUBLE, 9) AS frequency FROM "
        "(SELECT f, gain, tn, sum(gain) OVER () AS g, sum(tn) OVER () AS c, count(*) OVER () AS k FROM ("
        + " UNION ALL ".join(f"SELECT f, gain, tn FROM t{r}_{d}_b" for r in range(2) for d in range(2)) + ")) GROUP BY f"),
)
def m12_small_boosted(spark, folder):
    out = _small_boosted(spark, folder)[0].importances(spark)
    return out.select("feature", *[F.round(c, 9).alias(c) for c in ("gain", "cover", "frequency")])


def _fitted_metrics_sql(p: str) -> str:
    return (
        f"count(*) AS n, round(avg(abs(y - {p})), 6) AS mae, round(sqrt(avg(pow(y - {p}, 2))), 6) AS rmse, "
        f"round(1 - avg(pow(y - {p}, 2)) / var_pop(y), 8) AS r2, round(pow(corr(y, {p}), 2), 8) AS r2_corr FROM s2 WHERE valid"
    )


@register("m11_fitted_metrics", _small_sql(f"SELECT {_fitted_metrics_sql('p2')}"))
def m11_fitted(spark, folder):
    model, rows = _small_boosted(spark, folder)
    return _shown(M.regression_metrics(model.transform(rows.where("valid")), "total_value"))


@register("m14_fitted_errors", _small_sql("SELECT record_id, y AS actual, round(p2, 4) AS predicted, round(y - p2, 4) AS residual FROM s2 WHERE valid"))
def m14_fitted(spark, folder):
    model, rows = _small_boosted(spark, folder)
    out = M.prediction_errors(model.transform(rows.where("valid")), "total_value", keep=["record_id"])
    return out.select("record_id", "actual", F.round("predicted", 4).alias("predicted"), F.round("residual", 4).alias("residual"))


def _small_tree(spark, folder):
    rows = cut_lineage(M.assemble(_small_rows(spark, folder), _SMALL))
    return M.fit_tree(rows.where("not valid"), "total_value", depth=2), rows


def _tree_sql(body: str) -> str:
    """A tree of depth 2 by least squared error, leaves of five rows at least, then ``body``."""
    source = _small_source(f"{_hash_sql('record_id', 8)} % 100 >= 80")
    worth = lambda g, n: f"pow({g}, 2) / {n}"
    return over_view(body, source, *_grown_sql("t", "s", "y", 2, worth, 5, "NOT valid"), "v AS (SELECT node, avg(y) AS p FROM t_1 WHERE NOT valid GROUP BY node)")


@register("m8_small_tree", _tree_sql("SELECT record_id, round(p, 4) AS prediction FROM t_1 JOIN v USING (node)"))
def m8_small(spark, folder):
    tree, rows = _small_tree(spark, folder)
    return tree.transform(rows).select("record_id", F.round("prediction", 4).alias("prediction"))


@register(
    "m12_small_tree_importances",
    _tree_sql(
        "SELECT CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_SMALL)) + " ELSE '' END AS feature, round(sum(gain) / any_value(g), 8) AS importance FROM "
        "(SELECT f, gain, sum(gain) OVER () AS g FROM (SELECT f, gain FROM t_0_b UNION ALL SELECT f, gain FROM t_1_b)) GROUP BY f"),
)
def m12_small(spark, folder):
    found = M.importances(_small_tree(spark, folder)[0], _SMALL, spark).where("importance > 0")
    return found.select("feature", F.round("importance", 8).alias("importance"))


@register("m12_importances")
def m12(spark, folder):
    train, _, names = _prepared(spark, folder)
    return M.importances(M.fit_tree(train, "total_value"), names, spark, top=15)


# Predictions both engines can make: the mean value of records with the same key.
_PREDICTED = (
    "pr AS (SELECT pid, total_value, avg(total_value) OVER (PARTITION BY living_area) AS by_area, "
    "avg(total_value) OVER (PARTITION BY zip_code) AS by_zip FROM a)"
)


def _predicted(spark, folder):
    rows = assessments(spark, folder, ["pid", "total_value", "living_area", "zip_code"])
    for key, name in (("living_area", "by_area"), ("zip_code", "by_zip")):
        means = rows.groupBy(key).agg(F.avg("total_value").alias(name))
        rows = rows.join(means, key)
    return rows


def _metrics_sql(p: str) -> str:
    return (
        f"count(*) AS n, round(avg(abs(total_value - {p})), 6) AS mae, round(sqrt(avg(pow(total_value - {p}, 2))), 6) AS rmse, "
        f"round(1 - avg(pow(total_value - {p}, 2)) / var_pop(total_value), 8) AS r2, round(pow(corr(total_value, {p}), 2), 8) AS r2_corr FROM pr"
    )


def _shown(df):
    scales = {"mae": 6, "rmse": 6, "r2": 8, "r2_corr": 8}
    return df.select(*[F.round(c, scales[c]).alias(c) if c in scales else F.col(c) for c in df.columns])


@register("m11_regression_metrics", over_view(f"SELECT {_metrics_sql('by_area')}", _PREDICTED))
def m11(spark, folder):
    return _shown(M.regression_metrics(_predicted(spark, folder), "total_value", "by_area"))


@register(
    "m13_compare_models",
    over_view(f"SELECT 'area' AS model, {_metrics_sql('by_area')} UNION ALL SELECT 'zip' AS model, {_metrics_sql('by_zip')}", _PREDICTED),
)
def m13(spark, folder):
    rows = _predicted(spark, folder)
    both = {
        name: rows.select("total_value", F.col(column).alias("prediction")) for name, column in (("area", "by_area"), ("zip", "by_zip"))
    }
    return _shown(M.compare_models(both, "total_value"))


@register(
    "m14_prediction_errors",
    over_view("SELECT pid, total_value AS actual, round(by_area, 6) AS predicted, round(total_value - by_area, 6) AS residual FROM pr", _PREDICTED),
)
def m14(spark, folder):
    out = M.prediction_errors(_predicted(spark, folder), "total_value", "by_area", ["pid"])
    return out.select("pid", "actual", F.round("predicted", 6).alias("predicted"), F.round("residual", 6).alias("residual"))


@register(
    "m14_error_histogram",
    over_view(
        "SELECT CAST(ceil((total_value - by_area) / 5000::DOUBLE - 0.5::DOUBLE) AS BIGINT) AS bin_index, count(*) AS count FROM pr GROUP BY 1",
        _PREDICTED,
    ),
)
def m14_histogram(spark, folder):
    errors = M.prediction_errors(_predicted(spark, folder), "total_value", "by_area")
    return distributions.histogram_width(errors, "residual", 5000).select("bin_index", "count")
