"""Two-sample tests, analysis of variance and pairwise comparisons.

Spark aggregates counts, means and variances in one pass; only the finished
statistic of a test meets a distribution function.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gablestat.functions.columns import decision
from gablestat.functions.probability import f_tail, range_critical, range_tail, t_tail
from gablestat.session import cut_lineage


def welch_t(
    df: DataFrame, value: str, group: str, g1, g2, alternative: str = "two.sided", alpha: float = 0.05
) -> DataFrame:
    """One row comparing mean(g1) with mean(g2) without assuming equal variances.

    ``alternative``: ``two.sided``, ``less`` (g1 below g2) or ``greater`` (g1 above g2).
    """
    x = F.col(value).cast("double")
    aggs = []
    for i, g in ((1, g1), (2, g2)):
        mine = F.when(F.col(group) == F.lit(g), x)
        aggs += [F.count(mine).alias(f"n{i}"), F.avg(mine).alias(f"mean{i}"), F.var_samp(mine).alias(f"var{i}")]
    return _welch(df.agg(*aggs), alternative, alpha)


def _welch(moments: DataFrame, alternative: str, alpha: float) -> DataFrame:
    """The finished test of one row ``n1 mean1 var1 n2 mean2 var2``."""
    se1, se2 = F.try_divide("var1", "n1"), F.try_divide("var2", "n2")
    out = moments.withColumns({"__a": se1, "__b": se2}).withColumns(
        {
            "t": F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(F.col("__a") + F.col("__b"))),
            "df": F.try_divide(
                F.pow(F.col("__a") + F.col("__b"), F.lit(2.0)),
                F.try_divide(F.col("__a") * F.col("__a"), F.col("n1") - 1)
                + F.try_divide(F.col("__b") * F.col("__b"), F.col("n2") - 1),
            ),
        }
    )
    tail = {
        "two.sided": t_tail(F.abs("t"), F.col("df")) * 2,
        "less": t_tail(-F.col("t"), F.col("df")),
        "greater": t_tail(F.col("t"), F.col("df")),
    }[alternative]
    out = out.withColumn("p_value", tail).withColumn("decision", decision("p_value", alpha))
    return out.select(
        "n1", "mean1", F.sqrt("var1").alias("sd1"), "n2", "mean2", F.sqrt("var2").alias("sd2"),
        "t", "df", "p_value", "decision",
    )


def group_moments(df: DataFrame, value: str, group: str, min_n: int = 1) -> DataFrame:
    """``(group, n, mean, var)`` of groups with at least ``min_n`` values."""
    x = F.col(value).cast("double")
    return (
        df.filter(F.col(group).isNotNull() & x.isNotNull())
        .groupBy(F.col(group).alias("group"))
        .agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))
        .filter(F.col("n") >= min_n)
    )


def moment_table(df: DataFrame, groupings: Mapping[str, Column], values: Sequence[str]) -> DataFrame:
    """``(grouping, level, value, n, mean, var)`` for every level of several groupings, from one read.

    A grouping is an expression whose text names a row's level; rows where it is missing take no part in it. The
    grouping sets combine before the shuffle, so a level that most rows share is no burden.
    """
    names = list(groupings)
    rows = df.select(*[g.cast("string").alias(f"g_{n}") for n, g in groupings.items()], *[F.col(v).cast("double").alias(v) for v in values])
    figures = [F.struct(F.lit(v).alias("value"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var")).alias(f"v_{v}") for v in values]
    found = rows.groupingSets([[f"g_{n}"] for n in names], *[f"g_{n}" for n in names]).agg(
        *figures, *[F.grouping(f"g_{n}").alias(f"s_{n}") for n in names])
    which = F.coalesce(*[F.when(F.col(f"s_{n}") == 0, F.lit(n)) for n in names])
    level = F.coalesce(*[F.col(f"g_{n}") for n in names])
    tall = found.select(which.alias("grouping"), level.alias("level"), F.inline(F.array(*[f"v_{v}" for v in values])))
    return tall.where(F.col("level").isNotNull())


def welch_from(moments: DataFrame, grouping: str, value: str, g1: str, g2: str, alternative: str = "two.sided", alpha: float = 0.05) -> DataFrame:
    """``welch_t`` of two levels of a moment table."""
    own = moments.where((F.col("grouping") == grouping) & (F.col("value") == value))
    picks = []
    for i, g in ((1, g1), (2, g2)):
        mine = F.col("level") == g
        picks += [F.coalesce(F.max(F.when(mine, F.col("n"))), F.lit(0)).alias(f"n{i}"),
                  F.max(F.when(mine, F.col("mean"))).alias(f"mean{i}"), F.max(F.when(mine, F.col("var"))).alias(f"var{i}")]
    return _welch(own.agg(*picks), alternative, alpha)


def anova_from(moments: DataFrame, grouping: str, value: str, min_n: int = 1, alpha: float = 0.05) -> DataFrame:
    """``anova_oneway`` of a moment table."""
    own = moments.where((F.col("grouping") == grouping) & (F.col("value") == value) & (F.col("n") >= max(min_n, 1)))
    return _anova(own, alpha)


def _variance_table(moments: DataFrame) -> DataFrame:
    grand = moments.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m")).scalar()
    gap = F.col("mean") - grand
    return moments.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * gap * gap).alias("ss_between"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("var"), F.lit(0.0))).alias("ss_within"),
    ).withColumns({"df_between": F.col("groups") - 1, "df_within": F.col("n") - F.col("groups")})


def anova_oneway(df: DataFrame, value: str, group: str, min_n: int = 1, alpha: float = 0.05) -> DataFrame:
    """One row: sums of squares, degrees of freedom, F, p and decision. The rows are read once, for their moments."""
    return _anova(cut_lineage(group_moments(df, value, group, min_n)), alpha)


def _anova(moments: DataFrame, alpha: float) -> DataFrame:
    table = _variance_table(moments)
    ratio = F.try_divide(
        F.try_divide("ss_between", "df_between"), F.try_divide("ss_within", "df_within")
    )
    return (
        table.withColumn("f_value", ratio)
        .withColumn("p_value", f_tail("f_value", F.col("df_between").cast("double"), F.col("df_within").cast("double")))
        .withColumn("decision", decision("p_value", alpha))
    )


#: Group means of one block of pairs.
BLOCK = 1000


def pairs_of(means: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: every pair of rows with ``a.key < b.key``, as structs.

    Rows are dealt to blocks by a hash, and every pair of blocks meets in one task, so a task holds two blocks however many
    rows there are.
    """
    blocks = max(1, -(-means.count() // block))
    dealt = means.select(F.struct(*means.columns).alias("r"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("own"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    left = spread.where("own <= other").select(F.col("own").alias("p"), F.col("other").alias("q"), F.col("r").alias("x"))
    right = spread.where("other <= own").select(F.col("other").alias("p"), F.col("own").alias("q"), F.col("r").alias("y"))
    met = left.join(right, ["p", "q"]).where((F.col("p") < F.col("q")) | (F.col("x")[key] < F.col("y")[key]))
    ordered = F.col("x")[key] < F.col("y")[key]
    return met.select(F.when(ordered, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(ordered, F.col("y")).otherwise(F.col("x")).alias("b"))


def tukey_hsd(df: DataFrame, value: str, group: str, min_n: int = 1, confidence: float = 0.95) -> DataFrame:
    """``(group1, group2, diff, lower, upper, p_adj)`` for every pair of group means, group1 < group2.

    The pairs are over the finished group means, not over rows; diff is mean2 - mean1.
    """
    moments = cut_lineage(group_moments(df, value, group, min_n))
    table = _variance_table(moments).select(
        F.struct(
            "groups", "df_within", F.try_divide("ss_within", "df_within").alias("mse")
        ).alias("t")
    ).scalar()
    pairs = pairs_of(moments.select("group", "n", "mean"), "group")
    noise = F.sqrt(F.col("mse") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    out = pairs.select(
        F.col("a.group").alias("group1"), F.col("b.group").alias("group2"),
        F.col("a.n").alias("n1"), F.col("b.n").alias("n2"),
        (F.col("b.mean") - F.col("a.mean")).alias("diff"),
        table.alias("t"),
    ).withColumns(
        {"mse": F.col("t.mse"), "k": F.col("t.groups").cast("double"), "dfw": F.col("t.df_within").cast("double")}
    ).withColumn("noise", noise)
    out = out.withColumn("q", F.abs("diff") / F.col("noise"))
    half = range_critical(F.lit(float(confidence)), "k", "dfw") * F.col("noise")
    return out.select(
        "group1", "group2", "diff",
        (F.col("diff") - half).alias("lower"), (F.col("diff") + half).alias("upper"),
        "q", range_tail("q", "k", "dfw").alias("p_adj"),
    )


def hypothesis_report(results: Mapping[str, DataFrame], alpha: float = 0.05) -> DataFrame:
    """``(hypothesis, p_value, decision)``: one row per named test result."""
    out = None
    for label, result in results.items():
        row = result.select(
            F.lit(label).alias("hypothesis"), F.round("p_value", 6).alias("p_value"),
            decision("p_value", alpha).alias("decision"),
        )
        out = row if out is None else out.unionByName(row)
    return out
