"""URL verdicts: host and path rules first, boosted trees over lexical features for the rest.

The trees are trained on the URLs that a rule decides. Features are lexical only: lengths, depth, digit ratio,
entropy, parameter counts and statistics of the host's suffix. Everything is DataFrame work; the trees are those
of Spark's own library.

Bounds: at most ``SAMPLE`` labelled URLs of each label train the trees (those of smallest hash). Shares of suffixes
and first path parts are counted over all URLs, their block rates over all that a rule decides; a table of these is
broadcast only if it was counted to have at most ``2 * SAMPLE`` rows.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule; an empty path
starts with no rule's path; if training has no URL of one of the labels, every URL that no rule fits gets the label
that is there, ``allow`` if there is none; repeated rows are judged alike; an empty table gives no rows. Other
columns are kept; those named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gablestat.session import cut_lineage, ensure_checkpoint_dir

#: Labelled URLs of each label that may train the trees.
SAMPLE = 10_000
#: Prior weight, in URLs, of a suffix's statistics.
PRIOR = 5.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "f_length", "f_host_length", "f_path_length", "f_labels", "f_depth", "f_digits", "f_host_digits", "f_dashes", "f_params",
    "f_fragment", "f_secure", "f_entropy", "f_host_entropy", "f_suffix_rate", "f_suffix_share", "f_dir_rate",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, null if none does. A rule is ``host/path``; it fits the host and its subdomains."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    kinds = F.array_distinct(F.split(text, ""))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, -F.aggregate(F.filter(kinds, lambda c: c != ""), F.lit(0.0), lambda a, c: a + share(c) * F.log2(share(c)))).otherwise(0.0)


def _digits(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.translate(text, "0123456789", ""))) / n).otherwise(0.0)


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """The rows with ``host path`` and the lexical features, without the suffix statistics."""
    whole = F.coalesce(F.col(url), F.lit(""))
    host, path = host_and_path(F.col(url))
    named = urls.drop("host", "path").withColumns({"host": host, "path": path, "_url": whole})
    query = F.regexp_extract("_url", r"(?s)\?([^#]*)", 1)
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return named.withColumns({
        "f_length": F.length("_url").cast("double"),
        "f_host_length": F.length("host").cast("double"),
        "f_path_length": F.length("path").cast("double"),
        "f_labels": count(F.col("host"), ".").cast("double"),
        "f_depth": count(F.col("path"), "/").cast("double"),
        "f_digits": _digits(F.col("_url")).cast("double"),
        "f_host_digits": _digits(F.col("host")).cast("double"),
        "f_dashes": count(F.col("_url"), "-").cast("double"),
        "f_params": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0).cast("double"),
        "f_fragment": F.contains(F.col("_url"), F.lit("#")).cast("double"),
        "f_secure": F.startswith(F.col("_url"), F.lit("https://")).cast("double"),
        "f_entropy": _entropy(F.col("_url")).cast("double"),
        "f_host_entropy": _entropy(F.col("host")).cast("double"),
        "_suffix": F.substring_index("host", ".", -1),
        "_dir": F.regexp_extract("path", r"^/([^/]*)", 1),
    })


class UrlFilter:
    """Rules, and trees for what no rule decides."""

    def __init__(self, rules: dict[str, str], sample: int = SAMPLE, rounds: int = 20, depth: int = 4, seed: int = 7):
        self.rules, self.sample, self.rounds, self.depth, self.seed = rules, sample, rounds, depth, seed
        self.model, self.only, self.stats, self.small, self.base = None, "allow", {}, {}, 0.5

    def _labelled(self, rows: DataFrame) -> DataFrame:
        """Adds ``rule`` and ``_block`` (1 block, 0 allow, null undecided)."""
        rule = rule_of(F.col("host"), F.col("path"), self.rules)
        blocked = [r for r, v in self.rules.items() if v == "block"]
        return rows.drop("rule").withColumn("rule", rule).withColumn(
            "_block", F.when(F.col("rule").isin(blocked), 1.0).when(F.col("rule").isNotNull(), 0.0))

    def _with_stats(self, rows: DataFrame) -> DataFrame:
        """Adds the smoothed block rates and the share of the host's suffix and the path's first part."""
        for column, named in (("_suffix", "f_suffix"), ("_dir", "f_dir")):
            table = self.stats[column].select(F.col("key").alias(column), F.col("rate").alias(f"{named}_rate"), F.col("share").alias(f"{named}_share"))
            rows = rows.join(F.broadcast(table) if self.small[column] else table, column, "left")
        return rows.fillna({"f_suffix_rate": self.base, "f_dir_rate": self.base, "f_suffix_share": 0.0, "f_dir_share": 0.0})

    def fit(self, urls: DataFrame, url: str = "url") -> "UrlFilter":
        """Learns from the rows that a rule decides."""
        ensure_checkpoint_dir(urls.sparkSession)
        rows = self._labelled(lexical(urls.select(url), url))
        known = rows.where("_block is not null")
        order = (F.xxhash64("_url"), F.col("_url"))
        picked = [known.where(F.col("_block") == v).orderBy(*order).limit(self.sample) for v in (0.0, 1.0)]
        train = cut_lineage(picked[0].unionByName(picked[1]))
        counts = {r["_block"]: r["n"] for r in train.groupBy("_block").agg(F.count("*").alias("n")).collect()}
        if len(counts) < 2:
            self.only = "block" if counts.get(1.0) else "allow"
            return self
        counted = cut_lineage(rows.groupBy("_suffix", "_dir").agg(
            F.coalesce(F.sum("_block"), F.lit(0.0)).alias("blocked"), F.count("_block").alias("decided"), F.count("*").alias("n")))
        total = counted.agg(F.sum("blocked").alias("blocked"), F.sum("decided").alias("decided"), F.sum("n").alias("n")).first()
        self.base = total["blocked"] / total["decided"]
        for column in ("_suffix", "_dir"):
            self.stats[column] = cut_lineage(counted.groupBy(F.col(column).alias("key")).agg(
                ((F.sum("blocked") + self.base * PRIOR) / (F.sum("decided") + PRIOR)).alias("rate"), (F.sum("n") / total["n"]).alias("share")))
            self.small[column] = self.stats[column].count() <= 2 * SAMPLE
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(self._with_stats(train))
        self.model = GBTClassifier(
            featuresCol="_features", labelCol="_block", maxIter=self.rounds, maxDepth=self.depth, seed=self.seed, stepSize=0.2,
            checkpointInterval=10, maxMemoryInMB=128).fit(ready.select("_features", "_block"))
        return self

    def transform(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """The rows with ``host path rule verdict block_score``."""
        kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
        rows = self._labelled(lexical(urls.select(*kept), url))
        if self.model is None:
            score = F.lit(1.0 if self.only == "block" else 0.0)
        else:
            rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(self._with_stats(rows))
            rows = self.model.setPredictionCol("_label").setRawPredictionCol("_raw").setProbabilityCol("_probability").transform(rows)
            score = vector_to_array("_probability")[1]
        rows = rows.withColumn("block_score", F.coalesce("_block", score))
        return rows.select(*kept, "host", "path", "rule", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow").alias("verdict"), "block_score")
