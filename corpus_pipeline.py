"""Documents to packed sequences: quality rules, exact and near duplicates, repeated passages, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on what its predecessor kept; all but the last return the columns
of documents. A null text counts as empty throughout; other columns are carried along, whatever their names; an empty table
stays empty.

What a stage returns is written before the next one begins, so each stage first deletes the tables that the one before it
stored on its way; the shared folder holds those of one stage at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gablestat.llm.exact_dedup import duplicate_groups, normalized
from gablestat.llm.jaccard_join import near_duplicates
from gablestat.llm.members import may_have, surely_without
from gablestat.llm.packing import pack, pieces
from gablestat.llm.quality_rules import fails, ledger
from gablestat.llm.substring_dedup import repeated_passages, without_passages
from gablestat.session import cut_lineage, drop_stored, recording

_left: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that sees ``doc_id``, ``text`` and all other columns as one, ``_rest``, so that no name clashes with its own."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            drop_stored(spark, _left.pop())
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        rest = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("_rest")] if others else []
        with recording() as paths:
            out = work(spark, docs.select("doc_id", "text", *rest))
        _left.extend(paths)
        if "text" not in out.columns:  # the last stage returns its own columns
            return out
        return out.select(*[F.col("_rest").getField(c).alias(c) if c in others else F.col(c) for c in docs.columns])

    run.__name__, run.__doc__ = work.__name__, work.__doc__
    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents that no rule of the policy rejects. The ledger is stored first: a filter pushed into its expressions would measure again for every word."""
    return cut_lineage(ledger(docs)).where(~fails("full-1")).select(*docs.columns)


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Of equal texts the longest original, then the smallest doc_id; rows that repeat count once, rows that only share a doc_id are told apart by their texts."""
    groups = duplicate_groups(docs).groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    some = cut_lineage(groups.where("not kept or n > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept"))
    ids = some.select(F.col("_id").alias("doc_id"))
    named = may_have(docs, ids, "doc_id").withColumn("_text", F.sha2(normalized(F.col("text")), 256))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_sha"))
    rest = surely_without(docs, ids, "doc_id").unionByName(named.join(some, same, "left_anti").drop("_text"))  # most texts stay where they are
    if some.where("kept").isEmpty():  # no row that stays repeats, so the texts needn't be moved once more
        return rest
    # of a row that repeats the longest text stays; map-side, so that very many repeats are no hot task
    row = F.struct(F.length("text").alias("_size"), *docs.columns)
    once = named.join(some.where("kept"), same, "left_semi").groupBy("doc_id", "_text").agg(F.max(row).alias("_row")).select(*(F.col(f"_row.{c}") for c in docs.columns))
    return rest.unionByName(once)


def _rows(docs: DataFrame) -> DataFrame:
    """The documents with ``_row``, a number of their own in the order of doc_id, since an id may be null or shared.

    Partitions are cut by id and hash, so that no text is among the keys that are sampled; texts of one hash are told apart
    where they are sorted.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    return cut_lineage(docs.repartitionByRange(*order).sortWithinPartitions(*order, "text").withColumn("_row", F.monotonically_increasing_id()))


@_stage
def jaccard_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id."""
    rows = _rows(docs)
    gone = cut_lineage(near_duplicates(rows, key="_row").where("_row <> component_id").select("_row"))
    return surely_without(rows, gone, "_row").unionByName(may_have(rows, gone, "_row").join(gone, "_row", "left_anti")).drop("_row")


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Passages that an earlier document has too are cut; documents stay, with ``n_chars`` of what is left."""
    rows = _rows(docs)
    left = without_passages(rows, repeated_passages(rows, key="_row"), key="_row").drop("_row")
    if "_rest" in left.columns and "n_chars" in left.schema["_rest"].dataType.names:
        left = left.withColumn("_rest", F.col("_rest").withField("n_chars", F.length("text").cast("long")))
    return left


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),)))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Packing's token ids and bins are no matter for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
