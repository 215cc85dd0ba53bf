"""The pipeline's stages on what their predecessors kept."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from gablestat.llm import jaccard_join, substring_dedup
from gablestat.llm.members import may_have, surely_without

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def test_stages_keep_columns_and_pack_all_that_is_left(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    total = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.cut_lineage(stage(spark, docs, FOLDER))
        assert sorted(after.columns) == sorted(docs.columns), name
        assert 0 < after.count() <= docs.count() and after.select("doc_id").distinct().count() == after.count(), name
        docs = after
    assert docs.count() < total
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_take_blank_rows(spark):
    some = spark.createDataFrame([(1, None, None, None, None), (None, "x", "en", "s", 1), (2, "y", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, some, FOLDER).count() == 3
    assert corpus_pipeline.STAGES[0][1](spark, some, FOLDER).count() == 0


def test_repeated_rows_stay_once_and_shared_ids_keep_their_own_text(spark):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, words(1, 80)), (1, words(1, 80)), (1, words(1, 80)), (2, words(2, 80)), (5, words(2, 80)), (5, words(5, 80)), (6, words(1, 80).replace("w1x79", "other")),
            (6, words(6, 80)), (None, words(7, 80)), (None, words(7, 80)), (None, words(2, 80)), (8, words(2, 60) + " " + words(8, 20)), (8, words(9, 80))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, FOLDER))
    left = {(r.doc_id, r.text.strip()) for r in docs.collect()}
    assert docs.count() == len(left)
    assert left == {(1, words(1, 80)), (2, words(2, 80)), (5, words(5, 80)), (6, words(6, 80)), (None, words(7, 80)), (8, words(8, 20)), (8, words(9, 80))}


def test_no_column_name_clashes_and_an_empty_table_stays_empty(spark):
    names = ["n_words", "failed_bits", "_words", "_lines", "_row", "_text", "_id", "_rest", "class", "component_id"]
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(k, text + f" {k} " + " ".join(f"own{k}x{i}" for i in range(60)), *(-k for _ in names)) for k in range(1, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, FOLDER))
        empty = corpus_pipeline.cut_lineage(stage(spark, empty, FOLDER))
        assert docs.columns == ["doc_id", "text", *names] and empty.columns == docs.columns and empty.count() == 0
    assert docs.count() == 3 and all(r[n] == -r.doc_id for r in docs.collect() for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, empty, FOLDER).count() == 0


def test_texts_without_a_wanted_key_take_no_part_in_joins(spark, monkeypatch):
    rows = spark.range(4000).select(F.when(F.col("id") > 5, F.col("id")).alias("doc_id"), F.lit("w").alias("text"))
    keys = spark.createDataFrame([(i,) for i in (None, 7, 9, 3999, 70_000)], "doc_id long")
    some, rest = may_have(rows, keys, "doc_id"), surely_without(rows, keys, "doc_id")
    assert some.count() + rest.count() == 4000 and some.count() < 20
    assert sorted(str(r.doc_id) for r in some.collect() if r.doc_id in (None, 7, 9, 3999)) == ["3999", "7", "9", *["None"] * 6]
    assert may_have(rows, keys.limit(0), "doc_id").count() == 0 and surely_without(rows, keys.limit(0), "doc_id").count() == 4000

    joined = []

    def counted(*args):
        joined.append((out := may_have(*args)).count())
        return out

    for module in (corpus_pipeline, jaccard_join, substring_dedup):
        monkeypatch.setattr(module, "may_have", counted)
    own = F.concat_ws(" ", *(F.concat(F.lit(f"x{i}y"), F.col("id")) for i in range(60)))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), own.alias("text"))
    docs = corpus_pipeline.cut_lineage(docs.union(docs.where("doc_id < 3").select(F.col("doc_id") + 5000, "text")))
    near = corpus_pipeline.cut_lineage(docs.withColumn("text", F.when(F.col("doc_id") < 5000, F.col("text")).otherwise(F.concat("text", F.lit(" z")))))
    spans = spark.createDataFrame([(k, 0, 0, 60) for k in range(5)], "doc_id long, source_id long, start int, stop int")
    for work, n in ((lambda: corpus_pipeline.exact_dedup(spark, docs, FOLDER), 2000), (lambda: corpus_pipeline.jaccard_join(spark, near, FOLDER), 2000),
                    (lambda: corpus_pipeline.substring_dedup(spark, near, FOLDER), 2003), (lambda: substring_dedup.without_passages(docs, spans), 2003)):
        joined.clear()
        assert work().count() == n
        assert joined and max(joined) < 100
