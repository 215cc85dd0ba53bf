"""The operators over the whole test tables: one query each, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: URL rules of the test query, fixed values.
URL_RULES = {
    "com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block",
}


def _register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out() -> F.Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


SQL_RULES = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaims,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w
), p AS (
  SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS a FROM w
), g AS (
  SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL
), s AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id
), f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_exclaims, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(s.n, 0) AS BIGINT) AS n_repeat_words
  FROM m LEFT JOIN s USING (doc_id)
), b AS (
  SELECT *, CAST((n_words < 50)::INT * 1 + (100 * n_repeat_words > 50 * n_words)::INT * 2 + (100 * n_symbols > 30 * n_words)::INT * 4
    + (100 * n_dup_lines > 45 * n_lines)::INT * 8 + (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT * 16
    + (100 * n_exclaims > 80 * n_words)::INT * 32 AS BIGINT) AS failed_bits FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM b
"""


@_register("op5_quality_rules", SQL_RULES)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gablestat.llm.quality_rules import fails, ledger

    return ledger(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        fails("base-1").alias("base_failed"), (~fails("full-1")).alias("kept"), "failed_bits")


SQL_EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), k AS (
  SELECT doc_id, t, count(*) OVER (PARTITION BY t) AS group_size, first_value(doc_id) OVER (PARTITION BY t ORDER BY size DESC, doc_id) AS keep_id FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
"""


@_register("op10_exact_dedup", SQL_EXACT)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gablestat.llm.exact_dedup import duplicate_groups

    return duplicate_groups(_documents(spark, sf_dir))


@_register("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gablestat.llm.url_filter import UrlFilter

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return UrlFilter(URL_RULES).fit(pages).transform(pages).drop("url")


@_register("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gablestat.llm.bpe import decode, encode

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return decode(encode(_documents(spark, sf_dir), ranks, pattern), ranks, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@_register("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gablestat.llm.packing import pack, pieces

    # the ids of byte_bpe_50k.json: the same vocabulary as ranks, with its one special string
    return pack(pieces(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),)))


SQL_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""


@_register("op8_jaccard_join", SQL_JACCARD)
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gablestat.llm.jaccard_join import near_duplicates

    return near_duplicates(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@_register("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gablestat.llm.substring_dedup import repeated_passages

    return repeated_passages(_documents(spark, sf_dir)).select("doc_id", "source_id", F.col("start").alias("start_word"), F.col("stop").alias("stop_word"))


@_register("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gablestat.llm.language_id import LanguageId, trainable

    docs = _documents(spark, sf_dir)
    model = LanguageId().fit(docs.where(trainable(held_out(), F.col("doc_id"))))
    return model.transform(docs.select("doc_id", held_out().alias("held_out"), "text")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@_register("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gablestat.llm.toxicity import ToxicityScorer

    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out() & F.col("doc_id").isNotNull())
    model = ToxicityScorer().fit(docs, labels)
    return model.transform(docs.select("doc_id", held_out().alias("held_out"), "text")).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


@_register("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gablestat.llm.weak_quality import WeakQuality

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return WeakQuality().fit(docs).transform(docs).drop("text")


SQL_COLLOCATIONS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL
), t AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, k AS size, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10
), u AS MATERIALIZED (
  SELECT lang, phrase, a, i.k, array_to_string(ws[1:i.k], ' ') AS p1, array_to_string(ws[i.k + 1:], ' ') AS p2
  FROM c, (SELECT unnest([1, 2]) AS k) i WHERE i.k < size
), h AS MATERIALIZED (
  SELECT lang, phrase, a FROM f WHERE a >= 10
), s AS (
  SELECT u.lang, u.phrase, u.k, u.a, l.a AS l, r.a AS r, CAST(1000000::HUGEINT * u.a * u.a // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM u JOIN h l ON l.lang = u.lang AND l.phrase = u.p1 JOIN h r ON r.lang = u.lang AND r.phrase = u.p2
), b AS (
  SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), o AS (
  SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE size = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE size = 3
), v AS (
  SELECT lang, phrase, max(a) AS a FROM o GROUP BY ALL
), x AS (
  SELECT b.* FROM b LEFT JOIN v USING (lang, phrase) WHERE v.a IS NULL OR 100 * v.a < 50 * b.a
), z AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank FROM x
)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) WHERE rank <= 2000
"""


@_register("op13_phrase_collocations", SQL_COLLOCATIONS)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gablestat.llm.collocations import top_collocations

    return top_collocations(_documents(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


SQL_SEARCH = r"""
WITH t AS MATERIALIZED (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
), l AS MATERIALIZED (
  SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY r
), c AS MATERIALIZED (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM l
), q AS MATERIALIZED (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
), f AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS MATERIALIZED (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c
), g AS MATERIALIZED (
  SELECT f.r, f.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))) AS gain
  FROM f JOIN w USING (term) JOIN l USING (r), c
), s AS MATERIALIZED (
  SELECT item_id, r, CAST(sum(gain * q) AS BIGINT) AS score FROM g JOIN q USING (term) GROUP BY ALL HAVING sum(gain * q) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s JOIN l USING (r) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 20
"""


@_register("op12_ranked_search", SQL_SEARCH)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gablestat.llm.lexical_search import search

    return search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_register("op11_chat_format")
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gablestat.llm.chat_format import chat_windows, read_back

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"  # a conversation of control strings, as the query's contract has it
    more = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], turns.schema)
    windows = chat_windows(turns.unionByName(more), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return read_back(windows).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
