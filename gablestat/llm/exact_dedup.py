"""Exact duplicates by deterministic block naming.

A text without its white space is cut into blocks of ``BLOCK`` bytes. Blocks that occur more than once are
sorted and get integer names; then names of neighbouring blocks are paired, the pairs are sorted and named,
and so on until one name stands for the whole text. Two texts are equal if and only if they end on the same
level with the same name: names stand for contents, never for hashes of them (a hash only says where in the order a block comes).

Blocks are first counted by a hash, of a few bytes each; a block whose hash comes once is never compared or moved again.
A text with a block that occurs nowhere else equals no other text and leaves the recursion, so only what is
still undecided is paired. The sort of a level yields names by ``monotonically_increasing_id`` over the
ordered rows; the level is written to the shared folder before use, so a lost executor can't lead to other
names.

Skew: occurrences are counted with map-side sums, and names are joined to occurrences with plain joins that
adaptive execution can split, so a block of a third of all rows is no hot task.

Defined results: a null text counts as empty, empty and blank texts are equal to each other; rows may repeat
or share a doc_id (then a 64-bit hash of the text tells them apart) and doc_id may be null; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gablestat.session import cut_lineage

BLOCK = 4096
SPACES = " \t\n\x0b\x0c\r"


def normalized(text: Column) -> Column:
    """The text without ``[\\x20\\x09-\\x0D]``, null as empty."""
    text = F.coalesce(text, F.lit(""))
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _numbered(keys: DataFrame) -> DataFrame:
    """The distinct keys with integer names in the order of (hash, key).

    Ranges are cut by the hash alone, so the sampled borders that the driver gets are 8 bytes each and never blocks.
    """
    mark = F.xxhash64(*keys.columns)
    ordered = keys.repartitionByRange(mark).sortWithinPartitions(mark, *keys.columns)
    return cut_lineage(ordered.withColumn("name", F.monotonically_increasing_id()))


def text_names(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``unit level name`` for every text that may have an equal; ``unit`` is struct(key, hash).

    Equal (level, name) means equal texts; a text without a row here is unique.
    """
    plain = docs.select(F.col(key).alias("_key"), normalized(F.col(text)).alias("_norm"))
    rows = plain.select(F.struct(F.col("_key").alias("key"), F.xxhash64("_norm").alias("tag")).alias("unit"), F.encode("_norm", "UTF-8").alias("_bytes"))
    cut = rows.select(
        "unit", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length("_bytes") - 1) / block).cast("int"))),
            lambda i: F.substring(F.col("_bytes"), i * block + 1, F.lit(block)))).alias("i", "block"),
        F.greatest(F.lit(1), F.ceil(F.octet_length("_bytes") / block).cast("int")).alias("n"))
    # a block whose hash comes once comes once itself: the others are told by their hashes, and only they are sorted and named
    marked = cut.withColumn("mark", F.xxhash64("block"))
    often = cut_lineage(marked.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"))
    cut = cut_lineage(marked.join(often, "mark", "left_semi").drop("mark"))
    names = _numbered(cut.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block"))
    now = cut_lineage(cut.join(names, "block").select("unit", "n", "i", "name"))
    done, level = None, 0
    while True:
        # a whole text per row at n = 1: finished; the rest goes on in pairs
        ended = now.where("n = 1").select("unit", F.lit(level).alias("level"), "name").distinct()
        done = ended if done is None else done.unionByName(ended)
        if now.where("n > 1").isEmpty():
            return done
        level += 1
        paired = now.where("n > 1").groupBy("unit", "n", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("b"))
        whole = paired.where("a is not null and (b is not null or 2 * i + 1 = n)").select(
            "unit", F.expr("cast((n + 1) div 2 as int)").alias("n"), "i", "a", F.coalesce("b", F.lit(-1).cast("long")).alias("b"))
        whole = cut_lineage(whole)
        now = cut_lineage(whole.join(_numbered(whole.select("a", "b").distinct()), ["a", "b"]).select("unit", "n", "i", "name"))


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: ``doc_id keep_id group_size kept text_sha256``.

    Of equal texts the one with the most code points before normalising stays, then the smallest key. If
    that row itself repeats, its repeats are rows of the group and all bear ``kept``, since nothing tells
    them apart; ``dropDuplicates`` on the key leaves one.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("size"), normalized(F.col(text)).alias("_norm"))
    rows = rows.select(
        "doc_id", "size", F.struct(F.col("doc_id").alias("key"), F.xxhash64("_norm").alias("tag")).alias("unit"), F.sha2("_norm", 256).alias("text_sha256"))
    rows = cut_lineage(rows)
    named = text_names(docs, key, text, block)
    members = cut_lineage(rows.join(named, "unit", "left"))
    alike = members.where("level is not null")
    best = alike.groupBy("level", "name").agg(
        F.min(F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("blank"), "doc_id")).alias("best"), F.count("*").alias("group_size"))
    # written, so that the join back is one that adaptive execution can split where one group holds very many rows
    best = cut_lineage(best.select("level", "name", F.col("best.doc_id").alias("keep_id"), (-F.col("best.size")).alias("keep_size"), "group_size"))
    grouped = alike.join(best, ["level", "name"]).select("doc_id", "size", "keep_id", "keep_size", "group_size", "text_sha256")
    single = members.where("level is null").select(
        "doc_id", "size", F.col("doc_id").alias("keep_id"), F.col("size").alias("keep_size"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    out = grouped.unionByName(single)
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size"))).alias("kept"), "text_sha256")
