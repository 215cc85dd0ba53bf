"""Rows that may have a key of a table, told by a bitmap of fixed size, so that wide rows without such a key are not moved for a join.

The keys' hashes set bits of ``2 ** BITS`` (8 MB as numbers), which go to every task in blocks. A chance hit only means that a row takes
part in the join that decides; no row is lost or kept by the bitmap alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 25


def _told(rows: DataFrame, keys: DataFrame, *names: str) -> tuple[DataFrame, Column]:
    """The rows with the block of bits that their key falls in, and whether its bit is set. Columns of one name must be of one type."""
    place = F.pmod(F.xxhash64(*names), F.lit(1 << BITS)) + 1
    blocks = keys.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    # numbers of four bytes each, which a row's test reads much faster than bytes
    number = lambda i: F.conv(F.hex(F.substring("_bits", 4 * i + 1, F.lit(4))), 16, 10).cast("long")
    blocks = blocks.select("_block", F.transform(F.sequence(F.lit(0), F.lit(1023)), number).alias("_bits"))
    at = F.bitmap_bit_position(place).cast("int")
    told = rows.join(F.broadcast(blocks), F.bitmap_bucket_number(place) == F.col("_block"), "left")
    bit = at.bitwiseAND(F.lit(31)).bitwiseXOR(F.lit(24))  # the first byte of a number is its highest
    return told, F.coalesce(F.getbit(F.get("_bits", F.shiftright(at, 5)), bit) == 1, F.lit(False))


def may_have(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """The rows whose ``names`` are in ``keys``, and a few others. ``keys`` is read here, so it had better be stored."""
    told, held = _told(rows, keys, *names)
    return told.where(held).select(*[F.col(f"`{c}`") for c in rows.columns])


def surely_without(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """The rows that ``may_have`` leaves out."""
    told, held = _told(rows, keys, *names)
    return told.where(~held).select(*[F.col(f"`{c}`") for c in rows.columns])
