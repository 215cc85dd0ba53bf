"""Connected components of a table of links, by alternating star contractions.

Every step is a grouped minimum and a join back, so neither a component nor a node's neighbours are gathered anywhere;
joins are left to adaptive execution, which splits a node that a third of all links share. Each step is written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablestat.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node root`` (long) for every node of ``links`` (``a b``, long): the root is the component's smallest node.

    Rows with a null end and links of a node to itself are ignored; no links, no rows.
    """
    now = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    while True:
        # now: (a, b) with a < b. Large star: all larger neighbours of a node go to its smallest neighbour.
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array("a", "b")).alias("v"), "m").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        now = cut_lineage(small)
        # done when every node is either a root or the child of one root
        roles = now.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(0).alias("c")), F.struct(F.col("b").alias("v"), F.lit(1).alias("c")))).alias("r"))
        if roles.groupBy("r.v").agg(F.sum("r.c").alias("up"), F.min("r.c").alias("low")).where("up > 1 or (up = 1 and low = 0)").isEmpty():
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
