"""Connected components of links by alternating star contraction, as DataFrame operations.

Each round links every node to the least node it knows of, first upwards and then downwards. Links
live in tables cut to the shared folder; the driver only sees a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.runtime import cut


def stars(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node that is not its own root.

    links: columns a and b of one orderable type; loops, repeats and either direction are fine.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    links = cut(links.where("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    before = None
    while True:
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if before == tuple(now) or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(now)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # merge joins: a broadcast each round would pile up tables in the driver
        up = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        up = up.where("a <> b").distinct()
        down = up.groupBy("a").agg(F.min("b").alias("m"))
        links = cut(up.join(down.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct())
