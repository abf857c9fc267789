"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermatch.llm.common import pin


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``links``; a component is named by
    its smallest node.

    Alternating star contraction: every node hands its smallest neighbour to
    its larger neighbours, then to its smaller ones, until only stars are left;
    the rounds grow with the logarithm of a component's size. Each round is
    written to the shared folder. Null ends, loops and repeated links are
    ignored; no link gives an empty table.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    links = pin(links.where(f"`{a}` <> `{b}`").select(hi.alias("a"), lo.alias("b")).distinct(), "links")
    before = _fingerprint(links)
    while before[0]:
        # every node's smallest neighbour goes to its larger neighbours
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # and then to its smaller ones
        large = pin(large, "links-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b")
                 .unionByName(least.select("a", F.col("m").alias("b"))))
        links = pin(small.distinct(), "links-small")
        after = _fingerprint(links)
        if after == before:
            break
        before = after
    return (links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
            .unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
