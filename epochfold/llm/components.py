"""Connected components of a graph of links, by alternating stars; nothing is collected to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochfold.llm import common as C


def components(links: DataFrame, what: str = "components") -> DataFrame:
    """links(a, b) -> (node, component): the smallest node that each node of a link reaches.

    Large and small stars in turn: first each node hands its larger neighbours to the smallest one around, then each
    node hands its smaller neighbours, and itself, to the smallest of them. The rounds grow with the logarithm of the
    longest path. A star's centre is found by a partial aggregate before the shuffle, and each round is written out.
    Loops and repeated links are harmless; rows with a null end are ignored.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = C.stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = C.stash(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), what)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
