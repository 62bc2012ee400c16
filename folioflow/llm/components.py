"""Connected components of link tables by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``): every node of the links (``a``, ``b``) with the smallest node it reaches.

    Ids are bigints; loops, repeated links and either direction are fine, null ends are left out. A
    round is an aggregate and a join on the larger end, so Spark splits a hub's links; nothing is
    gathered per node. Each round is written to the shared folder, and rounds end when the links stay
    the same, which a star forest does after one more round. No links give no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = edges.where(F.col("a") != F.col("b")).select(high.alias("u"), low.alias("v")).distinct()
    links = materialise(links, "links")
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(larger.distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialise(others.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(links: DataFrame) -> tuple[int, int]:
    """Number of links and a sum over their hashes: equal for equal links."""
    mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(mixed)).first())
