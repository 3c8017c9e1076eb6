"""Connected components of links that live in a DataFrame, by alternating stars.

Every node first points its larger neighbours to the smallest node it sees (large star), then its smaller
ones (small star), until nothing changes; each component is then one star around its smallest node.
Only minima are aggregated, with map-side sums, and the joins hold one row a node on one side, so a
hub is split by the engine.  Each round is written to the shared folder, and deleted when the next is; the driver sees two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from grapnel.scratch import discard, materialize


def _star(links: DataFrame, small: bool) -> DataFrame:
    """links: u, v with u > v."""
    seen = links if small else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    told = seen.join(least, "u")
    if small:
        out = told.select(F.col("v").alias("a"), "m").unionByName(least.select(F.col("u").alias("a"), "m"))
    else:
        out = told.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), "m")
    return out.where(F.col("a") > F.col("m")).select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the component's smallest node) for every node that has a link to another."""
    own = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialize(own, "links")
    sign = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = sign(now)
    while before[0]:
        last, now = now, materialize(_star(_star(now, small=False), small=True), "links")
        discard(last)
        after = sign(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
