"""Connected components by alternating large and small stars, DataFrame operations only.

Each round is written to the shared folder. A node's smallest neighbour comes from an aggregate
with partial sums and is joined back from a written table, so a hub with a third of all links is
an ordinary skewed join that adaptive execution splits; no neighbour list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node.

    Repeated links, both directions and loops are allowed; null ends are ignored. Nodes that
    only have loops are left out, as are nodes without links: they are their own component.
    """
    stars = scratch.store(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "stars",
    )
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.store(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")),
            "least",
        )
        large = scratch.store(
            both.join(least, "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct(),
            "large",
        )
        low = scratch.store(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        # unchanged, and every node has one neighbour below it: stars
        if _fingerprint(large) == _fingerprint(stars) and low.count() == large.count():
            scratch.drop(least, large, low)
            break
        small = scratch.store(
            large.join(low, "u")
            .filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct(),
            "stars",
        )
        scratch.drop(stars, least, large, low)
        stars = small
    result = scratch.store(
        stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
            stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        ),
        "components",
    )
    scratch.drop(stars)
    return result


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(
        links.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")),
        ).first()
    )
