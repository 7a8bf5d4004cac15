"""From candidate lists to components, without all pairs of a large list. DataFrame operations only.

1. Every list (a key with its nodes) is compared with one of its nodes, the most central one, and
   the nodes that link to it are marked as connected. A group of thousands of copies is done with
   one comparison per member.
2. Lists of at most SMALL_LIST nodes are then compared exactly: all pairs that are not yet marked
   as connected.
3. The nodes of larger lists that are still open get exact lists: the rarest values of their full
   sets, as many as prefix filtering needs, counted among these nodes. Sets that only share a
   frequent passage fall apart here. These lists too are compared with their most central node,
   then all pairs not yet connected.

No list is cut: each pair that shares a list, and is not known to be connected, is compared or
meets again in the exact lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.llm.components import components
from pagesift.llm.scratch import Scratch

#: longer open lists go through exact lists; affects speed, never the result
SMALL_LIST = 32


def _comparable(percent: int):
    """Sets of these sizes can reach the similarity."""
    return 100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")


def rare_lists(
    entries: DataFrame, retained, needed, scratch: Scratch, name: str = "lists"
) -> DataFrame:
    """Stored inverted lists (key, node, n, weight, place) of each node's necessary rare values.

    `entries` is (key, node, n): the values that a node retains. A set of n values that retains
    `retained(n)` of them shares at least `needed(n)` of these with any set similar enough, so one
    of the first retained - needed + 1 in order of rarity is common to both. weight counts the
    node's values that other nodes have too. Lists of one node are left out.
    """
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    by_rarity = Window.partitionBy("node", "n").orderBy("df", "key")
    of_node = Window.partitionBy("node", "n")
    size = retained(F.col("n"))
    ranked = scratch.store(
        entries.join(shared, "key")
        .withColumn("weight", F.count(F.lit(1)).over(of_node))
        # values that no other node retains come first in the order of rarity
        .withColumn("place", F.row_number().over(by_rarity) + size - F.col("weight"))
        .filter(F.col("place") <= size - needed(F.col("n")) + 1)
        .select("key", "node", "n", "weight", F.col("place").cast("long").alias("place")),
        "ranked",
    )
    several = scratch.store(
        ranked.groupBy("key")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .filter("low <> high")
        .select("key"),
        "several",
    )
    lists = scratch.store(ranked.join(several, "key", "left_semi"), name)
    scratch.drop(ranked, several)
    return lists


def connect(
    lists: DataFrame,
    sets: DataFrame | Callable[[DataFrame], DataFrame],
    verify: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    percent: int = 80,
    small_list: int = SMALL_LIST,
) -> DataFrame:
    """(node, component) of the nodes with links.

    `lists` is a stored table (key, node, n, weight, place), `sets` a table (node, shingles) of all its
    nodes, read once for the open ones, or a function that makes it for given nodes (node); n may be 0 where the size is not known; `verify` turns pairs (a, b) into those that are links.
    """
    links = [_with_pivots(lists, verify, scratch, percent)]
    live, open_lists = _open(lists, links, scratch)
    small = open_lists.filter(F.col("nodes") <= small_list).select("key")
    large = scratch.store(
        live.join(open_lists.filter(F.col("nodes") > small_list).select("key"), "key", "left_semi")
        .select("node")
        .distinct(),
        "large",
    )
    links.append(_verified(_all_pairs(live, small, percent), verify, scratch))
    if not large.isEmpty():
        chosen = sets(large) if callable(sets) else sets.join(large, "node", "left_semi")
        own = scratch.store(chosen, "open-sets")
        entries = own.select(
            "node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("key")
        )
        exact = rare_lists(
            entries,
            retained=lambda n: n,
            needed=lambda n: F.ceil(n * percent / 100).cast("long"),
            scratch=scratch,
            name="exact",
        )
        links.append(_with_pivots(exact, verify, scratch, percent))
        links = [components(_all(links).select("a", "b"), scratch).select(
            F.col("node").alias("a"), F.col("component").alias("b"), F.lit(0).cast("long").alias("weight")
        )]
        live, open_lists = _open(exact, links, scratch)
        links.append(_verified(
                _all_pairs(live, open_lists.select("key"), percent, exact=True), verify, scratch
            ))
    return components(_all(links).select("a", "b"), scratch)


def _all(links: list[DataFrame]) -> DataFrame:
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return every


def _with_pivots(lists: DataFrame, verify, scratch: Scratch, percent: int) -> DataFrame:
    """Links (a, b, weight) of each node a to the most central node b of one of its lists."""
    pivots = scratch.store(
        lists.groupBy("key")
        .agg(F.max(F.struct("weight", "node", "n")).alias("p"))
        .select(
            "key",
            F.col("p.node").alias("other"),
            F.col("p.n").alias("other_n"),
            F.col("p.weight").alias("other_weight"),
        ),
        "pivots",
    )
    pairs = (
        lists.join(pivots, "key")
        .filter("node <> other")
        .filter(_comparable(percent))
        .select(F.col("node").alias("a"), F.col("other").alias("b"), F.col("other_weight").alias("weight"))
        .distinct()
    )
    links = scratch.store(verify(pairs), "links")
    scratch.drop(pivots)
    return links


def _open(
    lists: DataFrame, links: list[DataFrame], scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """The lists with the marks of known connections, and which lists have more than one mark."""
    marks = _all(links).groupBy(F.col("a").alias("node")).agg(
        F.max(F.struct("weight", "b"))["b"].alias("mark")
    )
    live = scratch.store(
        lists.join(marks, "node", "left").select(
            "key", "node", "n", "place", F.coalesce("mark", "node").alias("mark")
        ),
        "live",
    )
    open_lists = scratch.store(
        live.groupBy("key")
        .agg(
            F.min("mark").alias("low"),
            F.max("mark").alias("high"),
            F.count(F.lit(1)).alias("nodes"),
        )
        .filter("low <> high")
        .select("key", "nodes"),
        "open",
    )
    return live, open_lists


def _all_pairs(live: DataFrame, keys: DataFrame, percent: int, exact: bool = False) -> DataFrame:
    """Pairs not known to be connected. In exact lists, the first common value of a pair has at
    most one plus the smaller number of values after it in common, which bounds its places."""
    ours = live.join(keys, "key", "left_semi")
    theirs = ours.select(
        "key",
        F.col("node").alias("other"),
        F.col("mark").alias("other_mark"),
        F.col("n").alias("other_n"),
        F.col("place").alias("other_place"),
    )
    common = 1 + F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    reachable = common * (100 + percent) >= percent * (F.col("n") + F.col("other_n"))
    return (
        ours.join(theirs, "key")
        .filter("node < other and mark <> other_mark")
        .filter(_comparable(percent))
        .filter(reachable if exact else F.lit(True))
        .select(F.col("node").alias("a"), F.col("other").alias("b"))
        .distinct()
        .withColumn("weight", F.lit(-1).cast("long"))
    )


def _verified(pairs: DataFrame, verify, scratch: Scratch) -> DataFrame:
    return scratch.store(verify(pairs), "links")
