"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

1. Equal vectors are one class with its smallest ids, so a vector that a third of all rows share
   is searched and found once.
2. The tree is fitted on at most SAMPLE classes (a documented bound for fitting alone); every class
   is put into the leaf that the descent to the nearest centre ends in.
3. A query goes through the tree with a priority queue of bins by the distance to their centre and
   takes leaves in that order. How many is calibrated: for CALIBRATION vectors the true neighbours
   are found against all rows, and the visits are widened until the leaves visited hold RECALL of
   them.
4. Queries meet the rows of their leaves. Leaves are packed into bins, a query sends one row to a
   bin and gets its nearest of all its leaves there; large leaves, and bins of many queries, are
   dealt out in chunks. Distances are exact, in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.llm.scratch import Scratch

NEIGHBOURS = 10
SAMPLE = 20_000
CALIBRATION = 200
RECALL = 0.95
BRANCHES = 8
#: classes in a leaf, about, as long as the sample is large enough for so many leaves
LEAF_ROWS = 200
#: at least so many sampled vectors per leaf
LEAF_SAMPLE = 8
#: classes in a bin or a chunk of a leaf, about
CHUNK_ROWS = 16_384
CHUNK_QUERIES = 4096
_LLOYD_ROUNDS = 8
_BLOCK = 2_000_000


class Tree(NamedTuple):
    """Node n has the children first[n] .. first[n] + count[n] - 1; count 0 makes it leaf[n]."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def _squares(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(1) - 2.0 * rows @ centres.T


def _k_means(rows: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = rows[rng.choice(len(rows), k, replace=False)]
    own = _squares(rows, centres).argmin(1)
    for _ in range(_LLOYD_ROUNDS):
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        sizes = np.bincount(own, minlength=k)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
        new = _squares(rows, centres).argmin(1)
        if (new == own).all():
            break
        own = new
    return centres, own


def build_tree(rows: np.ndarray, leaf_rows: int, branches: int = BRANCHES, seed: int = 7) -> Tree:
    rng = np.random.default_rng(seed)
    centres, first, count, leaf = [rows.mean(0)], [0], [0], [-1]
    waiting, leaves = [(0, np.arange(len(rows)))], 0
    while waiting:
        node, own = waiting.pop()
        parts = []
        if len(own) > leaf_rows:
            middle, part = _k_means(rows[own], min(branches, len(own)), rng)
            parts = [(middle[p], own[part == p]) for p in range(len(middle)) if (part == p).any()]
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        first[node], count[node] = len(centres), len(parts)
        for middle, members in parts:
            waiting.append((len(centres), members))
            centres.append(middle)
            first.append(0)
            count.append(0)
            leaf.append(-1)
    return Tree(np.array(centres), np.array(first), np.array(count), np.array(leaf))


def leaf_of(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """The leaf that each row descends to."""
    node = np.zeros(len(rows), np.int64)
    active = np.flatnonzero(tree.count[node] > 0)
    while len(active):
        for parent in np.unique(node[active]):
            own = active[node[active] == parent]
            low = tree.first[parent]
            children = tree.centres[low : low + tree.count[parent]]
            node[own] = low + _squares(rows[own], children).argmin(1)
        active = active[tree.count[node[active]] > 0]
    return tree.leaf[node]


def leaves_in_order(tree: Tree, query: np.ndarray, enough) -> list[int]:
    """Leaves by best bin first, until `enough` says so of the list or none is left."""
    queue, found = [(0.0, 0)], []
    while queue and not enough(found):
        _, node = heapq.heappop(queue)
        if not tree.count[node]:
            found.append(int(tree.leaf[node]))
            continue
        low = int(tree.first[node])
        children = tree.centres[low : low + tree.count[node]]
        away = ((children - query) ** 2).sum(1)
        for k, distance in enumerate(away.tolist()):
            heapq.heappush(queue, (distance, low + k))
    return found


def _matrix(column) -> np.ndarray:
    """A non-null Arrow or pandas column of equally long lists."""
    if isinstance(column, pa.Array):
        width = len(column[0])
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.stack(column.to_numpy())


def _smallest(distance: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Per row of `distance` the places of the `count` smallest, ties to the smaller id."""
    if distance.shape[1] > count:
        bound = np.partition(distance, count - 1, axis=1)[:, count - 1]
    else:
        bound = distance.max(1)
    places = []
    for row, limit in zip(distance, bound):
        near = np.flatnonzero(row <= limit)
        places.append(near[np.lexsort((ids[near], row[near]))][:count])
    return places


def nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, count: int) -> Iterator:
    """(query's place, ids, distances) of the `count` nearest rows, in double precision."""
    step = max(1, _BLOCK // max(1, rows.size))
    for low in range(0, len(queries), step):
        block = queries[low : low + step]
        distance = np.sqrt(((block[:, None, :] - rows[None, :, :]) ** 2).sum(2))
        for place, near in enumerate(_smallest(distance, ids, count)):
            yield low + place, ids[near], distance[place, near]


def usable(embedding: Column, size: int | None = None) -> Column:
    """Neither null nor zero nor holding null or non-finite components."""
    finite = F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    fits = F.size(embedding) > 0 if size is None else F.size(embedding) == size
    return F.coalesce(
        embedding.isNotNull() & fits & finite & F.exists(embedding, lambda x: x != 0), F.lit(False)
    )


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    neighbours: int = NEIGHBOURS,
    recall: float = RECALL,
    sample: int = SAMPLE,
    leaf_rows: int = LEAF_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of `vectors` (vec_id, embedding) with `is_query`.

    score is the Euclidean distance on the original vectors; ties go to the smaller vec_id. A query
    finds every other row, but not its own id. Rows that are not `usable`, that have a null id, or
    whose length is not the most frequent one (the larger, if two are) take no part. Rows that
    repeat an id and vector are one; a query with fewer candidates gets them all.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        is_query.alias("is_query"),
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    length = (
        rows.groupBy(F.size("embedding").alias("size"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.desc("size"))
        .first()
    )
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == length["size"])
    # zero has two signs
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    keep = neighbours + 1
    own_first = Window.partitionBy("embedding").orderBy("vec_id")
    classes = scratch.store(
        rows.select("embedding", "vec_id")
        .withColumn("place", F.dense_rank().over(own_first))
        .filter(F.col("place") <= keep)
        .groupBy("embedding")
        .agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
        .select(F.col("ids")[0].alias("class"), "embedding", "ids"),
        "classes",
    )
    total = classes.count()
    tree = _fit(classes, total, sample, leaf_rows)
    shared = spark.sparkContext.broadcast(tree)
    placed = scratch.store(
        classes.mapInArrow(
            _placer(shared), "class long, embedding array<double>, ids array<long>, leaf int"
        ),
        "placed",
    )
    # one row per leaf, of which there are at most sample / LEAF_SAMPLE
    sizes = {
        r["leaf"]: (r["ids"], r["n"])
        for r in placed.groupBy("leaf")
        .agg(F.sum(F.size("ids")).alias("ids"), F.count(F.lit(1)).alias("n"))
        .collect()
    }
    visits = _calibrate(placed, total, tree, sizes, neighbours, recall)
    query_rows = rows.filter("is_query").select("vec_id", "embedding").distinct()
    asked = query_rows.join(
        classes.select("class", "embedding"), "embedding"
    ).select(F.col("vec_id").alias("query_id"), "class")
    asked = scratch.store(asked, "asked")
    searched = placed.join(asked.select("class").distinct(), "class", "left_semi")
    found = _search(
        searched, placed, shared, sizes, visits, keep, chunk_rows, chunk_queries, scratch
    )
    order = Window.partitionBy("class").orderBy("score", "vec_id")
    best = scratch.store(
        found.select("class", "score", F.explode("ids").alias("vec_id"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= keep)
        .select("class", "vec_id", "score"),
        "best",
    )
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    result = scratch.store(
        asked.join(best, "class")
        .filter("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= neighbours)
        .select("query_id", "rank", "vec_id", "score"),
        "result",
    )
    scratch.close(result)
    return result


def _fit(classes: DataFrame, total: int, sample: int, leaf_rows: int) -> Tree:
    draw = F.pmod(F.xxhash64(F.lit("tree"), "class"), F.lit(1_000_000)) / 1_000_000
    # sample rows at most, about
    chosen = classes.filter(draw < sample / max(total, 1)).select("class", "embedding")
    points = chosen.toPandas().sort_values("class")
    if not len(points):
        points = classes.limit(1).toPandas()
    share = len(points) / max(total, 1)
    return build_tree(_matrix(points["embedding"]), max(LEAF_SAMPLE, int(leaf_rows * share)))


def _placer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = leaf_of(shared.value, _matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(leaf, pa.int32())],
                    ["class", "embedding", "ids", "leaf"],
                )

    return run


def _calibrate(
    placed: DataFrame, total: int, tree: Tree, sizes: dict, neighbours: int, recall: float
) -> int:
    """Leaves to visit until they hold the wanted share of the true neighbours."""
    draw = F.pmod(F.xxhash64(F.lit("calibration"), "class"), F.lit(1_000_000)) / 1_000_000
    chosen = (
        placed.filter(draw < 2 * CALIBRATION / max(total, 1))
        # by their hash: ids may follow the source or the density
        .orderBy(draw, "class")
        .select("class", "embedding")
        .limit(CALIBRATION)
        .toPandas()
    )
    if not len(chosen):
        return tree.leaves
    queries, own = _matrix(chosen["embedding"]), chosen["class"].to_numpy()
    shared = placed.sparkSession.sparkContext.broadcast(queries)

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            leaf = np.array(batch.column(2))
            where = {int(i): int(x) for i, x in zip(ids, leaf)}
            out: list[list] = [[], [], [], []]
            for place, near, away in nearest(
                shared.value, _matrix(batch.column(1)), ids, neighbours + 1
            ):
                out[0] += [place] * len(near)
                out[1] += near.tolist()
                out[2] += away.tolist()
                out[3] += [where[i] for i in near.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.float64()), pa.array(out[3], pa.int32()),
                ],
                ["query", "class", "score", "leaf"],
            )

    near = Window.partitionBy("query").orderBy("score", "class")
    true = (
        placed.select("class", "embedding", "leaf")
        .mapInArrow(truth, "query int, class long, score double, leaf int")
        .withColumn("place", F.row_number().over(near))
        .filter(F.col("place") <= neighbours + 1)
        .select("query", "class", "leaf")
        .toPandas()
    )
    needed = []
    order = [
        {leaf: n for n, leaf in enumerate(leaves_in_order(tree, q, lambda _: False))} for q in queries
    ]
    for row in true.itertuples():
        if row[2] != own[row.query]:
            needed.append(order[row.query][row.leaf] + 1)
    if not needed:
        return tree.leaves
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]


def _bins(tree: Tree, sizes: dict, chunk_rows: int) -> tuple[np.ndarray, dict[int, int]]:
    """The bin of each leaf, and the chunks of each bin. Neighbouring leaves share a bin; a leaf of
    more than `chunk_rows` has its own."""
    bins, rows = np.zeros(tree.leaves, np.int64), {0: 0}
    current = 0
    for leaf in range(tree.leaves):
        size = sizes.get(leaf, (0, 0))[1]
        if rows[current] and rows[current] + size > chunk_rows:
            current += 1
            rows[current] = 0
        bins[leaf] = current
        rows[current] += size
    return bins, {b: max(1, -(-n // chunk_rows)) for b, n in rows.items()}


def _search(
    searched: DataFrame,
    placed: DataFrame,
    shared,
    sizes: dict,
    visits: int,
    keep: int,
    chunk_rows: int,
    chunk_queries: int,
    scratch: Scratch,
) -> DataFrame:
    """(class, score, ids) of the classes near each searched class, `keep` per bin and chunk."""
    bins, row_chunks = _bins(shared.value, sizes, chunk_rows)
    visit_kind = pa.list_(pa.struct([("bin", pa.int32()), ("leaves", pa.list_(pa.int32()))]))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value

        def enough(found: list[int]) -> bool:
            return len(found) >= visits and sum(sizes.get(x, (0, 0))[0] for x in found) >= keep

        for batch in batches:
            if not batch.num_rows:
                continue
            queries, visited = _matrix(batch.column(1)), []
            for query, own in zip(queries, batch.column(2).to_pylist()):
                found = leaves_in_order(tree, query, enough)
                # the leaf of the query's own class holds its copies
                by_bin: dict[int, list[int]] = {}
                for leaf in found if own in found else [*found, own]:
                    by_bin.setdefault(int(bins[leaf]), []).append(leaf)
                visited.append([{"bin": b, "leaves": leaves} for b, leaves in by_bin.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(visited, visit_kind)],
                ["class", "embedding", "visits"],
            )

    asked = scratch.store(
        searched.select("class", "embedding", "leaf")
        .mapInArrow(
            visit,
            "class long, embedding array<double>, visits array<struct<bin:int,leaves:array<int>>>",
        )
        .select("class", "embedding", F.inline("visits")),
        "visits",
    )
    # one row per bin
    load = {r["bin"]: r["n"] for r in asked.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = scratch.spark
    plan = F.broadcast(
        spark.createDataFrame(
            [
                (leaf, int(b), row_chunks[int(b)], -(-load.get(int(b), 1) // chunk_queries))
                for leaf, b in enumerate(bins)
            ],
            "leaf int, bin int, row_chunks int, query_chunks int",
        )
    )
    of_bin = plan.select("bin", "row_chunks", "query_chunks").distinct()
    asked = (
        asked.join(F.broadcast(of_bin), "bin")
        .withColumn("query_chunk", F.pmod(F.xxhash64("class"), F.col("query_chunks")).cast("int"))
        .withColumn("row_chunk", F.explode(F.sequence(F.lit(0), F.col("row_chunks") - 1)))
    )
    offered = (
        placed.join(plan, "leaf")
        .withColumn("row_chunk", F.pmod(F.xxhash64("class"), F.col("row_chunks")).cast("int"))
        .withColumn("query_chunk", F.explode(F.sequence(F.lit(0), F.col("query_chunks") - 1)))
    )

    def meet(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            rows = rows.sort_values(["leaf", "class"], kind="stable")
            ids, members = rows["class"].to_numpy(), rows["ids"].to_numpy()
            leaves, first = np.unique(rows["leaf"].to_numpy(), return_index=True)
            ends = dict(zip(leaves.tolist(), zip(first, [*first[1:], len(rows)])))
            offered_rows, asked_rows = _matrix(rows["embedding"]), _matrix(queries["embedding"])
            of_leaf: dict[int, list[int]] = {}
            for place, visited in enumerate(queries["leaves"]):
                for leaf in visited:
                    if leaf in ends:
                        of_leaf.setdefault(int(leaf), []).append(place)
            best: dict[int, list[tuple]] = {}
            for leaf, places in of_leaf.items():
                low, high = ends[leaf]
                own = offered_rows[low:high]
                found = nearest(asked_rows[places], own, np.arange(low, high), keep)
                for k, near, away in found:
                    mine = best.setdefault(places[k], [])
                    mine += [(a, int(ids[n]), int(n)) for a, n in zip(away.tolist(), near.tolist())]
                    mine.sort()
                    del mine[keep:]
            asked_ids = queries["class"].to_numpy()
            for place, mine in best.items():
                out += [(asked_ids[place], a, members[n]) for a, _, n in mine]
        return pd.DataFrame(out, columns=["class", "score", "ids"])

    keys = ["bin", "row_chunk", "query_chunk"]
    return (
        asked.select(*keys, "class", "embedding", "leaves")
        .groupBy(*keys)
        .cogroup(offered.select(*keys, "leaf", "class", "embedding", "ids").groupBy(*keys))
        .applyInPandas(meet, "class long, score double, ids array<long>")
    )
