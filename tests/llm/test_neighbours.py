import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.llm.neighbours import build_tree, leaf_of, leaves_in_order, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, score int, leaf string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, count=10):
    good = {
        i: np.array(v, np.float32).astype(float)
        for i, v in rows
        if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)
    }
    out = {}
    for q in good:
        if q % 5 == 0:
            near = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)
            out[q] = [(i, d) for d, i in near[:count]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def check(got, exact, recall):
    assert got.keys() == {q for q, near in exact.items() if near}
    hits = total = 0
    for q, near in got.items():
        assert near == sorted(near, key=lambda p: (p[1], p[0])) and len(near) == len(exact[q])
        hits += len({i for i, _ in near} & {i for i, _ in exact[q]})
        total += len(near)
    assert hits >= recall * total


def planted(n=600):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 3
    return [(k, (centres[k % 12] + rng.normal(size=8)).astype(np.float32).tolist()) for k in range(n)]


def test_recall_and_chunks(spark):
    rows = planted()
    for options in ({}, {"leaf_rows": 40, "chunk_rows": 15, "chunk_queries": 3}):
        got = found(nearest_neighbours(frame(spark, rows), F.col("vec_id") % 5 == 0, **options))
        check(got, brute(rows), 0.9)


def test_one_vector_shared_by_a_third(spark):
    rows = planted(200) + [(k, [1.0] * 8) for k in range(1000, 1100)]
    got = found(nearest_neighbours(frame(spark, rows), F.col("vec_id") % 5 == 0, leaf_rows=20))
    exact = brute(rows)
    check(got, exact, 0.9)
    for q in range(1000, 1100, 5):
        assert got[q] == exact[q]


def test_unusable_rows_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 2.0]), (10, [1.0, 2.0]), (6, [0.0, 3.0]), (15, None), (20, [0.0, 0.0]), (25, [nan, 1.0]),
        (30, [inf, 1.0]), (35, [None, 1.0]), (None, [1.0, 1.0]), (40, []), (45, [1.0, 2.0, 3.0]),
        (5, [1.0, 2.0]),
    ]
    got = found(nearest_neighbours(frame(spark, rows), F.col("vec_id") % 5 == 0))
    assert {q: [i for i, _ in near] for q, near in got.items()} == {5: [10, 6], 10: [5, 6]}
    assert found(nearest_neighbours(frame(spark, []), F.col("vec_id") % 5 == 0)) == {}
    assert found(nearest_neighbours(frame(spark, [(5, [1.0])]), F.col("vec_id") % 5 == 0)) == {}


def test_best_bin_first_reaches_every_leaf():
    rows = np.random.default_rng(0).normal(size=(500, 6))
    tree = build_tree(rows, 20)
    leaf = leaf_of(tree, rows)
    assert set(leaf) <= set(range(tree.leaves))
    order = leaves_in_order(tree, rows[3], lambda _: False)
    assert sorted(order) == list(range(tree.leaves))
    assert leaves_in_order(tree, rows[3], lambda found: len(found) >= 4) == order[:4]


def test_query_recall(spark):
    from pagesift.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = found(QUERIES["op10_neighbours"](spark, folder))
    exact = {q: near for q, near in brute(rows).items() if q % 100 == 0}
    check(got, exact, 0.9)
    assert all(near == pytest.approx([d for _, d in got[q]]) for q, near in ((q, [d for _, d in got[q]]) for q in got))


def test_recall_where_ids_follow_density(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 8)) * 40
    dense = [centres[k % 20] + rng.normal(size=8) * 0.01 for k in range(1100)]
    wide = [rng.normal(size=8) * 10 for _ in range(900)]
    rows = [(k, np.float32(v).tolist()) for k, v in enumerate(dense + wide)]
    got = found(nearest_neighbours(frame(spark, rows), F.col("vec_id") % 5 == 0, leaf_rows=40))
    check(got, brute(rows), 0.88)
