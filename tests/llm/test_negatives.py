import random

import numpy as np
from pyspark.sql import functions as F

from pagesift.llm import negatives
from pagesift.llm.negatives import SEGMENTS, Group, exact_scores, hard_negatives, merged, summaries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, size string, grp int"


def plain(rows, positives=5, count=10):
    """rows: (vec_id, vector, label) of those that take part."""
    own = []
    for number, vector, label in rows:
        if number % 7 == 0:
            label = (label + 1) % 10
        own.append((number, [int(np.floor(256 * float(x))) for x in vector], label))
    found = []
    for anchor, vector, label in own:
        if anchor % 100:
            continue
        scored = [
            (-sum(x * y for x, y in zip(vector, v)), n, other == label)
            for n, v, other in own
            if n != anchor and len(v) == len(vector)
        ]
        scored.sort()
        for p, positive, _ in [s for s in scored if s[2]][:positives]:
            p = -p
            inside = [(-s, n) for s, n, same in scored if not same and 30 * p <= -100 * s <= 90 * p]
            for rank, (score, n) in enumerate(inside[:count], 1):
                found.append((anchor, positive, rank, n, p, score))
    return sorted(found)


def result(df, **options):
    found = hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("vec_id") % 7 == 0, **options)
    return sorted(map(tuple, found.collect()))


def vectors(rng, count, size, step=13):
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    return [
        (n * step % 100_000, [float(np.float32(x + rng.gauss(0, 0.6))) for x in rng.choice(centres)], rng.randrange(10))
        for n in range(count)
    ]


def test_equals_brute_force(spark):
    rng = random.Random(2)
    for size in (64, 20, 3, 1):
        rows = vectors(rng, 700, size)
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
        expected = plain(rows)
        assert expected and result(df) == expected
        # many small groups
        assert result(df, group_bytes=4_000) == expected


def test_ties_go_to_the_smaller_id(spark):
    rows = [(n, [1.0, float(n % 3 == 0)], n % 2) for n in range(0, 400)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert result(df) == plain(rows)


def test_rows_that_take_no_part(spark):
    rng = random.Random(4)
    good = vectors(rng, 300, 8, step=1)
    bad = [
        (1000, None, 1), (1001, [1.0] * 8, None), (1100, [float("nan")] + [1.0] * 7, 1), (1002, [], 1),
        (1003, [None] + [1.0] * 7, 2), (1200, [float("inf")] * 8, 3), (None, [1.0] * 8, 3),
    ]
    other = [(2000, [1.0] * 5, 1), (2001, [2.0] * 5, 1), (2002, [1.0] * 5, 2)]
    df = spark.createDataFrame([(*r, None, None) for r in good + bad + other + good[:50]], SCHEMA)
    assert result(df) == plain(good + other)
    assert result(df.limit(0)) == []


def test_summaries_bound_the_scores():
    rng = np.random.default_rng(1)
    for size in (64, 21, 5):
        left, right = rng.integers(-300, 300, (2, 200, size)).astype(float)
        scores = np.diag(exact_scores(left, right))
        a, b = summaries(left), summaries(right)
        widths, pieces = [], 1
        while pieces <= SEGMENTS:
            (mean, spread), (other, reach) = merged(a, size, pieces), merged(b, size, pieces)
            middle, width = (mean * other).sum(1), (spread * reach).sum(1) + 1e-6
            assert ((middle - width <= scores) & (scores <= middle + width)).all()
            widths.append(width.mean())
            pieces *= 2
        assert sorted(widths, reverse=True) == widths


def test_refinement_prunes():
    rng = np.random.default_rng(3)
    centres = np.repeat(rng.normal(0, 300, (40, 8)), 8, axis=1)
    values = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 20, (4000, 64)))
    labels = rng.integers(0, 3, 4000)
    group = Group(np.arange(4000), labels, values, summaries(values))
    chosen = labels[:20, None] == labels[None, :]

    def wanted(chosen, lower, upper):
        return upper >= negatives._kth(chosen, lower, 5)

    _, left = group.bounded(summaries(values[:20]), wanted, chosen)
    assert left.sum() < chosen.sum() / 5


def test_large_numbers_are_exact():
    left = np.array([[2.0**40, 3.0]])
    right = np.array([[2.0**20 + 1, 7.0]])
    assert exact_scores(left, right).tolist() == [[2**60 + 2**40 + 21]]


def test_query(spark):
    from pagesift.llm.queries import QUERIES

    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    usable = [(r.vec_id, r.embedding, r.label) for r in rows if r.label is not None]
    found = sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, FOLDER).collect()))
    assert found == plain(usable)
