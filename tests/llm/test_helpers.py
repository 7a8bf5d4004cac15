import random

import brute
import numpy as np
import pyarrow as pa

from pagesift.llm.bytewords import (
    ALPHANUMERIC,
    NOT_SPACE,
    ngram_hashes,
    prefix_codes,
    slices,
    span_hashes,
    word_bounds,
)
from pagesift.llm.components import components
from pagesift.llm.linking import connect, rare_lists
from pagesift.llm.scratch import Scratch


def test_components_of_random_links_chains_and_hubs(spark):
    rng = random.Random(6)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)]
    links += [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)]
    links += [(5, 5), (7000, 7000)]
    df = spark.createDataFrame(links + links[:20] + [(b, a) for a, b in links[:20]], "a long, b long")
    found = {r.node: r.component for r in components(df, Scratch(spark, "t")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert found == brute.group(nodes, [link for link in links if link[0] != link[1]])
    assert components(df.limit(0), Scratch(spark, "t")).collect() == []


def test_long_open_lists_lose_no_link(spark):
    rng = random.Random(7)
    common = list(range(40))
    sets = {n: set(common) | {1000 + 10 * n + k for k in range(rng.randint(2, 14))} for n in range(60)}
    for n in range(60, 70):
        sets[n] = set(sets[n - 60]) | {n + 5000}
    rows = spark.createDataFrame([(n, sorted(s)) for n, s in sets.items()], "node long, shingles array<long>")
    scratch = Scratch(spark, "t")
    stored = scratch.store(rows, "sets")
    # one list of all nodes, as a candidate step without any filter gives it
    lists = scratch.store(
        rows.selectExpr("1L as key", "node", "size(shingles) as n", "node as weight", "0L as place"), "l"
    )

    def verify(pairs):
        both = pairs.join(stored.selectExpr("node as a", "shingles as x"), "a").join(
            stored.selectExpr("node as b", "shingles as y"), "b"
        )
        return both.filter(
            "100 * size(array_intersect(x, y)) >= 80 * size(array_union(x, y))"
        ).select("a", "b", "weight")

    found = {r.node: r.component for r in connect(lists, stored, verify, scratch).collect()}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    exact = brute.group(sets, links)
    assert {n: found.get(n, n) for n in sets} == exact and len(set(exact.values())) < 60


def test_rare_lists_hold_the_necessary_values(spark):
    from pyspark.sql import functions as F

    entries = spark.createDataFrame(
        [(k, n, 5) for n in range(4) for k in [1, 2, 3, 4, 100 + n]], "key long, node long, n long"
    )
    lists = rare_lists(
        entries, lambda n: n, lambda n: F.ceil(n * 0.8).cast("long"), Scratch(spark, "t")
    ).collect()
    # two values each: the own one, of no use as a list, and the first of the common ones
    assert sorted((r.key, r.node, r.place, r.weight) for r in lists) == [(1, n, 2, 4) for n in range(4)]


def test_words_never_cross_texts_or_slices():
    texts = ["ab cd", "", None, "ef", " g\tHÉ-h ", "x" * 50 + " y", "é"]
    for members, split in ((NOT_SPACE, brute.SPACE_WORD), (ALPHANUMERIC, brute.ITEM_WORD)):
        for limit in (1, 7, 10**6):
            words, rows = [], []
            for low, high, data, offsets in slices(pa.array(texts), limit):
                starts, ends, first = word_bounds(data, offsets, members)
                for k in range(high - low):
                    own = range(first[k], first[k + 1])
                    rows.append([bytes(data[starts[w] : ends[w]]).decode() for w in own])
                words += span_hashes(prefix_codes(data), starts, ends).tolist()
            # A-Z and a-z are one; the patterns are made for lower-cased texts
            rows = [[brute.lower(w) for w in row] for row in rows]
            assert rows == [split.findall(brute.lower(t)) for t in texts]
            flat = [w for row in rows for w in row]
            assert len(set(zip(flat, words))) == len(set(words)) == len(set(flat))


def test_ngram_hashes_tell_order():
    words = np.array([1, 2, 1, 2, 2, 1], np.uint64)
    hashes = ngram_hashes(words, 2).tolist()
    assert hashes[0] == hashes[2] and hashes[1] != hashes[0] and hashes[1] == hashes[4]
    assert len(ngram_hashes(words, 7)) == 0
