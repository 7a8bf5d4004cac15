import hashlib
import random

import brute
import numpy as np
import pytest

from pagesift.llm.suffix_dedup import (
    common_prefixes,
    repeated_spans,
    repeated_starts,
    sliding_minimum,
    suffix_array,
)


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, 1, "m") for i, t in rows], "doc_id long, text string, key int, marks string"
    ).repartition(3)


def check(spark, rows, **options):
    got = sorted(
        (str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        for r in repeated_spans(frame(spark, rows), **options).collect()
    )
    expected = sorted(
        (str(i), n, removed, spans, hashlib.sha256(kept).hexdigest())
        for i, n, removed, spans, kept in brute.repeated_spans(rows, options.get("size", 400))
    )
    assert got == expected
    return got


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for letters, count in ((2, 300), (4, 700), (1, 60), (200, 500)):
        data = rng.integers(0, letters, count).astype(np.uint8)
        data[count // 2 : count // 2 + count // 4] = data[: count // 4]
        order, _ = suffix_array(data, count)
        raw = data.tobytes()
        expected = sorted(range(count), key=lambda p: raw[p:])
        assert order.tolist() == expected
        shared = [0]
        for a, b in zip(expected, expected[1:]):
            n = 0
            while max(a, b) + n < count and raw[a + n] == raw[b + n]:
                n += 1
            shared.append(n)
        assert common_prefixes(data, order).tolist() == shared


def test_repeated_starts():
    data = np.frombuffer(b"abcdefabcdxyzabcdef", np.uint8)
    every = np.ones(len(data), bool)
    assert np.flatnonzero(repeated_starts(data, every, 4)).tolist() == [0, 1, 2, 6, 13, 14, 15]
    some = every.copy()
    some[[0, 6]] = False
    assert np.flatnonzero(repeated_starts(data, some, 4)).tolist() == [1, 2, 14, 15]


def test_sliding_minimum():
    values = np.random.default_rng(1).integers(0, 50, 97)
    for width in (1, 5, 97, 40):
        expected = [values[p : p + width].min() for p in range(97 - width + 1)]
        assert sliding_minimum(values, width).tolist() == expected


def planted(size):
    random.seed(size)
    text = lambda n: "".join(random.choice("abcdé ") for _ in range(n))
    rows, passage, base = [], text(size + 30), text(5 * size)
    for n in range(30):
        rows.append((n, text(random.randint(0, 2 * size)) + passage + text(random.randint(0, size))))
    for n in range(30, 45):
        near = list(base)
        for _ in range(n - 30):
            near[random.randrange(len(near))] = "X"
        rows.append((n, "".join(near)))
    rows.append((50, text(size) + base[: size + 5] + text(9) + base[3 : size + 1]))
    rows.append((51, "z" * (2 * size)))
    rows.append((52, passage[:size] + passage[1 : size + 1]))
    rows.append((53, passage[:size]))
    return rows


@pytest.mark.parametrize(
    "options",
    [
        {"size": 40, "window": 8},
        {"size": 40, "window": 8, "shard_runs": 3, "band": 4},
        {"size": 40, "window": 8, "shard_runs": 1},
        {"size": 40, "window": 8, "shard_bytes": 200},
        {},
    ],
)
def test_equals_brute_force(spark, options):
    got = check(spark, planted(options.get("size", 400)), **options)
    assert sum(r[2] for r in got) > 0


def test_nulls_empties_repeats(spark):
    text = "".join(chr(97 + n * n % 23) for n in range(50)) + "end"
    rows = [(1, None), (2, ""), (3, text), (3, text), (4, "short"), (None, text[5:] + "!"), (None, None)]
    check(spark, rows, size=30, window=8)
    assert repeated_spans(frame(spark, [])).collect() == []


def test_query_on_the_smallest_table(spark):
    from pagesift.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {tuple(r) for r in QUERIES["op5_suffix_dedup"](spark, folder).collect()}
    assert got == {
        (i, n, removed, spans, hashlib.sha256(kept).hexdigest())
        for i, n, removed, spans, kept in brute.repeated_spans(rows, 400)
    }
