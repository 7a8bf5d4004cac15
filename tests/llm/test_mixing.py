import random
import re
from collections import defaultdict

import pytest

from pagesift.llm.mixing import mixed_documents, mixture, source_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, budget int"


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", s, len(t or ""), 1, 2) for i, t, s in rows], SCHEMA
    )


def targets(sizes: dict) -> dict:
    """Shares by weight, excess reshared until no target is above twice its source's size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (
        None in sizes
    )
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def planted():
    random.seed(3)
    rows = []
    for n in range(600):
        source = random.choice(["hot"] * 6 + ["a", "b", "ä", "Z", None, "", "tiny"])
        if source == "tiny" and n % 3:
            source = "hot"
        rows.append((n, " ".join("w" * random.randint(1, 9) for _ in range(random.randint(0, 60))), source))
    return rows + [(600, None, "a"), (None, "one two", "b"), (5, "same row", "a"), (5, "same row", "a")]


def sizes(rows):
    found = defaultdict(int)
    for _, text, source in rows:
        found[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return found


def test_targets_and_budgets(spark):
    rows = planted()
    got = mixture(frame(spark, rows)).collect()
    expected, total = targets(sizes(rows)), defaultdict(int)
    source = defaultdict(set)
    for i, _, s in rows:
        source[i].add(s)
    assert len(got) == len(rows)
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(t, 6) for t in expected.values()})
    by_target = {round(t, 6): t for t in expected.values()}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        total[round(r.target, 6)] += r.taken
    assert len(by_target) == len(expected)
    for target, taken in total.items():
        assert abs(taken - target) <= 0.5
    assert sorted(map(tuple, mixture(frame(spark, rows).repartition(7)).collect(), ), key=str) == sorted(
        map(tuple, got), key=str
    )


def test_ranges_do_not_change_the_result(spark):
    from pagesift.llm.mixing import taken_words
    from pagesift.llm.scratch import Scratch

    df = frame(spark, planted())
    one, _ = taken_words(df, Scratch(spark, "t"), range_rows=10**9)
    many, _ = taken_words(df, Scratch(spark, "t"), range_rows=5)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [r for r in planted() if r[0] not in (5, None)]
    df = frame(spark, rows)
    mixed = mixed_documents(df)
    assert mixed.columns == [*df.columns, "epoch"]
    words, taken = defaultdict(int), {r.doc_id: r.taken for r in mixture(df).collect()}
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert dict(words) == {i: t for i, t in taken.items() if t}


def test_no_rows_and_no_words(spark):
    assert mixture(frame(spark, [])).collect() == []
    assert mixed_documents(frame(spark, [])).collect() == []
    (row,) = mixture(frame(spark, [(1, None, None)])).collect()
    assert tuple(row) == (1, 0, 0, 0.0, 0)
    assert mixed_documents(frame(spark, [(1, "", "a")])).collect() == []


def test_one_source_and_many(spark):
    rows = [(n, "a b c", f"s{n:03d}") for n in range(40)]
    got = {r.source: r.target for r in source_targets(frame(spark, rows).selectExpr("source", "3L as size")).collect()}
    assert got == pytest.approx(targets(sizes(rows)))
    (row,) = mixture(frame(spark, [(1, "a b c d", "x")])).collect()
    assert (row.target, row.taken) == (6.0, 6)
