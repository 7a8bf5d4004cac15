import random

import brute
import pyarrow as pa
import pytest

from pagesift.llm.neardup import near_duplicates, shingle_sets

FOLDER = "/root/testdata/sf0.001"


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, digest int")


def test_equals_brute_force_on_planted_groups(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(300)]
    rows, number = [], 0
    for size in (3, 4, 6, 20, 60, 90, 110, 140, 400):
        base = [random.choice(words) for _ in range(size)]
        for copy in range(8):
            text = list(base)
            for _ in range(copy * size // 60):
                text[random.randrange(size)] = random.choice(words)
            if copy % 3 == 2:
                text = text[: max(1, size - copy)]
            rows.append((number, (" ", "\t", "\n ")[copy % 3].join(text)))
            number += 1
    # a passage that most texts share without being near duplicates
    passage = [random.choice(words) for _ in range(60)]
    for _ in range(60):
        rows.append((number, " ".join(passage + [random.choice(words) for _ in range(30)])))
        number += 1
    df = frame(spark, [(i, t, "x", 1) for i, t in rows]).repartition(3)
    for size in (4, 5):
        assert result(near_duplicates(df, words=size)) == brute.near_duplicates(rows, size)


def test_chain_of_copies_is_one_component(spark):
    words = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 100])) for i in range(20)]
    got = result(near_duplicates(frame(spark, [(*r, None, None) for r in rows])))
    assert got == brute.near_duplicates(rows, 5)
    assert {v[1] for v in got.values()} == {0}


def test_nulls_empties_repeats_and_ties(spark):
    text = " ".join(f"a{i}" for i in range(50))
    rows = [(3, text), (3, text), (1, None), (2, ""), (4, " \n"), (7, text.upper()), (None, text)]
    got = near_duplicates(frame(spark, [(*r, "c", 0) for r in rows])).collect()
    found = sorted(
        ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=lambda r: str(r)
    )
    assert found == [
        (1, 0, 1, True), (2, 0, 2, True), (3, 46, 3, True), (3, 46, 3, True), (4, 0, 4, True),
        (7, 46, 3, False), (None, 46, None, True),
    ]


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).collect() == []


def test_very_long_text_is_one_slice():
    text = " ".join(str(i) for i in range(400_000))
    (own,) = shingle_sets(pa.array([text]), 4)
    assert len(own) == 399_997


@pytest.mark.parametrize("name", ["op9_minhash_neardup"])
def test_query(spark, name):
    from pagesift.llm.queries import QUERIES

    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    expected = brute.near_duplicates([(r.doc_id, r.text) for r in rows], 4)
    assert result(QUERIES[name](spark, FOLDER)) == expected
