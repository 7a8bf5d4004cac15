import pytest
from conftest import rows

from pagesift.operators.dedupe import dedupe_against, features_for_samples
from pagesift.operators.joins import equi_join, measured_bytes


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join_with_a_hot_key(spark, how):
    keys = ["hot"] * 60 + ["cold", "lost", None] * 5
    left = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    right = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("cold", 3), ("other", 4)], "k string, v int"
    )
    plain = left.join(right, "k", how)
    salted = equi_join(left, right, "k", how, "i", broadcast_bytes=0, hot_rows=10)
    order = lambda df: sorted(map(str, rows_of(df)))
    rows_of = lambda df: [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert order(salted) == order(plain)


def test_measured_bytes_counts_text(spark):
    df = spark.createDataFrame([("x" * 1000,), (None,)], "t string")
    assert 1000 < measured_bytes(df) < 1200


@pytest.mark.parametrize("limit", [0, 10**6])
def test_dedupe_keeps_and_removes_by_file_name(spark, limit):
    source = spark.createDataFrame([("/a/x",), ("/b/x",), ("/b/y",)], "path string")
    target = spark.createDataFrame([("/t/x",), ("/u/z",), ("/v/y",)], "path string")
    kept, removed = dedupe_against(target, source, broadcast_bytes=limit)
    assert rows(kept) == [("/u/z",)]
    assert rows(removed) == [("/t/x",), ("/v/y",)]


def test_feature_lines_of_logged_samples(spark):
    lines = spark.createDataFrame([("1 0:1  # /s/1",), ("0 1:1  # /s/2@x",)], "line string")
    log = spark.createDataFrame([("# /s/2 @ yes",), ("# /s/2 @ again",)], "line string")
    assert rows(features_for_samples(lines, log)) == [("0 1:1  # /s/2@x",)]
