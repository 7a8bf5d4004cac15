import random

from conftest import rows
from pyspark.sql import functions as F

from pagesift.functions.scalars import path_from_line, label_from_path, score_bucket
from pagesift.operators import metrics

SHAPE = "set_name string, label int, score double"


def pairs(data):
    pos = [s for l, s in data if l == 1]
    neg = [s for l, s in data if l == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_auc_equals_pair_counting_with_ties_and_outliers(spark):
    dice = random.Random(2)
    data = [("a", dice.randint(0, 1), dice.choice([0.1, 0.25, 0.5, dice.random(), 7.5, -3.0])) for _ in range(400)]
    data += [("b", dice.randint(0, 1), dice.random()) for _ in range(100)] + [("c", 1, 0.4)]
    df = spark.createDataFrame(data, SHAPE)
    found = {r["set_name"]: r["auc"] for r in metrics.auc(df.repartition(5), ["set_name"]).collect()}
    for name in "ab":
        assert abs(found[name] - pairs([(l, s) for n, l, s in data if n == name])) < 1e-9
    assert found["c"] is None


def test_counts_agree_and_everything_else_is_a_false_negative(spark):
    data = [("a", 1, 0.9), ("a", 0, 0.9), ("a", 0, 0.1), ("a", 1, 0.1), ("a", 1, None), ("a", 5, 0.9)]
    df = spark.createDataFrame(data, SHAPE)
    assert rows(metrics.confusion(df, ["set_name"])) == [("a", 1, 1, 1, 3)]
    row = metrics.metrics(df, ["set_name"]).first()
    assert (row["tp"], row["tn"], row["fp"], row["fn"]) == (1, 1, 1, 3)
    assert row["precision"] == 0.5 and row["recall"] == 0.25
    assert abs(row["f2"] - 5 * 0.5 * 0.25 / (4 * 0.5 + 0.25)) < 1e-12


def test_auc_of_many_scores_in_a_small_range(spark):
    n = 100_000
    df = spark.range(n).select(
        F.lit("a").alias("set_name"),
        (F.col("id") % 3 == 0).cast("int").alias("label"),
        ((F.col("id") + 1) * 1e-12).alias("score"),
    )
    ranks = sum(i + 1 for i in range(0, n, 3))
    pos = len(range(0, n, 3))
    expected = (ranks - pos * (pos + 1) / 2) / (pos * (n - pos))
    assert abs(metrics.auc(df, ["set_name"]).first()["auc"] - expected) < 1e-9


def test_a_score_that_is_no_number_is_missing(spark):
    data = [("a", 1, 0.9), ("a", 0, 0.1), ("a", 1, float("nan")), ("a", 0, float("nan"))]
    df = spark.createDataFrame(data, SHAPE)
    row = metrics.metrics(df, ["set_name"]).first()
    assert (row["tp"], row["tn"], row["fp"], row["fn"], row["auc"]) == (1, 1, 0, 2, 1.0)
    assert rows(metrics.confusion(df, ["set_name"])) == [("a", 1, 1, 0, 2)]


def test_undefined_measures(spark):
    row = metrics.metrics(spark.createDataFrame([("a", 0, 0.1)], SHAPE), []).first()
    assert (row["precision"], row["recall"], row["fpr"], row["fdr"]) == (0.0, 0.0, 0.0, 1.0)
    assert row["f1"] is None and row["f2"] is None and row["auc"] is None


def test_misclassified_and_prior(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 0, 0.7), ("a", 1, 0.9), ("a", 0, 0.6)], SHAPE)
    assert rows(metrics.misclassified_rows(df, 0.65), "label", "outcome") == [(0, "fp"), (1, "fn")]
    assert metrics.prior_threshold(df).first()["threshold"] == 0.5
    assert rows(metrics.class_counts(df)) == [(2, 2, 4)]


def test_buckets_at_their_edges(spark):
    values = [k / 10 for k in range(11)] + [-1.0, 2.0, 0.29999]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in df.select(score_bucket(F.col("v"))).collect()]
    assert found == [f"{k}_{k + 1}" for k in range(10)] + ["9_10", "0_1", "9_10", "2_3"]


def test_path_expressions(spark):
    lines = spark.createDataFrame([("1 0:1 # /a#b @ x",), (" /c ",)], "line string")
    assert rows(lines.select(path_from_line(F.col("line")))) == [("/c",), ("b",)]
    paths = spark.createDataFrame([("/normal/x",), ("/malicious/normal/malicious",), ("/x",)], "p string")
    assert [r[0] for r in paths.select(label_from_path(F.col("p"))).collect()] == [0, 1, 0]
