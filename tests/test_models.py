import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pagesift.operators import models, selection, selftrain, tfidf, topics, vectors
from pagesift.session import new_output
from pagesift.sources.libsvm import FEATURES_TYPE


@pytest.fixture(scope="module")
def labelled(spark):
    noise = (F.xxhash64("id") % 100).cast("double") / 1000
    return (
        spark.range(120)
        .select(
            F.col("id").alias("sample_id"),
            (F.col("id") % 2).cast("int").alias("label"),
            array_to_vector(F.array((F.col("id") % 2) + noise, noise, F.lit(0.0))).alias("features"),
        )
        .cache()
    )


def test_importances(spark, labelled):
    ranking = selection.select_features(labelled, "features", trees=20, depth=4)
    assert abs(sum(ranking.importances) - 1) < 1e-6
    assert ranking.order[0] == 0
    assert len(ranking.best(2)) == 2
    again = selection.select_features(labelled.repartition(3), "features", trees=20, depth=4)
    assert again == ranking
    model = tfidf.TfidfModel(("a", "b", "c"), (1, 1, 1), 2, 1, 1, True, True)
    ranked = selection.importance_rank(spark, ranking, model)
    assert [r["rank"] for r in ranked.orderBy("rank").collect()] == [1, 2, 3]
    rules = selection.generate_rules(ranked, 2).orderBy("idx").collect()
    assert [r["idx"] for r in rules] == [0, 1] and rules[0]["keyword"] == "a"
    assert selection.importance_report(ranked).orderBy("rank").first()["line"].startswith("1.feature 0 a (")


@pytest.mark.parametrize("name", models.MODEL_NAMES)
def test_each_model_separates_the_classes(spark, labelled, name):
    model = models.train(labelled, name)
    scored = models.score_samples(model, labelled, ["sample_id", "label"])
    wrong = scored.filter((F.col("score") >= 0.5) != (F.col("label") == 1)).count()
    assert wrong == 0


def test_saved_model_gives_equal_scores(spark, labelled):
    model = models.train(labelled, "xgboost", maxIter=3)
    path = new_output(spark, "model")
    models.save_model(model, path)
    parent, name = path.rsplit("/", 1)
    config = {"filesystem": {"mid_folder": parent}, "model": {"xgboost": {"model_name": name}}}
    for loaded in (models.load_model(path), models.load_model(config=config)):
        before = models.score_samples(model, labelled, ["sample_id"])
        after = models.score_samples(loaded, labelled, ["sample_id"])
        assert before.exceptAll(after).count() == 0


def test_unknown_names():
    with pytest.raises(ValueError):
        models.make_classifier("forest", 3)
    with pytest.raises(ValueError):
        models.model_names("svm|forest")
    assert models.model_names("svm|keras") == ["svm", "keras"]


def test_self_training_conserves_samples(spark, labelled):
    known = labelled.filter("sample_id < 60")
    unknown = labelled.filter("sample_id >= 60")
    grown, left, report = selftrain.self_train_round(known, unknown, maxIter=3)
    rounds = report.collect()
    assert grown.count() + left.count() == 120
    assert sum(r["added_1"] + r["added_0"] for r in rounds) == grown.count() - 60
    assert grown.select("sample_id").distinct().count() == grown.count()


def test_nmf_loss_never_rises(spark):
    df = spark.range(30).select(
        F.col("id").alias("sample_id"),
        F.array(
            *[
                F.struct(F.lit(j).alias("idx"), (1.0 + F.pmod(F.xxhash64("id", F.lit(j)), F.lit(5))).alias("value"))
                for j in range(6)
            ]
        )
        .cast(FEATURES_TYPE)
        .alias("features"),
    )
    fitted = topics.fit_nmf(df, 6, components=2, rounds=7, alpha=0.0, tolerance=0.0)
    assert len(fitted.losses) == 7
    assert all(b <= a + 1e-9 for a, b in zip(fitted.losses, fitted.losses[1:]))
    assert fitted.weights.count() == 30
    top = topics.nmf_topics(spark, fitted, tuple("abcdef"), 3).collect()
    assert len(top) == 6


def plain_nmf(matrix, w, h, rounds, l1, l2):
    """Rounds on a dense matrix; returns the weights, components and losses."""
    losses = []
    for _ in range(rounds):
        w = w * ((matrix / (w @ h + 1e-12)) @ h.T) / (h.sum(1) + l1 + l2 * w + 1e-12)
        fit = w @ h + 1e-12
        ratio = matrix / fit
        logs = np.where(ratio > 0, matrix * np.log(np.where(ratio > 0, ratio, 1)) - matrix, 0)
        losses.append(logs.sum() + (w.sum(0) * h.sum(1)).sum())
        h = h * (w.T @ ratio) / (w.sum(0)[:, None] + l1 + l2 * h + 1e-12)
    return w, h, losses


def test_nmf_agrees_with_dense_rounds(spark, monkeypatch):
    monkeypatch.setattr(topics, "BLOCK_ROWS", 3)
    width, ids = 4, list(range(20))
    matrix = np.array([[(i * 7 + j * 3) % 5 for j in range(width)] for i in ids], float)
    matrix[:, 3] = 0  # a feature that is listed with zeros alone
    matrix[5] = 0
    data = [(i, [(j, float(x)) for j, x in enumerate(row)] if i != 5 else []) for i, row in zip(ids, matrix)]
    # documents with features that do not count have no weights
    data += [(100, None), (101, [(width, 1.0)]), (102, [(0, None)]), (103, [(None, 1.0), (1, 1.0)])]
    df = spark.createDataFrame(data, "sample_id bigint, features array<struct<idx:int,value:double>>")
    fitted = topics.fit_nmf(df, width, components=3, rounds=6, tolerance=0.0, checkpoint_every=2)
    start = df.filter("sample_id < 100").select(
        "sample_id",
        *[((F.pmod(F.xxhash64("sample_id", F.lit(k)), F.lit(1000)) + 1) / 1000).alias(f"w{k}") for k in range(3)],
    )
    w = np.array([row[1:] for row in sorted(map(tuple, start.collect()))])
    h = np.array([[topics._start(k, j) for j in range(width)] for k in range(3)])
    w, h, losses = plain_nmf(matrix, w, h, 6, 0.05, 0.05)
    assert np.allclose(fitted.losses, losses) and np.allclose(fitted.components, h)
    rows = {row[0]: row[1:] for row in map(tuple, fitted.weights.collect())}
    assert np.allclose([rows[i] for i in ids], w)
    assert all(rows[i] == (None, None, None) for i in range(100, 104)) and len(rows) == 24


def texts(spark):
    data = [(i, i % 2, ("html body div " if i % 2 else "var function call ") * 5, f"s{i % 3}") for i in range(40)]
    return spark.createDataFrame(data, "sample_id int, label int, content string, set_name string")


def test_dictionary_and_bags(spark):
    df = spark.createDataFrame([(2, "b a  b"), (1, "c b")], "sample_id int, content string")
    dictionary = topics.build_dictionary(df)
    assert {r["token"]: r["id"] for r in dictionary.collect()} == {"b": 0, "c": 1, "a": 2}
    probe = spark.createDataFrame([(9, "A b zz b")], "sample_id int, content string")
    found = topics.doc_bow(probe, dictionary).collect()
    assert sorted((r["id"], r["n"]) for r in found) == [(0, 2), (2, 1)]


def test_dense_numbers_have_no_gaps(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("v"))
    numbered = topics.dense_numbers(df.repartition(6), ["v"], "n").orderBy("v").collect()
    assert [r["n"] for r in numbered] == list(range(1000))


def test_topics(spark):
    model = tfidf.fit_tfidf(texts(spark), 10, 1, 1)
    found = topics.lda_topics(spark, topics.fit_lda(model.transform(texts(spark))), model.terms, 3)
    assert found.groupBy("topic").count().filter("count = 3").count() == 2


def test_vectors_and_sweep(spark):
    df = texts(spark)
    assert {r["word"] for r in vectors.frequent_words(df, 3).collect()} == {
        "html", "body", "div", "var", "function", "call",
    }
    assert vectors.frequent_words(df, 101).isEmpty()
    words = vectors.fit_vectors(df, size=5, epochs=1)
    out = words.transform(df).select(vectors.vector_features().alias("f"))
    assert all(f["value"] > 0 for r in out.collect() for f in r["f"])
    table = vectors.sweep_vector_size(df, df, [3, 4], epochs=1, maxIter=2)
    sizes = {(r["size"], r["set_name"]) for r in table.collect()}
    assert sizes == {(s, n) for s in (3, 4) for n in ("train", "s0", "s1", "s2")}
