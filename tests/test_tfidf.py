import math
import random
import time
from collections import Counter

from conftest import rows
from pyspark.sql import functions as F

from pagesift.operators import tfidf, vocabulary
from pagesift.sources import libsvm, sinks


def brute(contents, top, low, high):
    grams = []
    for content in contents:
        words = [w for w in content.split() if w not in ("add", "ff")]
        grams.append(
            Counter(
                " ".join(words[i : i + n])
                for n in range(low, high + 1)
                for i in range(len(words) - n + 1)
            )
        )
    total = sum(grams, Counter())
    terms = sorted(sorted(total, key=lambda t: (-total[t], t))[:top])
    frequency = {t: sum(t in g for g in grams) for t in terms}
    cells = {}
    for i, g in enumerate(grams):
        raw = {
            t: g[t] * (math.log((1 + len(grams)) / (1 + frequency[t])) + 1) for t in terms if g[t]
        }
        norm = math.sqrt(sum(v * v for v in raw.values()))
        cells.update({(i, terms.index(t)): v / norm for t, v in raw.items()})
    return terms, cells


def corpus(spark):
    dice = random.Random(1)
    words = ["html", "body", "div", "add", "ff", "var", "nav"]
    contents = [" ".join(dice.choices(words, k=dice.randint(0, 30))) for _ in range(40)] + [""]
    df = spark.createDataFrame(list(enumerate(contents)), "sample_id int, content string")
    return contents, df


def test_weights_equal_brute_force_for_any_partitioning(spark):
    contents, df = corpus(spark)
    terms, cells = brute(contents, 20, 2, 3)
    for parts in (1, 7):
        model = tfidf.fit_tfidf(df.repartition(parts), 20, 2, 3)
        assert list(model.terms) == terms
        weighed = model.transform(df.repartition(parts)).withColumn(
            "features", tfidf.vector_features("tfidf")
        )
        found = {
            (r["sample_id"], r["idx"]): r["value"]
            for r in libsvm.to_long(weighed, ["sample_id"]).collect()
        }
        assert found.keys() == cells.keys()
        assert all(abs(found[c] - cells[c]) < 1e-9 for c in cells)


def test_top_terms_by_pruning_equal_the_plain_count(spark):
    _, df = corpus(spark)
    termed = tfidf.with_terms(df, 1, 3)
    plain = (
        termed.select(F.explode("terms").alias("term"))
        .groupBy("term")
        .count()
        .orderBy(F.desc("count"), "term")
    )
    for count in (1, 5, 37, 10_000):
        expected = [tuple(r) for r in plain.limit(count).collect()]
        assert [tuple(r) for r in tfidf.top_terms(termed, count).collect()] == expected
        for fraction in (0.0, 0.3):
            pruned = tfidf._pruned_top_terms(termed, count, "terms", fraction)
            assert [tuple(r) for r in pruned.collect()] == expected


def test_document_frequency(spark):
    df = spark.createDataFrame([(1, "zz yy zz"), (2, "zz"), (3, "")], "sample_id int, content string")
    frequencies = tfidf.term_frequency(tfidf.with_terms(df, 1, 1), ["sample_id"])
    assert rows(frequencies) == [(1, "yy", 1), (1, "zz", 2), (2, "zz", 1)]
    assert rows(tfidf.document_frequency(frequencies)) == [("yy", 1, 1), ("zz", 3, 2)]


def test_column_operators(spark):
    df = spark.createDataFrame([([(0, 0.5), (2, 0.25), (7, 1.0)],)], f"f {libsvm.FEATURES_TYPE}")
    get = lambda e: [tuple(x) for x in df.select(e.alias("o")).first()["o"]]
    f = F.col("f")
    assert get(tfidf.binarised(f)) == [(0, 1.0), (2, 1.0), (7, 1.0)]
    assert get(tfidf.rebased(f, 820)) == [(820, 0.5), (822, 0.25), (827, 1.0)]
    assert get(tfidf.selected_columns(f, [7, 0])) == [(0, 0.5), (7, 1.0)]
    assert get(tfidf.renumbered(f, [7, 5, 0], 10)) == [(10, 1.0), (12, 0.5)]


def test_dense_rows(spark):
    df = spark.createDataFrame([(1, "zz yy zz")], "sample_id int, content string")
    model = tfidf.fit_tfidf(df, 10, 1, 1)
    dense = sinks.dense_rows(model.transform(df), "tfidf", ["sample_id"], [1, 0]).first()["row"]
    assert [round(v, 6) for v in dense] == [round(2 / math.sqrt(5), 6), round(1 / math.sqrt(5), 6)]


def test_vocabulary_table_equals_the_model(spark):
    contents, df = corpus(spark)
    for top in (5, 40, 1_000_000):
        table = vocabulary.fit_tfidf_table(df, top, 1, 2)
        terms, cells = brute(contents, top, 1, 2)
        found = {r["idx"]: r["term"] for r in table.vocabulary.collect()}
        assert [found[i] for i in range(len(found))] == terms
        # broadcast, joined, and joined with every term salted
        for options in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "hot_rows": 3}):
            weighed = table.transform(df, **options)
            assert weighed.count() == df.count()
            got = {(r[0], r[1]): r[2] for r in libsvm.to_long(weighed, ["sample_id"]).collect()}
            assert got.keys() == cells.keys()
            assert all(abs(got[k] - cells[k]) < 1e-9 for k in cells)


def test_more_terms_than_the_driver_holds(spark):
    df = spark.range(600).select(
        F.col("id").alias("sample_id"),
        F.array_join(
            F.transform(F.sequence(F.lit(0), F.lit(199)), lambda n: F.concat(F.lit("w"), F.col("id") * 200 + n)), " "
        ).alias("content"),
    )
    model = vocabulary.fit_tfidf_table(df, 110_000, 1, 1)
    assert model.vocabulary.count() == 110_000
    assert libsvm.to_long(model.transform(df), ["sample_id"]).count() == 110_000


def test_long_documents_take_time_by_their_length(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(39_999)), lambda n: F.concat(F.lit("w"), n))
    df = spark.range(2).select(F.col("id").alias("sample_id"), F.array_join(words, " ").alias("content"))
    model = vocabulary.fit_tfidf_table(df, 110_000, 1, 1)
    start = time.perf_counter()
    assert libsvm.to_long(model.transform(df), ["sample_id"]).count() == 80_000
    # some seconds; the square of the length takes minutes
    assert time.perf_counter() - start < 60
