import random
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from pagesift.operators import digest, features, hashing, presence, split
from pagesift.sources import keywords, libsvm


def documents(spark, contents):
    return spark.createDataFrame(
        [(i, 1, f"p{i}", c) for i, c in enumerate(contents)],
        "sample_id bigint, label int, path string, content string",
    )


def long(df):
    return rows(libsvm.to_long(df, ["sample_id"]))


def test_keywords_match_whole_words_and_first_index_wins(spark):
    df = documents(spark, ["Html xhtml", "x_html-html5", "C++ a.b", "été", ""])
    dictionary = [(0, "html"), (1, "a.b"), (2, "été"), (3, "HTML"), (4, "axb")]
    assert long(presence.with_keyword_presence(df, dictionary)) == [
        (0, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0),
    ]


def test_regex_keywords_only_on_request(spark):
    df = documents(spark, ["axb", "a.b"])
    literal = presence.with_keyword_presence(df, [(5, "a.b")])
    pattern = presence.with_keyword_presence(df, [(5, "a.b")], regex=frozenset(["a.b"]))
    assert long(literal) == [(1, 5, 1.0)]
    assert long(pattern) == [(0, 5, 1.0), (1, 5, 1.0)]


def test_rules_are_bounded_by_alphanumerics_only(spark):
    df = documents(spark, ["_VAR_", "var1", "meta  charset", "a meta charset=x", "var t", "x-var t2 -y-"])
    rules = [(1, "var"), (2, "meta charset"), (3, "var t"), (4, "-y-")]
    assert long(presence.with_rule_presence(df, rules)) == [
        (0, 1, 1.0), (3, 2, 1.0), (4, 1, 1.0), (4, 3, 1.0), (5, 1, 1.0), (5, 4, 1.0),
    ]


def test_a_long_stretch_of_words_does_not_exhaust_the_stack(spark):
    df = documents(spark, ["word " * 100_000 + "var t"])
    assert long(presence.with_rule_presence(df, [(3, "var t")])) == [(0, 3, 1.0)]


def test_dictionary_from_a_table(spark):
    table = spark.createDataFrame([(7, "b"), (2, "a"), (3, "b")], "idx int, keyword string")
    assert presence.read_dictionary(table) == [(2, "a"), (3, "b")]


def test_a_large_dictionary_is_joined(spark):
    df = documents(spark, ["A b c", "b x-y", None, "nothing", "x-y b B"])
    table = spark.createDataFrame(
        [(4, "b"), (1, "a"), (9, "B"), (7, "zz"), (5, "x-y")], "idx int, keyword string"
    )
    joined = long(presence.keyword_presence(df, table, limit=3))
    assert joined == long(presence.keyword_presence(df, table))
    assert joined == [(0, 1, 1.0), (0, 4, 1.0), (1, 4, 1.0), (1, 5, 1.0), (4, 4, 1.0), (4, 5, 1.0)]


def test_rule_flags(spark):
    df = documents(spark, ["xVARx", "var", "VAR"])
    rules = [(1, "var", True, True), (2, "var", False, True), (3, "VAR", True, False)]
    assert long(presence.with_rule_presence(df, rules)) == [
        (0, 2, 1.0), (1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 1.0), (2, 3, 1.0),
    ]
    table = spark.createDataFrame([(3, "VAR", True, False)], "idx int, keyword string, fullword boolean, nocase boolean")
    assert presence.read_rules(table) == [(3, "VAR", True, False)]


def test_colliding_indexes_are_refused(spark):
    single = keywords.as_rules(spark.createDataFrame([(825, "a")], "idx int, keyword string"))
    with pytest.raises(Exception, match="n-gram base"):
        keywords.merge_rule_sets(single, single).collect()


def test_values_that_round_to_zero_are_not_written(spark):
    df = spark.createDataFrame([([(3, 1e-14), (4, 0.25)],)], f"features {libsvm.FEATURES_TYPE}")
    line = df.select(libsvm.format_line(F.lit(1), F.col("features"), None, 12)).first()[0]
    assert line == "1 4:0.250000000000 "


def test_merged_rules_shift_ngram_indexes(spark):
    single = keywords.as_rules(spark.createDataFrame([(1, "a")], "idx int, keyword string"))
    merged = keywords.merge_rule_sets(single, single)
    assert rows(merged, "idx", "keyword") == [(1, "a"), (821, "a")]


def test_libsvm_round_trip(spark):
    df = spark.createDataFrame(
        [(1, [(3, 0.5), (0, 2.0), (4, -1.0), (5, 0.0)], "/s/a#1"), (0, [], None)],
        f"label int, features {libsvm.FEATURES_TYPE}, path string",
    )
    lines = df.select(
        libsvm.format_line(F.col("label"), F.col("features"), F.col("path"), 3).alias("value")
    )
    assert rows(lines) == [("0 ",), ("1 0:2 3:0.500  # /s/a#1",)]
    parsed = libsvm.parse_line(lines)
    found = {r["label"]: ([tuple(f) for f in r["features"]], r["comment"]) for r in parsed.collect()}
    assert found == {1: ([(0, 2.0), (3, 0.5)], "/s/a#1"), 0: ([], None)}


def test_one_based_files(spark):
    lines = spark.createDataFrame([("1 1:2 4:1",), ("",)], "value string")
    parsed = libsvm.parse_line(lines, one_based=True).collect()
    assert [[tuple(f) for f in r["features"]] for r in parsed] == [[(0, 2.0), (3, 1.0)]]


def test_merge_lets_the_right_side_win(spark):
    shape = "sample_id int, idx int, value double"
    left = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0)], shape)
    right = spark.createDataFrame([(1, 1, 7.0), (2, 0, 3.0)], shape)
    expected = [(1, 0, 1.0), (1, 1, 7.0), (2, 0, 3.0)]
    assert rows(features.merge_features(left, right)) == expected
    pair = spark.createDataFrame(
        [([(0, 1.0), (1, 1.0)], [(1, 7.0)])],
        f"a {libsvm.FEATURES_TYPE}, b {libsvm.FEATURES_TYPE}",
    )
    merged = pair.select(features.merged_in_row(F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert [tuple(f) for f in merged] == [(0, 1.0), (1, 7.0)]


def test_feature_vectors(spark):
    df = spark.createDataFrame([([(2, 1.5), (9, 1.0)],)], f"features {libsvm.FEATURES_TYPE}")
    vector = features.with_feature_vector(df, 4).first()["vector"]
    assert list(vector) == [0.0, 0.0, 1.5, 0.0]
    vector = features.with_indicator_vector(df, 10).first()["vector"]
    assert dict(zip(vector.indices.tolist(), vector.values.tolist())) == {2: 1.0, 9: 1.0}


def test_hashed_rows_have_unit_length(spark):
    df = hashing.with_hashed_features(documents(spark, ["ab cd ef ab", "", "x"]))
    found = {r["sample_id"]: r["features"] for r in df.collect()}
    assert abs(sum(f["value"] ** 2 for f in found[0]) - 1) < 1e-9
    assert found[1] == [] and found[2] == []
    assert len({f["idx"] for f in found[0]}) == len(found[0])


def test_digest_against_brute_force(spark):
    dice = random.Random(3)
    content = "".join(dice.choices("abcdefgh <>/=", k=400))
    got = digest.with_digest(documents(spark, [content, "short", content + "é"])).collect()
    assert {r["sample_id"] for r in got} == {0, 2}
    counts = Counter()
    for i in range(len(content) - 4):
        w = [ord(c) for c in content[i : i + 5]]
        for k, (a, b) in enumerate(digest.TRIPLETS):
            counts[(w[0] * 961 + w[a] * 31 + w[b] + 7 * k) % 128] += 1
    values = [counts[b] for b in range(128)]
    q1, q2, q3 = (sorted(values)[p - 1] for p in (32, 64, 96))
    codes = [int(np.searchsorted([q1, q2, q3], v)) for v in values]
    expected = [4 * codes[2 * j] + codes[2 * j + 1] for j in range(64)]
    expected += [len(content) % 256 // 16, len(content) % 16]
    expected += [100 * q % (16 * q3) // q3 if q3 else 0 for q in (q1, q2)]
    assert got[0]["digest"] == "".join(f"{n:x}" for n in expected) == got[1]["digest"]


def test_nibbles_reject_other_text(spark):
    df = spark.createDataFrame([("0aF",), ("T1",), ("",)], "d string")
    found = [r[0] for r in df.select(digest.digest_nibbles(F.col("d"))).collect()]
    assert [[tuple(f) for f in x] if x else x for x in found] == [
        [(0, 0.0), (1, 10.0), (2, 15.0)], None, None,
    ]


def test_split_is_stable_disjoint_and_complete(spark):
    df = spark.range(2000).select(F.col("id").alias("sample_id"), (F.col("id") % 2).alias("label"))
    one = rows(split.split_by_rate(df.repartition(1)))
    seven = rows(split.split_by_rate(df.repartition(7)))
    assert one == seven
    train, test = split.train_test_sets(split.split_by_rate(df))
    assert abs(train.count() / 2000 - 0.7) < 0.05
    assert train.join(test, "sample_id").count() == 0
    assert split.full_refit_set(train, test).count() == 2000
