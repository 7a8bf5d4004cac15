import re
import unicodedata
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesift.functions import text


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in df.select("i", expression.alias("out")).orderBy("i").collect()]


def test_number_tokens_are_exactly_the_three_notations(spark):
    numbers = range(0, 65536, 7)
    stops = {f"{n:x}" for n in numbers} | {f"0{n:x}" for n in numbers} | {f"x{n:x}" for n in numbers}
    stops |= {f"0{n:o}" for n in numbers}
    kept = ["10000", "x10000", "010000g", "00ff", "html", "0200000", "x", "08000000"]
    words = sorted(stops) + kept
    found = column(spark, words, text.is_number_token(F.col("v")))
    assert all(found[: len(stops)])
    assert not any(found[len(stops) :])


def test_folding_matches_unicode_decomposition(spark):
    values = ["Été ÉCOLE", "straße", "ﬁn ﬃ", "naïve_x1", "日本 go", "", "plain"]
    expected = [
        unicodedata.normalize("NFKD", v.lower()).encode("ascii", "ignore").decode() for v in values
    ]
    assert column(spark, values, text.fold_to_ascii(F.col("v"))) == expected


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.lists(st.sampled_from(["aa", "bb", "cc", "dd"]), max_size=9), min_size=1, max_size=8))
def test_ngrams_and_run_lengths(spark, documents):
    df = spark.createDataFrame(list(enumerate(documents)), "i int, w array<string>")
    df = text.with_ngrams(df, "w", 1, 3, "g")
    df = text.with_run_lengths(df, "g", "runs").orderBy("i")
    for row, words in zip(df.collect(), documents):
        grams = [
            " ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)
        ]
        assert sorted(row["g"]) == sorted(grams)
        assert {r["item"]: r["n"] for r in row["runs"]} == dict(Counter(grams))


def test_ngrams_of_one_long_document_take_linear_time(spark):
    df = spark.range(1).select(F.array_repeat(F.lit("word"), 200_000).alias("w"))
    df = text.with_ngrams(df, "w", 2, 3, "g")
    counted = text.explode_values(df, "g", "term", []).groupBy("term").count().collect()
    assert {r["term"]: r["count"] for r in counted} == {"word word": 199_999, "word word word": 199_998}


def test_simple_words_length_and_underscore(spark):
    found = column(spark, ["A bc _de f9g Ünder abcdefghijklmnop"], text.simple_words(F.col("v")))
    assert found == [["bc", "ünder"]]


def test_lossy_decoding_drops_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "c binary")
    assert df.select(text.decode_lossy(F.col("c"))).first()[0] == "ab"


def test_whitespace_tokens(spark):
    assert column(spark, ["  a\tb \n c ", ""], text.whitespace_tokens(F.col("v"))) == [
        ["a", "b", "c"],
        [],
    ]


def test_number_pattern_has_no_group_capture():
    assert re.compile(text.NUMBER_TOKEN).groups == 0
