import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pagesift.operators import triage

PIECES = [
    "<!DOCTYPE html>", '"<!doctype html', "<html>", "<HTML lang='x'", "/<html>", "<head>", "</head>",
    "<body class=a>", "</body>", "<script>", "</script>", "<script src", ">", "\n", " ", "text", "<",
]


def by_patterns(content):
    guard = r"(?<!\"|'|/)"
    has = lambda p, f=0: re.search(p, content, re.I | f) is not None
    html = has(guard + "<html.*?>")
    if has(guard + "<!doctype html"):
        return 12 if html else 1
    if html:
        for tag, code in (("script", 22), ("head", 23), ("body", 24)):
            if has(f"<{tag}.*>.*</{tag}>", re.S):
                return code
        return 2
    return 3 if re.match(r"\s*<script.*?>.+</script>", content, re.I | re.S) else 0


def test_cascade_equals_the_patterns_on_random_content(spark):
    dice = random.Random(5)
    contents = ["".join(dice.choices(PIECES, k=dice.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(contents)), "i int, content string")
    coded = triage.with_triage_code(df).select("i", "code").collect()
    found = {r["i"]: r["code"] for r in coded}
    expected = {i: by_patterns(c) for i, c in enumerate(contents)}
    assert found == expected
    assert set(expected.values()) == {12, 1, 22, 23, 24, 2, 3, 0}


def test_null_and_binary_content(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"<html>\xff"))], "i int, content binary")
    assert rows(triage.with_triage_code(df), "i", "code") == [(1, 0), (2, 2)]


def lookup_input(spark):
    open_page = "<html>"
    samples = spark.createDataFrame(
        [(i, open_page, s) for i, s in enumerate(["a", "a", "b", "c", "d", "e", "a"])]
        + [(9, "no tag", "a")],
        "sample_id int, content string, sha1 string",
    )
    types = spark.createDataFrame(
        [("a", "HTML"), ("a", "Text"), ("a", "Text"), ("b", ""), ("c", None), ("d", "PDF")],
        "sha1 string, file_type string",
    )
    return samples, types


EXPECTED = sorted(
    [(i, r) for i in (0, 1, 6) for r in ("html/judge_by_vt", "no_html/judge_by_vt")]
    + [(2, "uncertain/no_type"), (3, "uncertain/no_type"), (4, "no_html/judge_by_vt")]
    + [(5, "uncertain/no_file"), (9, "no_html/no_match_by_re")]
)


def test_lookup_gives_every_distinct_route(spark):
    samples, types = lookup_input(spark)
    routed = triage.triage_routes(samples, types, ["sample_id"])
    assert rows(routed, "sample_id", "route") == EXPECTED


@pytest.mark.parametrize("limit", [0, 1200])
def test_lookup_in_a_type_table_too_large_to_broadcast(spark, limit):
    samples, types = lookup_input(spark)
    others = spark.range(200).select(F.sha1(F.col("id").cast("string")).alias("sha1"), F.lit("HTML").alias("file_type"))
    types = types.unionByName(others)
    routed = triage.triage_routes(samples, types, ["sample_id", "content"], broadcast_bytes=limit)
    assert rows(routed, "sample_id", "route") == EXPECTED


def test_unclosed_tags_take_linear_time(spark):
    df = spark.range(1).select(
        F.col("id").alias("sample_id"),
        F.concat(F.lit("<html>"), F.repeat(F.lit("<script>a"), 200_000)).alias("content"),
    )
    assert triage.with_triage_code(df).first()["code"] == 2


def test_every_code_has_a_route(spark):
    df = spark.createDataFrame([(c,) for c in triage.ROUTES], "code int")
    found = {r["code"]: r["r"] for r in df.select("code", triage.route_of_code(F.col("code")).alias("r")).collect()}
    assert found == triage.ROUTES
