"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.scalars import stable_fraction
from pagesift.sources.samples import spread

# A keyword dictionary with a repeated entry, and rules with n-gram literals.
KEYWORDS = [
    (0, "html"), (1, "head"), (2, "body"), (3, "div"), (4, "script"), (5, "style"), (6, "var"),
    (7, "function"), (8, "track"), (9, "nav"), (10, "article"), (11, "href"), (12, "dim"),
    (13, "sub"), (14, "html"),
]
RULES = [
    (0, "html"), (4, "script"), (6, "var"),
    (820, "meta charset"), (821, "var t"), (822, "script var"),
]
SINGLE_RULES = [rule for rule in RULES if rule[0] < 820]
NGRAM_RULES = [rule for rule in RULES if rule[0] >= 820]


# texts whose scan may have few splits, and the columns that identify their rows
_SPREAD = {"pages": "page_id", "documents": "doc_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows, _SPREAD[name]) if name in _SPREAD else rows


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, path, content): the pages as they are."""
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("sample_id"), F.col("url").alias("path"), F.col("html").alias("content")
    )


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, path, content) for triage, routing and lookup alone: pages rewritten so that
    every triage code occurs."""
    html = F.col("html")
    pages = (
        table(spark, folder, "pages")
        .withColumn("nodt", F.regexp_replace(html, r"(?is)<!doctype html>", ""))
        .withColumn("sc", F.regexp_extract(html, r"(?s)<script>.*?</script>", 0))
        .withColumn("nos", F.regexp_replace("nodt", r"(?is)<script.*?</script>", ""))
        .withColumn("noh", F.regexp_replace("nos", r"(?is)<head>.*</head>", ""))
    )
    kind = F.col("page_id") % 9
    forms = [
        html,
        F.col("nodt"),
        F.col("nos"),
        F.col("noh"),
        F.regexp_replace("noh", r"(?is)</?body>", ""),
        F.regexp_replace(html, r"(?is)</?html[^>]*>", ""),
        F.col("sc"),
        F.regexp_replace("sc", r"(?is)</?script>", ""),
    ]
    content = F
    for number, form in enumerate(forms):
        content = content.when(kind == number, form)
    content = content.otherwise(F.concat(F.lit('x="'), html))
    return pages.select(
        F.col("page_id").alias("sample_id"), F.col("url").alias("path"), content.alias("content")
    )


def type_table(spark: SparkSession, folder: str) -> DataFrame:
    """(sha1, file_type) with missing, empty, HTML, other and repeated entries."""
    rows = samples(spark, folder)
    digest = F.sha1("content").alias("sha1")
    kind = F.col("sample_id") % 4
    file_type = F.when(kind == 0, "HTML").when(kind == 1, "").otherwise("JavaScript")
    return (
        rows.filter(kind != 3)
        .select(digest, file_type.alias("file_type"))
        .unionByName(
            rows.filter(F.col("sample_id") % 20 == 4).select(digest, F.lit("Text").alias("file_type"))
        )
    )


def hashed_samples(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder).withColumn("sha1", F.sha1("content"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, label, set_name, score) with scores from the hash of the id."""
    documents = table(spark, folder, "documents").select("doc_id", "source")
    digits = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10)
    score = (digits.cast("bigint") % 700 + 300 * F.col("quality")) / F.lit(1000.0)
    return (
        documents.join(table(spark, folder, "labels"), "doc_id")
        .select(
            F.col("doc_id").alias("sample_id"),
            F.col("quality").alias("label"),
            F.col("source").alias("set_name"),
            score.alias("score"),
        )
    )


def encoded(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, content BINARY): five encodings behind different leading bytes."""
    hexed = F.hex(F.regexp_replace("content", r"[^\x00-\x7F]", ""))
    kind, lead = F.col("sample_id") % 5, F.col("sample_id") % 3
    body = (
        F.when(kind == 0, hexed)
        .when(kind == 1, F.regexp_replace(hexed, "(..)", "00$1"))
        .when(kind == 2, F.regexp_replace(hexed, "(..)", "$100"))
        .when(kind == 3, F.regexp_replace(hexed, "(..)", "000000$1"))
        .otherwise(F.regexp_replace(hexed, "(..)", "$1000000"))
    )
    front = F.when(lead == 0, "").when(lead == 1, "0D0A09").otherwise("735C0A")
    return page_texts(spark, folder).select("sample_id", F.unhex(F.concat(front, body)).alias("content"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, label, path, content): pages with label 1 and documents with label 0."""
    pages = page_texts(spark, folder).select("sample_id", F.lit(1).alias("label"), "path", "content")
    documents = table(spark, folder, "documents").select(
        (F.col("doc_id") + 1_000_000_000).alias("sample_id"),
        F.lit(0).alias("label"),
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"),
        F.col("text").alias("content"),
    )
    return pages.unionByName(documents)


def feature_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(line) feature-file lines, some with a remark after the path."""
    number = F.col("sample_id")
    return page_texts(spark, folder).select(
        F.concat(
            (number % 2).cast("string"),
            F.lit(" 0:1 "),
            (number % 5 + 3).cast("string"),
            F.lit(":1  # /data/s/"),
            number.cast("string"),
            F.when(number % 3 == 0, "@scored").otherwise(""),
        ).alias("line")
    )


def labelled_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, path): labelled documents below class folders."""
    root = F.when(F.col("toxic") == 1, "validation/mal_set/malicious-").otherwise(
        "validation/nor_set/normal-"
    )
    return (
        table(spark, folder, "documents")
        .select("doc_id", "source")
        .join(table(spark, folder, "labels"), "doc_id")
        .select(
            F.col("doc_id").alias("sample_id"),
            F.concat(
                root, F.col("source"), F.when(F.col("quality") == 0, "/malicious").otherwise(""),
                F.lit("/"), F.col("doc_id").cast("string"),
            ).alias("path"),
        )
    )


def training_state() -> Column:
    """Labelled or uncertain, half of the samples each, for self-training."""
    return F.when(stable_fraction(F.col("sample_id")) < 5000, "labelled").otherwise("uncertain")
