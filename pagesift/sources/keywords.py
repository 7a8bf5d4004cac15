"""Keyword lists and keyword rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: n-gram features start here, so keyword indexes stay below it.
NGRAM_BASE = 820


def first_occurrences(lines: DataFrame, position: str = "position", line: str = "line") -> DataFrame:
    """(idx, keyword) of the trimmed lines; a repeated keyword keeps its first position."""
    return (
        lines.select(F.col(position).alias("idx"), F.trim(F.col(line)).alias("keyword"))
        .filter(F.col("keyword") != "")
        .groupBy("keyword")
        .agg(F.min("idx").alias("idx"))
        .select("idx", "keyword")
    )


def load_keywords(spark: SparkSession, path: str) -> DataFrame:
    """A keyword file, one keyword per line; the line number is the feature index."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("position", "line"))
    return first_occurrences(lines)


def load_keyword_rules(spark: SparkSession, path: str) -> DataFrame:
    """(idx, keyword, fullword, nocase) rules written as a parquet table."""
    return spark.read.parquet(path).select("idx", "keyword", "fullword", "nocase")


def as_rules(keywords: DataFrame) -> DataFrame:
    """Keywords as bounded, case-insensitive rules."""
    return keywords.select(
        F.col("idx").cast("int").alias("idx"),
        "keyword",
        F.lit(True).alias("fullword"),
        F.lit(True).alias("nocase"),
    )


def merge_rule_sets(single: DataFrame, ngram: DataFrame, base: int = NGRAM_BASE) -> DataFrame:
    """Keyword rules and n-gram rules in one set; n-gram indexes are shifted by `base`.

    A keyword index of `base` or above would meet an n-gram's and is refused when rows are read.
    """
    refused = F.raise_error(F.concat(F.lit("keyword index not below the n-gram base: "), F.col("idx")))
    own = F.when(F.col("idx") < base, F.col("idx")).otherwise(refused).cast("int")
    return single.withColumn("idx", own).unionByName(ngram.withColumn("idx", (F.col("idx") + base).cast("int")))
