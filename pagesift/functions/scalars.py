"""Small column expressions: names, labels, decisions and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """The text after the last slash."""
    return F.substring_index(path, "/", -1)


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / len(needle)).cast("int")


def label_from_path(path: Column) -> Column:
    more = occurrences(path, "normal") < occurrences(path, "malicious")
    return F.when(more, 1).otherwise(0)


def path_from_line(line: Column) -> Column:
    """The sample path of a feature or log line: before the first @, after the last #."""
    return F.trim(F.substring_index(F.substring_index(line, "@", 1), "#", -1))


def decide(score: Column, threshold: float | Column = 0.5) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(score >= limit, 1).otherwise(0)


def outcome(label: Column, score: Column, threshold: float | Column = 0.5) -> Column:
    """tp, tn or fp; every other case counts as fn."""
    positive = decide(score, threshold) == 1
    negative = decide(score, threshold) == 0
    return (
        F.when(positive & (label == 1), "tp")
        .when(negative & score.isNotNull() & (label == 0), "tn")
        .when(positive & (label == 0), "fp")
        .otherwise("fn")
    )


def score_bucket(score: Column) -> Column:
    """One of ten half-open bins, the first and last open-ended; literals avoid rounding."""
    chosen = F
    for low in range(9, 0, -1):
        chosen = chosen.when(score >= F.lit(low / 10), F.lit(f"{low}_{low + 1}"))
    return chosen.otherwise(F.lit("0_1"))


def stable_fraction(key: Column) -> Column:
    """0..9999 from the md5 of the key; the same for any partitioning."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 10000
