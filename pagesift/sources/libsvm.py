"""Feature files: `label idx:value idx:value # path`, zero-based, ascending, values above zero.

A feature column is `array<struct<idx:int,value:double>>`, one per sample, so writing needs
no grouping. `to_long` gives one row per feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES_TYPE = "array<struct<idx:int,value:double>>"


def feature(idx: Column, value: Column) -> Column:
    return F.struct(idx.cast("int").alias("idx"), value.cast("double").alias("value"))


def positive_only(features: Column) -> Column:
    return F.filter(features, lambda f: f["value"] > 0)


def ordered(features: Column) -> Column:
    """Ascending by index."""
    return F.sort_array(features)


def to_long(df: DataFrame, keep: list[str], features: str = "features") -> DataFrame:
    """One row per feature: keep..., idx, value."""
    return df.select(*keep, F.inline_outer(features)).filter(F.col("idx").isNotNull())


def _number_text(value: Column, decimals: int) -> Column:
    rounded = F.round(value, decimals)
    return F.when(rounded == F.floor(rounded), rounded.cast("bigint").cast("string")).otherwise(
        F.format_string(f"%.{decimals}f", rounded)
    )


def format_line(
    label: Column, features: Column, comment: Column | None, decimals: int = 12
) -> Column:
    """One feature-file line; the comment part is left out where `comment` is null."""
    pairs = F.transform(
        ordered(F.filter(features, lambda f: F.round(f["value"], decimals) > 0)),
        lambda f: F.concat(f["idx"].cast("string"), F.lit(":"), _number_text(f["value"], decimals)),
    )
    body = F.concat(label.cast("string"), F.lit(" "), F.array_join(F.transform(
        pairs, lambda p: F.concat(p, F.lit(" "))), ""))
    if comment is None:
        return body
    return F.concat(body, F.coalesce(F.concat(F.lit(" # "), comment), F.lit("")))


def parse_line(df: DataFrame, line: str = "value", one_based: bool = False) -> DataFrame:
    """(label, features, comment) of feature-file lines; blank lines are dropped."""
    text = F.col(line)
    data = F.trim(F.substring_index(text, "#", 1))
    parts = F.filter(F.split(data, r"\s+"), lambda p: p != "")
    shift = 1 if one_based else 0
    features = F.transform(
        F.filter(parts, lambda p: F.contains(p, F.lit(":"))),
        lambda p: feature(
            F.substring_index(p, ":", 1).cast("int") - shift,
            F.substring_index(p, ":", -1).cast("double"),
        ),
    )
    comment = F.when(F.contains(text, F.lit("#")), F.trim(F.substring(
        text, F.instr(text, "#") + 1, F.length(text))))
    return df.filter(data != "").select(
        F.get(parts, F.lit(0)).cast("double").cast("int").alias("label"),
        features.alias("features"),
        comment.alias("comment"),
    )


def read_libsvm(spark: SparkSession, path: str, one_based: bool = False) -> DataFrame:
    return parse_line(spark.read.text(path), one_based=one_based)


def write_libsvm(df: DataFrame, path: str, comment: str | None = "path", decimals: int = 12) -> None:
    """Writes (label, features, comment) as text files."""
    remark = F.col(comment) if comment else None
    df.select(
        format_line(F.col("label"), F.col("features"), remark, decimals).alias("value")
    ).write.text(path)


def matrix_lines(
    matrix: DataFrame, comment_non_html: bool = False, decimals: int = 12
) -> DataFrame:
    """(label, line) of a matrix; non-HTML rows carry their path only in the hashing variant."""
    remark = F.col("path")
    if not comment_non_html:
        remark = F.when(F.col("label") == 1, remark)
    return matrix.select(
        F.col("label"), format_line(F.col("label"), F.col("features"), remark, decimals).alias("line")
    )


def dump_matrix_libsvm(
    matrix: DataFrame, path: str, comment_non_html: bool = False, decimals: int = 12
) -> None:
    """Feature files in one folder per class; reading the parent folder gives the total set."""
    matrix_lines(matrix, comment_non_html, decimals).write.partitionBy("label").text(path)
