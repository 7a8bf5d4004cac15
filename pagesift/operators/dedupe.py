"""Semi and anti joins between sample sets and feature files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.scalars import basename, path_from_line
from pagesift.operators.joins import BROADCAST_BYTES, equi_join
from pagesift.session import stored


def _distinct_names(source: DataFrame, path: str) -> DataFrame:
    return source.select(basename(F.col(path)).alias("_name")).distinct()


def dedupe_against(
    target: DataFrame, source: DataFrame, path: str = "path", broadcast_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): target samples whose file name is absent from, or present in, source."""
    named = target.withColumn("_name", basename(F.col(path)))
    names = _distinct_names(source, path).withColumn("_known", F.lit(True))
    # written once, for both outputs
    found = stored(
        equi_join(named, names, "_name", "left", path, broadcast_bytes).drop("_name"), "dedupe"
    )
    kept, removed = found.filter("_known is null"), found.filter("_known")
    return kept.drop("_known"), removed.drop("_known")


def distinct_names(source: DataFrame, path: str = "path") -> DataFrame:
    return _distinct_names(source, path).agg(F.count(F.lit(1)).alias("names"))


def features_for_samples(
    feature_lines: DataFrame, log_lines: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The feature lines whose sample path occurs in the log."""
    listed = log_lines.select(path_from_line(F.col("line")).alias("_path")).distinct()
    keyed = feature_lines.withColumn("_path", path_from_line(F.col("line")))
    return equi_join(keyed, listed, "_path", "left_semi", "line", broadcast_bytes).drop("_path")
