"""Feature selection by tree-ensemble importance, and the reports made from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.operators.tfidf import TfidfModel


def ordered_rows(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in an order that does not depend on how the input was partitioned.

    Iterative fits run hundreds of short jobs: one partition per core, or the given number
    where those would not fit in memory.
    """
    slots = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, "sample_id").sortWithinPartitions("sample_id")


def prepared(df: DataFrame, features: str, partitions: int | None = None) -> DataFrame:
    """(sample_id, label, features) as training rows."""
    rows = df.select(
        "sample_id", F.col("label").cast("double").alias("label"), F.col(features).alias("features")
    )
    return ordered_rows(rows, partitions)


@dataclass(frozen=True)
class Ranking:
    """Feature indexes by falling importance; ties go to the higher index."""

    order: tuple[int, ...]
    importances: tuple[float, ...]

    def best(self, count: int) -> list[int]:
        return list(self.order[:count])


def select_features(
    matrix: DataFrame,
    vector: str = "tfidf",
    trees: int = 250,
    depth: int = 30,
    seed: int = 0,
    partitions: int | None = None,
) -> Ranking:
    """Gini importance of every column over an ensemble of randomised, fully grown trees (Spark
    allows a depth of 30)."""
    rows = prepared(matrix, vector, partitions).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        forest = RandomForestClassifier(
            numTrees=trees,
            maxDepth=depth,
            featureSubsetStrategy="sqrt",
            bootstrap=False,
            seed=seed,
        ).fit(rows)
    finally:
        rows.unpersist()
    values = tuple(float(v) for v in forest.featureImportances.toArray())
    order = tuple(sorted(range(len(values)), key=lambda i: (-values[i], -i)))
    return Ranking(order, values)


def importance_rank(spark: SparkSession, ranking: Ranking, model: TfidfModel) -> DataFrame:
    """(rank, idx, term, importance), at most the size of the vocabulary."""
    rows = [
        (place, idx, model.terms[idx], ranking.importances[idx])
        for place, idx in enumerate(ranking.order, start=1)
    ]
    return spark.createDataFrame(rows, "rank int, idx int, term string, importance double")


def top_features(ranked: DataFrame, count: int) -> DataFrame:
    return ranked.filter(F.col("rank") <= count)


def importance_report(ranked: DataFrame) -> DataFrame:
    """Report lines `rank.feature idx term (importance)`."""
    line = F.concat(
        F.col("rank").cast("string"),
        F.lit(".feature "),
        F.col("idx").cast("string"),
        F.lit(" "),
        F.col("term"),
        F.lit(" ("),
        F.col("importance").cast("string"),
        F.lit(")"),
    )
    return ranked.select("rank", line.alias("line"))


def generate_rules(ranked: DataFrame, count: int = 100) -> DataFrame:
    """The best terms as rules: zero-based rank as index, vocabulary index kept."""
    return top_features(ranked, count).select(
        (F.col("rank") - 1).alias("idx"),
        F.col("term").alias("keyword"),
        F.lit(True).alias("fullword"),
        F.lit(True).alias("nocase"),
        F.col("idx").alias("vocab_id"),
    )
