"""Confusion counts, quality metrics and exact AUC, per model or validation set."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.functions.scalars import outcome
from pagesift.session import materialise

def _known_scores(scored: DataFrame) -> DataFrame:
    """A score that is not a number counts as missing."""
    score = F.col("score").cast("double")
    return scored.withColumn("score", F.when(~F.isnan(score), score))


def class_counts(corpus: DataFrame) -> DataFrame:
    return corpus.agg(
        F.count_if(F.col("label") == 1).alias("html"),
        F.count_if(F.col("label") == 0).alias("no_html"),
        F.count(F.lit(1)).alias("total"),
    )


def prior_threshold(corpus: DataFrame) -> DataFrame:
    """The share of HTML samples, used as decision threshold."""
    return corpus.agg(F.avg("label").alias("threshold"))


def confusion(
    scored: DataFrame, by: list[str], threshold: float | Column = 0.5
) -> DataFrame:
    case = outcome(F.col("label"), F.col("score"), threshold)
    counts = [F.count_if(case == name).alias(name) for name in ("tp", "tn", "fp", "fn")]
    return _known_scores(scored).groupBy(*by).agg(*counts)


def _ratio(numerator: Column, denominator: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator), F.lit(0.0))


def rates(confused: DataFrame) -> DataFrame:
    """The confusion counts with the derived rates; undefined F measures are null."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = F.col("precision"), F.col("recall")
    return (
        confused.withColumn("accuracy", F.try_divide((tp + tn).cast("double"), tp + tn + fp + fn))
        .withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("fpr", _ratio(fp, fp + tn))
        .withColumn("fdr", 1 - precision)
        .withColumn("f1", F.try_divide((2 * tp).cast("double"), 2 * tp + fp + fn))
        .withColumn("f2", F.try_divide(5 * precision * recall, 4 * precision + recall))
    )


def _score_table(scored: DataFrame, by: list[str]) -> DataFrame:
    """Positives, negatives and other rows of each distinct score."""
    label = F.col("label")
    return _known_scores(scored).groupBy(*by, "score").agg(
        F.count_if(label == 1).cast("double").alias("pos"),
        F.count_if(label == 0).cast("double").alias("neg"),
        F.count(F.lit(1)).alias("rows"),
    )


def _with_area(table: DataFrame, by: list[str], extra: list[Column], names: list[str]) -> DataFrame:
    """Sums `extra` per group and adds `auc`.

    The negatives below each score are a prefix sum in two levels: inside ranges of the distinct
    scores, then over the ranges of a group, of which there are as many as partitions. The ranges
    are written once, since both levels must see the same. No task sees a whole group's rows.
    """
    known = F.col("score").isNotNull()
    table = table.withColumn("_pos", F.when(known, F.col("pos")).otherwise(0.0)).withColumn(
        "_neg", F.when(known, F.col("neg")).otherwise(0.0)
    )
    table = materialise(
        table.repartitionByRange(*by, "score").withColumn("_range", F.spark_partition_id())
    )
    inside = W.partitionBy(*by, "_range").orderBy("score").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    buckets = (
        table.withColumn("_below", F.sum("_neg").over(inside) - F.col("_neg"))
        .groupBy(*by, "_range")
        .agg(
            F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)).alias("_area"),
            F.sum("_pos").alias("_pos"),
            F.sum("_neg").alias("_neg"),
            *[F.sum(e).alias(n) for e, n in zip(extra, names)],
        )
    )
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    return (
        buckets.withColumn("_offset", F.sum("_neg").over(before) - F.col("_neg"))
        .groupBy(*by)
        .agg(
            *[F.sum(n).cast("bigint").alias(n) for n in names],
            F.try_divide(
                F.sum(F.col("_area") + F.col("_offset") * F.col("_pos")),
                F.sum("_pos") * F.sum("_neg"),
            ).alias("auc"),
        )
    )


def auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve, ties counted half; null where a class is missing."""
    return _with_area(_score_table(scored, by), by, [], [])


def metrics(scored: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Confusion counts, rates and AUC in one pass over the distinct scores."""
    high = F.coalesce(F.col("score") >= F.lit(float(threshold)), F.lit(False))
    low = F.coalesce(F.col("score") < F.lit(float(threshold)), F.lit(False))
    pos, neg = F.col("pos").cast("bigint"), F.col("neg").cast("bigint")
    tp = F.when(high, pos).otherwise(0)
    tn = F.when(low, neg).otherwise(0)
    fp = F.when(high, neg).otherwise(0)
    fn = F.col("rows") - tp - tn - fp
    table = _score_table(scored, by)
    return rates(_with_area(table, by, [tp, tn, fp, fn], ["tp", "tn", "fp", "fn"]))


def misclassified_rows(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """False positives and false negatives, with their `outcome`."""
    return _known_scores(scored).withColumn(
        "outcome", outcome(F.col("label"), F.col("score"), threshold)
    ).filter(F.col("outcome").isin("fp", "fn"))


def union_models(scored: Mapping[str, DataFrame]) -> DataFrame:
    """Scored frames of several models in one, with a `model` column."""
    frames = [df.withColumn("model", F.lit(name)) for name, df in scored.items()]
    total = frames[0]
    for frame in frames[1:]:
        total = total.unionByName(frame)
    return total


def scoring_time(spark: SparkSession, scored: Mapping[str, DataFrame]) -> DataFrame:
    """(model, seconds): wall time of scoring each frame completely."""
    rows = []
    for name, df in scored.items():
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        rows.append((name, time.perf_counter() - start))
    return spark.createDataFrame(rows, "model string, seconds double")
