"""Self-training: confident samples move from the uncertain set into the training set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.scalars import score_bucket
from pagesift.operators.models import score_samples, train
from pagesift.session import materialise


def confident_label(score, high: float = 0.9, low: float = 0.1):
    """1 or 0 for a confident score, else null."""
    return F.when(score >= high, 1).when(score < low, 0)


def self_train_round(
    labelled: DataFrame,
    uncertain: DataFrame,
    model_name: str = "xgboost",
    high: float = 0.9,
    low: float = 0.1,
    max_rounds: int = 3,
    **params,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labelled, uncertain, report) after at most `max_rounds` rounds.

    Each round's scored rows are written to the shared folder: the labelled set is a union of
    written tables and no round repeats an earlier one.
    """
    spark = labelled.sparkSession
    labelled = labelled.select("sample_id", F.col("label").cast("int").alias("label"), "features")
    uncertain = uncertain.select("sample_id", "features")
    report = []
    for number in range(1, max_rounds + 1):
        model = train(labelled, model_name, **params)
        scored = score_samples(model, uncertain.withColumn("_row", F.col("features")),
                               ["sample_id", "_row"])
        decided = materialise(
            scored.select(
                "sample_id",
                F.col("_row").alias("features"),
                confident_label(F.col("score"), high, low).alias("label"),
            )
        )
        counts = decided.agg(
            F.count_if(F.col("label") == 1).alias("one"),
            F.count_if(F.col("label") == 0).alias("zero"),
            F.count_if(F.col("label").isNull()).alias("left"),
        ).first()
        report.append((number, counts["one"], counts["zero"], counts["left"]))
        labelled = labelled.unionByName(
            decided.filter(F.col("label").isNotNull()).select("sample_id", "label", "features")
        )
        uncertain = decided.filter(F.col("label").isNull()).select("sample_id", "features")
        if counts["one"] + counts["zero"] == 0 or counts["left"] == 0:
            break
    return (
        labelled,
        uncertain,
        spark.createDataFrame(
            report, "round int, added_1 bigint, added_0 bigint, left_over bigint"
        ),
    )


def bucketed(scored: DataFrame) -> DataFrame:
    return scored.withColumn("bucket", score_bucket(F.col("score")))
