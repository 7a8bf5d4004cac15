"""Hash split per class, train and test sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.scalars import stable_fraction


def split_by_rate(df: DataFrame, rate: float = 0.7, key: str = "sample_id") -> DataFrame:
    """Adds `part`, 'a' for about `rate` of each class; stable under re-partitioning.

    The hash of the key is independent of the class, so one expression splits all classes.
    """
    limit = round(rate * 10_000)
    return df.withColumn("part", F.when(stable_fraction(F.col(key)) < limit, "a").otherwise("b"))


def train_test_sets(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): the a-parts and the b-parts of all classes."""
    rows = parts.drop("part")
    return (
        rows.filter(parts["part"] == "a"),
        rows.filter(parts["part"] == "b"),
    )


def full_refit_set(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test together, for a last fit; metrics on it are in-sample."""
    return train.unionByName(test)
