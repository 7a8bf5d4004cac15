"""Classifiers by name: fitting, scoring, saving and loading."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.operators.selection import prepared

MODEL_NAMES = ("svm", "xgboost", "libsvm", "keras")


def make_classifier(name: str, width: int, seed: int = 0, **params):
    """An unfitted estimator. `svm` and `libsvm` have a linear kernel."""
    if name in ("svm", "libsvm"):
        return LinearSVC(**{"maxIter": 30, "tol": 1e-3, "regParam": 0.01, **params})
    if name == "xgboost":
        return GBTClassifier(**{"maxIter": 20, "maxDepth": 5, "seed": seed, **params})
    if name == "keras":
        return MultilayerPerceptronClassifier(
            **{"layers": [width, 16, 2], "maxIter": 50, "seed": seed, **params}
        )
    raise ValueError(f"unsupported model name {name!r}; known names: {', '.join(MODEL_NAMES)}")


def model_names(listed: str) -> list[str]:
    """The names of a `|`-separated list."""
    names = [n.strip() for n in listed.split("|")]
    unknown = [n for n in names if n not in MODEL_NAMES]
    if unknown:
        raise ValueError(f"unsupported model names: {unknown}")
    return names


def vector_width(df: DataFrame, features: str = "features") -> int:
    first = df.select(F.size(vector_to_array(features)).alias("n")).first()
    if first is None:
        raise ValueError("no rows to take the feature width from")
    return first["n"]


def train(
    df: DataFrame,
    name: str = "xgboost",
    features: str = "features",
    partitions: int | None = None,
    **params,
) -> PipelineModel:
    """Fits the named model on (sample_id, label, features vector)."""
    rows = prepared(df, features, partitions).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = make_classifier(name, vector_width(rows), **params).fit(rows)
    finally:
        rows.unpersist()
    return PipelineModel([fitted])


def score_samples(
    model: Transformer, df: DataFrame, keep: list[str], features: str = "features"
) -> DataFrame:
    """(keep..., score): the probability of class 1, or the logistic of the margin."""
    inputs = df.select(*keep, F.col(features).alias("features"))
    output = model.transform(inputs)
    if "probability" in output.columns:
        score = F.get(vector_to_array("probability"), F.lit(1))
    else:
        score = 1 / (1 + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1))))
    kept = [c for c in keep if c != "features"]
    return output.select(*kept, score.alias("score"))


def train_and_score(
    train_set: DataFrame, test_set: DataFrame, name: str = "xgboost", features: str = "features", **params
) -> tuple[PipelineModel, DataFrame]:
    """A model of the training set, and (sample_id, label, set_name, score) of both sets."""
    model = train(train_set, name, features, **params)
    both = train_set.withColumn("set_name", F.lit("train")).unionByName(
        test_set.withColumn("set_name", F.lit("test"))
    )
    return model, score_samples(model, both, ["sample_id", "label", "set_name"], features)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str | None = None, config: dict | None = None) -> PipelineModel:
    """From an explicit path, or from the configured default folder and name."""
    if path is None:
        if config is None:
            raise ValueError("give a path or a configuration")
        path = "/".join(
            [config["filesystem"]["mid_folder"].rstrip("/"), config["model"]["xgboost"]["model_name"]]
        )
    return PipelineModel.load(path)
