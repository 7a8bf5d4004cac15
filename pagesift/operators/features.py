"""Feature sets: merging, vocabulary restriction and the user-level feature jobs."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.encoding import WHITESPACE_STRIP, detect_encoding, narrow_encoding
from pagesift.functions.text import decode_lossy
from pagesift.operators.joins import equi_join
from pagesift.operators.presence import with_rule_presence
from pagesift.operators.selection import Ranking
from pagesift.operators.tfidf import (
    TfidfModel,
    binarised,
    rebased,
    renumbered,
    selected_columns,
    vector_features,
)
from pagesift.sources.keywords import NGRAM_BASE
from pagesift.sources.libsvm import feature


def narrowed_text(samples: DataFrame, content: str = "content") -> DataFrame:
    """Binary content as text: wide encodings narrowed, undecodable bytes dropped."""
    encoding = detect_encoding(F.col(content), WHITESPACE_STRIP)
    return samples.withColumn("_encoding", encoding).withColumn(
        content,
        decode_lossy(narrow_encoding(F.col(content), F.col("_encoding"), WHITESPACE_STRIP)),
    ).drop("_encoding")


def merge_features(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two long feature sets on (sample_id, idx); right values overwrite left ones."""
    both = left.withColumn("_priority", F.lit(0)).unionByName(
        right.withColumn("_priority", F.lit(1))
    )
    return both.groupBy("sample_id", "idx").agg(
        F.max_by("value", "_priority").alias("value")
    )


def merged_in_row(left: Column, right: Column) -> Column:
    """The same for two feature columns of one row: the last entry of each index stays."""

    def tagged(features: Column, priority: int) -> Column:
        return F.transform(
            features,
            lambda f: F.struct(
                f["idx"].alias("idx"), F.lit(priority).alias("priority"), f["value"].alias("value")
            ),
        )

    entries = F.sort_array(F.concat(tagged(left, 0), tagged(right, 1)))
    kept = F.zip_with(
        entries,
        F.slice(entries, 2, F.greatest(F.size(entries), F.lit(1))),
        lambda f, g: F.when(~f["idx"].eqNullSafe(g["idx"]), feature(f["idx"], f["value"])),
    )
    return F.filter(kept, lambda f: f.isNotNull())


def with_feature_vector(
    df: DataFrame, width: int, features: str = "features", out: str = "vector"
) -> DataFrame:
    """Adds features below `width` as an ML vector, stored sparse where that is smaller."""
    zeros = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: feature(i, F.lit(0.0)))
    inside = F.filter(features, lambda f: f["idx"].between(0, width - 1))
    full = F.transform(merged_in_row(zeros, inside), lambda f: f["value"])
    return (
        VectorAssembler(inputCols=["_full"], outputCol=out)
        .transform(df.withColumn("_full", array_to_vector(full)))
        .drop("_full")
    )


def with_indicator_vector(
    df: DataFrame, width: int, features: str = "features", out: str = "vector"
) -> DataFrame:
    """Adds 0/1 features below `width` as a sparse vector."""
    names = F.transform(features, lambda f: f["idx"].cast("string"))
    counter = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(width)], inputCol="_names", outputCol=out
    ).setBinary(True)
    return counter.transform(df.withColumn("_names", names)).drop("_names")


def restrict_to_vocabulary(frequencies: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Long term counts of the vocabulary's terms, which may be any number: the vocabulary is
    broadcast if its measured size allows it, frequent terms are salted otherwise."""
    terms = vocabulary.select("idx", "term")
    return equi_join(frequencies, terms, "term", "inner", "sample_id").drop("term")


def attach_scores(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores joined by sample id, never by line number; a sample without a score keeps null."""
    return samples.join(scores.select("sample_id", "score"), "sample_id", "left")


def rule_features(samples: DataFrame, rules: list[tuple[int, str]]) -> DataFrame:
    """Rule presence on binary content of any encoding."""
    return with_rule_presence(narrowed_text(samples), rules)


def keyword_tfidf_features(
    corpus: DataFrame,
    rules: list[tuple[int, str]],
    model: TfidfModel,
    ranking: Ranking,
    top: int = 100,
    base: int = NGRAM_BASE,
) -> DataFrame:
    """Rule presence with the best n-grams as 0/1 features above it, all in one row."""
    weighed = model.transform(with_rule_presence(corpus, rules))
    grams = rebased(
        binarised(selected_columns(vector_features("tfidf"), ranking.best(top))), base
    )
    return (
        weighed.withColumn("_grams", grams)
        .withColumn("features", merged_in_row(F.col("features"), F.col("_grams")))
        .drop("tfidf", "_grams")
    )


def tfidf_features(
    corpus: DataFrame, model: TfidfModel, ranking: Ranking, top: int = 300, base: int = 0
) -> DataFrame:
    """The best n-grams with their float weights."""
    chosen = selected_columns(vector_features("tfidf"), ranking.best(top))
    return (
        model.transform(corpus).withColumn("features", rebased(chosen, base)).drop("tfidf")
    )


def tfidf_rank_features(
    corpus: DataFrame, model: TfidfModel, ranking: Ranking, top: int = 100, base: int = 10
) -> DataFrame:
    """The best n-grams as 0/1 features numbered by rank, under the sample's own label."""
    features = renumbered(binarised(vector_features("tfidf")), ranking.best(top), base)
    return model.transform(corpus).withColumn("features", features).drop("tfidf")
