"""Term counts, vocabulary and TF-IDF weights, with the matrix in sparse rows.

Two passes find the vocabulary: counts per hash bucket, then per term of full buckets. The weights
need no shuffle: a document's terms are all in its own row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.text import (
    ascii_words,
    drop_number_tokens,
    explode_values,
    unicode_words,
    with_ngrams,
    with_run_lengths,
)
from pagesift.operators import ngrams
from pagesift.session import materialise
from pagesift.sources.libsvm import feature

MAX_TERMS = 100_000
# Scans of more files count terms with pruning; the buckets bound its first pass.
PRUNE_FILES = 2048
TERM_BUCKETS = 262_144


def with_terms(
    corpus: DataFrame,
    low: int,
    high: int,
    strip_accents: bool = True,
    stop_numbers: bool = True,
    content: str = "content",
    out: str = "terms",
) -> DataFrame:
    """Adds the n-grams of each document, built after number tokens are removed."""
    words = ascii_words(F.col(content)) if strip_accents else unicode_words(F.col(content))
    df = corpus.withColumn("_words", words)
    if stop_numbers:
        df = df.withColumn("_words", drop_number_tokens(F.col("_words")))
    return with_ngrams(df, "_words", low, high, out).drop("_words")


def term_frequency(termed: DataFrame, keep: list[str], terms: str = "terms") -> DataFrame:
    """(keep..., term, tf), counted inside each row."""
    runs = with_run_lengths(termed.select(*keep, terms), terms, "_runs")
    return runs.select(*keep, F.inline_outer("_runs").alias("term", "tf")).filter(
        F.col("term").isNotNull()
    )


def document_frequency(frequencies: DataFrame) -> DataFrame:
    """(term, ctf, df): corpus count and number of documents of every term."""
    return frequencies.groupBy("term").agg(
        F.sum("tf").cast("bigint").alias("ctf"), F.count(F.lit(1)).alias("df")
    )


def _ranked_counts(counted: DataFrame, count: int) -> DataFrame:
    return counted.orderBy(F.desc("ctf"), "term").limit(count)


def _term_counts(grams: DataFrame) -> DataFrame:
    return grams.groupBy("term").agg(F.count(F.lit(1)).alias("ctf"))


def top_terms(
    termed: DataFrame, count: int, terms: str = "terms", prune: bool | None = None
) -> DataFrame:
    """(term, ctf) of the `count` most frequent terms; ties go to the lower term.

    Most n-grams of a large corpus are rare, and counting them all shuffles several times the
    text. With `prune`, by default for scans of many files, terms that cannot be among
    the first `count` are left out before the shuffle; the result is the same.
    """
    if _prunes(termed, prune):
        return _pruned_top_terms(termed, count, terms)
    return _ranked_counts(_term_counts(explode_values(termed, terms, "term", [])), count)


def corpus_top_terms(
    corpus: DataFrame,
    count: int,
    low: int,
    high: int,
    strip_accents: bool = True,
    stop_numbers: bool = True,
    content: str = "content",
) -> DataFrame:
    """`top_terms` of the terms that `with_terms` would add, which are cut and counted in the tasks."""
    cut = ngrams.Cut(low, high, strip_accents, stop_numbers)
    counted = ngrams.frequent_terms(corpus, count, cut, content)
    return _ranked_counts(counted.select("term", "ctf"), count)


def corpus_term_frequency(
    corpus: DataFrame,
    keep: list[str],
    low: int,
    high: int,
    strip_accents: bool = True,
    stop_numbers: bool = True,
    content: str = "content",
) -> DataFrame:
    """`term_frequency` of the terms that `with_terms` would add."""
    cut = ngrams.Cut(low, high, strip_accents, stop_numbers)
    return ngrams.document_terms(corpus, keep, cut, content=content)


def _prunes(termed: DataFrame, prune: bool | None) -> bool:
    return len(termed.inputFiles()) > PRUNE_FILES if prune is None else prune


def _pruned_top_terms(
    termed: DataFrame, count: int, terms: str, fraction: float = 0.001
) -> DataFrame:
    """Exact top terms in two passes, by hash-bucket bounds.

    A small sample only proposes candidates. The first pass counts these exactly and all
    other terms by hash bucket. If there are `count` candidates, no term below their lowest
    count is wanted, and a term's count is at most its bucket's: the second pass counts the
    terms of the buckets that reach this bound.
    """
    sampled = explode_values(termed.sample(fraction, seed=0), terms, "term", [])
    proposed = [row["term"] for row in _ranked_counts(_term_counts(sampled), count).collect()]
    grams = explode_values(termed, terms, "term", [])
    is_candidate = F.col("term").isin(proposed) if proposed else F.lit(False)
    bucket = F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS))
    first = materialise(
        grams.groupBy(
            F.when(~is_candidate, bucket).alias("bucket"),
            F.when(is_candidate, F.col("term")).alias("term"),
        ).agg(F.count(F.lit(1)).alias("ctf"))
    )
    candidates = first.filter(F.col("term").isNotNull()).select("term", "ctf")
    bound = 0
    if len(proposed) == count:
        bound = candidates.agg(F.min("ctf")).first()[0]
    # at most TERM_BUCKETS rows
    reached = first.filter(F.col("term").isNull() & (F.col("ctf") >= bound)).select("bucket")
    others = (
        grams.filter(~is_candidate)
        .withColumn("bucket", bucket)
        .join(F.broadcast(reached), "bucket", "left_semi")
    )
    return _ranked_counts(candidates.unionByName(_term_counts(others)), count)


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary: terms in code-point order with their inverse document frequencies."""

    terms: tuple[str, ...]
    document_frequencies: tuple[int, ...]
    documents: int
    low: int
    high: int
    strip_accents: bool
    stop_numbers: bool

    @property
    def idf(self) -> list[float]:
        return [
            math.log((1 + self.documents) / (1 + df)) + 1.0 for df in self.document_frequencies
        ]

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """(idx, term, df)"""
        rows = [
            (i, t, d) for i, (t, d) in enumerate(zip(self.terms, self.document_frequencies))
        ]
        return spark.createDataFrame(rows, "idx int, term string, df bigint")

    def counts(self, corpus: DataFrame, content: str = "content") -> DataFrame:
        """Adds `term_counts`, a sparse vector of the vocabulary's counts."""
        cut = ngrams.Cut(self.low, self.high, self.strip_accents, self.stop_numbers)
        return _count_vectors(
            ngrams.known_terms(corpus, self.terms, cut, content, "terms"), self.terms
        )

    def transform(self, corpus: DataFrame, content: str = "content") -> DataFrame:
        """Adds `tfidf`, the L2-normalised weights as a sparse vector."""
        return self.weigh(self.counts(corpus, content))

    def weigh(self, counted: DataFrame) -> DataFrame:
        scaled = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="term_counts", outputCol="_scaled"
        ).transform(counted)
        return (
            Normalizer(p=2.0, inputCol="_scaled", outputCol="tfidf")
            .transform(scaled)
            .drop("_scaled", "term_counts")
        )


def _count_vectors(termed: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    model = CountVectorizerModel.from_vocabulary(
        list(terms), inputCol="terms", outputCol="term_counts"
    )
    return model.transform(termed).drop("terms")


def fit_tfidf(
    corpus: DataFrame,
    max_terms: int,
    low: int,
    high: int,
    strip_accents: bool = True,
    stop_numbers: bool = True,
    content: str = "content",
) -> TfidfModel:
    """Chooses the vocabulary and counts its document frequencies.

    Only terms of full hash buckets are counted one by one (see `ngrams.frequent_terms`), and only
    the chosen terms, at most `max_terms`, come to the driver.
    """
    if max_terms > MAX_TERMS:
        raise ValueError(f"at most {MAX_TERMS} terms; fit_tfidf_table takes any number")
    cut = ngrams.Cut(low, high, strip_accents, stop_numbers)
    counted = ngrams.frequent_terms(corpus, max_terms, cut, content)
    chosen = {row["term"]: row["df"] for row in _ranked_counts(counted, max_terms).collect()}
    if not chosen:
        raise ValueError("the corpus has no terms")
    terms = tuple(sorted(chosen))
    frequencies = tuple(chosen[term] for term in terms)
    return TfidfModel(terms, frequencies, corpus.count(), low, high, strip_accents, stop_numbers)


def vector_features(vector: str) -> Column:
    """Features of a sparse vector column."""
    raw = F.unwrap_udt(vector)
    return F.zip_with(raw["indices"], raw["values"], feature)


def rebased(features: Column, base: int) -> Column:
    return F.transform(features, lambda f: feature(f["idx"] + base, f["value"]))


def binarised(features: Column) -> Column:
    return F.transform(features, lambda f: feature(f["idx"], F.when(f["value"] > 0, 1).otherwise(0)))


def selected_columns(features: Column, chosen: list[int]) -> Column:
    """Only the features whose index is in `chosen`."""
    return F.filter(features, lambda f: f["idx"].isin(chosen))


def renumbered(features: Column, ranking: list[int], base: int) -> Column:
    """Selected columns, each numbered by its place in `ranking`."""
    lookup = F.map_from_arrays(
        F.array(*[F.lit(i) for i in ranking]), F.array(*[F.lit(r) for r in range(len(ranking))])
    )
    return F.sort_array(
        F.transform(
            selected_columns(features, ranking),
            lambda f: feature(F.try_element_at(lookup, f["idx"]) + base, f["value"]),
        )
    )
