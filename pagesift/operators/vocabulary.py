"""TF-IDF with a vocabulary of any size, kept as a table.

`TfidfModel` holds its terms in the driver and in every task. Here terms are ranked and numbered by
range partitions, and a document's terms meet the vocabulary in a join, whose hot terms are
salted; only a document's own entries are gathered again.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.operators import ngrams
from pagesift.operators.joins import BROADCAST_BYTES, SALT_ROWS, equi_join
from pagesift.operators.topics import dense_numbers
from pagesift.session import stored
from pagesift.sources.libsvm import FEATURES_TYPE, feature


@dataclass(frozen=True)
class TfidfTable:
    """A fitted vocabulary (idx, term, df) as a written table, numbered in code-point order."""

    vocabulary: DataFrame
    documents: int
    low: int
    high: int
    strip_accents: bool
    stop_numbers: bool

    def _buckets(self, bits: int) -> bytes:
        """The hash buckets that hold a term of the vocabulary, as a bitmap."""

        @F.arrow_udf("long")
        def bucket(terms: pa.Array) -> pa.Array:
            return pa.array(ngrams.buckets(ngrams.term_hashes(terms.to_pylist()), bits))

        return ngrams.bitmap(self.vocabulary.select(bucket("term").alias("bucket")), bits)

    def transform(
        self,
        corpus: DataFrame,
        content: str = "content",
        out: str = "features",
        broadcast_bytes: int = BROADCAST_BYTES,
        hot_rows: int = SALT_ROWS,
    ) -> DataFrame:
        """Adds the L2-normalised weights as features, ascending by index. `sample_id` identifies rows."""
        cut = ngrams.Cut(self.low, self.high, self.strip_accents, self.stop_numbers)
        bits = ngrams.MAX_BITS
        # few other terms share a bucket with the vocabulary's, and the join drops them
        counts = ngrams.document_terms(
            corpus, ["sample_id"], cut, bits, self._buckets(bits), content
        )
        known = equi_join(
            counts, self.vocabulary, "term", "inner", "sample_id", broadcast_bytes, hot_rows
        )
        idf = F.log((1 + F.lit(self.documents)) / (1 + F.col("df"))) + 1
        rows = known.groupBy("sample_id").agg(
            F.sort_array(F.collect_list(feature(F.col("idx"), F.col("tf") * idf))).alias("_raw")
        )
        squares = F.aggregate("_raw", F.lit(0.0), lambda total, f: total + f["value"] * f["value"])
        # repeated per entry, so that the length is computed once and not inside the lambda
        lengths = F.array_repeat(F.sqrt(squares), F.size("_raw"))
        weighed = rows.select(
            "sample_id",
            F.zip_with("_raw", lengths, lambda f, n: feature(f["idx"], f["value"] / n)).alias(out),
        )
        empty = F.array().cast(FEATURES_TYPE)
        return corpus.join(weighed, "sample_id", "left").withColumn(out, F.coalesce(out, empty))


def fit_tfidf_table(
    corpus: DataFrame,
    max_terms: int,
    low: int,
    high: int,
    strip_accents: bool = True,
    stop_numbers: bool = True,
    content: str = "content",
) -> TfidfTable:
    """The `max_terms` terms of the highest corpus counts, ties to the lower term; all if fewer."""
    cut = ngrams.Cut(low, high, strip_accents, stop_numbers)
    counted = ngrams.frequent_terms(corpus, max_terms, cut, content)
    ranked = dense_numbers(
        counted.select("term", "df", (-F.col("ctf")).alias("falling")), ["falling", "term"], "rank"
    )
    chosen = dense_numbers(
        ranked.filter(F.col("rank") < max_terms).select("term", "df"), ["term"], "number"
    )
    vocabulary = chosen.select(F.col("number").cast("int").alias("idx"), "term", "df")
    return TfidfTable(
        stored(vocabulary, "vocabulary"), corpus.count(), low, high, strip_accents, stop_numbers
    )
