"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.alignment import aligned
from pagesift.llm.decontamination import CONTAMINATION_SQL, contamination, digest
from pagesift.llm.fingerprints import fingerprints
from pagesift.llm.html_extraction import extract
from pagesift.llm.languages import predicted_languages
from pagesift.llm.line_dedup import line_components
from pagesift.llm.mixing import MIXTURE_SQL, mixture
from pagesift.llm.neardup import near_duplicates
from pagesift.llm.negatives import NEGATIVES_SQL, hard_negatives
from pagesift.llm.neighbours import nearest_neighbours
from pagesift.llm.scratch import table
from pagesift.llm.suffix_dedup import repeated_spans
from pagesift.llm.surrogates import with_surrogates
from pagesift.llm.toxicity import toxicity_scores


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document with the first line of its component."""
    return line_components(table(spark, folder, "documents")).drop("text_hash")


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, folder, "pages"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    return predicted_languages(table(spark, folder, "documents"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixture(table(spark, folder, "documents"))


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated strings of 400 bytes in every document."""
    return repeated_spans(table(spark, folder, "documents")).drop("spans")


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    return digest(
        contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    )


def op7_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    return with_surrogates(table(spark, folder, "documents")).drop("entities")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents on 4-word shingles."""
    return near_duplicates(table(spark, folder, "documents"), words=4)


def op10_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Ten nearest vectors of every hundredth vector."""
    return nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document."""
    return aligned(table(spark, folder, "documents"))[0]


def op12_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and how alike they are."""
    return fingerprints(table(spark, folder, "documents"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector and its best positives."""
    return hard_negatives(
        table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, F.col("vec_id") % 7 == 0
    )


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_language_id": op3_language_id,
    "op4_mixing": op4_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_surrogates": op7_surrogates,
    "op8_toxicity": op8_toxicity,
    "op9_minhash_neardup": op9_minhash_neardup,
    "op10_neighbours": op10_neighbours,
    "op11_alignment": op11_alignment,
    "op12_fingerprints": op12_fingerprints,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op4_mixing": MIXTURE_SQL,
    "op6_decontamination": CONTAMINATION_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
