"""Partitioned and text sinks. Every writer keeps its input's partitioning: no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.sources.samples import open_store

# Bounds the size of one output file; a route holding most rows is many files, not one.
MAX_RECORDS_PER_FILE = 1_000_000


def write_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    (
        df.write.partitionBy(*columns)
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .parquet(path)
    )


def route_samples(routed: DataFrame, path: str) -> None:
    """Samples in one folder per triage route."""
    write_partitioned(routed, path, "route")


def write_sample_files(samples: DataFrame, path: str) -> None:
    """One file per sample (name, content), in subfolders by the first two characters of the name.

    A repeated task writes the same files again. Null contents become empty files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base, _ = open_store(path)
        for batch in batches:
            for name, content in zip(*(column.to_pylist() for column in batch.columns)):
                folder = f"{base}/{name[:2]}"
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["files"])

    written = samples.select("name", F.col("content").cast("binary").alias("content"))
    written.mapInArrow(run, "files long").agg(F.sum("files")).collect()


def route_by_score(scored: DataFrame, path: str) -> None:
    """Samples in one folder per score bucket."""
    write_partitioned(scored, path, "bucket")


def write_misclassified(rows: DataFrame, path: str) -> None:
    """False positives and false negatives in one folder per model and outcome."""
    write_partitioned(rows, path, "model", "outcome")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def dense_rows(
    matrix: DataFrame, vector: str, keep: list[str], columns: list[int] | None = None
) -> DataFrame:
    """(keep..., row): a vector column of bounded width as array<double>, optionally some columns."""
    if columns is not None:
        matrix = VectorSlicer(indices=columns, inputCol=vector, outputCol="_chosen").transform(matrix)
        vector = "_chosen"
    return matrix.select(*keep, vector_to_array(vector).alias("row"))
