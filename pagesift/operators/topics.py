"""Token dictionaries, bags of words and topic models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.functions.text import explode_values, whitespace_tokens, with_run_lengths
from pagesift.operators.joins import equi_join
from pagesift.operators.selection import ordered_rows
from pagesift.session import materialise, stored

# monotonically_increasing_id puts the partition number above this bit
_ROW_BITS = 33
#: documents of a block of a factorisation
BLOCK_ROWS = 1000
#: keeps quotients of a factorisation finite
FLOOR = 1e-12
_ENTRY = "struct<idx:int,value:double>"
_BLOCK = ["ids", "lengths", "idx", "value", "w"]


def dense_numbers(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds 0..n-1 in `order`, whose columns identify a row.

    Rows are range-partitioned and sorted in place; only the partition sizes are summed up in
    one task. The numbered rows are written once, since both steps must see the same ranges.
    """
    placed = materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_range", F.shiftright("_place", _ROW_BITS))
    # one row per partition
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = sizes.select("_range", (F.sum("_rows").over(before) - F.col("_rows")).alias("_start"))
    within = F.col("_place") - F.shiftleft("_range", _ROW_BITS)
    return (
        placed.join(F.broadcast(starts), "_range")
        .withColumn(out, F.col("_start") + within)
        .drop("_place", "_range", "_start")
    )


def build_dictionary(corpus: DataFrame, content: str = "content") -> DataFrame:
    """(token, id): ids by the first document of a token, then by token."""
    tokens = corpus.select(
        "sample_id", F.array_distinct(whitespace_tokens(F.col(content))).alias("tokens")
    )
    first = (
        explode_values(tokens, "tokens", "token", ["sample_id"])
        .groupBy("token")
        .agg(F.min("sample_id").alias("first"))
    )
    return dense_numbers(first, ["first", "token"], "id").select("token", "id")


def doc_bow(documents: DataFrame, dictionary: DataFrame, content: str = "content") -> DataFrame:
    """(sample_id, id, n) of the lower-cased documents; unknown tokens are dropped.

    Tokens are counted inside each row, so each document has one row per distinct token.
    """
    tokens = documents.select(
        "sample_id", whitespace_tokens(F.lower(content)).alias("tokens")
    )
    runs = with_run_lengths(tokens, "tokens", "runs").select(
        "sample_id", F.inline_outer("runs").alias("token", "n")
    )
    known = runs.filter(F.col("token").isNotNull())
    return equi_join(known, dictionary, "token", "inner", "sample_id").select(
        "sample_id", "id", "n"
    )


def fit_lda(matrix: DataFrame, topics: int = 2, rounds: int = 5, vector: str = "tfidf") -> LDAModel:
    rows = ordered_rows(
        matrix.select("sample_id", F.col(vector).alias("features"))
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # every round passes over all documents
        return LDA(
            k=topics,
            maxIter=rounds,
            optimizer="online",
            learningOffset=50.0,
            subsamplingRate=1.0,
            seed=0,
        ).fit(rows)
    finally:
        rows.unpersist()


def _named(spark: SparkSession, rows: list[tuple], terms: tuple[str, ...]) -> DataFrame:
    named = [(topic, rank, terms[idx], weight) for topic, rank, idx, weight in rows]
    return spark.createDataFrame(named, "topic int, rank int, term string, weight double")


def lda_topics(spark: SparkSession, model: LDAModel, terms: tuple[str, ...], count: int = 100) -> DataFrame:
    """(topic, rank, term, weight) of the heaviest terms of each topic."""
    described = model.describeTopics(min(count, len(terms))).collect()
    rows = [
        (row["topic"], rank, idx, float(weight))
        for row in described
        for rank, (idx, weight) in enumerate(zip(row["termIndices"], row["termWeights"]), start=1)
    ]
    return _named(spark, rows, terms)


@dataclass
class Factorisation:
    """W as (sample_id, w0, w1, ...), H as one bounded row per component, loss per round."""

    weights: DataFrame
    components: list[list[float]]
    losses: list[float]


def _start(component: int, idx: int) -> float:
    return 0.1 + ((idx * 7919 + component * 104_729) % 1009) / 1009


def _one(values) -> pa.Array:
    """A list column of one row."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packer(width: int):
    """Rows of (sample_id, features, w) as blocks of at most BLOCK_ROWS documents.

    A document without features, or with one that is null or not below `width`, has no weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                ids, features, weights = batch.slice(low, BLOCK_ROWS).columns
                lengths = features.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                idx, value = features.flatten().flatten()
                known = idx.is_valid().to_numpy(False) & value.is_valid().to_numpy(False)
                idx = idx.fill_null(-1).to_numpy(zero_copy_only=False)
                value = value.fill_null(0.0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lengths)), lengths)
                whole = features.is_valid().to_numpy(False).copy()
                whole[row[~(known & (idx >= 0) & (idx < width))]] = False
                w = weights.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), -1).copy()
                w[~whole] = np.nan
                kept = whole[row]
                columns = [ids, np.where(whole, lengths, 0).astype(np.int32), idx[kept], value[kept], w.ravel()]
                yield pa.RecordBatch.from_arrays(list(map(_one, columns)), _BLOCK)

    return run


def _updater(shared: Broadcast, l1: float, l2: float):
    """A round over blocks: the weights are updated, and the sums for H and the loss are taken with them.

    Sums are listed by feature; those of feature -1 are the sums of the weights, with the block's loss.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        scale = h.sum(axis=1) + l1 + FLOOR
        for batch in batches:
            for n in range(batch.num_rows):
                packed = [batch.column(name)[n].values for name in _BLOCK]
                lengths, idx, value, w = (c.to_numpy(zero_copy_only=False) for c in packed[1:])
                w = w.reshape(len(lengths), len(h))
                row = np.repeat(np.arange(len(lengths)), lengths)
                own = h[:, idx]

                def ratios(w: np.ndarray) -> np.ndarray:
                    return value / (FLOOR + sum(w[row, k] * own[k] for k in range(len(h))))

                ratio = ratios(w)
                gain = [np.bincount(row, ratio * part, len(lengths)) for part in own]
                w = w * np.stack(gain, axis=1) / (scale + l2 * w)
                ratio = ratios(w)
                found, place = np.unique(idx, return_inverse=True)
                sums = [
                    np.append(np.bincount(place, ratio * w[row, k], len(found)), np.nansum(w[:, k]))
                    for k in range(len(h))
                ]
                # a ratio without a logarithm is left out
                logs = np.log(ratio, where=ratio > 0, out=np.ones(len(ratio)))
                loss = np.zeros(len(found) + 1)
                loss[-1] = np.where(ratio > 0, value * logs - value, 0.0).sum()
                listed = [np.append(found, -1).astype(np.int32), *sums, loss]
                yield pa.RecordBatch.from_arrays(
                    [*map(_one, [*packed[:4], w.ravel()]), *map(_one, listed)],
                    [*_BLOCK, "sum_idx", *[f"sum{k}" for k in range(len(h))], "loss"],
                )

    return run


def _unpacker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sample_id, w) of blocks; null in place of a document's missing weights."""
    for batch in batches:
        for n in range(batch.num_rows):
            ids, w = (batch.column(name)[n].values for name in ("ids", "w"))
            components = len(w) // len(ids)
            offsets = pa.array(np.arange(0, len(w) + 1, components), pa.int32())
            values = pa.array(w.to_numpy(zero_copy_only=False), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.ListArray.from_arrays(offsets, values)], ["sample_id", "w"]
            )


def fit_nmf(
    features: DataFrame,
    width: int,
    components: int = 2,
    rounds: int = 1000,
    alpha: float = 0.1,
    l1_ratio: float = 0.5,
    tolerance: float = 1e-4,
    checkpoint_every: int = 5,
) -> Factorisation:
    """Factors the long matrix of (sample_id, features) under the generalised KL divergence.

    H has components x width numbers and is broadcast each round. Documents are packed into blocks
    once; a round is one pass over the blocks, in tasks, which updates their weights, and one
    aggregate with at most `width` groups, which updates H.
    """
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    names = [f"w{k}" for k in range(components)]
    h = np.array([[_start(k, j) for j in range(width)] for k in range(components)])
    begin = F.array(
        *[(F.pmod(F.xxhash64("sample_id", F.lit(k)), F.lit(1000)) + 1) / 1000 for k in range(components)]
    )
    kind = features.schema["sample_id"].dataType.simpleString()
    shape = f"ids array<{kind}>, lengths array<int>, idx array<int>, value array<double>, w array<double>"
    blocks = features.select(
        "sample_id", F.col("features").cast(f"array<{_ENTRY}>"), begin.alias("w")
    ).mapInArrow(_packer(width), shape)
    held = blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    summed = [f"sum{k}" for k in range(components)]
    listed = "".join(f", {name} array<double>" for name in [*summed, "loss"])
    losses: list[float] = []
    for number in range(1, rounds + 1):
        shared = features.sparkSession.sparkContext.broadcast(h)
        updated = blocks.mapInArrow(_updater(shared, l1, l2), f"{shape}, sum_idx array<int>{listed}")
        if number % checkpoint_every == 0:
            updated = materialise(updated)
        else:
            updated = updated.persist(StorageLevel.MEMORY_AND_DISK)
        sums = (
            updated.select(F.inline(F.arrays_zip("sum_idx", *summed, "loss")))
            .groupBy("sum_idx")
            .agg(*[F.sum(name).alias(name) for name in [*summed, "loss"]])
            .toArrow()
        )
        idx = sums["sum_idx"].to_numpy()
        inside = idx >= 0
        gains, totals = np.zeros(h.shape), np.zeros(components)
        for k, name in enumerate(summed):
            values = sums[name].to_numpy()
            gains[k, idx[inside]] = values[inside]
            totals[k] = values[~inside].sum()
        losses.append(float(sums["loss"].to_numpy().sum() + totals @ h.sum(axis=1)))
        h = h * gains / (totals[:, None] + l1 + l2 * h + FLOOR)
        held.unpersist()
        held, blocks = updated, updated.select(*_BLOCK)
        if len(losses) > 1 and losses[-2] - losses[-1] < tolerance * abs(losses[0]):
            break
    unpacked = blocks.mapInArrow(_unpacker, f"sample_id {kind}, w array<double>")
    weights = stored(
        unpacked.select("sample_id", *[F.get("w", F.lit(k)).alias(n) for k, n in enumerate(names)]),
        "weights",
    )
    held.unpersist()
    return Factorisation(weights, h.tolist(), losses)


def nmf_topics(
    spark: SparkSession, fitted: Factorisation, terms: tuple[str, ...], count: int = 100
) -> DataFrame:
    """(topic, rank, term, weight) of the heaviest terms of each component."""
    rows = []
    for topic, weights in enumerate(fitted.components):
        order = sorted(range(len(weights)), key=lambda j: (-weights[j], j))[:count]
        rows += [(topic, rank, j, weights[j]) for rank, j in enumerate(order, start=1)]
    return _named(spark, rows, terms)
