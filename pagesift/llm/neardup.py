"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. A document's set is the distinct hashes of its word shingles; its sketch is the smallest K of
   them. Documents with equal sets are one node from here on.
2. Inverted lists of the retained values generate overlaps. Two sets of the wanted similarity
   share at least MIN_SHARED of K retained values (for sets of at most K: exactly the share that
   the similarity demands), so one of the first (size - needed + 1) values in order of rarity is
   common to both; only those values make lists. Values that many texts share come last in that
   order and make none.
3. Lists are compared as `linking` says; the union sketch of a pair estimates its similarity and
   drops pairs far below the threshold, the full sets decide the others.
4. Links are merged by distributed stars (see `components`).

With K = 72 and MIN_SHARED = 36 a pair of similarity 0.8 is missed with a probability below 1e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.bytewords import (
    NOT_SPACE,
    mix,
    ngram_hashes,
    prefix_codes,
    slices,
    span_hashes,
    word_bounds,
)
from pagesift.llm.linking import connect, rare_lists
from pagesift.llm.scratch import Scratch

K = 72
MIN_SHARED = 36


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes, below 2^63, of its `words`-word shingles; a shorter
    text has its whole word sequence as one shingle, a text without words nothing."""
    for _, _, data, offsets in slices(texts):
        starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
        hashes = span_hashes(prefix_codes(data), starts, ends)
        grams = ngram_hashes(hashes, words)
        for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
            if high - low >= words:
                own = grams[low : high - words + 1]
            else:
                own = ngram_hashes(hashes[low:high], high - low) if high > low else grams[:0]
            # >> 1: signed longs that sort like the hashes; mixed anew, so that a short text's
            # one shingle does not depend on the shingle size alone
            yield np.unique(mix(own + np.uint64(min(high - low, words))) >> np.uint64(1))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sketcher(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for own in shingle_sets(batch.column(1), words):
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                sketches.append(own[:k].copy())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    _lists(sketches),
                ],
                ["doc_id", "n_shingles", "digest", "sketch"],
            )

    return run


def _set_maker(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, ids = [], batch.column(0)
            done = held = 0
            for own in shingle_sets(batch.column(1), words):
                sets.append(own)
                held += len(own)
                if held >= 500_000:
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(done, len(sets)), _lists(sets)], ["node", "shingles"]
                    )
                    done, held, sets = done + len(sets), 0, []
            yield pa.RecordBatch.from_arrays(
                [ids.slice(done, len(sets)), _lists(sets)], ["node", "shingles"]
            )

    return run


def _needed(size: Column, k: int, min_shared: int, percent: int) -> Column:
    """Retained values that a set of this size shares with any set similar enough. Up to
    percent of k, both sets are retained whole."""
    whole = size * 100 <= k * percent
    return F.when(whole, F.ceil(size * percent / 100).cast("int")).otherwise(F.lit(min_shared))


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    k: int = K,
    min_shared: int = MIN_SHARED,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of `docs` (doc_id, text; others ignored).

    Links: 100 * intersection >= percent * union of the shingle sets. component_id is the smallest
    doc_id reachable. Null and empty texts have no shingles, link with nothing and are kept; rows
    that repeat a doc_id belong to one document; a row with a null doc_id links with nothing, has
    a null component and is kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    sketches = scratch.store(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _sketcher(words, k),
            "doc_id long, n_shingles long, digest binary, sketch array<long>",
        ),
        "sketches",
    )
    linked = sketches.filter("doc_id is not null and n_shingles > 0")
    classes = scratch.store(
        linked.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes"
    )
    # a doc_id with several texts is one node; each of its sets still makes its own lists
    nodes = linked.withColumnRenamed("doc_id", "node").join(
        classes, ["digest", "node"], "left_semi"
    )
    lists = rare_lists(
        nodes.select("node", F.col("n_shingles").alias("n"), F.explode("sketch").alias("key")),
        retained=lambda n: F.least(n, F.lit(k)),
        needed=lambda n: _needed(n, k, min_shared, percent),
        scratch=scratch,
    )
    sets = scratch.store(
        docs.select(F.col("doc_id").cast("long").alias("node"), "text")
        .join(lists.select("node").distinct(), "node", "left_semi")
        .mapInArrow(_set_maker(words), "node long, shingles array<long>"),
        "sets",
    )
    found = connect(lists, sets, lambda pairs: _similar(pairs, sets, k, percent), scratch, percent)
    component = F.coalesce("component", "node", "doc_id")
    result = (
        sketches.select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("digest")).alias(
                "digest"
            ),
        )
        .join(classes, "digest", "left")
        .join(found, "node", "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        )
    )
    result = scratch.store(result, "result")
    scratch.close(result)
    return result


def _similar(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    )
    sketch_a, sketch_b = F.slice("sa", 1, k), F.slice("sb", 1, k)
    union = F.slice(F.sort_array(F.array_union(sketch_a, sketch_b)), 1, k)
    estimate = F.size(F.array_intersect(F.array_intersect(sketch_a, sketch_b), union)) / F.size(
        union
    )
    # six standard deviations of the estimate below the threshold
    floor = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / k) ** 0.5
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        both.filter(estimate >= floor)
        .filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common))
        .select("a", "b", "weight")
    )
