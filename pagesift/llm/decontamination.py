"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are the sets to be contained in a document. Containment needs every word of a
window, so of its words in order of rarity the first alone is its necessary prefix. Rarity is
counted over all documents. A document word that is the prefix of a window makes a candidate at
the one place where the window would have to lie; place and length bound it to the document, and
the window's other words, rarest first, are compared there: exact containment, in the order of
the item.

The windows travel to the tasks in blocks of at most BLOCK_WORDS item words: a larger benchmark
takes more blocks, each against all documents, so memory does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.bytewords import (
    ALPHANUMERIC,
    prefix_codes,
    slices,
    span_hashes,
    word_bounds,
)

WINDOW = 10
BLOCK_WORDS = 500_000
#: candidates compared at a time
_CHUNK = 1_000_000


class Windows(NamedTuple):
    """Windows of one block. Window w has length[w] words from begin[w] in `words`; order[w] lists
    its places, rarest word first."""

    words: np.ndarray
    item: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    order: np.ndarray
    anchors: np.ndarray
    anchor_first: np.ndarray
    by_anchor: np.ndarray
    items: list[str]


def _hashed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, index of each row's first word and the end) per slice."""
    for low, _, data, offsets in slices(texts):
        starts, ends, first = word_bounds(data, offsets, ALPHANUMERIC)
        yield low, span_hashes(prefix_codes(data), starts, ends), first


def _counter(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        counts = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for _, words, _ in _hashed(batch.column(0)):
                counts += np.bincount(_find(known, words), minlength=len(counts))
        used = np.flatnonzero(counts[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["word", "n"]
        )

    return run


def _find(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of each word in the sorted `known`; len(known) if it is not there."""
    place = np.searchsorted(known, words)
    absent = known[np.minimum(place, len(known) - 1)] != words
    place[absent] = len(known)
    return place


def _windows(ids: list[str], texts: list[str | None], window: int, count) -> Windows | None:
    """`count` gives the occurrences of each word of a sorted vocabulary in all documents."""
    words, firsts = [], [np.zeros(1, np.int64)]
    total = 0
    for _, hashes, first in _hashed(pa.array(texts, pa.large_string())):
        words.append(hashes)
        firsts.append(first[1:] + total)
        total += len(hashes)
    if not total:
        return None
    words, first = np.concatenate(words), np.concatenate(firsts)
    sizes = np.diff(first)
    per_item = np.where(sizes >= window, sizes - window + 1, np.minimum(sizes, 1))
    item = np.repeat(np.arange(len(ids)), per_item)
    within = np.arange(len(item)) - np.repeat(np.cumsum(per_item) - per_item, per_item)
    begin = first[item] + within
    length = np.minimum(sizes[item], window)
    vocabulary = np.unique(words)
    rarity = count(vocabulary)[np.searchsorted(vocabulary, words)]
    places = np.arange(window)
    inside = places < length[:, None]
    of_window = np.minimum(begin[:, None] + places, len(words) - 1)
    order = np.argsort(np.where(inside, rarity[of_window], np.iinfo(np.int64).max), 1, kind="stable")
    anchor = words[begin + order[:, 0]]
    by_anchor = np.argsort(anchor, kind="stable")
    anchors, anchor_first = np.unique(anchor[by_anchor], return_index=True)
    return Windows(
        words, item, begin, length, order, anchors,
        np.append(anchor_first, len(anchor)), by_anchor, ids,
    )


def find_windows(
    own: Windows, words: np.ndarray, first: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(start word, window) of every occurrence of a window inside one of the texts."""
    anchor = _find(own.anchors, words)
    places = np.flatnonzero(anchor < len(own.anchors))
    anchor = anchor[places]
    fan = np.diff(own.anchor_first)[anchor]
    steps = np.concatenate([[0], np.cumsum(fan)])
    starts, found = [], []
    low = 0
    while low < len(places):
        high = max(low + 1, int(np.searchsorted(steps, steps[low] + _CHUNK, "right")) - 1)
        count = fan[low:high]
        place = np.repeat(places[low:high], count)
        nth = np.arange(steps[high] - steps[low]) - np.repeat(steps[low:high] - steps[low], count)
        window = own.by_anchor[np.repeat(own.anchor_first[anchor[low:high]], count) + nth]
        start = place - own.order[window, 0]
        text = np.searchsorted(first, place, "right") - 1
        fits = (start >= first[text]) & (start + own.length[window] <= first[text + 1])
        start, window = start[fits], window[fits]
        for step in range(1, own.order.shape[1]):
            at = own.order[window, step]
            # a shorter window has no word there
            over = at >= own.length[window]
            at = np.where(over, 0, at)
            same = over | (words[start + at] == own.words[own.begin[window] + at])
            start, window = start[same], window[same]
        starts.append(start)
        found.append(window)
        low = high
    none = np.zeros(0, np.int64)
    return np.concatenate(starts or [none]), np.concatenate(found or [none])


_HITS = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _hit_finder(shared, every_row: bool):
    """Word spans hit, merged, and the items; without `every_row` only of rows with hits."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def rows(words, first, own):
        count = len(first) - 1
        spans: list[list] = [[] for _ in range(count)]
        items: list[list] = [[] for _ in range(count)]
        start, window = find_windows(own, words, first) if own else ([], [])
        if len(start):
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, start, 1)
            np.add.at(edges, start + own.length[window], -1)
            hit = np.concatenate([[False], np.cumsum(edges[:-1]) > 0])
            text = np.searchsorted(first, start, "right") - 1
            pairs = np.unique(np.stack([text, own.item[window]], 1), axis=0)
            for t, i in pairs.tolist():
                items[t].append(own.items[i])
            for t in np.unique(text).tolist():
                part = np.concatenate([[False], hit[first[t] + 1 : first[t + 1] + 1], [False]])
                bounds = np.flatnonzero(part[1:] != part[:-1]).tolist()
                spans[t] = [{"start": a, "end": b} for a, b in zip(bounds[::2], bounds[1::2])]
                items[t] = sorted(set(items[t]))
        return np.diff(first).tolist(), spans, items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            sizes, spans, items = [], [], []
            for _, words, first in _hashed(batch.column(1)):
                for into, more in zip((sizes, spans, items), rows(words, first, own)):
                    into += more
            table = pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(sizes, pa.int64()),
                    pa.array(spans, pa.list_(span)),
                    pa.array(items, pa.list_(pa.string())),
                ],
                ["doc_id", "text_hash", "n_words", "spans", "items"],
            )
            if not every_row:
                table = table.filter(pa.array([bool(x) for x in items]))
            yield table

    return run


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, n_words, spans, items) per row of `docs` (doc_id, text), for `items` (item_id, text).

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A window
    is `window` consecutive words of an item; an item of fewer, but not none, is one window. Spans
    are the maximal runs of document words, by number from 0, inside any occurrence of a window;
    items are the ids of the windows that occur, as strings, sorted. Null texts and items without
    words hit nothing; a null item_id is the empty string; items that repeat an id are one item.
    """
    spark = docs.sparkSession
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text")
    size = named.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * block_words)))
    texts = docs.select("text")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def counted(vocabulary: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(vocabulary)
        counts = np.zeros(len(vocabulary), np.int64)
        found = texts.mapInArrow(_counter(shared), "word long, n long").groupBy("word")
        for row in found.agg(F.sum("n").alias("n")).collect():
            counts[row["word"]] = row["n"]
        return counts

    parts = []
    for block in range(blocks):
        # a block of bounded size
        chosen = (
            named.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
            .orderBy("id", "text")
            .collect()
        )
        own = _windows([r["id"] for r in chosen], [r["text"] for r in chosen], window, counted)
        finder = _hit_finder(spark.sparkContext.broadcast(own), every_row=block == 0)
        kind = docs.schema["doc_id"].dataType.simpleString()
        parts.append(rows.mapInArrow(finder, f"doc_id {kind}, text_hash long, {_HITS}"))
    if blocks == 1:
        return parts[0].drop("text_hash")
    first, *others = parts
    more = others[0]
    for part in others[1:]:
        more = more.unionByName(part)
    # rows that repeat a document repeat its hits
    more = (
        more.groupBy("doc_id", "text_hash", "n_words")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("spans"))).alias("more_spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("more_items"),
        )
        .select(
            F.col("doc_id").alias("more_id"), F.col("text_hash").alias("more_hash"),
            "more_spans", "more_items",
        )
    )
    all_spans = F.array_sort(F.concat("spans", F.coalesce("more_spans", F.array().cast("array<struct<start:long,end:long>>"))))
    return first.join(
        more,
        F.col("doc_id").eqNullSafe(F.col("more_id")) & F.col("text_hash").eqNullSafe(F.col("more_hash")),
        "left",
    ).select(
        "doc_id",
        "n_words",
        _merged(all_spans).alias("spans"),
        F.array_sort(
            F.array_union("items", F.coalesce("more_items", F.array().cast("array<string>")))
        ).alias("items"),
    )


def _merged(spans):
    """Sorted spans with overlapping and adjacent ones joined."""

    def step(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end")
        )
        return F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)),
        ).otherwise(F.concat(done, F.array(span)))

    empty = F.array().cast("array<struct<start:long,end:long>>")
    return F.aggregate(spans, empty, step)


def digest(hits: DataFrame) -> DataFrame:
    """Counts and the digest of the item ids of `contamination`'s rows."""
    n_hit = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"]
    )
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


#: DuckDB
CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[p : p + 9], ' ') AS words, least(len(w), 10) AS size
  FROM i, range(1, greatest(len(w) - 9, least(len(w), 1)) + 1) t(p)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT r, p, size, array_to_string(w[p : p + size - 1], ' ') AS words
  FROM d, sizes, range(1, len(w) - size + 2) t(p)),
hits AS (SELECT g.r, g.p, g.size, x.item_id FROM grams g JOIN windows x USING (words, size)),
words AS (
  SELECT r, count(DISTINCT p + k) AS n_hit FROM hits, range(0, size) t(k) GROUP BY r),
ids AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words,
  CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""
