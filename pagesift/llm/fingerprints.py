"""Document fingerprints of improbable byte windows.

1. Every window of WINDOW bytes has an entropy class. Classes are counted over all windows of the
   corpus; the fewer windows a class has, the rarer it is. Windows of little entropy (blanks,
   rules of one character) rank behind all others.
2. Of each SPAN neighbouring windows the rarest, first of equals, gets a point; windows of at least
   LEAST points are the features. They depend on nearby bytes only, so an edit leaves those of the
   untouched rest.
3. Features are inserted, in order, into Bloom filters of BITS bits, FEATURES to a filter; the next
   ones go to the next filter of the chain.
4. Two filters are as alike as their common bits, beyond those that chance explains, are many
   against the larger of both; a chain's likeness is the mean of its filters' best ones, by bits,
   taken from both sides.

The order of documents comes from one range shuffle; neighbours of different partitions meet in a
join of one row per partition.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.bytewords import mix
from pagesift.llm.scratch import Scratch

WINDOW = 32
SPAN = 32
LEAST = 8
FEATURES = 160
BITS = 2048
HASHES = 5
CLASSES = 256
#: windows below this share of the largest entropy rank last
WEAK = 0.4
#: window starts treated at a time, and characters
BLOCK = 1 << 20
SLICE_CHARS = 1_000_000

_SCALE = 1 << 16
#: c * log2(c), scaled, and what the c-th equal byte adds to a window's sum of them
_TERMS = [round(c * math.log2(c) * _SCALE) if c else 0 for c in range(WINDOW + 1)]
_GAINS = np.array([0] + [_TERMS[c] - _TERMS[c - 1] for c in range(1, WINDOW + 1)], np.int64)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Class of the entropy of each window of WINDOW bytes, 0 for equal bytes only."""
    count = len(data) - WINDOW + 1
    if count <= 0:
        return np.zeros(0, np.uint8)
    # how often the byte at a place occurs in the window that ends, or begins, there
    entering = np.ones(len(data), np.uint8)
    leaving = np.ones(len(data), np.uint8)
    for step in range(1, WINDOW):
        same = (data[step:] == data[:-step]).view(np.uint8)
        entering[step:] += same
        leaving[:-step] += same
    gained = np.cumsum(_GAINS[entering])
    lost = np.cumsum(_GAINS[leaving[: count - 1]])
    sums = gained[WINDOW - 1 :]
    sums[1:] -= lost
    largest = _TERMS[WINDOW]
    return ((largest - sums) * (CLASSES - 1) // largest).astype(np.uint8)


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each class from its windows' number: rarest first, weak classes last."""
    weak = np.arange(CLASSES) < WEAK * CLASSES
    ranks = np.empty(CLASSES, np.int64)
    # of the weak ones, those of more entropy come first
    ranks[np.lexsort((-np.arange(CLASSES), np.where(weak, 0, counts), weak))] = np.arange(CLASSES)
    return ranks


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first, end, offset, bytes): the window starts first to end, and the bytes from `offset` on that decide on
    them."""
    count = len(data) - WINDOW + 1
    for first in range(0, max(count, 1), BLOCK):
        end = min(first + BLOCK, count)
        offset = max(0, first - SPAN + 1)
        yield first, end, offset, data[offset : min(count, end + SPAN - 1) + WINDOW - 1]


def class_counts(texts: list[bytes]) -> np.ndarray:
    """Windows of each class in the texts."""
    counts = np.zeros(CLASSES, np.int64)
    short: list[bytes] = []
    for text in texts:
        if len(text) <= BLOCK:
            short.append(text)
            continue
        for first, end, offset, data in _blocks(np.frombuffer(text, np.uint8)):
            classes = entropy_classes(data)[first - offset : end - offset]
            counts += np.bincount(classes, minlength=CLASSES)
    data, offsets = _joined(short)
    classes = entropy_classes(data)
    counts += np.bincount(classes[_whole(offsets, len(classes), WINDOW)], minlength=CLASSES)
    return counts


def _whole(offsets: np.ndarray, count: int, size: int) -> np.ndarray:
    """Which of the places from 0 have `size` bytes of one text behind them."""
    inside = np.ones(count, bool)
    ends = offsets[1:-1]
    for back in range(1, size):
        places = ends - back
        inside[places[(places >= 0) & (places < count)]] = False
    return inside


def _chosen(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Places of the features of texts in one array, ascending."""
    classes = entropy_classes(data)
    count = len(classes)
    if not count:
        return np.zeros(0, np.int64)
    keys = (ranks[classes] << np.int64(32)) + np.arange(count)
    found = []
    if count >= SPAN:
        least = keys
        step = 1
        while step < SPAN:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        spans = _whole(offsets, len(least), WINDOW + SPAN - 1)
        places = least[spans] & np.int64((1 << 32) - 1)
        found.append(np.flatnonzero(np.bincount(places, minlength=1) >= LEAST))
    # texts of fewer windows than a span have one feature
    sizes = np.diff(offsets)
    for n in np.flatnonzero((sizes >= WINDOW) & (sizes < WINDOW + SPAN - 1)).tolist():
        own = keys[offsets[n] : offsets[n + 1] - WINDOW + 1]
        found.append(np.array([own.min() & np.int64((1 << 32) - 1)]))
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows at the places."""
    if not len(places):
        return np.zeros(0, np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places]
    parts = np.ascontiguousarray(windows).view("<u8")
    total = np.full(len(parts), WINDOW, np.uint64)
    for k in range(parts.shape[1]):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return total


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Hashes of each text's features in order; of a text shorter than a window, itself."""
    found: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    short = []
    for n, text in enumerate(texts):
        if len(text) > BLOCK:
            whole, own = np.frombuffer(text, np.uint8), []
            for first, end, offset, data in _blocks(whole):
                places = _chosen(data, np.array([0, len(data)]), ranks) + offset
                own.append(places[(places >= first) & (places < end)])
            found[n] = _hashes(whole, np.concatenate(own))
        elif 0 < len(text) < WINDOW:
            padded = np.frombuffer(text.ljust(WINDOW, b"\0"), np.uint8)
            found[n] = mix(_hashes(padded, np.array([0])) + np.uint64(len(text)))
        elif text:
            short.append(n)
    data, offsets = _joined([texts[n] for n in short])
    places = _chosen(data, offsets, ranks)
    hashes, bounds = _hashes(data, places), np.searchsorted(places, offsets)
    for k, n in enumerate(short):
        found[n] = hashes[bounds[k] : bounds[k + 1]]
    return found


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The chain of Bloom filters of each text, a row of BITS / 8 bytes per filter."""
    own = features(texts, ranks)
    sizes = [-(-len(f) // FEATURES) for f in own]
    first = np.zeros(len(own) + 1, np.int64)
    np.cumsum(sizes, out=first[1:])
    filters = np.zeros((int(first[-1]), BITS // 8), np.uint8)
    if first[-1]:
        which = np.concatenate([at + np.arange(len(f)) // FEATURES for at, f in zip(first, own)])
        hashes = np.concatenate(own)
        width = BITS.bit_length() - 1
        for k in range(HASHES):
            bit = (hashes >> np.uint64(width * k)).astype(np.int64) & (BITS - 1)
            np.bitwise_or.at(filters, (which, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    return [filters[low:high] for low, high in zip(first[:-1], first[1:])]


def written(digest: np.ndarray) -> str:
    """A digest as text: number of filters and their bits; empty without features."""
    return f"{len(digest)}:{base64.b64encode(digest.tobytes()).decode()}" if len(digest) else ""


def _written(bits: str) -> Column:
    """The same for a column of the digests' bytes."""
    filters = (F.octet_length(bits) / (BITS // 8)).cast("int").cast("string")
    return F.when(F.octet_length(bits) > 0, F.concat_ws(":", filters, F.base64(bits))).otherwise("")


def read(fingerprint: str) -> np.ndarray:
    if not fingerprint:
        return np.zeros((0, BITS // 8), np.uint8)
    count, bits = fingerprint.split(":")
    return np.frombuffer(base64.b64decode(bits), np.uint8).reshape(int(count), BITS // 8)


def _overlaps(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common bits of each two filters."""
    if len(left) * len(right) <= 64:
        return np.bitwise_count(left[:, None, :] & right[None, :, :]).sum(2, dtype=np.int64)
    wide = np.unpackbits(right, axis=1).astype(np.float32).T
    return np.rint(np.unpackbits(left, axis=1).astype(np.float32) @ wide).astype(np.int64)


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """0 to 1; of equal digests 1, also of empty ones; of an empty and another one 0."""
    if left.shape == right.shape and np.array_equal(left, right):
        return 1.0
    if not len(left) or not len(right):
        return 0.0
    n_left = np.bitwise_count(left).sum(1, dtype=np.int64)
    n_right = np.bitwise_count(right).sum(1, dtype=np.int64)
    best_left = np.zeros(len(left))
    best_right = np.zeros(len(right))
    for low in range(0, len(left), 256):
        own = slice(low, low + 256)
        a, b = n_left[own, None], n_right[None, :]
        chance = a * b / BITS
        spread = np.sqrt(chance * (1 - a / BITS) * (1 - b / BITS))
        common, most = _overlaps(left[own], right), np.maximum(a, b)
        # beyond three standard deviations of what chance gives
        real = common > chance + 3 * spread
        score = np.where(real, (common - chance) / np.maximum(most - chance, 1e-9), 0.0)
        best_left[own] = score.max(1)
        best_right = np.maximum(best_right, score.max(0))
    both = np.average(best_left, weights=n_left) + np.average(best_right, weights=n_right)
    return float(min(max(both / 2, 0.0), 1.0))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CLASSES, np.int64)
    for batch in batches:
        texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
        for low, high in _slices(texts):
            counts += class_counts(texts[low:high])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(CLASSES)), pa.array(counts)], ["class", "windows"]
    )


def corpus_rarity(docs: DataFrame) -> np.ndarray:
    """Ranks of the classes, from all windows of all texts of `docs`."""
    found = (
        docs.select("text")
        .mapInArrow(_counter, "class long, windows long")
        .groupBy("class")
        .agg(F.sum("windows").alias("windows"))
    )
    counts = np.zeros(CLASSES, np.int64)
    for row in found.collect():
        counts[row["class"]] = row["windows"]
    return rarity(counts)


def _slices(texts: list) -> Iterator[tuple[int, int]]:
    low = size = 0
    for n, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_CHARS:
            yield low, n + 1
            low, size = n + 1, 0
    if low < len(texts):
        yield low, len(texts)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = (
    "doc_id long, n_chars long, edited_sha256 string, bits binary, edited_bits binary, "
    "near_edited double, near_next double"
)
_NAMES = [column.split()[0] for column in _ROW.split(", ")]
_TYPES = [
    pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()
]


def _compared(ids: list, texts: list[str], following: list[str], ranks: np.ndarray) -> list[tuple]:
    """Result rows of texts and those that follow them."""
    changed = [edited(t, f).encode() for t, f in zip(texts, following)]
    # a following text is mostly the next row's own
    distinct = list(dict.fromkeys([*texts, *following]))
    own = dict(zip(distinct, digests([t.encode() for t in distinct], ranks)))
    rows = []
    for doc_id, text, after, new, digest in zip(
        ids, texts, following, changed, digests(changed, ranks)
    ):
        mine = own[text]
        sha = hashlib.sha256(new).hexdigest()
        near = likeness(mine, digest), likeness(mine, own[after])
        rows.append((doc_id, len(text), sha, mine.tobytes(), digest.tobytes(), *near))
    return rows


def _arrow(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(column), kind) for column, kind in zip(columns, types)], names
    )


def _sorted_rows(ranks: np.ndarray):
    """Rows of a sorted partition, but for its last one. The first and the last one's texts come as
    rows of their own, with the number of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names, types = [*_NAMES, "part", "edge", "text"], [*_TYPES, pa.int64(), pa.string(), pa.string()]

        def edge(kind: str, doc_id, text: str) -> pa.RecordBatch:
            return _arrow([(doc_id, *[None] * 6, part, kind, text)], names, types)

        last = None
        for batch in batches:
            ids, texts = (column.to_pylist() for column in batch.columns)
            texts = [t or "" for t in texts]
            for low, high in _slices(texts):
                if last is None:
                    yield edge("first", ids[0], texts[0])
                    own, following = list(range(low, high - 1)), texts[low + 1 : high]
                    some_ids, some = [ids[n] for n in own], [texts[n] for n in own]
                else:
                    some_ids, some = [last[0], *ids[low : high - 1]], [last[1], *texts[low : high - 1]]
                    following = texts[low:high]
                last = ids[high - 1], texts[high - 1]
                rows = _compared(some_ids, some, following, ranks)
                yield _arrow([(*row, None, None, None) for row in rows], names, types)
        if last is not None:
            yield edge("last", *last)

    return run


def _edge_rows(ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, after in zip(*(column.to_pylist() for column in batch.columns)):
                yield _arrow(_compared([doc_id], [text], [after], ranks), _NAMES, _TYPES)

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of
    `docs` (doc_id, text; others ignored).

    Rows are ordered by falling doc_id, null ids last, rows of one id by their texts' hashes; the
    last one is followed by the first, a single row by itself. Null is the empty text, whose
    fingerprint is empty. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    ranks = corpus_rarity(docs)
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash"), F.col("row")]
    ordered = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "text",
            F.xxhash64("text").alias("hash"),
            # spreads rows that are equal
            F.monotonically_increasing_id().alias("row"),
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    shape = f"{_ROW}, part long, edge string, text string"
    found = scratch.store(ordered.mapInArrow(_sorted_rows(ranks), shape), "rows")
    edges = scratch.store(
        found.filter("edge is not null").select("part", "edge", "doc_id", "text"), "edges"
    )
    # a number per partition
    parts = sorted(row["part"] for row in edges.filter("edge = 'first'").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, next long")
    first = edges.filter("edge = 'first'").select(
        F.col("part").alias("next"), F.col("text").alias("following")
    )
    pairs = edges.filter("edge = 'last'").join(F.broadcast(after), "part").join(first, "next")
    closed = scratch.store(
        pairs.select("doc_id", "text", "following").mapInArrow(_edge_rows(ranks), _ROW), "closed"
    )
    scratch.close(found, closed)
    every = found.filter("edge is null").select(*_NAMES).unionByName(closed)
    return every.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _written("bits").alias("fingerprint"),
        _written("edited_bits").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
