"""N-grams of a corpus, cut, hashed and counted for whole Arrow slices in the tasks.

The n-grams are those of `tfidf.with_terms`. No array of them is made: an n-gram is a span of the
words of its slice and a 64-bit hash, and a string only where one is returned.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.bytewords import (
    byte_set,
    ngram_hashes,
    prefix_codes,
    slices,
    span_hashes,
    word_bounds,
)
from pagesift.functions.text import NUMBER_TOKEN, foldings
from pagesift.session import stored

#: rows of a batch that a task returns, at most
BATCH_ROWS = 100_000
#: hash buckets, as powers of two, and buckets per wanted term
MIN_BITS, MAX_BITS, TERMS_SHARE = 18, 24, 64
#: buckets per wanted term whose terms are counted first
FULLEST = 4
#: bits of one of Spark's bitmaps
_BITMAP_BITS = 8 * 4096
#: ASCII word characters, and every byte of a character beyond ASCII
_MEMBERS = byte_set((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A), (0x80, 0xFF))
_HEXADECIMAL = byte_set((0x30, 0x39), (0x61, 0x66), (0x78, 0x78))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: the longest number token
_NUMBER_BYTES = 7
_NUMBER = re.compile(NUMBER_TOKEN.encode())


@dataclass(frozen=True)
class Cut:
    """How texts are cut into n-grams of `low` to `high` words."""

    low: int
    high: int
    strip_accents: bool = True
    stop_numbers: bool = True

    def text(self, content: str = "content") -> Column:
        """The text in which a word is a run of ASCII word characters or bytes beyond ASCII, once its
        accents are folded in the tasks if they are to be stripped."""
        text = F.col(content).cast("string")
        if self.strip_accents:
            return F.lower(text)
        plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")
        # capitals of plain texts are lowered with their bytes
        return F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text)


@dataclass(frozen=True)
class Grams:
    """The n-grams of some texts, in the order of their sizes: hash, text, first and last byte."""

    count: int
    data: np.ndarray
    hashes: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def strings(self, chosen: np.ndarray) -> pa.Array:
        """The chosen n-grams as strings."""
        starts, sizes = self.starts[chosen], self.ends[chosen] - self.starts[chosen]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
        found = pa.LargeStringArray.from_buffers(
            len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[places])
        )
        return found.cast(pa.string())


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words are number tokens."""
    others = np.concatenate([[0], np.cumsum(~_HEXADECIMAL[data], dtype=np.int32)])
    found = (ends - starts <= _NUMBER_BYTES) & (others[ends] == others[starts])
    places = np.flatnonzero(found)
    whole = data.tobytes()
    found[places] = [
        _NUMBER.match(whole[start:end]) is not None
        for start, end in zip(starts[places].tolist(), ends[places].tolist())
    ]
    return found


@cache
def _spellings() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with ASCII spellings, ascending, the spellings' lengths and, a row each, their bytes."""
    accented, plain, ligatures = foldings()
    spelled = sorted([*zip(map(ord, accented), plain), *((ord(c), letters) for c, letters in ligatures)])
    sizes = np.array([len(letters) for _, letters in spelled])
    letters = np.array([list(w.encode().ljust(sizes.max(), b" ")) for _, w in spelled], np.uint8)
    return np.array([number for number, _ in spelled]), sizes, letters


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Valid UTF-8 texts as `text.fold_to_ascii` writes lower-cased ones, and their offsets."""
    plain = data < 0x80
    if plain.all():
        return data, offsets
    points, sizes, letters = _spellings()
    leads = np.flatnonzero(data >= 0xC0)
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
    first, second, third, fourth = (padded[leads + k] for k in range(4))
    second, third, fourth = second & 0x3F, third & 0x3F, fourth & 0x3F
    number = np.where(
        first < 0xE0,
        (first & 0x1F) << 6 | second,
        np.where(
            first < 0xF0,
            (first & 0x0F) << 12 | second << 6 | third,
            (first & 0x07) << 18 | second << 12 | third << 6 | fourth,
        ),
    )
    place = np.minimum(np.searchsorted(points, number), len(points) - 1)
    known = points[place] == number
    leads, place = leads[known], place[known]
    lengths = plain.astype(np.int8)
    lengths[leads] = sizes[place]
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    folded = np.empty(ends[-1], np.uint8)
    folded[ends[:-1][plain]] = data[plain]
    for k in range(letters.shape[1]):
        longer = sizes[place] > k
        folded[ends[leads[longer]] + k] = letters[place[longer], k]
    return folded, ends[offsets]


def _cut(data: np.ndarray, offsets: np.ndarray, cut: Cut) -> Grams:
    if cut.strip_accents:
        data, offsets = fold(data, offsets)
    data = _LOWER[data]
    starts, ends, _ = word_bounds(data, offsets, _MEMBERS)
    sizes = ends - starts
    if len(data) and data.max() >= 0x80:
        # characters, not bytes
        inner = np.concatenate([[0], np.cumsum(data & 0xC0 == 0x80, dtype=np.int32)])
        sizes = sizes - (inner[ends] - inner[starts])
    kept = sizes >= 2
    if cut.stop_numbers:
        kept &= ~_numbers(data, starts, ends)
    starts, ends = starts[kept], ends[kept]
    texts = np.searchsorted(offsets, starts, "right") - 1
    # the words with one space behind each, so that an n-gram is one span
    sizes = ends - starts + 1
    places = np.concatenate([[0], np.cumsum(sizes)])
    joined = np.append(data, np.uint8(0x20))[
        np.repeat(starts - places[:-1], sizes) + np.arange(places[-1])
    ]
    joined[places[1:] - 1] = 0x20
    begins, closes = places[:-1], places[1:] - 1
    words = span_hashes(prefix_codes(joined), begins, closes)
    parts = []
    for size in range(cut.low, cut.high + 1):
        count = max(len(words) - size + 1, 0)
        inside = np.flatnonzero(texts[:count] == texts[size - 1 : size - 1 + count])
        parts.append(
            (ngram_hashes(words, size)[inside], texts[inside], begins[inside], closes[inside + size - 1])
        )
    return Grams(len(offsets) - 1, joined, *(np.concatenate(p) for p in zip(*parts)))


def cut_texts(texts: pa.Array, cut: Cut) -> Iterator[tuple[int, Grams]]:
    """(first row, n-grams) of slices of whole texts."""
    for low, _, data, offsets in slices(texts):
        yield low, _cut(data, offsets, cut)


def _per_text(grams: Grams, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of equal n-grams of one text among the chosen, and their counts."""
    # stable: within a hash the texts rise, but for the sizes, which have other hashes
    order = chosen[np.argsort(grams.hashes[chosen], kind="stable")]
    hashes, texts = grams.hashes[order], grams.texts[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
    firsts = np.flatnonzero(new)
    return order[firsts], np.diff(np.append(firsts, len(order)))


def _per_slice(grams: Grams, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the first of equal n-grams among the chosen, their counts and numbers of texts."""
    places, counts = _per_text(grams, chosen)
    if not len(places):
        return places, counts, counts
    hashes = grams.hashes[places]
    firsts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return places[firsts], np.add.reduceat(counts, firsts), np.diff(np.append(firsts, len(places)))


def buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def is_open(open_buckets: bytes, hashes: np.ndarray, bits: int) -> np.ndarray:
    bucket = buckets(hashes, bits)
    found = np.frombuffer(open_buckets, np.uint8)
    return (found[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1


def _pieces(*arrays: np.ndarray) -> Iterator[list[np.ndarray]]:
    for start in range(0, len(arrays[0]), BATCH_ROWS):
        yield [array[start : start + BATCH_ROWS] for array in arrays]


def bucket_counts(corpus: DataFrame, cut: Cut, bits: int, content: str = "content") -> DataFrame:
    """(bucket, n): the n-grams of each hash bucket; a task returns a row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, grams in cut_texts(batch.column(0), cut):
                np.add.at(counts, buckets(grams.hashes, bits), 1)
        for (found,) in _pieces(np.flatnonzero(counts)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(counts[found])], ["bucket", "n"]
            )

    parts = corpus.select(cut.text(content)).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def term_counts(
    corpus: DataFrame,
    cut: Cut,
    bits: int | None = None,
    open_buckets: bytes = b"",
    content: str = "content",
) -> DataFrame:
    """(term, ctf, df): corpus count and number of documents of the n-grams; with `bits`, of those
    in open buckets only."""
    sent = corpus.sparkSession.sparkContext.broadcast(open_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, grams in cut_texts(batch.column(0), cut):
                found = _per_slice(grams, _chosen(grams, sent.value, bits))
                for places, counts, texts in _pieces(*found):
                    yield pa.RecordBatch.from_arrays(
                        [grams.strings(places), pa.array(counts), pa.array(texts)],
                        ["term", "ctf", "df"],
                    )

    parts = corpus.select(cut.text(content)).mapInArrow(run, "term string, ctf long, df long")
    return parts.groupBy("term").agg(F.sum("ctf").alias("ctf"), F.sum("df").alias("df"))


def _chosen(grams: Grams, open_buckets: bytes, bits: int | None) -> np.ndarray:
    if bits is None:
        return np.arange(len(grams.hashes))
    return np.flatnonzero(is_open(open_buckets, grams.hashes, bits))


def document_terms(
    corpus: DataFrame,
    keep: list[str],
    cut: Cut,
    bits: int | None = None,
    open_buckets: bytes = b"",
    content: str = "content",
) -> DataFrame:
    """(keep..., term, tf) of every document; with `bits`, of the n-grams in open buckets only."""
    sent = corpus.sparkSession.sparkContext.broadcast(open_buckets)
    rows = corpus.select(*keep, cut.text(content).alias("_text"))
    shape = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.select(*keep).schema),
         "term string", "tf int"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, grams in cut_texts(batch.column(len(keep)), cut):
                found = _per_text(grams, _chosen(grams, sent.value, bits))
                for places, counts in _pieces(*found):
                    at = pa.array(grams.texts[places] + low)
                    own = [batch.column(k).take(at) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays(
                        [*own, grams.strings(places), pa.array(counts.astype(np.int32))],
                        [*keep, "term", "tf"],
                    )

    return rows.mapInArrow(run, shape)


def term_hashes(terms: list[str]) -> np.ndarray:
    """The hashes of n-grams given as strings."""
    found = np.zeros(len(terms), np.uint64)
    by_size: dict[int, list[int]] = {}
    for place, term in enumerate(terms):
        by_size.setdefault(term.count(" ") + 1, []).append(place)
    for size, places in by_size.items():
        words = [word.encode() for place in places for word in terms[place].split(" ")]
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(words), np.uint8)
        hashes = span_hashes(prefix_codes(data), ends - lengths, ends)
        found[places] = ngram_hashes(hashes, size)[::size]
    return found


def known_terms(corpus: DataFrame, terms: tuple[str, ...], cut: Cut, content: str, out: str) -> DataFrame:
    """Adds `out`: those n-grams of each document that are among the terms, as often as they occur."""
    hashes = term_hashes(list(terms))
    order = np.argsort(hashes)
    sent = corpus.sparkSession.sparkContext.broadcast((hashes[order], [terms[i] for i in order]))

    @F.arrow_udf("array<string>")
    def known(texts: pa.Array) -> pa.Array:
        own, names = sent.value
        found, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, grams in cut_texts(texts, cut):
            place = np.minimum(np.searchsorted(own, grams.hashes), len(own) - 1)
            hit = np.flatnonzero(own[place] == grams.hashes)
            hit = hit[np.argsort(grams.texts[hit], kind="stable")]
            found.append(place[hit])
            lengths.append(np.bincount(grams.texts[hit], minlength=grams.count))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
        values = pa.array(names, pa.string()).take(pa.array(np.concatenate(found)))
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return corpus.withColumn(out, known(cut.text(content)))


def frequent_terms(
    corpus: DataFrame, count: int, cut: Cut, content: str = "content", bits: int | None = None
) -> DataFrame:
    """(term, ctf, df), a written table with the `count` most frequent terms, ties to the lower term
    included, and some others: terms that cannot be among the first are left out before they are strings.

    A term's count is at most its hash bucket's. The terms of the fullest buckets are counted first;
    the lowest count that is then among the first `count` bounds the wanted ones, and terms of other
    buckets that reach it are counted too.
    """
    if bits is None:
        bits = min(max(MIN_BITS, (TERMS_SHARE * count).bit_length()), MAX_BITS)
    counted = stored(bucket_counts(corpus, cut, bits, content), "buckets")
    total = counted.count()
    full = 0
    if total > FULLEST * count:
        share = F.percentile_approx("n", 1 - FULLEST * count / total, 10_000)
        full = counted.agg(share.alias("n")).first()["n"]

    def terms_of(chosen: DataFrame) -> DataFrame:
        opened = bitmap(chosen.select("bucket"), bits)
        return stored(term_counts(corpus, cut, bits, opened, content), "terms")

    found = terms_of(counted.filter(F.col("n") >= full))
    if not full:
        return found
    first = found.select("ctf").orderBy(F.desc("ctf")).limit(count)
    row = first.agg(F.count(F.lit(1)).alias("terms"), F.min("ctf").alias("least")).first()
    least = row["least"] if row["terms"] == count else 0
    others = counted.filter((F.col("n") < full) & (F.col("n") >= least))
    return found.unionByName(terms_of(others)) if others.head(1) else found


def bitmap(buckets: DataFrame, bits: int) -> bytes:
    """A bit per bucket of the rows (bucket); one row per 32,768 buckets comes to the driver."""
    # Spark numbers bitmaps and their bits from bit 1 on
    number = F.col("bucket") + 1
    rows = (
        buckets.groupBy(F.bitmap_bucket_number(number).alias("number"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap"))
        .collect()
    )
    whole = bytearray(max((1 << bits) // 8, _BITMAP_BITS // 8))
    for row in rows:
        start = (row["number"] - 1) * _BITMAP_BITS // 8
        whole[start : start + len(row["bitmap"])] = row["bitmap"]
    return bytes(whole)


def per_text_codes(
    corpus: DataFrame, cut: Cut, code: Callable[[bytes], int], content: str, out: str
) -> DataFrame:
    """Adds `out`: array<struct<item, n>> of the codes of each document's n-grams and their counts,
    ascending; null where there is no text. A code is computed once per slice and n-gram."""

    @F.arrow_udf("array<struct<item:int,n:int>>")
    def coded(texts: pa.Array) -> pa.Array:
        items, counts, lengths = [], [], [np.zeros(0, np.int64)]
        for _, grams in cut_texts(texts, cut):
            _, first, which = np.unique(grams.hashes, return_index=True, return_inverse=True)
            whole = grams.data.tobytes()
            spans = zip(grams.starts[first].tolist(), grams.ends[first].tolist())
            codes = np.array([code(whole[start:end]) for start, end in spans], np.int64)
            pairs, own = np.unique((grams.texts << 32) + codes[which], return_counts=True)
            items.append(pairs & 0xFFFFFFFF)
            counts.append(own)
            lengths.append(np.bincount(pairs >> 32, minlength=grams.count))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
        flat = [np.concatenate([np.zeros(0, np.int64), *part]) for part in (items, counts)]
        values = pa.StructArray.from_arrays(
            [pa.array(part.astype(np.int32)) for part in flat], ["item", "n"]
        )
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=texts.is_null())

    return corpus.withColumn(out, coded(cut.text(content)))
