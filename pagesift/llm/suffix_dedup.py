"""Removal of byte strings that occur more than once, by suffix arrays of shards.

A string of SIZE bytes is owned by its anchor: the smallest hash among the WINDOW-byte windows
inside it. The anchor depends on the string alone, so equal strings have equal anchors at equal
offsets, and consecutive starts share an anchor: a document falls into runs of starts, about one
per 170 bytes. Runs meet by the hash of their anchor:

1. Runs of equal bytes meet by a digest; where there are two, all their starts are repeated.
2. Where the distinct runs of an anchor are few, they become part of a shard. A shard of bounded
   size drops starts that nothing can equal, builds the suffix array of the others by
   Larsson-Sadakane refinement and its common prefixes by Kasai's property, and finds starts that
   share SIZE bytes with another one.
3. Where they are many (a passage in a large share of all documents), runs are cut into bands of
   starts of like offset, which meet by the bytes that all their strings share. Bands of equal
   bytes are repeated; bands that differ are compared start by start, by digest. All counts
   have partial sums, so no task holds an anchor's runs.

Because equal strings always meet in one shard or one count, shards need no pairwise merging,
whose work would grow with the square of their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.bytewords import mix, powers, slices
from pagesift.llm.scratch import Scratch

SIZE = 400
WINDOW = 64
#: an anchor with more distinct runs goes the way of bands
SHARD_RUNS = 2000
SHARD_BYTES = 1024 * 1024
BAND = 16

_LOW = np.uint64(0xFFFFFFFF)
_RAW_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_RAW_CODES[data] * powers(len(data)), out=sums[1:])
    return sums


def _spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums), inverse=True)[starts])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by running minima of blocks from both sides."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def runs(
    data: np.ndarray, offsets: np.ndarray, size: int, window: int
) -> tuple[np.ndarray, ...] | None:
    """(row, first start, last start, anchor, key, digest) of each run; places count in `data`."""
    if len(data) < size:
        return None
    sums = _sums(data)
    at = np.arange(len(data) - window + 1)
    hashes = _spans(sums, at, at + window)
    # the upper half of the hash, then the leftmost place
    ranked = (hashes & ~_LOW) | at.astype(np.uint64)
    anchor = (sliding_minimum(ranked, size - window + 1) & _LOW).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = np.arange(len(anchor)) + size <= offsets[row + 1]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh & inside)
    if not len(first):
        return None
    # a run ends where the next begins, or at the last whole string of its row
    following = np.append(np.flatnonzero(fresh), len(anchor))
    last = following[np.searchsorted(following, first, "right")] - 1
    row = row[first]
    last = np.minimum(last, offsets[row + 1] - size)
    anchor = anchor[first]
    digest = mix(
        _spans(sums, first, last + size)
        + (last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        + (anchor - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    )
    return row, first, last, anchor, hashes[anchor], digest


_RUNS = "key long, digest long, doc_id {kind}, text_hash long, first long, last long, anchor long"


def _run_finder(size: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, offsets in slices(batch.column(2)):
                found = runs(data, offsets, size, window)
                if found is None:
                    continue
                row, first, last, anchor, key, digest = found
                origin, rows = offsets[row], pa.array(row + low)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        pa.array(digest.view(np.int64)),
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(first - origin),
                        pa.array(last - origin),
                        pa.array(anchor - origin),
                    ],
                    ["key", "digest", "doc_id", "text_hash", "first", "last", "anchor"],
                )

    return run


def _cutter(size: int):
    """The bytes of each wanted run of a text; `anchor` from the run's first start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1)):
                text, wanted = text.as_py().encode("utf-8", "surrogatepass"), wanted.as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["key"] for w in wanted], pa.int64()),
                        pa.array([w["digest"] for w in wanted], pa.int64()),
                        pa.array([w["last"] - w["first"] + 1 for w in wanted], pa.int64()),
                        pa.array([w["anchor"] - w["first"] for w in wanted], pa.int64()),
                        pa.array([text[w["first"] : w["last"] + size] for w in wanted], pa.binary()),
                    ],
                    ["key", "digest", "starts", "anchor", "bytes"],
                )

    return run


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first `depth` bytes at least, and the rank of each.

    Larsson and Sadakane: suffixes start sorted by seven bytes; each round sorts the groups that
    are still equal by the rank of what follows, which doubles the sorted length. Groups of one
    are settled and not touched again.
    """
    count = len(data)
    # seven places of nine bits; zero is beyond the end
    padded = np.zeros(count + 7, np.uint64)
    padded[:count] = data
    padded[:count] += np.uint64(1)
    code = np.zeros(count, np.uint64)
    for k in range(7):
        code = (code << np.uint64(9)) | padded[k : k + count]
    order = np.argsort(code, kind="stable")
    head = np.ones(count, bool)
    head[1:] = code[order[1:]] != code[order[:-1]]
    rank = np.empty(count, np.int64)
    rank[order] = _group_numbers(head)
    length = 7
    active = _crowded(head)
    while length < depth and len(active):
        suffix = order[active]
        after = suffix + length
        key = np.where(after < count, rank[np.minimum(after, count - 1)], -1)
        group = rank[suffix]
        inner = np.lexsort((key, group))
        order[active] = suffix[inner]
        key, group = key[inner], group[inner]
        split = np.ones(len(active), bool)
        split[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        # a group's number is the place of its first suffix
        fresh = np.maximum.accumulate(np.where(split, active, 0))
        rank[order[active]] = fresh
        alone = split & np.append(split[1:], True)
        active = active[~alone]
        length *= 2
    return order, rank


def _group_numbers(head: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))


def _crowded(head: np.ndarray) -> np.ndarray:
    """Places of the groups of more than one."""
    return np.flatnonzero(~(head & np.append(head[1:], True)))


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order.

    Kasai: a suffix shares at least one byte less than the suffix that starts one byte before it,
    and exactly one less where both neighbours continue equal bytes. So only the other suffixes
    are compared, eight bytes at a time and all at once.
    """
    count = len(data)
    before = np.full(count, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(count)
    previous = np.maximum(before - 1, 0)
    reducible = (
        (at > 0) & (before > 0)
        & (data[np.maximum(at - 1, 0)] == data[previous])
        & (before[np.maximum(at - 1, 0)] == before - 1)
    )
    shared = np.zeros(count, np.int64)
    left = np.flatnonzero(~reducible & (before >= 0))
    padded = np.concatenate([data.astype(np.int16), [-1] * 16])
    step = 8
    while len(left):
        a, b = left + shared[left], before[left] + shared[left]
        going = (a + step <= count) & (b + step <= count)
        same = np.zeros(len(left), np.int64)
        open_ = np.ones(len(left), bool)
        for k in range(step):
            a_k, b_k = np.minimum(a + k, count), np.minimum(b + k, count)
            open_ &= (padded[a_k] == padded[b_k]) & (a + k < count) & (b + k < count)
            same += open_
        shared[left] += same
        left = left[open_ & going]
    base = np.maximum.accumulate(np.where(reducible, 0, at))
    shared = np.where(reducible, np.maximum(shared[base] - (at - base), 0), shared)
    return shared[order]


def repeated_starts(data: np.ndarray, owned: np.ndarray, size: int) -> np.ndarray:
    """Of the owned places, those whose `size` bytes also begin at another owned place."""
    order, _ = suffix_array(data, size)
    group = np.cumsum(common_prefixes(data, order) < size)
    mine = owned[order]
    members = np.bincount(group[mine], minlength=group[-1] + 1)
    found = np.zeros(len(data), bool)
    found[order] = mine & (members[group] > 1)
    return found


_MARKS = "key long, digest long, marks array<struct<first:long,last:long>>"
_MARK = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _bounds(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"first": a, "last": b - 1} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def open_starts(
    data: np.ndarray,
    begins: np.ndarray,
    starts: np.ndarray,
    anchor: np.ndarray,
    keys: np.ndarray,
    size: int,
    band: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the starts that can be repeated, and of the bytes of their strings.

    Equal strings have like offsets to equal anchors. The strings of a band of offsets have the
    bytes between its last start and the end of its first string in common, so a band is open
    only if another run of the key has the same bytes there.
    """
    sums = _sums(data)
    codes, runs_, low, high = [], [], [], []
    for number in range(int(anchor.max()) // band + 1):
        last = anchor - number * band
        first = last - band + 1
        own = np.flatnonzero((last >= 0) & (first < starts))
        at, end = begins[own] + last[own], begins[own] + first[own] + size
        codes.append(_spans(sums, at, end) + keys[own] + np.uint64(number))
        runs_.append(own)
        low.append(np.maximum(first[own], 0))
        high.append(np.minimum(last[own], starts[own] - 1))
    code, run, low, high = map(np.concatenate, (codes, runs_, low, high))
    _, where, copies = np.unique(mix(code), return_inverse=True, return_counts=True)
    shared = copies[where] > 1
    run, low, high = run[shared], low[shared] + begins[run[shared]], high[shared] + begins[run[shared]]
    owned, needed = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
    np.add.at(owned, low, 1)
    np.add.at(owned, high + 1, -1)
    np.add.at(needed, low, 1)
    np.add.at(needed, high + size, -1)
    return np.cumsum(owned[:-1]) > 0, np.cumsum(needed[:-1]) > 0


def _shard_marker(size: int, band: int):
    def mark(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        pieces = table["bytes"].to_pylist()
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        begins = ends - [len(p) for p in pieces]
        starts, anchor = np.array(table["starts"]), np.array(table["anchor"])
        keys = np.array(table["key"]).view(np.uint64)
        owned, needed = open_starts(data, begins, starts, anchor, keys, size, band)
        found = np.zeros(len(data), bool)
        if needed.any():
            found[needed] = repeated_starts(data[needed], owned[needed], size)
        marks = [_bounds(found[b : b + s]) for b, s in zip(begins.tolist(), starts.tolist())]
        table = pa.table(
            {"key": table["key"], "digest": table["digest"], "marks": pa.array(marks, _MARK)}
        )
        return table.filter(pa.array([bool(m) for m in marks]))

    return mark


_BANDS = (
    "key long, digest long, band_key long, band_digest long, first long, last long, "
    "strings array<long>"
)


def _bander(size: int, band: int):
    """Bands of each run: starts of like distance to the anchor. band_key is the hash of the bytes
    that all strings of a whole band share, strings are the hashes of the strings themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, digest, starts, anchor, piece in zip(*(c.to_pylist() for c in batch.columns)):
                sums = _sums(np.frombuffer(piece, np.uint8))
                start = np.arange(starts)
                number = (anchor - start) // band
                string = _spans(sums, start, start + size)
                cuts = np.flatnonzero(np.diff(number)) + 1
                for own in np.split(start, cuts):
                    n, first, last = int(number[own[0]]), int(own[0]), int(own[-1])
                    whole_last, whole_first = anchor - n * band, anchor - n * band - band + 1
                    core = _spans(sums, np.array([whole_last]), np.array([whole_first + size]))
                    own_bytes = _spans(sums, np.array([first]), np.array([last + size]))
                    salt = np.uint64(key % (1 << 64)) + np.uint64(n)
                    where = np.uint64(first - whole_first) * np.uint64(64) + np.uint64(last - first)
                    rows.append(
                        (
                            key, digest,
                            int(mix(core + salt).view(np.int64)[0]),
                            int(mix(own_bytes + where).view(np.int64)[0]),
                            first, last, string[own].view(np.int64),
                        )
                    )
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:6]]
                + [pa.array(columns[6], pa.list_(pa.int64()))],
                ["key", "digest", "band_key", "band_digest", "first", "last", "strings"],
            )

    return run


def _band_marks(pieces: DataFrame, scratch: Scratch, size: int, band: int) -> DataFrame:
    """Marks of runs that are too many for a shard, from exact counts of bands and strings."""
    bands = scratch.store(pieces.mapInArrow(_bander(size, band), _BANDS), "bands")
    counts = scratch.store(
        bands.groupBy("band_key", "band_digest").agg(F.count(F.lit(1)).alias("copies")), "band-counts"
    )
    several = scratch.store(
        counts.groupBy("band_key")
        .agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("rows"))
        .filter("rows > 1"),
        "band-keys",
    )
    known = scratch.store(
        bands.join(several, "band_key").join(counts, ["band_key", "band_digest"]), "known-bands"
    )
    mark = F.struct("first", "last")
    whole = known.filter("copies > 1").select("key", "digest", mark.alias("mark"))
    single = scratch.store(
        known.filter("copies = 1 or kinds > 1").select(
            "key", "digest", "band_key", "first", "copies", F.posexplode("strings").alias("n", "string")
        ),
        "strings",
    )
    twice = scratch.store(
        single.groupBy("band_key", "string")
        .agg(F.count(F.lit(1)).alias("places"))
        .filter("places > 1")
        .drop("places"),
        "repeated-strings",
    )
    place = F.col("first") + F.col("n")
    alone = single.filter("copies = 1").join(twice, ["band_key", "string"], "left_semi").select(
        "key", "digest", F.struct(place.alias("first"), place.alias("last")).alias("mark")
    )
    marks = scratch.store(
        whole.unionByName(alone)
        .groupBy("key", "digest")
        .agg(F.array_sort(F.collect_list("mark")).alias("marks")),
        "band-marks",
    )
    scratch.drop(bands, counts, several, known, single, twice)
    return marks


def _remover(size: int):
    """Counts and digest of what is left of each text without its marked strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, marks in zip(batch.column(1), batch.column(2)):
                text = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for m in sorted(marks.as_py() or [], key=lambda m: m["first"]):
                    if spans and m["first"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], m["last"] + size)
                    else:
                        spans.append([m["first"], m["last"] + size])
                sha, done = hashlib.sha256(), 0
                for first, end in spans:
                    sha.update(text[done:first])
                    done = end
                sha.update(text[done:])
                removed = sum(end - first for first, end in spans)
                row = (len(text), removed, len(spans), sha.hexdigest(), spans)
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array(c, pa.int64()) for c in out[:3]]
                + [pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.list_(pa.int64())))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return run


def repeated_spans(
    docs: DataFrame,
    size: int = SIZE,
    window: int = WINDOW,
    shard_runs: int = SHARD_RUNS,
    shard_bytes: int = SHARD_BYTES,
    band: int = BAND,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per row of `docs` (doc_id, text).

    Spans [first byte, end) are the maximal runs of bytes covered by a string of `size` bytes that
    starts at another place too, of the same or another row; strings never cross rows. Null is an
    empty text; rows that repeat a document repeat each other's strings; a text shorter than
    `size` keeps everything.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = scratch.store(
        texts.mapInArrow(_run_finder(size, window), _RUNS.format(kind=kind)), "runs"
    )
    several = scratch.store(
        found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "keys"
    )
    met = scratch.store(found.join(several, "key"), "met")
    scratch.drop(found, several)
    where = F.struct("doc_id", "text_hash", "first", "last", "anchor")
    kinds = scratch.store(
        met.groupBy("key", "digest").agg(
            F.count(F.lit(1)).alias("copies"), F.min(where).alias("place")
        ),
        "kinds",
    )
    many = scratch.store(
        kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "many"
    )
    wanted = (
        kinds.join(many.select("key"), "key")
        .select("key", "digest", "place.*")
        .groupBy("doc_id", "text_hash")
        .agg(
            F.collect_list(F.struct("key", "digest", "first", "last", "anchor")).alias("wanted")
        )
    )
    # rows that repeat a document hold the same bytes
    pieces = scratch.store(
        _join_rows(texts, wanted, "inner")
        .select("text", "wanted")
        .mapInArrow(_cutter(size), "key long, digest long, starts long, anchor long, bytes binary")
        .dropDuplicates(["key", "digest"]),
        "pieces",
    )
    few = pieces.join(many.filter(F.col("kinds") <= shard_runs).select("key"), "key", "left_semi")
    volume = few.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = -(-volume // shard_bytes) or 1
    marks = (
        few.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(_shard_marker(size, band), _MARKS)
    )
    crowded = many.filter(F.col("kinds") > shard_runs).select("key")
    if not crowded.isEmpty():
        hot = pieces.join(crowded, "key", "left_semi").select(
            "key", "digest", "starts", "anchor", "bytes"
        )
        marks = marks.unionByName(_band_marks(hot, scratch, size, band))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("last") - F.col("first")).alias("last")))
    decided = scratch.store(
        kinds.join(marks, ["key", "digest"], "left")
        .filter("copies > 1 or marks is not null")
        .select("key", "digest", "copies", "marks"),
        "decided",
    )
    shifted = F.transform(
        F.when(F.col("copies") > 1, whole).otherwise(F.col("marks")),
        lambda m: F.struct(
            (m["first"] + F.col("first")).alias("first"), (m["last"] + F.col("first")).alias("last")
        ),
    )
    of_text = scratch.store(
        met.join(decided, ["key", "digest"])
        .select("doc_id", "text_hash", shifted.alias("marks"))
        .groupBy("doc_id", "text_hash")
        .agg(F.flatten(F.collect_list("marks")).alias("marks")),
        "of-text",
    )
    result = scratch.store(
        _join_rows(texts, of_text, "left")
        .select("doc_id", "text", "marks")
        .mapInArrow(
            _remover(size),
            f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
            "spans array<array<long>>",
        ),
        "result",
    )
    scratch.close(result)
    return result


def _join_rows(texts: DataFrame, of_rows: DataFrame, how: str) -> DataFrame:
    other = of_rows.withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    return texts.join(other, same, how)
