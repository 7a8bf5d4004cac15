"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

1. A text with a space before it is cut into byte ranges of about CHUNK characters; a shorter text
   is one range. A range travels with the words that its ends cut through, so its tokens are those
   of the whole text.
2. A range yields a fragment: the tokens up to its first common token end (open prefix), the groups
   between common ends (closed), and the tokens after the last one (open suffix). A range without
   a common end is open as a whole. `compose` joins two neighbours; it is associative, and a tree
   of Spark groupings, FAN fragments each, composes the ranges of a long text across tasks.
3. Tokens of both sides in one group are linked. Documents are counted per pair of linked ids over
   the whole corpus. The most frequent pairs, at most HOT_PAIRS, are broadcast; the others, none of
   which can be hot, are joined by shuffle.

Tokens of neither side reach across a single space between two other characters: A's pre-tokens
end there, and B's vocabulary has no piece with a space behind another character (checked when it
is loaded). So the words between such places are encoded once and remembered.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.scratch import Scratch

TOKENIZERS = "/opt/tokenizers"
#: code points of a byte range
CHUNK = 1 << 15
#: neighbouring fragments that one step composes
FAN = 16
#: pairs of ids that are broadcast
HOT_PAIRS = 500_000
#: encoded words that a worker remembers, at most twice as many between two slices, the longest of
#: them, and the links of all
WORDS, WORD_CHARS, WORD_LINKS = 100_000, 200, 4_000_000
#: characters encoded at a time
SLICE_CHARS = 1_000_000

_PLACE = re.compile(r"(?<=\S)(?= \S)")
#: blanks beside blanks, or beside an end of the text
_BLANKS = re.compile(r"\s | \s|^\s|\s$")
#: white space but the space and the line feed
_OTHER_BLANKS = re.compile(
    "[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]"
)
_SIDE = 1 << 32


class Words(NamedTuple):
    """Alignments of words, whose ends are token ends on both sides, in flat arrays. counts has tokens of A,
    tokens of B, groups, links and bytes; groups end with a semicolon each; the codes of all words follow
    one another. A word whose tokens' bytes are not its own has no token."""

    words: list[str]
    counts: np.ndarray
    groups: pa.StringArray
    codes: np.ndarray
    valid: np.ndarray


class Fragment(NamedTuple):
    """A byte range: open prefix, closed groups, open suffix. `cut` says whether it has a common end;
    without one all tokens are in the prefix. codes are the distinct pairs of linked ids, a * 2^32 + b,
    links their numbers."""

    valid: bool
    cut: bool
    prefix_a: list[int]
    prefix_b: list[int]
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: str
    codes: np.ndarray
    links: np.ndarray
    suffix_a: list[int]
    suffix_b: list[int]


FRAGMENT = (
    "valid boolean, cut boolean, prefix_a array<int>, prefix_b array<int>, n_a long, n_b long, "
    "n_groups long, n_links long, groups string, codes array<long>, links array<long>, "
    "suffix_a array<int>, suffix_b array<int>"
)
_FRAGMENT_TYPES = [
    pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(),
    pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()),
    pa.list_(pa.int32()), pa.list_(pa.int32()),
]


def group_text(a: list[int], b: list[int]) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


def pair_codes(a: list[int], b: list[int]) -> np.ndarray:
    return (np.array(a, np.int64)[:, None] * _SIDE + np.array(b, np.int64)[None, :]).ravel()


def merged_pairs(codes: list[np.ndarray], links: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with their summed numbers."""
    every = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    weights = np.concatenate(links) if links else np.zeros(0, np.int64)
    distinct, place = np.unique(every, return_inverse=True)
    return distinct, np.bincount(place, weights, len(distinct)).astype(np.int64)


def compose(parts: list[Fragment]) -> Fragment:
    """The fragment of neighbouring ranges, first to last."""
    cut = False
    prefix_a, prefix_b, open_a, open_b = [], [], [], []
    groups, codes, links = [], [], []
    n_groups = n_links = 0
    for part in parts:
        open_a, open_b = open_a + list(part.prefix_a), open_b + list(part.prefix_b)
        if not part.cut:
            continue
        if not cut:
            prefix_a, prefix_b = open_a, open_b
        elif open_a:
            # what the ranges before left open ends at this one's first common end
            groups.append(group_text(open_a, open_b))
            codes.append(pair_codes(open_a, open_b))
            links.append(np.ones(len(codes[-1]), np.int64))
            n_groups, n_links = n_groups + 1, n_links + len(codes[-1])
        if part.n_groups:
            groups.append(part.groups)
            codes.append(np.asarray(part.codes, np.int64))
            links.append(np.asarray(part.links, np.int64))
        n_groups, n_links = n_groups + part.n_groups, n_links + part.n_links
        open_a, open_b, cut = list(part.suffix_a), list(part.suffix_b), True
    if not cut:
        prefix_a, prefix_b, open_a, open_b = open_a, open_b, [], []
    return Fragment(
        all(part.valid for part in parts),
        cut,
        prefix_a,
        prefix_b,
        sum(part.n_a for part in parts),
        sum(part.n_b for part in parts),
        n_groups,
        n_links,
        ";".join(groups),
        *merged_pairs(codes, links),
        open_a,
        open_b,
    )


def _byte_alphabet() -> dict[str, int]:
    """Character of each byte in byte-level vocabularies: printable ones stand for themselves, the
    others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


class Aligner:
    """Both tokenizers and the words encoded so far."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pieces)
        alphabet = _byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.a_bytes[number] = bytes(alphabet[c] for c in token)
        self.b_bytes = []
        for number in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(number)
            if re.search("[^▁]▁", piece):
                raise ValueError(f"the piece {piece!r} reaches across words")
            whole = bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode()
            self.b_bytes.append(whole)
        self.a_sizes = np.array([len(t) for t in self.a_bytes])
        self.b_sizes = np.array([len(t) for t in self.b_bytes])
        # ids as the groups' text lists them, each with what may follow it
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.listed = [f"{n}{mark}" for n in range(most) for mark in ",|;"]
        self.listed_sizes = np.array([len(t) for t in self.listed])
        self._remember([])

    def _encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Token ids of texts that begin with a space, which B adds itself."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return a, self.b.encode([t[1:] for t in texts], num_threads=1)

    def _groups(self, text: str) -> list[tuple[int, int, list[int], list[int]]] | None:
        """(start, end, A ids, B ids) of each group; None if the tokens' bytes are not the text's."""
        (a,), (b,) = self._encode([text])
        a_parts, b_parts = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        whole = text.encode()
        if b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            return None
        groups, start, i, j, at_a, at_b = [], 0, 0, 0, 0, 0
        from_a = from_b = 0
        while i < len(a):
            if at_a <= at_b:
                at_a, i = at_a + len(a_parts[i]), i + 1
            while at_b < at_a:
                at_b, j = at_b + len(b_parts[j]), j + 1
            if at_a == at_b:
                groups.append((start, at_a, a[from_a:i], b[from_b:j]))
                start, from_a, from_b = at_a, i, j
        return groups

    def _remember(self, parts: list[Words]) -> None:
        """The words known from now on, numbered by their place."""
        self.names = list(chain.from_iterable(p.words for p in parts))
        self.places = {word: n for n, word in enumerate(self.names)}
        self.again = np.zeros(len(self.names), bool)
        self.counts, self.codes, self.valid = np.zeros((0, 5), np.int64), np.zeros(0, np.int64), self.again[:0]
        self.groups = pa.array([], pa.string())
        self._append(parts)

    def _append(self, parts: list[Words]) -> None:
        self.groups = pa.concat_arrays([self.groups, *[p.groups for p in parts]])
        self.counts = np.concatenate([self.counts, *[p.counts for p in parts]])
        self.codes = np.concatenate([self.codes, *[p.codes for p in parts]])
        self.valid = np.concatenate([self.valid, *[p.valid for p in parts]])
        links = self.counts[:, 3]
        self.starts = np.cumsum(links) - links

    def _words(self, words: list[str]) -> Iterator[Words]:
        """The alignments of words, in no particular order."""
        # plain words are encoded many at a time: tokens do not reach across their ends
        plain, others = [], []
        for w in words:
            (plain if w[0] == " " and w[1:] == w.strip() != "" else others).append(w)
        if plain:
            texts = ["".join(plain[low : low + 256]) for low in range(0, len(plain), 256)]
            yield from self._split(plain, *self._encode(texts))
        if others:
            for word, a, b in zip(others, *self._encode(others)):
                yield from self._split([word], [a], [b])

    def _split(self, words: list[str], a: list[list[int]], b: list[list[int]]) -> Iterator[Words]:
        """The alignments of consecutive words from their tokens."""
        raw = [w.encode() for w in words]
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a, b))
        whole = b"".join(raw)
        same = all(
            b"".join(map(names.__getitem__, ids.tolist())) == whole
            for names, ids in ((self.a_bytes, a), (self.b_bytes, b))
        )
        if not same and len(words) > 1:
            half = len(words) // 2
            for part in (words[:half], words[half:]):
                yield from self._split(part, *self._encode(["".join(part)]))
            return
        if not same:
            counts = np.array([[0, 0, 0, 0, len(whole)]])
            yield Words(words, counts, pa.array([""]), np.zeros(0, np.int64), np.zeros(1, bool))
            return
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        # the group of each token, and the tokens of each group
        a_group, b_group = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        a_count, b_count = np.bincount(a_group), np.bincount(b_group)
        a_first, b_first = np.cumsum(a_count) - a_count, np.cumsum(b_count) - b_count
        times = b_count[a_group]
        links = np.cumsum(times)
        partner = np.repeat(b_first[a_group] - links + times, times) + np.arange(links[-1])
        codes = np.repeat(a, times) * _SIDE + b[partner]
        # tokens in the order of the groups' text, A's before B's, each with what follows it
        marks = np.concatenate([
            np.where(np.arange(len(a)) == (a_first + a_count - 1)[a_group], 1, 0),
            np.where(np.arange(len(b)) == (b_first + b_count - 1)[b_group], 2, 0),
        ])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        listed = (3 * np.concatenate([a, b]) + marks)[order]
        text = "".join(map(self.listed.__getitem__, listed.tolist()))
        sizes = np.array([len(r) for r in raw])
        last = np.searchsorted(ends, np.cumsum(sizes)) + 1
        before = [np.concatenate([[0], np.cumsum(c)]) for c in (a_count, b_count, a_count * b_count)]
        until = [np.concatenate([[0], c[last]]) for c in before]
        counts = [*(np.diff(c) for c in until[:2]), np.diff(last, prepend=0), np.diff(until[2]), sizes]
        at = np.concatenate([[0], np.cumsum(self.listed_sizes[listed])])[until[0] + until[1]]
        offsets = pa.py_buffer(at.astype(np.int32))
        groups = pa.StringArray.from_buffers(len(words), offsets, pa.py_buffer(text.encode()))
        yield Words(words, np.stack(counts, axis=1), groups, codes, np.ones(len(words), bool))

    def _forget(self) -> None:
        """Only words that were asked for more than once are kept, and no long ones."""
        if len(self.names) <= 2 * WORDS and len(self.codes) <= WORD_LINKS:
            return
        kept = [n for n in np.flatnonzero(self.again).tolist() if len(self.names[n]) <= WORD_CHARS][-WORDS:]
        at = np.array(kept, np.int64)
        codes = self.codes[self._links(at)]
        if len(codes) > WORD_LINKS // 2:
            self._remember([])
            return
        names, groups = [self.names[n] for n in kept], self.groups.take(pa.array(at))
        self._remember([Words(names, self.counts[at], groups, codes, self.valid[at])])

    def _links(self, at: np.ndarray) -> np.ndarray:
        """Where the codes of the words at these places are."""
        links = self.counts[at, 3]
        ends = np.cumsum(links)
        return np.repeat(self.starts[at] - ends + links, links) + np.arange(links.sum())

    def known(self, cuts: list[list[str]]) -> dict[str, int]:
        """The places of all words of texts that are cut into words, valid until the next call."""
        self._forget()
        wanted = set().union(*cuts)
        new = [w for w in wanted if w not in self.places]
        found = [self.places[w] for w in wanted.difference(new)]
        self.again[found] = True
        for low in range(0, len(new), 10_000):
            parts = list(self._words(new[low : low + 10_000]))
            for part in parts:
                self.places.update(zip(part.words, range(len(self.names), len(self.names) + len(part.words))))
                self.names.extend(part.words)
            self._append(parts)
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        return self.places

    def places_of(self, texts: list[str]) -> list[np.ndarray]:
        """The places of each text's words; the texts begin with a space, or are empty."""
        others = {n: _PLACE.split(t) for n, t in enumerate(texts) if t and _crowded(t)}
        single = [n for n, t in enumerate(texts) if t and n not in others]
        cut = pc.split_pattern(pa.array([texts[n][1:] for n in single], pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        distinct = [" " + word for word in coded.dictionary.to_numpy(zero_copy_only=False)]
        known = self.known([distinct, *others.values()])
        at = np.array([known[w] for w in distinct], np.int64)[coded.indices.to_numpy()]
        ends = cut.offsets.to_numpy()
        found = [np.zeros(0, np.int64)] * len(texts)
        for n, low, high in zip(single, ends, ends[1:]):
            found[n] = at[low:high]
        for n, words in others.items():
            found[n] = np.array([known[w] for w in words], np.int64)
        return found

    def whole(self, places: list[int] | np.ndarray) -> Fragment:
        """The fragment of the words at these places."""
        at = np.asarray(places)
        distinct, links = np.unique(self.codes[self._links(at)], return_counts=True)
        numbers = self.counts[at, :4].sum(axis=0).tolist()
        # the taken groups follow one another in their buffer
        taken = self.groups.take(pa.array(at))
        size = int(np.frombuffer(taken.buffers()[1], np.int32)[len(at)])
        text = taken.buffers()[2][: max(size - 1, 0)].to_pybytes().decode() if size else ""
        return Fragment(bool(self.valid[at].all()), True, [], [], *numbers, text, distinct, links, [], [])

    def range(self, words: list[str], known: dict[str, int], low: int, high: int) -> Fragment:
        """The fragment of the tokens that end behind byte `low` and not behind `high`."""
        places = np.array([known[w] for w in words])
        ends = np.cumsum(self.counts[places, 4])
        begins = ends - self.counts[places, 4]
        inside = (low <= begins) & (ends <= high)
        parts = []
        # the words that an end of the range cuts, and those inside between them
        cut = np.flatnonzero(~inside & (begins < high) & (ends > low)).tolist()
        start = 0
        for n in [*cut, len(words)]:
            whole = start + np.flatnonzero(inside[start:n])
            if len(whole):
                parts.append(self.whole(places[whole]))
            if n < len(words):
                at = int(begins[n])
                parts.append(self._cut_word(words[n], low - at, high - at))
            start = n + 1
        return compose(parts)

    def _cut_word(self, text: str, low: int, high: int) -> Fragment:
        """The same for one word that reaches beyond the range."""
        groups = self._groups(text)
        if groups is None:
            return Fragment(False, True, [], [], 0, 0, 0, 0, "", [], [], [], [])
        parts = []
        for start, end, x, y in groups:
            own_a = _ending(x, start, self.a_bytes, low, high)
            own_b = _ending(y, start, self.b_bytes, low, high)
            counts = len(own_a), len(own_b)
            if end <= low or start >= high:
                continue
            if start >= low and end <= high:
                codes, links = merged_pairs([c := pair_codes(x, y)], [np.ones(len(c), np.int64)])
                part = Fragment(
                    True, True, [], [], *counts, 1, len(c), group_text(x, y), codes, links, [], []
                )
            elif end <= high:
                part = Fragment(True, True, own_a, own_b, *counts, 0, 0, "", [], [], [], [])
            elif start >= low:
                part = Fragment(True, True, [], [], *counts, 0, 0, "", [], [], own_a, own_b)
            else:
                part = Fragment(True, False, own_a, own_b, *counts, 0, 0, "", [], [], [], [])
            parts.append(part)
        return compose(parts)


def _ending(ids: list[int], at: int, sizes: list[bytes], low: int, high: int) -> list[int]:
    """The tokens, of which the first begins at `at`, that end in the range."""
    own = []
    for number in ids:
        at += len(sizes[number])
        if low < at <= high:
            own.append(number)
    return own


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(files: Broadcast) -> Aligner:
    """One per worker process."""
    key = files.id if hasattr(files, "id") else id(files)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*files.value)
    return _ALIGNERS[key]


def _crowded(text: str) -> bool:
    """Whether a text that begins with a space has blanks beside others, or beside an end."""
    if any(pair in text for pair in ("  ", " \n", "\n ")) or text[-1].isspace() or text[1].isspace():
        return True
    # the slow pattern only where there is rarer white space
    return bool(_OTHER_BLANKS.search(text) and _BLANKS.search(text, 1))


def words_of(text: str) -> list[str]:
    """The words of a text that begins with a space, each with the space before it."""
    if _crowded(text):
        return _PLACE.split(text)
    return [" " + word for word in text[1:].split(" ")]


def ranges(text: str, chunk: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, low, high) per range of a text that begins with a space: the range and the words
    around its ends, in code points. An end without a place between words on either side, as near as
    `chunk`, is left out, so that no stretch is encoded more than three times."""
    ends, around = [0], [(0, 0)]
    for at in range(chunk, len(text), chunk):
        before = None
        for back in (1_000, chunk):
            found = [m.start() for m in _PLACE.finditer(text, max(0, at - back), at)]
            if found:
                before = found[-1]
                break
        after = _PLACE.search(text, at, at + chunk)
        if before is not None and after:
            ends.append(at)
            around.append((before, after.start()))
    ends.append(len(text))
    around.append((len(text), len(text)))
    for n in range(len(ends) - 1):
        yield around[n][0], around[n + 1][1], ends[n], ends[n + 1]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    low = size = 0
    for n, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_CHARS:
            yield low, n + 1
            low, size = n + 1, 0
    if low < len(texts):
        yield low, len(texts)


_DONE = (
    "row long, doc_id long, chunk_no long, text string, low long, high long, n_a long, n_b long, "
    "n_groups long, n_links long, groups_sha256 string, codes array<long>, links array<long>"
)
_DONE_TYPES = [
    pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
    pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()),
]


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(column), kind) for column, kind in zip(columns, types)], names
    )


def _finished(fragment: Fragment) -> tuple:
    """The columns of a whole text behind its ids: numbers, digest and pairs."""
    if not fragment.valid or not fragment.n_a:
        return 0, 0, 0, 0, "", [], []
    digest = hashlib.sha256(fragment.groups.encode()).hexdigest()
    return (
        fragment.n_a, fragment.n_b, fragment.n_groups, fragment.n_links, digest, fragment.codes,
        fragment.links,
    )


def _document_aligner(files: Broadcast, chunk: int):
    """Whole texts of one range; of longer ones a row per range, still to be encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files)
        names = _names(_DONE)
        for batch in batches:
            numbers, ids, texts = (column.to_pylist() for column in batch.columns)
            texts = [" " + t if t else "" for t in texts]
            for low, high in _slices(texts):
                rows = []
                found = aligner.places_of([t if len(t) <= chunk else "" for t in texts[low:high]])
                for n, places in zip(range(low, high), found):
                    key = numbers[n], ids[n]
                    if len(places):
                        whole = aligner.whole(places)
                        rows.append((*key, None, None, None, None, *_finished(whole)))
                    elif not texts[n]:
                        rows.append((*key, None, None, None, None, 0, 0, 0, 0, "", [], []))
                    else:
                        for at, (first, last, own, end) in enumerate(ranges(texts[n], chunk)):
                            text = texts[n][first:last]
                            begin = len(texts[n][first:own].encode())
                            size = len(texts[n][own:end].encode())
                            rows.append((*key, at, text, begin, begin + size, *[None] * 7))
                yield _batch(rows, names, _DONE_TYPES)

    return run


def _range_aligner(files: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files)
        names = ["row", "doc_id", "chunk_no", *Fragment._fields]
        types = [pa.int64()] * 3 + _FRAGMENT_TYPES
        for batch in batches:
            every = batch.to_pylist()
            for first, last in _slices([row["text"] for row in every]):
                rows = every[first:last]
                cuts = [words_of(row["text"]) for row in rows]
                known = aligner.known(cuts)
                found = [
                    (
                        *(row["row"], row["doc_id"], row["chunk_no"]),
                        *aligner.range(cut, known, row["low"], row["high"]),
                    )
                    for row, cut in zip(rows, cuts)
                ]
                yield _batch(found, names, types)

    return run


def _composer(table: pa.Table) -> pa.Table:
    """One fragment of the neighbours that a group holds; chunk_no becomes the group's number."""
    rows = sorted(table.to_pylist(), key=lambda row: row["chunk_no"])
    parts = [Fragment(*[row[field] for field in Fragment._fields]) for row in rows]
    first = rows[0]
    own = (first["row"], first["doc_id"], first["chunk_no"] // FAN, *compose(parts))
    names = ["row", "doc_id", "chunk_no", *Fragment._fields]
    return pa.Table.from_batches([_batch([own], names, [pa.int64()] * 3 + _FRAGMENT_TYPES)])


def _closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [n for n in _names(_DONE) if n not in ("chunk_no", "text", "low", "high")]
    types = [t for n, t in zip(_names(_DONE), _DONE_TYPES) if n in names]
    for batch in batches:
        for row in batch.to_pylist():
            whole = Fragment(*[row[field] for field in Fragment._fields])
            yield _batch([(row["row"], row["doc_id"], *_finished(whole))], names, types)


def _composed(long: DataFrame, files: Broadcast, scratch: Scratch) -> DataFrame:
    """Finished rows of the texts that are cut into ranges: a tree of compositions."""
    shape = f"row long, doc_id long, chunk_no long, {FRAGMENT}"
    level = scratch.store(
        long.select("row", "doc_id", "chunk_no", "text", "low", "high")
        .repartition("row", "chunk_no")
        .mapInArrow(_range_aligner(files), shape),
        "fragments",
    )
    last = level.agg(F.max("chunk_no")).first()[0]
    while last:
        above = scratch.store(
            level.withColumn("parent", F.expr(f"chunk_no div {FAN}"))
            .groupBy("row", "parent")
            .applyInArrow(lambda table: _composer(table.drop_columns("parent")), shape),
            "fragments",
        )
        scratch.drop(level)
        level, last = above, last // FAN
    kept = [c for c in _DONE.split(", ") if c.split()[0] not in ("chunk_no", "text", "low", "high")]
    done = scratch.store(level.mapInArrow(_closer, ", ".join(kept)), "composed")
    scratch.drop(level)
    return done


def _hot_from(pairs: DataFrame, hot_pairs: int) -> int:
    """The smallest power of two such that at most `hot_pairs` pairs are in as many documents."""
    sizes = pairs.groupBy(F.floor(F.log2("documents")).cast("int").alias("power")).count()
    reached, least = 0, 62
    for row in sorted(sizes.collect(), reverse=True):
        reached += row["count"]
        if reached > hot_pairs:
            break
        least = row["power"]
    return 1 << least


def aligned(
    docs: DataFrame, folder: str = TOKENIZERS, chunk: int = CHUNK, hot_pairs: int = HOT_PAIRS
) -> tuple[DataFrame, DataFrame]:
    """Alignments of `docs` (doc_id, text; others ignored), and the counted pairs of the corpus.

    The first is (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row: tokens of
    each side, groups, links; how many links are the most frequent ones of their A id, ties
    included; and the sum of their pairs' counts. The second is (a, b, documents): in how many rows a pair of ids is
    linked. A is `byte_bpe_50k.json` and B `piece_bpe_32k.model` in `folder` of the driver.

    Null and empty texts, and texts whose tokens' bytes are not a space and the text (they hold the
    piece mark U+2581), have zeros and an empty digest. Repeated rows are documents of their own. A
    text without a single space between other characters is one range, whatever its length.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    read = [open(f"{folder}/{name}", "rb").read() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    files = spark.sparkContext.broadcast(tuple(read))
    first = scratch.store(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
        ).mapInArrow(_document_aligner(files, chunk), _DONE),
        "first",
    )
    done = first.filter("chunk_no is null").drop("chunk_no", "text", "low", "high")
    long = first.filter("chunk_no is not null")
    if not long.isEmpty():
        done = done.unionByName(_composed(long, files, scratch))
    counted = scratch.store(
        done.select(F.explode("codes").alias("code"))
        .groupBy("code")
        .agg(F.count(F.lit(1)).alias("documents")),
        "pairs",
    )
    own = counted.withColumn("a", F.shiftrightunsigned("code", 32))
    # at most one row per id of A's vocabulary
    most = F.broadcast(own.groupBy("a").agg(F.max("documents").alias("most")))
    pairs = own.join(most, "a").select(
        "code", "documents", (F.col("documents") == F.col("most")).cast("long").alias("best")
    )
    least = _hot_from(counted, hot_pairs)
    entries = done.select("row", F.inline(F.arrays_zip("codes", "links")).alias("code", "links"))
    sums = [
        F.sum(F.col("links") * F.col("best")).alias("n_best"),
        F.sum(F.col("links") * F.col("documents")).alias("count_sum"),
    ]
    hot = pairs.filter(F.col("documents") >= least)
    found = entries.join(F.broadcast(hot), "code").groupBy("row").agg(*sums)
    cold = pairs.filter(F.col("documents") < least)
    if not cold.isEmpty():
        rest = entries.join(F.broadcast(hot.select("code")), "code", "left_anti")
        found = (
            found.unionByName(rest.join(cold, "code").groupBy("row").agg(*sums))
            .groupBy("row")
            .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        )
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    result = scratch.store(
        done.join(found, "row", "left").select(
            "doc_id",
            *numbers,
            F.coalesce("n_best", F.lit(0)).alias("n_best"),
            F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
            "groups_sha256",
        ),
        "result",
    )
    scratch.close(result, counted)
    table = counted.select(
        F.shiftrightunsigned("code", 32).alias("a"),
        F.col("code").bitwiseAND(F.lit(_SIDE - 1)).alias("b"),
        "documents",
    )
    return result, table
