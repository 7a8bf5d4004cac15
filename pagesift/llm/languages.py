"""Language of mixed text: script ranges, word scores, Viterbi with a switching penalty.

Learned from labelled texts, at most about SAMPLE per language (a documented bound for fitting
alone): how often each language uses each script, and hashed letter n-grams of its words. A text's
words are scored for each language that uses their script; Viterbi with a penalty for each switch
labels spans of words, and the language of most letters is the text's. Texts of a batch step
through Viterbi together, word by word, so there is no Python per word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.bytewords import mix

#: labelled texts of a language used for fitting, about
SAMPLE = 3000
BUCKET_BITS = 16
GRAMS = (1, 2, 3, 4)
#: added to every count
SMOOTHING = 0.5
#: cost of a change of language between two words, in units of log likelihood
SWITCH = 6.0
#: a language uses a script if at least this share of its words does
SCRIPT_SHARE = 0.01
SLICE_CHARS = 1_000_000
UNKNOWN = "und"

# First code point of Unicode ranges and the script that begins there; 0 is no letter.
_SCRIPTS = (
    (0x0, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xB5, 1), (0xB6, 0),
    (0xBA, 1), (0xBB, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1), (0x2B0, 0),
    (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8),
    (0xE00, 9), (0xE80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 0), (0x1E00, 1), (0x1F00, 2),
    (0x2000, 0), (0x3040, 12), (0x30A0, 13), (0x3100, 0), (0x3400, 14), (0xA000, 0), (0xAC00, 11),
    (0xD7A4, 0), (0xF900, 14), (0xFB00, 1), (0xFB07, 0), (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1),
    (0xFF5B, 0), (0xFF66, 13), (0xFFA0, 0), (0x20000, 14), (0x32400, 0),
)
#: letters of all other scripts, with the marks that are written with them
OTHER = 15
_FIRST = np.array([first for first, _ in _SCRIPTS])
_SCRIPT = np.array([script for _, script in _SCRIPTS], np.int8)
SCRIPTS = OTHER + 1


def _is_letter(point: int) -> bool:
    kind = unicodedata.category(chr(point))[0]
    # marks of no script (accents, variation selectors of signs) are no letters
    return kind == "L" or kind == "M" and not unicodedata.name(chr(point), "").startswith(
        ("COMBINING ", "VARIATION ", "ENCLOSING ")
    )


_TABLE = _SCRIPT[np.searchsorted(_FIRST, np.arange(0x110000), "right") - 1]
_TABLE[[p for p in np.flatnonzero(_TABLE == 0).tolist() if _is_letter(p)]] = OTHER


class Model(NamedTuple):
    languages: list[str]
    #: log likelihood of each bucket, by language
    grams: np.ndarray
    #: whether a language uses a script
    scripts: np.ndarray


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Script of each code point, 0 for no letter; letters of other scripts count as OTHER."""
    return _TABLE[points]


class Words(NamedTuple):
    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    first: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Runs of letters of one script, never across texts; `first` is the first word of each text."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(
        "".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32
    ).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)
    kind = scripts_of(points)
    change = np.ones(len(points) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[edges] = True
    bounds = np.flatnonzero(change)
    starts, ends = bounds[:-1], bounds[1:]
    script = kind[starts] if len(starts) else kind
    letters = script > 0
    starts, ends, script = starts[letters], ends[letters], script[letters]
    return Words(points, starts, ends, script, np.searchsorted(starts, edges))


def gram_buckets(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bucket) of the n-grams of each size, with a blank on either side of a word."""
    sizes = words.ends - words.starts + 2
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    word = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(offsets[-1]) - offsets[word]
    inside = (within > 0) & (within < sizes[word] - 1)
    padded = np.full(offsets[-1], 32, np.uint64)
    at = words.starts[word] + within - 1
    padded[inside] = words.points[at[inside]].astype(np.uint64)
    code = np.zeros(len(padded), np.uint64)
    for size in range(1, max(GRAMS) + 1):
        count = len(padded) - size + 1
        if count <= 0:
            return
        code = code[:count] * np.uint64(0x9E3779B97F4A7C15) + padded[size - 1 :]
        if size in GRAMS:
            whole = within[:count] + size <= sizes[word[:count]]
            bucket = mix(code[whole] + np.uint64(size)) >> np.uint64(64 - BUCKET_BITS)
            yield word[:count][whole], bucket.astype(np.int64)


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    lengths = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        done = lengths[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(lengths, done + SLICE_CHARS, "right")))
        yield [t or "" for t in texts.slice(low, high - low).to_pylist()]
        low = high


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language: n-grams by bucket, words by script from -1 down."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = batch.column(1).to_pylist()
        low = 0
        for texts in _slices(batch.column(0)):
            own = lang[low : low + len(texts)]
            low += len(texts)
            for name in set(own):
                words = words_of([t for t, x in zip(texts, own) if x == name])
                sums = counts.setdefault(name, np.zeros((1 << BUCKET_BITS) + SCRIPTS, np.int64))
                sums[:SCRIPTS] += np.bincount(words.script, minlength=SCRIPTS)
                for _, bucket in gram_buckets(words):
                    sums[SCRIPTS:] += np.bincount(bucket, minlength=1 << BUCKET_BITS)
    for name, sums in counts.items():
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(used)), pa.array(used - SCRIPTS), pa.array(sums[used])],
            ["lang", "bucket", "n"],
        )


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of rows (doc_id, text, lang); null texts and languages are left out.

    Its tables are bounded by the number of languages.
    """
    known = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, 1 << BUCKET_BITS)), np.zeros((0, SCRIPTS), bool))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    bound = F.lit(0.0)
    for lang, n in sizes.items():
        bound = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(bound)
    counts = (
        known.filter(draw < bound)
        .select("text", "lang")
        .mapInArrow(_counter, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(counts["lang"].unique())
    table = np.zeros((len(languages), SCRIPTS + (1 << BUCKET_BITS)))
    place = {name: k for k, name in enumerate(languages)}
    table[counts["lang"].map(place), counts["bucket"] + SCRIPTS] = counts["n"]
    words, grams = table[:, :SCRIPTS], table[:, SCRIPTS:] + SMOOTHING
    uses = words / np.maximum(words.sum(1, keepdims=True), 1) >= SCRIPT_SHARE
    return Model(languages, np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32), uses)


def label_words(model: Model, words: Words, switch: float = SWITCH) -> np.ndarray:
    """Language of each word; texts step through Viterbi together."""
    count, kinds = len(words.starts), len(model.languages)
    scores = np.zeros((count, kinds), np.float32)
    table = np.ascontiguousarray(model.grams.T)
    for word, bucket in gram_buckets(words):
        values = table[bucket]
        for k in range(kinds):
            scores[:, k] += np.bincount(word, values[:, k], minlength=count)
    # languages that do not use the script of a word are out, unless none does
    allowed = model.scripts.T[words.script]
    allowed[~allowed.any(1)] = True
    scores[~allowed] -= 1000.0
    sizes = np.diff(words.first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = words.first[:-1][order], sizes[order]
    best = np.zeros((len(order), kinds), np.float32)
    came = np.zeros((count, kinds), np.int16)
    stay = np.arange(kinds, dtype=np.int16)
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), "left")
    for step in range(longest):
        n = alive[step]
        at = begin[:n] + step
        if step:
            top = best[:n].argmax(1).astype(np.int16)
            jump = best[np.arange(n), top][:, None] - switch
            moved = jump > best[:n]
            came[at] = np.where(moved, top[:, None], stay)
            best[:n] = np.where(moved, jump, best[:n])
        best[:n] += scores[at]
    label = np.zeros(count, np.int16)
    state = best.argmax(1).astype(np.int16) if kinds else np.zeros(len(order), np.int16)
    for step in range(longest - 1, -1, -1):
        n = alive[step]
        at = begin[:n] + step
        label[at] = state[:n]
        state[:n] = came[at, state[:n]]
    return label


def _predictor(shared, switch: float, spans: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, values, found = [], [], []
            for texts in _slices(batch.column(0)):
                words = words_of(texts)
                label = label_words(model, words, switch) if model.languages else None
                letters = words.ends - words.starts
                text = np.repeat(np.arange(len(texts)), np.diff(words.first))
                votes = np.zeros((len(texts), max(len(model.languages), 1)))
                if label is not None:
                    np.add.at(votes, (text, label), letters)
                total = votes.sum(1)
                winner = votes.argmax(1)
                share = votes[np.arange(len(texts)), winner] / np.maximum(total, 1)
                names += [
                    model.languages[w] if t else UNKNOWN for w, t in zip(winner.tolist(), total.tolist())
                ]
                values += share.tolist()
                if spans:
                    found += _spans(texts, words, label, model.languages)
            columns = [pa.array(names, pa.string()), pa.array(values, pa.float64())]
            fields = ["lang_pred", "score"]
            if spans:
                columns.append(pa.array(found, kind))
                fields.append("spans")
            yield pa.RecordBatch.from_arrays(
                columns + batch.columns[1:], fields + batch.schema.names[1:]
            )

    return run


def _spans(texts, words: Words, label, languages) -> list[list[dict]]:
    """Runs of words of one language, in code points of the lower-cased text."""
    edges = np.concatenate([[0], np.cumsum([len(t.lower()) for t in texts])])
    found = []
    for k in range(len(texts)):
        own: list[dict] = []
        for w in range(words.first[k], words.first[k + 1]) if label is not None else []:
            name = languages[label[w]]
            end = int(words.ends[w] - edges[k])
            if own and own[-1]["lang"] == name:
                own[-1]["end"] = end
            else:
                own.append({"start": int(words.starts[w] - edges[k]), "end": end, "lang": name})
        found.append(own)
    return found


def identify(
    docs: DataFrame, model: Model, keep: list[str], switch: float = SWITCH, spans: bool = False
) -> DataFrame:
    """The columns `keep` of `docs` with lang_pred, score and, if asked for, the spans of languages.

    score is the share of the text's letters in the winning language's spans. A null text, one
    without letters, and every text if the model knows no language, is `und` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select("text", *keep)
    kept = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields
    )
    more = ", spans array<struct<start:long,end:long,lang:string>>" if spans else ""
    return inner.mapInArrow(
        _predictor(shared, switch, spans), f"lang_pred string, score double{more}, {kept}"
    ).select(*keep, "lang_pred", "score", *(["spans"] if spans else []))


def remainder(divisor: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor, F.lit(-1))


def predicted_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of `docs` (doc_id, text, lang).

    Learns from rows whose crc32 of doc_id leaves another remainder than 2 modulo 4; a null doc_id
    is neither learned from nor held out.
    """
    rest = remainder(4)
    model = fit(docs.filter((rest >= 0) & (rest != 2)))
    return identify(
        docs.select("text", "doc_id", (rest == 2).alias("held_out")), model, ["doc_id", "held_out"]
    )
