"""Column expressions for decoding, tokenising, n-grams and run lengths.

Array expressions refer to whole arrays (`zip_with`, `slice`) and never index an outer
array inside a lambda: when the optimiser inlines the array's definition, an indexed
form would be evaluated once per element.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hexadecimal 0..65535 bare, with a leading 0 or x, and octal with a leading 0.
NUMBER_TOKEN = (
    r"^(?:(?:0|x)?(?:0|[1-9a-f][0-9a-f]{0,3})|0(?:[1-7][0-7]{0,4}|1[0-7]{5}))$"
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row, wherever the optimiser moves it.

    A helper column does not guarantee that: a filter on the result is pushed below the
    projection with the helper's definition copied to each of its uses.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decode_lossy(content: Column) -> Column:
    """UTF-8 text of a BINARY or STRING column; undecodable bytes are dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


@lru_cache(maxsize=1)
def foldings() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(accented characters, their ASCII letters, ligatures with several letters)."""
    single_from, single_to, several = [], [], []
    for point in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        char = chr(point)
        if char != char.lower():
            continue
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if not plain.isalnum():
            continue
        if len(plain) == 1:
            single_from.append(char)
            single_to.append(plain)
        elif plain.isalpha() and unicodedata.category(char).startswith("L"):
            several.append((char, plain))
    return "".join(single_from), "".join(single_to), tuple(several)


def fold_to_ascii(text: Column) -> Column:
    """Lower-cased text with accents removed and everything else outside ASCII dropped."""
    accented, plain, ligatures = foldings()
    members = "".join(char for char, _ in ligatures)

    def spelled(lowered: Column) -> Column:
        expanded = lowered
        for char, letters in ligatures:
            expanded = F.replace(expanded, F.lit(char), F.lit(letters))
        return F.when(lowered.rlike(f"[{members}]"), expanded).otherwise(lowered)

    def folded(lowered: Column) -> Column:
        letters = F.translate(spelled(lowered), accented, plain)
        return F.when(
            lowered.rlike(r"[^\x00-\x7F]"), F.regexp_replace(letters, r"[^\x00-\x7F]+", "")
        ).otherwise(lowered)

    return bind(F.lower(text), folded)


def ascii_words(text: Column) -> Column:
    """Words of two or more of [a-z0-9_] after accent folding."""
    return F.regexp_extract_all(fold_to_ascii(text), F.lit(r"[a-z0-9_]{2,}"), F.lit(0))


def unicode_words(text: Column, shortest: int = 2) -> Column:
    """Words of letters, digits and underscore in any script, lower-cased."""
    return F.regexp_extract_all(
        F.lower(text), F.lit(r"[\p{L}\p{N}_]{%d,}" % shortest), F.lit(0)
    )


def is_number_token(word: Column) -> Column:
    return word.rlike(NUMBER_TOKEN)


def drop_number_tokens(words: Column) -> Column:
    return F.filter(words, lambda w: ~is_number_token(w))


def whitespace_tokens(text: Column) -> Column:
    """Tokens between white space; empty text has none."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def simple_words(text: Column, shortest: int = 2, longest: int = 15) -> Column:
    """Lower-case alphabetic tokens of bounded length that do not start with an underscore."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\w&&[^\d]]+"), F.lit(0))
    return F.filter(
        tokens,
        lambda t: F.length(t).between(shortest, longest) & ~t.startswith("_"),
    )


def without_last(array: Column, count: int) -> Column:
    return F.slice(array, 1, F.greatest(F.size(array) - count, F.lit(0)))


def without_first(array: Column, count: int) -> Column:
    return F.slice(array, count + 1, F.greatest(F.size(array) - count, F.lit(0)))


def _extend(shorter: Column, words: Column, length: int) -> Column:
    """n-grams of `length` from those one word shorter."""
    return F.zip_with(
        without_last(shorter, 1),
        without_first(words, length - 1),
        lambda head, word: F.concat_ws(" ", head, word),
    )


def with_ngrams(df: DataFrame, words: str, low: int, high: int, out: str = "ngrams") -> DataFrame:
    """Adds `out`: all n-grams of `low`..`high` words, joined by one space."""
    names = {1: words}
    for length in range(2, high + 1):
        names[length] = f"_{out}_{length}"
        df = df.withColumn(
            names[length], _extend(F.col(names[length - 1]), F.col(words), length)
        )
    df = df.withColumn(out, F.concat(*[F.col(names[n]) for n in range(low, high + 1)]))
    return df.drop(*[name for n, name in names.items() if n > 1])


def explode_values(df: DataFrame, array: str, out: str, keep: list[str]) -> DataFrame:
    """One row per element.

    The outer form is used because the inner form adds a size filter that is pushed below
    the projections and evaluates the array a second time.
    """
    return df.select(*keep, F.explode_outer(array).alias(out)).filter(F.col(out).isNotNull())


def with_run_lengths(df: DataFrame, array: str, out: str) -> DataFrame:
    """Adds `out`: array<struct<item, n>> of the distinct elements and their counts, per row.

    Sort and run-length inside the row: counting per document needs no shuffle.
    """
    item_type = df.schema[array].dataType.elementType.simpleString()
    df = df.withColumn("_sorted", F.sort_array(array))
    before = F.concat(F.array(F.lit(None).cast(item_type)), without_last(F.col("_sorted"), 1))
    marks = F.zip_with("_sorted", before, lambda a, b: F.when(~a.eqNullSafe(b), a))
    starts = F.filter(
        F.transform(marks, lambda a, i: F.struct(a.alias("item"), i.alias("at"))),
        lambda s: s["item"].isNotNull(),
    )
    df = df.withColumn("_starts", starts).withColumn("_total", F.size("_sorted"))
    ends = F.concat(
        F.transform(without_first(F.col("_starts"), 1), lambda s: s["at"]), F.array("_total")
    )
    runs = F.zip_with(
        "_starts",
        ends,
        lambda s, end: F.struct(s["item"].alias("item"), (end - s["at"]).alias("n")),
    )
    # an empty array has an end but no start
    return df.withColumn(out, F.filter(runs, lambda r: r["item"].isNotNull())).drop(
        "_sorted", "_starts", "_total"
    )
