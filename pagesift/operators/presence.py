"""Keyword and rule presence.

Dictionaries of at most MAX_DICTIONARY entries are read to the driver once and used as literal
sets, which Spark evaluates by hash lookup in the row: no explode, no join, no shuffle. Larger
keyword tables are joined with the distinct words of each sample, and so are larger rule sets as far as
they are bounded words. Other rules go to the tasks in blocks, each as an automaton that finds all its
literals in one pass over a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.text import unicode_words, with_ngrams
from pagesift.operators.joins import equi_join
from pagesift.sources.libsvm import FEATURES_TYPE, feature, ordered

MAX_DICTIONARY = 10_000
#: rules of one automaton, about
RULE_BLOCK = 50_000
_WORD = re.compile(r"\w+")
_RULE_WORDS = re.compile(r"[a-z0-9]+(?: [a-z0-9]+)*")


def keyword_presence(
    samples: DataFrame,
    keywords: DataFrame,
    content: str = "content",
    out: str = "features",
    limit: int = MAX_DICTIONARY,
) -> DataFrame:
    """Adds features idx:1 for each keyword of the table (idx, keyword), of any size.

    Up to `limit` rows it is `with_keyword_presence`. Beyond, keywords that are single words meet
    the samples' distinct words in a join, one row per sample and word found; the others, which
    are patterns, must be at most `limit`.
    """
    if keywords.limit(limit + 1).count() <= limit:
        return with_keyword_presence(samples, read_dictionary(keywords), content, out)
    is_word = F.col("keyword").rlike(r"(?U)^\w+$")
    words = (
        keywords.filter(is_word)
        .groupBy(F.lower("keyword").alias("_word"))
        .agg(F.min("idx").cast("int").alias("_idx"))
    )
    others = read_dictionary(keywords.filter(~is_word), limit)
    tokens = samples.select(
        "sample_id",
        F.explode(F.array_distinct(unicode_words(F.col(content), shortest=1))).alias("_word"),
    )
    found = (
        equi_join(tokens, words, "_word", "inner", "sample_id")
        .groupBy("sample_id")
        .agg(F.sort_array(F.collect_set(feature(F.col("_idx"), F.lit(1.0)))).alias("_found"))
    )
    return (
        with_keyword_presence(samples, others, content, "_others")
        .join(found, "sample_id", "left")
        .withColumn(out, _merged(F.col("_found"), F.col("_others")))
        .drop("_found", "_others")
    )


def read_dictionary(keywords: DataFrame, limit: int = MAX_DICTIONARY) -> list[tuple[int, str]]:
    """(idx, keyword) pairs in index order; a repeated keyword keeps its lowest index."""
    rows = keywords.select("idx", "keyword").orderBy("idx").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a keyword dictionary holds at most {limit} entries")
    first: dict[str, int] = {}
    for row in rows:
        first.setdefault(row["keyword"], row["idx"])
    return [(idx, keyword) for keyword, idx in first.items()]


def read_rules(rules: DataFrame, limit: int = MAX_DICTIONARY) -> list[tuple]:
    """(idx, literal, fullword, nocase) in index order."""
    rows = rules.select("idx", "keyword", "fullword", "nocase").orderBy("idx").limit(limit + 1)
    found = [tuple(row) for row in rows.collect()]
    if len(found) > limit:
        raise ValueError(f"a rule set holds at most {limit} rules")
    return found


def rule_presence(
    samples: DataFrame,
    rules: DataFrame,
    content: str = "content",
    out: str = "features",
    limit: int = MAX_DICTIONARY,
    block: int = RULE_BLOCK,
) -> DataFrame:
    """`with_rule_presence` for a rule table (idx, keyword, fullword, nocase) of any size.

    Beyond `limit` rules, those that are a bounded single word of either case meet the samples' distinct
    words in a join; no task holds them all. Of the others, blocks of about `block` rules are sent to the
    tasks one after the other; rules with equal patterns share a block. Of equal patterns the lowest
    index wins. Literals must not be empty.
    """
    shape = ["idx", "keyword", "fullword", "nocase"]
    total = rules.count()
    if total <= limit:
        return with_rule_presence(samples, read_rules(rules, limit), content, out)
    bounded = F.col("fullword") & F.col("nocase")
    is_word = F.coalesce(bounded & F.lower("keyword").rlike(r"\A[a-z0-9]+\z"), F.lit(False))
    others = rules.filter(~is_word)
    rest = _with_blocks(samples, others.select(*shape), others.count(), content, "_others", block)
    # rows that share id and text share their words, so an id may repeat or be null
    keyed = rest.withColumn("_text", F.md5(F.col(content).cast("binary")))
    tokens = samples.select(
        "sample_id",
        F.md5(F.col(content).cast("binary")).alias("_text"),
        F.explode(
            F.array_distinct(F.regexp_extract_all(F.lower(content), F.lit("[a-z0-9]+"), F.lit(0)))
        ).alias("_word"),
    )
    words = (
        rules.filter(is_word)
        .groupBy(F.lower("keyword").alias("_word"))
        .agg(F.min("idx").cast("int").alias("_idx"))
    )
    found = (
        equi_join(tokens, words, "_word", "inner", "_text")
        .groupBy(F.col("sample_id").alias("_id"), F.col("_text").alias("_own"))
        .agg(F.collect_set(feature(F.col("_idx"), F.lit(1.0))).alias("_found"))
    )
    same = F.col("sample_id").eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_own"))
    return (
        keyed.join(found, same, "left")
        .withColumn(out, _merged(F.col("_found"), F.col("_others")))
        .drop("_found", "_others", "_text", "_id", "_own")
    )


def _with_blocks(
    samples: DataFrame, rules: DataFrame, total: int, content: str, out: str, block: int
) -> DataFrame:
    """`with_rule_presence` by an automaton for each block of about `block` of `total` rules."""
    if not total:
        return samples.withColumn(out, F.lit(None).cast(FEATURES_TYPE))
    spark = samples.sparkSession
    shape = rules.columns
    blocks = -(-total // block)
    numbered = rules.select(
        *shape, F.pmod(F.xxhash64(F.lower("keyword")), F.lit(blocks)).alias("_block")
    )
    df, names = samples.withColumn("_lowered", F.lower(content)), []
    for number in range(blocks):
        own = numbered.filter(F.col("_block") == number).select(*shape).orderBy("idx", "keyword")
        sent = spark.sparkContext.broadcast([tuple(row) for row in own.collect()])
        names.append(f"_rules_{number}")
        df = df.withColumn(names[-1], _automaton_hits(sent)(F.col("_lowered"), F.col(content)))
    parts = [F.transform(name, lambda idx: feature(idx, F.lit(1.0))) for name in names]
    return df.withColumn(out, _merged(*parts)).drop("_lowered", *names)


_ASCII_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
_AUTOMATA: dict[int, list] = {}


def _automata(rules: list[tuple]) -> list:
    """An automaton, or None, for the lowered text, the text with A-Z lowered, and the text itself.

    The literals of words joined by single spaces are compared with the lowered text, other
    literals as patterns ignore the case of A-Z alone.
    """
    import ahocorasick

    found = [{}, {}, {}]
    for idx, keyword, fullword, nocase in rules:
        lowered = keyword.lower()
        if fullword and nocase and _RULE_WORDS.fullmatch(lowered):
            kind, literal = 0, lowered
        elif nocase:
            kind, literal = 1, keyword.translate(_ASCII_LOWER)
        else:
            kind, literal = 2, keyword
        # equal patterns have the first index; one text may be several patterns
        entries = found[kind].setdefault(literal, {})
        entries.setdefault((bool(fullword), keyword if kind else literal), idx)
    automata = []
    for literals in found:
        automaton = ahocorasick.Automaton() if literals else None
        for literal, entries in literals.items():
            bounded = [idx for (fullword, _), idx in entries.items() if fullword]
            anywhere = [idx for (fullword, _), idx in entries.items() if not fullword]
            automaton.add_word(literal, (len(literal), bounded, anywhere))
        if automaton:
            automaton.make_automaton()
        automata.append(automaton)
    return automata


def _is_alphanumeric(char: str) -> bool:
    return char.isascii() and char.isalnum()


def _found_rules(automaton, text: str) -> Iterator[int]:
    for end, (size, bounded, anywhere) in automaton.iter(text):
        yield from anywhere
        if bounded:
            before, after = end - size, end + 1
            if not (before >= 0 and _is_alphanumeric(text[before])) and not (
                after < len(text) and _is_alphanumeric(text[after])
            ):
                yield from bounded


def _automaton_hits(sent: Broadcast):
    """A function of (lowered text, text) that gives the indexes of the rules found."""

    @F.arrow_udf("array<int>")
    def hits(lowered: pa.Array, content: pa.Array) -> pa.Array:
        key = id(sent.value)
        if key not in _AUTOMATA:
            _AUTOMATA[key] = _automata(sent.value)
        whole, ascii_only, exact = _AUTOMATA[key]
        rows = []
        for low, text in zip(lowered.to_pylist(), content.to_pylist()):
            found: set[int] = set()
            if text is not None:
                if whole:
                    found.update(_found_rules(whole, low))
                if ascii_only:
                    found.update(_found_rules(ascii_only, text.translate(_ASCII_LOWER)))
                if exact:
                    found.update(_found_rules(exact, text))
            rows.append(sorted(found))
        return pa.array(rows, pa.list_(pa.int32()))

    return hits


def _index_map(entries: Iterable[tuple[int, str]]) -> Column:
    pairs = list(entries)
    return F.map_from_arrays(
        F.array(*[F.lit(keyword) for _, keyword in pairs]),
        F.array(*[F.lit(idx).cast("int") for idx, _ in pairs]),
    )


def _hits(tokens: Column, entries: dict[str, int]) -> Column:
    """Features of the dictionary words among the tokens."""
    if not entries:
        return F.lit(None).cast(FEATURES_TYPE)
    words = list(entries)
    lookup = _index_map((idx, word) for word, idx in entries.items())
    found = F.array_distinct(F.filter(tokens, lambda t: t.isin(words)))
    return F.transform(found, lambda w: feature(F.try_element_at(lookup, w), F.lit(1.0)))


def _pattern_hits(text: Column, patterns: list[tuple[int, str]]) -> Column:
    if not patterns:
        return F.lit(None).cast(FEATURES_TYPE)
    checks = [
        F.when(text.rlike(pattern), feature(F.lit(idx), F.lit(1.0))) for idx, pattern in patterns
    ]
    return F.filter(F.array(*checks), lambda f: f.isNotNull())


def _merged(*parts: Column) -> Column:
    """Parts with an index each at most once."""
    empty = F.array().cast(FEATURES_TYPE)
    return ordered(F.array_distinct(F.concat(*[F.coalesce(p, empty) for p in parts])))


def with_keyword_presence(
    samples: DataFrame,
    dictionary: list[tuple[int, str]],
    content: str = "content",
    out: str = "features",
    regex: frozenset[str] = frozenset(),
) -> DataFrame:
    """Adds features idx:1 for each keyword found as a whole word, ignoring case.

    Keywords are literals; those in `regex` are patterns. Word boundaries are Unicode ones.
    Two keywords that differ only in case are equal patterns: the first index wins.
    """
    plain: dict[str, int] = {}
    patterns: dict[str, int] = {}
    for idx, keyword in dictionary:
        if keyword in regex:
            patterns.setdefault(rf"(?iu)(?U)\b{keyword}\b", idx)
        elif _WORD.fullmatch(keyword):
            plain.setdefault(keyword.lower(), idx)
        else:
            literal = re.sub(r"([^\w\s])", r"\\\1", keyword)
            patterns.setdefault(rf"(?iu)(?U)\b{literal}\b", idx)
    tokens = "_tokens"
    return (
        samples.withColumn(tokens, unicode_words(F.col(content), shortest=1))
        .withColumn(
            out,
            _merged(
                _hits(F.col(tokens), plain),
                _pattern_hits(F.col(content), [(i, p) for p, i in patterns.items()]),
            ),
        )
        .drop(tokens)
    )


def with_rule_presence(
    samples: DataFrame,
    rules: list[tuple],
    content: str = "content",
    out: str = "features",
) -> DataFrame:
    """Adds features idx:1 for each rule literal found between non-alphanumerics, ignoring case.

    A rule is (idx, literal) or (idx, literal, fullword, nocase); without `fullword` the literal
    may stand anywhere, without `nocase` capitals count. Literals of plain words joined by single spaces are looked up among the document's own
    word n-grams, so the cost does not grow with the number of rules. Other literals are
    searched by pattern.
    """
    by_length: dict[int, dict[str, int]] = {}
    patterns: dict[str, int] = {}
    for idx, keyword, *flags in rules:
        fullword, nocase = flags or (True, True)
        literal = keyword.lower()
        if fullword and nocase and _RULE_WORDS.fullmatch(literal):
            by_length.setdefault(literal.count(" ") + 1, {}).setdefault(literal, idx)
        else:
            escaped = re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", keyword)
            bounded = rf"(?<![A-Za-z0-9]){escaped}(?![A-Za-z0-9])" if fullword else escaped
            patterns.setdefault(f"(?i){bounded}" if nocase else bounded, idx)

    df = samples.withColumn("_lowered", F.lower(content))
    parts = []
    if 1 in by_length:
        df = df.withColumn(
            "_words", F.regexp_extract_all("_lowered", F.lit("[a-z0-9]+"), F.lit(0))
        )
        parts.append(_hits(F.col("_words"), by_length[1]))
    longer = sorted(n for n in by_length if n > 1)
    if longer:
        # stretches of words joined by single spaces, each closed by a token no rule contains;
        # possessive, since a greedy group recurses once per word of a long stretch
        stretches = F.regexp_extract_all(
            "_lowered", F.lit("[a-z0-9]++(?: [a-z0-9]++)++"), F.lit(0)
        )
        df = df.withColumn("_linked", F.split(F.array_join(stretches, " | "), " "))
        for length in longer:
            gram = f"_grams_{length}"
            df = with_ngrams(df, "_linked", length, length, gram)
            parts.append(_hits(F.col(gram), by_length[length]))
    parts.append(_pattern_hits(F.col(content), [(i, p) for p, i in patterns.items()]))
    return df.withColumn(out, _merged(*parts)).drop(
        "_lowered", "_words", "_linked", *[f"_grams_{n}" for n in longer]
    )
