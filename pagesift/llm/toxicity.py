"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows are drawn by a hash of their id, at most about SAMPLE of each class (a documented
bound for fitting alone), and fall into FOLDS parts with equal shares of both classes. Every part
serves every step: a part's features come from the lexicon of the other parts, words and word
beginnings that toxic texts use far more often; the trees are fitted on densities of that lexicon,
its distance to second-person words, capitals, punctuation and obfuscation; the calibration learns
from scores that trees of the other parts give a part. The final lexicon and trees see all drawn
rows, so that a few dozen labels are used as fully as thousands. Texts are scored whole, one pass,
without a shuffle.
"""

from __future__ import annotations

import math
import re
import warnings
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pagesift.llm.scratch import Scratch

#: labelled rows of a class used for fitting, about
SAMPLE = 6000
#: terms of the lexicon
TERMS = 400
#: a term is in at least this share of the toxic texts, and in two
SUPPORT = 1 / 1500
#: standard errors that the log odds of a term lie above zero
SURE = 2.5
FOLDS = 3
ROUNDS = 24
DEPTH = 4
STEMS = (4, 5, 6, 7, 8)

# Words of address in the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner "
    "ihr euch euer tú ti tus usted ustedes vosotros vuestro".split()
)
# Signs that stand for letters.
_LETTERS = str.maketrans("013457@$!|", "oieastasil")

_WORD = re.compile(r"\w(?:[\w@$!|*'-]*\w)?")
_ODD = re.compile(r"[^\W\d_][*@$!|\d_-]+[^\W\d_]")
_PUNCTUATION = re.compile(r"[^\w\s]")
_CAPITAL_WORD = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{2,}\b")
_REPEATED = re.compile(r"(\w)\1{2,}")
_MASKS = re.compile(r"[*@$!|_'-]")

FEATURES = (
    "lexicon_density", "strong_density", "log_strong", "weight_density", "largest_weight",
    "distinct_strong", "address_density", "near_address", "capitals", "capital_words",
    "exclamations", "punctuation", "obfuscated", "obfuscated_hits", "stretched", "variety",
    "log_words",
)

_CACHE = 200_000
_NEAR = 3
_STRONG = 1.5


class Model(NamedTuple):
    lexicon: dict[str, float]
    trees: GBTClassificationModel
    calibration: IsotonicRegressionModel


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def plain(word: str) -> str:
    """A word without masks, with letters for look-alike signs."""
    return _MASKS.sub("", word.translate(_LETTERS))


def terms_of(word: str) -> list[str]:
    return [word] + [word[:size] + "*" for size in STEMS if len(word) > size]


class Features:
    """Dense features of one text; word weights are remembered between texts, up to a bound."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= _CACHE:
                self.known.clear()
            found = max((self.lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0)
            if not found and not word.isalpha():
                found = max((self.lexicon.get(t, 0.0) for t in terms_of(plain(word))), default=0.0)
            self.known[word] = found
        return found

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        words = words_of(text)
        count, length = max(len(words), 1), max(len(text), 1)
        weights = [self.weight(w) for w in words]
        hits = [k for k, w in enumerate(weights) if w > 0]
        strong = [k for k in hits if weights[k] >= _STRONG]
        address = [k for k, w in enumerate(words) if w in SECOND_PERSON] if strong else []
        near = 0
        if address:
            marked = {k + d for k in address for d in range(-_NEAR, _NEAR + 1)}
            near = sum(k in marked for k in strong)
        odd = [w for w in words if not w.isalpha() and _ODD.search(w)]
        return [
            len(hits) / count,
            len(strong) / count,
            math.log1p(len(strong)),
            sum(weights) / count,
            max(weights, default=0.0),
            float(len({words[k] for k in strong})),
            len(address) / count,
            near / count,
            sum(map(str.isupper, text)) / length,
            len(_CAPITAL_WORD.findall(text)) / count,
            text.count("!") / count,
            len(_PUNCTUATION.findall(text)) / length,
            len(odd) / count,
            float(sum(self.weight(w) > 0 for w in odd)),
            len(_REPEATED.findall(text)) / count,
            len(set(words)) / count,
            math.log1p(len(words)),
        ]


def _featurer(lexica):
    """Features in place of the text, the first column; a row uses the lexicon of its `part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = [Features(lexicon) for lexicon in lexica.value]
        for batch in batches:
            texts = batch.column(0)
            known = "part" in batch.schema.names
            parts = batch.column("part").to_pylist() if known else [0] * len(texts)
            rows = [make[part](text.as_py()) for text, part in zip(texts, parts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), *batch.columns[1:]],
                ["features", *batch.schema.names[1:]],
            )

    return run


def _term_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part: occurrences of terms in toxic and other texts, and the toxic texts with them."""
    toxic, other, texts = Counter(), Counter(), Counter()

    def table():
        keys = list(toxic.keys() | other.keys())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part for part, _ in keys], pa.int32()),
                pa.array([term for _, term in keys], pa.string()),
                *[pa.array([counts[k] for k in keys], pa.int64()) for counts in (toxic, other, texts)],
            ],
            ["part", "term", "toxic", "other", "texts"],
        )

    for batch in batches:
        for text, label, part in zip(*(batch.column(k) for k in range(3))):
            part = part.as_py()
            own = Counter()
            for word, n in Counter(words_of(text.as_py() or "")).items():
                for term in terms_of(word):
                    own[part, term] += n
            if label.as_py():
                toxic.update(own)
                texts.update(own.keys())
            else:
                other.update(own)
        if len(toxic) + len(other) > 300_000:
            yield table()
            toxic, other, texts = Counter(), Counter(), Counter()
    yield table()


def _lexica(rows: DataFrame, scratch: Scratch) -> list[dict[str, float]]:
    """For each part the lexicon of the other parts, and behind them that of all parts."""
    counts = scratch.store(
        rows.select(F.coalesce("text", F.lit("")).alias("text"), "toxic", "part")
        .mapInArrow(_term_counter, "part int, term string, toxic long, other long, texts long")
        .groupBy("part", "term")
        .agg(*[F.sum(name).alias(name) for name in ("toxic", "other", "texts")]),
        "terms",
    )
    toxic = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("toxic").alias("n")).collect()}
    return [
        _lexicon(counts.filter(F.col("part") != held), sum(n for part, n in toxic.items() if part != held))
        for held in (*range(FOLDS), -1)
    ]


def _lexicon(counts: DataFrame, toxic_texts: int) -> dict[str, float]:
    """Terms of toxic texts by log odds with a flat prior, at most TERMS by significance."""
    counts = counts.groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum("other").alias("b"), F.sum("texts").alias("texts")
    )
    sums = counts.filter(~F.col("term").endswith("*")).agg(F.sum("a"), F.sum("b")).first()
    total_a, total_b = (sums[0] or 0) + 1.0, (sums[1] or 0) + 1.0
    odds = F.log((F.col("a") + 0.5) / (F.lit(total_a) - F.col("a") + 0.5)) - F.log(
        (F.col("b") + 0.5) / (F.lit(total_b) - F.col("b") + 0.5)
    )
    score = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    chosen = (
        counts.filter(F.col("texts") >= max(2.0, SUPPORT * toxic_texts))
        .select("term", odds.alias("odds"), score.alias("score"))
        .filter((F.col("odds") > 1) & (F.col("score") > SURE))
        .orderBy(F.desc("score"), "term")
        .limit(TERMS)
        .collect()
    )
    return {r["term"]: float(r["odds"]) for r in chosen}


def remainder(divisor: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, rule: Column, sample: int) -> DataFrame:
    """(text, toxic, weight, part): about `sample` rows of a class at most, by a hash of the id.
    weight is the number of labelled rows that a row stands for, part a number below FOLDS; each
    part has the same share of either class."""
    known = (
        labels.filter(rule & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("toxic").alias("_toxic"))
    )
    sizes = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("_id").alias("n")).collect()}
    share = {label: min(1.0, sample / n) for label, n in sizes.items()}
    draw = F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(1_000_000)) / 1_000_000
    bound = F.when(F.col("_toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    # at most about two samples of ids
    in_class = Window.partitionBy("_toxic").orderBy(F.xxhash64(F.lit("part"), "_id"), "_id")
    chosen = known.filter(draw < bound).withColumn(
        "_part", F.pmod(F.row_number().over(in_class), F.lit(FOLDS)).cast("int")
    )
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(
        "text",
        F.col("_toxic").cast("int").alias("toxic"),
        (1 / bound).alias("weight"),
        F.col("_part").alias("part"),
    )


def fit(
    docs: DataFrame, labels: DataFrame, rule: Column | None = None, sample: int = SAMPLE
) -> Model | None:
    """A model of `labels` (doc_id, toxic) on the texts of `docs`, from labels that fit `rule`.

    None, with a warning, if no labelled row of `docs` is of the one class or of the other.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = scratch.store(
        labelled_sample(docs, labels, F.lit(True) if rule is None else rule, sample), "sample"
    )
    if rows.agg(F.countDistinct("toxic")).first()[0] < 2:
        scratch.close()
        warnings.warn("toxicity: labels of both classes are needed; nothing was learned", stacklevel=2)
        return None
    *parted, lexicon = _lexica(rows, scratch)
    shared = spark.sparkContext.broadcast(parted)
    featured = scratch.store(
        rows.mapInArrow(
            _featurer(shared), "features array<double>, toxic int, weight double, part int"
        )
        .select(
            array_to_vector("features").alias("features"),
            F.col("toxic").cast("double").alias("label"),
            "weight",
            "part",
        )
        .coalesce(4),
        "featured",
    )

    learner = GBTClassifier(
        maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=5, seed=7,
        weightCol="weight",
    )
    def fitted(held: int) -> GBTClassificationModel:
        return learner.fit(featured.filter(F.col("part") != held))

    # many small jobs each: side by side, the last one on all parts
    with ThreadPoolExecutor(max_workers=FOLDS + 1) as pool:
        *apart, trees = pool.map(fitted, (*range(FOLDS), -1))
    scored = [
        model.transform(featured.filter(F.col("part") == held)).select(
            "label", "weight", vector_to_array("probability")[1].alias("raw")
        )
        for held, model in enumerate(apart)
    ]
    calibration = IsotonicRegression(featuresCol="raw", weightCol="weight").fit(
        reduce(DataFrame.unionByName, scored)
    )
    scratch.close()
    return Model(lexicon, trees, calibration)


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all, if none are named) with `score` in [0, 1], `predicted` and
    `learned`.

    Null and empty texts have the score of texts without words. Without a model every score is 0
    and `learned` is false. Columns of `docs` with these three names are replaced.
    """
    names = [c for c in keep or docs.columns if c not in ("score", "predicted", "learned")]
    if model is None:
        return docs.select(
            *[F.col(f"`{c}`") for c in names],
            F.lit(0.0).alias("score"),
            F.lit(0).alias("predicted"),
            F.lit(False).alias("learned"),
        )
    shared = docs.sparkSession.sparkContext.broadcast([model.lexicon])
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    packed = docs.select(F.col("text").alias("_text"), row.alias("_row"))
    kind = StructType(
        [StructField("features", ArrayType(DoubleType())), packed.schema["_row"]]
    )
    featured = packed.mapInArrow(_featurer(shared), kind)
    raw = model.trees.transform(
        featured.withColumn("features", array_to_vector("features"))
    ).select("_row", vector_to_array("probability")[1].alias("raw"))
    calibrated = model.calibration.transform(raw)
    value = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return calibrated.select(
        "_row.*",
        value.alias("score"),
        F.when(value >= 0.5, 1).otherwise(0).alias("predicted"),
        F.lit(True).alias("learned"),
    )


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, learned) per row of `docs` (doc_id, text), from the rows
    of `labels` (doc_id, toxic) whose crc32 of doc_id leaves a remainder modulo 5. A null doc_id is
    not held out."""
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), remainder(5) > 0)
    rows = docs.select("doc_id", "text", (remainder(5) == 0).alias("held_out"))
    return score(rows, model, ["doc_id", "held_out"])
