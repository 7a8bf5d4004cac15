import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from pagesift.functions.bytewords import slices
from pagesift.functions.text import fold_to_ascii
from pagesift.operators import hashing, ngrams, tfidf, vocabulary
from pagesift.sources.libsvm import to_long


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = ["The", "the", "été", "ÉTÉ", "naïve", "Straße", "ﬁn", "KK", "Kelvin", "名前", "я", "да", "x1f", "0x", "0ff"]
    words += ["07777", "0177777", "x12345", "ffff", "10000", "a_b", "_", "a", "II", "😀😀", "𝒳𝒳", "no-de", "٣٤", "end\n"]
    words += [f"w{n}" for n in range(300)]
    weights = [8] * 29 + [1 / (n + 1) for n in range(300)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randrange(60))) for _ in range(150)]
    texts += ["", None, "x", "one", "THE END", "-"]
    texts += texts[:5]
    return spark.createDataFrame(
        [(n % 140, t) for n, t in enumerate(texts)], "sample_id long, content string"
    ).cache()


CUTS = [(1, 3, True, True), (2, 3, True, False), (1, 2, False, True), (2, 3, False, False)]


@pytest.mark.parametrize("cut", CUTS)
def test_terms_equal_the_array_form(corpus, cut):
    termed = tfidf.with_terms(corpus, *cut)
    expected = rows(tfidf.term_frequency(termed, ["sample_id"]))
    found = tfidf.corpus_term_frequency(corpus, ["sample_id"], *cut)
    assert rows(found) == expected and len(expected) > 1000
    counted = tfidf.document_frequency(tfidf.term_frequency(termed, []))
    assert rows(ngrams.term_counts(corpus, ngrams.Cut(*cut))) == rows(counted)


@pytest.mark.parametrize("cut", CUTS[:3])
@pytest.mark.parametrize("bits", [2, 7, 18])
def test_frequent_terms_with_few_and_many_buckets(corpus, cut, bits):
    counted = tfidf.document_frequency(tfidf.term_frequency(tfidf.with_terms(corpus, *cut), []))
    every = sorted((tuple(r) for r in counted.collect()), key=lambda r: (-r[1], r[0]))
    for count in (1, 9, 60, 100_000):
        found = ngrams.frequent_terms(corpus, count, ngrams.Cut(*cut), bits=bits).collect()
        first = sorted((tuple(r) for r in found), key=lambda r: (-r[1], r[0]))[:count]
        assert first == every[:count]


def test_rare_terms_are_not_counted_one_by_one(corpus):
    every = ngrams.term_counts(corpus, ngrams.Cut(2, 3)).count()
    assert ngrams.frequent_terms(corpus, 10, ngrams.Cut(2, 3)).count() < every / 20


def test_buckets_of_a_vocabulary_leave_other_terms_out(corpus):
    table = vocabulary.fit_tfidf_table(corpus, 20, 1, 2)
    bits = ngrams.MAX_BITS
    own = ngrams.document_terms(corpus, ["sample_id"], ngrams.Cut(1, 2), bits, table._buckets(bits))
    terms = {r["term"] for r in table.vocabulary.collect()}
    assert {r["term"] for r in own.select("term").distinct().collect()} == terms


def test_hashes_of_strings_are_those_of_the_texts(corpus):
    terms = ["été", "the", "the naïve", "a_b the naïve"]
    cut = ngrams.Cut(1, 3, strip_accents=False)
    (_, found), = ngrams.cut_texts(pa.array(["a_b the naïve été"]), cut)
    names = found.strings(np.arange(len(found.hashes))).to_pylist()
    by_name = dict(zip(names, found.hashes.tolist()))
    assert [by_name[t] for t in terms] == ngrams.term_hashes(terms).tolist()


def test_hashed_features_of_every_kind_of_text(corpus):
    rows_of = corpus.select("sample_id", "content").withColumn("sample_id", F.monotonically_increasing_id())
    kept = rows_of.cache()
    found = {r["sample_id"]: r["features"] for r in hashing.with_hashed_features(kept, 50, 1, 2).collect()}
    for row in kept.collect():
        if row["content"] is None:
            assert found[row["sample_id"]] is None
            continue
        words = re.findall(r"[^\W]{2,}", row["content"].lower())
        sums = Counter()
        for term in [*words, *map(" ".join, zip(words, words[1:]))]:
            digest = hashlib.md5(term.encode()).hexdigest()
            sums[int(digest[:8], 16) % 50] += -1 if digest[8] >= "8" else 1
        length = sum(v * v for v in sums.values()) ** 0.5
        expected = [(k, v / length) for k, v in sorted(sums.items()) if v]
        assert {f["idx"]: f["value"] for f in found[row["sample_id"]]} == pytest.approx(dict(expected))


def test_vectors_of_texts_without_terms(corpus):
    model = tfidf.fit_tfidf(corpus.filter("content is not null"), 30, 1, 2)
    weighed = model.transform(corpus.filter("content is not null"))
    long = to_long(weighed.withColumn("features", tfidf.vector_features("tfidf")), ["sample_id"])
    assert weighed.count() == corpus.filter("content is not null").count()
    assert long.select("idx").distinct().count() == 30


def test_accents_are_folded_in_the_tasks_as_in_columns(spark):
    points = [*range(1, 0xD800), *range(0xE000, 0x1F000)]
    texts = ["".join(map(chr, points[low : low + 997])) for low in range(0, len(points), 997)]
    texts += ["", "plain Text", "ŒUVRE ﬁn ß İI ΣΑΣ", "a\U0001f600é"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", F.lower("text"), fold_to_ascii(F.col("text"))).orderBy("i").toArrow()
    for low, high, data, offsets in slices(rows.column(1).combine_chunks()):
        folded, ends = ngrams.fold(data, offsets)
        whole = folded.tobytes().decode("ascii")
        found = [whole[a:b] for a, b in zip(ends[:-1], ends[1:])]
        assert found == rows.column(2).to_pylist()[low:high]
    # nothing is folded before the texts are in the tasks
    plan = df.select(ngrams.Cut(1, 2).text("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan
