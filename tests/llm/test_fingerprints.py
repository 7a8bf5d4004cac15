import hashlib
import math
import random
from collections import Counter

import numpy as np

from pagesift.llm import fingerprints as fp
from pagesift.llm.fingerprints import (
    BITS,
    FEATURES,
    HASHES,
    LEAST,
    SPAN,
    WINDOW,
    class_counts,
    digests,
    edited,
    entropy_classes,
    features,
    fingerprints,
    likeness,
    rarity,
    read,
    written,
)

FOLDER = "/root/testdata/sf0.001"


def plain_class(window):
    terms = [round(c * math.log2(c) * fp._SCALE) for c in Counter(window).values()]
    largest = round(WINDOW * math.log2(WINDOW) * fp._SCALE)
    return (largest - sum(terms)) * (fp.CLASSES - 1) // largest


def plain_features(text, ranks):
    """The feature windows of a text in order."""
    if len(text) < WINDOW:
        return [text] if text else []
    windows = [text[i : i + WINDOW] for i in range(len(text) - WINDOW + 1)]
    order = [(ranks[plain_class(w)], i) for i, w in enumerate(windows)]
    if len(order) < SPAN:
        return [windows[min(order)[1]]]
    points = Counter(min(order[i : i + SPAN])[1] for i in range(len(order) - SPAN + 1))
    return [windows[i] for i in sorted(points) if points[i] >= LEAST]


def plain_filters(text, ranks):
    """The set bits of each filter of the chain."""
    own = plain_features(text, ranks)
    found = []
    for low in range(0, len(own), FEATURES):
        bits = set()
        for window in own[low : low + FEATURES]:
            (one,) = features([window], ranks)
            assert len(one) == 1
            bits |= {(int(one[0]) >> (11 * k)) % BITS for k in range(HASHES)}
        found.append(bits)
    return found


def plain_likeness(left, right):
    if left == right:
        return 1.0
    if not left or not right:
        return 0.0

    def score(a, b):
        chance = len(a) * len(b) / BITS
        spread = math.sqrt(chance * (1 - len(a) / BITS) * (1 - len(b) / BITS))
        common = len(a & b)
        if common <= chance + 3 * spread:
            return 0.0
        return (common - chance) / (max(len(a), len(b)) - chance)

    def side(ours, theirs):
        return sum(len(a) * max(score(a, b) for b in theirs) for a in ours) / sum(map(len, ours))

    return (side(left, right) + side(right, left)) / 2


def bits_of(digest):
    return [set(np.flatnonzero(np.unpackbits(row, bitorder="little")).tolist()) for row in digest]


def plain(docs):
    """docs: (doc_id, text), already in falling order."""
    texts = [t or "" for _, t in docs]
    counts = np.zeros(fp.CLASSES, np.int64)
    for text in texts:
        data = text.encode()
        for i in range(len(data) - WINDOW + 1):
            counts[plain_class(data[i : i + WINDOW])] += 1
    ranks = rarity(counts)
    rows = []
    for n, text in enumerate(texts):
        after = texts[(n + 1) % len(texts)]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        mine, theirs, next_ = (plain_filters(t.encode(), ranks) for t in (text, new, after))
        rows.append((
            docs[n][0], len(text), hashlib.sha256(new.encode()).hexdigest(), mine, theirs,
            plain_likeness(mine, theirs), plain_likeness(mine, next_),
        ))
    return rows


def compare(found, expected):
    found = sorted(found, key=str)

    def listed(row, *digests):
        return str((*row, *[[sorted(bits) for bits in digest] for digest in digests]))

    rows = [
        listed(
            (r.doc_id, r.n_chars, r.edited_sha256),
            *[bits_of(read(f)) for f in (r.fingerprint, r.edited_fingerprint)],
        )
        for r in found
    ]
    assert sorted(rows) == sorted(listed(r[:3], *r[3:5]) for r in expected)
    near = sorted((str(r.doc_id), r.n_chars, r.near_edited, r.near_next) for r in found)
    want = sorted((str(r[0]), r[1], r[5], r[6]) for r in expected)
    assert np.allclose([n[2:] for n in near], [w[2:] for w in want])


def sentence(rng, words):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(words))


def test_equals_plain_version(spark):
    rng = random.Random(6)
    texts = [sentence(rng, n) for n in (1, 2, 8, 9, 12, 15, 30, 200, 900)]
    texts += ["", "a", "-" * 300, "日本語の文書です。" * 40, texts[7], texts[8][:2000] + texts[7], "x" * WINDOW]
    rng.shuffle(texts)
    docs = [(n, t) for n, t in enumerate(texts)] + [(100, None)]
    df = spark.createDataFrame(
        [(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, part string, edge int, row int"
    )
    compare(fingerprints(df.repartition(4)).collect(), plain(sorted(docs, reverse=True)))


def test_ties_nulls_and_repeats(spark):
    rng = random.Random(8)
    texts = [sentence(rng, 40) for _ in range(4)]
    rows = [(3, texts[0]), (3, texts[0]), (3, texts[0]), (2, None), (None, texts[1])]
    found = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    compare(found, plain([(3, texts[0])] * 3 + [(2, None), (None, texts[1])]))
    (single,) = fingerprints(spark.createDataFrame([(1, texts[2])], "doc_id long, text string")).collect()
    assert single.near_next == 1.0 and single.edited_sha256 == hashlib.sha256(
        edited(texts[2], texts[2]).encode()
    ).hexdigest()
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_row_once_over_many_partitions(spark):
    rng = random.Random(9)
    docs = [(n, sentence(rng, rng.randrange(1, 60))) for n in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        found = fingerprints(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    texts = dict(docs)
    assert {r.doc_id: r.edited_sha256 for r in found} == {
        n: hashlib.sha256(edited(t, texts[(n - 1) % 300]).encode()).hexdigest() for n, t in docs
    }


def test_blocks_do_not_change_the_features(monkeypatch):
    rng = random.Random(10)
    text = sentence(rng, 3000).encode()
    ranks = rarity(class_counts([text]))
    whole, counts = features([text], ranks)[0], class_counts([text])
    monkeypatch.setattr(fp, "BLOCK", 1000)
    assert np.array_equal(features([text], ranks)[0], whole)
    assert np.array_equal(class_counts([text]), counts)


def test_entropy_classes():
    rng = random.Random(11)
    data = bytes(rng.choices(b"aabbbcd e", k=500))
    found = entropy_classes(np.frombuffer(data, np.uint8))
    assert found.tolist() == [plain_class(data[i : i + WINDOW]) for i in range(len(data) - WINDOW + 1)]


def test_likeness_follows_the_shared_part():
    rng = random.Random(12)
    one, two = sentence(rng, 2000), sentence(rng, 2000)
    ranks = rarity(class_counts([one.encode(), two.encode()]))
    half = len(one) // 2
    quarter = one[: half + half // 2] + two[: half - half // 2]
    a, b, c, d = digests([t.encode() for t in (one, two, one[:half] + two[:half], quarter)], ranks)
    assert likeness(a, a) == 1.0 and likeness(a, b) < 0.05
    assert 0.4 < likeness(a, c) < 0.7 < likeness(a, d) < 0.9
    assert likeness(a, c) == likeness(c, a)
    assert np.array_equal(read(written(a)), a)


def test_query(spark):
    from pagesift.llm.queries import QUERIES

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    texts = sorted(((r.doc_id, r.text or "") for r in docs), reverse=True)
    found = {r.doc_id: r for r in QUERIES["op12_fingerprints"](spark, FOLDER).collect()}
    assert len(found) == len(texts)
    for (doc_id, text), (_, after) in zip(texts, texts[1:] + texts[:1]):
        row = found[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited(text, after).encode()).hexdigest()
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
    long = [found[i] for i, t in texts if len(t) > 500]
    nearer = [r.near_edited > r.near_next for r in long]
    assert sum(nearer) >= 0.97 * len(long)
