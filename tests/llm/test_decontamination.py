import hashlib
import random

import brute
import pytest

from pagesift.llm.decontamination import contamination, digest


def frames(spark, docs, items):
    return (
        spark.createDataFrame(
            [(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_words int, items string"
        ),
        spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int"),
    )


def rows(hits):
    return sorted(
        (r.doc_id, r.n_words, sum(s["end"] - s["start"] for s in r.spans), r["items"])
        for r in hits.collect()
    )


@pytest.fixture(scope="module")
def planted():
    random.seed(11)
    words = ["the"] * 6 + ["of"] * 3 + [f"w{n}" for n in range(25)] + ["été", "Ärger", "x1", "日本"]
    draw = lambda n: [random.choice(words) for _ in range(n)]
    items = [(n, " ".join(draw(random.randint(0, 30)))) for n in range(40)]
    items += [(3, "the of the"), (50, "the " * 14), (51, None), (52, ""), (53, "single")]
    docs = []
    for n in range(120):
        text = draw(random.randint(0, 50))
        if n % 3 == 0:
            item = (items[n % 40][1] or "").split()
            at = random.randint(0, len(text))
            text[at:at] = item[random.randint(0, 5) :][: random.choice([8, 9, 10, 11, 30])]
        docs.append((n, (", ", " ", "\n")[n % 3].join(text).upper()))
    docs += [(200, None), (201, ""), (202, "single"), (203, " ".join(["the"] * 40))]
    return docs, items


@pytest.mark.parametrize("block_words", [500_000, 60])
def test_equals_brute_force(spark, planted, block_words):
    docs, items = planted
    hits = contamination(*frames(spark, docs, items), block_words=block_words)
    assert rows(hits) == sorted(brute.contamination(docs, items))


def test_adjacent_windows_and_text_ends(spark):
    words = [f"q{n}" for n in range(20)]
    docs = [(1, " ".join(words[:10])), (2, " ".join(words[10:])), (3, " ".join(words)), (3, " ".join(words))]
    items = [(1, " ".join(words[5:15])), (2, " ".join(words[:10])), (2, " ".join(words[10:]))]
    for block_words in (500_000, 12):
        got = rows(contamination(*frames(spark, docs, items), block_words=block_words))
        assert got == sorted(brute.contamination(docs, items))


def test_digest_and_empty_tables(spark):
    docs = [(1, "a b c"), (None, "zz"), (2, None)]
    got = {r.doc_id: tuple(r)[1:] for r in digest(contamination(*frames(spark, docs, [(9, "b"), (10, "C")]))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {
        1: (3, 2, 2, sha("10,9"), True), None: (1, 0, 0, sha(""), False), 2: (0, 0, 0, sha(""), False),
    }
    assert contamination(*frames(spark, [], [(1, "a")])).collect() == []
    assert rows(contamination(*frames(spark, [(1, "a")], []))) == [(1, 1, 0, [])]
