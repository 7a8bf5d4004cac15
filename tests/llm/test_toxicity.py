import pytest

from pagesift.llm.toxicity import FEATURES, Features, fit, score, toxicity_scores

FOLDER = "/root/testdata/sf0.1"


def test_features():
    make = Features({"idiot": 3.0, "tras*": 2.0, "meh": 0.5})
    row = lambda text: dict(zip(FEATURES, make(text)))
    plain = row("Nothing to see, move along.")
    assert plain["log_strong"] == 0 and plain["largest_weight"] == 0
    rude = row("You idiot! TRASHY 1d1ot i*diot meh loooool")
    assert rude["distinct_strong"] == 4 and rude["largest_weight"] == 3.0
    assert rude["obfuscated_hits"] == 2 and rude["near_address"] > 0 and rude["stretched"] > 0
    assert rude["lexicon_density"] > rude["strong_density"]
    assert row(None) == row("") and all(v == 0 for k, v in row("").items())


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels")]


def test_held_out_quality_and_nulls(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame(
        [(None, "x" * 300_000, None, None, 1), (-5, None, "en", "s", 0), (-6, "", "en", "s", 0)],
        docs.schema,
    )
    rows = toxicity_scores(docs.unionByName(odd).union(docs.limit(1)), labels).collect()
    assert len(rows) == docs.count() + 4
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    right = sum(r.predicted == toxic[r.doc_id] for r in held) / len(held)
    assert right >= 0.96
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[None].held_out is False and by_id[-5].score == by_id[-6].score < 0.5


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "a", 0.7, "q")], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="both classes"):
        assert fit(docs, labels) is None
    (row,) = score(docs, None).collect()
    assert row.asDict() == {"doc_id": 1, "text": "a", "score": 0.0, "predicted": 0, "learned": False}
    assert toxicity_scores(docs.limit(0), labels).collect() == []


def test_few_labels(spark):
    """51 toxic labels: every drawn row serves lexicon, trees and calibration."""
    docs, labels = (
        spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels")
    )
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(toxic.values()) == 51
    rows = [r for r in toxicity_scores(docs, labels).collect() if r.held_out and r.doc_id in toxic]
    ones = [r.score for r in rows if toxic[r.doc_id]]
    others = [r.score for r in rows if not toxic[r.doc_id]]
    wins = sum((a > b) + (a == b) / 2 for a in ones for b in others)
    assert wins / (len(ones) * len(others)) >= 0.9
    assert sum(s >= 0.5 for s in ones) >= len(ones) / 2
    assert all(r.learned for r in rows)
