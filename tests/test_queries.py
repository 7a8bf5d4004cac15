import os

import check_oracles
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def connection():
    return check_oracles.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, connection, name):
    assert check_oracles.compare(spark, connection, FOLDER, name) == ""


@pytest.mark.parametrize(
    "name", ["keyword_tfidf_features", "tfidf_features", "tfidf_rank_features"]
)
def test_feature_lines_of_every_sample(spark, name):
    """Which n-grams a forest selects has no SQL form; every sample has one well-formed line."""
    lines = entry.queries()[name](spark, FOLDER)
    corpus = entry.queries()["full_refit_set"](spark, FOLDER)
    found = {r["sample_id"]: r["line"] for r in lines.collect()}
    assert found.keys() == {r["sample_id"] for r in corpus.collect()}
    pairs = [p.split(":") for line in found.values() for p in line.partition("#")[0].split()[1:]]
    assert pairs and all(int(i) >= 0 and float(v) > 0 for i, v in pairs)


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_query(spark):
    assert entry.entry(spark).count() > 0
