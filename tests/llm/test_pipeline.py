import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagesift.llm.mixing import mixture

FOLDER = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], SCHEMA
    )


def words(rng, n):
    return " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = [(n, words(rng, 60), f"s{n % 3}") for n in range(30)]
    rows += [(40, rows[3][1], "s0"), (41, rows[4][1] + " more", None), (42, None, "s1"), (43, "", "s1")]
    rows += [(50, rows[7][1] + "\n" + words(rng, 30), "s2"), (None, words(rng, 20), "s2")]
    return rows


def test_stages_return_the_columns_of_documents(spark, docs):
    df = frame(spark, docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, FOLDER)
        assert out.columns == COLUMNS, name
        assert {None, 42, 43} <= {r.doc_id for r in out.collect()}, name
        assert stage(spark, df.limit(0), FOLDER).collect() == [], name


def test_near_duplicate_stage(spark, docs):
    kept = {r.doc_id for r in STAGE["minhash_neardup"](spark, frame(spark, docs), FOLDER).collect()}
    exact = brute.near_duplicates([(i, t) for i, t, _ in docs if i is not None], 5)
    assert kept == {i for i, v in exact.items() if v[2]} | {None}
    assert 40 not in kept and 41 not in kept and 3 in kept


def test_decontamination_stage(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    planted = [(90, f"before {items[5][1]} after", "s1"), (91, items[6][1].upper(), "s1")]
    df = frame(spark, docs + planted)
    kept = {r.doc_id for r in STAGE["decontamination"](spark, df, FOLDER).collect()}
    hits = brute.contamination([(i, t) for i, t, _ in docs + planted], items)
    assert kept == {i for i, _, hit, _ in hits if not hit}
    assert not {90, 91} & kept


def test_line_stage(spark, docs):
    rows = {r.doc_id: r.text for r in STAGE["line_dedup"](spark, frame(spark, docs), FOLDER).collect()}
    assert rows.keys() == {i for i, *_ in docs}
    assert rows[40] == "" and rows[50] == docs[34][1].split("\n")[1] and rows[3] == docs[3][1]


def test_toxicity_stage(spark):
    folder = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in STAGE["toxicity"](spark, df, folder).select("doc_id").collect()}
    clean, toxic = ({i for i, t in labels.items() if t == value} for value in (0, 1))
    assert len(kept & clean) >= 0.98 * len(clean) and len(kept & toxic) <= 0.08 * len(toxic)


def test_mixing_stage(spark, docs):
    df = frame(spark, docs)
    out = STAGE["mixing"](spark, df, FOLDER)
    taken = mixture(df).agg(F.sum("taken")).first()[0]
    assert sum(len((r.text or "").split()) for r in out.collect()) == taken


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert sorted(map(str, docs.collect())) == sorted(
        map(str, corpus_pipeline.run(spark, FOLDER).collect())
    )
    assert docs.count() > 0


def test_stages_keep_columns_with_clashing_names(spark, docs):
    extra = ["_rejected", "rejected", "row", "gone", "_doc_id", "component", "node", "items"]
    df = frame(spark, docs).withColumns({name: F.lit("x") for name in extra})
    for name in ("line_dedup", "minhash_neardup", "decontamination"):
        out = STAGE[name](spark, df, FOLDER)
        assert out.columns == df.columns, name
        assert {r[c] for r in out.collect() for c in extra} == {"x"}, name
