import random

import pytest

from pagesift.llm import languages
from pagesift.llm.languages import fit, identify, predicted_languages

WORDS = {
    "en": "the and this that with from have were been which their would there about".split(),
    "de": "der und nicht eine werden schon über zwischen während sich auch keine".split(),
    "ru": "это как его она они был что так все при под над есть".split(),
}


def text(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(k, text(lang, 30, rng), lang) for k, lang in enumerate(list(WORDS) * 40)]
    rows += [(500, None, "en"), (501, "the", None), (None, "and the", "en")]
    return fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def predict(spark, model, texts, **options):
    df = spark.createDataFrame(
        [(n, t, "x", 1.0) for n, t in enumerate(texts)],
        "doc_id long, text string, lang_pred string, score double",
    )
    return sorted(identify(df, model, ["doc_id"], **options).collect())


def test_languages_scripts_and_spans(spark, model):
    rng = random.Random(2)
    english, german, russian = (text(k, 12, rng) for k in ("en", "de", "ru"))
    mixed = f"{english}. {german}\n{german} {russian}"
    rows = predict(
        spark, model, [english, german.upper(), russian, mixed, None, "", "12 34 !", "é"], spans=True
    )
    assert [r.lang_pred for r in rows][:3] == ["en", "de", "ru"]
    assert [s.lang for s in rows[3].spans] == ["en", "de", "ru"]
    cuts = [mixed[s.start : s.end] for s in rows[3].spans]
    assert cuts == [english, f"{german}\n{german}", russian]
    assert rows[3].lang_pred == "de" and 0.3 < rows[3].score < 0.7
    assert [(r.lang_pred, r.score, r.spans) for r in rows[4:7]] == [("und", 0.0, [])] * 3
    assert rows[7].lang_pred in model.languages


def test_slices_and_long_texts_change_nothing(spark, model, monkeypatch):
    rng = random.Random(3)
    texts = [text(rng.choice(list(WORDS)), rng.randint(0, 40), rng) for _ in range(40)]
    texts.append(" ".join(texts) * 40)
    whole = predict(spark, model, texts)
    monkeypatch.setattr(languages, "SLICE_CHARS", 50)
    assert predict(spark, model, texts) == whole


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in predicted_languages(df).collect()] == [("und", 0.0)]
    assert predicted_languages(df.limit(0)).collect() == []


def test_held_out_accuracy(spark):
    from pagesift.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op3_language_id"](spark, folder).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and 0.15 < len(held) / len(rows) < 0.35
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


OTHERS = {
    "km": "ភាសាខ្មែរ គឺជា ភាសា កំណើត របស់ ជនជាតិ ខ្មែរ និង ជា ភាសា ផ្លូវការ".split(),
    "am": "ሰላም ለዓለም ይህ ቋንቋ አማርኛ ነው እና በኢትዮጵያ ይነገራል".split(),
    "lo": "ພາສາ ລາວ ແມ່ນ ພາສາ ທາງການ ຂອງ ປະເທດ".split(),
    "ff": "𞤆𞤵𞤤𞤢𞤪 𞤫 𞤖𞤫𞤬𞤼𞤫𞤪𞤫 𞤸𞤢𞤤𞤢 𞤲𞤣𞤫𞤪".split(),
}


def test_learned_languages_of_other_scripts(spark):
    rng = random.Random(5)
    make = lambda lang, n: " ".join(rng.choice((WORDS | OTHERS)[lang]) for _ in range(n))
    rows = [(k, make(lang, 20), lang) for k, lang in enumerate([*WORDS, *OTHERS] * 20)]
    other = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = predict(spark, other, [make(k, 8) for k in [*WORDS, *OTHERS]] + ["\u2764\ufe0f 12 \u0301"])
    assert [r.lang_pred for r in got] == [*WORDS, *OTHERS, "und"]
    assert all(r.score > 0.9 for r in got[:-1]) and got[-1].score == 0.0


def test_every_letter_has_a_script():
    import unicodedata

    import numpy as np

    letters = [p for p in range(0x110000) if unicodedata.category(chr(p))[0] == "L"]
    assert (languages.scripts_of(np.array(letters)) > 0).all()
