import re
import time

import pytest

from pagesift.llm import surrogates as module
from pagesift.llm.surrogates import (
    GIVEN,
    Surrogates,
    collisions,
    find_entities,
    replace,
    with_surrogates,
)

TEXT = (
    "Dr. John Smith (john.smith@acme.org) called +1 (017) 555-7713 from 10.0.0.5 and 97.51.17.173. "
    "Mrs García paid with 4111 1111 1111 1111 and DE89 3704 0044 0532 0130 00; my name is Anna Müller. "
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", SSN 123-45-6789, on 2024-01-02. Smith and '
    "JOHN.SMITH@ACME.ORG again. Госпожа Иванова."
)


@pytest.fixture
def keyed():
    return Surrogates("a key")


def kinds(text):
    return [(e.type, text[e.start : e.end]) for e in find_entities(text)]


def test_entities_are_found():
    assert kinds(TEXT) == [
        ("given-m", "John"), ("family", "Smith"), ("email", "john.smith@acme.org"),
        ("phone", "+1 (017) 555-7713"), ("ip", "10.0.0.5"), ("ip", "97.51.17.173"), ("family", "García"),
        ("card", "4111 1111 1111 1111"), ("iban", "DE89 3704 0044 0532 0130 00"), ("given-f", "Anna"),
        ("family", "Müller"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
        ("ssn", "123-45-6789"), ("family", "Smith"), ("email", "JOHN.SMITH@ACME.ORG"),
        ("family", "Иванова"),
    ]


def test_clean_text_stays(keyed):
    clean = "In 2024-01-02 some 20 000 000 people, 3.14 of them; ratio 1:2. See chapter 12-34 at 10:30."
    assert replace(clean, keyed) == (clean, [])


def test_surrogates_keep_type_format_script_and_gender(keyed):
    new, entities = replace(TEXT, keyed)
    assert [e["type"] for e in entities] == [k for k, _ in kinds(TEXT)]
    assert kinds(new)[:6] != kinds(TEXT)[:6]
    for (kind, old), found in zip(kinds(TEXT), entities):
        assert old not in new.replace("John", "") or kind == "given-m"
        assert new[found["start"] :][: len(old)].lower() != old.lower()
    parts = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\d{4} \d{4} \d{4} \d{4}\b|DE\d\d [\d ]{22}", new)
    assert len(parts) >= 3
    card = next(e["surrogate"] for e in entities if e["type"] == "card")
    assert module._luhn(card) and card[0] == "4"
    assert module._iban_holds(next(e["surrogate"] for e in entities if e["type"] == "iban"))
    addresses = [e["surrogate"] for e in entities if e["type"] == "ip"]
    assert addresses[0].startswith("10.") and not addresses[1].startswith("10.")
    given = {e["type"]: e["surrogate"] for e in entities if e["type"].startswith("given")}
    assert given["given-m"].capitalize() in GIVEN["latin", "m"]
    assert given["given-f"].capitalize() in GIVEN["latin", "f"]
    assert re.fullmatch("[А-Яа-я]+а", new.split()[-1].strip("."))


def test_same_entity_same_surrogate(keyed):
    _, entities = replace(TEXT, keyed)
    by_type = lambda t: [e["surrogate"] for e in entities if e["type"] == t]
    assert len(set(by_type("email"))) == 1
    assert by_type("family")[0] == by_type("family")[3]
    assert replace(TEXT, Surrogates("a key")) == replace(TEXT, keyed)
    assert replace(TEXT, Surrogates("another"))[0] != replace(TEXT, keyed)[0]


@pytest.mark.parametrize(
    "kind, values",
    [
        ("ip", [f"10.1.{a}.{b}" for a in range(30) for b in range(30)]),
        ("phone", [f"1{n:09d}" for n in range(0, 10_000, 7)]),
        ("family", [f"{a}{b}ski" for a in "abcdefghijklm" for b in "aeioubcdfgh"]),
        ("card", [f"4111{n:08d}" for n in range(800)]),
        ("email", [f"{a}{b}@x{c}.org" for a in "abcde" for b in "xyz01" for c in "abc"]),
        ("given-f", [n.lower() for n in GIVEN["latin", "f"]]),
        ("secret", [f"{n:032x}" for n in range(500)]),
    ],
)
def test_map_is_one_to_one(keyed, kind, values):
    found = [keyed.of(kind, v) for v in values]
    assert len(set(found)) == len(values)
    assert [len(f) for f in found] == [len(v) for v in values] or kind in ("ip", "given-f")


SCHEMA = "doc_id long, text string, entities string, n_entities int"


def test_operator_with_nulls_and_repeats(spark):
    rows = [(1, TEXT), (1, TEXT), (2, None), (3, ""), (None, "mail a@b.org"), (4, "x " * 200_000 + "a@b.org")]
    df = spark.createDataFrame([(*r, "e", 9) for r in rows], SCHEMA)
    got = with_surrogates(df, "k").collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[2].text, by_id[2].n_entities, by_id[3].text) == (None, 0, "")
    assert by_id[1].n_entities == 16 and [r.text for r in got if r.doc_id == 1][0] == by_id[1].text
    assert by_id[None].text.split()[1] == by_id[4].text.split()[-1] != "a@b.org"
    assert with_surrogates(df.limit(0)).collect() == []


def test_collisions_are_drawn_anew(spark, monkeypatch):
    once = Surrogates._once
    monkeypatch.setattr(
        Surrogates,
        "_once",
        lambda self, k, n: "1.1.1.1" if n in ("8.8.8.8", "9.9.9.9") else once(self, k, n),
    )
    replaced = spark.createDataFrame(
        [(1, "", [("ip", 0, 5, "1.1.1.1"), ("ip", 9, 7, "1.1.1.1"), ("ip", 9, 5, "1.1.1.1"), ("ip", 1, 6, "2.2.2.2")])],
        "doc_id long, text string, entities array<struct<type:string,start:long,mark:long,surrogate:string>>",
    )
    assert [(r.first, r.mark) for r in collisions(replaced).collect()] == [(5, 7)]
    keyed = Surrogates("k", {Surrogates("k").mark("ip", "9.9.9.9"): 1})
    assert keyed.of("ip", "9.9.9.9") != keyed.of("ip", "8.8.8.8") == "1.1.1.1"


def test_query_removes_planted_data(spark):
    from pagesift.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op7_surrogates"](spark, folder).collect()
    assert {r.doc_id for r in rows} == docs.keys()
    private = re.compile(r"\S+@\S+\.com|\b[0-9a-f]{40}\b|\+1 \(\d+\) 555-\d{4}|\b\d{16}\b")
    for r in rows:
        found = private.findall(docs[r.doc_id])
        assert not any(f in r.text for f in found)
        if not r.n_entities:
            assert r.text == docs[r.doc_id] and not found


@pytest.mark.parametrize("before", ["", "Yesterday ", "We met ", "In May we met ", "Then Old Uncle "])
def test_untitled_names_behind_any_number_of_words(before):
    text = f"{before}Anna Petrova there. Petrova left; Anna stayed."
    assert kinds(text) == [
        ("given-f", "Anna"), ("family", "Petrova"), ("family", "Petrova"), ("given-f", "Anna"),
    ]


def test_untitled_name_with_a_middle_name():
    assert [e for _, e in kinds("and Anna Maria Petrova went")] == ["Anna", "Maria", "Petrova"]


@pytest.mark.parametrize(
    "number",
    [
        "06 12 34 56 78", "06\u00a012\u00a034\u00a056\u00a078", "06.12.34.56.78", "0612345678", "030 1234567",
        "(030) 1234567", "0171/1234567", "0171 / 123 45 67", "+49 171/1234567", "+49 17123/456789",
        "0049 30 123456", "020 7946 0958", "555 123 4567", "1-555-123-4567",
    ],
)
def test_phone_formats(keyed, number):
    text = f"Reach us under {number}, or in 2024."
    assert kinds(text) == [("phone", number)]
    new, _ = replace(text, keyed)
    assert number not in new
    assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", text)


@pytest.mark.parametrize(
    "text, number",
    [
        ("Call me at 555-1234.", "555-1234"), ("Tel.: 5551234567", "5551234567"),
        ("mein Telefon ist 1234567", "1234567"), ("phone 555-1234 or 555-9876", "555-9876"),
    ],
)
def test_phones_with_a_cue(text, number):
    assert ("phone", number) in kinds(text)


@pytest.mark.parametrize(
    "text",
    [
        "on 01/02/2024 and 01.02.2024 10:30", "500-1000 of 1 000 000 000", "epoch 1700000000",
        "ISBN 0306406152", "at 10:30:45", "std::vector and a :: b and dead::beef", "0.0612345678",
        "mac 00:1a:2b:3c:4d:5e", "::1",
    ],
)
def test_other_numbers_stay(text):
    assert kinds(text) == []


@pytest.mark.parametrize(
    "shown, first",
    [
        ("2001:db8::8a2e:370:7334", "2001:"), ("2001:0DB8:0000:0000:0000:8A2E:0370:7334", "2001:"),
        ("fe80::1ff:fe23:4567:890a", "fe80:"), ("2001:db8:1:2:3:4:5:6", "2001:"), ("2001:db8::", "2001:"),
    ],
)
def test_ipv6(keyed, shown, first):
    text = f"from [{shown}]:80 and IP:{shown}. End"
    assert kinds(text) == [("ip", shown)] * 2
    new, entities = replace(text, keyed)
    assert shown not in new and new[6:].startswith(first) and len(new) == len(text)
    assert entities[0]["mark"] == entities[1]["mark"]


def test_ipv6_map_is_one_to_one(keyed):
    values = [f"2001:db8::{n:x}:1" for n in range(1, 2000)]
    assert len({keyed.of("ip", v) for v in values}) == len(values)


@pytest.mark.parametrize(
    "piece",
    ["a", "Mr Anna Smith ", "1 ", "a@", "ab.c@de.com ", "Anna'a'", "1.2.3.4 ", "(0", "-", "7", "f"],
)
def test_long_runs_cost_the_same_per_character(keyed, piece):
    text = "Dr Anna Smith token=" + piece * (200_000 // len(piece)) + "@b.com"
    start = time.process_time()
    found = find_entities(text)
    for entity in found:
        keyed.of(entity.type, entity.normal)
    assert time.process_time() - start < 30
    assert all(a.end <= b.start for a, b in zip(found, found[1:]))


def test_addresses_from_their_at_sign():
    text = "x a.b+c@de.example.org, .@a.com a.@b.com @c.com d@e f@g.h1 i@j.kl@m.no"
    shown = [text[e.start : e.end] for e in find_entities(text) if e.type == "email"]
    assert shown == ["a.b+c@de.example.org", "i@j.kl"]


def test_a_name_again_before_an_apostrophe():
    text = "Dr Anna Petrova. Anna's, Anna-Lena, Annas, O'Anna, Petrova’s Anna"
    starts = [e.start for e in find_entities(text)]
    assert starts == [m.start() for m in re.finditer(r"Anna(?= )|Petrova|Anna(?='s)|Anna$", text)]
