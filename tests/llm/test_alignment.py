import hashlib
import json
import random
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pagesift.llm import alignment
from pagesift.llm.alignment import TOKENIZERS, Aligner, aligned, compose, ranges

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    names = json.load(open(f"{TOKENIZERS}/byte_bpe_50k.json"))["model"]["vocab"]
    return a, {i: t for t, i in names.items()}, SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")


def token_ends(tokens):
    ends, at = [], 0
    for token in tokens:
        at += len(token)
        ends.append(at)
    return ends


def plain_groups(encoders, text):
    """Groups of (A ids, B ids) of the whole text; none if it has no tokens."""
    a, names, b = encoders
    if not text:
        return []
    whole = (" " + text).encode()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    letters = alignment._byte_alphabet()
    a_tokens = [bytes(letters[c] for c in names[i]) for i in a_ids]
    b_tokens = [
        bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in ((i, b.id_to_piece(i)) for i in b_ids)
    ]
    if b"".join(a_tokens) != whole or b"".join(b_tokens) != whole:
        return []
    a_ends, b_ends = token_ends(a_tokens), token_ends(b_tokens)
    common = sorted(set(a_ends) & set(b_ends))
    groups = [([], []) for _ in common]
    for side, (ids, ends) in enumerate(((a_ids, a_ends), (b_ids, b_ends))):
        for number, end in zip(ids, ends):
            groups[next(n for n, c in enumerate(common) if c >= end)][side].append(number)
    return groups


def plain(encoders, texts):
    every = [plain_groups(encoders, t) for t in texts]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in every]
    counts = Counter(pair for own in links for pair in own)
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for groups, own in zip(every, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((
            sum(len(a) for a, _ in groups),
            sum(len(b) for _, b in groups),
            len(groups),
            sum(own.values()),
            sum(n for pair, n in own.items() if counts[pair] == most[pair[0]]),
            sum(n * counts[pair] for pair, n in own.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return rows, counts


def result(df):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


ODD = [
    "", " ", "  two  blanks ", "\n\nline\n \n", "a\tb\r\n c", "x▁y z", "<s> </s> <unk> <0x41> <|endoftext|>",
    "日本語 テスト の文", "é ﬁ 　wide   nb", "don't we'll they're 's", "\x00 \x1c \x85 q",
    "🙂🙂 👩‍👩‍👧 x", "a" * 3000, "word " * 50 + "  ", "Привет, мир! Ωμέγα",
]


def test_equals_plain_version(spark, encoders):
    rng = random.Random(3)
    words = "the quick unbelievable antidisestablishmentarianism naïve 12345 C++ foo_bar über 東京 ok".split()
    texts = ODD + [
        "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", ", ", ""]) for _ in range(n))
        for n in (1, 2, 5, 20, 100, 400, 900)
    ]
    expected, counts = plain(encoders, texts)
    df = spark.createDataFrame(
        [(n, t, "x", 1) for n, t in enumerate(texts)], "doc_id long, text string, row string, code int"
    ).repartition(3)
    # byte ranges that cut nearly every word, few hot pairs, and the defaults
    for chunk, hot in ((7, 5), (64, 0), (alignment.CHUNK, alignment.HOT_PAIRS)):
        found, pairs = aligned(df, chunk=chunk, hot_pairs=hot)
        assert result(found) == dict(enumerate(expected))
        assert {(r.a, r.b): r.documents for r in pairs.collect()} == dict(counts)


def test_compose_is_associative_and_gives_the_whole():
    files = [open(f"{TOKENIZERS}/{n}", "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    aligner = Aligner(*files)
    text = " " + "immeasurable 東京都 supercalifragilistic über-ok, yes " * 12
    parts = []
    for first, last, low, high in ranges(text, 5):
        piece = text[first:last]
        begin = len(text[first:low].encode())
        cut = alignment._PLACE.split(piece)
        size = len(text[low:high].encode())
        parts.append(aligner.range(cut, aligner.known([cut]), begin, begin + size))
    assert len(parts) > 30 and any(p.suffix_a or p.prefix_a for p in parts)
    cut = alignment._PLACE.split(text)
    known = aligner.known([cut])
    whole = compose([aligner.whole([known[w] for w in cut])])
    rng = random.Random(1)
    for _ in range(20):
        left = list(parts)
        while len(left) > 1:
            at = rng.randrange(len(left) - 1)
            left[at : at + 2] = [compose(left[at : at + 2])]
        assert repr(left[0]) == repr(whole)


def test_long_text_goes_through_several_levels(spark, encoders):
    text = "several words make a long enough text, " * 200
    expected, _ = plain(encoders, [text[:-1]])
    df = spark.createDataFrame([(5, text[:-1])], "doc_id long, text string")
    assert result(aligned(df, chunk=20)[0]) == {5: expected[0]}


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, None), (None, "a b"), (2, "a b"), (2, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(aligned(df)[0].collect(), key=str)
    # the two pairs are in three documents each
    assert [(r.doc_id, r.n_a, r.n_links, r.n_best, r.count_sum) for r in found] == [
        (1, 0, 0, 0, 0), (2, 2, 2, 2, 6), (2, 2, 2, 2, 6), (None, 2, 2, 2, 6)
    ]
    assert aligned(df.limit(0))[0].collect() == []


def test_query(spark, encoders):
    from pagesift.llm.queries import QUERIES

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    expected, _ = plain(encoders, [r.text for r in docs])
    found = result(QUERIES["op11_alignment"](spark, FOLDER))
    assert found == {r.doc_id: row for r, row in zip(docs, expected)}


def test_one_foreign_word_does_not_split_the_others():
    """Words beside one that B cannot give back are still encoded many at a time."""
    files = [open(f"{TOKENIZERS}/{f}", "rb").read() for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    aligner = Aligner(*files)
    words = [f" w{n}x" for n in range(2_000)] + [" a▁b"]
    calls, encode = [], aligner._encode

    def counted(texts):
        calls.append(len(texts))
        return encode(texts)

    aligner._encode = counted
    known = aligner.known([words])
    assert len(calls) < 60
    assert aligner.valid[[known[w] for w in words]].tolist() == [True] * 2_000 + [False]


def test_forgotten_words_change_nothing(monkeypatch):
    """A worker that remembers next to nothing aligns as one that remembers all."""
    files = [open(f"{TOKENIZERS}/{f}", "rb").read() for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé語", k=rng.randrange(1, 9))) for _ in range(60)] + ["x" * 300, "two\nlines", "a▁b"]
    texts = [" " + " ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(40)]
    texts += ["  two", " x  y ", "", "  a b", " a\u2028 b", " a \u3000b", " a\u2028b c", " a\tb c", " a\n b", " 1\n\n2 3"]
    whole = Aligner(*files)
    expected = [repr(whole.whole(p)) if len(p) else "" for p in whole.places_of(texts)]
    monkeypatch.setattr(alignment, "WORDS", 8)
    few = Aligner(*files)
    for _ in range(2):
        found = []
        for low in range(0, len(texts), 3):
            found += [repr(few.whole(p)) if len(p) else "" for p in few.places_of(texts[low : low + 3])]
        assert found == expected
    few.known([[f" {n}" for n in range(99)] + [" " + "x" * 300]])
    few.known([])
    assert len(few.names) <= 8 and not any(len(w) > alignment.WORD_CHARS for w in few.names)
    cuts = [alignment.words_of(t) if t else [] for t in texts]
    assert cuts == [alignment._PLACE.split(t) if t else [] for t in texts]
