import random

from pagesift.operators import presence
from pagesift.sources.libsvm import to_long

SHAPE = "idx int, keyword string, fullword boolean, nocase boolean"


def hits(df):
    return sorted(tuple(r) for r in to_long(df, ["sample_id"]).collect())


def test_automata_equal_the_pattern_plan(spark):
    rng = random.Random(2)
    words = ["var", "Var", "script", "é", "x1", "a", "meta charset", "script var", "<div", "a.b", "İs", "7", "\n"]
    rules = [(n, w, bool(f), bool(c)) for n, (w, f, c) in enumerate((w, f, c) for w in words for f in (0, 1) for c in (0, 1))]
    rules += [(500 + n, rules[n][1].swapcase(), True, True) for n in range(len(rules))]
    pieces = [*words, "VAR", "varx", "_var_", " ", "  ", "-", "SCRIPT", "É", "K", "meta  charset", "A.B", "aXb"]
    texts = ["".join(rng.choices([*pieces, " ", " "], k=rng.randrange(30))) for _ in range(200)]
    samples = spark.createDataFrame(
        [(n, t) for n, t in enumerate([*texts, "", None])], "sample_id long, content string"
    )
    table = spark.createDataFrame(rules, SHAPE)
    expected = hits(presence.with_rule_presence(samples, rules))
    assert hits(presence.rule_presence(samples, table)) == expected
    for block in (7, 1000):
        assert hits(presence.rule_presence(samples, table, limit=5, block=block)) == expected


def test_a_hundred_thousand_rules(spark):
    rules = [(n, f"w{n} v{n % 7}" if n % 2 else f"w{n}", True, True) for n in range(100_000)]
    rng = random.Random(3)
    texts = [" ".join(f"{w}{rng.randrange(120_000)} v{rng.randrange(7)}" for w in "w" * 80) for _ in range(20)]
    samples = spark.createDataFrame(list(enumerate(texts)), "sample_id long, content string")
    found = hits(presence.rule_presence(samples, spark.createDataFrame(rules, SHAPE)))
    literals = {k: n for n, k, _, _ in rules}
    expected = set()
    for sample, text in enumerate(texts):
        tokens = text.split()
        for gram in [*tokens, *map(" ".join, zip(tokens, tokens[1:]))]:
            if gram in literals:
                expected.add((sample, literals[gram], 1.0))
    assert found == sorted(expected)


def test_bounded_words_are_joined_and_not_sent_to_tasks(spark):
    rules = [(n, f"W{n % 40}", True, True) for n in range(60)]
    samples = spark.createDataFrame(
        [(1, "w3 W4-w3"), (1, "w5"), (None, "w6 w7x"), (None, "w6 w7x"), (2, None), (3, "")],
        "sample_id long, content string",
    )
    found = presence.rule_presence(samples, spark.createDataFrame(rules, SHAPE), limit=5)
    assert "EvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [(r["sample_id"], [f["idx"] for f in r["features"]]) for r in found.collect()]
    assert sorted(rows, key=str) == sorted(
        [(1, [3, 4]), (1, [5]), (None, [6]), (None, [6]), (2, []), (3, [])], key=str
    )
