"""Dictionary matches, linked words and names within names against plain versions."""

import random
import re

import pytest

from kelpwood.operators import dictionary as D

DOCS, NAMES = "k long, text string", "id long, name string"


def tokens(x):
    return [w for w in (w.strip(D.STRIP) for w in re.split(r"\s+", x or "")) if w]


def plain(docs, names):
    of = {}
    for i, n in names:
        key = tuple(tokens((n or "").lower()))
        if key:
            of[key] = min(i, of.get(key, i))
    out, most = [], max(map(len, of))
    for d, text in docs:
        t, reach = tokens((text or "").lower()), 0
        for at in range(len(t)):
            best = max((k for k in range(1, min(most, len(t) - at) + 1) if tuple(t[at : at + k]) in of), default=0)
            if best and at + best > reach:
                out.append((d, at, best, of[tuple(t[at : at + best])]))
            if best:
                reach = max(reach, at + best)
    return sorted(out)


@pytest.mark.parametrize("seed", [1])
def test_matches(spark, seed):
    rnd = random.Random(seed)
    vocab = ["red", "Ring", "steel", "Éclair", "a", "ring,", "(ring)", "old"]
    names = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 2, 3, 5])))) for i in range(25)] + [(90, ""), (91, " ,. "), (92, None), (93, "red " * 9 + "ring")]
    docs = [(i, " ".join(rnd.choice([*vocab, "x", "--", "\n"]) for _ in range(rnd.randint(0, 40)))) for i in range(60)] + [(100, None), (101, ""), (102, "red " * 9 + "ring"), (103, "red " * 3000)]
    got = D.matches(spark.createDataFrame(docs, DOCS), "k", "text", spark.createDataFrame(names, NAMES))
    assert sorted((r.doc, r.at, r.words, r.id) for r in got.collect()) == plain(docs, names)


def test_matches_of_nothing(spark):
    docs, names = spark.createDataFrame([(1, "red ring")], DOCS), spark.createDataFrame([(1, "red")], NAMES)
    assert D.matches(docs.limit(0), "k", "text", names).isEmpty() and D.matches(docs, "k", "text", names.limit(0)).isEmpty()


def test_linked_words(spark):
    names = spark.createDataFrame([(5, "Rust"), (3, "rust"), (7, "kafka"), (8, "The"), (9, "12345"), (10, "ab"), (11, "SQL"), (12, "Red Ring")], NAMES)
    docs = spark.createDataFrame([(1, "we use rust, Kafka and (kafka) the 12345 ab SQL red ring"), (2, None), (3, "RUST Rust rUst")], DOCS)
    got = sorted((r.doc, r.id) for r in D.linked_words(docs, "k", "text", names).collect())
    assert got == [(1, 3), (1, 7), (1, 11), (3, 3)]
    assert D.linked_words(docs, "k", "text", names, most=1).count() == 2


def test_names_within_names(spark):
    rnd = random.Random(3)
    names = ["".join(rnd.choice("abAB ") for _ in range(rnd.randint(1, 9))) for _ in range(120)] + ["customer#000000001", "000000001", "ustome", "abcd" * 50, None, ""]
    got = {(r.a, r.b) for r in D.containing_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    low = sorted({n.strip(" ").lower() for n in names if n})
    assert got == {(a, b) for a in low for b in low if a < b and min(len(a), len(b)) >= 4 and (a in b or b in a)}


def test_texts_are_not_exchanged(spark):
    """Where names are too many to be broadcast, what moves is parts of texts that may be names: no exchange has a text's tokens."""
    rnd = random.Random(2)
    vocab = ["red", "ring", "steel", "old", "a"]
    names = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 6)))) for i in range(40)]
    docs = [(i // 2, " ".join(rnd.choice([*vocab, "x", "y"]) for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = D.matches(spark.createDataFrame(docs, DOCS), "k", "text", spark.createDataFrame(names, NAMES))
        plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
        moved = re.findall(r"\(\d+\) Exchange\nInput[^:]*: \[(.*)\]", plan)
        assert len(moved) >= 2 and not any(re.search(r"\bt#", columns) for columns in moved)
        assert sorted((r.doc, r.at, r.words, r.id) for r in got.collect()) == plain(docs, names)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
