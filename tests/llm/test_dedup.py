"""MinHash groups and substring duplicates against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelpwood.llm.components import connected_components
from kelpwood.llm.minhash import near_duplicates, sub_bands
from kelpwood.llm.substring import _firsts, _lookup, factors, substring_dedup

SCHEMA = "doc_id long, text string"


def words(t):
    return (t or "").encode().split()


def groups(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = [x.lower() for x in words(t)]  # bytes: A-Z only
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def crowd(seed):
    """Bases with nearer bases around them, and copies of all with few to many edits: many links just above and below the threshold."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(2):
        base = [rnd.choice(vocab) for _ in range(100)]
        bases = [base]
        for _ in range(3):
            b = list(base)
            for j in rnd.sample(range(100), rnd.randint(3, 12)):
                b[j] = rnd.choice(vocab)
            bases.append(b)
        for _ in range(120):
            b = list(rnd.choice(bases))
            for j in rnd.sample(range(100), rnd.choice([0, 0, 1, 2, 3, 5, 8])):
                b[j] = rnd.choice(vocab)
            docs.append((len(docs) * 7 % 1009, " ".join(b[: 100 - rnd.choice([0, 0, 0, 9])])))
    return docs


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_groups(spark, k, percent):
    docs = crowd(k)
    got = near_duplicates(spark.createDataFrame(docs, SCHEMA), k, percent).collect()
    comp, size = groups(docs, k, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == comp
    assert {r["doc_id"]: r["n_shingles"] for r in got} == size
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_documents(spark):
    docs = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "b a"), (6, None), (None, "a b"), (3, "a b"), (7, "x " * 30000), (8, "x " * 30000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], SCHEMA + ", bands int")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, 3, 85).collect())
    assert got == [(False, 1, 0, 1, True), (False, 2, 0, 2, True), (False, 3, 1, 3, True), (False, 3, 1, 3, True), (False, 4, 1, 3, False), (False, 5, 1, 5, True), (False, 6, 0, 6, True), (False, 7, 1, 7, True), (False, 8, 1, 7, False), (True, 0, 1, None, True)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sub_bands():
    assert 2 * (1 - 0.85**2) ** sub_bands(0.85) <= 1e-4 < 2 * (1 - 0.85**2) ** (sub_bands(0.85) - 1)


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    up = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: c for x, c in up.items() if x in got} and set(got) == {x for a, b in pairs if a != b for x in (a, b)}


def kept(docs, window):
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, t in sorted(docs, key=lambda d: order(d[0])):
        w = words(t)
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if order(first[tuple(w[j : j + window])]) < order(i):
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 600, 8 << 20])
def test_substrings(spark, block):
    rnd = random.Random(block)
    vocab = [f"w{i}" for i in range(40)] + ["é\u00a0x", "\u2003"]
    passages = [[rnd.choice(vocab) for _ in range(n)] for n in (13, 14, 30, 60)]
    docs = [(None, " ".join(passages[2])), (5, None), (6, ""), (7, "a b"), (900, " ".join(passages[3])), (901, " ".join(passages[3])), (901, " ".join(passages[3]))]
    for i in range(60):
        w = []
        for _ in range(rnd.randint(1, 5)):
            p = rnd.choice(passages)
            w += rnd.choice([p, p[rnd.randint(0, 8) :], p[: rnd.randint(1, len(p))], [rnd.choice(vocab) for _ in range(20)], ["a"] * 16])
        docs.append((10 + i * 7 % 61, rnd.choice([" ", "\n", "\t "]).join(w)))
    got = substring_dedup(spark.createDataFrame([(*d, 3) for d in docs], SCHEMA + ", n_words int"), 13, block, respace=True)
    got = got.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()
    assert sorted(map(tuple, got), key=str) == kept(docs, 13)


def test_texts_that_stay(spark):
    docs = [(1, "a\n\n b  c"), (2, None), (3, "p q r s"), (4, "x p q r y")]
    got = {r["doc_id"]: (r["text"], r["n_removed"], [tuple(f) for f in r["factors"]]) for r in substring_dedup(spark.createDataFrame(docs, SCHEMA), 3).collect()}
    assert got == {1: ("a\n\n b  c", 0, []), 2: (None, 0, []), 3: ("p q r s", 0, []), 4: ("x y", 3, [(1, 3, 3, 0)])}
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_factors():
    """Two references for five windows of one text: the second factor starts where the first ends; another text starts anew."""
    place, doc = np.array([0, 1, 2, 3, 4, 0]), np.array([0, 0, 0, 0, 0, 1])
    ref, ref_place = np.array([7, 7, 7, 9, 9, 9]), np.array([5, 6, 7, 20, 21, 22])
    assert factors(place, doc, ref, ref_place, 3).tolist() == [[0, 0, 5, 7, 5], [0, 5, 2, 9, 22], [1, 0, 3, 9, 22]]


def test_factors_are_copies(spark):
    """Each factor's words are those at its reference, in an earlier document."""
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(30)]
    passages = [[rnd.choice(vocab) for _ in range(n)] for n in (20, 33, 50)]
    docs = [(i, " ".join(sum((rnd.choice(passages)[rnd.randint(0, 6) :] for _ in range(4)), []))) for i in range(40)]
    text = {i: t.split() for i, t in docs}
    got = substring_dedup(spark.createDataFrame(docs, SCHEMA), 8, block_bytes=700).collect()
    assert sum(len(r["factors"]) for r in got) > 40
    for r in got:
        assert r["n_removed"] == sum(f["length"] for f in r["factors"])
        for f in r["factors"]:
            assert f["ref_doc"] < r["doc_id"]
            assert text[r["doc_id"]][f["start"] : f["start"] + f["length"]] == text[f["ref_doc"]][f["ref_start"] : f["ref_start"] + f["length"]]


def test_equal_first_hashes():
    """Windows whose 64-bit hashes collide are told apart by the second hash."""
    full, second = np.array([5, 5, 9, 5], np.uint64), np.array([1, 2, 1, 1])
    key, check, spot, number = _firsts(full, second, np.array([30, 10, 20, 40]))
    assert list(zip(key.tolist(), check.tolist(), spot.tolist())) == [(5, 1, 30), (5, 2, 10), (9, 1, 20)] and number.tolist() == [0, 1, 2, 0]
    known = pa.table({"w": np.array([5, 9, 5]), "spot": np.array([2, 7, 1]) << 48 | 3})
    assert _lookup(key, check, known).tolist() == [2, 0, -1]
