"""Line dedup, whitening and ranked search against plain versions, with odd inputs."""

import collections
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelpwood.llm import ranked, whitening
from kelpwood.llm.lines import line_dedup
from kelpwood.llm.queries import op11_whitening
from kelpwood.llm.ranked import build_index, count_terms, search

DOCS = "doc_id long, text string"


# ----------------------------------------------------------------- lines
def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain_lines(rows, least, chars):
    keys = lambda t: [low(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    seen = collections.defaultdict(set)
    for i, t in rows:
        for k in keys(t):
            seen[k].add(i)
    often = {k for k, ids in seen.items() if len(ids) >= least and len(k) >= chars}
    out = []
    for i, t in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t), strict=True) if k not in often]
        n = len(keys(t))
        out.append((i, "\n".join(kept), n, n - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "chars"), [(3, 1), (2, 4), (1, 1), (3, 0)])
def test_lines(spark, least, chars):
    rnd = random.Random(least)
    pool = ["Menu", " menu\t", "MENU", "É", "é", "ÉCOLE x", "école x", "", " ", "\x0bterms of use\r", "Terms Of Use", "ſ", "S", "İ", " menu"] + [f"line {i}" for i in range(20)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "menu\n" * 3000 + "tail"), (None, "menu\nonly here"), (None, "menu\nonly there"), (7, "menu\nagain"), (7, "menu\nagain"), (104, "menu\n")]
    got = line_dedup(spark.createDataFrame(rows, DOCS), least, chars)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr) == plain_lines(rows, least, chars)


def test_lines_of_odd_tables(spark):
    empty = line_dedup(spark.createDataFrame([], DOCS))
    assert empty.columns == ["doc_id", "text", "n_lines", "n_dropped"] and empty.isEmpty()
    odd = spark.createDataFrame([(i, f"same\n{i}", 5, "x", "y", 1, 2) for i in range(4)], DOCS + ", n_lines int, gone string, __lines string, h1 int, `a.b` int")
    got = line_dedup(odd, 4)
    assert got.columns == ["doc_id", "text", "gone", "__lines", "h1", "a.b", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect())) == [(i, str(i), "x", "y", 1, 2, 2, 1) for i in range(4)]


def test_a_copied_row_counts_once(spark):
    got = line_dedup(spark.createDataFrame([(1, "a\nb")] * 12 + [(2, "a")], DOCS), 3)
    assert {r.n_dropped for r in got.collect()} == {0} and got.count() == 13


# ----------------------------------------------------------------- whitening
def exact_covariance(x):
    """Of vectors of whole numbers, by fractions."""
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * int(v) - int(t) for v, t in zip(r, s, strict=True)] for r in x]
    return [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(len(s))] for i in range(len(s))]


def test_products_keep_two_doubles(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 40, (3000, 6)) + 10**9
    want, unique = exact_covariance(np.unique(x, axis=0).tolist()), len(np.unique(x, axis=0))
    each = spark.createDataFrame([(r.tolist(),) for r in np.unique(x, axis=0).astype(float)], "v array<double>").repartition(70)
    n, hi, lo = whitening._merged(each.mapInArrow(whitening._sums(6), whitening.PARTS), 6)
    assert n == unique and [int(a) + int(b) for a, b in zip(hi[0], lo[0], strict=True)] == np.unique(x, axis=0).sum(0).tolist()
    model = whitening.fit(spark.createDataFrame([(r.tolist(),) for r in x.astype(float)], "embedding array<double>"))
    _, hi, lo = whitening._merged(each.mapInArrow(whitening._products(6, model.mean), whitening.PARTS), 6)
    for i in range(6):
        for j in range(i, 6):
            got = (Fraction(hi[i, j]) + Fraction(lo[i, j])) / n
            assert abs(got - want[i][j]) <= Fraction(1, 10**26) * max(want[i][i], want[j][j])
    v = np.array([[float(c) for c in r] for r in want])
    assert np.allclose(model.values, np.linalg.eigvalsh(v)[::-1], rtol=1e-12)
    assert np.abs(model.components @ v - model.values[:, None] * model.components).max() <= 1e-12 * model.values[0]
    assert model.identity_error < 1e-12


def test_whitening_query(spark):
    folder = "/root/testdata/sf0.01"
    got = op11_whitening(spark, folder).toPandas()
    t = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(t.embedding.to_numpy()).astype(float)).astype(int) + 1000000
    each = np.unique(x, axis=0)
    n, s = len(each), each.sum(0)
    y = (n * each - s).astype(object)
    v = np.array([[float(Fraction(int(c), n**3)) for c in r] for r in y.T @ y])
    w, q = np.linalg.eigh(v)
    w, q = w[::-1][:16], q[:, ::-1][:, :16]
    p = got.pivot(index="vec_id", columns="component", values="whitened").loc[t.vec_id].to_numpy()
    want = ((n * x - s) / n @ q) / np.sqrt(w)
    assert np.abs(p - want * np.sign((p * want).sum(0))).max() < 1e-11
    assert np.allclose(got.groupby("component").explained.first(), w / np.trace(v), rtol=1e-12)
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-10
    assert got.groupby("vec_id").deviation.first().loc[t.vec_id].tolist() == [int(d) for d in ((n * x - s).astype(object) ** 2).sum(1)]


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (2, [2.0, 1.0, 0.5]), (3, [2.0, 1.0, 0.5]), (4, None), (5, [1.0, None, 2.0]), (6, [nan, 0.0, 0.0]), (7, [inf, 0.0, 0.0]), (8, [1.0]), (9, []), (None, [4.0, 4.0, 0.5]), (10, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("explained", F.lit("mine")).withColumn("v", F.lit(1))
    model = whitening.fit(df)
    assert model.n == 3 and model.dims == 3
    out = whitening.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "v", "whitened", "explained", "identity_error"]
    got = {r.vec_id: r.whitened for r in out.collect()}
    assert set(got) == {1, 2, 3, None} and got[2] == got[3] and all(w[2] is None and None not in w[:2] for w in got.values())  # the third component doesn't vary
    alone = df.filter("vec_id in (2, 3)")
    only = whitening.whiten(alone, whitening.fit(alone)).collect()
    assert len(only) == 2 and only[0].whitened == [None] * 3 and only[0].explained is None and only[0].identity_error is None
    for nothing in (df.filter("false"), df.filter("vec_id in (4, 5, 9)")):
        assert whitening.fit(nothing) is None and whitening.whiten(nothing, None).isEmpty()


def test_close_eigenvalues_are_refined():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0].astype(np.longdouble)
    q += q @ (np.eye(20) - q.T @ q) / 2  # orthonormal beyond doubles
    q += q @ (np.eye(20) - q.T @ q) / 2
    w = np.array([1 + i * 1e-6 for i in range(20)], np.longdouble)
    v = (q * w) @ q.T
    hi = v.astype(np.float64)
    values, x, _ = whitening.eigen(hi, (v - hi).astype(np.float64), 1)
    true = q.T[::-1].astype(np.float64)
    assert np.abs(np.abs((x * true).sum(1)) - 1).max() < 1e-14
    assert min(np.abs(a - b * np.sign((a * b).sum())).max() for a, b in zip(x, true, strict=True)) < 1e-12
    assert np.allclose(values, w[::-1].astype(float), rtol=1e-15)


# ----------------------------------------------------------------- search
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k):
    of = lambda t: TERMS.findall(low(t or ""))
    tf = [(i, collections.Counter(of(t))) for i, t in docs]
    n = sum(bool(c) for _, c in tf)
    total = sum(sum(c.values()) for _, c in tf)
    df = collections.Counter(t for _, c in tf for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(of(t))
    out = []
    for item, its in asked.items():
        found = []
        for i, c in tf:
            m = 50 + 50 * sum(c.values()) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in its if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("k", "parts", "shard"), [(5, 1, 1 << 30), (7, 6, 400), (3, 9, 1)])
def test_search(spark, monkeypatch, k, parts, shard):
    monkeypatch.setattr(ranked, "SHARD_BYTES", shard)
    rnd = random.Random(k)
    vocab = [f"w{i}" for i in range(40)] + ["École", "ÉCOLE", "x1"]
    pick = lambda n: " ".join(rnd.choice(vocab[: rnd.choice([4, 12, 43])]) for _ in range(n)).replace("w3 ", "W3-")
    docs = [(i * 3, pick(rnd.randint(0, 30))) for i in range(150)]
    docs += [(1000 + i, "w1 w2 w3 w5 x1") for i in range(60)]  # copies: ties
    docs += [(9, None), (10, ""), (11, "-- ,"), (None, "w1 w2"), (13, "w7 " * 5000), (14, "w1 w2"), (15, "日本 語,日本")]
    rnd.shuffle(docs)
    items = [(i, pick(rnd.randint(1, 12))) for i in range(12)] + [(50, None), (51, "nowhere"), (52, "日本"), (53, "w1 w2 w3 w5 x1"), (None, "w9"), (53, "w20")]
    frame = spark.createDataFrame(docs, DOCS).repartition(parts).withColumn("id", F.lit("x")).withColumn("terms", F.lit(0))
    index = build_index(frame)
    got = search(index, spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1)), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == plain_search(docs, items, k)


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 4)
    docs = [(i, f"a{i % 5} b{i % 7} c{i % 11}") for i in range(100)]
    items = [(i, f"a{i % 5} b{(i + 1) % 7} z") for i in range(9)]
    assert rows_of(search(build_index(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(items, DOCS), 4, item_col="doc_id")) == plain_search(docs, items, 4)


def test_search_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], DOCS)
    for index in (docs, none, spark.createDataFrame([(1, None), (2, "!")], DOCS)):
        for items in (none, spark.createDataFrame([(1, None)], DOCS), spark.createDataFrame([(1, "q")], DOCS)):
            assert search(build_index(index), items, 3, item_col="doc_id").isEmpty()


def test_terms_of_neighbouring_texts_stay_apart():
    texts = pa.array(["a b", "c", None, "", "é-É", "-", "d "] * 3)[2:]
    assert count_terms(texts).tolist() == [len(TERMS.findall(t.as_py() or "")) for t in texts]
    w = ranked.terms(texts)
    assert [[w.dictionary[c].as_py() for c in w.codes[a:b]] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)] == [TERMS.findall(low(t.as_py() or "")) for t in texts]


def test_a_tree_finds_what_sorting_finds():
    rng = np.random.default_rng(5)
    n, each = 700, []
    for _ in range(9):
        d = np.sort(rng.choice(n, rng.integers(1, n), replace=False))
        each.append((d, rng.integers(1, 50, len(d)) * 1000))
    doc = np.concatenate([d[np.argsort(-i, kind="stable")] for d, i in each])
    impact = np.concatenate([i[np.argsort(-i, kind="stable")] for _, i in each]).astype(np.int32)
    tree = ranked.Tree(n, np.cumsum([len(d) for d, _ in each]).tobytes(), impact.tobytes(), ranked.wavelet(doc, ranked.levels_of(n)).tobytes())
    for k in (1, 10, 1000):
        weight, code = rng.integers(1, 5, 9), rng.permutation(9)[:6]
        score = np.zeros(n, np.int64)
        for c, w in zip(code, weight[:6], strict=True):
            score[each[c][0]] += w * each[c][1]
        order = np.lexsort((np.arange(n), -score))
        order = order[score[order] > 0][:k]
        docs, scores = tree.best(code, weight[:6], k)
        assert docs.tolist() == order.tolist() and scores.tolist() == score[order].tolist()
        for least, limit in ((int(score[order[-1]]), int(order[-1])), (int(score.max()), 0)):
            docs, scores = tree.best(code, weight[:6], k, least, limit)
            want = [i for i in order if (score[i], -i) > (least, -limit)]
            assert docs.tolist() == want
