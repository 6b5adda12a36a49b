"""The stages one after another: columns, and what each drops, against plain versions on its own input."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as p
from kelpwood.llm import langid, quality
from kelpwood.llm.common import materialize

FOLDER = "/root/testdata/sf0.001"


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def good_documents(rows, chance):
    """Documents that stay: evidence under the shrunken means of host and path, in plain Python; rows: doc_id, host, path."""
    host, path = defaultdict(list), defaultdict(list)
    for (_, h, s), c in zip(rows, chance, strict=True):
        host[h].append(c)
        path[h, s].append(c)
    mean = min(max(float(np.mean(chance)), 1e-3), 1 - 1e-3)

    def strength(groups):
        big = [g for g in groups if len(g) >= 2]
        n, noise = sum(map(len, big)), mean * (1 - mean)
        var = sum(len(g) * (np.mean(g) - mean) ** 2 for g in big) / n
        return min(max(noise / max(var - noise * len(big) / n, noise / 1000) - 1, 2.0), 1000.0)

    kh, kp, inside, logit = strength(host.values()), strength(path.values()), lambda x: min(max(x, 1e-3), 1 - 1e-3), lambda x: math.log(x / (1 - x))
    out = set()
    for (i, h, s), c in zip(rows, chance, strict=True):
        a = inside((sum(host[h]) - c + kh * mean) / (len(host[h]) - 1 + kh))
        b = inside((sum(path[h, s]) - c + kp * a) / (len(path[h, s]) - 1 + kp))
        if logit(c) + logit(b) - logit(mean) >= 0:
            out.add(i)
    return out


def without_passages(texts, window):
    """Each text without the words of windows that start in an earlier one; those that lose nothing as they are, those that lose all gone."""
    first, out = {}, {}
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    for i, t in texts.items():
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        if not any(gone):
            out[i] = t
        elif not all(gone):
            out[i] = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in p.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, FOLDER), name)
        seen[name] = (before, docs)
        assert name == "packing" or docs.columns == names
    kept = {n: ({r["doc_id"]: r["text"] for r in a.collect()}, {r["doc_id"] for r in b.collect()}) for n, (a, b) in seen.items()}
    texts = kept["language_id"][0]
    model = langid.train_split(seen["language_id"][0])
    score = {i: float(model.predict(langid.features(pa.array([t])))[1][0]) for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    sure = {i for i, x in score.items() if abs(x - p.LEAST_LANGUAGE_SCORE) > 1e-3}
    assert kept["language_id"][1] & sure == {i for i in sure if score[i] >= p.LEAST_LANGUAGE_SCORE}
    assert kept["language_id"][1] <= set(score)

    rows = seen["quality"][0].select("doc_id", "source", F.concat_ws("/", "source", "lang").alias("path"), "text").collect()
    scorer = quality.train(seen["quality"][0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    chance = np.clip(scorer.chance(pa.array([r["text"] for r in rows])), 1e-6, 1 - 1e-6).astype(float)
    stay = good_documents([(r["doc_id"], r["source"] or "", r["path"]) for r in rows], chance)
    assert len(stay ^ kept["quality"][1]) <= 1  # a tie at the threshold may fall either way
    good = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1 and toxic = 0").collect()}
    assert len(good & kept["quality"][1]) > 0.95 * len(good & set(kept["quality"][0]))
    rows, left = kept["minhash_near_dedup"]
    sets = {i: shingles(t) for i, t in rows.items()}
    up = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low = min(up[a], up[b])
                up = {i: low if c in (up[a], up[b]) else c for i, c in up.items()}
    assert left == {i for i, c in up.items() if i == c}
    before, after = seen["substring_dedup"]
    want = without_passages({r["doc_id"]: r["text"] for r in before.collect()}, p.REPEATED_WORDS)
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in after.collect()}
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())


ODD = ("bits", "__gone", "__site_path", "n_removed", "score", "keep", "row", "doc", "path", "lang_pred", "word", "a.b")


def test_stages_keep_odd_columns_and_rows(spark):
    """Columns of any name come through each stage unchanged; nulls, empty and repeated rows have the results that the docstrings state."""
    plain = spark.read.parquet(f"{FOLDER}/documents.parquet")
    like = [(10**9, None, None, None, None), (10**9 + 1, "", "en", None, 0), (None, "the same words without an id", None, "x", 1), (None, "the same words without an id", None, "x", 1)]
    twice = plain.orderBy("doc_id").limit(3)
    docs = plain.unionByName(twice).unionByName(twice.withColumn("text", F.concat(F.lit("zz "), "text"))).unionByName(spark.createDataFrame(like, plain.schema))
    odd = materialize(docs.select("*", *[F.xxhash64("doc_id", F.lit(c)).alias(c) for c in ODD]), "odd")
    least = {r.doc_id: r.text for r in odd.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    for name, stage in p.STAGES[:-1]:
        out = materialize(stage(spark, odd, FOLDER), name)
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
        assert out.filter(" or ".join(f"not `{c}` <=> xxhash64(doc_id, '{c}')" for c in ODD)).isEmpty()
        empty = stage(spark, odd.limit(0), FOLDER)
        assert empty.columns == odd.columns and empty.isEmpty()
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name in ("language_id", "quality"):
            assert not {10**9, 10**9 + 1} & set(ids)
        else:
            assert {10**9, 10**9 + 1} <= set(ids)
        if name == "minhash_near_dedup":
            known = [i for i in ids if i is not None]
            assert len(known) == len(set(known)) and ids.count(None) == 2
            texts = {r.doc_id: r.text for r in out.collect()}
            assert all(texts[r.doc_id] == least[r.doc_id] for r in twice.collect() if r.doc_id in texts)
    pieces = p.packing(spark, odd, FOLDER)
    assert pieces.filter("doc_id = 1000000000").count() == 1
    assert p.packing(spark, odd.limit(0), FOLDER).isEmpty()
