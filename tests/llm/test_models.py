"""Language identification and quality: held-out accuracy, plain versions and odd rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelpwood.llm import langid, quality
from kelpwood.llm.queries import op1_quality, op10_language_id

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


def test_language_accuracy(spark, docs):
    got = op10_language_id(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() == docs.count()
    assert got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert got.filter("score < 0 or score > 1 or held_out <> (crc32(cast(cast(doc_id as string) as binary)) % 5 = 0)").isEmpty()


def test_language_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, "123 !?"), (None, "Der die und das nicht"), (3, "123 !?"), (4, "the " * 50000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    got = langid.split(langid.identify(df, langid.train_split(docs, 100))).collect()
    assert len(got) == 6
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (1, 2, 3))
    assert [(r["lang_pred"], r["held_out"]) for r in got if r["doc_id"] is None] == [("de", False)]
    none = langid.identify(df, langid.train_split(docs.limit(0)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.identify(df.limit(0), None).count() == 0


def test_one_language(spark):
    df = spark.createDataFrame([(i, "some words here", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(df, langid.train_split(df)).collect()} == {"en"}


def test_quality(spark, docs):
    got = op1_quality(spark, FOLDER)
    assert got.count() == docs.count()
    j = got.join(spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", F.col("quality").alias("q"), "toxic"), "doc_id")
    share = lambda c: j.filter(c).agg(F.avg(F.col("keep").cast("int"))).first()[0]
    assert share("q = 1 and toxic = 0") > 0.97 and share("q = 0") < 0.1 and share("toxic = 1") < 0.3


def test_quality_sites_shrink(spark):
    """A site with one row stays near the global mean; one with many goes to its own."""
    rows = [(i, "x", "big", "p") for i in range(200)] + [(1000, "x", "small", "p"), (1001, None, None, None), (1002, "", "big", None), (1000, "x", "small", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string").withColumn("keep", F.lit("own"))
    got = quality.score_quality(df, None, "host", "path", ["doc_id", "keep"]).collect()
    assert len(got) == 204 and got[0].__fields__ == ["doc_id", "evidence", "host_posterior", "path_posterior", "quality", "keep"]
    assert all(not r["keep"] for r in got if r["doc_id"] in (1001, 1002))
    assert quality.score_quality(df.limit(0), None, "host", "path", ["doc_id"]).count() == 0


def posteriors(rows, chance):
    """The operator's arithmetic in plain Python: rows (host, path), their chances -> host and path posterior and quality of each."""
    host, path = defaultdict(list), defaultdict(list)
    for (h, p), c in zip(rows, chance, strict=True):
        host[h].append(c)
        path[h, p].append(c)
    mean = min(max(sum(chance) / len(chance), 1e-3), 1 - 1e-3)

    def strength(groups):
        big = [g for g in groups if len(g) >= 2]
        if not big:
            return 20.0
        n = sum(map(len, big))
        var, noise = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in big) / n, mean * (1 - mean)
        return min(max(noise / max(var - noise * len(big) / n, noise / 1000) - 1, 2.0), 1000.0)

    kh, kp = strength(host.values()), strength(path.values())
    inside = lambda x: min(max(x, 1e-3), 1 - 1e-3)
    logit = lambda x: math.log(x / (1 - x))
    out = []
    for (h, p), c in zip(rows, chance, strict=True):
        a = inside((sum(host[h]) - c + kh * mean) / (len(host[h]) - 1 + kh))
        b = inside((sum(path[h, p]) - c + kp * a) / (len(path[h, p]) - 1 + kp))
        out.append((a, b, 1 / (1 + math.exp(-(logit(c) + logit(b) - logit(mean))))))
    return out


def test_quality_against_plain_posteriors(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    some = docs.withColumn("path", F.concat_ws("/", "source", "lang"))
    model = quality.train(some, labels, most=400)
    rows = sorted(quality.score_quality(some, model, "source", "path", ["doc_id", "source", "lang", "text"]).collect(), key=lambda r: r["doc_id"])
    want = posteriors([(r["source"] or "", "/".join(x for x in (r["source"], r["lang"]) if x is not None)) for r in rows], [r["evidence"] for r in rows])
    assert np.allclose([(r["host_posterior"], r["path_posterior"], r["quality"]) for r in rows], want, atol=1e-9)
    chance = model.chance(pa.array([r["text"] for r in rows]))
    assert np.allclose([r["evidence"] for r in rows if r["text"]], np.clip(chance, 1e-6, 1 - 1e-6)[[bool(r["text"]) for r in rows]], atol=1e-5)
    # a site with many good documents lifts its own, but less than the documents' mean, and one document of a site hardly moves
    by_site = defaultdict(list)
    for r in rows:
        by_site[r["source"], r["lang"]].append(r)
    mean = sum(r["evidence"] for r in rows) / len(rows)
    for site in by_site.values():
        own = sum(r["evidence"] for r in site) / len(site)
        for r in site[:3]:
            assert min(own, mean, r["host_posterior"]) - 0.35 <= r["path_posterior"] <= max(own, mean, r["host_posterior"]) + 0.35


def test_quality_model_is_a_plain_regression(spark, docs):
    """Each head's chance from its weights, word by word."""
    model = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), most=300)
    texts = [r["text"] for r in docs.select("text").limit(30).collect()] + ["", "a " * 200000]
    shape, doc, word = quality.features(pa.array(texts))
    got = [head.chance(shape, doc, word) for head in model.heads]
    for head, values in zip(model.heads, got, strict=True):
        weight = dict(zip(head.words.tolist(), head.w[quality.SHAPES : -1].tolist(), strict=True))
        for i, v in enumerate(values):
            z = head.w[-1] + sum(4 * float(a) * b for a, b in zip(shape[i], head.w, strict=False))
            z += sum(weight.get(w, 0.0) for w in set(word[doc == i].tolist()))
            assert v == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-4)


def test_quality_names(spark):
    """Columns named like helper columns, very long texts and many ties."""
    df = spark.createDataFrame([(i, "x " * (300000 if i == 0 else 3), "h", "p", 1, 2, 3, 4, 5) for i in range(30)], "doc_id long, text string, host string, path string, np int, sp int, nh int, __host int, __p int")
    got = quality.score_quality(df, None, "host", "path", df.columns)
    assert set(df.columns) < set(got.columns) and {tuple(r)[4:9] for r in got.collect()} == {(1, 2, 3, 4, 5)}


def plain_features(text):
    """Hashed counts of 1 to 3 byte n-grams, by a dictionary."""
    folded = [b if b >= 128 else b | 32 if 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in (text or "").encode()]
    count = Counter()
    for k in range(1, langid.GRAMS + 1):
        for i in range(len(folded) - k + 1):
            gram = folded[i : i + k]
            if k == 1 and gram[0] == 32:
                continue
            value = 0
            for b in gram:
                value = (value * 257 + b) % (1 << 64)
            count[((value + k) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 52] += 1
    x = np.zeros(langid.DIM)
    for slot, n in count.items():
        x[slot] = math.sqrt(n)
    return x / max(1e-9, math.sqrt((x * x).sum()))


def test_language_against_plain_votes(spark, docs):
    """Family first, then one vote for each pair of its languages."""
    model = langid.train_split(docs, 200)
    texts = [r["text"] for r in docs.select("text").filter("length(text) < 3000").limit(60).collect()]
    lang, score = model.predict(langid.features(pa.array(texts)))
    names = [*(model.families if len(model.families) > 1 else []), *model.pairs]
    for text, got, p in zip(texts, lang, score, strict=True):
        odds = dict(zip(names, plain_features(text) @ model.w[:-1].astype(float) + model.w[-1], strict=True))
        chance = {x: 1 / (1 + math.exp(-o)) for x, o in odds.items()}
        family = {f: chance.get(f, 1.0) for f in model.families}
        total = sum(family.values())
        best = max(family, key=lambda f: family[f])
        own = [g for g in model.langs if langid.family_of(g) == best]
        votes = {g: sum(chance[a, b] if g == a else 1 - chance[a, b] for a, b in model.pairs if g in (a, b)) / max(1, len(own) - 1) for g in own}
        votes = votes if len(own) > 1 else {own[0]: 1.0}
        want = max(votes, key=lambda g: votes[g])
        assert p == pytest.approx(family[best] / total * votes[want], abs=1e-3)
        assert got == want or abs(votes[want] - votes[got]) < 1e-3


def test_many_short_texts_stay_small():
    """Slices are bounded by rows as well as by bytes."""
    from kelpwood.llm.common import slices

    batch = pa.record_batch({"text": ["eleven byte"] * 10000})
    sizes = [b.num_rows for b in slices(batch, "text", langid.SLICE, langid.SLICE_ROWS)]
    assert sum(sizes) == 10000 and max(sizes) == langid.SLICE_ROWS


def test_too_many_languages(spark):
    df = spark.createDataFrame([(i, "words", f"l{i}") for i in range(langid.MOST_LANGUAGES + 1)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.train(df)
