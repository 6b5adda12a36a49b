"""Quality by hierarchical empirical Bayes: a document's own evidence under the prior of its path and host.

1. Evidence: logistic regressions on telling words and shape counts of the whole text give each document's chance to be good
   (labelled quality 1 and not toxic). They are fitted on a bounded sample of labelled documents.
2. Sites: sums of these chances by host and by host and path (grouped aggregation with partial sums). Beta priors
   are fitted by moments; a host shrinks toward the global mean, a path toward its host, the more the fewer documents it has.
3. Posterior: the document's log-odds, moved by how far its path's posterior mean (without the document itself) is from the global mean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, internal, materialize, slices, text_array, tidy, word_hashes
from .linear import fit_logistic, sigmoid

WORDS, SHAPES, LEAST_DOCS = 1024, 10, 4  # words of each head, shape counts, sample documents that a word must be in
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BROADCAST_ROWS = 100_000  # site rows (some 60 bytes each) that are sent to all executors; more are joined by a shuffle


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape counts of each text; the number of the text and the hash of each of its distinct words (lower case, without marks around it)."""
    texts = text_array(texts)
    n = len(texts)
    w = Words(texts, lower=True)
    shape = np.zeros((n, SHAPES), np.float32)
    if not len(w.codes):
        return shape, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = w.docs()
    many = np.maximum(w.lengths, 1)
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]]
    size = np.maximum(np.diff(off), 1)
    by_text = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off - off[0]])
    by_word = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.offsets])
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    pair = doc << 32 | w.codes
    again = np.concatenate([[False], pair[1:] == pair[:-1]])
    distinct = np.unique(pair)
    doc_of = distinct >> 32
    marked = pc.match_substring_regex(w.dictionary, r"[#$%&*]{2,}$|!!$").to_numpy(zero_copy_only=False)[w.codes]
    bars = pc.equal(w.dictionary, "|").to_numpy(zero_copy_only=False)[w.codes]
    counts = (by_text(upper) / size, by_text(digit) / size, by_text(~letter & ~digit & (data > 32)) / size, by_word(again) / many, np.bincount(doc_of, minlength=n) / many, by_word(marked) / many, by_word(bars) / many, np.log1p(w.lengths) / 10, size / many / 20, by_text(letter) / size)
    for i, v in enumerate(counts):
        shape[:, i] = np.minimum(v, 3)
    return shape, doc_of, word_hashes(pc.utf8_trim(w.dictionary, characters=MARKS))[distinct & 0xFFFFFFFF]


class _Head:
    """One logistic regression over shape counts and the presence of telling words (sorted hashes)."""

    def __init__(self, words: np.ndarray, shape: np.ndarray, present: np.ndarray, positive: np.ndarray):
        """``present``: for each sample document and each of ``words`` whether it is there."""
        self.words = words
        sign = np.where(positive, 1.0, -1.0)
        if abs(sign.sum()) == len(sign):
            self.w = np.append(np.zeros(SHAPES + len(words)), 6.0 * sign[0])
        else:
            x = np.empty((len(shape), SHAPES + len(words)), np.float32)
            x[:, :SHAPES], x[:, SHAPES:] = 4 * shape, present
            self.w = fit_logistic(x, sign, l2=1e-4)

    def chance(self, shape, docs, words) -> np.ndarray:
        x = np.zeros((len(shape), SHAPES + len(self.words)), np.float32)
        x[:, :SHAPES] = 4 * shape
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = self.words[at] == words
            x[docs[hit], SHAPES + at[hit]] = 1
        return sigmoid((x @ self.w[:-1].astype(np.float32)).astype(np.float64) + self.w[-1])


class QualityModel:
    def __init__(self, heads: list[_Head]):
        self.heads = heads

    def chance(self, texts: pa.Array) -> np.ndarray:
        """Each text's chance to be good: of quality and not toxic."""
        x = features(texts)
        return self.heads[0].chance(*x) * self.heads[1].chance(*x)


def _feature_rows(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            shape, doc, word = features(part.column("text"))
            cut = np.searchsorted(doc, np.arange(len(shape) + 1)).astype(np.int32)
            shapes = pa.array([r.tobytes() for r in shape], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(word.view(np.int64)))
            own = [part.column(c) for c in ("doc_id", "quality", "toxic")]
            yield pa.RecordBatch.from_arrays([*own, shapes, lists], ["doc_id", "quality", "toxic", "shape", "words"])


def _present_rows(vocabulary: np.ndarray):
    """Which words of a sorted vocabulary each row has, as packed bits."""

    def run(batches):
        for batch in batches:
            lists = batch.column("words")
            off = lists.offsets.to_numpy().astype(np.int64)
            words = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(np.uint64)
            bits = np.zeros((batch.num_rows, len(vocabulary)), bool)
            if len(vocabulary) and len(words):
                at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                hit = vocabulary[at] == words
                bits[np.repeat(np.arange(batch.num_rows), np.diff(off))[hit], at[hit]] = True
            packed = pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())
            own = [batch.column(c) for c in ("doc_id", "quality", "toxic", "shape")]
            yield pa.RecordBatch.from_arrays([*own, packed], ["doc_id", "quality", "toxic", "shape", "bits"])

    return run


def _telling(sample: DataFrame, positive: Column, docs: int, good: int) -> np.ndarray:
    """The ``WORDS`` words whose presence tells the classes apart best (log-odds times the root of their count), by grouped counts."""
    each = sample.select(F.explode("words").alias("w"), positive.cast("int").alias("pos"))
    c = each.groupBy("w").agg(F.count("*").alias("df"), F.sum("pos").alias("pos")).filter(F.col("df") >= LEAST_DOCS)
    share = lambda n, of: F.log((n + 0.5) / F.lit(max(1, of) + 1.0))
    score = F.abs(share(F.col("pos"), good) - share(F.col("df") - F.col("pos"), docs - good)) * F.sqrt("df")
    top = c.select("w", score.alias("score")).orderBy(F.desc("score"), "w").limit(WORDS).collect()
    return np.sort(np.array([r["w"] for r in top], np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, most: int = 6000) -> QualityModel | None:
    """From at most ``most`` labelled documents, the least by a hash of doc_id; None if there are none.

    Words are counted by grouped aggregation; only ``WORDS`` of them for each head, and a bit for each in each sample document, come to the driver.
    """
    long = lambda c, kind: F.col(c).cast(kind).alias(c)
    label = labels.select(long("doc_id", "long"), long("quality", "int"), long("toxic", "int")).dropna().dropDuplicates(["doc_id"])
    some = label.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    count = label.count()
    if count > most:
        some = some.filter(F.col("h") < int((1 << 30) * 1.2 * most / count))
    some = some.orderBy("h", "doc_id").limit(most).drop("h")
    base = docs.select(long("doc_id", "long"), long("text", "string")).filter("text is not null")
    read = base.join(F.broadcast(some), "doc_id").mapInArrow(_feature_rows, "doc_id long, quality int, toxic int, shape binary, words array<long>")
    one = F.min(F.struct("words", "shape", "quality", "toxic")).alias("x")  # of the rows of one id the least counts
    sample = materialize(read.groupBy("doc_id").agg(one).select("doc_id", "x.*"), "quality")
    good = [F.col("quality") == 1, F.col("toxic") == 0]
    n, *pos = sample.agg(F.count("*"), *[F.count_if(g) for g in good]).first()
    if not n:
        return None
    vocab = [_telling(sample, g, n, k) for g, k in zip(good, pos, strict=True)]
    both = np.unique(np.concatenate(vocab))
    schema = "doc_id long, quality int, toxic int, shape binary, bits binary"
    rows = sorted(sample.mapInArrow(_present_rows(both), schema).collect(), key=lambda r: r["doc_id"])
    shape = np.array([np.frombuffer(r["shape"], np.float32) for r in rows])
    bits = np.unpackbits(np.array([np.frombuffer(r["bits"], np.uint8) for r in rows]), axis=1)
    labelled = [np.array([r["quality"] == 1 for r in rows]), np.array([r["toxic"] == 0 for r in rows])]
    model = QualityModel([_Head(v, shape, bits[:, np.searchsorted(both, v)], y) for v, y in zip(vocab, labelled, strict=True)])
    del rows, bits, shape
    tidy()
    return model


def _strength(groups: DataFrame, mean: float, n: str, s: str) -> float:
    """Size of the Beta prior, by moments: what of the spread between groups' means sampling doesn't explain."""
    g = groups.filter(F.col(n) >= 2).agg(F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - F.lit(mean), F.lit(2))), F.sum(n), F.count("*")).first()
    if not g[2]:
        return 20.0
    var, noise = g[0] / g[1], mean * (1 - mean)
    between = max(var - noise * g[2] / g[1], noise / 1000)
    return float(min(max(noise / between - 1, 2.0), 1000.0))


def evidence(docs: DataFrame, model: QualityModel | None, host: str, path: str, carry: list[str]) -> tuple[DataFrame, list[str]]:
    """The columns ``carry`` and three more, whose names are returned: host, path and the chance to be good by its text alone."""
    taken = docs.select(*[F.col(f"`{c}`") for c in carry])
    own = [internal(taken, x) for x in ("host", "path", "p")]
    text = internal(taken, "text")
    site = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    base = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").cast("string").alias(text), site(host, own[0]), site(path, own[1]))
    kept = [f for f in base.schema.fields if f.name != text]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                texts = text_array(part.column(text))
                p = model.chance(texts) if model is not None else np.full(len(texts), 0.5)
                p[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] = 0.0
                cols = [*[part.column(c) for c in names], pa.array(np.clip(p, 1e-6, 1 - 1e-6))]
                yield pa.RecordBatch.from_arrays(cols, [*names, own[2]])

    return base.mapInArrow(run, T.StructType([*kept, T.StructField(own[2], T.DoubleType())])), own


def score_quality(docs: DataFrame, model: QualityModel | None, host: str, path: str, carry: list[str], keep_above: float = 0.5) -> DataFrame:
    """``docs`` (text, host and path columns) -> the columns ``carry`` and evidence, host_posterior, path_posterior, quality (all double), keep boolean.

    Defined cases: null or empty text: evidence near 0, not kept. Null host or path: the site with an empty name. Without a model all evidence is 0.5.
    Repeated rows count and are returned each; ties at ``keep_above`` are kept. Very long texts are read whole, in slices. Empty table: empty
    result. Columns of ``carry`` named like an output are replaced; all others may have any name.
    The doc-level rows are written to the shared folder once, so that texts are read and scored once.
    """
    out = ("evidence", "host_posterior", "path_posterior", "quality", "keep")
    carry = [c for c in carry if c.lower() not in out]
    found, (at, under, chance) = evidence(docs, model, host, path, carry)
    rows = materialize(found, "quality")
    n_path, s_path, n_host, s_host = (internal(rows, x) for x in ("np", "sp", "nh", "sh"))
    paths = materialize(rows.groupBy(at, under).agg(F.count("*").alias(n_path), F.sum(chance).alias(s_path)), "quality")
    hosts = paths.groupBy(at).agg(F.sum(n_path).alias(n_host), F.sum(s_path).alias(s_host))
    total = paths.agg(F.sum(n_path), F.sum(s_path), F.count("*")).first()
    mean = min(max((total[1] or 0.0) / max(total[0] or 0, 1), 1e-3), 1 - 1e-3)
    k_host, k_path = _strength(hosts, mean, n_host, s_host), _strength(paths, mean, n_path, s_path)
    sites = paths.join(hosts, at)
    sites = F.broadcast(sites) if (total[2] or 0) <= BROADCAST_ROWS else sites
    p = F.col(chance)
    logit = lambda c: F.log(c / (1 - c))
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-3)), F.lit(1 - 1e-3))
    host_mean = inside((F.col(s_host) - p + F.lit(k_host * mean)) / (F.col(n_host) - 1 + F.lit(k_host)))
    path_mean = inside((F.col(s_path) - p + F.lit(k_path) * F.col("host_posterior")) / (F.col(n_path) - 1 + F.lit(k_path)))
    moved = logit(p) + logit(F.col("path_posterior")) - F.lit(float(np.log(mean / (1 - mean))))
    j = rows.join(sites, [at, under]).withColumn("host_posterior", host_mean).withColumn("path_posterior", path_mean)
    j = j.withColumn("quality", 1 / (1 + F.exp(-moved)))
    own = [F.col(f"`{c}`") for c in carry]
    return j.select(*own, p.alias("evidence"), "host_posterior", "path_posterior", "quality", (F.col("quality") >= keep_above).alias("keep"))
