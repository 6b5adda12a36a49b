"""Hierarchical language identification: the family first, then one-versus-one linear SVMs within it.

Features are hashed letter n-grams (1 to ``GRAMS`` bytes) of the whole text, so no text is cut. The models are fitted on
a bounded sample of labelled rows (``per_language`` rows of each language); they are small arrays that travel with the tasks.
Prediction is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_array, tidy
from .linear import fit_svm, platt, sigmoid

DIM, GRAMS = 4096, 3
SLICE, SLICE_ROWS = 1 << 20, 1024  # text bytes and rows whose n-grams are held at once
MOST_LANGUAGES = 500
#: Families of common ISO 639-1 codes; a language that isn't named is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "bn", "ur", "pa", "mr", "gu", "ne"),
    "sinitic": ("zh", "yue"),
}
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def _fold() -> np.ndarray:
    """Letters in lower case; all other ASCII is a space."""
    t = np.full(256, 32, np.uint8)
    t[128:] = np.arange(128, 256)
    t[97:123] = t[65:91] = np.arange(97, 123)
    return t


_FOLD = _fold()


def features(texts: pa.Array) -> np.ndarray:
    """Square roots of hashed n-gram counts, of unit length, one row per text."""
    texts = text_array(texts)
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = _FOLD[np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    out, gram = np.zeros(n * DIM, np.float32), np.zeros(len(data), np.uint64)
    for k in range(1, GRAMS + 1):
        if len(data) < k:
            break
        gram = gram[: len(data) - k + 1] * np.uint64(257) + data[k - 1 :]
        slot = ((gram + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)
        same = (doc[: len(gram)] == doc[k - 1 :]) & (data[: len(gram)] != 32 if k == 1 else True)
        out += np.bincount((doc[: len(gram)] * DIM + slot.astype(np.int64))[same], minlength=n * DIM).astype(np.float32)
    out = np.sqrt(out.reshape(n, DIM))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9).astype(np.float32)


class LanguageModel:
    """Family SVMs (one against the rest) and language SVMs (one against one within a family), with their log-odds."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        y = np.array(langs)
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(lang) for lang in self.langs})
        fam = np.array([family_of(lang) for lang in langs])
        self.pairs = [(a, b) for f in self.families for a, b in combinations([g for g in self.langs if family_of(g) == f], 2)]
        cols = []
        for f in self.families if len(self.families) > 1 else []:
            cols.append(self._fit(x, np.where(fam == f, 1.0, -1.0)))
        for a, b in self.pairs:
            cols.append(self._fit(x, np.where(y == a, 1.0, np.where(y == b, -1.0, 0.0))))
        self.w = np.array(cols, np.float32).reshape(len(cols), DIM + 1).T

    @staticmethod
    def _fit(x, y):
        w, at = fit_svm(x, y), y != 0
        slope, offset = platt((x @ w[:-1].astype(x.dtype) + w[-1])[at], y[at])
        return np.concatenate([w[:-1] * slope, [w[-1] * slope + offset]])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and probability of each row."""
        odds = x @ self.w[:-1] + self.w[-1]
        nf = len(self.families) if len(self.families) > 1 else 0
        p = sigmoid(odds[:, :nf]) if nf else np.ones((len(x), 1))
        p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-12)
        best = np.full(len(x), -1.0)
        lang = np.full(len(x), self.langs[0], object)
        top = p.argmax(axis=1)
        for i, f in enumerate(self.families):
            at = np.flatnonzero(top == i)
            own = [g for g in self.langs if family_of(g) == f]
            score = np.zeros((len(at), len(own)))
            for j, (a, b) in enumerate(self.pairs):
                if a in own:
                    q = sigmoid(odds[at, nf + j])
                    score[:, own.index(a)] += q
                    score[:, own.index(b)] += 1 - q
            score = score / max(1, len(own) - 1) if len(own) > 1 else score + 1.0
            pick = score.argmax(axis=1) if len(at) else np.zeros(0, int)
            best[at] = p[at, i] * score[np.arange(len(at)), pick]
            lang[at] = np.array(own, object)[pick]
        return lang, np.clip(best, 0.0, 1.0)


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` rows of each language, the least by a hash of doc_id."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: lang doesn't look like a language code")
    if not counts:
        return labelled.limit(0)
    share = F.lit(0.0)
    for lang, c in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.2 * per_language / c))).otherwise(share)
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    some = labelled.withColumn("h", h).filter(F.col("h") < share * float(1 << 30)).limit(4 * per_language * len(counts))
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    return some.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_language)


def _feature_rows(batches):
    for batch in batches:
        for part in slices(batch, "text", SLICE, SLICE_ROWS):
            x = features(part.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "lang", "x"])


def train(labelled: DataFrame, per_language: int = 1000) -> LanguageModel | None:
    """``labelled``: doc_id long, text, lang. The bound ``per_language`` is on rows, not on their lengths; None without rows."""
    rows = _sample(labelled.filter("text is not null and lang is not null and doc_id is not null"), per_language).select("doc_id", "text", "lang").mapInArrow(_feature_rows, "doc_id long, lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["doc_id"]))
    langs, x = [r["lang"] for r in rows], np.empty((len(rows), DIM), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r["x"], np.float16)
    del rows
    model = LanguageModel(x, langs)
    del x
    tidy()
    return model


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """All columns of ``docs`` and lang_pred string, score double (0 to 1), from ``text`` alone.

    Null text and text without a letter: ``und`` with score 0; so are all rows where nothing could be learned. Columns named like
    an output are replaced; repeated rows and null ids pass through; an empty table gives an empty result. Very long texts are read whole. Ties
    between languages go to the first in order of their codes.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE, SLICE_ROWS):
                text = text_array(part.column("text"))
                letters = pc.match_substring_regex(text, r"\pL").to_numpy(zero_copy_only=False)
                lang, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
                if model is not None and letters.any():
                    got, p = model.predict(features(text.filter(pa.array(letters))))
                    lang[letters], score[letters] = got, p
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def split(docs: DataFrame) -> DataFrame:
    """held_out: crc32 of doc_id as text, modulo 5, is 0 (null id: false, and never learned from)."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False)))


def train_split(docs: DataFrame, per_language: int = 1000) -> LanguageModel | None:
    """A model from the rows that aren't held out."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return train(split(base).filter("not held_out"), per_language)
