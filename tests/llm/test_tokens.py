"""Token ids, packing and pieces against the libraries and exact round trips."""

import random
import time
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from kelpwood.llm.packing import pack, pack_documents
from kelpwood.llm.pieces import PieceModel, decode_pieces, encode_pieces
from kelpwood.llm.wordtokens import WordTokenizer

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "  ", "a\x1cb", "Don't we'll 's", "<|endoftext|> x <|ENDOFTEXT|>", "İstanbul ΣΑΣ éÉ", "word.,! x.", "12ab3 $$$", "x. \n", "K.\x0b\x0c ok", "日本語 テスト。", "ß ẞ fi", "e\u0301 E\u0301", " a  b ", "▁a", "\n\n x", "x" * 3000, "😀 z\x00", "a\u00a0b\u2003c", "thth*** thth"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(120).collect()
    return [r["text"] for r in rows] + ODD


def cut(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_word_tokens(texts):
    w = WordTokenizer(WORD)
    want = [w.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert cut(*w.encode(pa.array(texts))) == want
    assert cut(*w.encode(pa.array(texts))) == want  # from the cache


def test_pieces_equal_the_library(texts):
    m, sp = PieceModel(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    ids, bounds = m.encode(pa.array(texts))
    assert cut(ids, bounds) == sp.encode(texts)
    assert m.decode(ids, bounds) == [t.replace("▁", " ") for t in texts]


def best_sum(m, unit):
    score = dict(zip(m.id.tolist(), m.score.tolist(), strict=True))
    known = {m.pieces[i]: s for i, s in score.items()}
    best = [0.0] + [None] * len(unit)
    for e in range(1, len(unit) + 1):
        best[e] = max(best[s] + known.get(unit[s:e], float(m.least) if e - s == 1 else -np.inf) for s in range(e))
    return best[-1]


def test_viterbi_is_the_best_sum(texts):
    m = PieceModel(PIECE, rule="unigram")
    score = dict(zip(m.id.tolist(), m.score.tolist(), strict=True))
    units = sorted({"▁" + w for t in texts for w in t.split(" ") if w and len(w) < 30 and "▁" not in w})[:400]
    ids, sizes = m.encode_units(units)
    at = np.cumsum(sizes) - sizes
    for u, a, n in zip(units, at, sizes, strict=True):
        got = ids[a : a + n].tolist()
        if all(i in score for i in got):
            assert "".join(m.pieces[i] for i in got) == u
            assert sum(score[i] for i in got) == pytest.approx(best_sum(m, u))


def test_long_words():
    """Words beyond the matrices' length, as the libraries split them, and one of a hundred thousand letters in a few seconds."""
    rnd = random.Random(3)
    long = ["".join(rnd.choice(letters) for _ in range(n)) for letters, n in (("ab", 700), ("etaoinshrdlu", 5000), ("thé日", 2000), ("x", 1024))]
    w, m, sp = WordTokenizer(WORD), PieceModel(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert cut(*w.encode(pa.array(long))) == [w.tok.encode(t, add_special_tokens=False).ids for t in long]
    assert cut(*m.encode(pa.array(long))) == sp.encode(long)
    huge = pa.array(["".join(rnd.choice("etaoinshrdlu") for _ in range(100_000))])
    start = time.time()
    assert len(w.encode(huge)[0]) > 20_000 and len(m.encode(huge)[0]) > 20_000
    assert time.time() - start < 30


def test_piece_rows(spark):
    df = spark.createDataFrame([(1, "hello world", 1), (2, None, 2), (None, "", 3), (1, "hello world", 4)], "doc_id long, text string, ids int")
    got = encode_pieces(df, PIECE)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["round_trip"]) for r in got.collect()) == [(0, 0, True), (1, 3, True), (1, 3, True), (2, 0, True)]
    assert sorted(r["text"] for r in decode_pieces(got, PIECE).collect()) == ["", "", "hello world", "hello world"]
    assert encode_pieces(df.limit(0), PIECE).count() == 0


@pytest.mark.parametrize("seed,last", list(product(range(20), (True, False))))
def test_pack(seed, last):
    rnd = random.Random(seed)
    sizes = [rnd.choice([1, 2, rnd.randint(1, 300), rnd.randint(1, 5000), rnd.randint(1, 20000)]) for _ in range(rnd.randint(1, 80))]
    done, left = pack(sizes, last=last)
    seen = [np.zeros(n, int) for n in sizes]
    for piece in [p for s in done for p in s] + left:
        seen[piece[0]][piece[1] : piece[1] + piece[2]] += 1
    assert all((s == 1).all() for s in seen)
    total = [sum(p[2] for p in s) for s in done]
    assert all(n & (n - 1) == 0 and n <= 4096 for n in total)
    assert not left if last else sum(p[2] for p in left) < 4096


def test_pack_documents(spark):
    docs = [(1, "the " * 9000, "x"), (2, None, "y"), (None, "", "z"), (3, "a b c", "w"), (3, "a b c", "w"), (4, "Word. " * 700, "v")]
    out = pack_documents(spark.createDataFrame(docs, "doc_id long, text string, ids string"), WORD).withColumn("crc", F.crc32("ids")).collect()
    tok = WordTokenizer(WORD).tok
    want = sorted((d[0] or 0, tok.encode(d[1] or "", add_special_tokens=False).ids + [2]) for d in docs)
    whole = {}
    for r in sorted(out, key=lambda r: r["start"]):
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["crc"]
        whole.setdefault(r["doc_id"] or 0, []).append(r)
    for key in (1, 4):
        assert np.concatenate([np.frombuffer(r["ids"], np.uint32) for r in whole[key]]).tolist() == dict(want)[key]
    assert sum(r["length"] for r in out) == sum(len(w) for _, w in want)
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))]
        total = sum(x for _, x in s)
        assert total & (total - 1) == 0
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0
