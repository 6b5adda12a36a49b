"""Token ids of whole texts through a ``tokenizers`` file whose pre-tokens never cross white space.

Each distinct white-space chunk is encoded once and looked up afterwards, by Arrow and numpy: natural text repeats
its words, so most of a text costs a lookup. The cache of a worker is bounded by a number of chunks and starts anew beyond it.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Words, text_array, tidy
from .merging import LONG, merge_long

CACHE_CHUNKS = 400_000
NONE = np.int32(2**31 - 1)
#: A letter, then ASCII marks up to white space: always a pre-token of their own.
_TAIL = r"(\pL)([!-/:-@\[-`{-~]+)([ \t-\r])"


class _Merger:
    """Pair merges of many words at once: words of equal length are rows of a matrix and advance together."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        byte = _byte_letters()
        self.inner = np.array([vocab[byte[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[byte[b] + suffix] for b in range(256)], np.int32)
        self.v = len(vocab)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] * self.v + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.table: dict | None = None
        self.bits = 1 << 20  # a filter before the search: most pairs aren't merged
        self.maybe = np.zeros(self.bits, bool)
        self.maybe[self._slot(self.key)] = True

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 7) & (self.bits - 1)

    def ranks(self, a, b):
        key = a.astype(np.int64) * self.v + b
        out = np.full(key.shape, NONE, np.int32)
        at = np.nonzero(self.maybe[self._slot(key)])
        k = key[at]
        i = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        out[at] = np.where(self.key[i] == k, self.rank[i], NONE)
        return out

    def _equal(self, raw: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        b = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), size)
        sym = self.inner[b]
        sym[:, -1] = self.final[b[:, -1]]
        count = np.full(len(raw), size)
        out = np.zeros((len(raw), size), np.int32)
        rows = np.arange(len(raw))
        rank = self.ranks(sym[:, :-1], sym[:, 1:])
        while True:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE)
            on = best < NONE
            if not on.all():
                out[rows[~on], : sym.shape[1]] = sym[~on]
                count[rows[~on]] = sym.shape[1]
                rows, sym, rank, at, best = rows[on], sym[on], rank[on], at[on], best[on]
            if not len(rows):
                return out, count
            r, width = np.arange(len(rows)), sym.shape[1]
            sym[r, at] = self.made[best]
            place = np.arange(width - 1)
            sym = np.take_along_axis(sym, place + (place > at[:, None]), axis=1)
            place = np.arange(width - 2)
            rank = np.take_along_axis(rank, place + (place >= at[:, None]), axis=1)
            for shift in (-1, 0):
                i = np.flatnonzero((at + shift >= 0) & (at + shift < width - 2))
                c = at[i] + shift
                rank[i, c] = self.ranks(sym[i, c], sym[i, c + 1])

    def _alone(self, word: bytes) -> np.ndarray:
        """Ids of one long word."""
        if self.table is None:
            self.table = dict(zip(self.key.tolist(), self.rank.tolist(), strict=True))
        sym = self.inner[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self.final[word[-1]])
        table, v = self.table, self.v

        def rank(i, j, k):
            return table.get(sym[i] * v + sym[j])

        def merged(i, j):
            sym[i] = int(self.made[table[sym[i] * v + sym[j]]])

        return np.array([sym[i] for i in merge_long(len(word), rank, merged)[:-1]], np.int32)

    def encode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another and how many each has."""
        length = np.array([len(x) for x in raw], np.int64)
        order = np.argsort(length, kind="stable")
        done, sizes = [], np.zeros(len(raw), np.int64)
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for group in np.split(order, cuts):
            if len(group) and length[group[0]] >= LONG:
                for i in group:
                    ids = self._alone(raw[i])
                    sizes[i] = len(ids)
                    done.append((np.array([i]), ids, sizes[[i]]))
                continue
            for at in (group[i : i + 8192] for i in range(0, len(group), 8192)):
                mat, n = self._equal([raw[i] for i in at], int(length[at[0]]))
                sizes[at] = n
                done.append((at, mat[np.arange(mat.shape[1]) < n[:, None]], n))
        start = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.uint32)
        for at, ids, n in done:
            flat[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, sizes


def _byte_letters() -> list[str]:
    """Byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merger = _Merger(model) if model.get("end_of_word_suffix") else None
        del model
        tidy()
        self._reset()

    def _reset(self):
        self.words = pa.array([], pa.string())
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    # ------------------------------------------------------------- chunks
    def _library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another and how many each has, by the library."""
        ids = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.array([len(x) for x in ids], np.int64)

    def _encode_new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that are one lower-case word in normal form are merged here, many at once; others by the library."""
        words = chunks.to_pylist()
        plain = np.zeros(len(words), bool)
        if self.merger is not None:
            lower = pc.equal(pc.utf8_lower(chunks), chunks)
            plain = pc.and_(pc.utf8_is_alpha(chunks), lower).to_numpy(zero_copy_only=False)
            if not unicodedata.is_normalized("NFC", " ".join(words)):
                plain = plain & np.array([unicodedata.is_normalized("NFC", w) for w in words], bool)
        own, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        sizes = np.zeros(len(words), np.int64)
        parts = []
        for at, (ids, n) in ((own, self.merger.encode([words[i].encode() for i in own]) if len(own) else self._library([])), (rest, self._library([words[i] for i in rest]))):
            sizes[at] = n
            parts.append((at, ids, n))
        start = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.uint32)
        for at, ids, n in parts:
            flat[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, sizes

    def _lookup(self, dictionary: pa.Array) -> np.ndarray:
        """Cache places of distinct chunks."""
        if len(self.words) > CACHE_CHUNKS:
            self._reset()
        at = pc.index_in(dictionary, value_set=self.words)
        if at.null_count:
            new = dictionary.filter(pc.is_null(at))
            ids, sizes = self._encode_new(new)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, ids])
            at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at[at < 0] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            return at
        return at.to_numpy(zero_copy_only=False).astype(np.int64)

    # ------------------------------------------------------------- texts
    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the bounds of each text. Exactly encode(text, add_special_tokens=False)."""
        texts = text_array(texts)
        marked = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        w = Words(pc.replace_substring_regex(texts, _TAIL, r"\1 \2\3"), lower=True)
        if len(w.dictionary):
            place = self._lookup(w.dictionary)[w.codes]
            size, first = self.sizes[place], self.starts[place]
        else:
            size = first = np.zeros(0, np.int64)
        done = np.concatenate([[0], np.cumsum(size)])
        bounds = done[w.offsets]
        ids = self.flat[np.repeat(first - done[:-1], size) + np.arange(done[-1])]
        if marked.any():  # strings of special tokens: the library's own way, as case counts there
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for i in np.flatnonzero(marked):
                parts[i] = np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, bounds


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
