"""SentencePiece encoding and decoding: batched Viterbi (or merges) in numpy.

A text's spaces become the meta symbol, with one before the text; no piece has that symbol inside it but after others of it, so units (a run of
meta symbols and what follows) are segmented alone and each distinct unit of a batch once. Units of equal length are rows of a matrix and advance together:
every substring's hash is probed in the sorted hashes of the pieces, the best score at each place is a maximum over the starts, and its start is the
backpointer. Ties go to the earlier start (the longer piece). Characters that no piece covers become their bytes' pieces.

This gives the library's ids for models of the unigram kind. A file that was trained by pair merges holds merge ranks as scores, of which the
highest sum is not the tokenizer's segmentation (``and`` would be ``a``, ``nd``). There the same sweep maximises validity in place of a sum: the segmentation of a
prefix is a prefix of the segmentation, and it is one whose neighbours are valid pairs, that is, merging the characters of both gives just these two pieces.
So at each place exactly one of the pieces that end there may follow the last piece of the prefix before it; its start is the backpointer. Pairs are judged by
merging once, and kept in a table of fixed size. Units with characters that no piece has, and very long ones, are merged outright.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, text_array
from .merging import LONG, merge_long

META = "▁"
PAIRS = 1 << 21  # slots of the table of judged pairs
TEXT_SLICE = 8 << 20  # text bytes that are encoded at once: the more, the more units of equal length advance together
CACHE_UNITS = 200_000  # encoded units that a worker keeps
UNKNOWN_PENALTY = 10.0
NORMAL, USER, BYTE = 1, 4, 6  # fixed values: piece types
_UNIT = regex.compile(f"{META}*[^{META}]+|{META}+")
_MUL = np.uint64(0xD6E8FEB86659FD93)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return out, i


def _fields(b: bytes, i: int, end: int):
    """Number, wire type, start and end of each field of a protocol-buffer message."""
    while i < end:
        tag, i = _varint(b, i)
        if tag & 7 == 2:
            n, i = _varint(b, i)
        elif tag & 7 == 0:
            n = _varint(b, i)[1] - i
        else:
            n = {1: 8, 5: 4}[tag & 7]
        yield tag >> 3, tag & 7, i, i + n
        i += n


def trained_by(proto: bytes) -> int:
    """The trainer's model type (fixed values of the file format: field 2, then 3; 1 unigram, 2 pair merges)."""
    for field, _, start, end in _fields(proto, 0, len(proto)):
        if field == 2:
            for inner, _, a, _ in _fields(proto, start, end):
                if inner == 3:
                    return _varint(proto, a)[0]
    return 1


class PieceModel:
    def __init__(self, path: str | None = None, proto: bytes | None = None, rule: str = "auto"):
        """``rule``: ``unigram`` (Viterbi), ``merges``, or ``auto``: as the file's trainer says."""
        from sentencepiece import SentencePieceProcessor

        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        self.merges = rule == "merges" or rule == "auto" and trained_by(proto) == 2
        sp = SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        score = np.array([sp.get_score(i) for i in range(n)], np.float32)
        self.byte = np.full(256, sp.unk_id(), np.int32)
        plain = np.zeros(n, bool)
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            else:
                plain[i] = not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        at = np.flatnonzero(plain)
        if any(META in self.pieces[i].lstrip(META) for i in at):
            raise ValueError("pieces with the meta symbol inside aren't supported")
        self.least = np.float32(score[at].min() - UNKNOWN_PENALTY)
        length = np.array([len(self.pieces[i]) for i in at])
        self.longest = int(length.max())
        key = np.zeros(len(at), np.uint64)
        for size in np.unique(length):
            rows = np.flatnonzero(length == size)
            key[rows] = self._hash(self._points([self.pieces[i] for i in at[rows]], size))[:, -1]
        order = np.argsort(key)
        self.key, self.id = key[order], at[order].astype(np.int32)
        self.score = score[self.id]
        self.best: dict | None = None
        self.pair, self.judged = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.whole = np.zeros(n, bool)
        self._forget()
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.key >> np.uint64(44)] = True
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else p.replace(META, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        if self.merges:  # pieces that merging makes of their own characters
            for size in np.unique(length):
                some = at[length == size]
                self.whole[some] = self._merge([self.pieces[i] for i in some], int(size))[1].sum(axis=1) == 1

    @staticmethod
    def _points(units: list[str], size: int) -> np.ndarray:
        return np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), size)

    @staticmethod
    def _hash(points: np.ndarray) -> np.ndarray:
        """Hash of each row's whole prefix, one for each length."""
        h, out = np.zeros(len(points), np.uint64), np.empty(points.shape, np.uint64)
        for i in range(points.shape[1]):
            h = h * _MUL + points[:, i] + np.uint64(1)
            out[:, i] = h
        return mix(out)

    def _probe(self, sums: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece and score of every substring of ``size`` characters; sums: plain prefix sums from 0 on."""
        with np.errstate(over="ignore"):
            key = mix(sums[:, size:] - sums[:, :-size] * np.uint64(pow(int(_MUL), size, 1 << 64)))
        piece, score = np.full(key.shape, -1, np.int32), np.full(key.shape, -np.inf, np.float32)
        at = np.nonzero(self.maybe[key >> np.uint64(44)])
        k = key[at]
        i = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        hit = self.key[i] == k
        at = tuple(a[hit] for a in at)
        piece[at], score[at] = self.id[i[hit]], self.score[i[hit]]
        return piece, score

    def _viterbi(self, units: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Segmentation of units of equal length: for each end a piece (or -1: bytes of one character) and whether the end is used."""
        points = self._points(units, size)
        n = len(units)
        sums = np.zeros((n, size + 1), np.uint64)
        for i in range(size):
            sums[:, i + 1] = sums[:, i] * _MUL + points[:, i] + np.uint64(1)
        reach = min(size, self.longest)
        found = [self._probe(sums, k) for k in range(1, reach + 1)]
        alone = found[0][1]
        one = np.where(found[0][0] >= 0, alone, self.least)
        best = np.zeros((n, size + 1), np.float32)
        back, piece = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), -1, np.int32)
        rows = np.arange(n)
        for e in range(1, size + 1):
            lo = max(0, e - reach)
            cand = np.stack([best[:, s] + (found[e - s - 1][1][:, s] if e - s > 1 else one[:, s]) for s in range(lo, e)], axis=1)
            pick = cand.argmax(axis=1)
            best[:, e], back[:, e] = cand[rows, pick], lo + pick
            for s in range(lo, e):
                at = np.flatnonzero(pick == s - lo)
                piece[at, e] = found[e - s - 1][0][at, s]
        used, pos = np.zeros((n, size + 1), bool), np.full(n, size)
        while (pos > 0).any():
            on = pos > 0
            used[rows[on], pos[on]] = True
            pos[on] = back[rows[on], pos[on]]
        return piece[:, 1:], used[:, 1:]

    def _valid(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of pieces stay apart when their characters are merged."""
        key = left.astype(np.int64) * len(self.pieces) + right
        slot = (mix(key.view(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
        new = np.flatnonzero(self.pair[slot] != key)
        out = self.judged[slot]
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            a, b = fresh // len(self.pieces), fresh % len(self.pieces)
            first = np.array([len(self.pieces[i]) for i in a])
            total = first + np.array([len(self.pieces[i]) for i in b])
            ok = np.zeros(len(fresh), bool)
            for size in np.unique(total):
                at = np.flatnonzero(total == size)
                used = self._merge([self.pieces[a[i]] + self.pieces[b[i]] for i in at], int(size))[1]
                ok[at] = (used.sum(axis=1) == 2) & used[np.arange(len(at)), first[at] - 1]
            at = (mix(fresh.view(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
            self.pair[at], self.judged[at] = fresh, ok  # of two in one slot the last stays, with its verdict
            out[new] = ok[back.reshape(-1)]
        return out

    def _viterbi_pairs(self, units: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """The segmentation by valid neighbours, in the form that _viterbi returns; all characters of the units are pieces."""
        points = self._points(units, size)
        n = len(units)
        sums = np.zeros((n, size + 1), np.uint64)
        for i in range(size):
            sums[:, i + 1] = sums[:, i] * _MUL + points[:, i] + np.uint64(1)
        reach = min(size, self.longest)
        found = [self._probe(sums, k)[0] for k in range(1, reach + 1)]
        last, back = np.full((n, size + 1), -1, np.int32), np.zeros((n, size + 1), np.int32)
        rows = np.arange(n)
        for e in range(1, size + 1):
            lo = max(0, e - reach)
            ends = np.stack([found[e - s - 1][:, s] for s in range(lo, e)], axis=1)
            who, at = np.nonzero(ends >= 0)
            piece, before = ends[who, at], last[who, lo + at]
            start = lo + at == 0
            ok = np.where(start, self.whole[piece], False)
            inner = np.flatnonzero(~start)
            ok[inner] = self._valid(before[inner], piece[inner])
            score = np.zeros(ends.shape, np.int8)
            score[who, at] = ok
            pick = score.argmax(axis=1)
            last[:, e], back[:, e] = ends[rows, pick], lo + pick
        used, pos = np.zeros((n, size + 1), bool), np.full(n, size)
        while (pos > 0).any():
            on = pos > 0
            used[rows[on], pos[on]] = True
            pos[on] = back[rows[on], pos[on]]
        return last[:, 1:], used[:, 1:]

    def _by_pairs(self, units: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """_viterbi_pairs, and merges for units with characters that no piece has."""
        points = self._points(units, size)
        known = (self._probe_alone(points) >= 0).all(axis=1)
        if known.all():
            return self._viterbi_pairs(units, size)
        piece, used = np.full((len(units), size), -1, np.int32), np.zeros((len(units), size), bool)
        for at, way in ((np.flatnonzero(known), self._viterbi_pairs), (np.flatnonzero(~known), self._merge)):
            if len(at):
                piece[at], used[at] = way([units[i] for i in at], size)
        return piece, used

    def _probe_alone(self, points: np.ndarray) -> np.ndarray:
        """The piece of each character, or -1."""
        flat = points.reshape(-1, 1)
        return self._probe(np.concatenate([np.zeros((len(flat), 1), np.uint64), flat + np.uint64(1)], axis=1), 1)[0].reshape(points.shape)

    def _merge(self, units: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Pair merges of units of equal length, in the form that _viterbi returns: the best-scored pair first, ties from the left."""
        points = self._points(units, size)
        n = len(units)
        sums = np.zeros((n, size + 1), np.uint64)
        for i in range(size):
            sums[:, i + 1] = sums[:, i] * _MUL + points[:, i] + np.uint64(1)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _MUL)]), dtype=np.uint64)
        piece, used = np.full((n, size), -1, np.int32), np.zeros((n, size), bool)

        def pairs(row, start, end):
            key = mix(sums[row, end] - sums[row, start] * power[end - start])
            score = np.full(key.shape, -np.inf, np.float32)
            at = np.nonzero(self.maybe[key >> np.uint64(44)])
            i = np.minimum(np.searchsorted(self.key, key[at]), len(self.key) - 1)
            score[at] = np.where(self.key[i] == key[at], self.score[i], -np.inf)
            return score

        rows = np.arange(n)
        cut = np.tile(np.arange(size + 1), (n, 1))
        score = pairs(rows[:, None], cut[:, :-2], cut[:, 2:]) if size > 1 else np.zeros((n, 0), np.float32)
        while len(rows):
            width = score.shape[1]
            at = score.argmax(axis=1) if width else np.zeros(len(rows), np.int64)
            on = score[np.arange(len(rows)), at] > -np.inf if width else np.zeros(len(rows), bool)
            off = np.flatnonzero(~on)
            if len(off):
                r = np.repeat(rows[off], width + 1)
                start, end = cut[off, :-1].reshape(-1), cut[off, 1:].reshape(-1)
                key = mix(sums[r, end] - sums[r, start] * power[end - start])
                i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                used[r, end - 1] = True
                piece[r, end - 1] = np.where(self.key[i] == key, self.id[i], -1)
                rows, cut, score, at = rows[on], cut[on], score[on], at[on]
            if not len(rows):
                break
            place = np.arange(width + 1)
            cut = np.take_along_axis(cut, place + (place > at[:, None]), axis=1)
            place = np.arange(width - 1)
            score = np.take_along_axis(score, place + (place >= at[:, None]), axis=1)
            for shift in (-1, 0):
                i = np.flatnonzero((at + shift >= 0) & (at + shift < width - 1))
                c = at[i] + shift
                score[i, c] = pairs(rows[i], cut[i, c], cut[i, c + 2])
        return piece, used

    def _alone(self, unit: str) -> tuple[np.ndarray, np.ndarray]:
        """Merges of one long unit, in the form that _viterbi returns."""
        if self.best is None:
            self.best = {self.pieces[i]: (-float(s), int(i)) for i, s in zip(self.id.tolist(), self.score.tolist(), strict=True)}
        best, longest = self.best, self.longest
        cut = merge_long(len(unit), lambda i, j, k: best.get(unit[i:k], (None,))[0] if k - i <= longest else None)
        used, piece = np.zeros((1, len(unit)), bool), np.full((1, len(unit)), -1, np.int32)
        for i, k in zip(cut[:-1], cut[1:], strict=True):
            used[0, k - 1] = True
            piece[0, k - 1] = best.get(unit[i:k], (None, -1))[1]
        return piece, used

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after another and how many each has."""
        length = np.array([len(u) for u in units], np.int64)
        order = np.argsort(length, kind="stable")
        sizes, done = np.zeros(len(units), np.int64), []
        for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            size = int(length[group[0]])
            step = max(1, min(8192, (1 << 21) // max(size, 1)))
            for at in (group[i : i + step] for i in range(0, len(group), step)):
                own = [units[i] for i in at]
                if self.merges and size >= LONG:
                    piece, used = (np.concatenate(x) for x in zip(*[self._alone(u) for u in own], strict=True))
                else:
                    piece, used = (self._by_pairs if self.merges else self._viterbi)(own, size)
                odd = np.flatnonzero((used & (piece < 0)).any(axis=1))
                sizes[at] = used.sum(axis=1)
                flat = piece[used]
                if len(odd):
                    old, new = sizes[at], sizes[at].copy()
                    cut, parts = np.cumsum(old) - old, {}
                    for r in odd:  # characters without a piece become their bytes'
                        ids, ends = flat[cut[r] : cut[r] + old[r]], np.flatnonzero(used[r])
                        whole = [self.byte[list(own[r][e].encode("utf-8", "surrogatepass"))] if i < 0 else [i] for i, e in zip(ids, ends, strict=True)]
                        parts[r] = np.concatenate(whole).astype(np.int32)
                        new[r] = len(parts[r])
                    start, plain = np.cumsum(new) - new, np.ones(len(at), bool)
                    plain[odd] = False
                    keep = np.repeat(plain, old)
                    to = np.repeat(start - cut, old) + np.arange(len(flat))
                    out = np.empty(int(new.sum()), np.int32)
                    out[to[keep]] = flat[keep]
                    for r, ids in parts.items():
                        out[start[r] : start[r] + new[r]] = ids
                    flat, sizes[at] = out, new
                done.append((at, flat))
        start = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        for at, flat in done:
            n = sizes[at]
            out[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
        return out, sizes

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another and the bounds of each text (null: none)."""
        texts = text_array(texts)
        odd = pc.match_substring_regex(texts, f"(^ )|( $)|  |{META}").to_numpy(zero_copy_only=False)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        usual = ~odd & ~empty
        parts = pc.split_pattern(texts.filter(pa.array(usual)), " ")
        words = parts.flatten()
        marked = pc.binary_join_element_wise(pa.scalar(META), words, "") if len(words) else pa.array([], pa.string())
        counts = np.zeros(len(texts), np.int64)
        counts[usual] = np.diff(parts.offsets.to_numpy())
        extra = {i: _UNIT.findall(META + texts[i].as_py().replace(" ", META)) for i in np.flatnonzero(odd & ~empty)}
        for i, u in extra.items():
            counts[i] = len(u)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        all_units = pa.concat_arrays([marked, pa.array([u for us in extra.values() for u in us], pa.string())]).dictionary_encode()
        codes = all_units.indices.to_numpy(zero_copy_only=False)
        place = np.empty(len(codes), np.int64)
        place[np.repeat(usual, counts)] = codes[: len(marked)]
        place[~np.repeat(usual, counts)] = codes[len(marked) :]
        if not len(place):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        place = self._lookup(all_units.dictionary)[place]
        size = self.sizes[place]
        done = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(self.starts[place] - done[:-1], size) + np.arange(done[-1])], done[bounds]

    def _forget(self) -> None:
        self.units = pa.array([], pa.string())
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _lookup(self, units: pa.Array) -> np.ndarray:
        """Places of distinct units among those that were encoded; new ones are encoded and kept, up to a bound."""
        if len(self.units) > CACHE_UNITS or len(self.flat) > 16 * CACHE_UNITS:
            self._forget()
        at = pc.index_in(units, value_set=self.units)
        if not at.null_count:
            return at.to_numpy(zero_copy_only=False).astype(np.int64)
        new = units.filter(pc.is_null(at))
        ids, sizes = self.encode_units(new.to_pylist())
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.units) + np.arange(len(new))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])
        self.units = pa.concat_arrays([self.units, new])
        return at

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of ids; the space that encoding puts first is left out."""
        size = self.raw_at[ids + 1] - self.raw_at[ids] if len(ids) else np.zeros(0, np.int64)
        done = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.repeat(self.raw_at[ids] - done[:-1], size) + np.arange(done[-1])].tobytes() if len(ids) else b""
        cut = done[bounds]
        return [data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id long, n_tokens long, ids array<int>, round_trip boolean (decoding gives the text back), one row per input row.

    Null and empty text: no ids, round_trip true. Only doc_id and text are read; repeated rows and null ids pass through; an empty table gives an empty
    result. A text with the meta symbol itself decodes to a space there, so its round_trip is false. Very long texts are read whole. Ties between segmentations go to
    the earlier start.
    """

    def run(batches):
        model = piece_model(model_path)
        for batch in batches:
            for part in slices(batch, "text", TEXT_SLICE):
                ids, bounds = model.encode(part.column("text"))
                same = [a == (b or "") for a, b in zip(model.decode(ids, bounds), part.column("text").to_pylist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), lists, pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` (ids array<int>, ...) with ``text`` string; null ids: null."""
    encoded = encoded.drop("text")

    def run(batches):
        model = piece_model(model_path)
        for batch in batches:
            col = batch.column("ids")
            off = col.offsets.to_numpy().astype(np.int64)
            ids = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.int64)
            texts = model.decode(ids, off - off[0])
            null = col.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string(), mask=null)], [*batch.schema.names, "text"])

    return encoded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields) + ", text string")
