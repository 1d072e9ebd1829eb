"""Operator 5: SentencePiece encoding and decoding by batched Viterbi in numpy.

Texts are cut into units that no piece can cross; each unit is encoded once in a worker process, and units of equal length advance
together, one numpy step for all. Substring hashes, differences of running ones, probe the sorted keys of pieces; maxima
over the pieces that end at a place store backpointers, and all rows step back together.

* Unigram models: a path's value is the sum of its pieces' scores.
* BPE models: the best sum gives other ids than the model's own. A path is the model's own exactly if each
  piece may follow the one before it: merging the two pieces' text by itself leaves these two. Of the pieces that end at a place just
  one may follow the best path to its start, so there the maximum is over 0 for that one and minus infinity for the others.

Characters outside the vocabulary become byte pieces, so decoding gives the text back exactly; only a text that itself
holds the space mark comes back with spaces there.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .units import Units

MARK = "\u2581"
CELLS = 1 << 20
_BASE = np.uint64(0x9E6C63D0876A9A35)
_TOP = np.int64(1) << 62


class Pieces:
    """A vocabulary as sorted arrays. pieces: strings; kinds: 'n'ormal, 'b'yte or 'x' for control and unknown pieces.

    Symbols are numbered anew: 0 is any character outside, then come single characters, then longer pieces from the best score down.
    """

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], bpe: bool):
        self.bpe = bpe
        self.name = hashlib.sha256(repr((pieces, scores, kinds, bpe)).encode()).hexdigest()
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "n"}
        self.byte_id = np.full(256, -1, np.int32)
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == "b":
                self.byte_id[int(p[3:5], 16)] = i
        self.unknown = next((i for i, k in enumerate(kinds) if k == "x"), 0)
        raw = [bytes([int(p[3:5], 16)]) if k == "b" else p.replace(MARK, " ").encode() if k == "n" else b"" for p, k in zip(pieces, kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.r_[0, np.cumsum([len(x) for x in raw])]
        longer = sorted((p for p in normal if len(p) > 1), key=lambda p: (-scores[normal[p]], normal[p]))
        # a text may be cut at a character that stands in no longer piece, and before spaces if they only begin pieces
        self.cuts = [b for b in b"\t\n\r" if not any(chr(b) in p for p in longer)]
        self.at_spaces = not any(MARK in p.lstrip(MARK) for p in longer)
        chars = sorted({c for p in normal for c in p})
        self.code = np.array([ord(c) for c in chars], np.int64)
        symbols = ["", *chars, *longer]
        self.id = np.array([normal.get(p, -1) for p in symbols], np.int32)
        worst = min(scores, default=0.0) - 10
        self.score = np.array([scores[i] if i >= 0 else worst for i in self.id.tolist()])
        self.length = np.array([max(len(p), 1) for p in symbols], np.int64)
        if bpe:
            self._splits(symbols)
            unmade = [p for i, p in enumerate(symbols) if len(p) > 1 and self.left[i] == i]
            if unmade:
                raise ValueError(f"not a BPE vocabulary: no earlier pieces merge to {unmade[:5]}")
        of = {p: i for i, p in enumerate(symbols)}
        self.longest = max(map(len, longer), default=1)
        lengths: dict[int, list[str]] = {}
        for p in longer:
            lengths.setdefault(len(p), []).append(p)
        key = [np.zeros(0, np.uint64)]
        for n, own in lengths.items():
            total = np.zeros(len(own), np.uint64)
            for j in range(n):
                total = total * _BASE + np.array([ord(p[j]) + 1 for p in own], np.uint64)
            key.append(X.mix(total + np.uint64(n)))
        key, sym = np.concatenate(key), np.array([of[p] for own in lengths.values() for p in own], np.int64)
        order = np.argsort(key)
        self.key, self.sym = key[order], sym[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.key & np.uint64(len(self.bits) - 1)).astype(np.int64)] = True

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        """The pieces of a unigram or BPE model whose texts are taken as they are; other models would give other ids and are refused."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        kind, normal = model.trainer_spec.model_type, model.normalizer_spec
        if kind not in (1, 2):
            raise ValueError(f"model type {kind} is neither unigram (1) nor BPE (2)")
        odd = [n for n, v, well in (("precompiled_charsmap", len(normal.precompiled_charsmap), 0), ("remove_extra_whitespaces", normal.remove_extra_whitespaces, False), ("add_dummy_prefix", normal.add_dummy_prefix, True), ("escape_whitespaces", normal.escape_whitespaces, True), ("treat_whitespace_as_suffix", model.trainer_spec.treat_whitespace_as_suffix, False)) if v != well]
        if odd:
            raise ValueError(f"the model changes texts before it encodes them: {', '.join(odd)}")
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("pieces defined by the user are taken before all others")
        kinds = ["n" if p.type == 1 else "b" if p.type == 6 else "x" for p in model.pieces]
        return cls([p.piece for p in model.pieces], [p.score for p in model.pieces], kinds, kind == 2)

    def _splits(self, symbols: list[str]) -> None:
        """left and right: the two symbols whose merge makes each one (itself where none do); pair, merged: those merges, sorted."""
        of = {p: i for i, p in enumerate(symbols) if i}
        left, right = list(range(len(symbols))), list(range(len(symbols)))
        pairs: dict[tuple[int, int], int] = {}

        def follows(a: int, b: int) -> bool:
            """Scalar twin of self.follows() over the merges found so far."""
            limit = len(symbols)
            while True:
                if pairs.get((a, b), limit) < limit:
                    return False
                if right[a] != a and (a > b or left[b] == b):
                    limit, a = a, right[a]
                elif left[b] != b:
                    limit, b = b + 1, left[b]
                else:
                    return True

        for k, p in enumerate(symbols):
            for i in range(len(p) - 1, 0, -1):
                a, b = of.get(p[:i], k), of.get(p[i:], k)
                if a < k and b < k and follows(a, b):
                    left[k], right[k], pairs[a, b] = a, b, k
                    break
        self.left, self.right = np.array(left), np.array(right)
        at = sorted(pairs)
        self.pair = np.array([*(a << 32 | b for a, b in at), _TOP], np.int64)
        self.merged = np.array([*(pairs[x] for x in at), _TOP], np.int64)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of symbols a and b by themselves leaves these two.

        Seen backwards from the end of merging: the younger of the two that meet at the border is taken apart; if they themselves
        have an earlier merge than the last one taken apart, it would have come first.
        """
        out, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), _TOP)
        while len(live):
            k = a << 32 | b
            at = np.searchsorted(self.pair, k)
            bad = (self.pair[at] == k) & (self.merged[at] < limit)
            out[live[bad]] = False
            r, l = self.right[a], self.left[b]
            split_a, split_b = r != a, l != b
            split_a &= (a > b) | ~split_b
            go = ~bad & (split_a | split_b)
            limit = np.where(split_a, a, b + 1)[go]
            a, b, live = np.where(split_a, r, a)[go], np.where(split_a, b, l)[go], live[go]
        return out

    def viterbi(self, codes: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all rows, sizes): the best path through each row of characters, all rows of one length."""
        m, n = codes.shape
        codes, leaf = codes.T.astype(np.uint64) + np.uint64(1), leaf.T
        run, power = np.zeros((n + 1, m), np.uint64), np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _BASE)])
        for j in range(n):
            run[j + 1] = run[j] * _BASE + codes[j]
        best, back, last = np.zeros((n + 1, m)), np.zeros((n + 1, m), np.int32), np.zeros((n + 1, m), np.int64)
        for j in range(1, n + 1):
            last[j], back[j] = leaf[j - 1], j - 1
            best[j] = -1 if self.bpe else best[j - 1] + self.score[leaf[j - 1]]
            todo = None
            for i in range(max(0, j - self.longest), j - 1):
                h = X.mix((run[j] - run[i] * power[j - i] if todo is None else run[j, todo] - run[i, todo] * power[j - i]) + np.uint64(j - i))
                maybe = np.flatnonzero(self.bits[(h & np.uint64(len(self.bits) - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.key, h[maybe]), len(self.key) - 1)
                hit = self.key[at] == h[maybe]
                rows, sym = maybe[hit] if todo is None else todo[maybe[hit]], self.sym[at[hit]]
                if not len(rows):
                    continue
                if self.bpe:
                    value = np.where(self.follows(last[i, rows], sym), 0.0, -np.inf) if i else np.zeros(len(rows))
                else:
                    value = best[i, rows] + self.score[sym]
                up = value > best[j, rows]
                rows = rows[up]
                best[j, rows], back[j, rows], last[j, rows] = value[up], i, sym[up]
                if self.bpe and len(rows):  # no other piece may end here
                    todo = np.flatnonzero(best[j] < 0)
                    if not len(todo):
                        break
        out, size, at, rows = np.empty((m, n), np.int64), np.zeros(m, np.int64), np.full(m, n), np.arange(m)
        while len(rows):
            size[rows] += 1
            out[rows, n - size[rows]] = last[at, rows]
            at = back[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        return out[np.arange(n) >= (n - size)[:, None]], size

    def units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of some units."""
        codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.code, codes), len(self.code) - 1)
        leaf = np.where(self.code[at] == codes, at + 1, 0)
        size = np.array([len(u) for u in units])
        first = np.cumsum(size) - size
        which, sizes, out = [], [], []
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            step = max(1, CELLS // n)
            for a in range(0, len(rows), step):
                own = rows[a : a + step]
                where = first[own][:, None] + np.arange(n)
                sym, count = self.viterbi(codes[where], leaf[where])
                which.append(own)
                sizes.append(count)
                out.append(self._bytes(sym, count, codes[where].ravel(), n))
        which, sizes, flat = np.concatenate(which), np.concatenate(sizes), np.concatenate([x for x, _ in out])
        sizes = np.concatenate([x for _, x in out])
        begin, order = np.cumsum(sizes) - sizes, np.argsort(which)
        n = sizes[order]
        return n, flat[np.repeat(begin[order] - (np.cumsum(n) - n), n) + np.arange(len(flat))]

    def _bytes(self, sym: np.ndarray, count: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): symbols without a piece become the pieces of their bytes."""
        ids = self.id[sym]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, count
        place = (np.cumsum(self.length[sym]) - self.length[sym])[odd]  # rows have n characters each and follow one another
        own = [self.byte_id[list(chr(c).encode("utf-8", "replace"))] for c in codes[place].tolist()]
        own = [x if x.min() >= 0 else np.array([self.unknown], np.int32) for x in own]
        more = np.array([len(x) for x in own])
        row = np.repeat(np.arange(len(count)), count)[odd]
        reps = np.ones(len(ids), np.int64)
        reps[odd] = more
        ids, fill = np.repeat(ids, reps), np.repeat(np.arange(len(reps)), reps)
        ids[np.isin(fill, odd)] = np.concatenate(own)
        return ids, count + np.bincount(row, weights=more - 1, minlength=len(count)).astype(np.int64)

    def encode(self, texts: list[str], met: Units) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids). Units: spaces and what follows them, or one of self.cuts."""
        marked = [(" " + t.replace(MARK, " ")).encode() if t else b"" for t in texts]
        off = np.r_[0, np.cumsum([len(t) for t in marked])]
        raw = b"".join(marked)
        buf = np.frombuffer(raw, np.uint8)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        space, cut = buf == 32, np.isin(buf, self.cuts)
        head = cut.copy()
        head[1:] |= (space[1:] & ~space[:-1] & self.at_spaces) | (~space[1:] & cut[:-1])
        head[off[:-1][off[:-1] < len(buf)]] = True
        start = np.flatnonzero(head)
        end = np.r_[start[1:], len(buf)]

        def encode(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(which):
                return np.zeros(0, np.int64), np.zeros(0, np.uint32)
            n, ids = self.units([raw[a:b].decode().replace(" ", MARK) for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)])
            return n, ids.astype(np.uint32)

        entry, first, pool = met.ids(np.column_stack([X.hash_extents(buf, start, end), X.hash_extents(buf, start, end, 1)]), encode)
        size = first[entry + 1] - first[entry]
        total = np.r_[0, np.cumsum(size)]
        ids = pool[np.repeat(first[entry] - total[:-1], size) + np.arange(total[-1])]
        return ids.astype(np.int32), total[np.searchsorted(start, off)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The texts of ids[off[i]:off[i + 1]]; the mark that encoding puts first is taken off."""
        size = (self.raw_at[1:] - self.raw_at[:-1])[ids]
        at = np.r_[0, np.cumsum(size)]
        flat = self.raw[np.repeat(self.raw_at[ids] - at[:-1], size) + np.arange(at[-1])].tobytes()
        return [flat[a + (b > a) : b] for a, b in zip(at[off[:-1]].tolist(), at[off[1:]].tolist(), strict=True)]


_met: dict[str, Units] = {}


def met_by(pieces: Pieces) -> Units:
    """The units that this worker process has met, of one model at a time."""
    if pieces.name not in _met:
        _met.clear()
        _met[pieces.name] = Units()
    return _met[pieces.name]


def encode_documents(documents: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_crc32, round_trip) of each row of *documents* (doc_id, text).

    ids are those of the model; ids_crc32 is of them as little-endian unsigned 32-bit integers; round_trip tells whether decoding
    gives the text back. Null and empty texts have no ids; rows without doc_id are left out; repeated rows each give a
    row; other columns are ignored.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(Pieces.load(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in X.slices(batches, limit=2 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, off = pieces.encode(texts, met_by(pieces))
            flat = ids.astype("<i4")
            same = [a == b.encode() for a, b in zip(pieces.decode(ids, off), texts, strict=True)]
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), lists, pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids", "ids_crc32", "round_trip"])

    own = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean")
