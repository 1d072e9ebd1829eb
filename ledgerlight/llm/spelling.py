"""Operator 12: spelling variants, words one edit apart, by a rare-first prefix filter of positional bigrams.

All bigrams are put in one order, rare ones first. One edit spoils at most two bigrams of a word, and those that it leaves keep their order,
so the first bigram that two near words still share is among the three rarest of each. Its place is limited: either the edit comes after
it, and the words agree up to its end, or before it, and they agree from its start on. So each word goes out under six keys, its
beginning up to and its ending from each of its three rarest bigrams, and only words of one key are compared.

Words under a key of more than BUCKET words aren't compared with each other: they go out once more under what is left of the free
part of the word when one letter is taken out. Words of one such key differ in that letter alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import lookup
from .text import LOWER, _P, _power, _Q, hash_extents, mix, slices, text_arrays, words

#: Fewest code points of a word, and fewest occurrences.
SHORTEST, LEAST = 5, 3
#: Words under one key that are compared with each other.
BUCKET = 64
#: One in so many runs of a document loses a letter.
SLIPS = 97
_RAREST = 3
_FAR = 64

# Letters a-z and U+00C0 to U+00FF stand as Latin-1 bytes, anything else as a blank.
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[0xC0:] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & np.uint32(1), (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(Latin-1 letters and blanks, offsets) of a text column, A-Z lower-cased."""
    buf, off = text_arrays(column)
    after = np.zeros(len(buf), bool)
    after[1:] = buf[:-1] == 0xC3
    keep = buf != 0xC3  # the first byte of the two that make U+00C0 to U+00FF
    low = np.where(after, buf + np.uint8(0x40), np.where(buf < 0x80, LOWER[buf], np.uint8(0x20)))
    return np.where(_LETTER[low], low, np.uint8(0x20))[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def _shifted(crc: np.ndarray, most: int) -> np.ndarray:
    """[i, n]: what crc[i] becomes when n bytes follow, before the crc of these bytes is added."""
    out = np.empty((len(crc), most + 1), np.uint32)
    out[:, 0] = crc
    for n in range(most):
        out[:, n + 1] = _CRC[out[:, n] & np.uint32(0xFF)] ^ (out[:, n] >> np.uint32(8))
    return out


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each slice of (doc_id, text): the runs of letters, some without a letter."""
    for b in slices(batches):
        buf, off = _letters(b.column(1))
        w = words(buf, off, _LETTER)
        if not len(w.h):
            continue
        size, row = w.end - w.start, np.repeat(np.arange(b.num_rows), w.counts)
        _, first, unit = np.unique(w.h, return_index=True, return_inverse=True)
        other = hash_extents(buf, w.start, w.end, seed=1)
        if (other != other[first[unit]]).any():  # two runs of one fingerprint
            _, first, unit = np.unique(np.stack([w.h, other], axis=1), axis=0, return_index=True, return_inverse=True)
        run = [buf[s:e].tobytes().decode("latin-1") for s, e in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
        raw = [r.encode() for r in run]
        crc, n_bytes = np.array([zlib.crc32(r) for r in raw], np.uint32), np.array([len(r) for r in raw])
        heads = np.array([zlib.crc32(f"{d}:".encode()) for d in b.column(0).to_pylist()], np.uint32)
        near = n_bytes[unit] <= _FAR
        h = np.zeros(len(unit), np.uint32)
        h[near] = _shifted(heads, _FAR)[row[near], n_bytes[unit[near]]] ^ crc[unit[near]]
        for i in np.flatnonzero(~near).tolist():
            h[i] = zlib.crc32(raw[unit[i]], int(heads[row[i]]))
        slip = h % np.uint32(SLIPS) == 0
        n = np.bincount(unit[~slip], minlength=len(run))
        out = {r: k for r, k in zip(run, n.tolist(), strict=True) if k and len(r) >= SHORTEST}
        for u, at in zip(unit[slip].tolist(), (h[slip] % size[slip].astype(np.uint32)).tolist(), strict=True):
            r = run[u][:at] + run[u][at + 1 :]
            if len(r) >= SHORTEST:
                out[r] = out.get(r, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["word", "n"])


def word_counts(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n) of all words of (doc_id, text) that occur at least *least* times.

    Runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; where 97 divides the crc32 of <doc_id>:<run> the run's letter at the place
    crc32 modulo its length goes; then words of five code points or more. Null texts have none.
    """
    counted = documents.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _bigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) of (word)."""
    for b in slices(batches, "word"):
        buf, off = _letters(b.column(0))
        inside = np.ones(max(len(buf) - 1, 0), bool)
        inside[off[1:-1] - 1] = False
        gram, n = np.unique(_grams(buf)[inside], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int32()), pa.array(n, pa.int64())], names=["gram", "n"])


def _grams(buf: np.ndarray) -> np.ndarray:
    return buf[:-1].astype(np.int32) * 256 + buf[1:]


def _keyed(rank: np.ndarray):
    """(word, n, key, cut, after) of (word, n): six keys; cut is where the free part begins (after) or ends."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "word", 1 << 20):
            buf, off = _letters(b.column(0))
            row = np.repeat(np.arange(b.num_rows), np.diff(off))[:-1]
            place = np.arange(len(buf) - 1)
            inside = place + 1 < off[row + 1]
            row, place = row[inside], place[inside]
            order = np.lexsort((place, rank[_grams(buf)[place]], row))
            first = np.searchsorted(row[order], np.arange(b.num_rows))
            rare = np.sort(order[(np.arange(len(order)) - first[row[order]]) < _RAREST])
            r, p = row[rare], place[rare]
            head, tail = hash_extents(buf, off[r], p + 2), hash_extents(buf, p, off[r + 1], seed=1)
            both = b.take(pa.array(np.concatenate([r, r])))
            more = [np.concatenate([head, tail]).view(np.int64), np.concatenate([p + 2, p]) - off[np.concatenate([r, r])], np.arange(2 * len(r)) < len(r)]
            yield pa.RecordBatch.from_arrays([both.column(0), both.column(1), *map(pa.array, more)], names=["word", "n", "key", "cut", "after"])

    return run


_K = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _without_a_letter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, key, role) of (word, n, key, cut, after): the free part without each of its letters, by its place (role 0) and anywhere
    (role 2), and the free part as it is (role 1)."""
    for b in slices(batches, "word", 1 << 16):
        buf, off = _letters(b.column(0))
        key, cut, after = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        s, e = np.where(after, off[:-1] + cut, off[:-1]), np.where(after, off[1:], off[:-1] + cut)
        power, back = _power(_P, len(buf) + 1), _power(_Q, len(buf) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)])])
        size = e - s
        row = np.repeat(np.arange(b.num_rows), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + s[row]
        own = key.view(np.uint64)
        whole = mix((total[e] - total[s]) * back[s] + own * _K[0])
        rest = (total[at] - total[s[row]] + (total[e[row]] - total[at + 1]) * np.uint64(_Q)) * back[s[row]]
        place = mix(rest + own[row] * _K[1] + (at - s[row]).astype(np.uint64) * _K[2])
        anywhere = mix(rest + own[row] * _K[0])
        rows = np.concatenate([row, np.arange(b.num_rows), row])
        role = np.concatenate([np.zeros(len(row), np.int32), np.ones(b.num_rows, np.int32), np.full(len(row), 2, np.int32)])
        both = b.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([both.column(0), both.column(1), pa.array(np.concatenate([place, whole, anywhere]).view(np.int64)), pa.array(role)], names=["word", "n", "key", "role"])


def _pairs(rows: DataFrame, both: Column) -> DataFrame:
    """Pairs of rows of one key under a condition, one edit apart."""
    a, b = rows.alias("a"), rows.alias("b")
    near = a.join(b, (F.col("a.key") == F.col("b.key")) & both).where(F.levenshtein("a.word", "b.word", 1) == 1)
    return near.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("m"))


def near_words(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, other, m): every ordered pair of words of (word, n) that differ by one inserted, deleted or replaced code point.

    Words are distinct, of five or more letters a-z and U+00C0 to U+00FF.
    """
    grams = counts.select("word").mapInArrow(_bigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rank = np.zeros(1 << 16, np.int32)
    for i, r in enumerate(sorted(grams.collect(), key=lambda r: (r.n, r.gram))):  # the alphabet has 90 letters, so 8,100 rows at most
        rank[r.gram] = i
    keys = scratch.save(counts.mapInArrow(_keyed(rank), "word string, n long, key long, cut long, after boolean"), "keys")
    large = keys.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BUCKET).withColumn("large", F.lit(True))
    keys = scratch.save(lookup(keys, large, ["key"], "size", keys.count(), "word"), "keys")
    small = _pairs(keys.where("large is null"), (F.col("a.word") < F.col("b.word")) & (F.abs(F.length("a.word") - F.length("b.word")) <= 1))
    free = keys.where("large").select("word", "n", "key", "cut", "after").mapInArrow(_without_a_letter, "word string, n long, key long, role int")
    role = lambda x, y: (F.col("a.role") == x) & (F.col("b.role") == y)
    rest = _pairs(free, (role(0, 0) & (F.col("a.word") < F.col("b.word"))) | role(1, 2))
    low, high = (F.least("word", "other"), F.greatest("word", "other"))
    n = lambda c: F.when(F.col("word") == c, F.col("n")).otherwise(F.col("m"))
    pairs = small.unionByName(rest).select(low.alias("word"), n(low).alias("n"), high.alias("other"), n(high).alias("m")).distinct()
    return pairs.select(F.explode(F.array(F.struct("word", "n", "other", "m"), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))).alias("p")).select("p.*")


def spelling_variants(documents: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of (doc_id, text) that word_counts names.

    n_near: words one edit apart; form: the commonest of them (of equally common ones the first by code points), where it is at least
    twice as common, else null; form_n: its count; root: what forms lead to from here, the word itself where it has none. A row without
    doc_id counts with the id None; repeated rows count each; other columns are ignored; an empty table gives no words.
    """
    scratch = Scratch(documents.sparkSession, "spelling")
    counts = scratch.save(word_counts(documents), "counts")
    best = near_words(counts, scratch).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    rows = counts.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.other").alias("near"), (-F.col("best.m")).alias("m"))
    formed = F.col("m") >= 2 * F.col("n")
    rows = scratch.save(rows.select("word", F.when(formed, F.col("near")).alias("form"), "n", "n_near", F.when(formed, F.col("m")).alias("form_n")), "forms")
    return rows.join(_roots(rows, scratch), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the words of (word, form) that have a form. Counts double with each form, so there are few rounds."""
    cur = scratch.save(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = scratch.save(cur.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        cur = after.drop("moved")
