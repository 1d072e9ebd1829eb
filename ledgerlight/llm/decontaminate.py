"""Operator 7: benchmark decontamination with spaced seeds.

A mask looks at five of seven consecutive words and ignores the others, so a seed still hits where ignored words
were exchanged; with a third mask of six equal words in a row they together hit every overlap of 13 or more words of
which 80 % agree. Seeds of the test items (a stated set, taken in blocks of bounded size, each broadcast) meet the seeds of
every text; around the hits item and text are aligned word by word, and the longest stretch through each hit is taken of
which 80 % of the words agree.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X

#: Fixed masks: the word positions that a seed looks at.
MASKS = ((0, 2, 4, 5, 6), (0, 1, 2, 3, 6), (0, 1, 2, 3, 4, 5))
SHORTEST, LEAST = 5, 13
BLOCK_CHARS, PIECE = 8 << 20, 1 << 20
_R = X.mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _seeds(h: np.ndarray, mask: tuple[int, ...], tag: int) -> np.ndarray:
    """Seed at each place where the mask's last word still exists."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, tag, np.uint64)
    for j, o in enumerate(mask):
        out += h[o : o + n] * _R[j]
    return X.mix(out)


def _masks(lengths: set[int]) -> list[tuple[int, tuple[int, ...]]]:
    """All masks, and for items of fewer than LEAST words the unbroken run that a fifth of exchanged words must leave."""
    runs = {n: -(-(n - n // 5) // (n // 5 + 1)) for n in lengths}
    return [(i, m) for i, m in enumerate(MASKS)] + [(100 + n, tuple(range(runs[n]))) for n in sorted(lengths)]


class Seeds:
    """Seeds of a block of test items, sorted, behind a table of bits."""

    def __init__(self, items: list[tuple[int, str]], shortest: int = SHORTEST):
        self.items, self.words, seeds, item, place = [], [], [], [], []
        short = set()
        for i, t in items:
            buf, off = X.text_arrays(pa.array([t or ""]))
            h = X.words(X.LOWER[buf], off, X.ALNUM).h
            if len(h) >= max(shortest, 1):
                self.items.append(i)
                self.words.append(h)
                short |= {len(h)} if len(h) < LEAST else set()
        self.masks = _masks(short)
        for k, h in enumerate(self.words):
            for tag, m in self.masks:
                if tag == 100 + len(h) or (tag < 100 and len(h) >= LEAST):
                    s = _seeds(h, m, tag)
                    seeds.append(s)
                    item.append(np.full(len(s), k))
                    place.append(np.arange(len(s)))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        seeds, item, place = cat(seeds, np.uint64), cat(item, np.int64), cat(place, np.int64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item, self.place = seeds[order], item[order], place[order]
        self.bits = np.zeros(1 << max(12, min(26, int(len(seeds) * 32).bit_length())), bool)
        self.bits[(self.seeds & np.uint64(len(self.bits) - 1)).astype(np.int64)] = True

    def hits(self, w: X.Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the slice, item, place in the item) of each equal seed within a text, in pieces of about PIECE pairs."""
        for tag, m in self.masks:
            s = _seeds(w.h, m, tag)
            at = np.flatnonzero(self.bits[(s & np.uint64(len(self.bits) - 1)).astype(np.int64)])
            at = at[np.isin(at, w.inside(m[-1] + 1), assume_unique=True)] if len(at) else at
            lo, hi = np.searchsorted(self.seeds, s[at]), np.searchsorted(self.seeds, s[at], side="right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            piece = np.cumsum(n) // PIECE
            cut = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1], True]) if len(at) else []
            for f, t in zip(cut[:-1], cut[1:], strict=True):
                k = n[f:t]
                own = np.repeat(lo[f:t] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                yield np.repeat(at[f:t], k), self.item[own], self.place[own]


def _stretches(same: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """For the equal words *at*: the longest stretch through each that begins and ends with equal words, has LEAST words and of which 80 % agree."""
    total = np.r_[0, np.cumsum(np.where(same, 1, -4))]  # each exchanged word is paid for by four equal ones
    i = np.flatnonzero(same)
    j, out = i + 1, []
    ahead = -np.maximum.accumulate(total[j][::-1])[::-1]
    to = j[np.searchsorted(ahead, -total[i], side="right") - 1]
    i, to = i[to - i >= LEAST], to[to - i >= LEAST]
    while True:
        holds = np.searchsorted(at, to) > np.searchsorted(at, i)
        i, to = i[holds], to[holds]
        if not len(i):
            return out
        k = (to - i).argmax()
        out.append((int(i[k]), int(to[k])))
        at = at[(at < i[k]) | (at >= to[k])]


def matches(seeds: Seeds, w: X.Words) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, aligned words, equal words): the best verified overlap of each row and item."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for p, item, q in seeds.hits(w):
        row = np.searchsorted(w.first, p, side="right") - 1
        order = np.lexsort((p, p - q, item, row))
        p, item, row, on = p[order], item[order], row[order], (p - q)[order]
        begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (on[1:] != on[:-1])][: len(p)])
        for f, t in zip(begin.tolist(), [*begin[1:].tolist(), len(p)], strict=False):  # one row, item and diagonal
            r, k, diag = int(row[f]), int(item[f]), int(on[f])
            lo, hi = int(w.first[r]), int(w.first[r + 1])
            words = seeds.words[k]
            a, b = max(lo, diag), min(hi, diag + len(words))
            same = w.h[a:b] == words[a - diag : b - diag]
            for i, j in _stretches(same, p[f:t] - a) if len(words) >= LEAST else [(0, b - a)]:
                n, equal = j - i, int(same[i:j].sum())
                if n >= min(LEAST, len(words)) and 5 * equal >= 4 * n:
                    best[r, k] = max(best.get((r, k), (0, 0, 0)), (equal, n, -(a + i - lo)))
    return [(r, k, -s, n, same) for (r, k), (same, n, s) in sorted(best.items())]


def contamination(documents: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, item_id, start, n_aligned, n_equal): texts that hold a passage of a test item.

    Words are runs of A-Z (lower-cased), digits and non-ASCII characters. A passage counts from 13 aligned words, the first and last
    equal (all words of an item that has *shortest* to 12), of which 80 % agree; items of fewer words than *shortest* are too common to tell
    anything and never match. start counts words from 0. One row for each
    document and item, the longest overlap. Null or empty texts match nothing; rows without an id are left out; rows that share
    a doc_id count as one; other columns are ignored; an empty table on either side gives no rows.
    """
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = total // BLOCK_CHARS + 1
    schema = "doc_id long, item_id long, start long, n_aligned long, n_equal long"

    def of_block(i: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).dropDuplicates().collect()  # about BLOCK_CHARS of text
        shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(Seeds(sorted((r[0], r[1] or "") for r in rows), shortest), 5))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = pickle.loads(shared.value)
            for batch in X.slices(batches, limit=2 << 20):
                buf, off = X.text_arrays(batch.column(1))
                ids = batch.column(0).to_pylist()
                found = [(ids[r], seeds.items[k], s, n, same) for r, k, s, n, same in matches(seeds, X.words(X.LOWER[buf], off, X.ALNUM))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        return docs.mapInArrow(run, schema)

    found = reduce(DataFrame.union, [of_block(i) for i in range(blocks)])
    # an item may have several texts, and a document several rows
    best = F.max(F.struct("n_equal", "n_aligned", (-F.col("start")).alias("start"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("m.start")).alias("start"), "m.n_aligned", "m.n_equal")
