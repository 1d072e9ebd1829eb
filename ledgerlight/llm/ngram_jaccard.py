"""Operator 1: n-gram Jaccard join, a grouped prefix join.

1. Map: each slice of documents becomes sets of k-word shingles; equal sets of one slice
   collapse. The shingles are dealt out by range of their fingerprint, packed in
   arrays; one that is in many documents of the slice travels once, with its count.
2. By fingerprint range: document frequencies. Only shingles of two or more documents
   can be shared, so only those go back, to their slice.
3. By slice: the global order of shingles is (frequency, fingerprint), rarest first. Only a document
   with a shared shingle in its prefix can have a partner; most have none.
4. By prefix shingle: documents with the same prefix and size are one group. Pairs of groups
   pass the size and the positional filter, are expanded into members, and pass a bitmap
   filter; all three are exact bounds. Equal documents have been made one before, over all slices. Of a list of over SHORT documents a spanning forest
   of the most similar pairs goes on, never all pairs.
5. Pairs are verified on the whole sets. Where a pair fails, its lists run
   again over the components found so far with ever more pairs for each two components,
   until every pair of components is linked or each of its pairs has failed: no link is lost.

Very long lists are dealt out as pairs of blocks. Fingerprints have 48 bits below the range
they were dealt by: two sets of 500 shingles overlap falsely with a chance near 1e-12.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .components import components
from .scratch import Scratch, partitions

HEAVY = 64
BLOCK = 8192
SHORT = 16
BITS = 1024
ROWS = 1000
HELD = 1 << 18
RANGE_BYTES = 2 << 20
_LOW = np.uint64((1 << 48) - 1)
_DEALT = "kind int, key int, slice long, data binary"
_DOC = "doc_id long, n long, rep long, s int, tokens binary"
_ENTRY = np.dtype([("id", "<i8"), ("n", "<i4"), ("s", "<i4"), ("pos", "<i4"), ("group", "<u8"), ("comp", "<i8"), ("bits", "<u8", BITS // 64)])


def _arrow(schema: str, cols: list) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def shingle_sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """doc_ids and each one's sorted distinct shingle fingerprints (lower-cased A-Z)."""
    sets = []
    for piece in X.slices([batch], limit=X.PIECE_BYTES):
        buf, off = X.text_arrays(piece.column(piece.schema.get_field_index("text")))
        w = X.words(X.LOWER[buf], off)
        grams, at = X.rolling(w.h, k), w.inside(k)
        grams = grams[at]
        first = np.searchsorted(at, w.first)
        for i, n in enumerate(w.counts.tolist()):
            if n >= k:
                sets.append(np.unique(grams[first[i] : first[i + 1]]))
            else:
                own = w.h[w.first[i] : w.first[i + 1]].copy()
                sets.append(X.rolling(own, n) ^ np.uint64(0xA5A5A5A5A5A5 + n) if n else own)
    return batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False), sets


@X.freed
def _deal(batches: Iterator[pa.RecordBatch], k: int, ranges: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for seq, batch in enumerate(X.slices(batches)):
        ids, sets = shingle_sets(batch, k)
        n = np.array([len(x) for x in sets], np.int64)
        rep = np.full(len(ids), -1, np.int64)
        known: dict[bytes, int] = {}
        for i in np.argsort(ids, kind="stable").tolist():
            if n[i]:
                j = known.setdefault(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), i)
                rep[i] = j if j != i else -1
        used = [i for i in range(len(ids)) if n[i] and rep[i] < 0]
        h = np.concatenate([sets[i] for i in used]) if used else np.zeros(0, np.uint64)
        doc = np.repeat(np.array(used, np.uint32), n[used]) if used else np.zeros(0, np.uint32)
        del sets
        rng = (((h >> np.uint64(48)) * np.uint64(ranges)) >> np.uint64(16)).astype(np.uint16)
        h &= _LOW
        h |= rng.astype(np.uint64) << np.uint64(48)
        s = np.sort(h)
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        count = np.diff(np.r_[head, len(s)])
        heavy, heavy_n = s[head[count >= HEAVY]], count[count >= HEAVY].astype(np.uint32)
        del s, head, count
        where = np.searchsorted(heavy, h).astype(np.uint32)
        is_heavy = (where < len(heavy)) & (heavy[np.minimum(where, max(len(heavy) - 1, 0))] == h) if len(heavy) else np.zeros(len(h), bool)
        this = (part << 24) | seq
        info = pickle.dumps((ids, n, rep, doc[is_heavy], where[is_heavy], heavy), 5)
        rows = [[1, this % ranges, this, info]]
        light = ~is_heavy
        del where, is_heavy
        h, doc, rng = h[light], doc[light], rng[light]
        order = np.argsort(rng, kind="stable")
        h, doc, rng = h[order], doc[order], rng[order]
        del order
        cut, cut2 = np.searchsorted(rng, np.arange(ranges + 1)), np.searchsorted(heavy >> np.uint64(48), np.arange(ranges + 1, dtype=np.uint64))
        six = h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :6]
        for r in range(ranges):
            a, b, c, d = cut[r], cut[r + 1], cut2[r], cut2[r + 1]
            if b > a or d > c:
                step = np.diff(doc[a:b], prepend=0)
                step = step.astype(np.uint8 if not b > a or step.max() < 256 else np.uint32)
                rows.append([0, r, this, pickle.dumps((np.ascontiguousarray(six[a:b]), step, heavy[c:d], heavy_n[c:d]), 5)])
        yield from _arrow(_DEALT, list(zip(*rows, strict=True))).to_batches()


@X.freed
def _frequencies(table: pa.Table) -> pa.Table:
    kind, key, where, data = (table.column(c).to_pylist() for c in table.column_names)
    rows, got = [], []
    for k, r, at, raw in zip(kind, key, where, data, strict=True):
        if k:
            rows.append((1, 0, at, raw))
        else:
            six, step, heavy, heavy_n = pickle.loads(raw)
            h = np.zeros((len(six), 8), np.uint8)
            h[:, :6] = six
            got.append((at, h.view("<u8").ravel() | np.uint64(r << 48), np.cumsum(step, dtype=np.int64), heavy, heavy_n))
    if got:
        h = np.concatenate([x for g in got for x in (g[1], g[3])])
        c = np.concatenate([x for g in got for x in (np.ones(len(g[1]), np.int64), g[4].astype(np.int64))])
        order = np.argsort(h, kind="stable")
        head = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        total = np.add.reduceat(c[order], head)
        df = np.empty(len(h), np.int64)
        df[order] = np.repeat(total, np.diff(np.r_[head, len(h)]))
        level = np.minimum(np.floor(np.log2(df) * 6), 255).astype(np.uint8)
        at = 0
        for where, own, doc, heavy, _ in got:
            d, lv = df[at : at + len(own)], level[at : at + len(own)]
            lv2 = level[at + len(own) : at + len(own) + len(heavy)]
            at += len(own) + len(heavy)
            keep = d > 1
            if keep.any() or len(heavy):
                rows.append((0, 0, where, pickle.dumps((own[keep], doc[keep].astype(np.uint32), lv[keep], heavy, lv2), 5)))
    return _arrow(_DEALT, list(zip(*rows, strict=True)) or [[], [], [], []])


@X.freed
def _prefixes(table: pa.Table, num: int, den: int) -> pa.Table:
    """Rows of _DOC of one slice; tokens, in the global order, only for documents that may have a partner."""
    got, infos = [], []
    for k, raw in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        (infos if k else got).append(pickle.loads(raw))
    ids, n, rep, hdoc, hwhere, heavy = infos[0]
    cat = lambda j, kind: np.concatenate([g[j] for g in got]) if got else np.zeros(0, kind)
    tok, doc, lv, hh, hl = cat(0, np.uint64), cat(1, np.uint32), cat(2, np.uint8), cat(3, np.uint64), cat(4, np.uint8)
    if len(heavy):
        order = np.argsort(hh)
        of = hl[order][np.searchsorted(hh[order], heavy)]
        tok, doc, lv = np.concatenate([tok, heavy[hwhere]]), np.concatenate([doc, hdoc]), np.concatenate([lv, of[hwhere]])
    shared = np.bincount(doc, minlength=len(ids))
    single = n - shared
    prefix = n - -(-n * num // den) + 1
    active = (n > 0) & (rep < 0) & (single < prefix) & (shared > 0)
    use = active[doc] if len(doc) else np.zeros(0, bool)
    tok, doc, lv = tok[use], doc[use], lv[use]
    order = np.lexsort((tok, lv, doc))
    tok, doc = tok[order], doc[order]
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    tokens = [tok[cut[i] : cut[i + 1]].tobytes() if a else None for i, a in enumerate(active.tolist())]
    cols = [ids.tolist(), n.tolist(), [int(ids[r]) if r >= 0 else None for r in rep.tolist()], single.tolist(), tokens]
    return _arrow(_DOC, cols)


def _few(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


@X.freed
def _entries(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """One row for each prefix shingle and ROWS documents: the packed entries of these."""
    for batch in _few(batches, ROWS):
        cols = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
        parts, toks = [], []
        for i, n, s, comp, raw in zip(cols["doc_id"], cols["n"], cols["s"], cols["comp"], cols["tokens"], strict=True):
            tok = np.frombuffer(raw, "<u8")
            pre = tok[: n - -(-n * num // den) + 1 - s]
            e = np.zeros(len(pre), _ENTRY)
            e["id"], e["n"], e["s"], e["comp"], e["pos"] = i, n, s, comp, s + np.arange(len(pre))
            own = i if s else int.from_bytes(hashlib.blake2b(pre.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little")
            e["group"] = np.uint64(own & (2**64 - 1))
            odd = np.bincount((tok % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
            e["bits"] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
            parts.append(e)
            toks.append(pre)
        if parts:
            e, t = np.concatenate(parts), np.concatenate(toks)
            order = np.argsort(t, kind="stable")
            e, t = e[order], t[order]
            head = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            to = np.r_[head[1:], len(t)]
            yield from _arrow("token long, size int, data binary", [t[head].view(np.int64), (to - head).astype(np.int32), [e[a:b].tobytes() for a, b in zip(head, to, strict=True)]]).to_batches()


def _bound(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least possible share of unshared shingles of each pair of entries of one list; inf where they can't be linked."""
    n, m = x["n"].astype(np.int64), y["n"].astype(np.int64)
    before = np.minimum(x["pos"] - x["s"], y["pos"] - y["s"])
    after = np.minimum(n - x["pos"], m - y["pos"])
    apart = np.bitwise_count(x["bits"] ^ y["bits"]).sum(axis=1, dtype=np.int64)
    both = np.minimum(np.minimum(before + after, np.minimum(n - x["s"], m - y["s"])), (n - x["s"] + m - y["s"] - apart) // 2)
    ok = (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (both >= -(-(n + m) * num // (num + den)))
    return np.where(ok, 1 - 2 * both / (n + m), np.inf)


class _List:
    """The documents that have one prefix shingle; bound(v) filters pairs by group, then by member."""

    def __init__(self, e: np.ndarray, num: int, den: int):
        self.e, self.num, self.den = e, num, den
        _, self.lead, self.of = np.unique(e["group"], return_index=True, return_inverse=True)

    def bound(self, v: int) -> np.ndarray:
        """_bound() of v and each member: by size and position for whole groups, then by bitmap for their members."""
        e, num, den = self.e, self.num, self.den
        x, g = e[v], e[self.lead]
        n, gn = int(x["n"]), g["n"].astype(np.int64)
        both = np.minimum(x["pos"] - x["s"], g["pos"] - g["s"]) + np.minimum(n - x["pos"], gn - g["pos"])
        ok = (den * np.minimum(n, gn) >= num * np.maximum(n, gn)) & (both >= -(-(n + gn) * num // (num + den)))
        out = np.full(len(e), np.inf)
        at = np.flatnonzero(ok[self.of])
        out[at] = _bound(e[v : v + 1], e[at], num, den)
        out[v] = np.inf
        return out

    def forest(self) -> list[tuple[int, int]]:
        """A least spanning forest of the pairs that passed (Prim), over components."""
        size = len(self.e)
        best, parent, out = np.full(size, np.inf), np.full(size, -1), []
        todo = np.ones(size, bool)
        comp = self.e["comp"]
        for _ in range(size):
            v = int(np.argmin(np.where(todo, best, np.inf)))
            if not (todo[v] and best[v] < np.inf):
                v = int(np.argmax(todo))
            elif best[v] >= 0:
                out.append((int(parent[v]), v))
            todo[v] = False
            near = self.bound(v)
            near[comp == comp[v]] = -1
            better = todo & (near < best)
            best[better], parent[better] = near[better], v
        return out

    def between(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The *most* nearest pairs of each two components as (v, u, more), component by component; more: whether others were left.

        Of one component's pairs no more than *most* for each other one are held, and HELD beside them.
        """
        comp = self.e["comp"]
        order = np.argsort(comp, kind="stable")
        cut = np.flatnonzero(np.r_[True, comp[order][1:] != comp[order][:-1], True])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            held, n, dropped = [], 0, np.zeros(0, np.int64)
            for v in order[a:b].tolist():
                near = self.bound(v)
                near[comp <= comp[v]] = np.inf
                u = np.flatnonzero(near < np.inf)
                if len(u):
                    held.append((comp[u], near[u], np.full(len(u), v), u))
                    n += len(u)
                if n > HELD:
                    best, gone = self._nearest(held, most)
                    held, n, dropped = [best], 0, np.union1d(dropped, gone)
            if held:
                (to, _, v, u), gone = self._nearest(held, most)
                yield v, u, np.isin(to, np.union1d(dropped, gone))

    @staticmethod
    def _nearest(held: list, most: int) -> tuple[tuple, np.ndarray]:
        """The *most* nearest of each component, and the components of which some were dropped."""
        to, near, v, u = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((u, v, near, to))
        head = np.flatnonzero(np.r_[True, to[order][1:] != to[order][:-1]])
        place = np.arange(len(order)) - np.repeat(head, np.diff(np.r_[head, len(order)]))
        use = order[place < most]
        return (to[use], near[use], v[use], u[use]), np.unique(to[order[place >= most]])


@X.freed
def _pairs(batches: Iterator[pa.RecordBatch], num: int, den: int, most: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each list of the partition; most: 0 for a spanning forest."""
    table = list(batches)
    if not sum(b.num_rows for b in table):
        return
    table = pa.Table.from_batches(table)
    t, block = table.column("token").to_numpy(), table.column("block").to_numpy()
    order = np.lexsort((block, t))
    t, block = t[order], block[order]
    data = table.column("data").take(pa.array(order)).to_pylist()
    e = np.frombuffer(b"".join(data), _ENTRY)
    rows = np.array([len(x) for x in data]) // _ENTRY.itemsize
    t, block = np.repeat(t, rows), np.repeat(block, rows)
    head = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (block[1:] != block[:-1])])
    size = np.diff(np.r_[head, len(t)])
    schema = "a long, b long, token long, more boolean"

    def table_of(v: np.ndarray, u: np.ndarray, more: np.ndarray | bool) -> list[pa.RecordBatch]:
        x, y = e["id"][v], e["id"][u]
        return _arrow(schema, [np.maximum(x, y), np.minimum(x, y), t[v], np.broadcast_to(more, len(v))]).to_batches()

    for n in range(2, SHORT + 1):
        lists = head[size == n]
        i, j = np.triu_indices(n, 1)
        for at in range(0, len(lists), 4096):
            v, u = ((lists[at : at + 4096, None] + k).ravel() for k in (i, j))
            near = (_bound(e[v], e[u], num, den) < np.inf) & (e["comp"][v] != e["comp"][u])
            yield from table_of(v[near], u[near], False)
    for a, n in zip(head[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
        one = _List(e[a : a + n], num, den)
        if most:
            for v, u, more in one.between(most):
                yield from table_of(v + a, u + a, more)
        elif pairs := one.forest():
            v, u = np.array(pairs).T
            yield from table_of(v + a, u + a, True)


@X.freed
def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in _few(batches, ROWS):
        a, b, an, bn, x, y = (batch.column(i).to_pylist() for i in range(6))
        ok = []
        for i in range(len(a)):
            both = len(np.intersect1d(np.frombuffer(x[i], "<u8"), np.frombuffer(y[i], "<u8"), assume_unique=True))
            ok.append(den * both >= num * (an[i] + bn[i] - both))
        yield from _arrow("a long, b long, ok boolean", [a, b, ok]).to_batches()


def _candidates(docs: DataFrame, num: int, den: int, most: int, tokens: DataFrame | None) -> DataFrame:
    spark = docs.sparkSession
    lists = docs.mapInArrow(partial(_entries, num=num, den=den), "token long, size int, data binary")
    if tokens is not None:
        lists = lists.join(tokens, "token", "left_semi")
    long = lists.groupBy("token").agg(F.sum("size").alias("total")).where(F.col("total") > BLOCK)
    blocks = F.ceil(F.coalesce("total", F.lit(1)) / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("data"), F.col("blocks")).cast("int")
    lists = lists.join(long, "token", "left").withColumn("blocks", blocks).withColumn("own", own)
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("own")).cast("long") * F.lit(1 << 31) + F.greatest(o, F.col("own")))
    lists = lists.select("token", F.explode(pair).alias("block"), "data")
    return lists.repartition(partitions(spark), "token", "block").mapInArrow(partial(_pairs, num=num, den=den, most=most), "a long, b long, token long, more boolean")


def jaccard_components(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of *documents* (doc_id, text).

    Two documents link when den * |intersection| >= num * |union| of their sets of distinct k-word shingles
    (words are runs without ASCII white space; A-Z are lower-cased; a shorter text is one shingle).
    component_id is the least doc_id that links lead to. Null or empty texts have no
    shingles and their own doc_id; rows without doc_id are left out; rows that
    share a doc_id are one node, and each gives a row; other columns are ignored; an empty table gives an empty one.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "jaccard")
    own = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ranges follow the text: a group of shingles is about that of RANGE_BYTES, up to 128 GB of text
    ranges = min(65536, (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES + 1)
    dealt = own.mapInArrow(partial(_deal, k=k, ranges=ranges), _DEALT)
    counted = dealt.groupBy("key").applyInArrow(lambda table: _frequencies(table), _DEALT)

    def prefixes(table: pa.Table) -> pa.Table:
        return _prefixes(table, num, den)

    docs = scratch.save(counted.groupBy("slice").applyInArrow(prefixes, _DOC), "docs")
    # documents whose shingles are all shared and equal are one: only the least of them goes on, the others link to it
    every = docs.where("tokens is not null").select("doc_id", "n", "s", "tokens", F.when(F.col("s") == 0, F.sha2("tokens", 256)).alias("digest"))
    groups = every.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).where("c > 1").select("digest", "least")
    copies = scratch.save(every.select("doc_id", "digest").join(groups, "digest").where("doc_id > least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")), "copies")
    tok = scratch.save(every.drop("digest").join(copies.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_anti"), "tokens")
    links, most, tokens, comp = [copies], 0, None, None
    while True:
        with_comp = tok.withColumn("comp", F.col("doc_id")) if comp is None else tok.join(comp, tok.doc_id == comp.node, "left").select(tok["*"], F.coalesce("component", "doc_id").alias("comp"))
        found = scratch.save(_candidates(with_comp, num, den, most, tokens), "found")
        a = tok.select(F.col("doc_id").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("at"))
        b = tok.select(F.col("doc_id").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("bt"))
        pairs = found.select("a", "b").distinct().join(a, "a").join(b, "b").select("a", "b", "an", "bn", "at", "bt")
        judged = scratch.save(pairs.mapInArrow(partial(_verify, num=num, den=den), "a long, b long, ok boolean"), "judged")
        good = judged.where("ok").select("a", "b")
        if comp is None or not good.isEmpty():
            links.append(good)
            comp = components(reduce(DataFrame.union, links), scratch)
        tokens = scratch.save(found.where("more").join(judged.where("not ok"), ["a", "b"]).select("token").distinct(), "again")
        scratch.drop(found)
        if tokens.isEmpty():
            break
        most = max(64, most * 64)
    node = docs.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("node"))
    return node.join(comp, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
