"""Operator 3: substring dedup with a log-structured index of window fingerprints.

1. Documents are put in doc_id order and packed in slices (compressed Arrow), once; all later
   passes read the packs where they lie.
2. Anchors. The least 8-word fingerprint inside a window is the window's anchor; equal windows have
   equal anchors. Windows whose anchor stands only once in all documents cannot repeat and are not indexed.
3. The other windows enter the index in batches of ascending doc_id. The index is a sorted immutable run for
   each range of fingerprints (a bucketed table). A batch is merge-joined
   with the runs: the first holder of a fingerprint keeps it, every later one is a
   repeat. A match is verified on a second, independent fingerprint (96 bits in all). The merged run is the
   compacted index for the next batch; the old run is not read again.
   With a stored index (index=path) later calls go on from earlier ones: every window enters it, as one that stands once may
   be repeated later. A call adds one run of what is new; when there are FAN runs they are compacted into one.
4. Each slice marks the windows that repeat an earlier one and drops the words they cover.

A window that stands many times in a slice travels once, so a passage that a third of all
documents share costs one entry for each slice.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from functools import partial, reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import text as X
from .scratch import Scratch, partitions

GRAM, FAN = 8, 4
RANGE_BYTES = 256 << 10
_DEALT = "kind int, key int, slice long, data binary"
_ROWS = {"kind": pa.int32(), "key": pa.int32(), "slice": pa.int64(), "data": pa.binary()}


def _rows(rows: list) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table([pa.array(c, k) for c, k in zip(cols, _ROWS.values(), strict=True)], names=list(_ROWS))


@X.freed
def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for seq, batch in enumerate(X.slices(batches)):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(batch)
        _, off = X.text_arrays(_column(batch, "text"))
        yield from _rows([(0, int(off[-1]), (part << 32) | seq, sink.getvalue().to_pybytes())]).to_batches()


def _unpack(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A slice in pieces of whole rows: no window goes over the end of a row."""
    return X.slices([batch], limit=X.PIECE_BYTES)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _windows(batch: pa.RecordBatch, size: int) -> tuple[X.Words, np.ndarray, np.ndarray]:
    """Words, window starts and window fingerprints of a slice."""
    buf, off = X.text_arrays(_column(batch, "text"))
    w = X.words(buf, off)
    at = w.inside(size)
    return w, at, X.rolling(w.h, size)[at] if len(at) else np.zeros(0, np.uint64)


def _anchors(w: X.Words, at: np.ndarray, size: int) -> np.ndarray:
    """The least GRAM-word fingerprint in each window."""
    low, done, span = X.rolling(w.h, GRAM), 1, size - GRAM + 1
    while done < span:
        step = min(done, span - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    return low[at]


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    return (((h >> np.uint64(48)) * np.uint64(ranges)) >> np.uint64(16)).astype(np.int64)


def _split(this: int, keys: np.ndarray, ranges: int, *more: np.ndarray) -> list:
    """Rows of sorted fingerprints by range."""
    cut = np.searchsorted(_range(keys, ranges), np.arange(ranges + 1))
    return [(0, r, this, pickle.dumps((keys[a:b], *(m[a:b] for m in more)), 5)) for r, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]


def _places(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The anchors of a piece: one may serve neighbouring windows of one place; elsewhere it counts again."""
    w, at, _ = _windows(batch, size)
    low = _anchors(w, at, size)
    return low[np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)])] if len(low) else low


@X.freed
def _deal_anchors(batches: Iterator[pa.RecordBatch], size: int, ranges: int) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for this, raw in zip(_column(rows, "slice").to_pylist(), _column(rows, "data"), strict=True):
            keys, count = np.unique(np.concatenate([_places(p, size) for p in _pieces(_unpack(raw.as_buffer()))]), return_counts=True)
            yield from _rows(_split(this, keys, ranges, np.minimum(count, 2).astype(np.uint8))).to_batches()


@X.freed
def _repeated(table: pa.Table) -> pa.Table:
    """To each slice its anchors that stand at two places or more."""
    where = table.column("slice").to_pylist()
    got = [pickle.loads(x) for x in table.column("data").to_pylist()]
    keys, of = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
    twice = np.bincount(of, weights=np.concatenate([c for _, c in got]), minlength=len(keys)) > 1
    hit, at, rows = twice[of], 0, []
    for this, (k, _) in zip(where, got, strict=True):
        own = k[hit[at : at + len(k)]]
        at += len(k)
        if len(own):
            rows.append((0, 0, this, own.tobytes()))
    return _rows(rows)


def _isin(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def _keys(table: pa.Table) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(table.column("data").to_pylist()), "<u8")) if table.num_rows else np.zeros(0, np.uint64)


def _check(w: X.Words, at: np.ndarray, size: int) -> np.ndarray:
    """A second fingerprint of the windows, independent of the first."""
    return (X.rolling(X.mix(w.h * np.uint64(0xA24BAED4963EE407) + np.uint64(0x9FB21C651E98DF25)), size)[at] >> np.uint64(32)).astype(np.uint32)


def _own(batch: pa.RecordBatch, size: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: starts of its windows (of those whose anchor is known, where anchors are given), their fingerprints and second ones, and the words of each row."""
    got, n = [], 0
    for piece in _pieces(batch):
        w, at, h = _windows(piece, size)
        if len(at) and known is not None:
            use = _isin(known, _anchors(w, at, size))
            at, h = at[use], h[use]
        got.append((at + n, h, _check(w, at, size) if len(at) else np.zeros(0, np.uint32), w.counts))
        n += len(w.h)
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


@X.freed
def _deal_windows(packs: pa.Table, anchors: pa.Table, size: int, ranges: int) -> pa.Table:
    rows, known = [], _keys(anchors)
    for this, raw in zip(packs.column("slice").to_pylist(), packs.column("data").to_pylist(), strict=True):
        _, h, check, _ = _own(_unpack(raw), size, known)
        h, first = np.unique(h, return_index=True)
        rows += _split(this, h, ranges, check[first])
    return _rows(rows)


@X.freed
def _merge(run: pa.Table, batch: pa.Table) -> pa.Table:
    """Merge-join of one range: repeats to their slices, and the merged run."""
    old = [pickle.loads(x) for x in run.column("data").to_pylist()]
    rows = sorted(zip(batch.column("slice").to_pylist(), batch.column("key").to_pylist(), batch.column("data").to_pylist(), strict=True), key=lambda x: x[0])
    new = [pickle.loads(x[2]) for x in rows]
    key = np.concatenate([k for k, _ in old + new])
    check = np.concatenate([c for _, c in old + new])
    order = np.lexsort((check, key))  # stable: of equal fingerprints the earliest stands first
    k, c = key[order], check[order]
    later = np.zeros(len(key), bool)
    later[order[1:]] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    head = ~later[order]
    where = (rows[0][1] if rows else run.column("key")[0].as_py())
    out, at = [(1, where, 0, pickle.dumps((k[head], c[head]), 5))], sum(len(x) for x, _ in old)
    for (this, r, _), (own, _) in zip(rows, new, strict=True):
        lost = own[later[at : at + len(own)]]
        at += len(own)
        if len(lost):
            out.append((0, r, this, lost.tobytes()))
    return _rows(out)


@X.freed
def _deal_all(batches: Iterator[pa.RecordBatch], size: int, ranges: int) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for this, raw in zip(_column(rows, "slice").to_pylist(), _column(rows, "data").to_pylist(), strict=True):
            _, h, check, _ = _own(_unpack(raw), size)
            if len(h):
                h, first = np.unique(h, return_index=True)
                yield from _rows(_split(this, h, ranges, check[first])).to_batches()


def _add(runs: pa.Table, batch: pa.Table) -> pa.Table:
    """_merge() that gives of the merged run only what the runs did not have."""
    out = _merge(runs, batch).to_pylist()
    old = [pickle.loads(x) for x in runs.column("data").to_pylist()]
    k, c = pickle.loads(out[0]["data"])
    if old:
        have = np.rec.fromarrays([np.concatenate([x for x, _ in old]), np.concatenate([x for _, x in old])])
        new = ~np.isin(np.rec.fromarrays([k, c]), have)
        k, c = k[new], c[new]
    rows = [(x["kind"], x["key"], x["slice"], x["data"]) for x in out[1:]]
    return _rows([(1, out[0]["key"], 0, pickle.dumps((k, c), 5)), *rows] if len(k) else rows)


def _compact(runs: pa.Table, ranges: int) -> pa.Table:
    """One sorted run of several, dealt by a new number of ranges."""
    got = [pickle.loads(x) for x in runs.column("data").to_pylist()]
    k, c = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
    order = np.lexsort((c, k))
    return _rows([(1, key, 0, data) for _, key, _, data in _split(0, k[order], ranges, c[order])])


class Index:
    """Runs of window fingerprints in a folder; a manifest for each version names the runs that are alive and their ranges.

    Runs and manifests are never changed, so an older version stays readable, and a call that failed half-way leaves no trace.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        top = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        there = [x.getPath() for x in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(p.getName()) for p in there if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def at(self, version: int | None) -> tuple[int, int, list[str]]:
        """(version, ranges, runs) of a version, else of the last one; 0 is the empty index."""
        version = max(self.versions(), default=0) if version is None else version
        rows = self.spark.read.parquet(f"{self.path}/manifest/{version}").collect() if version else []
        return version, rows[0].ranges if rows else 0, [r.run for r in rows if r.run]

    def runs(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(_DEALT).parquet(*[f"{self.path}/{r}" for r in names]) if names else self.spark.createDataFrame([], _DEALT)

    def write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, ranges: int, runs: list[str]) -> int:
        version = max(self.versions(), default=0) + 1
        self.spark.createDataFrame([(r, ranges) for r in runs or [""]], "run string, ranges int").write.parquet(f"{self.path}/manifest/{version}")
        return version

    def take(self, packs: DataFrame, size: int, ranges: int, version: int | None, scratch: Scratch) -> DataFrame:
        """The repeats of a batch against a version and itself; the batch becomes part of the next version."""
        _, have, runs = self.at(version)
        have = have or ranges
        dealt = packs.mapInArrow(partial(_deal_all, size=size, ranges=have), _DEALT)
        found = scratch.save(self.runs(runs).groupBy("key").cogroup(dealt.groupBy("key")).applyInArrow(_add, _DEALT), "found")
        runs = [*runs, self.write(found.where("kind = 1"))]
        if len(runs) >= FAN:
            all_runs = self.runs(runs)
            have = max(have, min(65536, (all_runs.agg(F.sum(F.length("data"))).first()[0] or 0) // (4 * RANGE_BYTES) + 1))
            runs = [self.write(all_runs.groupBy("key").applyInArrow(lambda own: _compact(own, have), _DEALT))]
        self.commit(have, runs)
        return found.where("kind = 0")


@X.freed
def _cut(packs: pa.Table, lost: pa.Table, size: int, schema: pa.Schema) -> pa.Table:
    known, out = _keys(lost), []
    for raw in packs.column("data").to_pylist():
        batch = _unpack(raw)
        at, h, check, counts = _own(batch, size)
        if len(at):
            order = np.lexsort((check, h))  # stable: of equal windows the earliest stands first
            a, b = h[order], check[order]
            again = np.zeros(len(h), bool)
            again[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            del order, a, b
            gone = at[again | _isin(known, h)]
        else:
            gone = at
        first = np.r_[0, np.cumsum(counts)]
        step = np.zeros(first[-1] + 1, np.int64)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + size, -1)
        keep = np.cumsum(step)[:-1] == 0
        kept, removed = [], []
        texts = _column(batch, "text").to_pylist()
        for i, t in enumerate(texts):
            own = keep[first[i] : first[i + 1]]
            kept.append(b" ".join(compress((t or "").encode().split(), own.tolist())).decode())
            removed.append(int(len(own) - own.sum()))
        cols = [*batch.columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        cols.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept], pa.string()))
        out.append(pa.Table.from_arrays(cols, names=schema.names).cast(schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def substring_dedup(documents: DataFrame, size: int = 20, batches: int = 3, index: str | None = None, version: int | None = None) -> DataFrame:
    """The rows of *documents* (doc_id, text, ...) with n_words, n_removed, kept_text and kept_sha256.

    Each word is removed that is covered by a window of *size* words (runs without ASCII white space) whose words
    also stand at an earlier start: in a document of smaller doc_id, or earlier in the same document. Windows are judged on the
    texts as given. Kept words are joined by one space. Null and empty texts have no words; rows without doc_id are left out;
    rows that share a doc_id are ordered by text; other columns are kept unless they have the name of a result; an empty
    table gives an empty result.

    With *index*, a folder, windows of earlier calls count as earlier too, and these documents become part of it at once. To run a
    batch again after its result was lost, name the *version* from before it.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "substring")
    n = partitions(spark)
    new = ["n_words", "n_removed", "kept_text", "kept_sha256"]
    own = documents.where("doc_id is not null").drop(*new)
    schema = own.limit(0).toArrow().schema
    for name, kind in zip(new, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True):
        schema = schema.append(pa.field(name, kind))
    ddl = StructType([*own.schema.fields, *(StructField(c, k) for c, k in zip(new, (LongType(), LongType(), StringType(), StringType()), strict=True))])

    tables = []

    def table(df: DataFrame, by: str, name: str) -> DataFrame:
        """A table in the shared folder whose files are dealt by *by*, so that later steps read it without a shuffle."""
        as_name = f"ll_{name}_{uuid.uuid4().hex}"
        df.write.option("path", scratch.path(name)).bucketBy(n, by).format("parquet").saveAsTable(as_name)
        tables.append(as_name)
        out = spark.table(as_name)
        out.as_name = as_name
        return out

    ordered = own.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    packs = table(ordered.mapInArrow(_packs, _DEALT), "slice", "packs")
    # a slice gives a row for each range, so ranges follow the text and not only the partitions
    ranges = min(8 * n, 65536, (packs.agg(F.sum("key")).first()[0] or 0) // RANGE_BYTES + 1)
    if index is None:
        repeated = packs.mapInArrow(partial(_deal_anchors, size=size, ranges=ranges), _DEALT).groupBy("key").applyInArrow(lambda own: _repeated(own), _DEALT)
        repeated = table(repeated, "slice", "anchors")

    def windows(packs: pa.Table, anchors: pa.Table) -> pa.Table:
        return _deal_windows(packs, anchors, size, ranges)

    def cut(packs: pa.Table, lost: pa.Table) -> pa.Table:
        return _cut(packs, lost, size, schema)

    run, lost = None, []
    for i in range(batches if index is None else 0):
        mine = f"(slice >> 32) * {batches} div {n} = {i}"
        dealt = packs.where(mine).groupBy("slice").cogroup(repeated.where(mine).groupBy("slice")).applyInArrow(windows, _DEALT)
        before = run if run is not None else spark.createDataFrame([], _DEALT)
        merged = table(before.where("kind = 1").groupBy("key").cogroup(dealt.groupBy("key")).applyInArrow(lambda run, batch: _merge(run, batch), _DEALT), "key", "run")
        lost.append(merged.where("kind = 0"))
        run = merged
    gone = reduce(DataFrame.union, lost) if index is None else Index(spark, index).take(packs, size, ranges, version, scratch)
    out = packs.groupBy("slice").cogroup(gone.groupBy("slice")).applyInArrow(cut, ddl)
    for name in tables:  # their files stay until the driver ends; the catalog keeps no entry
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out
