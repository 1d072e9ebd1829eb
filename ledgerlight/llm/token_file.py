"""Operator 6: token ids in binary files with Elias-Fano document boundaries.

A file is a Parquet folder of blobs, so Spark's commit protocol guards it and any store that Spark
reads can hold it. A blob has the concatenated ids of some consecutive documents, in 2 or 4 bytes each, and two Elias-Fano
sequences: doc_ids and boundaries. select(i) finds one boundary without unpacking the others. Blobs of a shard
(a range of doc_id) know how many ids of the shard stand before them; a total for each shard gives global offsets.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as X
from .scratch import Scratch, partitions
from .units import Units

MAGIC, JOINED = b"LLT1", 4000
_BLOB = "shard int, seq int, before long, n_docs long, n_tokens long, data binary"
_BLOCK, _CHUNK = 64, 4096
#: _PLACE[b, r]: the place of the r-th one of byte b.
_PLACE = np.argsort(-((np.arange(256)[:, None] >> np.arange(8)) & 1), axis=1, kind="stable").astype(np.uint8)


class EliasFano:
    """A non-decreasing sequence of integers >= 0 in about 2 + log2(last / n) bits each.

    In memory select() adds one 32-bit rank for each 512 upper bits.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low = n, low_bits, low
        self.high = np.pad(high, (0, -len(high) % _BLOCK)).reshape(-1, _BLOCK)
        self.ranks = np.cumsum(np.r_[0, np.bitwise_count(self.high).sum(axis=1)], dtype=np.uint32)[:-1]

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        return cls.read(cls.pack(values), 0)[0]

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        v = np.asarray(values, np.uint64)
        n = len(v)
        low_bits = max(0, int(v[-1] // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if n and low_bits else np.zeros((n, 0))
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        upper[at] = 1
        low, high = (np.packbits(x, bitorder="little") for x in (bits.astype(np.uint8).ravel(), upper))
        return struct.pack("<QBQQ", n, low_bits, len(low), len(high)) + low.tobytes() + high.tobytes()

    @classmethod
    def read(cls, raw: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", raw, at)
        at += struct.calcsize("<QBQQ")
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a)), at + a + b

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.ranks.nbytes

    def select(self, at: np.ndarray) -> np.ndarray:
        """The values at some places: by rank to the block that holds that one of the upper bits, then to its byte and bit."""
        i = np.asarray(at, np.int64)
        if len(i) > _CHUNK:
            return np.concatenate([self.select(i[a : a + _CHUNK]) for a in range(0, len(i), _CHUNK)])
        if not len(i):
            return i
        block = np.searchsorted(self.ranks, i.astype(np.uint32), side="right") - 1
        rank = i - self.ranks[block]
        own = self.high[block]
        ones = np.cumsum(np.bitwise_count(own), axis=1, dtype=np.int64)
        byte = (ones <= rank[:, None]).sum(axis=1)
        k = np.arange(len(i))
        left = rank - np.where(byte > 0, ones[k, byte - 1], 0)
        value = (block * _BLOCK + byte) * 8 + _PLACE[own[k, byte], left] - i
        for j in range(self.low_bits - 1, -1, -1):
            bit = i * self.low_bits + j
            value = value << 1 | (self.low[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
        return value


def write_blob(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    first = int(doc_ids[0])
    return b"".join([MAGIC, struct.pack("<Bq", width, first), EliasFano.pack(doc_ids - first), EliasFano.pack(np.cumsum(sizes)), ids.astype(f"<u{width}").tobytes()])


def read_blob(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, boundaries with a leading 0, ids)."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token blob")
    width, first = struct.unpack_from("<Bq", raw, 4)
    docs, at = EliasFano.read(raw, 4 + struct.calcsize("<Bq"))
    ends, at = EliasFano.read(raw, at)
    every = np.arange(docs.n)
    return docs.select(every) + first, np.r_[0, ends.select(every)], np.frombuffer(raw, f"<u{width}", -1, at)


#: The normalizer and the split of tokenizers that lower-case and part ASCII letters, digits and other signs.
PARTING = (
    ["NFC", "Replace", "Lowercase"],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)
_bytes = np.arange(256)
_CLASS = np.select([~X.NOT_SPACE | (_bytes > 127), (X.LOWER >= 97) & (X.LOWER <= 122), (_bytes >= 48) & (_bytes <= 57)], [3, 1, 2], 0).astype(np.uint8)


_loaded: dict = {}


def _tokenizer(spec: str) -> tuple:
    """(tokenizer, whether ASCII classes part, units met or None) of this worker process.

    Units are used if the tokenizer drops white space before all else, so that it never looks across it.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if spec not in _loaded:
        _loaded.clear()
        steps = json.loads(spec)
        normal = [x["type"] for x in (steps.get("normalizer") or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (steps.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        parts = normal == PARTING[0] and split[:1] == [PARTING[1]] and steps["model"].get("end_of_word_suffix") is not None
        steps_of = lambda x: x.get("normalizers") or x.get("pretokenizers") or [x]
        first = steps_of(steps.get("pre_tokenizer") or {"type": ""})[0]
        drops = first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or (first["type"] == "Split" and first.get("invert") and first["behavior"] == "Removed" and split[:1] == [PARTING[1]])
        # marks of word starts and cut or padded texts depend on what stands before
        local = {x["type"] for x in steps_of(steps.get("normalizer") or {"type": ""})} <= {"", "NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace", "StripAccents", "BertNormalizer"}
        _loaded[spec] = Tokenizer.from_str(spec), parts, Units() if drops and local and not steps.get("truncation") and not steps.get("padding") else None
    return _loaded[spec]


def _parted(buf: np.ndarray, off: np.ndarray, w: X.Words) -> tuple[np.ndarray, X.Words]:
    """Texts and units of a tokenizer with PARTING: words cut where ASCII letters, digits and other signs meet, in lower case.

    Words with an apostrophe (which joins letters) or '<' (which begins special tokens) stay as they are, as do letters before
    other characters than ASCII, which may compose with them.
    """
    kind = _CLASS[buf]
    plain = kind[1:] < 3
    lower = np.append(plain, True)
    cut = np.append(False, plain & (kind[:-1] < 3) & (kind[1:] != kind[:-1]))
    odd = np.flatnonzero((buf == 39) | (buf == 60))
    odd = np.unique(np.searchsorted(w.start, odd, side="right") - 1)
    n = w.end[odd] - w.start[odd]
    whole = np.repeat(w.start[odd] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    lower[whole] = cut[whole] = False
    end = np.append(cut, False)
    cut[w.start] = end[w.end] = True
    start = np.flatnonzero(cut)
    return np.where(lower, X.LOWER[buf], buf), X.Words(w.h, start, np.flatnonzero(end), np.searchsorted(start, off))


def encode_slice(batch: pa.RecordBatch, loaded: tuple, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids) of the rows (doc_id, text), each with end_id after it.

    For tokenizers that never look across ASCII white space each distinct run of other bytes is encoded once in a process,
    many in one call, parted by spaces; for others each text as a whole.
    """
    tokenizer, parts, met = loaded
    if met is None:
        got = [x.ids for x in tokenizer.encode_batch([x or "" for x in batch.column(1).to_pylist()], add_special_tokens=False)]
        return np.array([len(x) + 1 for x in got], np.int64), np.array([i for x in got for i in (*x, end_id)], np.uint32)
    buf, off = X.text_arrays(batch.column(1))
    w = X.words(buf, off, hashes=False)
    if parts and len(w.start):
        buf, w = _parted(buf, off, w)
    raw = buf.tobytes()

    def encode(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for at in range(0, len(which), JOINED):
            own = [raw[a:b].decode() for a, b in zip(w.start[which[at : at + JOINED]].tolist(), w.end[which[at : at + JOINED]].tolist(), strict=True)]
            got = tokenizer.encode(" ".join(own), add_special_tokens=False)
            begin = np.cumsum([0, *(len(x) + 1 for x in own[:-1])])
            place = np.fromiter((a for a, _ in got.offsets), np.int64, len(got))
            sizes.append(np.bincount(np.searchsorted(begin, place, side="right") - 1, minlength=len(own)))
            out.append(np.array(got.ids, np.uint32))
        return np.concatenate(sizes), np.concatenate(out)

    key = np.column_stack([X.hash_extents(buf, w.start, w.end), X.hash_extents(buf, w.start, w.end, 1)])
    entry, first, pool = met.ids(key, encode)
    n = np.insert(first[entry + 1] - first[entry], w.first[1:], 1)  # the end id after the units of each row
    begin = np.insert(first[entry], w.first[1:], len(pool))
    total = np.r_[0, np.cumsum(n)]
    place = np.repeat(begin - total[:-1], n) + np.arange(total[-1])
    ids = np.where(place < len(pool), pool[np.minimum(place, len(pool) - 1)] if len(pool) else 0, end_id).astype(np.uint32)
    return np.diff(total[np.r_[0, np.cumsum(w.counts + 1)]]), ids


def _encode(batches: Iterator[pa.RecordBatch], spec, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    shard, before, loaded = TaskContext.get().partitionId(), 0, _tokenizer(spec.value)
    for seq, batch in enumerate(X.slices(batches, limit=4 << 20)):
        sizes, ids = encode_slice(batch, loaded, end_id)
        data = write_blob(batch.column(0).to_numpy(), sizes, ids, width)
        row = (shard, seq, before, len(sizes), len(ids), data)
        before += len(ids)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _BLOB.split(", ")])


def write_token_files(documents: DataFrame, tokenizer_file: str, end_id: int, path: str) -> None:
    """Encode *documents* (doc_id, text) and write their ids in ascending doc_id order.

    Null texts count as empty; rows without doc_id are left out; rows that share a doc_id stand in order of their texts;
    other columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = documents.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    width = 2 if max(Tokenizer.from_str(spec).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    own = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = own.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(partial(_encode, spec=spark.sparkContext.broadcast(spec), end_id=end_id, width=width), _BLOB).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            docs, ends, ids = read_blob(raw.as_py())
            flat = ids.astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _picked(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            docs, (ends, ids, first) = _opened(raw.as_py())
            low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), docs.n)
            while (low < high).any():  # all that are wanted by one binary search, a boundary at a time
                mid = np.minimum((low + high) // 2, max(docs.n - 1, 0))
                less = (docs.select(mid) + first < wanted) & (low < high)
                low, high = np.where(less, mid + 1, low), np.where(less | (low >= high), high, mid)
            at, own = low, wanted
            while len(at):  # rows that share a doc_id stand one after another
                here = at < docs.n
                at, own = at[here], own[here]
                same = docs.select(at) + first == own
                at, own = at[same], own[same]
                if len(at):
                    begin = np.where(at > 0, ends.select(np.maximum(at - 1, 0)), 0)
                    rows = [ids[a:b].tolist() for a, b in zip(begin.tolist(), ends.select(at).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "ids"])
                at = at + 1


def _opened(raw: bytes) -> tuple[EliasFano, tuple[EliasFano, np.ndarray, int]]:
    width, first = struct.unpack_from("<Bq", raw, 4)
    docs, at = EliasFano.read(raw, 4 + struct.calcsize("<Bq"))
    ends, at = EliasFano.read(raw, at)
    return docs, (ends, np.frombuffer(raw, f"<u{width}", -1, at), first)


def ids_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents of the files, the end id included: found through select(), without unpacking the others."""
    wanted = np.unique(np.array(doc_ids, np.int64))
    return spark.read.schema(_BLOB).parquet(path).select("data").mapInArrow(partial(_picked, wanted=wanted), "doc_id long, ids array<long>")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the files."""
    files = spark.read.schema(_BLOB).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("own"))
    # one row for each shard, as many as the writer had partitions
    base = shards.select("shard", (F.sum("own").over(Window.orderBy("shard")) - F.col("own")).alias("base"))
    rows = files.select("shard", "before", "data").join(F.broadcast(base), "shard").select((F.col("base") + F.col("before")).alias("first"), "data")
    return rows.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, tokenizer_file: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the files of *documents* and return what read_token_files() gives for them."""
    to = path or Scratch(documents.sparkSession, "tokens").path("ids")
    write_token_files(documents, tokenizer_file, end_id, to)
    return read_token_files(documents.sparkSession, to)
