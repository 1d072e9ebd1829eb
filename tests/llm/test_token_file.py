from __future__ import annotations

import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerlight.llm.queries import tokenizer_path
from ledgerlight.llm.token_file import EliasFano, _tokenizer, encode_slice, read_blob, token_files, write_blob
from ledgerlight.llm.units import Units

TEXTS = [None, "", "Hello  WORLD", "don't 世界 naïve\n\n x\u00a0y\u2003z", "word " * 3000, "<|endoftext|> <|startoftext|>x", "a" * 5000, "\u0130stanbul e\u0301"]


def expected(docs):
    from tokenizers import Tokenizer

    t, out, at = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), {}, 0
    for d, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def result(df):
    return {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in df.collect()}


def test_odd_texts(spark):
    docs = [(10 * i + 5, t or "") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(d, t or None, 1) for d, t in docs], "doc_id long, text string, start int")
    assert result(token_files(df, tokenizer_path("word_bpe_49k.json"), 2)) == expected(docs)
    assert token_files(df.limit(0), tokenizer_path("word_bpe_49k.json"), 2).count() == 0


def test_whole_table_and_the_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    to = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/ids"
    got = result(token_files(docs, tokenizer_path("word_bpe_49k.json"), 2, to))
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])
    for r in spark.read.parquet(to).collect():
        ids, ends, tokens = read_blob(r.data)
        assert len(ids) == r.n_docs
        assert ends[-1] == len(tokens) == r.n_tokens


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [5, 5, 9, 1000, 10**12], list(range(0, 5000, 7)), [3] * 300 + [4]])
def test_select(values):
    raw = EliasFano.pack(np.array(values))
    ef, at = EliasFano.read(raw, 0)
    assert ef.select(np.arange(len(values))).tolist() == values
    assert [int(ef.select(np.array([i]))[0]) for i in range(0, len(values), 7)] == values[::7]
    assert at == len(raw)


def test_boundaries_take_few_bits():
    rng = np.random.default_rng(3)
    ends = np.cumsum(rng.integers(50, 1500, 10_000))
    bits = 2 + np.log2(ends[-1] / len(ends))
    assert len(EliasFano.pack(ends)) * 8 / len(ends) < bits + 1
    # in memory too: no table of 64-bit offsets beside the sequence
    ef = EliasFano.of(ends)
    assert ef.nbytes * 8 / len(ends) < bits + 1.2
    assert ef.ranks.dtype == np.uint32
    assert ef.select(np.arange(len(ends))).tolist() == ends.tolist()
    docs, got, ids = read_blob(write_blob(np.array([-7, 3]), np.array([2, 0]), np.array([9, 8]), 2))
    assert (docs.tolist(), got.tolist(), ids.tolist()) == ([-7, 3], [0, 2, 2], [9, 8])


def test_units_met_before_in_tiny_generations():
    """Generations of three units, so that they change all the time."""
    from tokenizers import Tokenizer

    file = tokenizer_path("word_bpe_49k.json")
    spec = open(file, encoding="utf-8").read()
    plain, parts = Tokenizer.from_file(file), _tokenizer(spec)[1]
    assert parts
    rng = np.random.default_rng(5)
    words = ["the", "The,", "a1b2", "J\u030c", "J\u030cx", "don't", "x's", "<|endoftext|>", "<|ENDOFTEXT|>", "\u00e9t\u00e9.", "E\u0301t", "192.168.0.1", "A" * 70, "\u0301a", "!!", "\u4e16\u754c", "I\u0307s", "a\u2003b", "\u03a3\u03a3."]
    loaded = plain, parts, Units(3)
    for _ in range(40):
        texts = [" ".join(rng.choice(words, rng.integers(0, 9)).tolist()) for _ in range(4)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], names=["doc_id", "text"])
        sizes, ids = encode_slice(batch, loaded, 2)
        want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert sizes.tolist() == [len(x) for x in want], texts
        assert ids.tolist() == [i for x in want for i in x], texts


def test_tokenizers_that_look_across_blanks_encode_whole_texts(spark):
    """A byte-level BPE keeps the blank with the next word; its ids are the library's own."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from ledgerlight.llm.token_file import _tokenizer, ids_of, write_token_files

    file = public_tokenizers.path("byte_bpe_50k.json")
    with open(file, encoding="utf-8") as f:
        assert _tokenizer(f.read())[2] is None
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        assert _tokenizer(f.read())[2] is not None
    texts = {3: "to be  or\nnot to be", 9: " leading and trailing ", 4: "", 12: "na\u00efve \u4e2d\u6587 " * 50, 40: None}
    to = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/ids"
    write_token_files(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), file, 50256, to)
    own = Tokenizer.from_file(file)
    want = {d: [*own.encode(t or "", add_special_tokens=False).ids, 50256] for d, t in texts.items()}
    assert {r.doc_id: r.ids for r in ids_of(spark, to, [*texts, 5, 99]).collect()} == want


def test_single_documents_of_large_files(spark):
    import public_tokenizers

    from ledgerlight.llm.token_file import ids_of, write_token_files

    rng = np.random.default_rng(1)
    docs = [(int(i) * 3 - 500, " ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(0, 40)))) for i in range(900)] + [(100, "same id"), (100, "again the same id")]
    to = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/ids"
    write_token_files(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), public_tokenizers.path("word_bpe_49k.json"), 2, to)
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ask = [-500, -499, 100, 1, 4, 2197, 10**9]
    got = sorted((r.doc_id, r.ids) for r in ids_of(spark, to, ask).collect())
    assert got == sorted((d, [*own.encode(t, add_special_tokens=False).ids, 2]) for d, t in docs if d in ask)
