from __future__ import annotations

import zlib

import numpy as np
import pytest

from ledgerlight.llm.pieces import Pieces, encode_documents
from ledgerlight.llm.queries import tokenizer_path
from ledgerlight.llm.units import Units

TEXTS = [None, "", " ", "  two  spaces ", "Grüße, 世界! 😀\n\n\tx", "a" * 3000, "don't stop — 3.14159", "\r\n", "x\u2581y", "word " * 5000, "日本語" * 200, "\x00\x07"]


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_ids_of_the_model(spark, model):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids string"), tokenizer_path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(TEXTS):
        ids = model.encode(t or "")
        assert list(got[i].ids) == ids, t[:30]
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert got[i].round_trip == ("\u2581" not in (t or ""))


def test_whole_table(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: model.encode(r.text or "") for r in docs.collect()}
    got = encode_documents(docs, tokenizer_path("piece_bpe_32k.model")).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want
    assert all(r.round_trip for r in got)
    assert encode_documents(docs.limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_viterbi_against_all_cuts():
    pieces = ["<unk>", "\u2581", "a", "b", "ab", "ba", "\u2581a", "aba", "bab"]
    scores = [0.0, -2.5, -2.0, -2.2, -2.9, -3.1, -3.0, -4.05, -4.4]
    own = Pieces(pieces, scores, ["x"] + ["n"] * 8, bpe=False)
    score = dict(zip(pieces, scores, strict=True))

    def best(t):
        if not t:
            return 0.0
        return max((score[t[:i]] + best(t[i:]) for i in range(1, len(t) + 1) if t[:i] in score), default=-np.inf)

    for t in ["a", "abab", "babab", "abaabab", "bbbaab"]:
        ids, off = own.encode([t], Units())
        assert "".join(pieces[i] for i in ids) == "\u2581" + t
        assert sum(scores[i] for i in ids) == pytest.approx(best("\u2581" + t))
        assert own.decode(ids, off) == [t.encode()]


def merged(text, score):
    """The model's definition: merge the best-scored pair, leftmost first, until none is left."""
    parts = list(text)
    while True:
        can = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score]
        if not can:
            return parts
        i = min(can)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_paths_of_bpe_against_merging():
    """Random vocabularies over three letters; each piece joins two neighbours of a merged random text."""
    rng = np.random.default_rng(9)
    letters = ["a", "b", "c"]
    draw = lambda most: "".join(rng.choice(letters, rng.integers(2, most)).tolist())
    for _ in range(25):
        score = dict.fromkeys(letters, -99)
        for i in range(25):
            parts = merged(draw(12), score)
            if len(parts) > 1:
                at = rng.integers(len(parts) - 1)
                score[parts[at] + parts[at + 1]] = -i
        pieces = list(score)
        own = Pieces(pieces, [float(score[p]) for p in pieces], ["n"] * len(pieces), bpe=True)
        texts = [draw(16) for _ in range(150)]
        sizes, ids = own.units(texts)
        assert [[pieces[i] for i in x] for x in np.split(ids, np.cumsum(sizes)[:-1])] == [merged(t, score) for t in texts]


def test_vocabularies_that_merging_cannot_make_are_refused():
    with pytest.raises(ValueError, match="not a BPE vocabulary"):
        Pieces(["a", "b", "aab"], [-9.0, -9.0, -1.0], ["n"] * 3, bpe=True)


def test_models_that_change_texts_are_refused(tmp_path):
    """The normaliser and the kind of model come from the model's file."""
    import public_tokenizers
    from sentencepiece import sentencepiece_model_pb2 as pb

    def changed(change):
        model = pb.ModelProto()
        with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
            model.ParseFromString(f.read())
        change(model)
        path = tmp_path / "changed.model"
        path.write_bytes(model.SerializeToString())
        return str(path)

    def blanks(m):
        m.normalizer_spec.remove_extra_whitespaces = True

    def chars(m):
        m.trainer_spec.model_type = 4

    def charsmap(m):
        m.normalizer_spec.precompiled_charsmap = b"x"

    for change, why in ((blanks, "remove_extra_whitespaces"), (chars, "model type 4"), (charsmap, "precompiled_charsmap")):
        with pytest.raises(ValueError, match=why):
            Pieces.load(changed(change))
