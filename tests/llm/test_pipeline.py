"""Each stage against a plain version on its own input."""

from __future__ import annotations

import brute
import corpus_pipeline as pipeline
from test_decontaminate import every

from ledgerlight.llm.queries import tokenizer_path

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import sentencepiece

    docs, seen = spark.read.parquet(f"{DIR}/documents.parquet"), {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(f"file://{tmp_path}/{i}")
        before, docs = {r.doc_id: r.text for r in docs.collect()}, spark.read.parquet(f"file://{tmp_path}/{i}")
        assert i == 4 or docs.columns == pipeline.COLUMNS
        seen[name] = before, docs
    before, after = seen["quality classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    good = [d for d, q in labels.items() if q == 1 and d in before]
    assert kept < set(before)
    assert sum(d in kept for d in good) >= 0.9 * len(good)
    before, after = seen["n-gram Jaccard join"]
    assert {r.doc_id for r in after.collect()} == {d for d, (_, c) in brute.jaccard(list(before.items()), 5, 80, 100).items() if c == d}
    before, after = seen["substring dedup"]
    want = {d: (kept if gone else before[d]) for d, (n, gone, _, kept) in brute.substring(list(before.items())).items() if gone < n or not n}
    assert {r.doc_id: r.text for r in after.collect()} == want
    before, after = seen["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    gone = before.keys() - {r.doc_id for r in after.collect()}
    suspects = [(d, t) for d, t in before.items() if d in gone]
    assert {d for d, _ in every(suspects, items)} == gone
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    before, after = seen["SentencePiece encoding"]
    assert {r.doc_id: list(r.ids) for r in after.collect()} == {d: model.encode(t or "") for d, t in before.items()}
