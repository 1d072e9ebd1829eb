"""Paged sources in batch and as a stream that goes on from its checkpoint."""

from __future__ import annotations

import json

import pytest

from ledgerlight.sources import paged


def put(folder, page, n):
    (folder / f"{page}.json").write_text(json.dumps([{"id": f"{page}-{i}", "size": i, "none": None} for i in range(n)]))


def source(reader, folder, **options):
    return reader.format("paged").options(fetch="tests.recorded_pages:fetch", columns="id, size, gone", folder=str(folder), **options)


def test_pages_are_read_in_parallel(spark, tmp_path):
    paged.register(spark)
    for page in range(1, 21):
        put(tmp_path, page, page % 4)
    df = source(spark.read, tmp_path).load()
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    assert sorted((r.page, r.place, r.id, r["size"], r.gone) for r in rows) == sorted((p, i, f"{p}-{i}", str(i), None) for p in range(1, 21) for i in range(p % 4))


def test_a_paid_source_is_refused(spark, tmp_path):
    paged.register(spark)
    with pytest.raises(Exception, match="source_refused: tier paid"):
        source(spark.read, tmp_path, tier="paid").load()


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    paged.register(spark)
    pages, out = tmp_path / "pages", tmp_path / "out"
    pages.mkdir()

    def come():
        stream = source(spark.readStream, pages).load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").option("path", str(out)).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(out)).collect())

    put(pages, 1, 2)
    put(pages, 2, 1)
    assert come() == ["1-0", "1-1", "2-0"]
    (pages / "1.json").write_text(json.dumps([{"id": "again"}]))  # a page that has been read isn't read again
    put(pages, 3, 1)
    assert come() == ["1-0", "1-1", "2-0", "3-0"]
