"""Operator 4: quality classifier by positive-unlabelled learning (nnPU).

Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator" (2017): a linear
model on byte and layout statistics minimises
    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).
Trusted positives are documents of label 1. The unlabelled sample is web text without
regard to labels. The class prior is estimated from these two alone: a first model scores both, and no more of the web text can
be positive than the least ratio of the shares above a threshold (Scott, "A Rate of Convergence for Mixture Proportion
Estimation", 2015). Both samples are bounded (max_rows and max_unlabelled, those of the least hash of their doc_id); scoring
reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import text as X

MAX_ROWS, MAX_UNLABELLED = 6000, 6000
#: features() makes some ten arrays of eight bytes for each byte of a slice.
SLICE_BYTES = 512 << 10
_KINDS = np.zeros(256, np.int64)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|", b"*#%&$@", b"\"'()-/_+=<>[]{}\\^`~"), start=1):
    _KINDS[list(_set)] = _i
_KINDS[128:] = 11


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Layout statistics of each text: shares of kinds of bytes, of their neighbours, of words and of repeated words."""
    rows = len(off) - 1
    size = np.diff(off).astype(float)
    row = np.repeat(np.arange(rows), np.diff(off))
    kind = _KINDS[buf]
    shares = np.bincount(row * 12 + kind, minlength=rows * 12).reshape(rows, 12) / np.maximum(size, 1)[:, None]
    cross = kind[:-1] * 12 + kind[1:] if len(kind) else kind
    inner = row[:-1] == row[1:] if len(row) else np.zeros(0, bool)
    pairs = np.bincount(row[:-1][inner] * 144 + cross[inner], minlength=rows * 144).reshape(rows, 144) / np.maximum(size, 1)[:, None] if len(row) else np.zeros((rows, 144))
    w = X.words(buf, off)
    n = w.counts.astype(float)
    width = np.bincount(np.repeat(np.arange(rows), w.counts), weights=(w.end - w.start).astype(float), minlength=rows) / np.maximum(n, 1)
    lines = np.bincount(row[buf == 10], minlength=rows) + 1.0
    distinct = np.empty(rows)
    for i in range(rows):
        own = w.h[w.first[i] : w.first[i + 1]]
        distinct[i] = len(np.unique(own)) / len(own) if len(own) else 0
    extra = np.column_stack([np.log1p(size), np.log1p(n), width, n / lines / 50, distinct, distinct * np.log1p(n), size == 0])
    return np.hstack([np.sqrt(shares), np.sqrt(pairs), extra])


@X.freed
def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.slices(batches, limit=SLICE_BYTES):
        x = features(*X.text_arrays(batch.column(batch.schema.get_field_index("text"))))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("label")), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["label", "x"])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05) -> dict:
    """Non-negative PU risk with the logistic loss, full batches, Adam."""
    both = np.vstack([positive, unlabelled])
    mean, std = both.mean(0), both.std(0)
    std[std < 1e-9] = 1
    p, u = ((np.clip((x - mean) / std, -5, 5)) for x in (positive, unlabelled))
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        neg = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_plus, gp_minus, gu_minus = -(1 - sig(zp)) / len(p), sig(zp) / len(p), sig(zu) / len(u)
        if neg >= 0:
            dp, du = prior * (gp_plus - gp_minus), gu_minus
        else:  # the negative part is overfitted: step back along it
            dp, du = prior * gp_minus, -gu_minus
        g = np.append(dp @ p + du @ u + 1e-3 * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return {"mean": mean, "std": std, "w": w, "b": b}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["std"], -5, 5) @ model["w"] + model["b"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of both: the least ratio of the shares from a threshold on.

    Thresholds keep a tenth of the positives at least. Shares are taken at their 95 % bounds, so that chance does not pull the least
    ratio down.
    """
    cut = np.quantile(positive, np.linspace(0.02, 0.9, 45))
    p, u = ((x[None, :] >= cut[:, None]).mean(axis=1) for x in (positive, unlabelled))
    most, least = u + 2 * np.sqrt(u * (1 - u) / len(unlabelled)), p - 2 * np.sqrt(p * (1 - p) / len(positive))
    return float(np.clip((most[least > 0] / least[least > 0]).min(initial=1), 0.05, 0.95))


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(5)) == 0


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_unlabelled: int = MAX_UNLABELLED) -> dict:
    """Fit on rows that are not held out. labels (doc_id, quality): 1 is trusted; other labels are not read.

    Without trusted or without unlabelled texts every score is one half.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
    pick = lambda df, most: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = pick(known.where("label = 1").dropDuplicates(["doc_id"]), max_rows)
    drawn = pick(docs.select("doc_id").distinct(), max_unlabelled)
    want = chosen.select("doc_id", F.lit(1).alias("label")).union(drawn.select("doc_id", F.lit(0).alias("label")))
    rows = docs.join(F.broadcast(want), "doc_id").select("label", "text").mapInArrow(_features_of, "label int, x array<double>").toArrow()
    y = rows.column("label").to_numpy() if rows.num_rows else np.zeros(0)
    if not (y == 1).any() or not (y == 0).any():
        return {"constant": 0.5}
    x = np.array(rows.column("x").to_pylist(), float)
    order = np.lexsort((*x.T[:4], y))  # whichever order the rows came in, the same sums
    x, y = x[order], y[order]
    first = fit(x[y == 1], x[y == 0], 0.5)
    return fit(x[y == 1], x[y == 0], class_prior(scores(first, x[y == 1]), scores(first, x[y == 0])))


def quality_scores(documents: DataFrame, model: dict) -> DataFrame:
    """The rows of *documents* (doc_id, text, ...) with held_out, score and predicted.

    score is 0 to 1, higher where label 1 is likelier; predicted is 1 from 0.3. Null and empty texts are scored as
    texts of no bytes; rows without doc_id are left out; repeated rows are scored alike; other columns are kept unless
    they have the name of a result.
    """
    kept = documents.drop("held_out", "score", "predicted").where("doc_id is not null")
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])

    @X.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, limit=SLICE_BYTES):
            x = features(*X.text_arrays(batch.column(batch.schema.get_field_index("text"))))
            if "constant" in model:
                s = np.full(len(x), model["constant"])
            else:
                s = scores(model, x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, "score"])

    out = kept.mapInArrow(run, schema)
    return out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
