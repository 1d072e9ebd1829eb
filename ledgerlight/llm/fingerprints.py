"""Operator 13: document fingerprints by consistent weighted sampling, in DataFrame functions only.

Ioffe, "Improved Consistent Sampling, Weighted Minhash and L1 Sketching" (2010). A text is its terms with their counts as weights.
For each of SAMPLES samples every term draws r and c from Gamma(2, 1) and b from (0, 1), all from a hash of the term and the
sample's number (16 bits for each uniform of r and c); its level is t = floor(ln(w) / r + b) and its value a = c / exp(r (t - b + 1)).
The pair (term, t) of the smallest value is the sample. Two texts agree in a sample with the chance sum of min(w, w') / sum of
max(w, w'). A value follows from term and level alone, so equal values stand for equal samples.

The values of a term of weight w are exponential with rate w, so the smallest of a text of n words lies above REACH / n with the
chance exp(-REACH). exp(-r) c is a lower bound of w a that needs no logarithm, since exp(-r) is a product of two uniforms and
c >= 1 - (a product of two uniforms): values that lie above REACH / n by that bound aren't worked out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, partitions

SAMPLES = 64
#: Samples are worked out in groups of so many; SAMPLES is a multiple.
GROUP = 16
#: exp(-REACH), the chance that a sample stays open ("0000", which agrees with another open one): 6e-6.
REACH = 12
#: Separators of terms: ASCII other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_DIGITS = 4


def _sample(k: int, side: int) -> Column:
    """The logarithm of the smallest value in sample k."""
    u = [f"((shiftrightunsigned(z{k}, {16 * i}) & 65535) + 0.5D)" for i in range(4)]
    r = f"(-ln({u[0]} * {u[1]} / 4294967296D))"
    b = f"((xxhash64(z{k}) & 4294967295) / 4294967296D)"
    value = f"ln(-ln({u[2]} * {u[3]} / 4294967296D)) - {r} * (floor(ln_w{side} / {r} + {b}) - {b} + 1)"
    return F.expr(f"min(case when {u[0]} * {u[1]} * (4294967296D - {u[2]} * {u[3]}) <= most{side} then {value} end)").alias(f"s{k}_{side}")


def signatures(counts: DataFrame, key: list[str], sides: int, samples: int = SAMPLES) -> DataFrame:
    """(*key, f0, f1, ...): a fingerprint for each side of (*key, h, w0, n0, w1, n1, ...).

    h is a term's 64-bit hash, w its weight on that side (0: absent) and n about the sum of these weights. Four hexadecimal digits
    stand for each sample; a side without terms has an empty fingerprint. Where counts are dealt by columns of the key, nothing
    is shuffled.
    """
    groups, size = samples // GROUP, GROUP  # expressions for the samples of one group only; a row for each group
    rows = counts.withColumn("g", F.explode(F.array(*map(F.lit, range(groups))))).withColumn("hg", F.xxhash64("h", "g"))
    draws = [F.expr(f"xxhash64(hg ^ {(0x9E3779B97F4A7C15 * (k + 1)) % (1 << 63)}L)").alias(f"z{k}") for k in range(size)]
    # a term of weight 0 passes no test, since no product is 0
    levels = [x for s in range(sides) for x in (F.expr(f"ln(w{s})").alias(f"ln_w{s}"), F.expr(f"w{s} / n{s} * {REACH}D * 18446744073709551616D").alias(f"most{s}"), F.col(f"w{s}"))]
    least = rows.select(*key, "g", *levels, *draws).groupBy(*key, "g").agg(*[F.max(f"w{s}").alias(f"w{s}") for s in range(sides)], *[_sample(k, s) for s in range(sides) for k in range(size)])
    digits = lambda s: F.concat(*[F.lpad(F.hex(F.expr(f"coalesce(cast(s{k}_{s} * 4294967296D as bigint) & 65535, 0)")), _DIGITS, "0") for k in range(size)])
    parts = least.select(*key, "g", *[F.when(F.col(f"w{s}") > 0, F.lower(digits(s))).otherwise("").alias(f"f{s}") for s in range(sides)])
    one = lambda s: F.concat(*[F.max(F.when(F.col("g") == g, F.col(f"f{s}"))) for g in range(groups)])
    return parts.groupBy(*key).agg(*[one(s).alias(f"f{s}") for s in range(sides)])


def fingerprints(texts: DataFrame, key: list[str], samples: int = SAMPLES) -> DataFrame:
    """(*key, fingerprint) of every row of (*key, text); equal texts have equal fingerprints.

    key is unique and not null. Terms are runs of letters and digits (everything beyond ASCII counts as letters), weighted by their
    counts. A text without terms (null, empty, signs only) has an empty fingerprint.
    """
    rows = texts.select(*key, F.split(F.coalesce("text", F.lit("")), BETWEEN).alias("terms"))
    rows = rows.select(*key, F.size("terms").alias("n0"), F.explode("terms").alias("term"))
    counts = rows.groupBy(*key, "n0", F.xxhash64("term").alias("h")).agg(F.sum((F.col("term") != "").cast("double")).alias("w0"))
    return signatures(counts, key, 1, samples).withColumnRenamed("f0", "fingerprint")


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of the samples in which two fingerprints agree; two empty ones are alike, an empty and another one aren't."""
    same = [(F.substring(a, _DIGITS * k + 1, _DIGITS) == F.substring(b, _DIGITS * k + 1, _DIGITS)).cast("int") for k in range(samples)]
    some = sum(same[1:], same[0]) / F.lit(float(samples))
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(some)


def neighbours(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, digest, n_chars, copies, and prev_id, prev_digest, prev_n: the document before in the order of doc_id and digest,
    for the first the last one). Rows of one doc_id and text are one document, copies of them.

    Only ids and digests are put in order: dealt into ranges, in order within each; the last of a range comes by a table of the ranges.
    """
    slim = documents.groupBy("doc_id", "digest").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    ranges = slim.repartitionByRange(partitions(documents.sparkSession), "doc_id", "digest").withColumn("part", F.spark_partition_id())
    ranges = scratch.save(ranges, "ranges")
    one = F.struct("doc_id", "digest", "n_chars")
    last = ranges.groupBy("part").agg(F.max(one).alias("last"))  # a row for each range
    order = Window.orderBy("part")
    before = last.select("part", F.coalesce(F.lag("last").over(order), F.max("last").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    prev = F.coalesce(F.lag(one).over(Window.partitionBy("part").orderBy("doc_id", "digest")), F.col("before"))
    rows = ranges.join(F.broadcast(before), "part").withColumn("p", prev)
    return rows.select("doc_id", "digest", "n_chars", "copies", F.col("p.doc_id").alias("prev_id"), F.col("p.digest").alias("prev_digest"), F.col("p.n_chars").alias("prev_n"))


def edited_fingerprints(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of (doc_id, text).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next document's; near_edited
    and near_next are the likeness of the fingerprint to the edited text's and to the next document's. Order is doc_id, then a
    64-bit hash of the text; after the last document comes the first (a single one follows itself). Null texts are empty. Repeated rows
    get a row each, with the same result, and aren't next to themselves; rows without doc_id are left out; other columns are ignored;
    an empty table gives no rows.
    """
    scratch, n = Scratch(documents.sparkSession, "fingerprints"), partitions(documents.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = documents.where("doc_id is not null").select("doc_id", text.alias("text"), F.xxhash64(text).alias("digest"))
    order = scratch.save(neighbours(rows.select("doc_id", "digest", F.length("text").cast("long").alias("n_chars")), scratch), "neighbours")
    texts = rows.groupBy("doc_id", "digest").agg(F.first("text").alias("text")).join(order, ["doc_id", "digest"])
    heads = texts.select(F.col("prev_id").alias("doc_id"), F.col("prev_digest").alias("digest"), F.expr("left(text, cast(floor(prev_n / 2) as int))").alias("head"))
    kept = F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))")
    own = texts.join(heads, ["doc_id", "digest"]).select("doc_id", "digest", kept.alias("kept"), F.expr("right(text, cast(floor(n_chars / 2) as int))").alias("rest"), "head")
    shas = own.select("doc_id", "digest", F.sha2(F.concat("kept", "head"), 256).alias("edited_sha256"))
    # terms of the kept half but its last, which goes on in what follows, count for both texts
    first = own.withColumn("first", F.split("kept", BETWEEN)).withColumn("cut", F.element_at("first", -1))
    after = lambda c: F.split(F.concat("cut", c), BETWEEN)
    parts = first.select("doc_id", "digest", F.expr("slice(first, 1, size(first) - 1)").alias("p0"), after("rest").alias("p1"), after("head").alias("p2"))
    part = lambda i: F.struct(F.lit(i).alias("part"), F.col(f"p{i}").alias("terms"))
    rows = parts.select("doc_id", "digest", *[(F.size("p0") + F.size(f"p{s + 1}")).alias(f"n{s}") for s in (0, 1)], F.explode(F.array(part(0), part(1), part(2))).alias("p"))
    rows = rows.select("doc_id", "digest", "n0", "n1", "p.part", F.explode("p.terms").alias("term"))
    weight = lambda other: F.sum(((F.col("term") != "") & (F.col("part") != other)).cast("double"))
    counts = rows.groupBy("doc_id", "digest", "n0", "n1", F.xxhash64("term").alias("h")).agg(weight(2).alias("w0"), weight(1).alias("w1"))
    signed = signatures(counts, ["doc_id", "digest"], 2, samples).withColumnsRenamed({"f0": "fingerprint", "f1": "edited_fingerprint"})
    mine = signed.join(shas, ["doc_id", "digest"]).join(order, ["doc_id", "digest"])
    # each row goes to its own document and, as the next one, to the document before
    to = F.explode(F.array(F.struct("doc_id", "digest", F.lit(True).alias("own")), F.struct(F.col("prev_id").alias("doc_id"), F.col("prev_digest").alias("digest"), F.lit(False).alias("own"))))
    sent = mine.withColumn("to", to).select("to.*", "n_chars", "copies", "edited_sha256", "fingerprint", "edited_fingerprint")
    own_value = lambda c: F.max(F.when(F.col("own"), F.col(c))).alias(c)
    out = sent.groupBy("doc_id", "digest").agg(*[own_value(c) for c in ("n_chars", "copies", "edited_sha256", "fingerprint", "edited_fingerprint")], F.max(F.when(~F.col("own"), F.col("fingerprint"))).alias("next"))
    out = out.withColumns({"near_edited": likeness("fingerprint", "edited_fingerprint", samples), "near_next": likeness("fingerprint", "next", samples)})
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
