"""Operator 10: chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A conversation that was logged again and again while it grew stands in the table as many prefixes of its last
state. Every turn gets the rolling hash of the turns up to it: the exclusive or of hashes of (place, role, text), twice with
other seeds (128 bits). A conversation whose last hash is an inner hash of another one is a
prefix of that: an anti-join keeps the others. Of equal conversations the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chat_texts(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logs, text) of the maximal conversations of (conv_id, turn, role, text).

    text is each turn as <|im_start|>role, new line, text, <|im_end|>, new line; n_logs counts the equal conversations.
    Turns go by turn, role, text, nulls first; null roles and texts count as empty; repeated rows are turns
    of their own; rows without conv_id are left out; other columns are ignored; an empty table gives no rows.
    """
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    places = rows.withColumn("at", F.row_number().over(one))
    rolling = one.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = [F.bit_xor(F.xxhash64(F.lit(seed), "at", "role", "text")).over(rolling).alias(f"h{seed}") for seed in (1, 2)]
    last = F.lead("at").over(one).isNull().alias("last")
    keys = places.select("conv_id", "at", *hashed, last)
    whole = keys.where("last").groupBy("at", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logs"))
    inner = keys.where("not last").select("at", "h1", "h2").distinct()
    kept = whole.join(inner, ["at", "h1", "h2"], "left_anti").select("conv_id", F.col("at").cast("long").alias("n_turns"), "n_logs")
    turn = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    texts = places.select("conv_id", F.struct("at", turn.alias("turn")).alias("t")).join(kept.select("conv_id"), "conv_id", "left_semi")
    texts = texts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["turn"]), "").alias("text"))
    return kept.join(texts, "conv_id").select("conv_id", "n_turns", "n_logs", "text")
