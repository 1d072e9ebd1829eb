"""Operator 11: the trie of conversation prefixes.

Each turn gets a rolling 128-bit digest of the turns up to it, and each digest its smallest conversation, the node's owner. A conversation
that owns a node owns all that follow on its path, so it owns a chain of nodes from its first owned depth to its end. That depth is
found by binary search for all conversations at once: a probe by 2^k looks only at depths whose lowest set bit is 2^k, so digests
and minima are saved by that bit and each of them is read by one round. The last node on the path that another conversation owns is
the place where the chain hangs on that conversation's chain. Chains are summed up bottom-up over the tree of chains by doubling: a round
adds what hangs 2^k chains below, so a tree of chains of any height takes a logarithm of rounds.

Conversations of any length are numbered and hashed in parts, frequent prefixes are counted before they are shuffled, and joins with the
nodes of frequent prefixes don't send their rows to one task (see skew.py).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, partitions
from .skew import lookup, ranged, running

#: Turns of a conversation that are hashed, and ids of members that are put in order, in one group.
BLOCK = 4096
_xor = lambda a, b: a.bitwiseXOR(b)
_plus = lambda a, b: a + b


def placed_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, at, digest, n_chars) of (conv_id, turn, role, text): place from 1 within its conversation, SHA-256 of role and text,
    code points of the text.

    Turns go by turn, nulls first, then by digest. Null roles and texts are empty; rows without conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    # equal rows may stand in any order, so a number of the row may part them
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.length(text).alias("n_chars"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("turn").asc_nulls_first(), "digest", "row"]
    one = ranged(rows, ["conv_id", *order], scratch)
    return running(one, ["conv_id"], order, {"at": (F.sum, _plus, F.lit(1).cast("long"))}).select("conv_id", "at", "digest", "n_chars")


def _members_hash(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which follow one another; a state at a time."""
    node, state, done = None, None, []
    for b in batches:
        for owner, at, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (owner, at) != node:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (owner, at), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield _rows(done)
            done = []
    if node:
        yield _rows([(*node, state.hexdigest())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["owner", "depth", "ends_sha256"])


def _member_hashes(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of (conv_id, owner, depth): pieces of up to BLOCK ids are put together by groups, then hashed in order.

    SHA-256 goes from left to right, so the pieces of one node go through one task, as a stream.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("owner", "depth", F.floor(F.col("conv_id") / BLOCK).alias("piece")).agg(text.alias("ids"))
    dealt = pieces.repartition(partitions(ends.sparkSession), "owner", "depth").sortWithinPartitions("owner", "depth", "piece")
    return dealt.select("owner", "depth", "ids").mapInArrow(_members_hash, "owner long, depth long, ends_sha256 string")


def _sums(chains: DataFrame, columns: list[str], scratch: Scratch) -> DataFrame:
    """chains (conv_id, up, *columns) with the columns summed over each chain and all that hang below it."""
    cur = scratch.save(chains.select("conv_id", "up", *columns), "sums")
    while total := cur.where("up is not null").count():
        below = cur.where("up is not null").groupBy(F.col("up").alias("_c")).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in columns])
        added = cur.join(below, F.col("conv_id") == F.col("_c"), "left")
        added = added.select("conv_id", "up", "_n", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns])
        after = scratch.save(added, "added")
        # of chains that others hang on: where these hang themselves
        jump = after.where("_n is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"), "_n")
        after = scratch.save(lookup(after.select("conv_id", "up", *columns), jump, ["up"], "_n", total, "conv_id").select("conv_id", F.col("next").alias("up"), *columns), "sums")
        scratch.drop(cur)
        cur = after
    return cur


def trie_nodes(turns: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every distinct prefix.

    turns is (conv_id, at, digest, n_chars) with at from 1 without gaps, members (conv_id, n_turns) has every conversation, turnless ones
    too, once. See prefix_trie for the columns.
    """
    members = scratch.save(members.select("conv_id", F.col("n_turns").cast("long")), "members")
    top, n_convs, longest = members.agg(F.min("conv_id"), F.count("*"), F.max("n_turns")).first()
    if top is None:
        return members.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    parts = turns.withColumn("part", F.floor((F.col("at") - 1) / BLOCK))
    hashes = {f"h{s}": (F.bit_xor, _xor, F.xxhash64(F.lit(s), "at", "digest")) for s in (1, 2)}
    prefixes = running(parts, ["conv_id"], ["at"], hashes).select("conv_id", "at", "n_chars", "h1", "h2", F.expr("at & -at").alias("bit"))
    prefixes = scratch.save(prefixes, "prefixes", by="bit")
    minima = prefixes.groupBy("bit", "at", "h1", "h2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars"))
    minima = scratch.save(minima, "minima", by="bit")

    n_prefixes = prefixes.count()
    # pos: the deepest node known to be another conversation's; up: whose
    state = scratch.save(members.where(F.col("conv_id") != top).select("conv_id", "n_turns", F.lit(0).cast("long").alias("pos"), F.lit(top).cast("long").alias("up")), "state")
    bit = 1 << max(0, longest.bit_length() - 1)
    while bit and longest:
        probe = state.join(prefixes.where(F.col("bit") == bit).select("conv_id", (F.col("at") - bit).alias("pos"), "at", "h1", "h2"), ["conv_id", "pos"], "left")
        own = minima.where(F.col("bit") == bit).select("at", "h1", "h2", "owner", "n_convs")
        found = lookup(probe, own, ["at", "h1", "h2"], "n_convs", n_prefixes, "conv_id")
        other = F.col("owner") != F.col("conv_id")
        after = found.select("conv_id", "n_turns", F.when(other, F.col("at")).otherwise(F.col("pos")).alias("pos"), F.when(other, F.col("owner")).otherwise(F.col("up")).alias("up"))
        after = scratch.save(after, "state")
        scratch.drop(state)
        state, bit = after, bit >> 1
    root = members.where(F.col("conv_id") == top).select("conv_id", "n_turns", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("up"))
    chains = scratch.save(state.unionByName(root), "chains")

    nodes = minima.select("owner", F.col("at").alias("depth"), "n_convs", "n_chars")
    nodes = nodes.unionByName(members.sparkSession.createDataFrame([(top, 0, n_convs, 0)], "owner long, depth long, n_convs long, n_chars int"))
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_chars"))
    hung = chains.where("up is not null")
    kids = hung.where("n_turns > pos").groupBy(F.col("up").alias("owner"), F.col("pos").alias("depth")).agg(F.count("*").alias("kids"))
    saved = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("saved").alias("saved"))
    ends = chains.join(kids.select(F.col("owner").alias("conv_id"), F.col("depth").alias("n_turns"), "kids"), ["conv_id", "n_turns"], "left").join(saved, "conv_id", "left")
    leaf = ((F.col("n_turns") > F.col("pos")) & F.col("kids").isNull()).cast("long")
    whole = _sums(ends.select("conv_id", "up", leaf.alias("leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved")), ["leaves", "saved"], scratch)
    hanging = hung.select("conv_id", "up", "pos", "n_turns").join(whole.drop("up"), "conv_id")
    hanging = hanging.groupBy(F.col("up").alias("owner"), F.col("pos").alias("depth")).agg(F.sum((F.col("n_turns") > F.col("pos")).cast("long")).alias("kids"), F.sum("leaves").alias("below_leaves"), F.sum("saved").alias("below_saved"))

    # along each chain from its end: what the nodes have themselves and what hangs on them
    own = chains.select(F.col("conv_id").alias("owner"), "n_turns", F.col("pos").alias("above"), "up", (F.col("n_turns") - F.col("pos")).alias("size"))
    n_nodes = nodes.count()
    full = lookup(nodes, own.where("size > 0"), ["owner"], "size", n_nodes, "depth").join(hanging, ["owner", "depth"], "left")
    full = full.withColumn("n_children", F.coalesce("kids", F.lit(0)) + (F.col("depth") < F.col("n_turns")).cast("long"))
    full = full.withColumns({"leaves": F.coalesce("below_leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long"), "tokens": F.coalesce("below_saved", F.lit(0)) + F.col("saved"), "part": -F.floor(F.col("depth") / BLOCK)})
    full = running(scratch.save(full, "nodes"), ["owner"], [F.desc("depth")], {"n_leaves": (F.sum, _plus, F.col("leaves")), "saved_tokens": (F.sum, _plus, F.col("tokens"))})

    at = F.when(F.col("n_turns") > F.col("pos"), F.col("conv_id")).otherwise(F.col("up"))
    hashed = _member_hashes(chains.select("conv_id", at.alias("owner"), F.col("n_turns").alias("depth")))
    parent = F.when(F.col("depth") - 1 > F.col("above"), F.col("owner")).otherwise(F.col("up"))
    out = full.join(hashed, ["owner", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, turn, role, text): each distinct sequence of the first turns of some conversation.

    conv_id: smallest conversation that starts so; depth: turns of the prefix; parent_conv_id: conv_id of the node above (null: root);
    n_convs: conversations that start so; n_children; n_leaves: nodes without children below it or itself; saved_tokens: code points of
    the last turn times (n_convs - 1), summed over the node and all below; ends_sha256: of the ids of conversations that end here.
    Order, nulls and ties are those of placed_turns; repeated rows are turns of their own; other columns are ignored; an empty table
    gives no nodes.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = scratch.save(placed_turns(conversations, scratch), "turns")
    return trie_nodes(turns, turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")), scratch)


def with_borrowed_heads(turns: DataFrame, scratch: Scratch, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, members): each conversation c begins with the first h turns of conversation c - c % every instead of its own first h.

    h is the unsigned crc32 of c in decimals modulo most. Where that conversation has fewer turns all are taken, none where it is absent.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string")) % most
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    first = turns.where((F.col("at") < most) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "at", "digest", "n_chars")
    base = sizes.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(base, "base", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = scratch.save(convs.withColumn("tail", F.greatest(F.col("n") - F.col("h"), F.lit(0))), "heads")
    heads = convs.select("conv_id", "base", "head").join(first, "base").where("at <= head").select("conv_id", "at", "digest", "n_chars")
    total = turns.count()
    tails = lookup(turns, convs.select("conv_id", "n", "h", "head"), ["conv_id"], "n", total, "at").where("at > h")
    tails = tails.select("conv_id", (F.col("at") - F.col("h") + F.col("head")).alias("at"), "digest", "n_chars")
    return scratch.save(heads.unionByName(tails), "rebuilt"), convs.select("conv_id", (F.col("head") + F.col("tail")).alias("n_turns"))
