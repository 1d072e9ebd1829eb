from __future__ import annotations

import hashlib
import zlib

import duckdb
from pyspark.sql import functions as F

from ledgerlight.llm import skew, trie
from ledgerlight.llm.queries import _TRIE
from ledgerlight.llm.scratch import Scratch
from ledgerlight.llm.trie import placed_turns, prefix_trie, trie_nodes, with_borrowed_heads

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def every(rows, borrow=False):
    conv = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv.setdefault(c, []).append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in conv.items()}
    turns = own
    if borrow:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        turns = {c: own.get(c - c % 100 if c >= 0 else c + -c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}
    nodes = {}
    for c, v in turns.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    end = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(turns[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p], end(p, m)) for p, m in nodes.items())


def result(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.select(COLUMNS).collect())


def logged():
    """Prefixes of a few texts in any order of ids, one logged after each turn, one long, ties, repeats, nulls."""
    rows = []
    for c in range(0, 260, 3):
        n, base = c % 7 + 1, c % 5
        rows += [(c, t, "user" if t % 2 else "assistant", f"{base if t < 3 else c % 4} turn {t}") for t in range(n)]
    for c in range(300, 340):
        rows += [(c, t, "user", f"growing {t}") for t in range(c - 299)]
    rows += [(350, t, "user", f"long {t // 2}") for t in range(700)] + [(351, t, "user", f"long {t // 2}") for t in range(600)]
    rows += [(400, 0, None, None), (401, 0, "", ""), (402, None, "user", "x"), (402, 0, "user", "x"), (None, 0, "user", "x"), (403, 0, "b", "y"), (403, 0, "a", "y"), (403, 0, "a", "y"), (404, 0, "user", "\U0001f600" * 70_000)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    df = spark.createDataFrame([(*r, "x", 1) for r in logged()], SCHEMA + ", owner string, depth int").repartition(5)
    assert result(prefix_trie(df)) == every(logged())


def test_frequent_keys_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 3)
    rows = [r for r in logged() if r[0] not in (350, 351)]
    assert result(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == every(rows)


def test_borrowed_heads_and_sql(spark):
    rows = [r for r in logged() if r[0] not in (350, 351, 404)] + [(-107, 0, "user", "q"), (-100, 0, "user", "p"), (-100, 1, "user", "q"), (-1, 0, "a", "b")]
    df, scratch = spark.createDataFrame(rows, SCHEMA).repartition(4), Scratch(spark, "test")
    got = result(trie_nodes(*with_borrowed_heads(placed_turns(df, scratch), scratch), scratch))
    assert got == every(rows, borrow=True)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    q = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({_TRIE})")
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in q.fetchall()) == got


def test_empty_and_turnless(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    scratch = Scratch(spark, "test")
    none = placed_turns(spark.createDataFrame([], SCHEMA), scratch)
    members = spark.createDataFrame([(5, 0), (3, 0)], "conv_id long, n_turns long")
    assert result(trie_nodes(none, members, scratch)) == [(3, 0, -1, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_many_members_of_one_node(spark):
    """Ten thousand equal conversations of negative and positive ids, over several pieces."""
    df = spark.range(-5000, 5000, 1, 7).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    want = hashlib.sha256(",".join(map(str, range(-5000, 5000))).encode()).hexdigest()
    assert [r for r in result(prefix_trie(df)) if r[1] == 1] == [(-5000, 1, -5000, 10000, 0, 1, 9999 * 2, want)]
