from __future__ import annotations

import re

from ledgerlight.llm.chat import chat_texts

SCHEMA = "conv_id long, turn long, role string, text string"


def every(rows):
    conv = {}
    for c, t, r, x in rows:
        if c is not None:
            conv.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v)] for c, v in conv.items()}
    out = []
    for c, v in turns.items():
        same = [d for d, w in turns.items() if w == v]
        if c == min(same) and not any(len(w) > len(v) and w[: len(v)] == v for w in turns.values()):
            out.append((c, len(v), len(same), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v)))
    return sorted(out)


def test_against_brute_force(spark):
    rows = []
    for c in range(40):
        n, base = c % 7 + 1, c % 5
        rows += [(c, t, "user" if t % 2 else "assistant", f"{base} turn {t}") for t in range(n)]
    rows += [(100, 0, None, None), (101, 0, "", ""), (101, 1, "user", None), (102, None, "user", "x"), (None, 0, "user", "x"), (103, 0, "user", "y"), (103, 0, "user", "y"), (104, 0, "user", "y" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(tuple(r) for r in chat_texts(df).collect()) == every(rows)


def test_native_and_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat_texts(df).count() == 0
    assert not re.search("Python|Pandas|Arrow", chat_texts(df)._jdf.queryExecution().executedPlan().toString())
