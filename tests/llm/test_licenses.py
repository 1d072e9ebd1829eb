from __future__ import annotations

import random
import re
from re import _parser

import brute

from ledgerlight.llm.licenses import BASE, GATE, license_scan, rules


def scan(text):
    w = brute.plain(text)
    at = [(i, lab) for p, lab in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, sure, found = {lab for _, lab in at}, [0.9] * len(at), []
    if re.search(GATE, text or ""):
        t = f" {' '.join(w)} "
        for p, lab, key, rx, c in rules():
            if key in t:
                found += [(p, lab, c, m.start(), m.end()) for m in re.finditer(rx, t)]
        for d in found:
            if not any(o[0] <= d[0] and o[3] <= d[3] and o[4] >= d[4] and (o[4] - o[3] > d[4] - d[3] or o[0] < d[0]) for o in found):
                labels.add(d[1])
                sure.append(d[2])
    places = [i for i, _ in at]
    return (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({lab for _, lab in at})), ",".join(sorted(labels)), max(sure, default=0.0))


TEXTS = [
    None, "", "plain words", "MIT License", "mit-license; MIT\nLicense, mit license", "Licensed under the Apache License, Version 2.0 (the License)", "GNU General Public License v3 or later",
    "the GNU Affero General Public License version 3.0", "lesser general public license 2.1", "SPDX-License-Identifier: BSD-3-Clause", "all rights reserved. Creative Commons Attribution-ShareAlike 4.0",
    "general public license " * 300, "permit license emit license mit licenses", "x" * 200_000 + " mit license", "\u0130 mit\u00a0license mit license", "cc by nc nd 4.0 cc-by 4.0 CC0", "under the terms of the MIT license and the apache license",
]


def test_against_brute_force(spark):
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS)]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string, n_words int, labels string"))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {i: scan(t) for i, t in enumerate(TEXTS)}


def test_specific_names_suppress_general_ones():
    assert scan(TEXTS[5])[5] == "apache,apache-2.0"
    assert scan(TEXTS[6])[5] == "gpl,gpl-3.0"
    assert scan(TEXTS[12])[1] == 0


def test_no_python_in_the_plan(spark):
    df = license_scan(spark.createDataFrame([(1, "mit license")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def ungated(text):
    """Labels and score by all rules, without gate and keywords."""
    t, w = f" {' '.join(brute.plain(text))} ", brute.plain(text)
    base = {lab for p, lab in BASE.items() if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))}
    found = [(p, lab, c, m.start(), m.end()) for p, lab, _, rx, c in rules() for m in re.finditer(rx, t)]
    kept = [d for d in found if not any(o[0] <= d[0] and o[3] <= d[3] and o[4] >= d[4] and (o[4] - o[3] > d[4] - d[3] or o[0] < d[0]) for o in found)]
    return ",".join(sorted(base | {d[1] for d in kept})), max([d[2] for d in kept] + [0.9] * bool(base), default=0.0)


def sample(rng, tree):
    """A text that a regex matches."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            kind, what = rng.choice(arg)
            out += chr(what if str(kind) == "LITERAL" else rng.randint(*what))
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3))))
        elif op == "SUBPATTERN":
            out += sample(rng, arg[3])
        elif op == "BRANCH":
            out += sample(rng, rng.choice(arg[1]))
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    return out


def test_gate_and_keywords_lose_nothing(spark):
    rng = random.Random(3)
    texts = ["public\ndomain", "in the public\ndomain", "All rights\nreserved", "Creative\nCommons Attribution 4.0", "released under MIT-0", "expat license", "the X11 license", "Common Development and Distribution License 1.0", "open database license", "cc  by-sa"]
    for _, _, _, rx, _ in rules():
        texts += [re.sub(" ", lambda _: rng.choice([" ", "\n", " - ", "\n * ", "\t"]), f"x {sample(rng, _parser.parse(rx))} y") for _ in range(4)]
    got = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {texts[r.doc_id]: (r.labels, r.score) for r in got} == {t: ungated(t) for t in texts}
    assert all(ungated(t)[0] for t in texts[1:])
    assert all(key in f" {' '.join(brute.plain(m))} " for _, _, key, rx, _ in rules() for m in [sample(rng, _parser.parse(rx)) for _ in range(20)])


def test_spdx_and_license_texts(spark):
    texts = {
        "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "Apache-2.0": "apache-2.0", "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2.0,mit", "SPDX-License-Identifier: Apache-2.0 OR MIT": "apache-2.0,mit",
        "GPL-3.0-only": "gpl-3.0", "LGPL-2.1-or-later": "lgpl-2.1", "SPDX-License-Identifier: ISC": "isc", "SPDX-License-Identifier: MPL-2.0": "mpl-2.0", "wir gehen mit vim": "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files": "mit", "Redistribution and use in source and binary forms, with or without\n * modification, are permitted": "bsd",
    }
    got = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {list(texts)[r.doc_id]: r.labels for r in got} == texts


def test_very_many_hits(spark):
    """Work grows nearly as the hits: sixteen times the marks take less than thirty-two times as long."""
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, "cc0 mit license " * n)], "doc_id long, text string")
        began = time.time()
        (r,) = license_scan(df).collect()
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (3 * n, n, "mit", "cc0-1.0,mit")
        return time.time() - began

    fixed = min(seconds(1) for _ in range(2))
    small, large = max(seconds(2_000) - fixed, 0.2), seconds(32_000) - fixed
    assert large < 32 * small
