"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import random
import re

UPPER, DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UPPER, DOWN)
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spaced(text: str | None, lower: bool = False) -> list[str]:
    t = text or ""
    return SPACE.findall(t.translate(LOWER) if lower else t)


def plain(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingles(text: str | None, k: int) -> set:
    w = spaced(text, True)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def jaccard(docs: list[tuple], k: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t, k) for d, t, *_ in docs}
    ids, up = list(sets), {d: d for d in sets}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def substring(docs: list[tuple], size: int = 20) -> dict[int, tuple[int, int, str, str]]:
    seen, out = set(), {}
    for d, t, *_ in sorted(docs, key=lambda x: x[0]):
        w = spaced(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                gone[i : i + size] = [True] * size
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def stretch(same: list[bool], need: int) -> bool:
    """Whether some run of aligned words, equal at both ends, has *need* words or more of which 80 % agree."""
    n = len(same)
    return any(same[i] and same[j - 1] and sum(same[i:j]) * 5 >= (j - i) * 4 for i in range(n) for j in range(i + need, n + 1))


def prose(rng: random.Random, n: int, words: int = 3000) -> list[str]:
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def odd_documents() -> list[tuple]:
    """(doc_id, text) with copies, near copies, chains, shared passages, empty, short, long and repetitive texts."""
    rng = random.Random(5)
    docs, passage = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a a a a a a a a")], prose(rng, 60)
    for i in range(10, 40):
        docs.append((i, " ".join(prose(rng, rng.randrange(5, 200)))))
    base = prose(rng, 300)
    docs += [(i, " ".join(base)) for i in range(50, 60)]
    for i in range(60, 100):  # a chain: each one differs a little from the one before
        base = list(base)
        base[rng.randrange(len(base))] = f"x{i}"
        docs.append((i, " ".join(base)))
    for i in range(100, 110):
        docs.append((i, " ".join(prose(rng, 30) + passage + prose(rng, 30))))
    docs.append((110, " ".join(["same"] * 500)))
    docs.append((111, " ".join(passage * 3)))
    docs.append((112, " ".join(prose(rng, 20000))))
    docs.append((113, "Über\u00a0straße İ \u2028 \u0085x naïve " * 10))
    docs.append((114, "z" * 100_000))
    return docs
