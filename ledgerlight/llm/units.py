"""What a worker process has encoded before, in bounded memory."""

from __future__ import annotations

import numpy as np

MOST_UNITS = 1_500_000


class Units:
    """The ids of units that a worker process has met, by 128-bit fingerprint, in two generations of bounded size.

    A generation is an open-addressed table in numpy arrays. When the younger is full it becomes the older one; units that are
    found there are taken over.
    """

    def __init__(self, most: int = MOST_UNITS):
        self.most, self.slots = most, 1 << (2 * most - 1).bit_length()
        self.old = self.new = None
        self._next()

    def _next(self) -> None:
        self.old = self.new
        self.new = {"slot": np.full(self.slots, -1, np.int32), "key": np.zeros((0, 2), np.uint64), "first": np.zeros(1, np.int64), "ids": np.zeros(0, np.uint32)}

    @staticmethod
    def _find(table: dict | None, key: np.ndarray) -> np.ndarray:
        """Entries of the keys, -1 where there is none."""
        out = np.full(len(key), -1, np.int64)
        todo, step = np.arange(len(key) if table else 0), 0
        while len(todo):
            slot = table["slot"]
            e = slot[(key[todo, 0] + np.uint64(step)).astype(np.int64) & (len(slot) - 1)]
            todo, e = todo[e >= 0], e[e >= 0]
            k = table["key"][e]
            same = (k[:, 0] == key[todo, 0]) & (k[:, 1] == key[todo, 1])
            out[todo[same]] = e[same]
            todo, step = todo[~same], step + 1
        return out

    def _add(self, key: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Put distinct keys in that are not there."""
        t = self.new
        n = len(t["key"])
        if 2 * (n + len(key)) > len(t["slot"]):  # one slice has more units than a generation: its table grows
            key, size, ids = np.concatenate([t["key"], key]), np.concatenate([np.diff(t["first"]), size]), np.concatenate([t["ids"], ids])
            t = self.new = {"slot": np.full(1 << (4 * len(key)).bit_length(), -1, np.int32), "key": key[:0], "first": np.zeros(1, np.int64), "ids": ids[:0]}
            n = 0
        slot = t["slot"]
        todo, step = np.arange(len(key)), 0
        while len(todo):
            at = (key[todo, 0] + np.uint64(step)).astype(np.int64) & (len(slot) - 1)
            free = slot[at] < 0
            slot[at[free]] = n + todo[free]
            todo, step = todo[slot[at] != n + todo], step + 1
        t["key"], t["ids"] = np.concatenate([t["key"], key]), np.concatenate([t["ids"], ids])
        t["first"] = np.concatenate([t["first"], t["first"][-1] + np.cumsum(size)])

    def ids(self, key: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry of each key, first id of each entry, ids); encode(places) gives (sizes, ids) of units not met before."""
        e = self._find(self.new, key)
        lost = _distinct(key, np.flatnonzero(e < 0))
        if len(lost):
            if len(self.new["key"]) and len(self.new["key"]) + len(lost) > self.most:
                self._next()
                e[:], lost = -1, _distinct(key, np.arange(len(key)))
            before = self._find(self.old, key[lost])
            size, ids = encode(lost[before < 0])
            if (before >= 0).any():
                n, own = _take(self.old["first"], self.old["ids"], before[before >= 0])
                size, ids, lost = np.concatenate([size, n]), np.concatenate([ids, own]), np.concatenate([lost[before < 0], lost[before >= 0]])
            self._add(key[lost], size, ids)
            e[e < 0] = self._find(self.new, key[e < 0])
        return e, self.new["first"], self.new["ids"]


def _distinct(key: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One of the places of each key."""
    k = key[places]
    order = np.lexsort((k[:, 1], k[:, 0]))
    k = k[order]
    return places[order[np.r_[True, (k[1:] != k[:-1]).any(axis=1)][: len(k)]]]


def _take(first: np.ndarray, ids: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids) of some entries."""
    n = first[entries + 1] - first[entries]
    at = np.cumsum(n) - n
    return n, ids[np.repeat(first[entries] - at, n) + np.arange(n.sum())]
