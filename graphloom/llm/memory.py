"""What a worker remembers of byte strings it has seen, as arrays: no Python object for each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import textbatch as tb

#: Of a list of byte strings, for each column all values end to end and the number of values of each string.
Make = Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]]


class Pool:
    """Arrays of different lengths, end to end."""

    def __init__(self, kind: str):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.values, self.first, self.size = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def insert(self, place: np.ndarray, values: np.ndarray, size: np.ndarray) -> None:
        self.first = np.insert(self.first, place, len(self.values) + np.cumsum(size) - size)
        self.size = np.insert(self.size, place, size)
        self.values = np.concatenate([self.values, values.astype(self.kind, copy=False)])


class Memory:
    """Strings are found by hash and told apart by their bytes, which are kept, too."""

    def __init__(self, kinds: list[str], make: Make, most: int):
        self.make, self.most = make, most
        self.bytes, self.columns = Pool("u1"), [Pool(k) for k in kinds]
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        for pool in (self.bytes, *self.columns):
            pool.clear()

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands or would stand among the known ones, and whether it is new."""
        place = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != hashes[inside]
        return place, new

    def look(self, texts: tb.Texts, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each column, the values of all the byte ranges end to end, and the number of values of each range."""
        first, kind = texts.kinds(start, end)
        low, high = start[first], end[first]
        hashes = texts.hashes(low, high)
        order = np.argsort(hashes, kind="stable")
        low, high, hashes = low[order], high[order], hashes[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # of kinds with one hash only the first can be remembered
        alone = np.ones(len(hashes), bool)
        alone[1:] = hashes[1:] != hashes[:-1]
        place, new = self.places(hashes)
        if len(self.known) + new.sum() > self.most:
            self.forget()
            place, new = self.places(hashes)
        fresh = new & alone
        if fresh.any():
            made = self.make(self.strings(texts, low[fresh], high[fresh]))
            size = (high - low)[fresh]
            self.bytes.insert(place[fresh], texts.data[tb.spread(low[fresh], size)], size)
            for pool, (values, n) in zip(self.columns, made, strict=True):
                pool.insert(place[fresh], values, n)
            self.known = np.insert(self.known, place[fresh], hashes[fresh])
            place, _ = self.places(hashes)
        odd = np.flatnonzero(~self.right(texts, low, high, place))
        if not len(odd):
            at = place[rank][kind]
            sizes = [pool.size[at] for pool in self.columns]
            return [(pool.values[tb.spread(pool.first[at], n)], n) for pool, n in zip(self.columns, sizes, strict=True)]
        # a known hash of other bytes: these strings are asked for each time
        out = []
        for pool, (values, n) in zip(self.columns, self.make(self.strings(texts, low[odd], high[odd])), strict=True):
            head, size = pool.first[place].copy(), pool.size[place].copy()
            head[odd], size[odd] = len(pool.values) + np.cumsum(n) - n, n
            head, size = head[rank][kind], size[rank][kind]
            out.append((np.concatenate([pool.values, values.astype(pool.kind, copy=False)])[tb.spread(head, size)], size))
        return out

    def right(self, texts: tb.Texts, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the bytes kept at each place are those of the range."""
        size = high - low
        good = self.bytes.size[place] == size
        at, size, low = place[good], size[good], low[good]
        differ = self.bytes.values[tb.spread(self.bytes.first[at], size)] != texts.data[tb.spread(low, size)]
        wrong = np.zeros(len(size), bool)
        wrong[np.repeat(np.arange(len(size)), size)[differ]] = True
        good[np.flatnonzero(good)[wrong]] = False
        return good

    @staticmethod
    def strings(texts: tb.Texts, low: np.ndarray, high: np.ndarray) -> list[bytes]:
        raw = texts.data.tobytes()
        return [raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
