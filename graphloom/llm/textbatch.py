"""Word arithmetic on whole Arrow batches of text.

A batch's texts lie end to end in one UTF-8 buffer. The functions here find
words, lines and shingles in that buffer with numpy, so no Python object is
made per word. Words are runs of bytes other than space and 0x09-0x0D; in
UTF-8 those bytes never occur inside another character.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (a longer single text is one piece).
PIECE = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

GAMMA = np.uint64(0x9E3779B97F4A7C15)
#: Longer byte ranges are hashed by blake2b.
LONG = 1024
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def new_key() -> int:
    """A secret for the hashes of one job, drawn on the driver: no text can be made to collide under it."""
    return secrets.randbits(64)


class Texts:
    """Some consecutive texts of a batch: `data` holds their bytes, `at` the n + 1 offsets."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n = data, at, len(at) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of marked bytes; a run ends with its text."""
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = self.at[(self.at > 0) & (self.at < len(inside))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def of(self, place: np.ndarray) -> np.ndarray:
        """The text in which each byte lies."""
        return np.searchsorted(self.at, place, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all words."""
        start, end = self.runs(~SPACE[self.data])
        return start, end, self.of(start)

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False, key: int = 0) -> np.ndarray:
        """64-bit hashes of byte ranges under a key; they depend on the bytes and the key alone.

        Eight bytes at a time go through `mix`, which isn't linear, so ranges that collide
        whatever the key can't be built as they can for a polynomial.
        """
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = LOWER[self.data] if lower else self.data
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        size, key = end - start, np.uint64(key)
        value = mix(size.astype(np.uint64) * GAMMA + key)
        value = mix(value ^ (eight[start] & _TAIL[np.minimum(size, 8)]))
        long = size > LONG
        at, done = np.flatnonzero((size > 8) & ~long), 8
        while len(at):
            left = size[at] - done
            value[at] = mix((value[at] + key) ^ (eight[start[at] + done] & _TAIL[np.minimum(left, 8)]))
            at = at[left > 8]
            done += 8
        if long.any():
            secret = key.tobytes()
            for i in np.flatnonzero(long).tolist():
                value[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]], digest_size=8, key=secret).digest(), "little")
        return value

    def kinds(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of byte ranges, one of each kind and the kind of each range; equal bytes alone share a kind."""
        _, first, kind = np.unique(self.hashes(start, end), return_index=True, return_inverse=True)
        if not self.same(start, end, start[first][kind], end[first][kind]):
            number: dict[bytes, int] = {}
            kind = np.array([number.setdefault(self.data[a:b].tobytes(), len(number)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
            _, first = np.unique(kind, return_index=True)
        return first, kind

    def same(self, start: np.ndarray, end: np.ndarray, other: np.ndarray, stop: np.ndarray) -> bool:
        """Whether each range has the bytes of its partner."""
        size = end - start
        if (size != stop - other).any():
            return False
        step = max(1, PIECE // max(1, int(size.max(initial=1))))  # ranges at once, for bounded memory
        step = max(step, len(size) // 64)
        for a in range(0, len(size), step):
            some = size[a : a + step]
            if (self.data[spread(start[a : a + step], some)] != self.data[spread(other[a : a + step], some)]).any():
                return False
        return True

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sums of a value of each byte by text."""
        total = np.zeros(len(per_byte) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, Texts) of stretches of about `most` bytes."""
    data, at = buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, stop, Texts(data[at[row] : at[stop]], at[row : stop + 1] - at[row])
        row = stop


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] places, then those of first[1], and so on."""
    stop = np.cumsum(size)
    return np.repeat(first - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)


def distinct(value: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first places of the distinct (value, of), in no order, and how often each occurs."""
    key = value ^ mix(of.astype(np.uint64) * GAMMA)  # for one `of` a bijection of the value
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    if (of[order[1:]] != of[order[:-1]])[~new[1:]].any():  # two pairs with one key
        order = np.lexsort((value, of))
        new[1:] = (value[order[1:]] != value[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
    edge = np.flatnonzero(new)
    return order[edge], np.diff(np.append(edge, len(order)))


def shingles(words: np.ndarray, of: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles by text, as (hash, text) ordered by text.

    A text of 1 to k - 1 words has its whole sequence as its one shingle.
    """
    count = np.bincount(of, minlength=n)
    first = np.zeros(n, np.int64)
    first[1:] = np.cumsum(count)[:-1]
    made, owner = [], []
    for size in range(1, k):
        short = np.flatnonzero(count == size)
        if len(short):
            made.append(chain(words, first[short], size))
            owner.append(short)
    start = np.flatnonzero(of[k - 1 :] == of[: len(of) - k + 1]) if len(of) >= k else np.zeros(0, np.int64)
    made.append(chain(words, start, k))
    owner.append(of[start])
    value, text = np.concatenate(made), np.concatenate(owner)
    at, _ = distinct(value, text)
    at = at[np.argsort(text[at], kind="stable")]
    return value[at], text[at]


def chain(words: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words from each start; they depend on the words and k."""
    value = np.full(len(start), k, np.uint64)
    for j in range(k):
        value = mix(value * GAMMA + words[start + j])
    return value
