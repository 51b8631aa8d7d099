"""SuperMinHash signatures (Ertl, 2017) of many sets at once.

Each element draws, from its own random stream, a value r in [0, 1) and the
next entry of a random permutation of the slots at every level j; a slot keeps
the least j + r. Levels are worked off for all sets together, and a set leaves
as soon as all its slots are filled, as no later level can lower a slot: the
early stop of the original, with the same signatures as element by element.
"""

from __future__ import annotations

import numpy as np

from .textbatch import GAMMA, mix

EMPTY = np.uint32(0xFFFFFFFF)


def signatures(value: np.ndarray, of: np.ndarray, n: int, slots: int = 128) -> np.ndarray:
    """n x slots signatures; entries are level * 2**24 + r. Sets without elements keep EMPTY.

    value, of: distinct 64-bit elements and their set, ordered by set. slots: at most 255.
    """
    kept = np.full(n * slots, EMPTY, np.uint32)
    order = None  # rows of permutations, made when the first set needs level 1
    open_sets = np.bincount(of, minlength=n) > 0
    for level in range(slots):
        draw = mix(value + np.uint64((2 * level + 1) * int(GAMMA) % (1 << 64)))
        r = (draw >> np.uint64(40)).astype(np.uint32) | np.uint32(level << 24)
        pick = level + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)
        if order is None and level == 0:
            slot = pick
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(value), 1))
                rows = np.arange(len(value))
                order[rows, first] = 0
                order[:, 0] = first
            rows = np.arange(len(value))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, level]
            order[:, level] = slot
        np.minimum.at(kept, of * slots + slot, r)
        open_sets &= (kept.reshape(n, slots) == EMPTY).any(axis=1)
        if not open_sets.any():
            break
        stay = open_sets[of]
        first = slot[stay] if order is None else None
        if order is not None and not stay.all():
            order = order[stay]
        value, of = value[stay], of[stay]
    return kept.reshape(n, slots)


def bands(kept: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` slots; the band's number is part of the key."""
    n, slots = kept.shape
    count = slots // rows
    key = np.tile((np.arange(count, dtype=np.uint64) + np.uint64(1)) * GAMMA, (n, 1))
    for j in range(rows):
        key = mix(key * GAMMA + kept[:, j : count * rows : rows].astype(np.uint64))
    return key
