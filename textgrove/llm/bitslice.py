"""Bit-sliced Hamming comparison of 64-bit fingerprints.

Fingerprints lie in blocks of 64 lanes. Bit plane b of a block is one word that holds bit b of its
64 fingerprints, so one XOR with a query's bit (spread over a word) compares 64 fingerprints at
once. The distances of all lanes are counted in two bit-sliced counter words and an overflow word,
updated by carry-save addition. A block is abandoned as soon as all its lanes exceed the radius.
"""

from __future__ import annotations

import numpy as np

LANES = 64
STEP = 8  # planes between two looks for blocks to abandon
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
PAIRS_AT_ONCE = 1 << 18


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, blocks) words: bit i of word [b, k] is bit b of fingerprint 64 * k + i."""
    blocks = -(-len(fps) // LANES)
    padded = np.zeros(blocks * LANES, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T.reshape(64, blocks, LANES), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).reshape(64, blocks)


def near_lanes(
    planes: np.ndarray, queries: np.ndarray, blocks: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each (query, block) pair: the pairs left, and a word with the lanes within ``radius``.

    ``radius`` is at most 2: two counter bits and an overflow word hold all that is asked.
    """
    alive = np.arange(len(queries))
    one = np.zeros(len(queries), np.uint64)
    two, over = one.copy(), one.copy()
    for plane in range(64):
        spread = np.where((queries >> np.uint64(plane)) & np.uint64(1), ONES, np.uint64(0))
        diff = planes[plane, blocks] ^ spread
        carry = one & diff
        one ^= diff
        over |= two & carry
        two ^= carry
        if plane % STEP == STEP - 1:
            dead = _beyond(one, two, over, radius)
            keep = np.flatnonzero(dead != ONES)
            if len(keep) < len(alive):
                alive, queries, blocks = alive[keep], queries[keep], blocks[keep]
                one, two, over = one[keep], two[keep], over[keep]
            if not len(alive):
                break
    return alive, ~_beyond(one, two, over, radius)


def _beyond(one, two, over, radius):
    return over | {0: one | two, 1: two, 2: one & two}[radius]


def linked_pairs(fps: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i < j, within ``radius``: all of those with j < ends[i].

    Groups lie one after another in ``fps``; ``ends[i]`` is where the group of i ends. Lanes of a
    neighbouring group that share a block are compared as well; what they add are true links.
    """
    planes = bit_planes(fps)
    start = np.arange(len(fps))
    spans = np.maximum(0, -(-ends // LANES) - (start + 1) // LANES)
    spans[start + 1 >= ends] = 0
    lefts, rights = [], []
    cut = np.flatnonzero(np.diff(np.cumsum(spans) // PAIRS_AT_ONCE, prepend=0))
    for part in np.split(start, cut):
        if not len(part):
            continue
        n = spans[part]
        query = np.repeat(part, n)
        block = (
            np.repeat((part + 1) // LANES, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        )
        alive, lanes = near_lanes(planes, fps[query], block, radius)
        query, block = query[alive], block[alive]
        bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(bits)
        left, right = query[row], block[row] * LANES + lane
        keep = (right > left) & (right < len(fps))
        lefts.append(left[keep])
        rights.append(right[keep])
    if not lefts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(lefts), np.concatenate(rights)


def smallest_linked(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n items the smallest index it is connected to by the pairs."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            break
    return root
