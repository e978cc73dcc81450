"""Bit-sliced Hamming distances: fingerprints as vertical bit planes, carry-save counters, early abandonment."""

from __future__ import annotations

import numpy as np

BITS = 64
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(x: np.ndarray) -> np.ndarray:
    """The vertical planes, shape (64, words), of fingerprints; the last word is padded with zeros."""
    bits = np.unpackbits(x.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    bits = np.concatenate([bits, np.zeros((-len(x) % 64, BITS), np.uint8)])
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def within(planes: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, column) of all distances of at most `radius` (0 to 63) between queries and a block's planes.

    Counter k holds bit k of 64 distances a word; two planes at a time go through a full adder into the
    counters, and what runs over the last counter sticks. Words whose distances all exceed the radius are
    dropped on the way, and the block is abandoned when none is left.
    """
    masks = np.where(np.unpackbits(queries.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool), ONES, np.uint64(0))
    columns = np.arange(planes.shape[1])
    counters = [np.zeros((len(queries), len(columns)), np.uint64) for _ in range(max(1, int(radius).bit_length()))]
    over = np.zeros_like(counters[0])
    far = over
    for b in range(0, BITS, 2):
        x, y = planes[b] ^ masks[:, b, None], planes[b + 1] ^ masks[:, b + 1, None]
        carry = (counters[0] & x) | (y & (counters[0] ^ x))
        counters[0] = counters[0] ^ x ^ y
        for k in range(1, len(counters)):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over = over | carry
        if b >= radius and b % 8 == 6 or b == BITS - 2:
            # greater than the radius, from the highest counter down
            far, equal = over, ONES
            for k in range(len(counters) - 1, -1, -1):
                if radius >> k & 1:
                    equal = equal & counters[k]
                else:
                    far, equal = far | (equal & counters[k]), equal & ~counters[k]
            live = ~(far == ONES).all(0)
            if not live.any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if live.mean() < 0.7:
                planes, columns = planes[:, live], columns[live]
                counters, over, far = [c[:, live] for c in counters], over[:, live], far[:, live]
    bits = np.unpackbits(np.ascontiguousarray(~far).view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")
    q, c = np.nonzero(bits)
    return q, columns[c // 64] * 64 + c % 64
