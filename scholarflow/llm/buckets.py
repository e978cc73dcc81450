"""Streams the tasks of `common.block_pairs` through a kernel, many small buckets at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of `n` rows, the smallest row of its component under the links i - j."""
    p = np.arange(n)
    while len(i):
        a, b = p[i], p[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q
    return p


def small_pairs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of the same group; rows are sorted by group."""
    i, j = [], []
    lag = 1
    while lag < len(group):
        same = np.flatnonzero(group[lag:] == group[:-lag])
        if not len(same):
            break
        i.append(same)
        j.append(same + lag)
        lag += 1
    none = np.zeros(0, np.int64)
    return np.concatenate(i or [none]), np.concatenate(j or [none])


def stream(batches: Iterator[pd.DataFrame], keys: list[str], small: int, kernel: Callable[[pd.DataFrame, np.ndarray, bool], pd.DataFrame | None]) -> Iterator[pd.DataFrame]:
    """Calls kernel(rows, group, is_large) for the sorted tasks of a partition.

    Groups of up to `small` rows come many at a time; a larger one comes alone. A task never holds
    more than a batch and one group, and `block_pairs` bounds a group.
    """
    left: list[pd.DataFrame] = []
    for batch in _with_end(batches):
        if batch is not None:
            left.append(batch)
            rows = pd.concat(left, ignore_index=True) if len(left) > 1 else batch
            change = np.flatnonzero((rows[keys].to_numpy()[1:] != rows[keys].to_numpy()[:-1]).any(1)) + 1
            if not len(change):
                left = [rows]
                continue
            done, left = rows.iloc[: change[-1]], [rows.iloc[change[-1] :]]
        elif left:
            done, left = pd.concat(left, ignore_index=True), []
        else:
            continue
        k = done[keys].to_numpy()
        group = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(1))])
        n = np.bincount(group)
        is_small = n[group] <= small
        if is_small.any():
            out = kernel(done[is_small].reset_index(drop=True), group[is_small], False)
            if out is not None:
                yield out
        for g in np.flatnonzero(n > small):
            out = kernel(done[group == g].reset_index(drop=True), group[group == g], True)
            if out is not None:
                yield out


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    for batch in batches:
        if len(batch):
            yield batch
    yield None
