"""Edit distance with adjacent transpositions, for many pairs of words at once.

The distance table of a pair is filled diagonal by diagonal: the cells of one diagonal do not depend on each other, so the
diagonals of all pairs of a chunk are filled together by a few array operations, whatever the words' length.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

# Executors get the functions of this module by value and need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Characters of the pairs that are aligned together; a longer pair is aligned alone.
CHUNK_CHARACTERS = 2**16


def _codes(words: list[str], size: int) -> np.ndarray:
    """The code points of the words, a row each, filled up with zeros."""
    return np.array(words, f"<U{max(1, size)}").view(np.uint32).reshape(len(words), max(1, size))[:, :size]


def _aligned(left: list[str], right: list[str]) -> np.ndarray:
    """The distances of pairs of words of similar length. Cells beyond a pair's own table are filled too; none of its own depends on them."""
    rows, columns = np.array([len(w) for w in left]), np.array([len(w) for w in right])
    m, n = int(rows.max()), int(columns.max())
    a, b = _codes(left, m), np.ascontiguousarray(_codes(right, n)[:, ::-1])
    # cell (i, k - i) of diagonal k stands at i; four diagonals before are needed
    recent = [np.zeros((len(left), m + 1), np.int32) for _ in range(5)]
    result = np.zeros(len(left), np.int32)
    ends = rows + columns
    for k in range(m + n + 1):
        now, before, second, _, fourth = (recent[(k - back) % 5] for back in range(5))
        low, high = max(1, k - n), min(m, k - 1)
        if low <= high:
            # character j = k - i of the right word stands at n - j
            differs = a[:, low - 1 : high] != b[:, n - k + low : n - k + high + 1]
            cells = np.minimum(before[:, low - 1 : high], before[:, low : high + 1]) + 1
            np.minimum(cells, second[:, low - 1 : high] + differs, out=cells)
            now[:, low : high + 1] = cells
        low, high = max(2, k - n), min(m, k - 2)
        if low <= high:
            swapped = a[:, low - 1 : high] == b[:, n - k + low + 1 : n - k + high + 2]
            swapped &= a[:, low - 2 : high - 1] == b[:, n - k + low : n - k + high + 1]
            cells = now[:, low : high + 1]
            np.minimum(cells, fourth[:, low - 2 : high - 1] + 1, out=cells, where=swapped)
        if k <= n:
            now[:, 0] = k
        if k <= m:
            now[:, k] = k
        done = np.flatnonzero(ends == k)
        result[done] = now[done, rows[done]]
    return result


def osa_distances(left: list[str], right: list[str]) -> np.ndarray:
    """The distance of each pair of words."""
    result = np.zeros(len(left), np.int32)
    sizes = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64)
    order, low = np.argsort(-sizes, kind="stable"), 0
    while low < len(order):
        chosen = order[low : low + max(1, CHUNK_CHARACTERS // max(1, int(sizes[order[low]])))]
        result[chosen] = _aligned([left[i] for i in chosen], [right[i] for i in chosen])
        low += len(chosen)
    return result


@F.arrow_udf(T.IntegerType())
def _osa(left: pa.Array, right: pa.Array) -> pa.Array:
    """Null where a word is null."""
    pairs = np.flatnonzero(left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(zero_copy_only=False))
    found, known = np.zeros(len(left), np.int32), np.zeros(len(left), bool)
    known[pairs] = True
    found[pairs] = osa_distances(left.take(pa.array(pairs)).to_pylist(), right.take(pa.array(pairs)).to_pylist())
    return pa.array(found, mask=~known)


def aligned_distance(left: Column, right: Column) -> Column:
    """As :func:`pricemill.functions.distance.osa_distance` without a limit, for tables where most pairs are not settled by the
    built-in ``levenshtein``: the others are aligned by Arrow batches."""
    plain = F.levenshtein(left, right)
    unsettled = plain > 1
    return F.when(unsettled, _osa(F.when(unsettled, left), F.when(unsettled, right))).otherwise(plain)
