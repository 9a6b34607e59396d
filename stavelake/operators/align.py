"""Alignment of two ordered note lists, in Arrow batches of streams: the recurrence has no relational form."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the table above which it is kept in blocks of rows, so its memory grows with the root of its rows.
MOST_CELLS = 1_500_000
#: Cells of a table that is filled without a search for a short way first.
FEW_CELLS = 4096


def row_above(x: int, below: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The row of lengths for one more value x on the left."""
    out = np.zeros_like(below)
    out[:-1] = np.maximum.accumulate(np.maximum(below[:-1], np.where(right == x, below[1:] + 1, 0))[::-1])[::-1]
    return out


def table_ops(a: list, b: list) -> list[tuple[str, int | None, int | None]]:
    """`lcs_ops` by the lengths of all pairs of rests. A large table keeps one row of each block, and blocks are filled again as the way reaches them.
    """
    codes = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    left, right = [codes[x] for x in a], np.array([codes[x] for x in b], np.int64)
    n = len(a)
    block = max(1, n if n * len(b) <= MOST_CELLS else isqrt(n))
    row = np.zeros(len(b) + 1, np.int32)
    marks = {n: row}
    for k in range(n - 1, -1, -1):
        if k < block:
            break  # no block lies before the first
        row = row_above(left[k], row, right)
        if k % block == 0:
            marks[k] = row
    out, i, j, lo = [], 0, 0, -1
    size: list[np.ndarray] = []
    while i < n or j < len(b):
        if i < n and i // block != lo:
            lo = i // block
            size = [marks[min(n, (lo + 1) * block)]]
            for k in range(min(n, (lo + 1) * block) - 1, lo * block - 1, -1):
                size.append(row_above(left[k], size[-1], right))
            size.reverse()
        at = i - lo * block
        if i < n and j < len(b) and a[i] == b[j]:
            out.append(("m", i, j))
            i, j = i + 1, j + 1
        elif i < n and (j == len(b) or size[at + 1][j] >= size[at][j + 1]):
            out.append(("d", i, None))
            i += 1
        else:
            out.append(("i", None, j))
            j += 1
    return out


def short_way(a: list, b: list, most: int) -> list[tuple[str, int | None, int | None]] | None:
    """`lcs_ops` in (n + m) x D steps for lists with D differences; None where D is above `most`.

    From the ends of both lists backward, for d = 0, 1, 2.. and each diagonal (left less right): the least place from
    which the ends are d differences away, found by one difference more and then all equal items. The way then runs
    forward, and deletes wherever the rest after it is still on the shortest way.
    """
    n, m = len(a), len(b)
    reach: list[dict[int, int]] = []
    for d in range(most + 1):
        now: dict[int, int] = {}
        for k in range(n - m - d, n - m + d + 1, 2):
            if d:
                before = reach[-1]
                i = min(before.get(k + 1, n + 2) - 1, before.get(k - 1, n + 1))
                if i < 0 or i > n or i < k or i - k > m:
                    continue
            else:
                i = n
            while i > 0 and i > k and a[i - 1] == b[i - k - 1]:
                i -= 1
            now[k] = i
        reach.append(now)
        if now.get(0) == 0:
            break
    else:
        return None
    out, i, j, d = [], 0, 0, len(reach) - 1
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append(("m", i, j))
            i, j = i + 1, j + 1
        else:
            d -= 1
            if i < n and reach[d].get(i - j + 1, n + 1) <= i + 1:
                out.append(("d", i, None))
                i += 1
            else:
                out.append(("i", None, j))
                j += 1
    return out


def lcs_ops(a: list, b: list) -> list[tuple[str, int | None, int | None]]:
    """(op, left, right) with op m, d or i: a longest common subsequence; of equal ways deleting comes first.

    Exact at every size. Lists with few differences take time by these (`short_way`), others by the table of all cells.
    """
    if len(a) * len(b) > FEW_CELLS and (found := short_way(a, b, isqrt(MOST_CELLS))) is not None:
        return found
    return table_ops(a, b)


def align(truth: DataFrame, pred: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, op, left, right): places in the two ordered lists of each key; a key of one side alone is all d or all i.

    Each key's values travel as one array in order, so Python gets many keys in a batch.
    """
    types = dict(truth.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", op string, left int, right int"
    cols = list(dict.fromkeys([*order, value]))

    def lists(df: DataFrame, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(*cols)))
        return df.groupBy(*keys).agg(F.transform(rows, lambda r: r[value].cast("string")).alias(name))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *key, a, b in batch.itertuples(index=False, name=None):
                out += [(*key, *op) for op in lcs_ops([] if a is None else list(a), [] if b is None else list(b))]
            yield pd.DataFrame(out, columns=[*keys, "op", "left", "right"]).astype({"left": "Int32", "right": "Int32"})

    both = lists(truth, "truth_").join(lists(pred, "pred_"), keys, "full_outer").select(*keys, "truth_", "pred_")
    return both.mapInPandas(run, schema)
