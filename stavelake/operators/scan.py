"""Recurrences over sorted rows: each key's rows pass one by one through a small state, whatever their number."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Fold(Protocol):
    def take(self, *row) -> Iterable[tuple]:
        """Rows that the next row of the key gives out."""

    def end(self) -> Iterable[tuple]:
        """Rows that are left when the key has no more."""


def fold_in_order(rows: DataFrame, keys: list[str], order: list[str], make: Callable[[], Fold], schema: str) -> DataFrame:
    """What a fresh fold gives for the rows of each key in order; it takes all columns of `rows`, the keys first.

    Rows are shuffled by key and sorted by Spark, which spills where it must, and stream through Python: a key of any
    size needs as much memory as its fold keeps. Null keys are one key. Ties in the order come in no defined order.
    """
    placed = rows.select(*keys, *[c for c in rows.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys, *order)
    n, made = len(keys), to_arrow_schema(T.StructType.fromDDL(schema))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), made)], schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if fold is None or row[:n] != key:
                    out += fold.end() if fold else ()
                    key, fold = row[:n], make()
                out += fold.take(*row)
            if out:
                yield batch_of(out)
        if fold and (left := list(fold.end())):
            yield batch_of(left)

    return placed.mapInArrow(run, schema)


def islands(rows: DataFrame, key: str, at: str, reach: Column, cut: Callable[[Column, Column], Column], name: str = "island") -> DataFrame:
    """`rows` with a number for each stretch of a key between gaps in `at` for which `cut(gap, reach)` holds.

    `reach` is one number for each key, and no gap of less may be a cut. Cells of that width hold no cut, so only the ends of
    cells, which are aggregated before the shuffle, are put in order; a key with many rows in few cells stays spread.
    Without a reach (null or zero) each value is a cell of its own.
    """
    wide = F.when(reach > 0, reach)
    celled = rows.withColumn("cell", F.coalesce(F.floor(F.col(at) / wide), F.xxhash64(at)))
    cells = celled.groupBy(key, "cell").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.max(reach).alias("reach"))
    w = Window.partitionBy(key).orderBy("low")
    far = F.coalesce(cut(F.col("low") - F.lag("high").over(w), F.coalesce("reach", F.lit(0.0))), F.lit(True))
    numbered = cells.withColumn("far", far.cast("int")).select(F.col(key).alias("key"), F.col("cell").alias("in_cell"), F.sum("far").over(w).cast("long").alias(name))
    on = F.col(key).eqNullSafe(F.col("key")) & F.col("cell").eqNullSafe(F.col("in_cell"))
    return celled.join(numbered, on).drop("cell", "key", "in_cell")


class Spans:
    """Numbered spans of whole numbers, to which more can be added, and the least number that touches a stretch.

    A sparse tree of halves: each span lies in the fewest nodes that make it up, so all steps take time by the logarithm
    of the axis, and memory by the spans that are in.
    """

    LEAVES, NONE = 1 << 33, 1 << 62

    def __init__(self) -> None:
        self.own: dict[int, list[int]] = {}
        self.least: dict[int, int] = {}
        self.nodes: dict[int, list[int]] = defaultdict(list)

    def _cover(self, low: int, high: int) -> Iterator[int]:
        lo, hi = low + self.LEAVES + self.LEAVES // 2, high + 1 + self.LEAVES + self.LEAVES // 2
        while lo < hi:
            if lo & 1:
                yield lo
                lo += 1
            if hi & 1:
                hi -= 1
                yield hi
            lo, hi = lo >> 1, hi >> 1

    def _mend(self, node: int) -> None:
        while node:
            heap = self.own.get(node)
            while heap and heap[0] not in self.nodes:
                heappop(heap)
            if heap == []:
                del self.own[node]
            best = min(heap[0] if heap else self.NONE, self.least.get(2 * node, self.NONE), self.least.get(2 * node + 1, self.NONE))
            if best == self.least.get(node, self.NONE):
                return
            if best == self.NONE:
                del self.least[node]
            else:
                self.least[node] = best
            node >>= 1

    def add(self, number: int, low: int, high: int) -> None:
        for node in self._cover(low, high):
            self.nodes[number].append(node)
            heappush(self.own.setdefault(node, []), number)
            self._mend(node)

    def drop(self, number: int) -> None:
        for node in self.nodes.pop(number, ()):
            self._mend(node)

    def first(self, low: int, high: int) -> int | None:
        best = min((self.least.get(node, self.NONE) for node in self._cover(low, high)), default=self.NONE)
        for node in (low + self.LEAVES + self.LEAVES // 2, high + self.LEAVES + self.LEAVES // 2):
            while node:
                if heap := self.own.get(node):
                    best = min(best, heap[0])
                node >>= 1
        return None if best == self.NONE else best
