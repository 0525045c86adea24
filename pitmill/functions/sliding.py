"""Ranks within sliding windows by a sorted window: two binary searches a row, no list a row."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class SortedWindow:
    """The last ``n`` values of a series, in order of time and of size; missing ones take a place in time only."""

    def __init__(self, n: int):
        self.n, self.times, self.sizes = n, deque(), []

    def push(self, value: float | None) -> None:
        self.times.append(value)
        if value is not None:
            insort(self.sizes, value)
        if len(self.times) > self.n:
            gone = self.times.popleft()
            if gone is not None:
                del self.sizes[bisect_left(self.sizes, gone)]

    def percentile(self, value: float) -> float:
        """100 times the mean rank of ``value``, which is in the window, over the number of values."""
        below, upto = bisect_left(self.sizes, value), bisect_right(self.sizes, value)
        return (below + (upto - below + 1) / 2) / len(self.sizes) * 100


def with_sliding_percentiles(rows: DataFrame, by: str | None, order: str, places: Mapping[str, tuple[str, bool]], n: int, least: int) -> DataFrame:
    """``rows`` with, for each of ``places`` (name -> (column, whether low values rank high)), the percentile of the row's value among the last ``n`` rows.

    One pass over each series in order; only its window is kept. Null where the row
    has no value or the window fewer than ``least`` values. Without ``by`` the rows are one series.
    """
    columns = list(places.values())
    index, at = rows.columns.index(by) if by else None, [rows.columns.index(c) for c, _ in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, windows = object(), []
        for batch in batches:
            keys = batch.column(index).to_pylist() if by else [None] * batch.num_rows
            values = [batch.column(k).to_pylist() for k in at]
            out: list[list] = [[] for _ in columns]
            for i, key in enumerate(keys):
                if key != current:
                    current, windows = key, [SortedWindow(n) for _ in columns]
                for k, (window, (_, low)) in enumerate(zip(windows, columns, strict=True)):
                    v = values[k][i]
                    v = None if v is None or v != v else -float(v) if low else float(v)
                    window.push(v)
                    out[k].append(window.percentile(v) if v is not None and len(window.sizes) >= least else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(o, pa.float64()) for o in out)], [*batch.schema.names, *places])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(name, T.DoubleType()) for name in places)])
    ordered = rows.repartition(by).sortWithinPartitions(by, order) if by else rows.repartition(1).sortWithinPartitions(order)
    return ordered.mapInArrow(run, schema)
