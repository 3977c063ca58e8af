"""Rows folded by their pattern of missing values, and sums over the folded table.

Methods for tables with gaps (maximum-likelihood covariances, chained regressions) need, of all rows that miss the same
columns, only the products of the columns they have. A pattern is a bit set; its rows are kept as they are until there are more of them than columns, and from then on as the
triangular factor that has the same products. So the folded table is never larger than the rows, whatever the number of patterns, and a pattern that a third of all rows
share is one small matrix per task before it is shuffled. Patterns never reach the driver: each pass sums over them by partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.operators.measures import measure, number, task_sums
from tablewise.session import cut_lineage

#: Numbers that a task holds before it sends what it has folded.
HELD = 4_000_000
FOLDED = "pattern binary, n long, factor binary"


def value(name: str) -> Column:
    """A column as a number; not-a-number is a gap too."""
    return F.when(~F.isnan(number(name)), number(name))


def centre_and_scale(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each column; 0 and 1 where there is none."""
    row = measure(df, **{f"{k}{i}": f(value(c)) for i, c in enumerate(columns) for k, f in (("a", F.avg), ("s", F.stddev_pop))})
    mean = np.array([row[f"a{i}"] or 0.0 for i in range(len(columns))], float)
    scale = np.array([row[f"s{i}"] or 1.0 for i in range(len(columns))], float)
    return mean, scale


def factor(rows: np.ndarray) -> np.ndarray:
    """A matrix of no more rows than columns (two more at most) with the same products."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] + 2 else rows


class _Folds:
    """Matrices by pattern; columns are a constant and those that the pattern has."""

    def __init__(self) -> None:
        self.parts: dict[bytes, list] = {}
        self.held = 0

    def add(self, pattern: bytes, n: int, rows: np.ndarray) -> None:
        old = self.parts.get(pattern)
        if old is not None:
            self.held -= old[1].size
            n, rows = n + old[0], np.vstack([old[1], rows])
        if len(rows) > 2 * rows.shape[1] + 2:
            rows = factor(rows)
        self.parts[pattern] = [n, rows]
        self.held += rows.size

    def sent(self) -> Iterator[pa.RecordBatch]:
        items = list(self.parts.items())
        self.parts, self.held = {}, 0
        for lo in range(0, len(items), 2000):
            part = items[lo : lo + 2000]
            columns = [pa.array([p for p, _ in part], pa.binary()), pa.array([n for _, (n, _) in part], pa.int64()), pa.array([factor(r).tobytes() for _, (_, r) in part], pa.binary())]
            yield pa.record_batch(columns, ["pattern", "n", "factor"])


def present(pattern: bytes, width: int) -> np.ndarray:
    """Numbers of the columns that a pattern has."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(pattern, np.uint8), count=width))


def folded(df: DataFrame, columns: Sequence[str], mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """One row per pattern: which ``columns`` it has, its number of rows, and their factor, standardised by ``mean`` and ``scale``; checkpointed."""
    width = len(columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds = _Folds()
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(i).fill_null(np.nan).to_numpy(zero_copy_only=False) for i in range(width)])
            there = ~np.isnan(x)
            x = (x - mean) / scale
            bits = np.packbits(there, axis=1)
            order = np.lexsort(bits.T[::-1])
            first = np.flatnonzero(np.append(True, (bits[order[1:]] != bits[order[:-1]]).any(axis=1)))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                at = order[lo:hi]
                own = there[at[0]]
                folds.add(bits[at[0]].tobytes(), hi - lo, np.column_stack([np.ones(hi - lo), x[np.ix_(at, own)]]))
            if folds.held > HELD:
                yield from folds.sent()
        yield from folds.sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds, last = _Folds(), None  # patterns come in order
        for b in batches:
            for pattern, n, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if pattern != last and folds.held > HELD // 8:
                    yield from folds.sent()
                last = pattern
                folds.add(pattern, n, np.frombuffer(blob).reshape(-1, len(present(pattern, width)) + 1))
        yield from folds.sent()

    rows = df.select(*[value(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return cut_lineage(rows.mapInArrow(fold, FOLDED).repartition("pattern").sortWithinPartitions("pattern").mapInArrow(merge, FOLDED))


def summed(table: DataFrame, width: int, size: int, own: Callable[[np.ndarray, int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all patterns of ``own(columns it has, number of rows, factor)``, ``size`` numbers; each task adds its patterns."""

    def of(b: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(size)
        for pattern, n, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            has = present(pattern, width)
            total += own(has, n, np.frombuffer(blob).reshape(-1, len(has) + 1))
        return total

    return task_sums(table, size, of)
