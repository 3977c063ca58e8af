"""Model-based gap filling and the measured effect of cleaning steps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import half_up
from tablewise.operators.cleaning import apply_suggestions, fill_median
from tablewise.operators.gap_patterns import centre_and_scale, folded, summed, value
from tablewise.operators.learners import fold_scores, make, prepare
from tablewise.operators.measures import col, measure, null_counts, number, numeric_columns, quantiles, report
from tablewise.operators.neighbors import knn, scaled_vectors


def fill_nearest(df: DataFrame, key: str, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Fill a gap with the mean of the k nearest rows that have the value.

    Distances use the other columns, standardised, a missing one at its mean; the k nearest
    are exact. The key must be unique per row.
    """
    columns = list(columns or numeric_columns(df, [key]))
    miss = null_counts(df, columns)
    gaps = [c for c in columns if 0 < miss[c] < miss["*"]]
    out = df
    for c in gaps:
        others = [o for o in columns if o != c]
        stats = measure(df, **{f"{m}{i}": f(number(o)) for i, o in enumerate(others) for m, f in (("a", F.avg), ("s", F.stddev_pop))})
        ask, give = df.where(col(c).isNull()), df.where(col(c).isNotNull())
        near = knn(scaled_vectors(ask, key, others, stats), scaled_vectors(give, key, others, stats), k)
        value = near.join(give.select(F.col(key).cast("long").alias("neighbor"), number(c).alias("_v")), "neighbor").groupBy("id").agg(F.avg("_v").alias("_fill"))
        out = out.join(value.withColumnRenamed("id", "_id"), F.col(key).cast("long") == F.col("_id"), "left").withColumn(c, F.coalesce(number(c), "_fill")).drop("_id", "_fill")
    return fill_median(out, gaps).select(*[col(c) for c in df.columns]) if gaps else df


RIDGE = 1e-6


def chained_fits(table: DataFrame, width: int, gaps: Sequence[int], start: np.ndarray, rounds: int) -> list[tuple[int, np.ndarray]]:
    """The regressions of all rounds in their order: column, and its coefficients (constant first, 0 for the column itself), in standardised units.

    What a row of a pattern is filled with is a linear function of what it has, so a regression needs only the folded table: one sum over it per regression, no scan of the rows.
    """
    fits: list[tuple[int, np.ndarray]] = []
    for _ in range(rounds):
        for c in gaps:
            done = list(fits)

            def products(has: np.ndarray, n: int, factor: np.ndarray, c=c, done=done) -> np.ndarray:
                if c not in has:
                    return np.zeros((width + 1) ** 2)
                full = factor @ filled_from(has, width, start, done).T
                return (full.T @ full).ravel()

            sums = summed(table, width, (width + 1) ** 2, products).reshape(width + 1, width + 1)
            others = [0, *[j + 1 for j in range(width) if j != c]]
            penalty = np.diag([0.0] + [RIDGE * sums[0, 0]] * (width - 1))
            beta = np.zeros(width + 1)
            beta[others] = np.linalg.lstsq(sums[np.ix_(others, others)] + penalty, sums[others, c + 1], rcond=None)[0]
            fits.append((c, beta))
    return fits


def filled_from(has: np.ndarray, width: int, start: np.ndarray, fits: Sequence[tuple[int, np.ndarray]]) -> np.ndarray:
    """The matrix that makes all columns (a constant first) of a row from the constant and the columns it ``has``."""
    out = np.zeros((width + 1, len(has) + 1))
    out[0, 0] = 1.0
    out[1:, 0] = start
    out[has + 1, 0] = 0.0
    out[has + 1, np.arange(len(has)) + 1] = 1.0
    missing = set(range(width)) - set(has.tolist())
    for c, beta in fits:
        if c in missing:
            out[c + 1] = beta @ out
    return out


def fill_iterative(df: DataFrame, columns: Sequence[str] | None = None, rounds: int = 10) -> DataFrame:
    """Chained equations: each column with gaps is predicted from the others, round after round, starting from medians.

    The rows are read to fold them by their pattern of gaps, and once more to be filled; the rounds work on the folded table. A gap is filled by
    the regressions that concern its row, in their order, which each task works out once per pattern. Columns without any value stay empty.
    """
    columns = list(columns or numeric_columns(df))
    miss = null_counts(df, columns)
    columns = [c for c in columns if miss[c] < miss["*"]]
    gaps = sorted((c for c in columns if miss[c]), key=lambda c: (miss[c], c))
    if not gaps:
        return df
    mean, scale = centre_and_scale(df, columns)
    medians = quantiles(df.select(*[value(c).alias(c) for c in gaps]), gaps, [0.5])
    start = np.array([(medians[c][0] - m) / s if c in gaps else 0.0 for c, m, s in zip(columns, mean, scale, strict=True)])
    width, at = len(columns), [columns.index(c) for c in gaps]
    fits = chained_fits(folded(df, columns, mean, scale), width, at, start, rounds)
    flat = df.withColumns({c: value(c) for c in columns})
    place = [flat.columns.index(c) for c in columns]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(i).fill_null(np.nan).to_numpy(zero_copy_only=False) for i in place])
            there = ~np.isnan(x)
            bits = np.packbits(there, axis=1)
            order = np.lexsort(bits.T[::-1])
            first = np.flatnonzero(np.append(True, (bits[order[1:]] != bits[order[:-1]]).any(axis=1)))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                rows = order[lo:hi]
                has = np.flatnonzero(there[rows[0]])
                if len(has) == width:
                    continue
                key = bits[rows[0]].tobytes()
                if key not in known:
                    if len(known) > 10_000:
                        known.clear()
                    gone = np.setdiff1d(np.arange(width), has)
                    known[key] = gone, filled_from(has, width, start, fits)[gone + 1]
                gone, made = known[key]
                given = np.column_stack([np.ones(len(rows)), (x[np.ix_(rows, has)] - mean[has]) / scale[has]])
                x[np.ix_(rows, gone)] = given @ made.T * scale[gone] + mean[gone]
            arrays = [pa.array(x[:, place.index(i)]) if i in place else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return flat.mapInArrow(fill, flat.schema)


def cleaning_impact(df: DataFrame, target: str, key: str, chosen: DataFrame, problem: str = "classification", trees: int = 50, depth: int = 10) -> DataFrame:
    """Fold score of a forest before and after each suggestion."""
    est = make("forest", problem, numTrees=trees, maxDepth=depth, cacheNodeIds=True, checkpointInterval=-1)  # no row goes down its trees again at every level

    def quality(table: DataFrame) -> float:
        keep = [c for c in table.columns if c in (target, key) or c in numeric_columns(table)]
        return float(np.mean(fold_scores(prepare(table.select(*keep).where(col(target).isNotNull()), target, key)[0], est, problem)))

    base, rows = quality(df), []
    for r in chosen.orderBy("id").collect():  # one row per suggestion
        if r["column"] in (target, key):
            continue
        got = quality(apply_suggestions(df, chosen, [r["id"]]))
        rows.append((r["id"], r["type"], r["column"], half_up(base), half_up(got), half_up(got - base), "apply" if got - base >= -0.005 else "skip"))
    return report(df, rows, "id int, type string, column string, before double, after double, change double, advice string")
