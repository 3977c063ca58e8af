"""Decision measures: one wide aggregate per decision, exact quantiles, melting, ranks.

Everything that reaches the driver here is bounded by the number of columns, bins
or buckets, never by the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest number of rows of one column whose distinct values a task may hold for an exact answer.
ROWS_PER_TASK = 1_000_000
# Relative accuracy of the quantile sketches that narrow larger columns.
SKETCH_ACCURACY = 10_000
# Number of aggregate expressions per pass; wider tables take several passes.
EXPRESSIONS_PER_PASS = 400


def numeric_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    skip = set(skip)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    skip = set(skip)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def date_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def col(name: str) -> Column:
    """Column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str) -> Column:
    return col(name).cast("double")


def measure(df: DataFrame, **exprs: Column) -> Row:
    """Evaluate named aggregate expressions in as few passes as the width allows."""
    names = list(exprs)
    out: dict = {}
    for i in range(0, len(names), EXPRESSIONS_PER_PASS):
        part = names[i : i + EXPRESSIONS_PER_PASS]
        out.update(df.agg(*[exprs[n].alias(n) for n in part]).first().asDict())
    return Row(**out)


def task_sums(rows: DataFrame, size: int, own, meet: int = 8) -> np.ndarray:
    """The sum over all batches of ``rows`` of ``own(batch)``, ``size`` numbers: a task adds its batches, ``meet`` tasks add the tasks' sums, and the driver gets ``meet`` rows."""

    def add(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += own(b)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def join(batches):
        total = np.zeros(size)
        for b in batches:
            for blob in b.column(0).to_pylist():
                total += np.frombuffer(blob)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    met = rows.mapInArrow(add, "sums binary").repartition(meet).mapInArrow(join, "sums binary").collect()
    return np.sum([np.frombuffer(r["sums"]) for r in met], axis=0)


def report(df: DataFrame, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A small report frame in the session of ``df``."""
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], schema)


def melt(df: DataFrame, columns: Sequence[str], kind: str = "double", keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep..., column, value); nulls are kept."""
    return df.select(
        *[col(k) for k in keep],
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast(kind).alias("value")) for c in columns])
        ).alias("_cell"),
    ).select(*[col(k) for k in keep], "_cell.column", "_cell.value")


def null_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    row = measure(df, **{f"m{i}": F.count_if(col(c).isNull()) for i, c in enumerate(columns)}, n=F.count("*"))
    return {c: row[f"m{i}"] for i, c in enumerate(columns)} | {"*": row["n"]}


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact distinct non-null counts of all columns: one melted two-step aggregate.

    Values are deduplicated map-side first, so a hot value costs one row per task.
    """
    if not columns:
        return {}
    cells = melt(df, columns, "string").where("value is not null").distinct()
    got = {r["column"]: r["n"] for r in cells.groupBy("column").agg(F.count("*").alias("n")).collect()}
    return {c: got.get(c, 0) for c in columns}


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of the non-null values of several columns."""
    return melt(df, columns, "string").where("value is not null").groupBy("column", "value").agg(
        F.count("*").alias("n")
    )


def top_values(freq: DataFrame, k: int) -> DataFrame:
    """The k most frequent values per column with their rank, ties by value.

    The rank filter is pushed below the shuffle (window group limit), so a
    high-cardinality column ships at most k rows per task.
    """
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column, lowest value on ties, as text."""
    if not columns:
        return {}
    best = frequencies(df, columns).groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("b")
    )
    got = {r["column"]: r["b"]["value"] for r in best.collect()}
    return {c: got.get(c) for c in columns}


def quantiles(
    df: DataFrame, columns: Mapping[str, Column] | Sequence[str], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles of several columns.

    A task never holds more than ROWS_PER_TASK values of all columns together: columns within their share of that use the exact aggregate. Larger ones
    are narrowed: a sketch per column gives brackets around its wanted ranks, a count places
    them, and a bracket is sketched again until its values are within their share too. Each round is one pass for all columns and ranks.
    """
    if not isinstance(columns, Mapping):
        columns = {c: number(c) for c in columns}
    if not columns:
        return {}
    names = list(columns)
    # NaN is a missing value here, as everywhere in this package
    cols = {c: F.nanvl(columns[c].cast("double"), F.lit(None).cast("double")) for c in names}
    counts = measure(df, **{f"n{i}": F.count(cols[c]) for i, c in enumerate(names)})
    n = {c: counts[f"n{i}"] for i, c in enumerate(names)}
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in names}
    share = ROWS_PER_TASK // len(names)
    small = [c for c in names if 0 < n[c] <= share]
    if small:
        grid = F.array(*[F.lit(float(p)) for p in probs])
        got = measure(df, **{f"q{i}": F.percentile(cols[c], grid) for i, c in enumerate(small)})
        for i, c in enumerate(small):
            out[c] = list(got[f"q{i}"])
    large = [c for c in names if n[c] > share]
    if large:
        _narrowed_quantiles(df, {c: cols[c] for c in large}, n, probs, out)
    return out


def _narrowed_quantiles(df, cols, n, probs, out) -> None:
    # open: (column, prob index) -> [lo, hi, rows below lo, rows inside]
    open_ = {(c, j): [None, None, 0, n[c]] for c in cols for j in range(len(probs))}
    for _ in range(12):
        if not open_:
            return
        share, eps = ROWS_PER_TASK // len(open_), 2.0 / SKETCH_ACCURACY
        asked: dict[tuple, list] = {}  # ranks of one bracket come from one aggregate
        for (c, j), (lo, hi, below, inside) in open_.items():
            asked.setdefault((c, lo, hi, below, inside), []).append(j)
        exprs = {}
        for i, ((c, lo, hi, below, inside), js) in enumerate(asked.items()):
            x = cols[c] if lo is None else F.when(cols[c].between(lo, hi), cols[c])
            at = [min(1.0, max(0.0, (probs[j] * (n[c] - 1) - below) / max(1, inside - 1))) for j in js]
            if inside <= share:
                exprs[f"k{i}"] = F.percentile(x, F.array(*[F.lit(f) for f in at]))
            else:
                exprs[f"k{i}"] = F.percentile_approx(x, [g for f in at for g in (max(0.0, f - eps), min(1.0, f + eps))], SKETCH_ACCURACY)
        got = measure(df, **exprs)
        trial = {}
        for i, ((c, _, _, _, inside), js) in enumerate(asked.items()):
            for k, j in enumerate(js):
                if inside <= share:
                    out[c][j] = got[f"k{i}"][k]
                    del open_[c, j]
                else:
                    trial[c, j] = got[f"k{i}"][2 * k : 2 * k + 2]
        if not trial:
            return
        exprs = {}
        for i, ((c, _j), (lo, hi)) in enumerate(trial.items()):
            exprs[f"b{i}"] = F.count_if(cols[c] < lo)
            exprs[f"w{i}"] = F.count_if(cols[c].between(lo, hi))
        placed = measure(df, **exprs)
        for i, ((c, j), (lo, hi)) in enumerate(trial.items()):
            below, inside = placed[f"b{i}"], placed[f"w{i}"]
            pos = probs[j] * (n[c] - 1)
            if lo == hi and below <= pos <= below + inside - 1:
                out[c][j] = lo
                del open_[c, j]
            elif below <= pos and pos <= below + inside - 1:
                open_[c, j] = [lo, hi, below, inside]
            else:
                # the rank lies in the gap next to the bracket: widen on that side
                old = open_[c, j]
                open_[c, j] = [old[0] if pos < below else lo, old[1] if pos >= below else hi, old[2], old[3]]
                wide = open_[c, j]
                lo_, hi_ = wide[0], wide[1]
                x = cols[c]
                low = F.lit(True) if lo_ is None else x >= lo_
                high = F.lit(True) if hi_ is None else x <= hi_
                fix = measure(
                    df,
                    b=F.count_if(~low) if lo_ is not None else F.lit(0).cast("long"),
                    w=F.count_if(low & high & x.isNotNull()),
                    lo=F.min(F.when(low & high, x)),
                    hi=F.max(F.when(low & high, x)),
                )
                open_[c, j] = [fix["lo"], fix["hi"], fix["b"], fix["w"]]
    for c, j in list(open_):  # heavy ties keep the last brackets wide: few distinct values, exact is safe
        lo, hi, below, inside = open_[c, j]
        f = (probs[j] * (n[c] - 1) - below) / max(1, inside - 1)
        out[c][j] = measure(df, v=F.percentile(F.when(cols[c].between(lo, hi), cols[c]), F.lit(f)))["v"]


def correlation(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson correlation; null instead of an error when a side is constant."""
    a, b = a.cast("double"), b.cast("double")
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """Pairwise-complete Pearson correlation of every pair a before b; null where a side is constant.

    Every task sums masked products of its standardised rows and passes them on by matrix row, so neither the plan
    nor a task grows with the number of pairs beyond these sums.
    """
    width = len(columns)
    if width < 2:
        return {}
    got = measure(df, **{f"{k}{i}": f(number(c).cast("double")) for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))})
    mean = np.array([got[f"m{i}"] or 0.0 for i in range(width)], float)
    scale = np.array([got[f"s{i}"] or 1.0 for i in range(width)], float)

    def own(batches):
        total = np.zeros((width, 4, width))  # by column a: rows with both, sums of a, of a squared, and of a times b
        for b in batches:
            there = np.stack([x.is_valid().to_numpy(zero_copy_only=False) for x in b.columns], axis=1).astype(float)
            x = np.stack([v.fill_null(0).to_numpy(zero_copy_only=False) for v in b.columns], axis=1)
            x = np.where(there > 0, (x - mean) / scale, 0.0)
            total += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x], axis=1)
        yield pa.record_batch([pa.array(np.arange(width)), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "sums"])

    def add(batches):
        total = {}
        for b in batches:
            for i, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(sums)
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["i", "sums"])

    shape = "i long, sums binary"
    rows = df.select(*[number(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(own, shape)
    sums = np.zeros((width, 4, width))
    for r in rows.repartition("i").mapInArrow(add, shape).collect():  # one row per column
        sums[r["i"]] = np.frombuffer(r["sums"]).reshape(4, width)
    both, first, square, product = sums.transpose(1, 0, 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = square / both - (first / both) ** 2
        r = (product / both - first * first.T / both**2) / np.sqrt(spread * spread.T)
    r[~((spread > 1e-13) & (spread.T > 1e-13))] = np.nan
    return {(a, b): None if np.isnan(r[i, j]) else float(r[i, j]) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j}


def pick(value: Column, options: Sequence, none=None) -> Column:
    """options[value] as a balanced tree of comparisons (value is an integer column)."""
    if not options:
        return F.lit(none)

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(options[lo])
        mid = (lo + hi) // 2
        return F.when(value < mid, tree(lo, mid)).otherwise(tree(mid, hi))

    return tree(0, len(options))


def bins_right_closed(value: Column, edges: Sequence[float]) -> Column:
    """Bin number of a value among right-closed bins; the first bin includes its left edge."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    if len(edges) < 2:
        return out
    out = out.when((value < edges[0]) | (value > edges[-1]), F.lit(None).cast("int"))
    for i, e in enumerate(edges[1:]):
        out = out.when(value <= e, F.lit(i))
    return out


def histogram(df: DataFrame, bounds: Mapping[str, tuple[float, float, int]]) -> DataFrame:
    """Equal-width histograms (column, bin, n, lo, hi), empty bins included.

    ``bounds`` maps a column to (min, max, bins). The last bin includes the maximum.
    """
    spark = df.sparkSession
    cells = []
    frame = []
    for c, (lo, hi, k) in bounds.items():
        width = (hi - lo) / k if hi > lo else 1.0
        x = number(c)
        b = F.least(F.floor((x - lo) / width), F.lit(k - 1)).cast("int")
        cells.append(F.struct(F.lit(c).alias("column"), F.when(x.isNotNull(), b).alias("bin")))
        frame += [(c, i, lo + i * width, lo + (i + 1) * width) for i in range(k)]
    counts = (
        df.select(F.explode(F.array(*cells)).alias("x"))
        .select("x.*")
        .where("bin is not null")
        .groupBy("column", "bin")
        .agg(F.count("*").alias("n"))
    )
    empty = spark.createDataFrame(frame, "column string, bin int, lo double, hi double")
    return empty.join(counts, ["column", "bin"], "left").select(
        "column", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "lo", "hi"
    )


def hash_uniform(*parts: Column | str | int) -> Column:
    """A repeatable uniform number in [0, 1) from a key and a seed.

    It depends on the values only, so a lost executor recomputes the same number.
    """
    text = F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, int) else (col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def hash_normal(*parts: Column | str | int) -> Column:
    """A repeatable standard normal number from a key and a seed (Box-Muller)."""
    u, v = hash_uniform(*parts, 101), hash_uniform(*parts, 211)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def order_number(df: DataFrame, name: str) -> Column:
    """A date, time or number as a number that sorts the same way."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(col(name)).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col(name).cast("timestamp"))
    return col(name)


def over_rows(
    df: DataFrame, by: Sequence[str], order: str, make, back: int = 0, ahead: int = 0, tie: str | None = None
) -> DataFrame:
    """Add window columns whose frames reach at most ``back`` rows back and ``ahead`` rows ahead.

    ``make(window)`` gives {name: Column}. A small table is one window per group. A large
    one is cut into blocks of ROWS_PER_TASK positions; the rows at a block's edge are
    copied to its neighbour, so a series of any length is spread over many tasks.
    """
    key = order_number(df, order)
    if df.count() <= ROWS_PER_TASK:
        w = Window.partitionBy(*by).orderBy(key, *([tie] if tie else []))
        return df.withColumns(make(w))
    size = max(ROWS_PER_TASK, 2 * (back + ahead) + 1)
    data = positions(df.withColumn("_key", key), by, "_key", "_pos", tie)
    own = F.floor(F.col("_pos") / size)
    copies = [own, F.when(F.col("_pos") % size >= size - back, own + 1), F.when(F.col("_pos") % size < ahead, own - 1)]
    data = data.withColumn("_own", own).withColumn("_block", F.explode(F.array_compact(F.array(*copies))))
    w = Window.partitionBy(*by, "_block").orderBy("_pos")
    return data.withColumns(make(w)).where("_block = _own").drop("_key", "_pos", "_own", "_block")


def bucketed(df: DataFrame, order: str, into: str, rows: int | None = None) -> tuple[DataFrame, int]:
    """Add an integer range bucket of a numeric column holding about ROWS_PER_TASK rows each."""
    rows = df.count() if rows is None else rows
    parts = -(-rows // ROWS_PER_TASK)
    if parts <= 1:
        return df.withColumn(into, F.lit(0)), 1
    probs = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(col(order).cast("double"), probs, max(SKETCH_ACCURACY, 4 * parts))).first()[0]
    frequent = {a for a, b in zip(found, found[1:]) if a == b}  # values that fill a bucket get one of their own
    edges = sorted({*found, *(float(np.nextafter(v, np.inf)) for v in frequent)})
    splits = [-float("inf"), *edges, float("inf")]
    x = df.withColumn("_x", col(order).cast("double"))
    out = Bucketizer(splits=splits, inputCol="_x", outputCol="_b", handleInvalid="keep").transform(x)
    return out.withColumn(into, col("_b").cast("int")).drop("_x", "_b"), len(splits) - 1


def running_sums(
    df: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, str], descending: bool = False
) -> DataFrame:
    """Inclusive running sums over ``order`` within ``by``, without one task per group.

    ``df`` should be pre-aggregated to one row per (by, order). Rows go to range
    buckets; bucket totals are summed over the buckets before (at most one row per
    group and bucket) and added to the running sums inside each bucket.
    """
    data, parts = bucketed(df, order, "_bucket")
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    rng = (Window.unboundedPreceding, 0)
    inner = Window.partitionBy(*by, "_bucket").orderBy(way(order)).rowsBetween(*rng)
    if parts == 1:
        return data.select("*", *[F.sum(c).over(inner).alias(o) for o, c in sums.items()]).drop("_bucket")
    totals = data.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(way("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_bucket", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums]
    )
    on = [*by, "_bucket"]
    return (
        data.select("*", *[F.sum(c).over(inner).alias(f"_r_{o}") for o, c in sums.items()])
        .join(offsets, on)
        .select(*df.columns, *[(F.col(f"_r_{o}") + F.col(f"_o_{o}")).alias(o) for o in sums])
    )


#: Parts into which a bucket of a single order value is cut.
CROWD_PARTS = 100


def uncrowded(data: DataFrame, order: str, tie: str | None) -> DataFrame:
    """Cut buckets that are too large though they hold one order value only: by ranges of a numeric tie column, or by hash without one."""
    numeric = tie is None or isinstance(data.schema[tie].dataType, T.NumericType)
    if not numeric:
        return data
    x = col(tie).cast("double") if tie else F.pmod(F.xxhash64(*data.columns), F.lit(1 << 30)).cast("double")
    probs = [i / CROWD_PARTS for i in range(1, CROWD_PARTS)]
    stats = data.withColumn("_x", x).groupBy("_bucket").agg(
        F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi"), F.percentile_approx("_x", probs, SKETCH_ACCURACY).alias("edges"))
    crowded = stats.where((F.col("n") > ROWS_PER_TASK) & F.col("lo").eqNullSafe(F.col("hi"))).select("_bucket", "edges").collect()  # one row per bucket at most
    if not crowded:
        return data
    edges = F.create_map(*[v for r in crowded for v in (F.lit(r["_bucket"]), F.array(*[F.lit(e) for e in sorted(set(r["edges"]))]))])
    part = F.size(F.filter(F.try_element_at(edges, F.col("_bucket")), lambda e: e < x))
    return data.withColumn("_bucket", F.col("_bucket") * CROWD_PARTS + F.greatest(part, F.lit(0)))


def positions(df: DataFrame, by: Sequence[str], order: str, into: str = "pos", tie: str | None = None) -> DataFrame:
    """0-based position of each row within its group by a numeric order.

    Hot groups are split by ranges of the order, and a hot order value by ranges of a numeric tie column.
    """
    data, parts = bucketed(df, order, "_bucket")
    data = uncrowded(data, order, tie) if parts > 1 else data
    keys = [F.asc(order)] + ([F.asc(tie)] if tie else [])
    inner = Window.partitionBy(*by, "_bucket").orderBy(*keys)
    data = data.withColumn("_rn", F.row_number().over(inner) - 1)
    if parts == 1:
        return data.withColumn(into, F.col("_rn").cast("long")).drop("_rn", "_bucket")
    totals = data.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        data.join(offsets, [*by, "_bucket"])
        .withColumn(into, (F.col("_rn") + F.col("_off")).cast("long"))
        .drop("_rn", "_off", "_bucket")
    )


def smallest_per_group(df: DataFrame, by: Sequence[str], order: str, tie: str, quota: DataFrame) -> DataFrame:
    """Rows with the ``quota.take`` smallest values of a uniform [0, 1) column in each group.

    Rows are counted per (group, slice of the unit interval); whole slices are kept
    or dropped, and only the slice holding the cut is ranked row by row.
    """
    rows = df.count()
    parts = max(1, -(-rows // ROWS_PER_TASK)) * 4 if rows > ROWS_PER_TASK else 1
    data = df.withColumn("_slice", F.least(F.floor(F.col(order) * parts), F.lit(parts - 1)).cast("int"))
    key = [F.col(c) for c in by]
    counts = data.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(*key, "_slice", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    cut = placed.join(quota, list(by)).select(*by, "_slice", (F.col("take") - F.col("_before")).alias("_left"))
    within = Window.partitionBy(*by, "_slice").orderBy(order, tie)
    return (
        data.join(cut, [*by, "_slice"])
        .where("_left > 0")
        .withColumn("_rn", F.row_number().over(within))
        .where("_rn <= _left")
        .select(*df.columns)
    )


def smallest_rows(df: DataFrame, order: str, tie: str, take: int) -> DataFrame:
    """The ``take`` rows with the smallest values of a uniform [0, 1) column, of any number, without a global sort."""
    quota = report(df, [(0, int(take))], "_all int, take long")
    return smallest_per_group(df.withColumn("_all", F.lit(0)), ["_all"], order, tie, quota).drop("_all")
