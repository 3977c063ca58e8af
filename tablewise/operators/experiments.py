"""Lists, comparisons, leaderboards and annotations over experiment tables."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.moments import half_up, rounded
from tablewise.operators.measures import bucketed, col, frequencies, measure, number, positions, report, top_values
from tablewise.operators.profile import kind_of

SORTABLE = ("created_at", "updated_at", "name", "best_score", "score", "status", "id")


def list_experiments(df: DataFrame, limit: int = 50, offset: int = 0, search: str | None = None, columns: Sequence[str] = ("name",),
                     tag: str | None = None, sort_by: str = "created_at", descending: bool = True, key: str = "id") -> DataFrame:
    """Filtered, sorted page of experiments with the total number of matches."""
    if search:
        cond = F.lit(False)
        for c in columns:
            cond = cond | F.lower(col(c)).contains(search.lower())
        df = df.where(cond)
    if tag:
        df = df.where(F.array_contains("tags", tag))
    if sort_by not in SORTABLE:
        raise ValueError(f"cannot sort by {sort_by}")
    total = df.count()
    order = F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by)
    return df.orderBy(order, key).offset(offset).limit(limit).withColumn("total", F.lit(total).cast("long"))


def with_models(experiments: DataFrame, models: DataFrame, key: str = "id") -> DataFrame:
    """Each experiment with one row per model, ranked best first (rows, not a list, so no group is gathered)."""
    ranked = positions(models.withColumn("_neg", -number("primary_metric")), ["experiment_id"], "_neg", "_pos", "model_name")
    ranked = ranked.withColumn("model_rank", F.col("_pos") + 1).drop("_neg", "_pos").withColumnRenamed("experiment_id", key)
    return experiments.join(ranked, key)


def with_steps(experiments: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Each experiment with one row per stored step result."""
    return experiments.join(results.select(F.col("experiment_id").alias(key), "step", "result_data", F.col("created_at").alias("step_at")), key, "left")


def newest_of_session(experiments: DataFrame) -> DataFrame:
    return experiments.groupBy("session_id").agg(F.max_by(F.struct(*experiments.columns), F.struct("created_at", "id")).alias("r")).select("r.*")


def compare_values(long: DataFrame, first, second, key: str = "id") -> DataFrame:
    """Two experiments side by side from (id, name, value) rows: difference, winner and rank on each side."""
    pair = long.where(col(key).isin([first, second])).groupBy("name").agg(
        F.max(F.when(col(key) == first, F.col("value"))).alias("a"), F.max(F.when(col(key) == second, F.col("value"))).alias("b"))
    rank = lambda c: F.when(F.col(c).isNotNull(), F.rank().over(Window.orderBy(F.desc_nulls_last(c))))  # noqa: E731 - one row per measure name
    return pair.select(
        "name", "a", "b", rounded(F.col("b") - F.col("a")).alias("delta"),
        F.when(F.col("a") > F.col("b"), F.lit(str(first))).when(F.col("b") > F.col("a"), F.lit(str(second))).otherwise("tie").alias("winner"),
        rank("a").cast("int").alias("rank_a"), rank("b").cast("int").alias("rank_b"))


def changed_parameters(models: DataFrame, first, second, key: str = "id", params: str = "hyperparameters") -> DataFrame:
    """Parameters whose value differs between two experiments."""
    long = models.where(col(key).isin([first, second])).select(key, F.explode(params).alias("name", "value"))
    return long.groupBy("name").agg(F.max(F.when(col(key) == first, F.col("value"))).alias("a"), F.max(F.when(col(key) == second, F.col("value"))).alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))


def statistics(df: DataFrame, score: str = "score") -> DataFrame:
    """Total, complete and mean best score over all and per problem type."""
    measures = [F.count("*").alias("total"), F.count_if(F.col("status") == "complete").alias("complete"), rounded(F.avg(score)).alias("mean_score")]
    return df.agg(*measures).select(F.lit("all").alias("problem_type"), "*").union(df.groupBy("problem_type").agg(*measures))


def leaderboard(df: DataFrame, score: str = "score", key: str = "id", limit: int = 20, where=None) -> DataFrame:
    """The best rows by score with their rank; the rank is taken on the cut list only."""
    top = (df if where is None else df.where(where)).orderBy(F.desc_nulls_last(score), key).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), F.asc(key))))


def latest_submission(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row per experiment: the newest submission."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), version).alias("r")).select(key, "r.*")


def standing(df: DataFrame, group: str, score: str = "score", key: str = "id") -> DataFrame:
    """Rank, percentile and gap to the top within a group; equal scores rank by ``key``.

    Rows are ranked in range buckets, so a group of any size is spread over tasks.
    """
    data = positions(df.withColumn("_neg", -number(score)), [group], "_neg", "_pos", key)
    whole = df.groupBy(group).agg(F.count("*").alias("n"), F.max(score).alias("top"))
    return data.join(whole, group).select(
        key, group, score, (F.col("_pos") + 1).alias("rank"), "n", rounded(100.0 * (F.col("n") - F.col("_pos") - 1) / F.col("n"), 2).alias("percentile"),
        rounded(F.col("top") - F.col(score)).alias("gap"))


def annotation_summary(annotations: DataFrame) -> DataFrame:
    """Counts by label and accuracy per experiment."""
    c = lambda v: F.count_if(F.col("label") == v)
    return annotations.groupBy("experiment_id").agg(F.count("*").alias("total"), c("correct").alias("correct"), c("incorrect").alias("incorrect"), c("uncertain").alias("uncertain")).select(
        "*", rounded(F.try_divide(F.col("correct"), F.col("correct") + F.col("incorrect"))).alias("accuracy"))


def annotations_newest_first(annotations: DataFrame, limit: int = 100) -> DataFrame:
    return annotations.orderBy(F.desc("created_at"), "id").limit(limit)


def failure_patterns(rows: DataFrame, wrong: DataFrame, key: str, features: Sequence[str], top: int | None = None, limit: int | None = None) -> DataFrame:
    """Features that set the rows marked wrong apart: mean shift over 1.5 stds, or a category 1.5 times as common.

    Of each text column the ``top`` most frequent values of the wrong rows count, and the first ``limit`` findings are kept, if given.
    """
    bad = rows.join(wrong.select(key).distinct(), key, "left_semi")
    nums = [c for c in features if kind_of(rows, c) == "numeric"]
    texts = [c for c in features if c not in nums]
    out = []
    if nums:
        a = measure(rows, **{f"{k}{i}": f(number(c)) for i, c in enumerate(nums) for k, f in (("a", F.avg), ("s", F.stddev_samp))})
        b = measure(bad, **{f"a{i}": F.avg(number(c)) for i, c in enumerate(nums)})
        for i, c in enumerate(nums):
            if a[f"s{i}"] and b[f"a{i}"] is not None:
                z = abs(b[f"a{i}"] - a[f"a{i}"]) / a[f"s{i}"]
                if z > 1.5:
                    out.append((c, "value_cluster", None, half_up(z, 2)))
    if texts:
        total, n_bad = rows.count(), bad.count()
        fa = frequencies(rows, texts)
        fb = frequencies(bad, texts) if top is None else top_values(frequencies(bad, texts), top)
        both = fb.select("column", "value", F.col("n").alias("nb")).join(fa, ["column", "value"]).select(
            "column", "value", (F.col("nb") / max(1, n_bad)).alias("pb"), (F.col("n") / total).alias("pa"))
        for r in both.where("pb > 1.5 * pa and pb > 0.2").collect():  # above a share of 0.2, so at most 5 per column
            out.append((r["column"], "category_cluster", r["value"], half_up(r["pb"] / max(r["pa"], 0.01), 2)))
    out.sort(key=lambda r: (-r[3], r[0]))
    return report(rows, out[:limit], "feature string, kind string, value string, strength double")


def pareto_front(df: DataFrame, better: str, cheaper: str, key: str = "id") -> DataFrame:
    """Rows no other row beats: at least as good on both measures and better on one.

    The best value per cost is enough: a row is dominated when a cheaper or equal cost
    reaches a better or equal value, so the running best over the distinct costs decides.
    """
    best = df.groupBy(number(cheaper).alias("c")).agg(F.max(number(better)).alias("top"))
    data, _ = bucketed(best, "c", "_b")
    tops = data.groupBy("_b").agg(F.max("top").alias("_t"))
    before = tops.select("_b", F.max("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # one row per bucket
    inner = Window.partitionBy("_b").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    front = data.withColumn("_in", F.max("top").over(inner)).join(before, "_b").select("c", "top", F.greatest("_in", "_before").alias("_prev"))
    keep = front.where("_prev is null or top > _prev").select("c", "top")
    return df.join(keep, (number(cheaper) == F.col("c")) & (number(better) == F.col("top"))).select(*[df[x] for x in df.columns])


def local_front(points: np.ndarray) -> np.ndarray:
    """The rows of an (n, 3) array that no other row beats, larger being better, without repeats.

    Sorted by the first measure, a row can only be beaten by one before it: the best third measure so far at
    a second measure as large or larger decides, kept as a staircase that rises in one as it falls in the other.
    """
    points = np.unique(points, axis=0)[::-1]
    seconds, thirds, kept = [], [], []  # seconds rise, thirds fall
    for i, (_, y, z) in enumerate(points.tolist()):
        at = bisect_left(seconds, y)
        if at < len(seconds) and thirds[at] >= z:
            continue
        kept.append(i)
        low = at
        while low > 0 and thirds[low - 1] <= z:
            low -= 1
        high = at + (at < len(seconds) and seconds[at] == y)
        seconds[low:high], thirds[low:high] = [y], [z]
    return points[kept]


def skyline(df: DataFrame, better: Sequence[str], cheaper: Sequence[str], fan: int = 16) -> DataFrame:
    """Rows no other row beats in up to three measures: as good in all and better in one.

    ``better`` holds columns of which more is better, ``cheaper`` those of which less is. Equal points stay
    together. Each task sends only the front of its own points; fronts are merged ``fan`` at a time until one
    is left, which the last task holds. Rows with a null or NaN measure take no part.
    """
    signs = [(c, 1.0) for c in better] + [(c, -1.0) for c in cheaper]
    if not 1 <= len(signs) <= 3:
        raise ValueError("one to three measures")
    given = [number(c) * sign for c, sign in signs]
    cells = [g.alias(f"_m{i}") for i, g in enumerate(given)] + [F.lit(0.0).alias(f"_m{i}") for i in range(len(given), 3)]
    usable = reduce(and_, [g.isNotNull() & ~F.isnan(g) for g in given])

    def fronts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.empty((0, 3))
        for b in batches:
            best = local_front(np.concatenate([best, b.to_numpy(float)]))
        yield pd.DataFrame(best, columns=["_m0", "_m1", "_m2"])

    schema = "_m0 double, _m1 double, _m2 double"
    points = df.where(usable).select(*cells)
    left = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    front = points.mapInPandas(fronts, schema)
    while True:
        left = -(-left // fan)
        front = front.repartition(left, "_m0", "_m1", "_m2").mapInPandas(fronts, schema)
        if left == 1:
            break
    same = reduce(and_, [g == F.col(f"_m{i}") for i, g in enumerate(given)])
    return df.join(front, same, "left_semi")
