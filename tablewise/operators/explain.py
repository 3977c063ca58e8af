"""Explaining fitted models: contributions, what-if, counterfactuals, dependence, interactions, reviews.

Features travel as one array column ``vec``; a changed copy of a row is an expression over it,
so every question is one exploded frame and one ``transform``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.base import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import half_up, rounded
from tablewise.operators.learners import class_one, importance, with_vector
from tablewise.operators.measures import correlation, hash_uniform, measure, quantiles, report
from tablewise.operators.neighbors import knn


def answer(model: Model, df: DataFrame, problem: str, into: str = "out") -> DataFrame:
    """Add the model output: probability of class 1, or the predicted number."""
    pred = model.transform(df)
    return pred.withColumn(into, class_one(pred, problem).cast("double")).drop("rawPrediction", "probability", "prediction")


def vector_stats(data: DataFrame, width: int, *fns) -> list[list[float]]:
    """The given aggregates of every vector element, in one pass."""
    row = measure(data, **{f"f{k}_{i}": f(F.col("vec")[i]) for k, f in enumerate(fns) for i in range(width)})
    return [[row[f"f{k}_{i}"] for i in range(width)] for k in range(len(fns))]


def replaced(j: Column | int, value: Column) -> Column:
    """The vector with element j set to a value."""
    return F.transform("vec", lambda x, i: F.when(i == j, value).otherwise(x))


def linear_contributions(data: DataFrame, coefficients: Sequence[float], features: Sequence[str]) -> DataFrame:
    """(id, feature, contribution): coefficient times distance from the mean."""
    mean = vector_stats(data, len(features), F.avg)[0]
    cells = [F.struct(F.lit(f).alias("feature"), ((F.col("vec")[i] - mean[i]) * float(c)).alias("contribution")) for i, (f, c) in enumerate(zip(features, coefficients))]
    return data.select("id", F.explode(F.array(*cells)).alias("x")).select("id", "x.*")


def sampled_contributions(data: DataFrame, model: Model, problem: str, features: Sequence[str], orders: int = 4, seed: int = 42) -> DataFrame:
    """(id, feature, contribution): Shapley values over a few seeded orders and background rows.

    Step s of an order takes the first s features from the row and the rest from the
    background; the change between two steps belongs to the feature that was added.
    """
    p = len(features)
    rng = np.random.default_rng(seed)
    back = data.orderBy(hash_uniform("id", seed), "id").limit(orders).select("vec").collect()  # ``orders`` rows
    plans = [(rng.permutation(p).tolist(), list(back[m % len(back)]["vec"])) for m in range(orders)]
    # rank[i]: step at which feature i is added
    cells = F.array(*[
        F.struct(F.array(*[F.lit(order.index(i)) for i in range(p)]).alias("rank"), F.array(*[F.lit(i) for i in order]).alias("order"), F.array(*[F.lit(float(v)) for v in b]).alias("back"))
        for order, b in plans])
    long = data.select("id", "vec", F.explode(cells).alias("o")).select("id", "vec", "o.*").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(p))))
    mixed = F.transform("vec", lambda x, i: F.when(F.element_at("rank", i + 1) < F.col("step"), x).otherwise(F.element_at("back", i + 1)))
    out = answer(model, with_vector(long, mixed), problem)
    plus = F.when(F.col("step") > 0, F.struct(F.try_element_at("order", F.col("step")).alias("i"), F.col("out").alias("v")))
    minus = F.when(F.col("step") < p, F.struct(F.try_element_at("order", F.col("step") + 1).alias("i"), (-F.col("out")).alias("v")))
    names = F.array(*[F.lit(f) for f in features])
    return out.select("id", F.explode(F.array_compact(F.array(plus, minus))).alias("c")).groupBy("id", F.element_at(names, F.col("c.i") + 1).alias("feature")).agg(
        (F.sum("c.v") / orders).alias("contribution"))


def global_strength(contributions: DataFrame, n: int = 25) -> DataFrame:
    """Mean absolute contribution per feature and its share."""
    g = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("s"))
    total = g.agg(F.sum("s")).first()[0] or 1.0
    return g.select("feature", rounded(F.col("s"), 6).alias("strength"), rounded(F.col("s") / total).alias("share")).orderBy(F.desc("strength"), "feature").limit(n)


def contribution_pairs(contributions: DataFrame, features: Sequence[str], least: float = 0.1) -> DataFrame:
    """Pairs of features whose contributions move together."""
    wide = contributions.groupBy("id").pivot("feature", list(features)).agg(F.first("contribution"))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = measure(wide, **{f"r{i}": correlation(F.col(f"`{a}`"), F.col(f"`{b}`")) for i, (a, b) in enumerate(pairs)})
    return report(contributions, [(a, b, half_up(row[f"r{i}"])) for i, (a, b) in enumerate(pairs) if row[f"r{i}"] is not None and abs(row[f"r{i}"]) > least], "feature_1 string, feature_2 string, correlation double")


def what_if(data: DataFrame, model: Model, problem: str, features: Sequence[str], edits: DataFrame) -> DataFrame:
    """Outputs before and after the edits (id, feature, value), with the change in percent."""
    at = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")) - 1
    rows = data.join(edits, "id").withColumn("j", at.cast("int"))
    before = answer(model, rows, problem, "before")
    after = answer(model, with_vector(before, replaced(F.col("j"), F.col("value"))), problem, "after")
    return after.select("id", "feature", "value", rounded(F.col("before")).alias("before"), rounded(F.col("after")).alias("after"),
                        rounded(100 * F.try_divide(F.col("after") - F.col("before"), F.abs("before")), 2).alias("change_pct"))


def counterfactuals(data: DataFrame, train: DataFrame, model: Model, features: Sequence[str], wanted: float = 1.0, keep: int = 3) -> DataFrame:
    """Single changes to p10..p90 of a feature that reach the wanted class, surest first."""
    q = quantiles(train, {f: F.col("vec")[i] for i, f in enumerate(features)}, [0.1, 0.25, 0.5, 0.75, 0.9])
    tries = F.array(*[F.struct(F.lit(i).alias("j"), F.lit(float(v)).alias("value")) for i, f in enumerate(features) for v in q[f]])
    # the unchanged row is one more try (j = -1): a row's tries are judged together, and no filter repeats the model's expression
    tries = F.concat(F.array(F.struct(F.lit(-1).alias("j"), F.lit(0.0).alias("value"))), tries)
    long = data.select("id", "vec", F.explode(tries).alias("t")).select("id", "vec", "t.*")
    out = answer(model, with_vector(long, replaced(F.col("j"), F.col("value"))), "classification", "after").select("id", "j", "value", "after")
    names = F.array(*[F.lit(f) for f in features])
    reaches = (F.col("after") >= 0.5).cast("double") == wanted
    tried = out.groupBy("id").agg(
        F.max(F.when(F.col("j") < 0, F.col("after"))).alias("before"),
        F.array_sort(F.collect_list(F.when((F.col("j") >= 0) & reaches, F.struct((F.col("after") * (-1.0 if wanted == 1.0 else 1.0)).alias("o"), "j", "value", "after")))).alias("hits"))
    best = F.slice("hits", 1, keep)
    return tried.where((F.col("before") >= 0.5).cast("double") != wanted).select("id", "before", F.posexplode(best).alias("at", "h")).select(
        "id", "before", "h.*", (F.col("at") + 1).alias("rank")).select(
        "id", F.element_at(names, F.col("j") + 1).alias("feature"), "value", rounded(F.col("before")).alias("before"), rounded(F.col("after")).alias("after"), "rank")


def partial_dependence(data: DataFrame, model: Model, problem: str, features: Sequence[str], chosen: Sequence[str], points: int = 50) -> DataFrame:
    """Mean output over all rows with one feature set to each point of a grid."""
    pos = [list(features).index(f) for f in chosen]
    q = quantiles(data, {f: F.col("vec")[i] for f, i in zip(chosen, pos)}, [0.05, 0.95])
    cells = [F.struct(F.lit(f).alias("feature"), F.lit(i).alias("j"), F.lit(float(v)).alias("value")) for f, i in zip(chosen, pos) for v in sorted(set(np.linspace(*q[f], points)))]
    long = data.select("id", "vec", F.explode(F.array(*cells)).alias("g")).select("id", "vec", "g.*")
    out = answer(model, with_vector(long, replaced(F.col("j"), F.col("value"))), problem)
    return out.groupBy("feature", "value").agg(rounded(F.avg("out")).alias("mean"), rounded(F.stddev_pop("out")).alias("spread"))


def individual_curves(data: DataFrame, model: Model, problem: str, features: Sequence[str], feature: str, rows: int = 50, points: int = 20, seed: int = 42) -> DataFrame:
    """Output curves of single rows, for a fixed number of rows drawn by hash."""
    j = list(features).index(feature)
    q = quantiles(data, {feature: F.col("vec")[j]}, [0.05, 0.95])[feature]
    picked = data.orderBy(hash_uniform("id", seed), "id").limit(rows)
    long = picked.select("id", "vec", F.explode(F.array(*[F.lit(float(v)) for v in np.linspace(*q, points)])).alias("value"))
    return answer(model, with_vector(long, replaced(j, F.col("value"))), problem).select("id", "value", rounded(F.col("out")).alias("out"))


def strengths(data: DataFrame, found: Sequence[tuple[str, str, float]]) -> DataFrame:
    """One row per feature pair with its strength (at most 1) and a label."""
    rows = [(a, b, half_up(min(h, 1.0)), "STRONG" if h > 0.3 else "moderate" if h > 0.1 else "weak") for a, b, h in found]
    return report(data, rows, "feature_1 string, feature_2 string, strength double, label string")


def tree_leaves(model: Model, problem: str) -> list[tuple[float, dict[int, tuple[float, float]]]] | None:
    """(what the leaf adds to the output, {feature: (above, up to)}) for every leaf of a model whose output is a sum over trees; None for other models."""
    trees = list(getattr(model, "trees", None) or ([model] if hasattr(model, "depth") else []))
    boosted = type(model).__name__.startswith("GBT")
    if not trees or (boosted and problem == "classification"):  # boosted classes go through a logistic curve
        return None
    weights = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
    leaves: list[tuple[float, dict[int, tuple[float, float]]]] = []
    for tree, weight in zip(trees, weights, strict=True):
        open_ = [(tree._java_obj.rootNode(), {})]
        while open_:
            node, box = open_.pop()
            if node.subtreeDepth() == 0:
                counts = list(node.impurityStats().stats()) if problem == "classification" else []
                leaves.append((weight * (counts[1] / sum(counts) if counts else node.prediction()), box))
                continue
            cut = node.split()
            if not hasattr(cut, "threshold"):
                return None
            f, at = cut.featureIndex(), cut.threshold()
            low, high = box.get(f, (-np.inf, np.inf))
            open_ += [(node.leftChild(), box | {f: (low, min(high, at))}), (node.rightChild(), box | {f: (max(low, at), high)})]
    return leaves


#: Rows x leaves that a task compares at once.
CELLS = 1 << 20


def tree_interactions(data: DataFrame, leaves: Sequence[tuple[float, dict[int, tuple[float, float]]]], pairs: Sequence[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """Friedman's H of feature pairs over all rows of ``data(vec)``, for the leaves of a tree model.

    With some features set to given values, a row reaches a leaf if the given values fit the leaf's box in those features and
    the row fits it in the others. The mean over all rows is therefore the sum of the leaves that the values fit, each with the
    share of rows that fit it in the other features. One pass over the rows counts these shares, one more sums the squares of
    the curves at every row: no copy of a row is made. Features that share no leaf do not interact.
    """
    together = {(a, b) for _, box in leaves for a in box for b in box if a < b}
    met = [p for p in pairs if (min(p), max(p)) in together]
    if not met:
        return dict.fromkeys(pairs, 0.0)
    used = sorted({f for _, box in leaves for f in box})
    sets = [(), *[(f,) for f in sorted({f for p in met for f in p})], *met]
    values = np.array([v for v, _ in leaves])
    above = {f: np.array([box.get(f, (-np.inf, np.inf))[0] for _, box in leaves]) for f in used}
    up_to = {f: np.array([box.get(f, (-np.inf, np.inf))[1] for _, box in leaves]) for f in used}

    def misses(batches: Iterator[pd.DataFrame]) -> Iterator[dict[int, np.ndarray]]:
        """For blocks of rows: which rows are outside which leaves, per feature."""
        step = max(1, CELLS // len(values))
        for b in batches:
            for lo in range(0, len(b), step):
                x = np.stack(b["vec"].iloc[lo : lo + step].to_list()).astype(float)
                x[np.isnan(x)] = np.inf  # a comparison with no number goes right
                yield {f: (x[:, f, None] <= above[f]) & np.isfinite(above[f]) | (x[:, f, None] > up_to[f]) for f in used}

    def summed(numbers: int, block: Callable[[dict[int, np.ndarray]], np.ndarray]) -> np.ndarray:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(numbers)
            for miss in misses(batches):
                total += block(miss)
            yield pd.DataFrame({"i": np.arange(numbers), "s": total})

        total = np.zeros(numbers)
        for r in data.select("vec").mapInPandas(add, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # sets x leaves numbers
            total[r["i"]] = r["s"]
        return total

    def fitting(miss: dict[int, np.ndarray]) -> np.ndarray:
        count = np.sum([m.astype(np.int16) for m in miss.values()], axis=0, dtype=np.int16)
        rest = [(count - sum((miss[f] for f in s), np.int16(0)) == 0).sum(axis=0) for s in sets]
        return np.concatenate([*rest, [len(count)]]).astype(float)

    counts = summed(len(sets) * len(values) + 1, fitting)
    n = counts[-1]
    if not n:
        return dict.fromkeys(pairs, 0.0)
    share = dict(zip(sets, counts[:-1].reshape(len(sets), -1) / n * values, strict=True))
    middle = share[()].sum()

    def squares(miss: dict[int, np.ndarray]) -> np.ndarray:
        single = {s[0]: ~miss[s[0]] @ share[s] - middle for s in sets if len(s) == 1}
        out = []
        for a, b in met:
            both = ~(miss[a] | miss[b]) @ share[a, b] - middle
            beyond = both - single[a] - single[b]
            out += [beyond.sum(), (beyond * beyond).sum(), both.sum(), (both * both).sum()]
        return np.array(out)

    sums = summed(4 * len(met), squares).reshape(len(met), 4)
    strength = dict.fromkeys(pairs, 0.0)
    for p, (u, uu, v, vv) in zip(met, sums, strict=True):
        spread = vv - v * v / n
        if spread > 1e-10:
            strength[p] = float(np.sqrt(max(uu - u * u / n, 0.0) / spread))
    return strength


def sampled_interactions(data: DataFrame, model: Model, problem: str, features: Sequence[str], rows: int = 200, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Friedman's H per feature pair (of the ``limit`` strongest features, if given) over a fixed sample of ``rows``, from single and joint partial dependence."""
    strong = [f for f, _ in importance(model, features)][:limit] or list(features)[:limit]
    picked = data.orderBy(hash_uniform("id", seed), "id").limit(rows).select("id", "vec")
    points = [(r["id"], r["vec"]) for r in picked.collect()]  # the fixed sample
    pairs = [(a, b) for i, a in enumerate(strong) for b in strong[i + 1 :]]
    sets = [(f,) for f in strong] + pairs
    probes = F.array(*[F.struct(F.lit(int(k)).alias("at"), F.array(*[F.lit(float(x)) for x in v]).alias("other")) for k, v in points])
    masks = F.array(*[F.struct(F.lit("|".join(s)).alias("who"), F.array(*[F.lit(f in s) for f in features]).alias("mask")) for s in sets])
    long = picked.withColumn("p", F.explode(probes)).withColumn("m", F.explode(masks)).repartition("id")
    mixed = F.transform("vec", lambda x, i: F.when(F.element_at(F.col("m.mask"), i + 1), F.element_at(F.col("p.other"), i + 1)).otherwise(x))
    out = answer(model, with_vector(long, mixed), problem).groupBy(F.col("m.who").alias("who"), F.col("p.at").alias("at")).agg(F.avg("out").alias("v"))
    pd_ = {(r["who"], r["at"]): r["v"] for r in out.collect()}  # sets x sample points
    rows_ = []
    for a, b in pairs:
        fa, fb, fab = (np.array([pd_[w, k] for k, _ in points]) for w in (a, b, f"{a}|{b}"))
        fa, fb, fab = fa - fa.mean(), fb - fb.mean(), fab - fab.mean()
        h = float(np.sqrt(((fab - fa - fb) ** 2).sum() / max((fab**2).sum(), 1e-12))) if (fab**2).sum() > 1e-10 else 0.0
        rows_.append((a, b, h))
    return strengths(data, rows_)


def interactions(data: DataFrame, model: Model, problem: str, features: Sequence[str], rows: int = 200, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Friedman's H per feature pair (of the ``limit`` strongest features, if given).

    Models that are sums of trees are measured over all rows along their leaves; for others single and joint partial dependence come from a fixed sample of ``rows``.
    """
    leaves = tree_leaves(model, problem)
    if leaves is None:
        return sampled_interactions(data, model, problem, features, rows, limit, seed)
    strong = [list(features).index(f) for f, _ in importance(model, features)][:limit]
    found = tree_interactions(data, leaves, [(a, b) for i, a in enumerate(strong) for b in strong[i + 1 :]])
    return strengths(data, [(features[a], features[b], h) for (a, b), h in found.items()])


def review(data: DataFrame, train: DataFrame, model: Model, features: Sequence[str], k: int = 10) -> DataFrame:
    """Per row: agreement of the nearest train rows, number of single changes that flip it, and confidence."""
    mean, std = vector_stats(train, len(features), F.avg, F.stddev_pop)
    unit = lambda df: df.select("id", F.array(*[(F.col("vec")[i] - mean[i]) / (std[i] or 1.0) for i in range(len(features))]).alias("vec"))
    now = answer(model, data, "classification", "p").withColumn("said", (F.col("p") >= 0.5).cast("double"))
    near = knn(unit(data), unit(train), k).join(train.select(F.col("id").alias("neighbor"), F.col("label").alias("nl")), "neighbor")
    agree = near.join(now.select("id", "said"), "id").groupBy("id").agg(F.avg((F.col("nl") == F.col("said")).cast("double")).alias("agreement"))
    tries = F.array(*[F.struct(F.lit(i).alias("j"), F.lit(float(s * (std[i] or 0.0))).alias("d")) for i in range(len(features)) for s in (-3, -2, -1, -0.5, 0.5, 1, 2, 3)])
    long = now.select("id", "vec", "said", F.explode(tries).alias("t")).select("id", "vec", "said", "t.*")
    moved = answer(model, with_vector(long, F.transform("vec", lambda x, i: F.when(i == F.col("j"), x + F.col("d")).otherwise(x))), "classification", "p2")
    flips = moved.groupBy("id").agg(F.count_if((F.col("p2") >= 0.5).cast("double") != F.col("said")).alias("flips"))
    top = F.greatest("p", 1 - F.col("p"))
    level = F.when((top >= 0.8) & (F.col("agreement") >= 0.7), "HIGH").when((top >= 0.6) & (F.col("agreement") >= 0.5), "MEDIUM").otherwise("LOW")
    return now.join(agree, "id").join(flips, "id").select("id", "said", rounded(top).alias("confidence"), rounded(F.col("agreement")).alias("agreement"), "flips", level.alias("level"))
