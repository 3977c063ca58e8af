"""Association rules, topics and cause-effect measures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import half_up, rounded
from tablewise.functions.tails import correlation_p, normal_cdf
from tablewise.operators.measures import col, correlation, distinct_counts, frequencies, measure, number, report, text_columns
from tablewise.operators.text import term_counts, vocabulary, weighted_terms

YES = ["1", "true", "yes"]
FLAGS = {"0", "1", "true", "false", "yes", "no", "1.0", "0.0"}


def baskets(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(id, items): names of the yes columns, or column=value items of the text columns."""
    columns = list(columns or [c for c in df.columns if c != key])
    uniq = distinct_counts(df, columns)
    few = [c for c in columns if 0 < uniq[c] <= 2]
    values: dict[str, set] = {c: set() for c in few}
    for r in frequencies(df, few).collect() if few else []:  # at most 2 values per column
        values[r["column"]].add(r["value"].lower())
    flags = [c for c in few if values[c] <= FLAGS]
    if len(flags) >= 2:
        items = [F.when(F.lower(col(c).cast("string")).isin(YES), F.lit(c)) for c in flags]
    else:
        items = [F.when(col(c).isNotNull(), F.concat(F.lit(c + "="), col(c))) for c in columns if c in text_columns(df)]
    return df.select(col(key).alias("id"), F.array_compact(F.array(*items)).alias("items"))


def itemsets(rows: DataFrame, support: float = 0.05, largest: int = 3) -> DataFrame:
    """(items, n, support) of the frequent itemsets of at most ``largest`` items."""
    total = rows.count()
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.0).fit(rows)
    return model.freqItemsets.where(F.size("items") <= largest).select(F.array_sort("items").alias("items"), F.col("freq").alias("n"), (F.col("freq") / total).alias("support"))


def rules(sets: DataFrame, confidence: float = 0.5, limit: int | None = None) -> DataFrame:
    """Rules with one consequent item: confidence, lift, leverage and conviction, best lift first; ``limit`` of them if given."""
    each = sets.where(F.size("items") >= 2).select("items", "support", F.explode("items").alias("consequent"))
    each = each.withColumn("antecedent", F.array_remove("items", F.col("consequent")))
    a = sets.select(F.col("items").alias("antecedent"), F.col("support").alias("sa"))
    c = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("consequent"), F.col("support").alias("sc"))
    r = each.join(a, "antecedent").join(c, "consequent").withColumn("conf", F.col("support") / F.col("sa")).where(F.col("conf") >= confidence)
    conviction = F.when(F.col("conf") < 1, F.least((1 - F.col("sc")) / (1 - F.col("conf")), F.lit(999.0))).otherwise(999.0)
    r = r.select(
        F.array_join("antecedent", ",").alias("antecedent"), "consequent", rounded(F.col("support")).alias("support"), rounded(F.col("conf")).alias("confidence"),
        rounded(F.col("conf") / F.col("sc")).alias("lift"), rounded(F.col("support") - F.col("sa") * F.col("sc"), 6).alias("leverage"), rounded(conviction).alias("conviction"),
    ).orderBy(F.desc("lift"), "antecedent", "consequent")
    return r if limit is None else r.limit(limit)


def topic_tokens(df: DataFrame, key: str, column: str, stop_words: Sequence[str] | None = None) -> DataFrame:
    stop = list(stop_words) if stop_words is not None else StopWordsRemover.loadDefaultStopWords("english")
    cleaned = F.regexp_replace(F.lower(F.coalesce(col(column), F.lit(""))), r"[^a-zA-Z\s]", " ")
    return df.select(col(key).alias("key"), F.filter(F.split(cleaned, r"\s+"), lambda t: (F.length(t) >= 2) & ~t.isin(stop)).alias("tokens"))


def lda_topics(df: DataFrame, key: str, column: str, topics: int = 5, size: int = 1000, seed: int = 42, words: int = 10) -> tuple[DataFrame, DataFrame, float]:
    """Top words and prevalence per topic, the main topic per text, and the log perplexity."""
    data = topic_tokens(df, key, column)
    most = 0.95 * df.count()  # given as a share, the learner would count the texts by keeping all their words
    cv = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=size, minDF=2.0, maxDF=most if most >= 2 else 0.95).fit(data)
    counts = cv.transform(data).select("key", "features").persist()
    model = LDA(k=topics, maxIter=10, seed=seed, optimizer="online").fit(counts)
    names = cv.vocabulary
    mix = model.transform(counts).select("key", vector_to_array("topicDistribution").alias("m"))
    main = mix.select("key", (F.array_position("m", F.array_max("m")) - 1).cast("int").alias("topic"), F.array_max("m").alias("weight"))
    share = mix.agg(*[F.avg(F.col("m")[i]).alias(f"p{i}") for i in range(topics)]).first()
    rows = [(r["topic"], ",".join(names[i] for i in r["termIndices"]), half_up(share[f"p{r['topic']}"])) for r in model.describeTopics(words).collect()]
    return report(df, rows, "topic int, words string, prevalence double"), main, float(model.logPerplexity(counts))


def topic_weights(x: np.ndarray, h: np.ndarray, steps: int = 60) -> np.ndarray:
    """Non-negative weights of the topics ``h`` in each row of ``x``, by multiplicative updates from equal weights."""
    w = np.full((len(x), len(h)), 1.0)
    up, gram = x @ h.T, h @ h.T
    for _ in range(steps):
        w *= up / (w @ gram + 1e-12)
    return w


def nmf_topics(df: DataFrame, key: str, column: str, topics: int = 5, size: int = 500, seed: int = 42, words: int = 10, rounds: int = 12) -> tuple[DataFrame, DataFrame, float]:
    """Non-negative factors of the TF-IDF weights: top terms per topic, main topic per text, and the error.

    The factor of the terms has ``topics`` x ``size`` numbers and travels with the tasks. In each round a task
    solves the weights of its texts for that factor and adds up their products; the factor is updated from the
    sums, and the error of all cells, zeros included, falls out of the same pass. A text is a row of dense term
    numbers inside a task, so keys may be of any type. Texts without a vocabulary term are in no topic.
    """
    vocab = vocabulary(term_counts(df, key, column, pairs=False), df.count(), size)
    names = list(vocab)
    numbered = report(df, enumerate(names), "at int, term string")
    cells = weighted_terms(df, key, column, vocab, pairs=False).join(numbered, "term").groupBy("key").agg(F.collect_list(F.struct("at", "w")).alias("c"))
    data = cells.select("key", F.col("c.at").alias("at"), F.col("c.w").alias("w")).persist()
    v = len(names)

    def dense(b: pd.DataFrame) -> np.ndarray:
        x = np.zeros((len(b), v))
        if len(b):
            x[np.repeat(np.arange(len(b)), b["at"].str.len()), np.concatenate(b["at"].to_list())] = np.concatenate(b["w"].to_list())
        return x

    def sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(topics * v + topics * topics + 1)
            for b in batches:
                x = dense(b)
                w = topic_weights(x, h)
                total += np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel(), [(x * x).sum()]])
            yield pd.DataFrame({"i": np.arange(len(total)), "s": total})

        rows = data.select("at", "w").mapInPandas(add, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # topics x (size + topics) numbers
        total = np.zeros(topics * v + topics * topics + 1)
        for r in rows:
            total[r["i"]] = r["s"]
        wx, ww = total[: topics * v].reshape(topics, v), total[topics * v : -1].reshape(topics, topics)
        error = max(0.0, float(total[-1] - 2 * (wx * h).sum() + (ww * (h @ h.T)).sum()))
        return wx, ww, error**0.5

    h = np.random.default_rng(seed).uniform(0.1, 1.0, (topics, v))
    for _ in range(rounds):
        wx, ww, _ = sums(h)
        for _ in range(10):  # the weights' sums stand for all texts, so the factor is solved on the driver
            h = h * wx / (ww @ h + 1e-12)
        h = h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)  # topics of one length, so weights compare
    *_, error = sums(h)

    def leading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "topic": topic_weights(dense(b), h).argmax(1)})

    top = [(k, names[j], half_up(float(h[k, j])), n + 1) for k in range(topics) for n, j in enumerate(np.lexsort((np.arange(v), -h[k]))[:words])]
    main = data.mapInPandas(leading, f"key {data.schema['key'].dataType.simpleString()}, topic int")
    return report(df, top, "topic int, term string, weight double, rank int"), main, error


def causal_edges(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Pairs with |r| > 0.1 and p < 0.05, pointed from the column that explains more to the one with less variance; the ``limit`` strongest if given."""
    pairs = list(combinations(columns, 2))
    exprs = {}
    for i, (a, b) in enumerate(pairs):
        both = number(a).isNotNull() & number(b).isNotNull()
        exprs |= {f"r{i}": correlation(number(a), number(b)), f"n{i}": F.count_if(both), f"va{i}": F.var_pop(F.when(both, number(a))), f"vb{i}": F.var_pop(F.when(both, number(b)))}
    row = measure(df, **exprs)
    rows = []
    for i, (a, b) in enumerate(pairs):
        r, n = row[f"r{i}"], row[f"n{i}"]
        if r is None or n < 10 or abs(r) <= 0.1:
            continue
        p = correlation_p(r, n)
        if p < 0.05:
            forward = row[f"vb{i}"] <= row[f"va{i}"]  # residual variance of b on a against a on b
            rows.append((a if forward else b, b if forward else a, half_up(abs(r)), half_up(p, 6), "causal" if abs(r) > 0.3 else "association"))
    rows.sort(key=lambda e: (-e[2], e[0], e[1]))
    return report(df, rows[:limit], "source string, target string, strength double, p_value double, kind string")


def _uniform(keys: np.ndarray, draw: np.ndarray, seed: int) -> np.ndarray:
    """Repeatable uniforms from (key, draw): a 64-bit mix of the two numbers."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (draw.astype(np.uint64)[None, :] + np.uint64(seed)) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(float) / float(1 << 53)


def weighted_moments(df: DataFrame, key: str, columns: Sequence[str], draws: int, seed: int = 42) -> DataFrame:
    """(draw, m0, m1, ...): bootstrap-weighted cross products of (1, columns), all draws in one pass.

    Each task turns its rows into one partial sum per draw; only those are shuffled. Draw 0 has weight 1.
    """
    width = len(columns) + 1
    cells = [(i, j) for i in range(width) for j in range(i + 1)]
    edges = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(9)])
    ids = np.arange(1, draws + 1)

    def partial(batches):
        total = np.zeros((draws + 1, len(cells)))
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf[[f"x{i}" for i in range(len(columns))]].to_numpy(float)])
            prod = np.column_stack([x[:, i] * x[:, j] for i, j in cells])
            total[0] += prod.sum(axis=0)
            for s in range(0, len(pdf), 20_000):
                w = np.searchsorted(edges, _uniform(pdf["k"].to_numpy()[s : s + 20_000], ids, seed)).astype(float)
                total[1:] += w.T @ prod[s : s + 20_000]
        out = pd.DataFrame(total, columns=[f"m{i}" for i in range(len(cells))])
        out.insert(0, "draw", np.arange(draws + 1, dtype="int32"))
        yield out

    data = df.select(F.col(key).cast("long").alias("k"), *[number(c).alias(f"x{i}") for i, c in enumerate(columns)]).dropna()
    names = [f"m{i}" for i in range(len(cells))]
    parts = data.mapInPandas(partial, "draw int, " + ", ".join(f"{m} double" for m in names))
    return parts.groupBy("draw").agg(*[F.sum(m).alias(m) for m in names])


def causal_effect(df: DataFrame, key: str, treatment: str, outcome: str, confounders: Sequence[str] = (), draws: int = 500, seed: int = 42) -> DataFrame:
    """Effect of a treatment, plain and adjusted, with a bootstrap interval and p-value."""
    columns = [treatment, *confounders, outcome]
    width = len(columns) + 1

    def slope(row, use):
        m = np.zeros((width, width))
        for at, (i, j) in enumerate((i, j) for i in range(width) for j in range(i + 1)):
            m[i, j] = m[j, i] = row[f"m{at}"]
        x = [0, *use]
        return float(np.linalg.lstsq(m[np.ix_(x, x)], m[x, width - 1], rcond=None)[0][1])

    rows = sorted(weighted_moments(df, key, columns, draws, seed).collect(), key=lambda r: r["draw"])  # one row per draw
    plain, full = slope(rows[0], [1]), slope(rows[0], range(1, width - 1))
    boots = np.array([slope(r, range(1, width - 1)) for r in rows[1:]])
    p = 2 * (1 - normal_cdf(abs(full / max(boots.std(), 1e-10))))
    lo, hi = np.percentile(boots, [2.5, 97.5])
    return report(df, [(treatment, outcome, half_up(plain, 6), half_up(full, 6), half_up(float(lo), 6), half_up(float(hi), 6), half_up(p, 6), p < 0.05)],
                  "treatment string, outcome string, plain double, adjusted double, low double, high double, p_value double, significant boolean")
