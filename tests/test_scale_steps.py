"""Steps whose cost must not grow faster than the table."""

import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.operators import anomalies, clusters, evaluation, imputation, measures, missingness, neighbors, patterns, sampling, text
from tablewise.sources import files


def test_term_counts_of_repeated_and_null_keys(spark):
    rows = [(1, "Red fish blue fish"), (2, "red fish"), (2, "fish red"), (None, "blue"), (None, "blue fish"), (3, None), (4, ""), (5, "a 1 ?"), (6, "red fish")]
    df = spark.createDataFrame(rows, "k int, t string").repartition(3)
    for some in (df, df.where("k > 2 OR k = 1")):  # with repeated keys and without
        seen, times = {}, Counter()
        for r in some.collect():
            w = [x for x in (r["t"] or "").lower().split() if len(x) > 1 and x.isalpha()]
            for t in [*w, *map(" ".join, zip(w, w[1:]))]:
                seen.setdefault(t, set()).add(r["k"])
                times[t] += 1
        got = {r["term"]: (r["df"], r["cf"]) for r in text.term_counts(some, "k", "t", []).collect()}
        assert got == {t: (len(seen[t]), times[t]) for t in seen}
        got = {r["term"] for r in text.term_counts(some, "k", "t", [], pairs=False).collect()}
        assert got == {t for t in seen if " " not in t}


def test_term_counts_cut_by_words(spark, monkeypatch):
    df = spark.range(400).selectExpr("id", "repeat('ab cd ', cast(id % 7 as int)) AS t").repartition(2)
    whole = sorted(map(tuple, text.term_counts(df, "id", "t", []).collect()))
    monkeypatch.setattr(text, "WORDS_AT_ONCE", 50)
    assert sorted(map(tuple, text.term_counts(df, "id", "t", []).collect())) == whole


def test_terms_are_counted_before_the_shuffle(spark):
    df = spark.range(2_000).selectExpr("id", "'one two three four five six' AS t").repartition(2)
    counts = text.term_counts(df, "id", "t", [])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan and "hashpartitioning(key" not in plan  # no row per text and term
    assert {r["df"] for r in counts.collect()} == {2_000}


def test_neighbours_of_many_queries_need_little_memory(monkeypatch):
    rng = np.random.default_rng(5)
    tree = neighbors.LocalTree(rng.normal(size=(500, 2)), np.arange(500))
    q, ids = rng.normal(size=(50_000, 2)), np.arange(1_000, 51_000)
    tracemalloc.start()
    got = tree.nearest(q, ids, 5, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6  # a number for each query and row alone takes 200 MB
    monkeypatch.setattr(neighbors, "VISITED_ROWS", 60_000)
    assert got.equals(tree.nearest(q, ids, 5, False))


def test_neighbours_are_found_down_the_tree(monkeypatch):
    """Copies in several leaves, ties and bounds give what brute force gives, and most leaves are passed over together."""
    monkeypatch.setattr(neighbors, "LOCAL_ROWS", 8)
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(0, 30, size=(600, 2)).astype(float), np.full((50, 2), 7.0)])
    ids = rng.permutation(len(points))
    tree = neighbors.LocalTree(points, ids)
    assert max(tree.pieces.values()) > 1 and len(tree.boxes) == len(tree.nodes)
    q, qid = np.concatenate([points[::5], [[7.0, 7.0], [99.0, -3.0]]]), np.concatenate([ids[::5], [5_000, 5_001]])
    d = np.sqrt(((q[:, None] - points[None]) ** 2).sum(axis=2))
    d[qid[:, None] == ids[None]] = np.inf
    for bound in (None, np.full(len(q), 2.0)):
        got = tree.nearest(q, qid, 6, True, bound)
        want = []
        for i in range(len(q)):
            near = sorted((d[i, j], int(ids[j])) for j in range(len(ids)) if np.isfinite(d[i, j]) and (bound is None or d[i, j] <= bound[i]))[:6]
            want += [(int(qid[i]), b, x) for x, b in near]
        assert sorted(got.itertuples(index=False, name=None)) == sorted(want)


def test_rows_of_one_split_are_searched_and_scored_by_all_cores(spark):
    df = spark.range(9_000).selectExpr("id AS k", "cast(id % 997 as double) AS a", "cast(id % 25 as double) AS b").coalesce(1)
    v = neighbors.vectors(df, "k", ["a", "b"])
    for found in (neighbors.knn(v, v, 3, same=True), anomalies.isolation_scores(df, "k", ["a", "b"], trees=5)):
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
        assert found.select("id").distinct().count() == 9_000
    assert neighbors.dealt(v, 9_000).rdd.getNumPartitions() == min(spark.sparkContext.defaultParallelism, 5)
    assert neighbors.dealt(v, 100).rdd.getNumPartitions() == 1  # few rows are not worth it


def test_boundary_sends_no_table_to_the_driver(spark):
    df = spark.range(300).selectExpr("id AS k", "cast(id % 17 as double) AS a", "cast(id % 11 as double) AS b", "cast(id % 2 as int) AS y")
    out = sampling.boundary(df, "y", "k", ["a", "b"], 50, 5)
    assert out.count() == 50
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    for side in ("[id#", "[neighbor#"):
        assert f"BroadcastHashJoin {side}" not in plan


def test_auc_of_many_rows(spark):
    """50,000 rows of either class: their product is beyond 32 bits."""
    df = spark.range(100_000).selectExpr("cast(id % 2 as int) AS label", "cast(id % 2 as int) AS prediction", "0.25 + (id % 2) / 2 AS prob")
    assert evaluation.classification_measures(df).first()["auc"] == 1.0
    points = spark.createDataFrame([(0.5, 1, 1, 1, 1, 4_000_000_000, 4_000_000_000)], "score double, pos long, neg long, tp long, fp long, P long, N long")
    assert evaluation.roc_auc(points).first()["auc"] == 0.0


def test_even_splits_are_not_shuffled(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    even, odd = str(tmp_path / "even"), str(tmp_path / "odd")
    rows = spark.range(cores * 5_000).withColumn("x", F.col("id") % 7)
    rows.repartitionByRange(cores, "id").write.parquet(even)
    rows.repartitionByRange(cores, F.greatest("id", F.lit(cores * 4_000))).write.parquet(odd)
    plans = {p: files.spread(spark.read.parquet(p), "id", 0) for p in (even, odd)}
    shuffled = {p: "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString() for p, df in plans.items()}
    assert spark.read.parquet(even).rdd.getNumPartitions() == cores
    assert shuffled == {even: False, odd: True}
    for df in plans.values():
        assert df.agg(F.count("*"), F.sum("id")).first() == rows.agg(F.count("*"), F.sum("id")).first()


class Seen(Exception):
    pass


def test_topics_keep_no_words(spark, monkeypatch):
    """The learner of the vocabulary gets the limit as a number of texts, the topics get vectors only."""
    texts = ["red fish blue", "red bird green", "red fish green", "red bird blue"] * 5 + ["old stone"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    asked, learner = {}, patterns.CountVectorizer

    def counted(**p):
        asked.update(p)
        return learner(**p)

    class Topics:
        def __init__(self, **_):
            pass

        def fit(self, counts):
            raise Seen(counts)

    monkeypatch.setattr(patterns, "CountVectorizer", counted)
    monkeypatch.setattr(patterns, "LDA", Topics)
    with pytest.raises(Seen) as seen:
        patterns.lda_topics(df, "k", "t", 2)
    counts = seen.value.args[0]
    assert counts.columns == ["key", "features"] and asked["maxDF"] == 0.95 * len(texts)
    plain = learner(inputCol="tokens", outputCol="features", vocabSize=1000, minDF=2.0, maxDF=0.95)
    tokens = patterns.topic_tokens(df, "k", "t")
    want = plain.fit(tokens).transform(tokens).select("key", "features")
    assert {r["features"].size for r in want.collect()} == {7} == {r["features"].size for r in counts.collect()}
    counts.unpersist()


def test_forest_of_the_cleaning_effect_keeps_its_nodes(spark, monkeypatch):
    df = spark.range(300).selectExpr("id", "cast(id % 13 as double) AS a", "cast(id * 7 % 23 as double) AS b", "cast(id % 13 > 5 as int) AS y")
    chosen = measures.report(df, [(0, "drop_column", "b", "high", None, None, None)], "id int, type string, column string, impact string, strategy string, low double, high double")
    forests, make = [], imputation.make

    def made(*a, **p):
        forests.append((a, p))
        return make(*a, **p)

    monkeypatch.setattr(imputation, "make", made)
    kept = imputation.cleaning_impact(df, "y", "id", chosen, trees=5, depth=4).collect()
    assert forests[0][1]["cacheNodeIds"] is True
    monkeypatch.setattr(imputation, "make", lambda *a, **p: make(*a, **{k: v for k, v in p.items() if k in ("numTrees", "maxDepth")}))
    assert imputation.cleaning_impact(df, "y", "id", chosen, trees=5, depth=4).collect() == kept  # the same trees


def test_power_iterations_follow_the_matrix_however_rows_are_dealt(spark):
    """What numpy gives on the same start; before, the start was drawn per partition, and every round built the graph anew."""
    rng = np.random.default_rng(8)
    pairs = {(min(a, b), max(a, b)): float(w) for a, b, w in zip(rng.integers(0, 60, 300).tolist(), rng.integers(0, 60, 300).tolist(), rng.uniform(0.1, 1, 300)) if a != b}
    rows = [(a, b, w) for (a, b), w in pairs.items()] + [(5, 5, 9.0)]
    df = spark.createDataFrame(rows, "src long, dst long, weight double")
    ids = sorted({x for ab in pairs for x in ab})
    w = np.zeros((len(ids), len(ids)))
    for (a, b), x in pairs.items():
        w[ids.index(a), ids.index(b)] = w[ids.index(b), ids.index(a)] = x
    w /= w.sum(axis=1, keepdims=True)
    start = {r["src"]: r["x"] for r in spark.createDataFrame([(i,) for i in ids], "src long").withColumn("x", measures.hash_normal("src", 0)).collect()}
    x = np.array([start[i] for i in ids])
    x /= np.abs(x).sum()
    for _ in range(4):
        x = w @ x
        x /= np.abs(x).sum()
    for some in (df.coalesce(1), df.repartition(7)):
        got = {r["id"]: r["x"] for r in clusters.power_vector(some, iterations=4).collect()}
        assert sorted(got) == ids and np.allclose([got[i] for i in ids], x, rtol=1e-9)
    assert clusters.power_vector(df.where("weight > 99")).isEmpty()  # no edge, no node


def test_a_power_iteration_deals_no_edges_again(spark):
    edges = spark.range(5_000).selectExpr("id AS src", "id * 7 % 5000 AS dst", "0.5D AS share")
    kept = clusters.kept_by_end(edges)
    kept.count()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = clusters.products(kept, spark.range(5_000).selectExpr("id", "1.0D AS x"))
        assert {r["y"] for r in step.collect()} == {0.5}
        plan = [x for x in step._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Exchange" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        kept.unpersist()
    assert sum("hashpartitioning(src" in x for x in plan) == 1  # the partial sums
    assert sum("hashpartitioning(dst" in x and "REPARTITION_BY_NUM" not in x for x in plan) <= 1, plan  # the vector; the edges were dealt once


def test_areas_of_several_curves(spark):
    """Ties, a score shared by most rows and scores that go on in the next batch or task."""
    rng = np.random.default_rng(4)
    n = 6_000
    y, z = rng.integers(0, 2, n), (rng.random(n) < 0.1).astype(int)
    scores = {0: (y, np.round(rng.normal(size=n) + y, 1)), 3: (z, np.where(rng.random(n) < 0.9, 0.5, rng.random(n))), 4: (z, rng.normal(size=n) - z), 7: (y, np.zeros(n))}
    rows = [tuple(float(v) for i in scores for v in (scores[i][0][r], scores[i][1][r])) for r in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"y{i} double, s{i} double" for i in scores)).repartition(5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = missingness.areas_under_curves(df, {i: (F.col(f"y{i}"), F.col(f"s{i}")) for i in scores})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for i, (label, score) in scores.items():
        hit, miss = score[label == 1], score[label == 0]
        want = ((hit[:, None] > miss[None]).sum() + (hit[:, None] == miss[None]).sum() / 2) / (len(hit) * len(miss))
        assert abs(got[i] - want) < 1e-9
    assert missingness.areas_under_curves(df, {}) == {}


def test_null_flags_are_judged_alike_in_both_forms(spark, monkeypatch):
    """One column has gaps, another foretells them and a third is constant; there are too few scores to be thinned."""
    df = spark.range(1_500).selectExpr("id", "CASE WHEN sin(id) > 0.2 THEN NULL ELSE cast(id AS double) END AS a", "sin(id) + cos(id * 3) AS b", "1.0D AS c")
    small = missingness.mar_scores(df).collect()
    monkeypatch.setattr(measures, "ROWS_PER_TASK", 1_000)
    monkeypatch.setattr(missingness, "BinaryClassificationEvaluator", None)  # no curve of its own for each column
    assert [(r["column"], r["predictors"].split(",")[0]) for r in small] == [("a", "b")] and 0.6 < small[0]["mar_score"] < 1
    assert missingness.mar_scores(df).collect() == small


def test_large_graphs_are_clustered_by_rounds_over_kept_edges(spark, monkeypatch):
    monkeypatch.setattr(measures, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(clusters, "PowerIterationClustering", None)
    df = spark.range(300).selectExpr("id", "cast(id % 2 AS double) * 50 + sin(id) AS a", "cos(id) AS b")
    got = clusters.spectral(df, "id", ["a", "b"], 2)
    assert got.dtypes == [("id", "bigint"), ("cluster", "int")]
    assert sorted(r["id"] for r in got.collect()) == list(range(300))


def test_copies_of_a_base_are_counted_once(spark, monkeypatch):
    """The sample, the boxes of the leaves and both searches read the base that is kept; before, each counted the copies of all points again."""
    monkeypatch.setattr(neighbors, "BROADCAST_VALUES", 0)
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 200)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [(i, [float(i % 250), float(i % 7)]) for i in range(2_000)]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    base = v.mapInPandas(counted, "id long, vec array<double>")
    got = neighbors.knn(v.where("id < 50"), base, 3)
    head = seen.value
    out = got.collect()
    assert len(out) == 150 and all(r["distance"] == 0 for r in out if r["rank"] == 1)
    assert head <= 3 * len(rows) and seen.value == head  # its width, its number and the copies; nothing when the result is taken


def test_rounds_of_large_graphs_bring_nothing_to_the_driver(spark, capfd):
    """Small files stand for large tables here: a number per node was broadcast in each round."""
    edges = spark.range(300).selectExpr("id AS src", "(id + 1) % 300 AS dst", "1.0D + id % 3 AS weight")
    made = clusters.power_vector(edges, 2)
    assert sorted(r["id"] for r in made.collect()) == list(range(300))
    kept = clusters.kept_by_end(edges.withColumnRenamed("weight", "share"))
    capfd.readouterr()
    clusters.products(kept, spark.range(300).selectExpr("id", "1.0D AS x")).explain()
    kept.unpersist()
    plan = capfd.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_points_are_gathered_as_numbers(spark):
    v = spark.range(0, 50, 1, 4).selectExpr("id", "array(cast(id AS double), id * 0.5D) AS vec")
    ids, points = neighbors.gathered(v, 2)
    assert sorted(ids.tolist()) == list(range(50)) and (points == ids[:, None] * [1, 0.5]).all()
    ids, points = neighbors.gathered(v.where("id < 0"), 2)
    assert len(ids) == 0 and points.shape == (0, 2)


def test_terms_of_texts_are_weighed_once_a_row(spark):
    """Words are runs of ASCII letters of the lowered text; a task gives one row per text and term, whatever the text repeats."""
    rows = [("a", "Good good food, the b café X"), ("a", "good food"), ("b", "Kelvin good\x1cfood 9food"), (None, "food goodégood food"), ("c", None), ("d", "")]
    df = spark.createDataFrame(rows, "k string, t string").coalesce(1)
    vocab = {"good": 1.0, "food": 2.0, "good food": 4.0, "kelvin good": 8.0, "good good": 16.0, "the": 32.0, "absent pair": 64.0}
    want = {}
    for r in df.select("k", text.grams("t").alias("g")).collect():
        for t in r["g"]:
            if t in vocab:
                want[r["k"], t] = want.get((r["k"], t), 0) + vocab[t]
    got = text.weighted_terms(df, "k", "t", vocab)
    assert {(r["key"], r["term"]): r["w"] for r in got.collect()} == want and len(want) > 8
    counts = {}
    for r in df.select("k", text.grams("t").alias("g")).where("k = 'b' OR k IS NULL").collect():
        for t in r["g"]:
            counts[t] = counts.get(t, 0) + 1
    single = text.term_counts(df.where("k = 'b' OR k IS NULL"), "k", "t")
    assert {r["term"]: r["cf"] for r in single.collect()} == counts


def test_words_of_a_text_are_made_once(spark, capfd):
    df = spark.createDataFrame([(1, "Good good bad."), (2, " "), (3, None)], "id long, t string").repartition(2)
    out = text.sentiment(text.text_measures(df, "t"), "t")
    got = {r["id"]: (r["t_word_count"], r["t_unique_word_ratio"], r["t_positive_ratio"], r["t_sentiment_score"]) for r in out.collect()}
    assert got == {1: (3, 2 / 3, 2 / 3, 2 / 3), 2: (0, 0.0, 0.0, 0.0), 3: (0, 0.0, 0.0, 0.0)}
    capfd.readouterr()
    text.text_measures(df, "t").explain()
    assert capfd.readouterr().out.count("split(") == 1
