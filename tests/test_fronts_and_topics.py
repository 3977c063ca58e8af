"""Skylines against brute force, factors of texts, ensembles without joins by id."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.operators import experiments, learners, patterns


def beaten(points, i):
    as_good = (points >= points[i]).all(1)
    return bool((as_good & (points > points[i]).any(1)).any())


@pytest.mark.parametrize("measures", [1, 2, 3])
def test_skyline_against_brute_force(spark, measures):
    rng = np.random.default_rng(measures)
    x = rng.integers(0, 9, (400, 3)).astype(float)
    x[:40, 0] = 4.0  # many rows on one value, repeats among them
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(400, None, 1.0, 1.0), (401, float("nan"), 9.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(7)
    better, cheaper = [["a"], ["a", "b"], ["a", "b"]][measures - 1], [[], [], ["c"]][measures - 1]
    signed = np.column_stack([x[:, "abc".index(c)] for c in better] + [-x[:, "abc".index(c)] for c in cheaper])
    want = {i for i in range(400) if not beaten(signed, i)}
    if measures < 3:  # the rows with a gap in a measure that is used take no part
        df = df.where("id < 400")
    got = experiments.skyline(df, better, cheaper, fan=2)
    assert {r.id for r in got.collect()} == want and got.columns == df.columns
    assert experiments.skyline(df.where("id < 0"), better, cheaper).count() == 0


def test_skyline_on_one_cost(spark):
    df = spark.range(100_000).select("id", F.lit(1.0).alias("cost"), (F.col("id") % 1000).cast("double").alias("score"), (F.col("id") % 777).cast("double").alias("size"))
    front = {tuple(r) for r in experiments.skyline(df, ["score"], ["cost", "size"]).select("score", "size").distinct().collect()}
    rows = {(float(i % 1000), float(i % 777)) for i in range(100_000)}
    best = {}
    for score, size in rows:
        best[size] = max(best.get(size, -1.0), score)
    want, top = set(), -1.0
    for size in sorted(best):
        if best[size] > top:
            want.add((best[size], size))
            top = best[size]
    assert front == want


def test_factors_take_any_key_and_separate_subjects(spark):
    subjects = ["apple pear plum cherry", "bolt screw nail hammer", "river lake ocean pond"]
    rng = np.random.default_rng(3)
    rows = [(f"text-{i}", " ".join(rng.choice(subjects[i % 3].split(), 12))) for i in range(90)]
    df = spark.createDataFrame(rows, "name string, text string")
    errors = [patterns.nmf_topics(df, "name", "text", 3, 50, rounds=r)[2] for r in (0, 3, 12)]
    assert errors[0] > errors[1] >= errors[2] * 0.999
    top, main, _ = patterns.nmf_topics(df, "name", "text", 3, 50, words=4)
    words = {t: {r.term for r in top.collect() if r.topic == t} for t in range(3)}
    assert sorted(map(sorted, words.values())) == sorted(sorted(s.split()) for s in subjects)
    got = {r.key: r.topic for r in main.collect()}
    assert len(got) == 90 and all(rows[int(k[5:])][1].split()[0] in words[t] for k, t in got.items())
    big = df.withColumn("name", F.monotonically_increasing_id() + (1 << 40))
    assert patterns.nmf_topics(big, "name", "text", 3, 50, rounds=1)[1].count() == 90


def test_ensembles_join_nothing_by_id(spark):
    data = spark.range(600).select("id", F.array((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double")).alias("vec"), (F.col("id") % 7 > 3).cast("double").alias("label"))
    data = learners.with_vector(data, F.col("vec"))
    models = [learners.make(n, "classification").fit(data) for n in ("tree", "bayes")]
    out = learners.with_outputs(data, models, "classification")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    for i, m in enumerate(models):
        alone = {r.id: r.prediction for r in m.transform(data).select("id", "prediction").collect()}
        assert {r.id: r[f"p{i}"] for r in out.select("id", f"p{i}").collect()} == alone
    scores = {r.model: r.score for r in learners.stack(data, "classification", ["tree", "bayes"]).collect()}
    assert scores["tree"] == 1.0 and scores["stack"] >= scores["bayes"]
