"""Search, URL rules and the pipeline against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewise.llm import top_k, url_filter
from tablewise.llm.components import components
from tablewise.llm.queries import ORACLES, QUERIES, URL_RULES, labelled_urls
from tests.compare import difference
from tests.conftest import FOLDER
from tests.llm.conftest import SMALL


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, oracle, key):
    diff, _ = difference(spark, oracle, FOLDER, QUERIES[key], ORACLES[key])
    assert diff is None, diff


def brute(rows, k):
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in vectors if i % 100 == 0}:
        own = max(v for i, v in vectors if i == q)
        found = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in vectors if i != q and len(v) == len(own))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 7)
    monkeypatch.setattr(top_k, "QUERIES", 2)
    rng = np.random.default_rng(0)
    rows = [(i, np.round(rng.normal(size=4), 1).tolist()) for i in range(350)]
    rows += [(500, [1.0, 2.0]), (501, [0.5, 0.25]), (600, None), (700, [1.0, None, 0.0, 0.0]), (800, [float("nan"), 0.0, 0.0, 0.0]), (900, [float("inf")] * 4), (901, []), (1000, [1e7, -1e7, 3e6, 1.0]), (1001, [-1e7, 1e7, 5.0, 1.0])]
    rows += [(i, v) for i, v in rows[:5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vector", F.lit("x")).withColumn("rank", F.lit(0))
    got = {tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 100 == 0).collect()}
    assert got == brute(rows, 10)
    assert top_k.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    return rest[:end].translate({c: c + 32 for c in range(65, 91)}), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def ruled(host, path):
    best = None
    for kind, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, kind)
    return best


def test_url_filter(spark):
    odd = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://WWW.Example.COM/en/x?y#z"), (5, "http://a.example.com/en/"), (6, "http://example.com"), (7, "x://b.net/es/1"), (8, "http://cheap-pills.org/buy"), (9, "a://b://c/d"), (10, "http://xcom/"), (10, "http://xcom/"), (None, "http://library.org/"), (11, "http://é.fr/ü#é")]
    pages = spark.createDataFrame(odd, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("kind", F.lit("x"))
    pages = pages.unionByName(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").withColumn("host", F.lit("x")).withColumn("kind", F.lit("x")))
    urls = {}
    for r in pages.collect():
        urls.setdefault(r.page_id, set()).add(r.url)
    got = url_filter.judged(pages, URL_RULES, labelled_urls(spark)).collect()
    assert len(got) == pages.count()
    for r in got:
        assert (r.host, r.path) in {parsed(u) for u in urls[r.page_id]}
        best = ruled(r.host, r.path)
        assert r.rule == (best and best[0])
        assert r.verdict == (best[1] if best else "block" if r.blocked_score >= 0.5 else "allow")
    assert next(r for r in got if r.page_id == 8 and r.host.startswith("cheap")).verdict == "block"
    assert url_filter.judged(pages.where("false"), URL_RULES).count() == 0


@pytest.mark.parametrize("most", [100_000, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr("tablewise.llm.components.ONE_TASK", most)
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (8, 10), (20, 20), (5, 4), (7, 30), (30, 31), (31, 32), (32, 33), (3, 2)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**dict.fromkeys([1, 2, 3, 4, 5], 1), **dict.fromkeys([8, 9, 10], 8), 20: 20, **dict.fromkeys([7, 30, 31, 32, 33], 7), **dict.fromkeys(range(100, 141), 100)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, odd):
    """Each stage keeps what it should of its own input; the last packs all of it."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SMALL).cache()
        assert frame.columns == docs.columns
        kept[name] = [r.doc_id for r in frame.collect()]
    assert sorted(kept["language_id"]) == sorted(d for d, t in given.items() if any(c.isalpha() for c in t or ""))
    normal = {d: "".join((given[d] or "").split()) for d in kept["language_id"]}
    assert len(kept["exact_dedup"]) == len(set(kept["exact_dedup"])) == len(set(normal.values()))
    grams = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d in kept["exact_dedup"] if (w := given[d].lower().split()) is not None}
    near = set()
    for d in sorted(grams):
        linked = {o for o in grams if o < d and 5 * len(grams[o] & grams[d]) >= 4 * len(grams[o] | grams[d])}
        if linked:
            near.add(d)
    assert near >= set(grams) - set(kept["jaccard_join"]) and len(near) == len(grams) - len(kept["jaccard_join"])
    assert set(kept["source_mixing"]) <= set(kept["jaccard_join"]) and len(kept["source_mixing"]) > len(kept["jaccard_join"])
    rows = corpus_pipeline.STAGES[-1][1](spark, frame, SMALL).collect()
    assert sorted(r.doc_id for r in rows if r.piece == 0) == sorted(kept["source_mixing"])


def test_pipeline_odd_rows(spark, odd):
    """One row of each group stays in both dedup stages, also of repeated rows and rows without a number."""
    passage = " ".join(f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    rows = [(None, passage), (None, passage), (None, f"{passage} more"), (None, "another text without a number"), (70, passage), (71, "seventy one rows of one text"), (71, "seventy one rows of one text"), (72, "one number"), (72, "and two texts")]
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("a"))
    docs = odd.unionByName(more.select("*", *[F.lit("x").alias(c) for c in odd.columns[4:]]))
    kept = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SMALL).cache()
        assert frame.columns == docs.columns
        kept[name] = [(r.doc_id, "".join((r.text or "").split())) for r in frame.collect()]
    texts = {"".join((r.text or "").split()) for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert sorted(t for _, t in kept["exact_dedup"]) == sorted(texts)
    gone = {passage.replace(" ", ""), passage.replace(" ", "") + "more"}
    near = [t for _, t in kept["jaccard_join"]]
    assert len(near) == len(set(near)) == len(texts) - 1 and texts - set(near) < gone
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, SMALL).where("piece = 0").count()
    assert packed == len(kept["source_mixing"])


def test_top_k_rows_without_number(spark):
    big = 2**53
    rows = [(None, [9.0, 9.0]), (100, [1.0, 1.0]), (big + 1, [2.0, 1.0]), (None, [5.0, 5.0]), (big + 3, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = {tuple(r) for r in top_k.top_k(df, F.col("vec_id") == 100).collect()}
    assert got == brute([r for r in rows if r[0]], 10) == {(100, 1, big + 1, 3 * 1024**2), (100, 2, big + 3, 3 * 1024**2)}


def test_copies_of_queries_are_not_gathered(spark, monkeypatch, capfd):
    """The queries' file is small, their copies for all slots are not: no plan brings them to the driver."""
    seen = []
    meeting = top_k._meeting
    monkeypatch.setattr(top_k, "QUERIES", 2)
    monkeypatch.setattr(top_k, "_meeting", lambda *a: seen.append(meeting(*a)) or seen[-1])
    rows = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 100 == 0).collect()} == brute(rows, 10)
    capfd.readouterr()
    for met in seen:
        met.explain()
    plans = capfd.readouterr().out
    assert len(seen) == 2 and plans.count("SortMergeJoin") >= 2 and "BroadcastExchange" not in plans


def test_bounds_hold_every_product():
    rng = np.random.default_rng(3)
    for scale in (1, 50, 1000, 10**7):
        v, q = rng.integers(-scale, scale + 1, (300, 5)).astype(float), rng.integers(-scale, scale + 1, (20, 5)).astype(float)
        low, high = v.min(axis=0), v.max(axis=0)
        least, most = top_k._bounds(q, ((v - low) // top_k._cells(low, high)).astype(np.uint8), low, high)
        exact = q @ v.T
        assert (least <= exact).all() and (exact <= most).all()
        if scale < 128:
            assert (least == exact).all() and (exact == most).all()  # a cell is one number


def test_url_query_learns_from_rules_only(spark, monkeypatch):
    """The query takes no host list, and judges pages of hosts that it did not see as the rules would."""
    from tablewise.llm import queries

    monkeypatch.setattr(queries, "labelled_urls", None)
    assert QUERIES["op7_url_filter"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host, path = url_filter.parts(F.col("url"))
    split = pages.withColumns({"host": host, "path": path})
    kind = url_filter.fitting(URL_RULES)[1]
    split = split.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("unseen", F.crc32(F.col("host").cast("binary")) % 5 == 0)
    known = split.where("NOT unseen").select("url", (F.col("kind") == "block").cast("int").alias("blocked"))
    got = url_filter.judged(split.where("unseen").select("page_id", "url"), (), known).join(split.select("page_id", "kind"), "page_id").collect()
    right = {k: [r.verdict == k for r in got if r.kind == k] for k in ("allow", "block")}
    print("unseen hosts:", {k: (sum(x), len(x)) for k, x in right.items()}, split.select("host", "unseen").distinct().groupBy("unseen").count().collect())
    assert min(sum(x) / len(x) for x in right.values()) > 0.8
