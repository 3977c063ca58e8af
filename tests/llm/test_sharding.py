"""Sharding by virtual slots against plain counting, with hot records and odd rows."""

import zlib
from collections import Counter, defaultdict

import pytest

from tablewise.llm import queries, sharding


def held(rows):
    load, places = Counter(), defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
        places[r.shard].append(r.place)
    for k, x in places.items():
        assert sorted(x) == list(range(len(x))), k
    return [load[k] for k in range(8)]


@pytest.mark.parametrize("bucket", [50_000, 3])
def test_documents(spark, documents, bucket, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    df, maps = sharding.sharded(documents, 8)
    rows = df.collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in documents.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    load = held(rows)
    assert max(load) - min(load) <= max(r.size for r in rows)
    slots = defaultdict(set)
    for r in rows:
        slots[r.virtual_slot, r.part].add(r.shard)
        assert maps[-1].shard[r.virtual_slot, r.part] == r.shard
    assert all(len(x) == 1 for x in slots.values())
    assert [m.version for m in maps] == [1, 2] and maps[0].shard.keys() == maps[1].shard.keys()
    size = Counter()
    for r in rows:
        size[r.virtual_slot, r.part] += r.size
    first = [sum(size[e] for e, k in maps[0].shard.items() if k == s) for s in range(8)]
    assert max(load) - min(load) <= max(first) - min(first)
    again = {(r.doc_id, r.shard, r.place) for r in sharding.sharded(documents.repartition(7), 8)[0].collect()}
    assert {(d, s) for d, s, _ in again} == {(r.doc_id, r.shard) for r in rows}


def test_copies_of_one_record_are_spread(spark):
    rows = [(None, "the same text " * 20)] * 4000 + [(i, f"text {i} " * (i % 37)) for i in range(4000)] + [(5, None), (6, ""), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS slot", "0 AS shard", "'y' AS size", "1 AS part", "2 AS row", "3 AS salt", "4 AS place")
    got = sharding.sharded(df, 8)[0].collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 4000
    load = held(got)
    assert max(load) < 1.01 * sum(load) / 8 and min(load) > 0.99 * sum(load) / 8


def test_rebalanced_and_grown_maps():
    size = {(s, 0): (s * 7919) % 1000 + 1 for s in range(64)} | {(3, 0): 40_000}
    first = sharding.first_map({}, 4, 64)
    second = sharding.rebalanced(first, size)
    load = [sum(size[e] for e, k in second.shard.items() if k == s) for s in range(4)]
    assert max(load) == 40_000 and [e for e, k in second.shard.items() if k == second.shard[3, 0]] == [(3, 0)]
    rest = sorted(load)[:3]
    assert rest[-1] - rest[0] <= 20
    third = sharding.grown(second, size)
    assert third.version == 3 and third.shards == 5
    assert all(k in (second.shard[e], 4) for e, k in third.shard.items())
    assert 0 < sum(size[e] for e, k in third.shard.items() if k == 4) <= 1.1 * sum(size.values()) / 5


def test_map_is_a_table(spark):
    slot_map = sharding.first_map({2: 3}, 2, 4)
    assert sorted(tuple(r) for r in slot_map.table(spark).collect()) == [(1, 0, 0, 0), (1, 1, 0, 1), (1, 2, 0, 0), (1, 2, 1, 1), (1, 2, 2, 0), (1, 3, 0, 1)]


def test_empty_and_query(spark, empty, odd):
    assert queries.op12_sharding(empty).count() == 0
    rows = queries.op12_sharding(odd).collect()
    assert len(rows) == odd.count() and {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    assert sorted(r.size for r in rows if r.doc_id in (3, 4)) == [1, 1]
