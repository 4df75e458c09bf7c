import zlib
from collections import defaultdict

import pytest

from watchtide.llm import sharding


def least_capacity(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle, n, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                n, room = n + 1, middle
            room -= s
        low, high = (low, middle) if n <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards,copies", [(4, 1), (7, 30), (40, 3)])
def test_minimax_against_a_sweep(spark, shards, copies):
    rows = [(i, f"text {i * i % 97} " * (i % 13 + 1)) for i in range(150)] + [(1000 + i, "hot text " * 9) for i in range(copies)]
    rows += [(2000, None), (2001, ""), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "'x' AS shard", "'y' AS h")
    got = sharding.shard_documents(docs, shards).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows)
    text = dict(rows)
    load, where, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in got:
        t = text[r.doc_id]
        assert r.size == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode()) and r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r.size
        where[t].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in where.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = sharding.sizes(docs).groupBy("h").sum("size").orderBy("h").collect()
    assert max(load.values()) == least_capacity([r[1] for r in groups], shards)
    assert set(load) <= set(range(shards))


def test_ranges_are_split_until_exact(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "MORE_BITS", 3)
    docs = spark.createDataFrame([(i, f"doc {i} " * (i % 17)) for i in range(300)], "doc_id long, text string")
    groups = sharding.sizes(docs).groupBy("h").sum("size").withColumnRenamed("sum(size)", "bytes").cache()
    found, _ = sharding.cuts(groups, 11)
    assert found == least_capacity([r.bytes for r in groups.orderBy("h").collect()], 11)


def test_empty(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_group_leaves_no_shard_empty(spark):
    rows = [(i, f"text {i} " * (i % 7 + 20)) for i in range(2000)] + [(5000 + i, "hot text " * 20) for i in range(900)] + [(9000 + i, "warm text " * 20) for i in range(90)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 40).groupBy("shard").sum("size").collect()
    load = sorted(r[1] for r in got)
    assert len(load) == 40 and load[-2:] == [90 * 216, 900 * 196] and load[-3] < 1.1 * load[0]


@pytest.mark.parametrize("seed", range(30))
def test_even_keeps_the_least_capacity(seed):
    import random

    random.seed(seed)
    sizes = [random.choice([16, 40, 90, random.randrange(16, 3000)]) for _ in range(random.randrange(1, 120))]
    shards = random.randrange(1, 45)
    starts = sharding.even(sizes, shards)
    load = [sum(sizes[a:b]) for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True)]
    assert starts[0] == 0 and len(load) == min(shards, len(sizes)) and min(load) > 0
    assert max(load) == least_capacity(sizes, shards)
