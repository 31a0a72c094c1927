import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veritrace.llm.sharding import Tree, shard_of, shard_rows, text_crc32, text_size

from . import tables


def brute_shard(key, tree, seed=7):
    def draw(name, weight):
        u = (int(hashlib.md5(f"{seed}:{name}:{key}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        return -math.log(u) / weight

    weigh = lambda x: sum(map(weigh, x.values())) if isinstance(x, dict) else x
    nodes = tree.regions
    while True:
        name = min((n for n in nodes if weigh(nodes[n]) > 0), key=lambda n: draw(n if isinstance(n, str) else f"s{n}", weigh(nodes[n])))
        if not isinstance(nodes[name], dict):
            return name
        nodes = nodes[name]


def placed(spark, tree, n=6_000):
    return {r.id: r.s for r in spark.range(n).select("id", shard_of(F.col("id").cast("string"), tree).alias("s")).collect()}


UNEVEN = Tree({"east": {"e1": {0: 1.0, 1: 2.0}, "e2": {2: 3.0}}, "west": {"w1": {3: 2.0, 4: 0.0}, "w2": {5: 1.0, 6: 1.0}}})


def test_draws_are_those_of_a_plain_descent(spark):
    got = placed(spark, UNEVEN, 500)
    assert got == {i: brute_shard(i, UNEVEN) for i in range(500)}


def test_shares_follow_weights(spark):
    counts = Counter(placed(spark, UNEVEN).values())
    for shard, weight in UNEVEN.shards().items():
        want = 6_000 * weight / 10
        assert abs(counts[shard] - want) <= 4 * math.sqrt(want)
    counts = Counter(placed(spark, Tree.of(40)).values())
    assert set(counts) == set(range(40)) and all(abs(c - 150) < 4.5 * math.sqrt(150) for c in counts.values())


@pytest.mark.parametrize("n", [1, 7, 40])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    before, after = placed(spark, Tree.of(n)), placed(spark, Tree.of(n).grown())
    moved = {i for i in before if before[i] != after[i]}
    assert {after[i] for i in moved} == {n}
    assert abs(len(moved) - 6_000 / (n + 1)) < 5 * math.sqrt(6_000 / (n + 1))
    again = placed(spark, Tree.of(n).grown().grown())
    assert {again[i] for i in after if after[i] != again[i]} == {n + 1}


def test_rows_move_only_where_weights_change(spark):
    tree, before = Tree.of(40), placed(spark, Tree.of(40))
    region = {s: r for r, racks in tree.regions.items() for shards in racks.values() for s in shards}
    rack = {s: k for racks in tree.regions.values() for k, shards in racks.items() for s in shards}
    heavier = placed(spark, tree.weighted("region1", "rack3", 17, 3.0))
    moved = [(before[i], heavier[i]) for i in before if before[i] != heavier[i]]
    assert moved and all(region[b] == "region1" for _, b in moved)
    assert all(rack[b] == "rack3" for a, b in moved if region[a] == "region1")
    assert all(b == 17 for a, b in moved if rack[a] == "rack3")
    gone = placed(spark, tree.weighted("region1", "rack3", 17, 0.0))
    assert 17 not in gone.values()
    assert all(region[before[i]] == "region1" for i in before if before[i] != gone[i])


def test_slots_sizes_and_texts(spark):
    rng = random.Random(4)
    bodies = [None, "", "é" * 40, tables.text(rng, 50), tables.text(rng, 20_000)]
    rows = [(rng.choice([None, rng.randrange(300), 7]), rng.choice(bodies), "en", "s", 1, 2) for _ in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot int, shard int")
    out = shard_rows(docs, Tree.of(40)).withColumns({"size": text_size(F.col("doc.text")), "crc": text_crc32(F.col("doc.text"))}).collect()
    assert Counter(tuple(r.doc) for r in out) == Counter(rows)
    for r in out:
        assert r.shard == brute_shard("" if r.doc.doc_id is None else r.doc.doc_id, Tree.of(40))
        assert r.grown_shard == brute_shard("" if r.doc.doc_id is None else r.doc.doc_id, Tree.of(40).grown())
        data = (r.doc.text or "").encode()
        assert (r.size, r.crc) == (len(data) + 16, zlib.crc32(data))
    for shard in range(40):
        held = sorted((r for r in out if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in held] == list(range(len(held)))
        keys = [(r.doc.doc_id is not None, r.doc.doc_id or 0, r.crc) for r in held]
        assert keys == sorted(keys)


def test_awkward_and_empty_tables(spark):
    docs = tables.awkward(spark)
    out = shard_rows(docs, Tree.of(3)).collect()
    assert sorted(map(str, (tuple(r.doc) for r in out))) == sorted(map(str, map(tuple, docs.collect())))
    assert shard_rows(tables.empty(spark), Tree.of(40)).collect() == []
    with pytest.raises(ValueError, match="without shards"):
        Tree.of(0).column()
