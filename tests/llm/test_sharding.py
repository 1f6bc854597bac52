import random
import zlib

from pyspark.sql import functions as F

from emberline.llm import sharding
from tests.llm.conftest import prose


def test_tree_gives_the_tightest_fit():
    rng = random.Random(4)
    tree, held = sharding.CapacityTree(), []
    for i in range(600):
        if held and rng.random() < 0.4:
            x = held.pop(rng.randrange(len(held)))
            tree.remove(*x)
        else:
            held.append((rng.randint(0, 60), i))
            tree.insert(*held[-1])
        need = rng.randint(0, 60)
        assert tree.tightest(need) == min((x for x in held if x[0] >= need), default=None)


def test_bins_keep_to_capacity():
    rng = random.Random(5)
    sizes = [rng.randint(1, 50) for _ in range(400)]
    bins = sharding.best_fit_decreasing(sizes, 100)
    load = {}
    for s, b in zip(sizes, bins):
        load[b] = load.get(b, 0) + s
    assert max(load.values()) <= 100 and len(load) <= 1.1 * sum(sizes) / 100 + 1
    even = sharding.even_bins(sizes, 7)
    load = [sum(s for s, b in zip(sizes, even) if b == k) for k in range(7)]
    assert max(load) - min(load) <= 50 and max(load) <= 1.02 * sum(sizes) / 7 + 1


def check(rows, texts, shards):
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    slots, homes = {}, {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        if r.doc_id is not None:
            homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert all(len(h) == 1 for h in homes.values())


def test_documents(documents):
    texts = [prose(i, 20 + i % 50) for i in range(400)] + ["hot copy"] * 300 + [None, None, "", ""]
    rows = sharding.shard(documents(texts).withColumn("shard", F.lit(9)), 16).collect()
    check(rows, texts, 16)
    load = {}
    for r in rows:
        load[r.shard] = load.get(r.shard, 0) + r.size
    assert len(load) == 16 and max(load.values()) <= 1.1 * sum(load.values()) / 16


def test_capacity_and_empty(documents):
    texts = [prose(i, 30) for i in range(100)]
    rows = sharding.shard(documents(texts), None, capacity=3000).collect()
    check(rows, texts, 100)
    load = {}
    for r in rows:
        load[r.shard] = load.get(r.shard, 0) + r.size
    assert max(load.values()) <= 3000
    assert sharding.shard(documents([]), 16).collect() == []
