"""Sharding against a plain best fit, its invariants, and odd tables."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm.balanced import Tree
from barloom.llm.sharding import assign, balanced, best_fit, level, shard_documents


def plain_best_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(room) if r >= s]
        if fits:
            b = min(fits)[1]
        else:
            room.append(max(capacity, s))
            b = len(room) - 1
        room[b] -= s
        out.append(b)
    return out


def test_tree_against_a_set():
    rng, tree, held = random.Random(1), Tree(), set()
    for _ in range(5000):
        k = (rng.randrange(100), rng.randrange(4))
        (tree.remove if k in held else tree.add)(k)
        held ^= {k}
        bound = (rng.randrange(110), -1)
        assert tree.at_least(bound) == min((x for x in held if x >= bound), default=None)
    assert len(tree) == len(held)
    with pytest.raises(KeyError):
        tree.remove((1000, 0))
    tree = Tree()
    tree.add(1)
    with pytest.raises(ValueError):
        tree.add(1)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_a_scan_of_all_bins(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(1, 1 + rng.choice((10, 100, 1200))) for _ in range(600)), reverse=True)
    assert best_fit(sizes, 1000) == plain_best_fit(sizes, 1000)
    assert best_fit(sizes, 1000, max(best_fit(sizes, 1000))) is None
    sums = [0] * 9
    for s, b in zip(sizes, balanced(sizes, 9), strict=True):
        sums[b] += s
    assert max(sums) - min(sums) <= 0.01 * max(sums)


def test_level_and_a_group_over_a_share():
    assert sorted(level([5, 4, 1], [0, 0, 0], 2)) in ([0, 0, 1], [0, 1, 1])
    of = balanced([100, 9, 8, 3], 3)
    assert of[0] not in of[1:] and {of[1], of[2]} == {1, 2}
    assert balanced([], 3) == [] and len(set(balanced([7, 7], 5))) == 2


def check(rows, texts, shards=24):
    """rows: result rows; texts: (doc_id, text) of the input."""
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts)
    slots, homes = {}, {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = shard_documents(docs).collect()
    check(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    sums = {}
    for r in rows:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
    assert len(sums) == 24 and max(sums.values()) < 1.05 * min(sums.values())


def test_a_hot_group_odd_rows_and_clashing_columns(spark):
    texts = [(i, "copied text " * 9) for i in range(300)] + [(None, "copied text " * 9)] * 40 + [(1000 + i % 50, f"text {i} " + "x" * (i % 97)) for i in range(500)] + [(5, None), (None, None), (6, ""), (7, "é" * 300_000)]
    docs = spark.createDataFrame([(d, t, "s", 1, b"h") for d, t in texts], "doc_id long, text string, shard string, size int, h binary").withColumn("id", F.lit(3)).withColumn("row", F.lit(1))
    rows = shard_documents(docs).collect()
    check(rows, texts)
    sums = {}
    for r in rows:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
    rest = sorted(sums.values())[:-1]  # the long text and the copies are more than a share each
    assert max(rest) >= 340 * 116 and len(sums) == 24
    assert shard_documents(docs.limit(0)).collect() == []


def test_capacity(spark):
    rng = random.Random(2)
    groups = [(bytes([i % 256, i // 256]), rng.randrange(1, 400)) for i in range(900)]
    got = {bytes(r.id): r.shard for r in assign(spark.createDataFrame(groups, "id binary, size long"), capacity=1000).collect()}
    sums = {}
    for g, s in groups:
        sums[got[g]] = sums.get(got[g], 0) + s
    assert max(sums.values()) <= 1000 and sorted(sums) == list(range(len(sums)))
    assert len(sums) <= -(-sum(s for _, s in groups) // 1000) + 1
    with pytest.raises(ValueError):
        assign(spark.createDataFrame(groups, "id binary, size long"))


def test_levels_of_bricks(spark, monkeypatch):
    import barloom.llm.sharding as sharding

    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 40)
    monkeypatch.setattr(sharding, "BRICKS", 4)
    monkeypatch.setattr(sharding, "MOST_BRICKS", 40)
    groups = [(i.to_bytes(4, "big"), 1 + i % 7) for i in range(3000)]
    rows = assign(spark.createDataFrame(groups, "id binary, size long"), shards=4).collect()
    sums = [0] * 4
    for r in rows:
        sums[r.shard] += 1 + int.from_bytes(r.id, "big") % 7
    assert len(rows) == 3000 and max(sums) < 1.2 * min(sums)
