import zlib
from collections import Counter
from dataclasses import replace

import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import shard_tree
from quillstone.llm.shard_tree import Shard, Tree, assign, layout


def uniform(key, salt, level, node):
    """Spark's 64-bit hash of four columns: each one's hash is the next one's seed."""
    h = 42
    for part in (key.encode(), *(x.to_bytes(4, "little") for x in (salt, level, node))):
        h = xxhash.xxh64_intdigest(part, h)
    return (h >> 11) / 2**53


def place(key, shards, tree=Tree()):
    held = {(s.region, s.rack, s.slot): s for s in shards if s.weight > 0}
    for salt in range(10_000):
        region = int(uniform(key, salt, 0, 0) * tree.regions)
        rack = int(uniform(key, salt, 1, region) * tree.racks)
        slot = int(uniform(key, salt, 2, region * tree.racks + rack) * tree.shards)
        s = held.get((region, rack, slot))
        at = (region * tree.racks + rack) * tree.shards + slot
        if s and (s.weight == tree.weight or uniform(key, salt, 3, at) < s.weight / tree.weight):
            return s.number


@pytest.mark.parametrize("bucket_rows", [50_000, 7])
def test_against_brute_force(docs, rows, monkeypatch, bucket_rows):
    monkeypatch.setattr(shard_tree, "BUCKET_ROWS", bucket_rows)
    found = assign(docs.withColumn("shard", docs["n_chars"]), layout(16), layout(17)).collect()
    assert len(found) == len(rows)
    slots = {}
    for r in found:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == place(key, layout(16)) and r["grown_shard"] == place(key, layout(17))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want


def moved(spark, before, after, n=20_000, tree=Tree()):
    df = spark.range(n).selectExpr("id AS doc_id", "'x' AS text")
    rows = assign(df, before, after, tree).select("shard", "grown_shard").collect()
    return [(r["shard"], r["grown_shard"]) for r in rows]


@pytest.mark.parametrize("n", [1, 16, 17, 18, 21, 63])
def test_a_new_shard_takes_rows_only_into_itself(spark, n):
    rows = moved(spark, layout(n), layout(n + 1))
    assert {b for a, b in rows if a != b} == {n}
    sizes = Counter(b for _, b in rows)
    assert max(sizes.values()) < (1.25 if n < 60 else 1.6) * min(sizes.values()) and len(sizes) == n + 1


def test_weights_share_rows_and_move_them_only_where_they_change(spark):
    tree = Tree(2, 3, 4, weight=4.0)
    weights = {0: 1.0, 1: 2.0, 2: 4.0, 3: 0.5, 4: 0.0}
    before = [replace(s, weight=weights.get(s.number, 1.0)) for s in layout(12, tree)]
    after = [replace(s, weight=3.0) if s.number == 0 else s for s in before]
    less = [replace(s, weight=1.0) if s.number == 2 else s for s in before]
    grown, shrunk = moved(spark, before, after, tree=tree), moved(spark, before, less, tree=tree)
    assert {b for a, b in grown if a != b} == {0} and {a for a, b in shrunk if a != b} == {2}
    sizes, whole = Counter(a for a, _ in grown), sum(s.weight for s in before)
    assert all(abs(sizes[s.number] / len(grown) - s.weight / whole) < 0.01 for s in before) and sizes[4] == 0
    some = spark.range(300).select(F.col("id").cast("string").alias("key"))
    assert [r["s"] for r in some.select(shard_tree.place(F.col("key"), before, tree).alias("s")).collect()] == [place(str(i), before, tree) for i in range(300)]


def test_levels_decide_and_draws_do_not_grow_with_shards(spark):
    """It isn't a flat choice among shards, and the expression has as many hashes for 16 shards as for 60."""
    rows = [a for a, _ in moved(spark, layout(16), None, 2000)]
    flat = [max(layout(16), key=lambda s: xxhash.xxh64_intdigest(f"{s.number}:{i}".encode())).number for i in range(2000)]
    assert sum(a != b for a, b in zip(rows, flat, strict=True)) > 1000
    hashes = lambda n: spark.range(1).select(shard_tree.place(F.col("id").cast("string"), layout(n)).alias("s"))._jdf.queryExecution().analyzed().toString().count("xxhash64")
    assert hashes(16) == hashes(60) == 3 * len(shard_tree.DESCENTS)


def test_trees_that_cannot_be(spark):
    key = F.lit("k")
    with pytest.raises(ValueError, match="places"):
        layout(65)
    for shards in ([], [Shard(0, 0, 0, 1, 0.0)], [Shard(0, 0, 0, 1), Shard(0, 0, 0, 2)], [Shard(4, 0, 0, 1)], [Shard(0, 0, 0, 1, 2.0)]):
        with pytest.raises(ValueError):
            shard_tree.place(key, shards)


def test_empty_table(no_docs):
    assert assign(no_docs, layout(16)).collect() == []
