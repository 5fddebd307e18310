import random

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm.components import components
from quillstone.llm.near_dup import forest, min_hashes, near_duplicates, odd_sketches

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = (text or "").translate(FOLD).encode().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Set size and component of each id: all pairs, on full sets; rows with one id are one node."""
    nodes = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(nodes):
        for j, y in nodes[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in parent}


def check(found, rows):
    want = brute(rows)
    assert len(found) == len(rows)
    sizes = {}
    for i, t, *_ in rows:
        sizes.setdefault(i, []).append(len(shingles(t)))
    for r in found:
        assert r["n_shingles"] in sizes[r["doc_id"]]
        assert r["component_id"] == want.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])


def test_against_all_pairs(docs, rows):
    check(near_duplicates(docs.withColumn("component_id", docs["n_chars"])).collect(), rows)


def test_a_group_of_near_copies_around_the_bound(spark):
    """Independent edits of one text: some pairs are linked and many are just below the bound."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(1, 7)):
            words[rng.randrange(len(words))] = f"edit{rng.random()}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"chain{j}" for j in range(6 * i, 6 * i + 60))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(near_duplicates(df).collect(), rows)


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (9, 8), (7, 9), (20, 2)], [(i + 1, i) for i in range(40)]])
def test_components(spark, edges):
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in parent:
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert found == parent


def test_forest_across_blocks():
    sets = [[1, 2, 3, 4], [1, 2, 3, 4, 5], [7, 8], [7, 8], [1, 2, 3, 4, 6]]
    rows = {"b1": [0] * 5, "b2": [1] * 5, "block": [0, 1, 0, 1, 1], "node": [10, 11, 12, 13, 14], "label": [10, 11, 12, 12, 14], "full": sets}
    found = forest(pa.table({k: pa.array(v) for k, v in rows.items()}), 75)
    assert sorted(zip(found["a"].to_pylist(), found["b"].to_pylist())) == [(10, 11), (10, 14)]


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    a, b = (np.concatenate((shared, rng.integers(0, 1 << 63, 100).astype(np.uint64))) for _ in range(2))
    values = min_hashes([a, b])
    sketch = odd_sketches(values).view(np.uint64)
    z = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
    estimate = 1 - np.log(1 - 2 * z / 512) / (np.log(1 - 2 / 512) * 256)
    assert abs(estimate - 900 / 1100) < 0.15 and abs((values[0] == values[1]).mean() - 900 / 1100) < 0.15
