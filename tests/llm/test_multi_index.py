import math

import numpy as np
import pytest

from quillstone.llm import multi_index
from quillstone.llm.multi_index import Quantiser, search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            scores = sorted((-float((q * v).sum()), j) for j, v in ok if j != i)[:k]
            out[i] = [(j, -s) for s, j in scores]
    return out


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(n)]


def found(df, **options):
    out = {}
    for r in search(df, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [i for i, _ in a[q]] == [i for i, _ in b[q]]
        assert np.allclose([s for _, s in a[q]], [s for _, s in b[q]], atol=1e-12)


def test_odd_vectors_take_no_part(spark):
    rows = vectors(60)
    rows += [(100, None), (120, [0.0] * 8), (140, [1.0] * 7 + [None]), (160, [float("nan")] * 8), (180, [float("inf")] + [0.0] * 7), (200, [1.0] * 3), (220, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    same(found(df), brute(rows))


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0] + [0.0] * 7) for i in range(100)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    same(found(df), brute(rows))


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    monkeypatch.setattr(multi_index, "BATCH", 3)
    rows = vectors(300)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    same(found(df, probe=1.0), brute(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_vectors(spark, n):
    rows = vectors(n)
    same(found(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)), {q: v for q, v in brute(rows).items() if v})


def test_cells_are_visited_in_order_of_summed_nearness():
    x = np.random.default_rng(0).normal(size=(500, 8))
    q = Quantiser(x, 8)
    q.counts.reshape(-1)[:] = np.bincount(q.cells(x), minlength=q.counts.size)
    order = q.visit(x[0], 10**9)
    near = [c @ p for p, c in zip((x[0][:4], x[0][4:]), q.parts)]
    sums = [near[0][c // len(q.parts[1])] + near[1][c % len(q.parts[1])] for c in order]
    assert sums == sorted(sums, reverse=True) and sorted(order) == np.flatnonzero(q.counts.reshape(-1)).tolist()


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = df.toArrow()
    ids, v = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist())
    got, hits, whole = found(df), 0, 0
    for q, best in got.items():
        scores = v @ v[ids == q][0]
        scores[ids == q] = -np.inf
        hits += len({i for i, _ in best} & set(ids[np.argsort(-scores)[:20]].tolist()))
        whole += 20
    assert hits / whole >= 0.9


def test_repeated_vectors_tie_exactly(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 200)
    monkeypatch.setattr(multi_index, "BATCH", 37)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 64)).astype(np.float32)
    rows = [(i, base[i % 300].tolist()) for i in range(900)]
    got = found(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4), probe=1.0)
    wide = base.astype(np.float64)
    for q, best in got.items():
        scores = (wide * wide[q % 300]).sum(1)
        want = sorted((-scores[i % 300], i) for i in range(900) if i != q)[:20]
        assert best == [(i, -s) for s, i in want]


def test_vectors_of_one_component_and_clashing_names(spark):
    rows = [(i, [float(i % 7) - 3.5]) for i in range(60)]
    df = spark.createDataFrame([(i, v, 0, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, query_id int, id string, v double")
    got = found(df)
    for q, best in got.items():
        want = sorted((-(q % 7 - 3.5) * (i % 7 - 3.5), i) for i, _ in rows if i != q)[:20]
        assert [i for i, _ in best] == [i for _, i in want]
    assert len(got) == 3
