import math
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators.sketches import LG, TRACKED, chunk_sketches, frequent_tokens, length_quantiles, merged, vocabulary_size


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(1)
    rows = {(f"w{min(int(rng.paretovariate(0.7)), 60_000)}", i) for i in range(1500) for _ in range(rng.randint(1, 60))}
    return spark.createDataFrame([(w, i, 1, 0, 2, 0, 0, 0) for w, i in rows], "token string, doc_ord long, t int, i int, b int, c int, r int, l int").cache()


def test_estimates_are_within_their_bounds(spark, found):
    sketches = chunk_sketches(found, 100)
    assert sketches.count() == 15
    whole = merged(sketches).cache()
    exact = found.select("token").distinct().count()
    assert abs(vocabulary_size(whole).first()[0] - exact) <= 3 * 1.04 / math.sqrt(1 << LG) * exact
    lengths = sorted(3 * r["n"] for r in found.groupBy("doc_ord").agg(F.count("*").alias("n")).collect())
    for r in length_quantiles(whole, [0.1, 0.5, 0.9, 0.99]).collect():
        below, upto = (sum(x < r["length"] for x in lengths) / len(lengths), sum(x <= r["length"] for x in lengths) / len(lengths))
        assert below - 0.03 <= r["at"] <= upto + 0.03
    df = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}
    got = {r["token"]: r["df"] for r in frequent_tokens(whole, 20).collect()}
    bound = 3.5 * sum(df.values()) / TRACKED
    assert len(got) == 20 and all(abs(df[w] - n) <= bound for w, n in got.items())
    assert {w for w, n in df.items() if n > min(got.values()) + bound} <= got.keys()


def test_merging_in_any_groups_is_merging_all(spark, found):
    sketches = chunk_sketches(found, 100)
    halves = merged(sketches.withColumn("half", F.col("chunk") % 2), "half")
    assert halves.count() == 2
    assert vocabulary_size(merged(halves)).first() == vocabulary_size(merged(sketches)).first() == vocabulary_size(merged(sketches.unionByName(sketches))).first()
