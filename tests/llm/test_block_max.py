import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillstone.llm import block_max
from quillstone.llm.block_max import build_index, rank, search

from .conftest import DOCS, long_text

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=10):
    """item -> [(score, id)] of every row's score, best first; ids of equal scores ascending, null last."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = {}
    for item, own in asked.items():
        found = []
        for i, c in counted:
            m = 10 + (90 * sum(c.values()) * n) // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out[item] = [(-s, None if none else i) for s, none, i in sorted(found)[:k]]
    return {item: v for item, v in out.items() if v}


def ranked(found, item="item_id"):
    out = defaultdict(list)
    for r in sorted(found, key=lambda r: (str(r[item]), r["rank"])):
        out[r[item]].append((r["score"], r["doc_id"]))
        assert r["rank"] == len(out[r[item]])
    return dict(out)


ITEMS = [(i, long_text(12, i % 9)) for i in range(20)] + [(100, None), (101, ""), (102, "word"), (103, "WORD unknownterm a"), (None, "two five"), (104, "é ☃"), (102, "one"), (105, "x" * 70)]


@pytest.mark.parametrize("segment_docs, terms_a_block", [(1 << 16, 100_000), (7, 40)])
def test_against_brute_force(spark, docs, rows, monkeypatch, segment_docs, terms_a_block):
    monkeypatch.setattr(block_max, "SEGMENT_DOCS", segment_docs)
    monkeypatch.setattr(block_max, "BLOCK_TERMS", terms_a_block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = rank(docs, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked(found.collect()) == brute([(r[0], r[1]) for r in rows], ITEMS)


def test_long_texts_are_counted_in_slices(spark, monkeypatch):
    monkeypatch.setattr(block_max, "SLICE_BYTES", 1000)
    monkeypatch.setattr(block_max, "SLICE_WORDS", 64)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(("ab", "cd", "Éf", "g" * rng.choice((5, 3000)))) for _ in range(900))) for i in range(6)] + [(9, "," * 5000), (10, "é" * 4000), (11, " " + "y" * 2500)]
    items = [(1, "ab cd"), (2, "Éf " + "g" * 3000), (3, "é" * 4000), (4, "y" * 2500)]
    found = rank(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"))
    assert ranked(found.collect()) == brute(rows, items)


def test_ties_go_to_the_smaller_id_and_repeated_rows_count(spark):
    rows = [(i % 40, "same words here") for i in range(200)] + [(None, "same words here")] + [(1000 + i, f"filler {i}") for i in range(600)]
    random.Random(2).shuffle(rows)
    items = [("q", "same words"), ("none", "nothing of it"), (None, "filler")]
    found = rank(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string"), k=7)
    assert ranked(found.collect()) == brute(rows, items, 7)


def test_blocks_below_the_threshold_are_not_decompressed():
    rng = random.Random(5)
    segment = block_max.Segment("s")
    for i in range(20_000):
        rare = "rare rare rare" if 5000 <= i < 5010 else ""
        segment.add(i, f"common {'mid' if rng.random() < 0.3 else ''} {rare} w{i} {'pad ' * rng.randint(0, 8)}".encode())
    rows = segment.rows().to_pylist()
    lengths = np.frombuffer(rows[0]["last"], np.int64)
    stats = (len(lengths), int(lengths.sum()))
    lists = {r["term"]: block_max.Postings(r, block_max.norm(lengths, stats), stats) for r in rows[1:]}
    asked = [(w, lists[t]) for w, t in ((8000, "rare"), (1000, "mid"), (20, "common"))]
    docs, scores = block_max.best(asked, len(lengths), 10)
    total = np.zeros(len(lengths), np.int64)
    for w, p in asked:
        found, value = block_max.Postings.read(p, np.ones(len(p.last), bool)) if p.have.all() else (None, None)
        if found is None:
            assert p.have.sum() <= 0.05 * len(p.have) + 2
            found, value = p.read(np.ones(len(p.last), bool))
        total[found] += w * value
    want = np.lexsort((np.arange(len(total)), -total))[:10]
    assert docs.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert set(docs) == set(range(5000, 5010))


def test_packing_and_competitive_pairs():
    rng = np.random.default_rng(0)
    values = np.concatenate((rng.integers(0, 1 << 33, 500), rng.integers(0, 200, 500), [0, 127, 128, 16383, 16384]))
    data, ends = block_max.pack(values)
    assert block_max.unpack(data).tolist() == values.tolist() and ends[-1] == len(data)
    block, tf, n = np.sort(rng.integers(0, 9, 300)), rng.integers(1, 6, 300), rng.integers(1, 40, 300)
    kept = block_max.competitive(block, tf, n)
    for b in range(9):
        pairs = set(zip(tf[block == b].tolist(), n[block == b].tolist(), strict=True))
        front = {p for p in pairs if not any(q != p and q[0] >= p[0] and q[1] <= p[1] for q in pairs)}
        assert {(int(tf[i]), int(n[i])) for i in kept if block[i] == b} == front


def test_large_statistics_do_not_overflow():
    n = np.array([1, 10**7, 3 * 10**9])
    assert block_max.norm(n, (10**11, 10**14)).tolist() == [10 + 90 * int(x) * 10**11 // 10**14 for x in n]


def test_empty_and_clashing_columns(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "a", 2, "x")], "item_id long, text string, rank int, item string")
    assert rank(no_docs, items).collect() == []
    assert rank(docs, items.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, "a b", "x", 1, "s", 5), (2, "c", "y", 2, "t", 6), (3, "d e", "z", 3, "u", 7)], "doc_id long, text string, term string, n int, segment string, id int")
    index = build_index(odd)
    assert ranked(search(index, items).collect()) == brute([(1, "a b"), (2, "c"), (3, "d e")], [(1, "a")])
    assert DOCS
