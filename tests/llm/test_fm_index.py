import re

import numpy as np
import pytest

from quillstone.llm import fm_index
from quillstone.llm.fm_index import FMIndex, WaveletMatrix, mark

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def brute(text, items, window):
    """Words, hit words and ids of items found in a text."""
    words = WORD.findall((text or "").translate(FOLD))
    hit, ids = set(), set()
    for i, t in items:
        w = WORD.findall((t or "").translate(FOLD))
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == w[j : j + n]:
                    hit.update(range(k, k + n))
                    ids.add(i)
    return len(words), len(hit), sorted(str(i) for i in ids if i is not None)


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 37, 1000)
    tree = WaveletMatrix(x)
    at, symbols = rng.integers(0, 1001, 300), rng.integers(0, 37, 300)
    assert tree.rank(symbols, at).tolist() == [int((x[:i] == s).sum()) for i, s in zip(at, symbols)]
    got, before = tree.access(np.arange(1000))
    assert (got == x).all() and before.tolist() == [int((x[:i] == x[i]).sum()) for i in range(1000)]


@pytest.mark.parametrize("seed", range(4))
def test_search_and_locate(seed):
    rng = np.random.default_rng(seed)
    parts = [np.append(rng.integers(1, 4, rng.integers(1, 40)), 0) for _ in range(30)]
    parts += [parts[0]] * 20
    text = np.concatenate(parts)
    index = FMIndex(text)
    for m in (1, 2, 5):
        patterns = rng.integers(1, 5, (40, m))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text) - m + 1) if (text[i : i + m] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def items_of(rows):
    texts = [t for _, t, *_ in rows if t]
    return [
        (1, " ".join(texts[0].split()[5:40])), (2, texts[5].upper()), (3, "one two"), (4, None), (5, ""), (6, "★ ☃"), (7, "a b c d e"), (3, "four"),
        (None, " ".join(texts[2].split()[:12])), (8, " ".join(texts[9].split()[30:39])), (9, "word " * 25), (10, "absent phrase entirely of other words than those there are in it"),
    ]


@pytest.mark.parametrize("window, block", [(10, 64 << 20), (3, 64 << 20), (10, 4000)])
def test_against_brute_force(spark, docs, rows, monkeypatch, window, block):
    monkeypatch.setattr(fm_index, "BLOCK_BYTES", block)
    items = items_of(rows)
    found = mark(docs.withColumn("items", docs["lang"]), spark.createDataFrame(items, ITEMS), ["doc_id", "text", "items"], window=window).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute(r["text"], items, window)


def test_removal_spans(spark):
    docs = spark.createDataFrame([(1, "Keep, one-two Three; keep é four!"), (2, "nothing"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "ONE two three"), (2, "four")], ITEMS)
    found = {r["doc_id"]: r for r in mark(docs, bench, ["doc_id"], cleaned=True).collect()}
    assert [tuple(s) for s in found[1]["spans"]] == [(6, 19), (28, 32)] and found[1]["text"] == "Keep,  ; keep é  !"
    assert found[2]["text"] == "nothing" and found[3]["text"] is None


def test_empty_tables(spark, docs, rows, no_docs):
    assert mark(no_docs, spark.createDataFrame([(1, "a b"), (2, "c")], ITEMS), ["doc_id"]).collect() == []
    none = spark.createDataFrame([], ITEMS)
    found = mark(docs, none, ["doc_id"]).collect()
    assert len(found) == len(rows) and not any(r["n_hit"] for r in found)
    assert mark(no_docs, spark.createDataFrame([(1, "a b")], ITEMS), ["doc_id"]).collect() == []


def test_one_block_is_broadcast_at_a_time(spark, docs, rows, monkeypatch):
    from pyspark import Broadcast, SparkContext

    alive, most, sent = [], [], []
    send, end = SparkContext.broadcast, Broadcast.destroy

    def broadcast(self, value):
        made = send(self, value)
        if isinstance(value, fm_index.Phrases):
            alive.append(made)
            sent.append(made)
            most.append(len(alive))
        return made

    def destroy(self, blocking=False):
        if self in alive:
            alive.remove(self)
        return end(self, blocking)

    monkeypatch.setattr(fm_index, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", destroy)
    items = items_of(rows)
    found = mark(docs, spark.createDataFrame(items, ITEMS), ["doc_id", "text"])
    assert len(sent) > 1 and max(most) == 1 and not alive
    for r in found.collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == brute(r["text"], items, 10)


def test_passes_give_the_spans_and_texts_of_one(spark, docs, rows, monkeypatch):
    """Stretches that meet at a border of two blocks' phrases are one span, and hot equal texts are dealt out."""
    from quillstone import runtime

    text = "Keep, one-two Three; keep é four! five SIX tail"
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, text) for i in range(40)] + [(2000, None)], "doc_id long, text string"))
    items = spark.createDataFrame([*items_of(rows), (20, "ONE two three"), (21, "four"), (22, "five six")], ITEMS)
    said = lambda found: sorted((repr(tuple(r)) for r in found.collect()))
    whole = said(mark(df, items, ["doc_id"], window=4, cleaned=True))
    monkeypatch.setattr(fm_index, "BLOCK_BYTES", 400)
    monkeypatch.setattr(runtime, "HOT_ROWS", 5)
    assert said(mark(df, items, ["doc_id"], window=4, cleaned=True)) == whole
    assert any("Keep,  ; keep é   tail" in w for w in whole)


@pytest.mark.parametrize("block", [64 << 20, 10])
def test_clashing_names_and_long_texts(spark, monkeypatch, block):
    monkeypatch.setattr(fm_index, "BLOCK_BYTES", block)
    monkeypatch.setattr(fm_index, "SHARD_BYTES", 500)
    items = spark.createDataFrame([(7, "alpha beta gamma delta", "x"), (8, "not in there", "y")], ITEMS + ", spans string")
    long = "word " * 3000 + "alpha beta gamma delta"
    rows = [(1, "x alpha beta gamma delta", "a", "b", 5, "c"), (2, None, None, None, None, None), (3, long, "a", "b", 5, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, items string, spans string, n_hit int, text_ string")
    found = sorted(mark(df, items, ["doc_id", "items", "n_hit", "text_"], window=3).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["text_"]) for r in found] == [(1, 5, 4, ["7"], "c"), (2, 0, 0, [], None), (3, 3004, 4, ["7"], "c")]
