import hashlib

import pytest

from quillstone.llm import rlz_dedup
from quillstone.llm.rlz_dedup import WINDOW, remove_duplicates


def brute(rows):
    """What is kept of each row, by all windows."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in split:
        if i is not None:
            for j in range(len(w) - WINDOW + 1):
                key = tuple(w[j : j + WINDOW])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for j in range(len(w) - WINDOW + 1):
                if first[tuple(w[j : j + WINDOW])] < i:
                    gone.update(range(j, j + WINDOW))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block, group", [(3 << 20, 1 << 20), (2000, 500)])
def test_against_brute_force(docs, rows, monkeypatch, block, group):
    monkeypatch.setattr(rlz_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(rlz_dedup, "GROUP_BYTES", group)
    found = remove_duplicates(docs.withColumn("n_words", docs["n_chars"]), ["doc_id", "n_words"], texts=False)
    assert rows_of(found) == sorted(brute(rows), key=str)


def test_factors_copy_from_smaller_documents(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words[:50])), (2, " ".join(words[50:])), (3, " ".join(["x", *words[10:40], "y", *words[55:90], "z"])), (4, " ".join(words[20:32]))]
    found = remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], details=True)
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert [tuple(f) for f in by_id[3]["factors"]] == [(1, 30, 1, 10), (32, 35, 2, 5)]
    assert by_id[3]["text"] == "x y z" and by_id[4]["n_removed"] == 0 and by_id[1]["factors"] == []


def test_factor_boundaries(spark):
    """Two factors of fewer words than a window each side of a boundary that is itself in the reference."""
    a, b, c = ([f"{x}{i}" for i in range(12)] for x in "abc")
    rows = [(1, " ".join([*a, *b])), (2, " ".join([*b, *c])), (3, " ".join([*a, *b, *c])), (4, " ".join([*a, *c]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in remove_duplicates(df, ["doc_id"]).collect()} == {1: 0, 2: 0, 3: 36, 4: 0}


def test_empty_table(no_docs):
    assert remove_duplicates(no_docs, ["doc_id"]).collect() == []


def test_a_passage_of_every_document_is_sent_once_a_task():
    import numpy as np

    from quillstone.llm._words import WordHasher

    passage, hasher = " ".join(f"p{i}" for i in range(40)), WordHasher()

    def sent(passages, blocks=30):
        windows = 0
        for k in range(blocks):
            ids = np.arange(k * 10, k * 10 + 10)
            raws = [f"own{i} {passage} tail{i}".encode() for i in ids]
            for batch in rlz_dedup._index_block(ids, np.zeros(10, np.int32), raws, hasher, 1, passages or rlz_dedup.Passages()):
                windows += sum(len(rlz_dedup._read(b)[3]) for b in batch.column(1).to_pylist() if b)
        return windows

    inner = 40 - WINDOW + 1
    assert sent(None) >= 30 * inner and sent(rlz_dedup.Passages()) == sent(None) - 29 * inner


def test_clashing_names(docs, rows):
    df = docs
    for name in ("__factors__", "__hash__", "hash", "tag", "packed", "whole", "factors", "id"):
        df = df.withColumn(name, docs["lang"])
    found = remove_duplicates(df, ["doc_id", "__hash__", "hash", "packed", "whole", "__factors__"], texts=False)
    assert rows_of(found) == sorted(brute(rows), key=str)
