import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillstone.llm import exact_dup
from quillstone.llm.exact_dup import exact_duplicates, filter_blocks

NAMES = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    """(id, digest, group size, id that stays) of every row, and how many rows of each group stay."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append((-len(t or ""), i is None, i or 0, i))
    best = {p: min(g)[3] for p, g in groups.items()}
    return Counter((i, best[plain(t)], len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in rows)


def check(found, rows):
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == brute(rows)
    stays = [r for r in found if r["kept"]]
    assert len({r["text_sha256"] for r in stays}) == len(stays) == len({plain(t) for _, t in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in stays)


@pytest.mark.parametrize("filter_bytes, cells", [(64 << 20, 12), (1 << 17, 100_000), (1 << 17, 12)])
def test_against_brute_force(docs, rows, monkeypatch, filter_bytes, cells):
    """With one filter, and with a filter for each of several ranges of hashes."""
    monkeypatch.setattr(exact_dup, "FILTER_BYTES", filter_bytes)
    monkeypatch.setattr(exact_dup, "CELLS", cells)
    assert (filter_blocks(len(rows))[1] > 1) == (cells > 12)
    found = exact_duplicates(docs)
    assert tuple(found.columns) == NAMES
    check(found.collect(), [(r[0], r[1]) for r in rows])


def test_blanks_ties_nulls_and_unicode(spark):
    rows = [
        (7, "a b"), (3, "a\tb"), (5, "ab"), (9, " a b "), (2, " ab  "), (None, "  a b"),  # the longest, then the smallest id
        (1, "a b"), (4, "a  b"), (6, "\x1ca"), (8, "a"),  # other blanks count
        (10, None), (11, ""), (12, " \n\r\x0b\x0c"), (13, "x" * 300_000), (14, "x " * 300_000), (15, "\U0001f600 é"), (16, "\U0001f600é"),
        (20, "same"), (20, "same"), (None, "same"),
    ]
    found = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(found, rows)
    assert next(r["keep_id"] for r in found if r["doc_id"] == 7) == 2


def test_a_hot_text_is_dealt_out_and_whole(spark):
    rows = [(i, "hot text" + " " * (i % 3)) for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 6000)]
    found = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    check(found, rows)
    assert sum(r["kept"] for r in found) == 3001


def test_single_rows_pass_without_a_shuffle(spark, docs):
    plan = exact_duplicates(docs)._jdf.queryExecution().optimizedPlan().toString()
    straight = plan[plan.index("MapInArrow") :]
    assert "Union" in plan and "Join" not in straight.partition("Join")[0]


def test_filter_misses_no_repeat_and_passes_few_single_ones():
    rng = np.random.default_rng(3)
    n = 200_000
    blocks, ranges = filter_blocks(n)
    hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    copies = hashes[:5000]
    bits = []
    for b in range(blocks):
        where = lambda h: exact_dup.places(h, blocks)[1][exact_dup.places(h, blocks)[0] == b]  # noqa: B023,E731
        bits.append(np.frombuffer(exact_dup.met_twice(np.concatenate((where(hashes), where(copies))), np.zeros(0, np.uint32)), np.uint8))
    bits = np.unpackbits(np.concatenate(bits))
    block, inner = exact_dup.places(hashes, blocks)
    maybe = np.all([bits[block.astype(np.int64) * exact_dup.BLOCK + c] for c in exact_dup.cells(inner)], axis=0)
    assert ranges == 1 and maybe[:5000].all() and maybe[5000:].mean() < 0.03


def test_filters_are_bounded():
    for n in (0, 1, 10**6, 10**9, 10**11):
        blocks, ranges = filter_blocks(n)
        assert 1 <= ranges <= exact_dup.RANGES and -(-blocks // ranges) * exact_dup.BLOCK // 8 <= exact_dup.FILTER_BYTES


def test_empty_extra_and_clashing_columns(spark, no_docs):
    assert exact_duplicates(no_docs).collect() == []
    odd = spark.createDataFrame([(1, "a", "x", 5, True, "k", 1), (2, "a ", "y", 6, False, "l", 2)], "doc_id long, text string, kept string, group_size int, maybe boolean, row string, place int")
    found = sorted(exact_duplicates(odd, keep=["doc_id", "kept", "row", "place", "text"]).collect())
    assert [(r["doc_id"], r["keep_id"], r["kept"], r["row"], r["place"], r["text"]) for r in found] == [(1, 2, False, "k", 1, "a"), (2, 2, True, "l", 2, "a ")]
    strings = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "name string, body string")
    assert {(r["name"], r["keep_id"]) for r in exact_duplicates(strings, "name", "body").collect()} == {("b", "a"), ("a", "a"), (None, "a")}
