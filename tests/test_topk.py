import random

import pytest

from quillstone.operators import topk
from quillstone.plans.build import build_index, load, search_index, search_index_top
from quillstone.sources import store

SCHEMA = "doc_ord long, title string, text string"


def read_of(df):
    """Rows that the scan of postings gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    rows, todo = 0, [plan.executedPlan() if "Adaptive" in plan.getClass().getName() else plan]
    while todo:
        node = todo.pop()
        if "QueryStage" in node.getClass().getName():
            todo.append(node.plan())
            continue
        if "FileSourceScan" in node.getClass().getName() and "/postings" in node.toString():
            rows += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(1)
    path = str(tmp_path_factory.mktemp("top"))
    rows = [(i, f"Title {'common' if rng.random() < 0.01 else i}", f"common word{i % 50} " + "rare " * (i % 997 == 0) + "common " * rng.choice((0, 0, 0, 1, 2, 7 if rng.random() < 0.01 else 0))) for i in range(12_000)]
    rows += [(20_000, None, None), (20_001, "", "common " * 50)]
    old = store.BLOCK_ROWS
    store.BLOCK_ROWS = 256
    try:
        build_index(spark.createDataFrame(rows, SCHEMA), path, stem=False).collect()
    finally:
        store.BLOCK_ROWS = old
    return path


LINES = ["common", "t:common", "common rare word7", "b:rare t:common", "word1 word2 t:common i:common", "nothing", "common common", ""]


@pytest.mark.parametrize("k", [1, 3, 10, 400])
def test_the_same_rows_as_a_whole_search(spark, index, k, monkeypatch):
    lines = spark.createDataFrame(list(enumerate(LINES)), "query_id int, line string")
    want = sorted(map(tuple, search_index(spark, index, lines, k, stem=False).collect()))
    assert sorted(map(tuple, search_index_top(spark, index, lines, k, stem=False).collect())) == want and want
    monkeypatch.setattr(topk, "MAX_BLOCKS", 0)
    assert sorted(map(tuple, search_index_top(spark, index, lines, k, stem=False).collect())) == want


def test_blocks_that_cannot_answer_are_not_read(spark, index):
    line = spark.createDataFrame([(0, "common")], "query_id int, line string")
    whole, some = read_of(search_index(spark, index, line, 3, stem=False)), read_of(search_index_top(spark, index, line, 3, stem=False))
    assert whole > 12_000 and 0 < some <= 3 * 256


def test_blocks_hold_what_postings_hold(spark, index):
    found = load(spark, index)
    spark_rows = {(r["token"], r["block"]): r for r in found.blocks.collect()}
    counted = {}
    for r in found.blocked.collect():
        counted.setdefault((r["token"], r["block"]), []).append(r)
    assert counted.keys() == spark_rows.keys() and len(counted) < sum(map(len, counted.values())) / 4
    for key, rows in counted.items():
        b = spark_rows[key]
        weighted = [10 * r["t"] + 5 * r["i"] + r["b"] + 5 * r["c"] + 2 * r["r"] + 2 * r["l"] for r in rows]
        assert (b["n"], b["first"], b["last"], b["most_b"], b["most_z"]) == (len(rows), min(r["doc_ord"] for r in rows), max(r["doc_ord"] for r in rows), max(r["b"] for r in rows), max(weighted))
    stats = found.stats.first()
    assert stats["n_docs"] == 12_002 and stats["n_postings"] == sum(map(len, counted.values()))


def test_bytes_are_those_of_the_files(spark, index, tmp_path):
    from pathlib import Path

    built = build_index(spark.createDataFrame([(0, "One", "thor hammer"), (1, "Two", "thor")], SCHEMA), str(tmp_path / "i")).first()
    files = [p for p in (tmp_path / "i").rglob("*") if p.is_file() and not p.name.endswith(".crc")]
    assert built["bytes"] == sum(p.stat().st_size for p in files) and built["vocabulary"] == 4 and Path(index).exists()
