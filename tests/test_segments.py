import random

import pytest

from quillstone.plans.build import build_index, search_index
from quillstone.sources import segments as G
from quillstone.sources.segments import Conflict, SegmentedIndex
from quillstone.streaming.ingest import ingest_updates

SCHEMA = "doc_ord long, title string, text string"
WORDS = ["thor", "hammer", "storm", "odin", "loki"]


def frame(spark, pages):
    return spark.createDataFrame([(i, *p) for i, p in pages.items()], SCHEMA)


def page(rng, i):
    return f"Page {rng.choice(WORDS)}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))


def answers(spark, source):
    lines = spark.createDataFrame([(1, "thor hammer"), (2, "t:odin b:storm"), (3, "loki unknown")], "query_id int, line string")
    return sorted(map(tuple, (source.search(lines, 50) if hasattr(source, "search") else search_index(spark, source, lines, 50)).collect()))


def rebuilt(spark, pages, path):
    build_index(frame(spark, pages), path).collect()
    return answers(spark, path)


def test_updates_and_deletes_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "LEAST_BYTES", 1 << 30)
    rng, index, now = random.Random(1), SegmentedIndex(spark, str(tmp_path / "i")), {}
    for step in range(5):
        new = {i: page(rng, i) for i in rng.sample(range(20), 8)}
        gone = [] if not step else [*rng.sample(range(20), 4), 999]
        assert index.apply(frame(spark, new), spark.createDataFrame([(i,) for i in gone], "doc_ord long") if gone else None) == step + 1
        now = {i: p for i, p in now.items() if i not in gone} | new
    want = rebuilt(spark, now, str(tmp_path / "r"))
    before = index.snapshot()
    assert answers(spark, before) == want and index.commit().n_docs == len(now) == before.titles.count() and len(index.commit().segments) == 5
    index.merge()
    assert len(index.commit().segments) == 1 and not index.commit().tombstones and answers(spark, index.snapshot()) == want == answers(spark, before)
    index.apply(None, spark.createDataFrame([(min(now),)], "doc_ord long"))
    now.pop(min(now))
    assert index.vacuum() and not index.vacuum()
    assert answers(spark, index.snapshot()) == rebuilt(spark, now, str(tmp_path / "r2")) and index.commit().n_docs == len(now)


def test_merging_some_segments_keeps_what_replaces_the_rest(spark, tmp_path, monkeypatch):
    index = SegmentedIndex(spark, str(tmp_path / "i"))
    index.apply(frame(spark, {0: ("a", "thor " * 9), 1: ("b", "hammer")}))
    index.apply(frame(spark, {2: ("c", "storm"), 0: ("a", "odin")}))
    index.apply(frame(spark, {3: ("d", "loki"), 2: ("c", "thor")}))
    last = index.commit()
    index._merged(last, [last.segments[0], last.segments[2]])  # not neighbours
    want = rebuilt(spark, {0: ("a", "odin"), 1: ("b", "hammer"), 2: ("c", "thor"), 3: ("d", "loki")}, str(tmp_path / "r"))
    assert answers(spark, index.snapshot()) == want and [s.version for s in index.commit().segments] == [2, 3]


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    index = SegmentedIndex(spark, str(tmp_path / "i"))
    with pytest.raises(FileNotFoundError):
        index.snapshot()
    index.apply(frame(spark, {0: ("a", "thor"), 1: ("b", "hammer")}))
    want = answers(spark, index.snapshot())
    monkeypatch.setattr(index, "_make", lambda commit: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.apply(frame(spark, {0: ("a", "storm"), 2: ("c", "thor")}))
    monkeypatch.undo()
    assert answers(spark, index.snapshot()) == want and index.commit().number == 1
    stale = index.commit()
    index.apply(frame(spark, {5: ("e", "odin")}))
    monkeypatch.setattr(index, "commit", lambda: stale)  # a writer that hasn't seen the last commit
    with pytest.raises(Conflict):
        index.apply(frame(spark, {6: ("f", "odin")}))
    monkeypatch.undo()
    assert index.commit().number == 2 and index.commit().n_docs == 3


def test_odd_batches(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "i"), stem=False)
    rows = [(0, "a", "thor", 2), (0, "b", "hammer", 5), (0, "c", "storm", 1), (1, None, None, None), (None, "x", "thor", 1), (2, "x", "odin", None), (2, "x", "odin", None)]
    index.apply(spark.createDataFrame(rows, SCHEMA + ", seq int"), spark.createDataFrame([(0,), (None,)], "doc_ord long"))
    found = {(r["token"], r["doc_ord"]) for r in index.snapshot().postings.collect()}
    assert found == {("hammer", 0), ("odin", 2)} and index.commit().n_docs == 3 and index.snapshot().titles.count() == 3
    index.apply(frame(spark, {}) if False else spark.createDataFrame([], SCHEMA))
    index.apply()
    assert index.commit().n_docs == 3 and index.snapshot().postings.count() == 2


def test_a_stream_of_updates(spark, tmp_path):
    for i, pages in enumerate(({0: ("a", "thor"), 1: ("b", "hammer")}, {0: ("a", "storm"), 2: ("c", "odin")})):
        frame(spark, pages).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    index = SegmentedIndex(spark, str(tmp_path / "i"), stem=False)
    ingest_updates(stream, index, str(tmp_path / "state")).awaitTermination()
    held = {(r["token"], r["doc_ord"]) for r in index.snapshot().postings.collect()}
    assert {("hammer", 1), ("odin", 2)} < held and len(held) == 3 and index.commit().batch == 1
    assert index.apply(frame(spark, {9: ("z", "thor")}), batch=1) == index.commit().number  # a batch that is run again
    assert index.snapshot().postings.count() == 3
