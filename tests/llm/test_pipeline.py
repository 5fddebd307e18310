import hashlib

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from quillstone.llm import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    from .test_fm_index import brute as hits
    from .test_near_dup import brute as groups
    from .test_pii import base

    docs, tables = spark.read.parquet(f"{DATA}/documents.parquet"), []
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        tables.append(docs)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    kept, single, clean, safe, encoded = ({r["doc_id"]: r for r in t.collect()} for t in tables)

    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [i for i, r in labels.items() if r["quality"] == 1 and not r["toxic"]]
    assert sum(i in kept for i in good) / len(good) > 0.97

    component = groups([(i, r["text"]) for i, r in kept.items()])
    assert set(single) == {i for i, c in component.items() if i == c}

    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    for i, r in single.items():
        if not hits(r["text"], items, 10)[1]:
            assert clean[i]["text"] == r["text"]
        else:
            assert not hits(clean[i]["text"], items, 10)[1]
    assert set(clean) == set(safe) == set(encoded) == set(single)
    assert not any(base(r["text"]) for r in safe.values())
    assert all(r["decodes"] and r["n_pieces"] == len(r["ids"]) for r in encoded.values())
    for r in encoded.values():
        raw = b"".join(int(x).to_bytes(4, "little") for x in r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(raw).hexdigest()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows_of_each_stage(spark, docs, rows, no_docs, name, stage):
    clash = docs
    for c in ("accepted", "kept", "component_id", "items", "spans", "text_", "ids", "node"):
        clash = clash.withColumn(c, docs["lang"])
    found = stage(spark, clash, DATA)
    ids = [r["doc_id"] for r in found.collect()]
    assert len(ids) <= len(rows) and (name in ("quality", "near_dedup") or len(ids) == len(rows))
    assert None in ids or name == "quality"
    assert stage(spark, no_docs, DATA).collect() == []


def test_run_and_queries(spark):
    import os

    from quillstone.runtime import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, DATA).count() > 100
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and "pipeline" in left.pop()
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", [n for n in sorted(registry.queries()) if n.split("_")[0] in ("op11", "op12")])
def test_query_has_the_rows_of_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    n = con.execute(f"SELECT count(*) FROM ({registry.oracle_sql()[name]})").fetchone()[0]
    assert registry.queries()[name](spark, DATA).count() == n > 0


@pytest.mark.parametrize("name", [n for n in sorted(registry.queries()) if n.split("_")[0] not in ("op11", "op12")])
def test_query_covers_its_table(spark, name):
    table = {"op1": "pages", "op9": "embeddings"}.get(name.split("_")[0], "documents")
    found = registry.queries()[name](spark, DATA)
    n = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert found.count() == (n if table != "embeddings" else 25 * 20)
