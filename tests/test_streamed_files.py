from quillstone import registry


class Stopped(Exception):
    pass


def test_a_stream_of_pages_has_files_for_all_splits(spark, tmp_path, monkeypatch):
    """No file of the stream has half of all pages once the documents lie in several splits."""
    rows = [(i, f"text {i}", "en", "src1", 6) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    paths = []

    def scratch_path(spark, tag):
        paths.append(str(tmp_path / tag))
        return paths[-1]

    def ingest(*args):
        raise Stopped

    monkeypatch.setattr(registry, "scratch_path", scratch_path)
    monkeypatch.setattr(registry, "ingest", ingest)
    try:
        registry.streamed_search_batch(spark, str(tmp_path))
    except Stopped:
        pass
    written = spark.read.parquet(paths[0])
    splits = registry.markup_pages(spark, str(tmp_path))._jdf.rdd().getNumPartitions()
    assert written.count() == 400 and len(written.inputFiles()) == 2 * splits
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        monkeypatch.setattr(registry, "scratch_path", lambda spark, tag: paths.append(str(tmp_path / f"more-{tag}")) or paths[-1])
        registry.streamed_search_batch(spark, str(tmp_path))
    except Stopped:
        pass
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(spark.read.parquet(str(tmp_path / "more-incoming")).inputFiles()) > 4
