"""Continuous indexing: every micro-batch of new pages adds its part of an index, which is searchable as it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import INDEX_V2, TokenizerConfig
from ..operators.postings import corpus_statistics, document_frequencies
from ..operators.search import search
from ..plans.build import index_pages
from ..runtime import scratch
from ..sources.segments import SegmentedIndex
from ..sources.store import Index, ranges_of, save


def ingest(pages: DataFrame, path: str, checkpoint: str, config: TokenizerConfig = INDEX_V2, stem: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """Start indexing a stream of new pages(doc_ord, title, text) into tables under path; trigger as for ingest_updates().

    A page's postings depend on that page alone, so batches need no state: a batch adds its postings and titles,
    its own document frequencies and its own statistics, which a search adds up. Each batch overwrites a folder
    of its own number, so a batch that is run again after a failure isn't counted twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def write(df: DataFrame, name: str) -> DataFrame:
            place = f"{path}/{name}/batch={number}"
            df.write.mode("overwrite").parquet(place)
            return spark.read.parquet(place)

        with scratch():
            part = index_pages(batch, config, stem)
            dealt = part.postings.repartitionByRange(ranges_of(part.postings), "token", "doc_ord")
            found = write(dealt.sortWithinPartitions("token", "doc_ord"), "postings")
            titles = write(part.titles, "titles")
            frequencies = write(document_frequencies(found).sortWithinPartitions("token"), "frequencies")
            write(corpus_statistics(titles, found, frequencies).drop("vocabulary"), "stats")

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_updates(pages: DataFrame, index: SegmentedIndex, checkpoint: str, trigger: dict | None = None, merge: bool = False) -> StreamingQuery:
    """Start applying a stream of pages(doc_ord, title, text) to an index, in which a page that comes again replaces the former one.

    A batch is one commit; one that is run again after a failure isn't applied twice. With merge, segments of like size are
    merged after each batch. trigger holds the arguments of DataStreamWriter.trigger(); by default the query ends when
    what is there has been read.
    """

    def add(batch: DataFrame, number: int) -> None:
        index.apply(batch, batch=number)
        if merge:
            index.merge()

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@dataclass
class StreamedIndex:
    """What the batches so far have added: postings and titles, frequencies and statistics summed over batches."""

    postings: DataFrame
    titles: DataFrame
    frequencies: DataFrame
    n_docs: DataFrame

    def search(self, lines: DataFrame, k: int = 10, stem: bool = True, aggregate: bool = False) -> DataFrame:
        """Ranked answers to lines(query_id, line); token filters reach the scans of all batches."""
        return search(lines, self.postings, self.frequencies, self.n_docs, self.titles, k, stem, aggregate)

    def compact(self, path: str) -> None:
        """Write everything as one stored index, in ranges of tokens."""
        save(Index(self.postings, self.titles), path)


def load_streamed(spark: SparkSession, path: str) -> StreamedIndex:
    """The index under path as of now."""
    tables = {t: spark.read.parquet(f"{path}/{t}").drop("batch") for t in ("postings", "titles", "frequencies", "stats")}
    frequencies = tables["frequencies"].groupBy("token").agg(F.sum("df").alias("df"))
    return StreamedIndex(tables["postings"], tables["titles"], frequencies, tables["stats"].agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs")))
