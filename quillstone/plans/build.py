"""Building an index, and answering query lines from a stored one."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import INDEX_V2, TokenizerConfig
from ..operators.extract import extract_fields
from ..operators.counting import positions_of, row_postings
from ..operators.postings import SHARD_TOKENS
from ..operators.search import Searcher, search
from ..operators.topk import search_blocks
from ..runtime import materialize, scratch
from ..sources.store import Index, load, save, stored_size


def index_pages(pages: DataFrame, config: TokenizerConfig = INDEX_V2, stem: bool = True, extra_stop_words: tuple[str, ...] = (), positions: bool = False) -> Index:
    """Postings of pages(doc_ord, title, text), counted in each page's row and kept as a scratch table, and titles.

    With positions, a posting has the places of its token too, made in the same pass over the texts. No text is shuffled.
    """
    counted = materialize(row_postings(extract_fields(pages), config, stem, extra_stop_words, positions), "counts")
    return Index(counted, pages.select("doc_ord", "title"), positions=positions_of(counted) if positions else None)


def build_index(pages: DataFrame, path: str, config: TokenizerConfig = INDEX_V2, stem: bool = True, extra_stop_words: tuple[str, ...] = (), positions: bool = False) -> DataFrame:
    """Write the index of pages to path; one row (seconds, vocabulary, shards, bytes).

    shards is the number of SHARD_TOKENS tokens that the vocabulary makes; tokens are found by statistics, not by shards.
    """
    spark, began = pages.sparkSession, time.time()
    with scratch():
        save(index_pages(pages, config, stem, extra_stop_words, positions), path)
    shards = F.when(F.col("vocabulary") > 0, F.floor(F.col("vocabulary") / (SHARD_TOKENS + 1)) + 1).otherwise(0)
    row = spark.read.parquet(f"{path}/stats").select("vocabulary", shards.cast("long").alias("shards"))
    return row.select(F.lit(time.time() - began).alias("seconds"), "vocabulary", "shards", F.lit(stored_size(spark, path)).alias("bytes"))


def search_index(spark: SparkSession, path: str, lines: DataFrame, k: int = 10, stem: bool = True, aggregate: bool = False) -> DataFrame:
    """Ranked answers of a stored index to lines(query_id, line)."""
    index = load(spark, path)
    return search(lines, index.postings, index.frequencies, index.n_docs, index.titles, k, stem, aggregate)


def search_index_top(spark: SparkSession, path: str, lines: DataFrame, k: int = 10, stem: bool = True) -> DataFrame:
    """The same answers as search_index gives, entries not added up, from the blocks of postings that can hold them."""
    index = load(spark, path)
    return search_blocks(lines, index.blocked, index.blocks, index.frequencies, index.n_docs, index.titles, k, stem)


def open_index(spark: SparkSession, path: str) -> Searcher:
    """A stored index that keeps what its batches have read."""
    index = load(spark, path)
    return Searcher(index.postings, index.frequencies, index.n_docs, index.titles)


__all__ = ["build_index", "index_pages", "load", "open_index", "save", "search_index", "search_index_top"]
