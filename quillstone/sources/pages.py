"""Page sources: XML dumps and the markup view of a documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import fresh, materialize, numbered

DUMP_SCHEMA = "title string, ns int, id long, revision struct<id:long,text:string>"


def with_ordinals(rows: DataFrame, name: str = "doc_ord") -> DataFrame:
    """Adds a column with each row's place in source order from 0 without gaps: files by path, a file's rows as they lie.

    rows comes straight from a file source. It is parsed once and kept as a scratch table; splits' sizes are counted
    there, and their offsets, a short row for each split, are broadcast. Text is never shuffled.
    """
    place, path, first = (fresh(c, rows) for c in ("place", "path", "first_byte"))
    located = rows.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.file_block_start").alias(first))
    stored = materialize(located.withColumn(place, F.monotonically_increasing_id()), "pages")
    return numbered(stored, place, name, path, first)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(doc_ord, page_id, title, text) of a page dump; titles and texts are kept whole, missing ones are empty."""
    raw = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(DUMP_SCHEMA).load(path)
    pages = with_ordinals(raw)
    return pages.select("doc_ord", F.col("id").alias("page_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("revision.text", F.lit("")).alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, line) of a text file, a query a line, numbered from 0."""
    return with_ordinals(spark.read.text(path).withColumnRenamed("value", "line"), "query_id").select("query_id", "line")


def write_dump(pages: DataFrame, path: str) -> None:
    """Write pages(doc_ord, title, text) as a page dump in order of doc_ord, in files by ranges of it."""
    revision = F.struct(F.col("doc_ord").alias("id"), F.col("text").alias("text"))
    rows = pages.select("title", F.lit(0).alias("ns"), F.col("doc_ord").alias("id"), revision.alias("revision"))
    rows.repartitionByRange("id").sortWithinPartitions("id").write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)


def markup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_ord, title, text) over the documents table: an infobox, the text, and for three rows of four a tail with sections."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    text = F.concat(F.lit("{{Infobox document | lang = "), "lang", F.lit(" | source = "), "source", F.lit("}} "), "text", tail())
    return docs.select(F.col("doc_id").alias("doc_ord"), F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" "), "source").alias("title"), text.alias("text"))


def tail():
    """The sections that follow a text in the markup view."""
    first = F.concat(F.lit(" == References == *[note "), "source", F.lit("]\n[[Category:"), "lang", F.lit("]] ==External links== * [http://example.org/"), F.col("doc_id").cast("string"), F.lit(" site "), "lang", F.lit("] "))
    other = F.concat(F.lit(" ==References== *[alpha beta] [[Category:"), "source", F.lit("]][[Category:docs]] == External links == * [http://e.org/x label] "))
    return F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, first).otherwise(other)
