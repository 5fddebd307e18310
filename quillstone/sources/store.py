"""The stored index: Parquet tables that readers can prune by token or document."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import FIELDS, weighted_tf
from ..operators.counting import positions_of
from ..operators.lexicon import deletion_table, gram_table
from ..operators.postings import posting_lists
from ..runtime import stored_bytes

#: Postings of a block, whose largest counts the table of blocks has.
BLOCK_ROWS = 4096
#: Stored bytes of a range of postings where there are more than cores' worth, and of one that is worth a core.
RANGE_BYTES, LEAST_BYTES = 128 << 20, 1 << 20


@dataclass
class Index:
    """Postings and titles, and what a stored index has besides: blocks of postings, document frequencies, one row of statistics, and places of tokens where these were asked for."""

    postings: DataFrame
    titles: DataFrame
    frequencies: DataFrame | None = None
    blocks: DataFrame | None = None
    stats: DataFrame | None = None
    positions: DataFrame | None = None
    blocked: DataFrame | None = None

    @property
    def n_docs(self) -> DataFrame:
        return self.stats.select("n_docs")


def ranges_of(df: DataFrame) -> int:
    """Ranges to deal a table into: RANGE_BYTES each, but not fewer than cores while each has LEAST_BYTES."""
    size, cores = stored_bytes(df), df.sparkSession.sparkContext.defaultParallelism
    if size is None:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // RANGE_BYTES), min(cores, size // LEAST_BYTES))


def save(index: Index, path: str, partitions: int | None = None) -> None:
    """Write an index. Postings are dealt by ranges of (token, doc_ord), so a frequent token may span several files, and
    sorted, so that statistics of row groups and pages answer lookups of tokens and of blocks. Places of tokens, where the
    postings have them, are a column that only positional searches read: what has places is dealt and sorted once.

    Blocks are runs of BLOCK_ROWS stored postings. The table of blocks has a row for each token in a block: how many postings,
    the first and last document, and the largest counts. Document frequencies and statistics are sums of it.
    Ranges follow from the stored bytes of the postings where these are a table. Small tables are written beside each other.
    """
    spark = index.postings.sparkSession
    n = partitions or ranges_of(index.postings)

    def ranged(df: DataFrame, name: str, *keys: str) -> None:
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/{name}")

    with ThreadPoolExecutor(2) as pool:
        titles = pool.submit(ranged, index.titles, "titles", "doc_ord")
        sorted_ = index.postings.repartitionByRange(n, "token", "doc_ord").sortWithinPartitions("token", "doc_ord")
        numbered = sorted_.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK_ROWS))
        numbered.write.mode("overwrite").option("parquet.page.row.count.limit", BLOCK_ROWS).parquet(f"{path}/postings")
        stored = spark.read.parquet(f"{path}/postings")
        most = [F.max(f).alias(f"most_{f}") for f in FIELDS] + [F.max(weighted_tf()).alias("most_z")]
        occurrences = F.sum(sum((F.col(f) for f in FIELDS[1:]), F.col("t"))).alias("occurrences")
        blocks = stored.groupBy("token", "block").agg(F.count("*").alias("n"), occurrences, F.min("doc_ord").alias("first"), F.max("doc_ord").alias("last"), *most)
        ranged(blocks, "blocks", "token", "block")
        blocks = spark.read.parquet(f"{path}/blocks")
        ranged(blocks.groupBy("token").agg(F.sum("n").alias("df")), "frequencies", "token")
        titles.result()
        pages = spark.read.parquet(f"{path}/titles").agg(F.count("*").alias("n_docs"))
        words = spark.read.parquet(f"{path}/frequencies").agg(F.count("*").alias("vocabulary"), F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("n_postings"))
        counts = blocks.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).cast("long").alias("n_occurrences"))
        pages.crossJoin(words).crossJoin(counts).write.mode("overwrite").parquet(f"{path}/stats")  # one row each


def save_lexicon(spark: SparkSession, path: str) -> None:
    """Add to an index the tables by which misspelt words and wildcards find tokens, in ranges of what is looked up."""
    vocabulary = spark.read.parquet(f"{path}/frequencies").select("token")
    for name, table, key in (("deletions", deletion_table(vocabulary), "variant"), ("grams", gram_table(vocabulary), "gram")):
        table.repartitionByRange(key, "token").sortWithinPartitions(key, "token").write.mode("overwrite").parquet(f"{path}/{name}")


def load_lexicon(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(deletions, grams) of an index."""
    return spark.read.parquet(f"{path}/deletions"), spark.read.parquet(f"{path}/grams")


def load(spark: SparkSession, path: str) -> Index:
    """A stored index; positions are None where it has none."""
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in ("postings", "titles", "frequencies", "blocks", "stats")}
    blocked = tables.pop("postings")
    positions = positions_of(blocked) if "gaps" in blocked.columns else None
    blocked = blocked.drop("gaps")
    return Index(blocked.drop("block"), **tables, blocked=blocked, positions=positions)


def stored(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def export_text(index: Index, path: str, partitions: int | None = None) -> None:
    """Write posting lists as text, a line token:postings for each of a token's chunks, in ranges and sorted within files."""
    n = partitions or int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = posting_lists(index.postings).repartitionByRange(n, "token", "chunk").sortWithinPartitions("token", "chunk")
    lists.select(F.concat("token", F.lit(":"), "postings").alias("value")).write.mode("overwrite").text(path)


def stored_size(spark: SparkSession, path: str) -> int:
    """Bytes of a stored index, whatever file system holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
