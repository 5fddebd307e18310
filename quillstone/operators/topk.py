"""Top-k search that reads only the blocks of postings that can hold an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import FIELDS, WEIGHTS, idf
from .search import bounded, rank, score
from .queryparse import parse

#: Blocks of a batch whose numbers become a filter of the scan; more of them are joined.
MAX_BLOCKS = 10_000


def block_bound():
    """The largest weighted count that a block's postings have of what a term asks for."""
    out = F.when(F.col("field") == "z", F.col("most_z"))
    for f in FIELDS:
        out = out.when(F.col("field") == f, F.col(f"most_{f}") * WEIGHTS[f])
    return out


def best_blocks(terms: DataFrame, blocks: DataFrame, frequencies: DataFrame, n_docs: DataFrame, k: int) -> DataFrame:
    """(query_id, token, block) of the k blocks of each query that can hold its k best entries.

    A block's bound is reached by one of its entries at least. In order of bound, term and first document, as entries
    are ranked, the first k blocks hold k entries, none of which any entry of a later block comes before: its score
    is its block's bound at most, and where scores are equal it belongs to a later term or a larger document.
    """
    weighed = terms.join(frequencies, "token").crossJoin(n_docs)  # n_docs is one row
    weighed = weighed.withColumn("idf", idf(F.col("n_docs"), F.col("df")))
    bounds = blocks.join(weighed, "token").withColumn("bound", F.round(block_bound().cast("long") * F.col("idf"), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "field_pos", "pos", "first")
    return bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "token", "block")


def search_blocks(lines: DataFrame, blocked: DataFrame, blocks: DataFrame, frequencies: DataFrame, n_docs: DataFrame, titles: DataFrame, k: int = 10, stem: bool = True) -> DataFrame:
    """Ranked answers to lines(query_id, line), the same as search() gives where entries aren't added up.

    First the table of blocks is read for the lines' tokens, then of the postings the best k blocks of each line at most.
    Block numbers rise with (token, doc_ord), so a filter by them reaches the scan and statistics skip the rest.
    """
    terms, words = bounded(parse(lines, stem))
    if words is not None:
        blocks, frequencies = (df.where(F.col("token").isin(words)) for df in (blocks, frequencies))
        frequencies = F.broadcast(frequencies)  # a row for each of the words at most
    chosen = best_blocks(terms, blocks, frequencies, n_docs, k).select("token", "block").distinct()
    rows = chosen.limit(MAX_BLOCKS + 1).collect()
    if len(rows) <= MAX_BLOCKS:
        numbers, tokens = sorted({r["block"] for r in rows}), sorted({r["token"] for r in rows})
        found = blocked.where(F.col("block").isin(numbers) & F.col("token").isin(tokens))
    else:
        found = blocked.join(chosen, ["token", "block"], "left_semi")
    return rank(score(terms, found.drop("block"), frequencies, n_docs), titles, k, few=words is not None)
