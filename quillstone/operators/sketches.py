"""Approximate statistics from mergeable sketches: each chunk of documents has its own, and those of any chunks are merged.

vocabulary is a HyperLogLog sketch of the tokens, lengths a KLL sketch of the documents' lengths in tokens, frequent a sketch of the tokens that most
documents have. Merging doesn't read postings again, so new chunks cost their own work only, and documents that two
chunks share count once in the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import FIELDS

#: Logarithm of the registers of a vocabulary sketch; its standard deviation is 1.04 / sqrt(2^LG).
LG = 14
#: Size of a length sketch; ranks are off by some 1.33 % at 200.
KLL = 200
#: Tokens that a sketch of frequent ones keeps; counts are off by 3.5 postings in TRACKED of all, at most.
TRACKED = 4096


def chunk_sketches(found: DataFrame, chunk: int) -> DataFrame:
    """(chunk, vocabulary, lengths, frequent) of postings, a chunk being so many documents."""
    rows = found.withColumn("chunk", F.floor(F.col("doc_ord") / chunk))
    of_tokens = rows.groupBy("chunk").agg(F.hll_sketch_agg("token", LG).alias("vocabulary"), F.expr(f"approx_top_k_accumulate(token, {TRACKED})").alias("frequent"))
    length = F.sum(sum((F.col(f) for f in FIELDS[1:]), F.col("t"))).alias("length")
    of_lengths = rows.groupBy("chunk", "doc_ord").agg(length).groupBy("chunk").agg(F.kll_sketch_agg_bigint("length", KLL).alias("lengths"))
    return of_tokens.join(of_lengths, "chunk").select("chunk", "vocabulary", "lengths", "frequent")


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of several chunks as one, or one for each value of some columns."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("vocabulary").alias("vocabulary"), F.kll_merge_agg_bigint("lengths").alias("lengths"), F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"))


def vocabulary_size(sketches: DataFrame) -> DataFrame:
    return sketches.select(F.hll_sketch_estimate("vocabulary").alias("vocabulary"))


def length_quantiles(sketches: DataFrame, ranks: list[float]) -> DataFrame:
    """(at, length): about the share at of documents is no longer than length."""
    values = [F.struct(F.lit(r).alias("at"), F.kll_sketch_get_quantile_bigint("lengths", F.lit(r)).alias("length")) for r in ranks]
    return sketches.select(F.explode(F.array(*values)).alias("q")).select("q.at", "q.length")


def frequent_tokens(sketches: DataFrame, k: int) -> DataFrame:
    """(token, df) of about the k tokens that most documents have."""
    return sketches.select(F.explode(F.expr(f"approx_top_k_estimate(frequent, {k})")).alias("t")).select(F.col("t.item").alias("token"), F.col("t.count").alias("df"))
