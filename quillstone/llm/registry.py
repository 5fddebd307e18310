"""Contract queries of the corpus operators: thin wrappers that name the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_model import judge

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op2_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weak_quality import classify

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, ["doc_id"], labels)


def op4_token_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_fst import count_tokens

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = count_tokens(docs, ["doc_id"], str(public_tokenizers.path("byte_bpe_50k.json")))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op5_pii_transducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import detect

    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


def op6_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shard_tree import assign, layout

    placed = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), layout(16), layout(17))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rlz_dedup import remove_duplicates

    return remove_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], texts=False)


def op8_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_lattice import encode

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoded = encode(docs, ["doc_id"], str(public_tokenizers.path("piece_bpe_32k.model")), n_best=3, ids=False)
    return encoded.select(
        "doc_id",
        "n_pieces",
        F.round(F.col("scores")[0], 6).alias("best_score"),
        F.size("scores").alias("n_best"),
        F.round(F.col("scores")[0] - F.try_element_at("scores", F.lit(2)), 6).alias("gap_to_second"),
        F.round(F.col("scores")[0] - F.try_element_at("scores", F.lit(3)), 6).alias("gap_to_third"),
        "ids_sha256",
        "decodes",
    )


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fm_index import mark

    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return mark(docs, bench, ["doc_id"]).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .block_max import rank

    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import build_trie

    return build_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dup import exact_duplicates

    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_QUERIES = (
    op1_url_filter, op2_minhash_odd_sketch, op3_weak_quality, op4_token_fst, op5_pii_transducers, op6_shard_tree, op7_rlz_dedup,
    op8_nbest_pieces, op9_multi_index, op10_fm_decontaminate, op11_block_max_wand, op12_prefix_trie, op13_bloom_dedup,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    from .oracle import oracles

    return oracles()
