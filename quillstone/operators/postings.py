"""From fields to postings, document frequencies, posting lists and vocabulary shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import FIELDS, decode_posting, encode_posting, split_postings
from ..functions.stemming import stemmer
from ..functions.text import INDEX_V1, INDEX_V2, TokenizerConfig, drop_stop_words, tokens, tokens_of_fragments
from ..runtime import materialize, numbered

LISTS = {"i": "infobox", "c": "category", "r": "references", "l": "links"}
SHARD_TOKENS = 10_000
#: Documents of a chunk of a posting list.
CHUNK_DOCS = 10_000


def field_tokens(fields: DataFrame, config: TokenizerConfig = INDEX_V2, extra_stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(doc_ord, field, token), a row for each occurrence that is kept."""

    def found(field: str):
        if field in ("t", "b"):
            own = tokens(F.col({"t": "title", "b": "body"}[field]), config)
        elif config is INDEX_V1:  # joins fragments before it tokenizes
            own = tokens(F.array_join(LISTS[field], " "), config)
        else:
            own = tokens_of_fragments(F.col(LISTS[field]), config)
        return F.struct(F.lit(field).alias("field"), drop_stop_words(own, config, extra_stop_words).alias("tokens"))

    bags = fields.select("doc_ord", F.explode(F.array(*(found(f) for f in FIELDS))).alias("bag"))
    # the array is a column of its own before it is exploded, so that no row carries it along
    return bags.select("doc_ord", "bag.field", "bag.tokens").select("doc_ord", "field", F.explode("tokens").alias("token"))


def count_fields(occurrences: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(token, doc_ord, t, i, b, c, r, l): counts by field, after one shuffle on (token, doc_ord) of what tasks have counted.

    With only(token), other tokens are dropped before they are counted.
    """
    counts = [F.count_if(F.col("field") == f).cast("int").alias(f) for f in FIELDS]
    if only is not None:
        occurrences = occurrences.join(only, "token", "left_semi")
    return occurrences.groupBy("token", "doc_ord").agg(*counts)


def stem_table(words: DataFrame) -> DataFrame:
    """(token, stem) of each of words(token): only distinct words reach the stemmer."""
    distinct = words.select("token").distinct()
    return materialize(distinct.select("token", stemmer(words.sparkSession)(F.col("token")).alias("stem")), "stems")


def restem(counted: DataFrame, stems: DataFrame, ranges: int | None = None) -> DataFrame:
    """Counts by token as counts by stem: those of a document's tokens with one stem are added up.

    With ranges, rows are dealt by that many ranges of (stem, doc_ord), and no other shuffle is needed to add them up.
    """
    named = counted.join(stems, "token").select(F.col("stem").alias("token"), "doc_ord", *FIELDS)
    if ranges:
        named = named.repartitionByRange(ranges, "token", "doc_ord")
    return named.groupBy("token", "doc_ord").agg(*(F.sum(f).cast("int").alias(f) for f in FIELDS))


def postings(occurrences: DataFrame, stem: bool = True, ranges: int | None = None) -> DataFrame:
    """(token, doc_ord, t, i, b, c, r, l): counts of each token, or each stem, of a document by field.

    To stem, tokens are counted as they are and these counts kept as a scratch table; their vocabulary is stemmed
    once, and its stems are joined with the counts. With ranges, rows are dealt by that many ranges of (token, doc_ord).
    """
    counted = count_fields(occurrences)
    if not stem:
        return counted.repartitionByRange(ranges, "token", "doc_ord") if ranges else counted
    counted = materialize(counted, "counts")
    return restem(counted, stem_table(counted), ranges)


def document_frequencies(found: DataFrame) -> DataFrame:
    """(token, df): documents that have the token in any field."""
    return found.groupBy("token").agg(F.count("*").alias("df"))


def posting_lists(found: DataFrame, chunk: int = CHUNK_DOCS) -> DataFrame:
    """(token, chunk, postings): a token's postings of each chunk of so many documents in text form, by document.

    A token's list is what its chunks hold, one after the other; no row holds more than a chunk's postings,
    however many documents have the token. For export; search reads rows.
    """
    rows = F.sort_array(F.collect_list(F.struct("doc_ord", encode_posting().alias("p"))))
    grouped = found.groupBy("token", F.floor(F.col("doc_ord") / chunk).alias("chunk"))
    return grouped.agg(F.array_join(F.transform(rows, lambda x: x["p"]), "").alias("postings"))


def merge_lists(parts: DataFrame) -> DataFrame:
    """(token, chunk, postings), as posting_lists() makes them, of lists(token, chunk, first, last, postings) of some of a chunk's documents each.

    Lists whose documents lie apart follow each other as they are; where they don't, the postings are sorted.
    """
    grouped = parts.groupBy("token", "chunk").agg(F.sort_array(F.collect_list(F.struct("first", "last", "postings"))).alias("parts"))
    following = F.slice("parts", 2, F.size("parts"))
    apart = F.forall(F.zip_with("parts", following, lambda x, y: y.isNull() | (x["last"] < y["first"])), lambda x: x)
    whole = F.array_join(F.transform("parts", lambda x: x["postings"]), "")
    each = F.transform(split_postings(whole), lambda x: F.struct(decode_posting(x)["doc_ord"].alias("doc_ord"), x.alias("p")))
    sorted_ = F.array_join(F.transform(F.sort_array(each), lambda x: F.concat(F.lit("d"), x["p"])), "")
    joined = F.when(F.size("parts") == 1, F.col("parts")[0]["postings"]).when(apart, whole).otherwise(sorted_)
    return grouped.select("token", "chunk", joined.alias("postings"))


def merge_postings(parts: list[DataFrame]) -> DataFrame:
    """One index of several over disjoint documents: a union, as a token's rows needn't be adjacent."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ordinals(words: DataFrame) -> DataFrame:
    """(token, ordinal): 1-based place of each token in binary order.

    Tokens are dealt by ranges and sorted in each, and the ranges' sizes offset their numbers: no task sorts more
    than a range, and no beginning of words is a task's alone.
    """
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = words.select("token").distinct().repartitionByRange(n, "token").sortWithinPartitions("token")
    stored = materialize(ranged.withColumn("place", F.monotonically_increasing_id()), "vocabulary")
    return numbered(stored, "place", "ordinal").select("token", (F.col("ordinal") + 1).alias("ordinal"))


def vocabulary_shards(words: DataFrame, size: int = SHARD_TOKENS) -> DataFrame:
    """(token, shard): the first shard has size tokens, later ones one more."""
    return ordinals(words).select("token", F.floor(F.col("ordinal") / (size + 1)).cast("int").alias("shard"))


def secondary_index(shards: DataFrame) -> DataFrame:
    """(shard, first_token) of every shard."""
    return shards.groupBy("shard").agg(F.min("token").alias("first_token"))


def shard_lookup(words: DataFrame, index: DataFrame) -> DataFrame:
    """(token, shard): the last shard that begins at or before the token; none for a token before all.

    Words and first tokens are dealt together by ranges of tokens. Within a range a word gets the last shard that
    begins before it, or else the last one of the ranges before, of which there is one row a range.
    """
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = words.select("token", F.lit(None).cast("int").alias("shard")).unionByName(index.select(F.col("first_token").alias("token"), "shard"))
    ranged = both.repartitionByRange(n, "token").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    # a first token comes before the same word; among ranges the last shard so far is carried on
    inside = Window.partitionBy("part").orderBy("token", F.col("shard").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    lasts = ranged.groupBy("part").agg(F.max("shard").alias("own"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    carried = F.broadcast(lasts.select("part", F.max("own").over(before).alias("carried")))
    seen = ranged.select("part", "token", F.col("shard").isNull().alias("asked"), F.last("shard", ignorenulls=True).over(inside).alias("shard"))
    found = seen.where("asked").join(carried, "part").select("token", F.coalesce("shard", "carried").alias("shard"))
    return found.where(F.col("shard").isNotNull())


def corpus_statistics(pages: DataFrame, found: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """One row: n_docs, vocabulary, n_postings, n_occurrences. The vocabulary is counted by frequencies, if these are stored already."""
    n = pages.agg(F.count("*").alias("n_docs"))
    frequencies = document_frequencies(found) if frequencies is None else frequencies
    words = frequencies.agg(F.count("*").alias("vocabulary"), F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("n_postings"))
    counts = found.agg(F.coalesce(F.sum(sum((F.col(f) for f in FIELDS[1:]), F.col("t"))), F.lit(0)).cast("long").alias("n_occurrences"))
    return n.crossJoin(words).crossJoin(counts)  # one row each
