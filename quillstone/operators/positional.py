"""Phrase and proximity search over places of tokens.

A line holds clauses: "several words" in quotes, which stand next to each other in this order; a NEAR/5 b, two words at
most 5 places apart in either order; and bare words. A document answers a line if it holds every clause, each within one
field, and within one fragment of it. Stop words of a phrase keep their places but may be any words. Of an operand of NEAR that is several
tokens, the one next to the operator counts. A clause without tokens, or with a stop word as an operand, asks for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import WEIGHTS, idf
from ..functions.stemming import stemmer
from ..functions.stopwords import STOP_WORDS
from ..functions.text import INDEX_V2, tokens
from .counting import places
from .search import among, bounded

QUOTED = r'"([^"]*)"'
NEAR = r"^NEAR/([1-9][0-9]*)$"


def parse_positional(lines: DataFrame, stem: bool = True) -> DataFrame:
    """(query_id, clause, distance, slot, offset, token) of lines(query_id, line).

    clause numbers a line's clauses, phrases first; distance is null for phrases and bare words; slots number a clause's
    tokens without gaps, offset is a token's place in its phrase.
    """
    line = F.coalesce("line", F.lit(""))
    pieces = F.filter(F.split(F.regexp_replace(line, QUOTED, " "), r"\s+"), lambda x: x != "")
    marked = lines.select("query_id", F.regexp_extract_all(line, F.lit(QUOTED), F.lit(1)).alias("quoted"), pieces.alias("pieces"))
    near = lambda x: F.regexp_extract(x, NEAR, 1)
    at = lambda i: F.try_element_at(F.col("pieces"), i)
    numbers = F.transform("pieces", lambda x, i: i + 1)
    is_near = lambda i: F.coalesce(near(at(i)) != "", F.lit(False))
    operand = lambda i: F.when(i > 0, at(i))  # noqa: E731  the place before the first is none
    clause = lambda distance, *texts: F.struct(distance.cast("int").alias("distance"), F.array(*texts).alias("texts"))
    none = F.lit(None)
    phrases = F.transform("quoted", lambda x: clause(none, x))
    pairs = F.transform(F.filter(numbers, is_near), lambda i: clause(near(at(i)), operand(i - 1), operand(i + 1)))
    beside = lambda i: is_near(i + 1) | F.when(i > 1, is_near(i - 1)).otherwise(F.lit(False))
    bare = F.transform(F.filter(numbers, lambda i: ~is_near(i) & ~beside(i)), lambda i: clause(none, at(i)))
    clauses = marked.select("query_id", F.posexplode(F.concat(phrases, pairs, bare)).alias("clause", "c"))
    found = lambda text: tokens(F.lower(F.coalesce(text, F.lit(""))), INDEX_V2)
    first, second = found(F.col("c.texts")[0]), found(F.try_element_at("c.texts", F.lit(2)))
    near_words = F.array(F.try_element_at(first, F.lit(-1)), F.try_element_at(second, F.lit(1)))
    words = clauses.select("query_id", "clause", F.col("c.distance").alias("distance"), F.posexplode(F.when(F.col("c.distance").isNull(), first).otherwise(near_words)).alias("offset", "token"))
    kept = words.withColumn("kept", F.coalesce(~F.col("token").isin(STOP_WORDS) & (F.length("token") >= INDEX_V2.min_length), F.lit(False)))
    whole = Window.partitionBy("query_id", "clause")
    kept = kept.withColumn("complete", F.min("kept").over(whole)).where(F.col("kept") & (F.col("distance").isNull() | F.col("complete")))
    token = stemmer(lines.sparkSession)(F.col("token")) if stem else F.col("token")
    slot = (F.row_number().over(whole.orderBy("offset")) - 1).alias("slot")
    return kept.select("query_id", F.col("clause").cast("int").alias("clause"), "distance", slot, F.col("offset").cast("int").alias("offset"), token.alias("token"))


def _phrase_starts(slots: Column) -> Column:
    """Where a phrase begins: places of its tokens, less their offsets, that all of them share."""
    begins = F.transform(slots, lambda s: F.transform(places(s["gaps"]), lambda p: p - s["offset"]))
    return F.aggregate(F.slice(begins, 2, F.size(begins)), begins[0], lambda acc, x: F.array_intersect(acc, x))


def _near_places(slots: Column, distance: Column) -> Column:
    """Places of the first token that have one of the second, itself excluded, at most so far away."""
    far = distance.cast("long")
    around = lambda p: F.concat(F.sequence(p - far, p - F.lit(1)), F.sequence(p + F.lit(1), p + far))
    return F.array_intersect(places(slots[0]["gaps"]), F.flatten(F.transform(places(slots[1]["gaps"]), around)))


def matches(terms: DataFrame, positions: DataFrame) -> DataFrame:
    """(query_id, clause, doc_ord, field, n): how many times each clause occurs in a field of a document.

    A clause's tokens meet in one shuffle by (query_id, clause, doc_ord, field), and places are compared in that row.
    """
    slots = F.count("*").over(Window.partitionBy("query_id", "clause"))
    entries = positions.join(terms.withColumn("slots", slots), "token")
    met = entries.groupBy("query_id", "clause", "doc_ord", "field").agg(F.first("slots").alias("slots"), F.first("distance").alias("distance"), F.array_sort(F.collect_list(F.struct("slot", "offset", "gaps"))).alias("s"))
    met = met.where(F.size("s") == F.col("slots"))
    n = F.size(F.when(F.col("distance").isNull(), _phrase_starts(F.col("s"))).otherwise(_near_places(F.col("s"), F.col("distance"))))
    return met.select("query_id", "clause", "doc_ord", "field", n.cast("long").alias("n")).where("n > 0")


def search_positional(lines: DataFrame, positions: DataFrame, n_docs: DataFrame, titles: DataFrame, k: int = 10, stem: bool = True) -> DataFrame:
    """(query_id, rank, doc_ord, title, score): the k best documents of each line.

    A clause scores as a term does: its occurrences weighted by field, times the logarithm of documents by documents that hold
    it; clauses are added up. Ties go to the smaller document; scores are compared to six decimals.
    """
    terms, words = bounded(parse_positional(lines, stem))
    if words is not None:
        positions = positions.where(among(words))
    weight = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    held = matches(terms, positions).groupBy("query_id", "clause", "doc_ord").agg(F.sum(F.col("n") * weight[F.col("field")]).alias("tf"))
    rare = held.groupBy("query_id", "clause").agg(F.count("*").alias("df"))
    wanted = terms.groupBy("query_id").agg(F.count_distinct("clause").alias("clauses"))
    scored = held.join(rare, ["query_id", "clause"]).crossJoin(n_docs)  # n_docs is one row
    entry = F.struct("clause", (F.col("tf") * idf(F.col("n_docs"), F.col("df"))).alias("s"))
    each = scored.groupBy("query_id", "doc_ord").agg(F.array_sort(F.collect_list(entry)).alias("entries")).join(wanted, "query_id").where(F.size("entries") == F.col("clauses"))
    score = F.round(F.aggregate("entries", F.lit(0.0), lambda acc, e: acc + e["s"]), 6)  # added in order of clauses
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_ord")
    best = each.select("query_id", "doc_ord", score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = (F.broadcast(best) if words is not None else best).join(titles.select("doc_ord", "title"), "doc_ord")
    return named.select("query_id", "rank", "doc_ord", "title", "score")
