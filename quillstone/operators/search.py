"""Field-weighted TF-IDF search of a batch of query lines in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import idf, weighted_tf
from ..runtime import materialize
from .counting import row_postings
from .postings import merge_postings
from .queryparse import parse

#: Query terms of a batch that are read into the driver and broadcast.
MAX_TERMS = 10_000
#: Words that a scan of stored postings compares one by one.
MAX_COMPARED = 100
#: Batches whose new tokens a searcher keeps apart; beyond, all are read into one frame.
MAX_KEPT = 8


def score(terms: DataFrame, found: DataFrame, frequencies: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(query_id, field_pos, field, pos, token, doc_ord, tf, idf, score): an entry for each term and document.

    A field term's documents are all that have the token; where that field lacks it the score is 0.
    n_docs is one row (n_docs).
    """
    weighed = terms.join(frequencies, "token").crossJoin(n_docs).withColumn("idf", idf(F.col("n_docs"), F.col("df")))  # n_docs is one row
    entries = found.join(weighed, "token").withColumn("tf", weighted_tf(F.col("field")).cast("long"))
    return entries.select("query_id", "field_pos", "field", "pos", "token", "doc_ord", "tf", "idf", (F.col("tf") * F.col("idf")).alias("score"))


def rank(entries: DataFrame, titles: DataFrame, k: int = 10, aggregate: bool = False, few: bool = False) -> DataFrame:
    """The k best entries of each query with titles; with aggregate, documents by the sum of their entries.

    Entries of one document aren't added up by default. Ties go to the earlier term, then to the smaller
    document; scores are compared to six decimals. With few (queries of a bounded number), the answers are
    broadcast to the titles, which then aren't shuffled.
    """
    if aggregate:
        entries = entries.groupBy("query_id", "doc_ord").agg(F.sum("score").alias("score"))
        ties = [F.col("doc_ord")]
    else:
        ties = [F.col("field_pos"), F.col("pos"), F.col("doc_ord")]
    order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), *ties)
    best = entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = (F.broadcast(best) if few else best).join(titles.select("doc_ord", "title"), "doc_ord")
    columns = ["query_id", "rank", "doc_ord", "title"] + ([] if aggregate else ["field", "token", "tf"])
    return named.select(*columns, F.round("score", 6).alias("score"))


def bounded(terms: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """Terms to join with, and their tokens if there are MAX_TERMS terms at most.

    So few terms are read into the driver: the join broadcasts them, and their tokens become a filter that
    reaches the scan of stored postings. More terms are a scratch table.
    """
    terms = materialize(terms, "terms")
    rows = terms.limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        return terms, None
    return F.broadcast(terms.sparkSession.createDataFrame(rows, terms.schema)), sorted({r["token"] for r in rows})


def among(words: list[str]) -> Column:
    """Whether a token is one of these words; few of them are compared one by one, as a scan takes a longer list for all between the first and the last."""
    if not 0 < len(words) <= MAX_COMPARED:
        return F.col("token").isin(words)
    return reduce(lambda x, y: x | y, (F.col("token") == w for w in words))


def search(lines: DataFrame, found: DataFrame, frequencies: DataFrame, n_docs: DataFrame, titles: DataFrame, k: int = 10, stem: bool = True, aggregate: bool = False) -> DataFrame:
    """Ranked answers to lines(query_id, line) from postings and frequencies; a line without hits has no rows.

    Few terms filter the scans by their tokens. Many terms leave only their tokens' rows by a semi-join, which
    the planner broadcasts or shuffles by the size of the distinct tokens.
    """
    terms, words = bounded(parse(lines, stem))
    if words is not None:
        found, frequencies = (df.where(F.col("token").isin(words)) for df in (found, frequencies))
        frequencies = F.broadcast(frequencies)  # a row for each of the words at most
    else:
        asked = terms.select("token").distinct()
        found, frequencies = (df.join(asked, "token", "left_semi") for df in (found, frequencies))
    return rank(score(terms, found, frequencies, n_docs), titles, k, aggregate, words is not None)


def search_fields(lines: DataFrame, fields: DataFrame, n_docs: DataFrame, titles: DataFrame, k: int = 10, stem: bool = True, aggregate: bool = False) -> DataFrame:
    """The same without an index: of pages' fields only the terms' tokens, counted in each page's row, are kept as a table."""
    terms, words = bounded(parse(lines, stem))
    only = terms.select("token").distinct()
    found = row_postings(fields, stem=stem).join(only if words is None else F.broadcast(only), "token", "left_semi")
    found = materialize(found, "matches")
    frequencies = found.groupBy("token").agg(F.count("*").alias("df"))
    return rank(score(terms, found, frequencies, n_docs), titles, k, aggregate, words is not None)


class Searcher:
    """A stored index that stays warm: statistics and the postings and frequencies of tokens asked before are kept.

    A batch reads only tokens that no batch before has asked for. What is kept is persisted, in memory or on disk
    of the executors, and can be read anew if it is lost; close() lets it go.
    """

    def __init__(self, found: DataFrame, frequencies: DataFrame, n_docs: DataFrame, titles: DataFrame):
        spark = found.sparkSession
        self.stored, self.titles = (found, frequencies), titles
        self.n_docs = spark.createDataFrame([tuple(n_docs.first())], "n_docs long")
        self.kept: list[tuple[DataFrame, DataFrame]] = []
        self.known: set[str] = set()

    def search(self, lines: DataFrame, k: int = 10, stem: bool = True, aggregate: bool = False) -> DataFrame:
        """Ranked answers as search() gives them; batches of more than MAX_TERMS terms aren't kept."""
        terms, words = bounded(parse(lines, stem))
        if words is None or len(self.known | set(words)) > 10 * MAX_TERMS:
            return search(lines, *self.stored, self.n_docs, self.titles, k, stem, aggregate)
        if new := sorted(set(words) - self.known):
            self.known |= set(new)
            self.kept.append(self._read(new))
            if len(self.kept) > MAX_KEPT:  # one frame of all, so that no plan grows with the number of batches
                for pair in self.kept:
                    for df in pair:
                        df.unpersist()
                self.kept = [self._read(sorted(self.known))]
        empty = tuple(df.where("false") for df in self.stored)
        found, frequencies = (merge_postings([p[i] for p in self.kept] or [empty[i]]) for i in (0, 1))
        return rank(score(terms, found, F.broadcast(frequencies), self.n_docs), self.titles, k, aggregate, True)

    def _read(self, tokens: list[str]) -> tuple[DataFrame, ...]:
        return tuple(df.where(F.col("token").isin(tokens)).persist() for df in self.stored)

    def close(self) -> None:
        for pair in self.kept:
            for df in pair:
                df.unpersist()
        self.kept, self.known = [], set()
