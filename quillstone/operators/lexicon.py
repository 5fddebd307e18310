"""Terms by likeness: misspelt words and wildcards, found in tables over the vocabulary and never by a scan of it.

Fuzzy terms go by deletion neighbourhoods. Two words within d edits have beginnings of PREFIX characters from which d characters at
most can be deleted so that the same string is left: in a best alignment only d characters of a beginning are edited or belong
to a character behind the other one's beginning. So a table has, for each token, what is left of its beginning after up
to MAX_EDITS deletions, 29 strings at most however long the token is; candidates are checked by their distance.

Wildcards go by grams. A token is marked at both ends and cut into pieces of one to three characters; a pattern's fixed parts are
cut into the longest grams that they hold, all of which a match must have, and what does is checked against the pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stopwords import STOP_WORDS
from ..functions.text import INDEX_V2
from ..runtime import materialize
from .search import bounded, rank, score

#: Characters at a word's beginning that deletions are made from, and deletions.
PREFIX, MAX_EDITS = 7, 2
#: Characters of a gram, at most; marks of a token's beginning and end, which no token holds.
GRAM, BEGIN, END = 3, "<", ">"
#: Keys of a lookup that become a filter of the scan; a table is joined with more of them as it is.
MAX_KEYS = 10_000


def _looked_up(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """table, whose scan skips what no wanted key is in where these are few."""
    rows = wanted.select(key).distinct().limit(MAX_KEYS + 1).collect()
    return table.where(F.col(key).isin(sorted(r[0] for r in rows))) if len(rows) <= MAX_KEYS else table


def _without_one(words: Column) -> Column:
    """The words with any one character deleted."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 0), cut))


def neighbourhood(word: Column, edits: int = MAX_EDITS) -> Column:
    """The beginning of a word with up to so many characters deleted."""
    last = every = F.array(F.substring(word, 1, PREFIX))
    for _ in range(edits):
        last = F.array_distinct(_without_one(last))
        every = F.concat(every, last)
    return F.array_distinct(every)


def deletion_table(vocabulary: DataFrame) -> DataFrame:
    """(variant, token): the strings by which each of vocabulary(token) is found."""
    return vocabulary.select(F.explode(neighbourhood(F.col("token"))).alias("variant"), "token")


def fuzzy_terms(words: DataFrame, deletions: DataFrame) -> DataFrame:
    """(word, edits, token, distance): the tokens within edits, MAX_EDITS at most, of each of words(word, edits).

    Distances are those of Levenshtein. Words that are repeated count once; a null word or number has no tokens.
    """
    asked = words.where("word IS NOT NULL AND edits IS NOT NULL").select("word", F.least("edits", F.lit(MAX_EDITS)).alias("edits")).distinct()
    near = asked.select("word", "edits", F.explode(neighbourhood(F.col("word"))).alias("variant"))
    pairs = near.join(_looked_up(deletions, "variant", near), "variant").where(F.abs(F.length("word") - F.length("token")) <= F.col("edits")).select("word", "edits", "token").distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "token")).where(F.col("distance") <= F.col("edits"))


def _grams(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))


def gram_table(vocabulary: DataFrame) -> DataFrame:
    """(gram, token): the grams of one to GRAM characters of each of vocabulary(token), marked at both ends."""
    marked = F.concat(F.lit(BEGIN), F.col("token"), F.lit(END))
    every = F.array_distinct(F.concat(*(F.when(F.length(marked) >= n, _grams(marked, n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1))))
    # a mark alone tells nothing
    return vocabulary.select(F.explode(F.array_except(every, F.array(F.lit(BEGIN), F.lit(END)))).alias("gram"), "token")


def wildcard_terms(patterns: DataFrame, grams: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(pattern, token): the tokens that each of patterns(pattern) matches, where * stands for any characters or none.

    Only a pattern of nothing but * reads the vocabulary; all others read the grams of their fixed parts.
    """
    asked = patterns.select("pattern").where("pattern IS NOT NULL").distinct()
    parts = F.filter(F.split(F.concat(F.lit(BEGIN), F.col("pattern"), F.lit(END)), r"\*"), lambda p: ~p.isin("", BEGIN, END))
    longest = F.transform(parts, lambda p: F.when(F.length(p) >= GRAM, _grams(p, GRAM)).otherwise(F.array(p)))
    cut = asked.withColumn("needed", F.array_distinct(F.flatten(longest)))
    wanted = cut.select("pattern", F.size("needed").alias("n"), F.explode("needed").alias("gram"))
    held = wanted.join(_looked_up(grams, "gram", wanted), "gram").groupBy("pattern", "token").agg(F.count("*").alias("met"), F.first("n").alias("n")).where("met = n").select("pattern", "token")
    open_ = F.broadcast(cut.where(F.size("needed") == 0).select("pattern"))  # only runs of * are left, and "" without any
    everything = vocabulary.select("token").join(open_, F.col("pattern") != "")
    like = F.regexp_replace(F.regexp_replace("pattern", r"([%_\\])", r"\\$1"), r"\*", "%")
    return held.unionByName(everything.select("pattern", "token")).withColumn("like", like).where("token LIKE like").select("pattern", "token")


def pattern_terms(lines: DataFrame, deletions: DataFrame, grams: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, field_pos, field, pos, token) of lines of words, word~ or word~1 (within two or one edits) and patterns with *.

    Every term searches all fields. Words are lower-cased; stop words and short ones without a sign are dropped. A token
    counts once for a line, terms are in order of pieces, and those of one piece in order of tokens.
    """
    pieces = lines.select("query_id", F.posexplode(F.split(F.lower(F.coalesce("line", F.lit(""))), r"\s+")).alias("piece", "text")).where("text != ''")
    wild = F.contains("text", F.lit("*"))
    word = F.regexp_extract("text", r"^(.+?)~([0-9]?)$", 1)
    edits = F.when(F.regexp_extract("text", r"^(.+?)~([0-9]?)$", 2) == "", MAX_EDITS).otherwise(F.regexp_extract("text", r"^(.+?)~([0-9]?)$", 2).cast("int"))
    kinds = materialize(pieces.withColumns({"wild": wild, "word": F.when(~wild & (word != ""), word), "edits": F.when(~wild & (word != ""), edits)}), "pieces")
    plain = kinds.where(~F.col("wild") & F.col("word").isNull() & ~F.col("text").isin(STOP_WORDS) & (F.length("text") >= INDEX_V2.min_length)).select("query_id", "piece", F.col("text").alias("token"))
    near = fuzzy_terms(kinds.select("word", "edits"), deletions)
    near = kinds.withColumn("edits", F.least("edits", F.lit(MAX_EDITS))).join(near, ["word", "edits"]).select("query_id", "piece", "token")
    matched = wildcard_terms(kinds.where("wild").select(F.col("text").alias("pattern")), grams, vocabulary)
    matched = kinds.where("wild").join(matched, F.col("text") == F.col("pattern")).select("query_id", "piece", "token")
    first = plain.unionByName(near).unionByName(matched).groupBy("query_id", "token").agg(F.min("piece").alias("piece"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("piece", "token")) - 1
    return first.select("query_id", F.lit(0).alias("field_pos"), F.lit("z").alias("field"), pos.alias("pos"), "token")


def search_patterns(lines: DataFrame, found: DataFrame, frequencies: DataFrame, n_docs: DataFrame, titles: DataFrame, deletions: DataFrame, grams: DataFrame, k: int = 10, aggregate: bool = False) -> DataFrame:
    """Ranked answers to lines with misspelt words and wildcards; every token that is found is a term of its own."""
    terms, words = bounded(pattern_terms(lines, deletions, grams, frequencies))
    if words is not None:
        found, frequencies = (df.where(F.col("token").isin(words)) for df in (found, frequencies))
    return rank(score(terms, found, frequencies, n_docs), titles, k, aggregate, words is not None)
