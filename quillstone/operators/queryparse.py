"""The query language: free text, or sticky field prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import FIELDS
from ..functions.stemming import stemmer
from ..functions.text import QUERY, drop_stop_words, tokens


def classify(lines: DataFrame) -> DataFrame:
    """lines(query_id, line) with is_field: some piece has a colon, and before each first colon stands a field's letter."""
    pieces = F.filter(F.split(F.coalesce("line", F.lit("")), " "), lambda x: F.contains(x, F.lit(":")))
    known = F.forall(pieces, lambda x: F.split_part(x, F.lit(":"), F.lit(1)).isin(*FIELDS))
    return lines.select("query_id", F.coalesce("line", F.lit("")).alias("line"), ((F.size(pieces) > 0) & known).alias("is_field"))


def parse(lines: DataFrame, stem: bool = True) -> DataFrame:
    """(query_id, field_pos, field, pos, token) of every line.

    Free text has the field z (all) and each token once. In a field query a prefix holds until the next
    one, words of a field that recurs are added to it, and repeated tokens stay. Words before the first prefix
    search all fields. A piece with a second colon belongs to the current field as it stands.
    """
    split = classify(lines).select("query_id", "line", "is_field", F.posexplode(F.split("line", " ")).alias("at", "piece"))
    prefixed = F.col("is_field") & (F.size(F.split("piece", ":")) == 2)
    marked = split.withColumn("own", F.when(prefixed, F.split_part("piece", F.lit(":"), F.lit(1))))
    marked = marked.withColumn("word", F.when(prefixed, F.split_part("piece", F.lit(":"), F.lit(2))).otherwise(F.col("piece")))
    before = Window.partitionBy("query_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("field", F.coalesce(F.last("own", ignorenulls=True).over(before), F.lit("z")))
    words = marked.groupBy("query_id", "is_field", "field").agg(F.min("at").alias("field_pos"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    text = F.array_join(F.transform("words", lambda w: w["word"]), " ")
    found = words.select("query_id", "is_field", "field", "field_pos", F.posexplode(drop_stop_words(tokens(text, QUERY), QUERY)).alias("pos", "token"))
    token = F.lower(stemmer(lines.sparkSession)(F.col("token")) if stem else F.col("token"))
    found = found.withColumn("token", token)
    once = Window.partitionBy("query_id", "token").orderBy("field_pos", "pos")
    found = found.withColumn("i", F.row_number().over(once)).where(F.col("is_field") | (F.col("i") == 1))
    return found.select("query_id", F.col("field_pos").cast("int").alias("field_pos"), "field", F.col("pos").cast("int").alias("pos"), "token")
