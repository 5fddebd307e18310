"""Field weights, inverse document frequency, and the compact text form of postings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of the fields in posting order, and their weights.
FIELDS = ("t", "i", "b", "c", "r", "l")
WEIGHTS = {"t": 10, "i": 5, "b": 1, "c": 5, "r": 2, "l": 2}


def idf(n_docs: Column, df: Column) -> Column:
    """log2(N / df), not smoothed."""
    return F.ln(n_docs / df) / F.ln(F.lit(2.0))


def weighted_tf(field: Column | None = None) -> Column:
    """Weighted count of all fields, or of the one named by field (z: all); 0 where that field lacks the token."""
    parts = {f: F.col(f) * WEIGHTS[f] for f in FIELDS}
    whole = sum((parts[f] for f in FIELDS[1:]), parts["t"])
    if field is None:
        return whole
    out = F.when(field == "z", whole)
    for f in FIELDS:
        out = out.when(field == f, parts[f])
    return out


def encode_posting() -> Column:
    """d<doc> and the counts that aren't zero, in field order: d12t1b7."""
    counts = [F.when(F.col(f) != 0, F.concat(F.lit(f), F.col(f).cast("string"))).otherwise("") for f in FIELDS]
    return F.concat(F.lit("d"), F.col("doc_ord").cast("string"), *counts)


def decode_postings(encoded: Column) -> Column:
    """Array of structs of concatenated postings."""
    return F.transform(split_postings(encoded), lambda x: decode_posting(x))


def split_postings(encoded: Column) -> Column:
    """Array of the postings of a list, each without its d."""
    split = F.split(encoded, "d")
    return F.slice(split, 2, F.size(split))


def decode_posting(one: Column) -> Column:
    """Struct of one posting without its d. Every letter stands once and in field order, so counts are cut off from the end."""
    counts = {}
    for f in reversed(FIELDS):
        counts[f] = F.when(F.contains(one, F.lit(f)), F.substring_index(one, f, -1).cast("int")).otherwise(0)
        one = F.substring_index(one, f, 1)
    return F.struct(one.cast("long").alias("doc_ord"), *(counts[f].alias(f) for f in FIELDS))
