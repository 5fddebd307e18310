"""Fields of wiki markup, as column expressions over lower-case text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from ..runtime import spread

# Markup patterns and headings.
INFOBOX = r"(?s)\{\{infobox(.*?)\}\}"
CATEGORY = r"(?s)\[\[category:(.*?)\]\]"
LINK = r"(?s)\* \[(.*?)\]"
REFERENCE = r"(?s)\*\[(.*?)\]"
#: Headings in order of preference; the second form counts only where the first doesn't occur.
REFERENCE_HEADINGS = ("== references ==", "==references==")
LINK_HEADINGS = ("==external links==", "== external links ==")


def fragments(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def section(text: Column, headings: tuple[str, str], part: int) -> Column:
    """Part 1 before or part 2 after a heading; what follows a second heading is dropped."""
    first, second = (F.split_part(text, F.lit(h), F.lit(part)) for h in headings)
    return F.when(F.contains(text, F.lit(headings[0])), first).otherwise(second)


def strip_infobox(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\{\{infobox.*?\}\}", " ")


def strip_categories(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\[\[category:.*?\]\]", " ")


def extract_fields(pages: DataFrame) -> DataFrame:
    """(doc_ord, title, body, infobox, category, links, references) of pages(doc_ord, title, text); null as empty.

    Categories, links and references are read in the references section only, in this order.
    """
    cleaned = spread(pages.select("doc_ord", "title", "text")).select("doc_ord", F.lower(F.coalesce("title", F.lit(""))).alias("title"), clean(F.col("text")).alias("text"))
    boxed = cleaned.select("doc_ord", "title", fragments(F.col("text"), INFOBOX).alias("infobox"), strip_infobox(F.col("text")).alias("text"))
    parts = boxed.select("doc_ord", "title", "infobox", section(F.col("text"), REFERENCE_HEADINGS, 1).alias("body"), section(F.col("text"), REFERENCE_HEADINGS, 2).alias("refs"))
    listed = parts.withColumns({"category": fragments(F.col("refs"), CATEGORY), "refs": strip_categories(F.col("refs"))})
    split = listed.withColumns({"external": section(F.col("refs"), LINK_HEADINGS, 2), "refs": section(F.col("refs"), LINK_HEADINGS, 1)})
    return split.select(
        "doc_ord", "title", "body", "infobox", "category", fragments(F.col("external"), LINK).alias("links"), fragments(F.col("refs"), REFERENCE).alias("references")
    )
