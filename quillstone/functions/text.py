"""Tokenizers as column expressions: everything stays in whole-stage code generation."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import STOP_WORDS


@dataclass(frozen=True)
class TokenizerConfig:
    """What a tokenizer does, in order: ASCII strip, URLs, special characters, then split, letter runs on their own where padded."""

    name: str
    ascii_only: bool
    pad_letters: bool
    specials: str
    blanks: str
    min_length: int
    lower_first: bool


# Regular-expression classes, alike in Java and RE2, of characters that become spaces, and of what splits.
SPECIALS_V2 = r"[\x27\x60\"|.*\[\]{}();:,=~\-+_!?/><&\\#$@%\n]"
SPECIALS_V1 = r"[\x{2014}\x27\x60\"|.*\[\]{}();:,=\-+_!?/><&\\#$@%\n]"
URL = "http[^ ]* "
BLANKS_ASCII = r"[ \t\n\r\x0B\x0C\x1C-\x1F]+"
BLANKS_UNICODE = r"[ \t\n\r\x0B\x0C\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

INDEX_V1 = TokenizerConfig("index_v1", False, False, SPECIALS_V1, BLANKS_UNICODE, 1, True)
INDEX_V2 = TokenizerConfig("index_v2", True, True, SPECIALS_V2, BLANKS_ASCII, 2, True)
QUERY = TokenizerConfig("query", True, False, SPECIALS_V2, BLANKS_ASCII, 1, False)


def clean(text: Column) -> Column:
    """Newlines to spaces, lower case; null as empty."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))


def tokens(text: Column, config: TokenizerConfig) -> Column:
    """The tokens of a text (which for index configurations is lower case already)."""
    s = F.coalesce(text, F.lit(""))
    if config.ascii_only:
        s = F.regexp_replace(s, r"[^\x00-\x7F]", "")
    s = F.regexp_replace(s, URL, " ")
    s = F.regexp_replace(s, config.specials, " ")
    blanks = config.blanks.removeprefix("[").removesuffix("]+")
    run = f"[A-Za-z]+|[^A-Za-z{blanks}]+" if config.pad_letters else f"[^{blanks}]+"
    return F.regexp_extract_all(s, F.lit(run), F.lit(0))


@cache
def byte_classes(config: TokenizerConfig) -> np.ndarray:
    """For each ASCII byte: 0 if it splits, 1 if it is a letter, 2 if not; runs of 1 or of 2 are tokens() of a configuration that pads letters."""
    splits = re.compile(f"{config.specials}|{config.blanks}")
    return np.array([0 if splits.match(c) else 1 if c.isalpha() else 2 for c in map(chr, range(128))], np.uint8)


def tokens_of_fragments(fragments: Column, config: TokenizerConfig) -> Column:
    """Each fragment is tokenized on its own, so a URL at a fragment's end is kept."""
    return F.flatten(F.transform(fragments, lambda x: tokens(x, config)))


def drop_stop_words(found: Column, config: TokenizerConfig, extra: tuple[str, ...] = ()) -> Column:
    """Without stop words (compared as written) and without tokens shorter than the configuration wants."""
    stop = [*STOP_WORDS, *extra]
    return F.filter(found, lambda x: ~x.isin(stop) & (F.length(x) >= config.min_length))
