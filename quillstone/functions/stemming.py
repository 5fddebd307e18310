"""The stemmer as an Arrow-batched column function with a memo in each worker."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..runtime import bounded_batches, ship
from .porter2 import stem

#: Words whose stems a worker remembers.
MAX_WORDS = 500_000
_memo: dict[str, str] = {}


def stem_series(words: pd.Series) -> pd.Series:
    """Stems of a batch; a word is stemmed once while it is remembered, a null stays null."""
    if len(_memo) > MAX_WORDS:
        _memo.clear()
    found = list(map(_memo.get, words))
    for i, s in enumerate(found):
        if s is None and words.iloc[i] is not None:
            w = words.iloc[i]
            found[i] = _memo[w] = stem(w)
    return pd.Series(found, index=words.index, dtype=object)


def stem_words(words: list[str | None]) -> list[str | None]:
    """Stems of words, none for none, by the same memo."""
    if len(_memo) > MAX_WORDS:
        _memo.clear()
    found = list(map(_memo.get, words))
    for i, s in enumerate(found):
        if s is None and words[i] is not None:
            found[i] = _memo[words[i]] = stem(words[i])
    return found


def stemmer(spark: SparkSession) -> Callable[[Column], Column]:
    ship(spark)
    bounded_batches(spark)
    return F.pandas_udf(stem_series, "string")
