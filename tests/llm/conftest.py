import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def long_text(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioustrnd") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus() -> list[tuple]:
    """Texts with copies, near copies, shared passages, nulls, empty and odd ones, long ones, and repeated rows."""
    base = [long_text(60 + 20 * i, i) for i in range(12)]
    passage = long_text(30, 99)
    texts = [*base]
    for i, t in enumerate(base):
        words = t.split()
        texts.append(t)  # a copy
        texts.append(" ".join([*words[:20], "changed", *words[21:]]))  # a near copy
        texts.append(" ".join([*words[:30], passage, *words[30:]]))
        texts.append(" ".join(w + "x" * (j % 4 == 0) for j, w in enumerate(words)))
    texts += [None, "", "   \n\t ", "one", "one", "one two three four", "ONE two three four", "a b c d e", "A b C d E", "\u00a0", "é ☃ " * 20, "word " * 300, long_text(5000, 7), long_text(5000, 7) + " tail"]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], (5, "another text under an id that is taken already " * 3, None, None, None), (None, base[0], "en", None, 1), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
