import random
import re

import pytest

from quillstone.operators.lexicon import deletion_table, fuzzy_terms, gram_table, pattern_terms, search_patterns, wildcard_terms


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(2)
    out = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(300)}
    out |= {"thor", "thar", "other", "thr", "10^5", "a" * 400, "a" * 399 + "b", "thunder", "father", "t"}
    return sorted(out)


@pytest.fixture(scope="module")
def vocabulary(spark, words):
    return spark.createDataFrame([(w,) for w in words], "token string").cache()


def test_fuzzy_against_brute_force(spark, vocabulary, words):
    rng = random.Random(4)
    asked = rng.sample(words, 40) + ["thor", "xthor", "thro", "", "zzzzzz", "a" * 398, "b" + "a" * 400, "abcabcabcabc", "cbacbacba"]
    for edits in (0, 1, 2):
        df = spark.createDataFrame([(w, edits) for w in [*asked, *asked[:3]]] + [(None, 1), ("a", None)], "word string, edits int")
        found = fuzzy_terms(df, deletion_table(vocabulary)).collect()
        want = {(w, t): distance(w, t) for w in asked for t in words if abs(len(w) - len(t)) <= 2}
        assert {(r["word"], r["token"]): r["distance"] for r in found} == {k: v for k, v in want.items() if v <= edits}
        assert len(found) == len({(r["word"], r["token"]) for r in found})


PATTERNS = ["th*r", "*", "**", "a*", "*a", "*a*", "t", "thor", "th*", "*er", "*the*", "*b*c*", "ab*ba", "a*a", "10^*", "", "z*", "*a*a*a*", "thor*", "*thor", "%", "t__r", "t*_*", "\\*", "aa*aa"]


def test_wildcards_against_brute_force(spark, vocabulary, words):
    df = spark.createDataFrame([(p,) for p in [*PATTERNS, "th*r", None]], "pattern string")
    found = sorted(map(tuple, wildcard_terms(df, gram_table(vocabulary), vocabulary).collect()))
    assert found == sorted((p, w) for p in PATTERNS for w in words if re.fullmatch(".*".join(map(re.escape, p.split("*"))), w))


def test_tables_are_bounded_and_reached_by_filters(spark, vocabulary, words, tmp_path):
    assert deletion_table(vocabulary).groupBy("token").count().agg({"count": "max"}).first()[0] <= 29
    gram_table(vocabulary).write.parquet(str(tmp_path / "grams"))
    grams = spark.read.parquet(str(tmp_path / "grams"))
    plan = wildcard_terms(spark.createDataFrame([("th*r",)], "pattern string"), grams, vocabulary.limit(0))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "In(gram" in plan and words


def test_lines(spark, vocabulary):
    lines = spark.createDataFrame([(1, "THOR the th*r thar~1"), (2, "thxr~ thor"), (3, ""), (4, None), (5, "~ *~ a~0 t")], "query_id int, line string")
    terms = {}
    for r in pattern_terms(lines, deletion_table(vocabulary), gram_table(vocabulary), vocabulary).orderBy("query_id", "pos").collect():
        terms.setdefault(r["query_id"], []).append(r["token"])
    assert terms[1][:3] == ["thor", "thar", "thr"] and len(terms[1]) == len(set(terms[1])) and set(terms[2]) == {"thor", "thar", "thr", "other"}
    assert 3 not in terms and 4 not in terms and (terms.get(5) or ["a"]) == ["a"]
    found = spark.createDataFrame([("thor", 0, 1, 0, 0, 0, 0, 0), ("thar", 1, 0, 0, 3, 0, 0, 0), ("thr", 1, 0, 0, 1, 0, 0, 0)], "token string, doc_ord long, t int, i int, b int, c int, r int, l int")
    frequencies, n = found.groupBy("token").count().withColumnRenamed("count", "df"), spark.createDataFrame([(4,)], "n_docs long")
    titles = spark.createDataFrame([(0, "A"), (1, "B")], "doc_ord long, title string")
    ranked = search_patterns(lines, found, frequencies, n, titles, deletion_table(vocabulary), gram_table(vocabulary)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["token"], r["score"]) for r in ranked] == [(1, "thor", 20.0), (1, "thar", 6.0), (1, "thr", 2.0), (2, "thor", 20.0), (2, "thar", 6.0), (2, "thr", 2.0)]
