import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions.text import INDEX_V1, INDEX_V2
from quillstone.operators import postings as P
from quillstone.operators import search as S
from quillstone.operators.counting import places, positional_postings, row_postings
from quillstone.operators.extract import extract_fields
from quillstone.operators.positional import matches, parse_positional, search_positional
from quillstone.operators.search import among
from quillstone.plans.build import build_index, load

WORDS = ["thor", "hammer", "the", "storm", "a1b", "odin"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))) for i in range(60)]


@pytest.fixture(scope="module")
def fields(spark, texts):
    return extract_fields(spark.createDataFrame([(i, "Page", t) for i, t in texts], "doc_ord long, title string, text string").repartition(3))


def split(text):
    """Tokens in place: letter runs are on their own."""
    return [x for w in text.split() for x in (["a", "1", "b"] if w == "a1b" else [w])]


def asked(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "query_id int, line string")


def hits(spark, fields, line):
    found = matches(parse_positional(asked(spark, line), stem=False), positional_postings(fields, stem=False))
    return {(r["clause"], r["doc_ord"]): r["n"] for r in found.where("field = 'b'").collect()}


def test_counts_in_the_row_equal_counts_after_a_shuffle(spark, fields):
    page = ("Running AT&T http://x.y z", "{{Infobox thor | a = running runs}} x {{infobox b}} Thor's runs, run! ==References== *[runs a] [[Category:Gods]][[Category:God]] ==External links== * [http://a.b site] * [run]")
    pages = spark.createDataFrame([(0, *page), (1, None, None), (2, "", ""), (3, "the", "a b c"), (4, *page)], "doc_ord long, title string, text string")
    for source in (fields, extract_fields(pages)):
        for config, stem, extra in ((INDEX_V2, True, ()), (INDEX_V2, False, ("thor",)), (INDEX_V1, False, ())):
            old = P.postings(P.field_tokens(source, config, extra), stem)
            assert sorted(map(tuple, row_postings(source, config, stem, extra).collect())) == sorted(map(tuple, old.collect()))


def test_no_text_is_shuffled(fields):
    assert "Exchange hashpartitioning" not in row_postings(fields)._jdf.queryExecution().executedPlan().toString()


def test_places_are_where_tokens_stand(spark, fields, texts):
    found = {(r["doc_ord"], r["token"]): r["at"] for r in positional_postings(fields, stem=False).where("field = 'b'").select("doc_ord", "token", places(F.col("gaps")).alias("at")).collect()}
    want = {}
    for i, t in texts:
        for at, w in enumerate(split(t)):
            if len(w) > 1 and w != "the":
                want.setdefault((i, w), []).append(at)
    assert found == want


@pytest.mark.parametrize("phrase", [["thor", "hammer"], ["thor", "thor"], ["odin"], ["storm", "the", "thor"], ["thor", "a1b", "odin"], ["a1b", "thor"]])
def test_phrases_against_brute_force(spark, fields, texts, phrase):
    want, words = {}, split(" ".join(phrase))
    kept = [(i, w) for i, w in enumerate(words) if w != "the" and len(w) > 1]
    for i, t in texts:
        tokens = split(t)
        n = sum(all(0 <= s + o < len(tokens) and tokens[s + o] == w for o, w in kept) for s in range(-len(words), len(tokens)))
        if n:
            want[(0, i)] = n
    assert hits(spark, fields, f'"{" ".join(phrase)}"') == want


@pytest.mark.parametrize("one, other, far", [("thor", "hammer", 1), ("thor", "odin", 3), ("thor", "thor", 2), ("hammer", "storm", 500)])
def test_words_near_each_other_against_brute_force(spark, fields, texts, one, other, far):
    want = {}
    for i, t in texts:
        tokens = split(t)
        n = sum(any(1 <= abs(a - b) <= far for b, y in enumerate(tokens) if y == other) for a, x in enumerate(tokens) if x == one)
        if n:
            want[(0, i)] = n
    assert hits(spark, fields, f"{one} NEAR/{far} {other}") == want


def test_clauses(spark):
    lines = ['"Thor Hammer" odin', "a NEAR/5 thor", "thor NEAR/2 odin NEAR/3 storm", "the", "", None, '"the of"', "NEAR/3 thor", "thor NEAR/3", "thor NEAR/0 odin", '"a1b odin', "x thor1 NEAR/4 2odin"]
    rows = {}
    for r in parse_positional(asked(spark, *lines), stem=False).orderBy("query_id", "clause", "slot").collect():
        rows.setdefault(r["query_id"], []).append((r["clause"], r["distance"], r["slot"], r["offset"], r["token"]))
    assert rows[0] == [(0, None, 0, 0, "thor"), (0, None, 1, 1, "hammer"), (1, None, 0, 0, "odin")]
    assert rows[2] == [(0, 2, 0, 0, "thor"), (0, 2, 1, 1, "odin"), (1, 3, 0, 0, "odin"), (1, 3, 1, 1, "storm")]
    assert all(i not in rows for i in (1, 3, 4, 5, 6, 7, 8)) and [r[4] for r in rows[9]] == ["thor", "near", "odin"] and [r[4] for r in rows[10]] == ["odin"]
    assert [r["token"] for r in parse_positional(asked(spark, '"running hammers"')).collect()] == ["run", "hammer"] and 11 not in rows


def test_a_document_holds_every_clause_and_fragments_are_apart(spark, monkeypatch):
    pages = spark.createDataFrame([
        (0, "Thor storm", "odin hammer ==References== *[alpha beta] *[gamma delta]"), (1, "Odin", "hammer odin hammer"), (2, "x", "thor"), (3, "Odin", "odin hammer storm hammer"), (4, None, None)],
        "doc_ord long, title string, text string",
    )
    found, titles, n = positional_postings(extract_fields(pages), stem=False), pages.select("doc_ord", "title"), pages.selectExpr("count(*) AS n_docs")
    ask = lambda *lines: [(r["query_id"], r["doc_ord"]) for r in search_positional(asked(spark, *lines), found, n, titles, stem=False).orderBy("query_id", "rank").collect()]
    lines = ['"odin hammer" storm', '"beta gamma"', '"gamma delta"', '"thor odin"', "odin NEAR/1 hammer", "storm unknown"]
    want = [(0, 0), (0, 3), (2, 0), (4, 1), (4, 0), (4, 3)]
    got = ask(*lines)
    assert sorted(got) == sorted(want) and got[:3] == [(0, 0), (0, 3), (2, 0)]
    monkeypatch.setattr(S, "MAX_TERMS", 2)
    assert ask(*lines) == got


def test_stored_postings_hold_the_places(spark, texts, tmp_path):
    """Places are made, dealt and sorted with the postings; only rows of the words asked for reach the search."""
    page = ("Thor runs", "{{Infobox thor | a = running runs}} thor {{infobox b}} thor's runs ==References== *[runs thor] *[thor] [[Category:Gods]] ==External links== * [http://a.b thor] * [run]")
    pages = spark.createDataFrame([(i, "Page", t) for i, t in texts] + [(100, *page), (101, None, None)], "doc_ord long, title string, text string")
    build_index(pages, str(tmp_path / "index"), stem=False, positions=True)
    assert not (tmp_path / "index" / "positions").exists()
    index = load(spark, str(tmp_path / "index"))
    want = positional_postings(extract_fields(pages), stem=False)
    assert index.positions.columns == want.columns and sorted(map(str, index.positions.collect())) == sorted(map(str, want.collect()))
    assert index.postings.columns == row_postings(extract_fields(pages)).columns
    words = [f"w{i}" for i in range(12)]  # a scan takes more than ten in one list for a range
    plan = index.positions.where(among(words))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,w1)" in plan
    assert index.positions.where(among([])).count() == 0
