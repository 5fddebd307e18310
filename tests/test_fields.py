import pytest
from pyspark.sql import functions as F

from quillstone.functions.text import INDEX_V1, INDEX_V2, QUERY, drop_stop_words, tokens, tokens_of_fragments
from quillstone.operators.extract import extract_fields

PAGES = [
    (0, "Nested", "{{infobox a {{x}} b}}"),
    (1, "Two", "{{Infobox one}} mid {{infobox}} end"),
    (2, "Heads", "body == References == *[r1] *[r2] [[Category:x]] * [http://u label] ==External links== * [http://v w] tail"),
    (3, "Tight", "body ==references== *[a] == external links == * [b] ==references== gone"),
    (4, "Deep", "body === references === *[q]"),
    (5, "None", "text [[category:stays]] *[kept] \n next"),
    (6, "Empty", ""),
    (7, None, None),
    (8, "AT&T", "a {{infobox u v}} z"),
    (9, "Twice", "one == references == two == references == three"),
]


@pytest.fixture(scope="module")
def fields(spark):
    rows = extract_fields(spark.createDataFrame(PAGES, "doc_ord long, title string, text string")).collect()
    return {r["doc_ord"]: r for r in rows}


def test_infobox_ends_at_the_first_close(fields):
    assert fields[0]["infobox"] == [" a {{x"] and fields[0]["body"] == "  b}}"
    assert fields[1]["infobox"] == [" one", ""] and fields[8]["infobox"] == [" u v"]


def test_sections(fields):
    two = fields[2]
    assert two["body"] == "body " and two["references"] == ["r1", "r2"] and two["category"] == ["x"] and two["links"] == ["http://v w"]
    assert fields[3]["body"] == "body " and fields[3]["references"] == ["a"] and fields[3]["links"] == ["b"]
    assert fields[4]["body"] == "body =" and fields[4]["references"] == ["q"]
    assert fields[9]["body"] == "one "


def test_without_sections(fields):
    assert fields[5]["body"] == "text [[category:stays]] *[kept]   next" and fields[5]["references"] == fields[5]["category"] == []
    assert fields[6]["body"] == "" and fields[7]["body"] == "" and fields[7]["title"] == "" and fields[8]["title"] == "at&t"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, v1, v2, query",
    [
        ("25kmph", ["25kmph"], ["25", "kmph"], ["25kmph"]),
        ("10^5", ["10^5"], ["10^5"], ["10^5"]),
        ("café x", ["café", "x"], ["caf", "x"], ["caf", "x"]),
        ("a_b&nbsp;c~d", ["a", "b", "nbsp", "c~d"], ["a", "b", "nbsp", "c", "d"], ["a", "b", "nbsp", "c", "d"]),
        ("see http://x.com/y now", ["see", "now"], ["see", "now"], ["see", "now"]),
        ("see http://x.com", ["see", "http", "x", "com"], ["see", "http", "x", "com"], ["see", "http", "x", "com"]),
        ("a—b c", ["a", "b", "c"], ["abc"], ["abc"]),
        ("", [], [], []),
        (None, [], [], []),
    ],
)
def test_three_tokenizers(spark, text, v1, v2, query):
    found = [one(spark, tokens(F.lit(text).cast("string"), c)) for c in (INDEX_V1, INDEX_V2, QUERY)]
    assert found == [v1, v2, query]


def test_fragments_are_tokenized_on_their_own(spark):
    assert one(spark, tokens_of_fragments(F.array(F.lit("http://u"), F.lit("b c")), INDEX_V2)) == ["http", "u", "b", "c"]
    assert one(spark, tokens(F.lit("http://u b c"), INDEX_V2)) == ["b", "c"]


def test_stop_words_and_length(spark):
    bag = F.array(*map(F.lit, ("the", "The", "x", "thor", "jpg")))
    assert one(spark, drop_stop_words(bag, INDEX_V2)) == ["The", "thor", "jpg"]
    assert one(spark, drop_stop_words(bag, INDEX_V1, ("jpg",))) == ["The", "x", "thor"]
