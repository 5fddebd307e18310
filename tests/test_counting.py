import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.functions.scoring import FIELDS, decode_posting, encode_posting
from quillstone.functions.text import INDEX_V2, tokens
from quillstone.operators import counting
from quillstone.operators import postings as P
from quillstone.operators.counting import positional_postings, row_lists, row_postings
from quillstone.operators.extract import extract_fields
from quillstone.runtime import BATCH_SETTINGS, bounded_batches


def batch(pages: list[list[list[str]]]) -> pa.RecordBatch:
    """Pages with the same fragments in every field."""
    kind = pa.list_(pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(range(len(pages)), pa.int64()), *(pa.array(pages, kind) for _ in FIELDS)], names=["doc_ord", *FIELDS])


PAGES = [[["one", "two"], []], [], [[]], [["two"] * 50], [["three", "one"], ["one"]], [["four"]]]


@pytest.mark.parametrize("made", [counting._counts, counting._places])
def test_what_is_counted_at_once_is_bounded(monkeypatch, made):
    whole = [b for b in made(INDEX_V2, False, ())([batch(PAGES).slice(1)]) if b.num_rows]
    monkeypatch.setattr(counting, "SLICE_TOKENS", 20)
    parts = [b for b in made(INDEX_V2, False, ())([batch(PAGES).slice(1)]) if b.num_rows]
    rows = lambda found: sorted(map(str, (r for b in found for r in b.to_pylist())))
    assert rows(parts) == rows(whole) and len({d for b in whole for d in b.column("doc_ord").to_pylist()}) == 3
    assert len(parts) > len(whole) and all(len(set(b.column("doc_ord").to_pylist())) < 3 for b in parts)


def test_slices_hold_every_row_once():
    found = list(counting._slices([batch(PAGES), batch([])], 20))
    assert [r for b in found for r in b.column("doc_ord").to_pylist()] == list(range(len(PAGES))) and len(found) > 2


def test_batches_to_python_are_bounded(spark):
    session = spark.newSession()
    bounded_batches(session)
    assert {k: session.conf.get(k) for k in BATCH_SETTINGS} == BATCH_SETTINGS or session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    by_hand = spark.newSession()
    by_hand.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
    bounded_batches(by_hand)
    assert by_hand.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "77"


ODD = ["", None, "thor", "a1b2cc 33x^y\x7fz", "héttp://x.y Z http", "http http://a.b c", "x—y İ \x1c\x0b\x85q", "d'été (l'été)\t~re-read_", "\U0001f600 1,000.50$ %", "httpx\nhttp://b q", " 9 "]


def test_bytes_are_split_as_expressions_split_texts(spark):
    every = "".join(map(chr, range(1, 400)))
    texts = [*ODD, every, *(f"a{c}b {c}{c}1" for c in every)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", tokens(F.col("text"), INDEX_V2).alias("found"))
    want = {r["i"]: r["found"] for r in rows.collect()}
    for first in (0, 3):  # a slice whose offsets don't begin at 0
        assert counting.split_texts(pa.array(texts, pa.string())[first:], INDEX_V2).to_pylist() == [want[i] for i in range(first, len(texts))]
    assert counting.split_texts(pa.array([], pa.string()), INDEX_V2).to_pylist() == []


@pytest.mark.parametrize("held", [1, 7, 1 << 18])
def test_lists_of_batches_equal_lists_of_postings(spark, monkeypatch, held):
    """Documents of a chunk lie in several lists, one after the other or mixed, and come twice."""
    pages = spark.createDataFrame([(i * 7 % 40, f"Title {i}", f"alpha beta{i % 3} {{{{infobox k{i}}}}} gamma gamma") for i in range(40)] + [(3, "Title", "alpha alpha"), (3, None, None)], "doc_ord long, title string, text string")
    want = sorted(map(tuple, P.posting_lists(row_postings(extract_fields(pages), stem=False), 10).collect()))
    schema = "token string, chunk long, first long, last long, postings string"
    monkeypatch.setattr(counting, "LIST_POSTINGS", held)
    fields = counting.text_lists(extract_fields(pages)).toArrow().combine_chunks()
    for size in (1, 5, 100):
        batches = counting._of_texts(counting._lists(INDEX_V2, False, (), 10), INDEX_V2)(iter(fields.to_batches(max_chunksize=size)))
        made = [r for b in batches for r in b.to_pylist()]
        parts = spark.createDataFrame([tuple(r.values()) for r in made], schema)
        assert sorted(map(tuple, P.merge_lists(parts).collect())) == want
    plan = P.merge_lists(row_lists(extract_fields(pages), stem=False))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(first" in plan


def test_postings_are_decoded_without_patterns(spark):
    cols = ["t", "i", "b", "c", "r", "l"]
    rows = [(10**12 + k, *(k * 37 if k >> n & 1 else 0 for n in range(6))) for k in range(1, 64)]
    df = spark.createDataFrame(rows, "doc_ord long, " + ", ".join(f"{c} int" for c in cols))
    found = df.select(decode_posting(F.substring(encode_posting(), 2, 100)).alias("p")).select("p.*")
    assert sorted(map(tuple, found.collect())) == rows and "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_places_are_made_of_texts(spark):
    """No expression makes an array of tokens before Python gets a page."""
    pages = spark.createDataFrame([(1, "A title", "some text")], "doc_ord long, title string, text string")
    for made in (positional_postings, row_postings):
        plan = made(extract_fields(pages), stem=False)._jdf.queryExecution().optimizedPlan().toString()
        assert "[A-Za-z]+" not in plan


def test_slices_put_small_batches_together():
    """One filtering and one sort of words for many small batches, and no slice of more tokens than asked for but a longer page."""
    small = [batch([[["one", "two"]]]) for _ in range(7)]
    assert [b.num_rows for b in counting._slices(small, 36)] == [3, 3, 1]
    assert [b.num_rows for b in counting._slices([batch(PAGES)], 1)] == [1, 2, 1, 1, 1]
    assert [b.num_rows for b in counting._slices(small, 1 << 18)] == [7] and not list(counting._slices([batch([])], 20))


def test_postings_of_a_slice_are_sorted():
    """By token, byte by byte, and document, whatever the order of pages and words."""
    pages = batch([[["zeta", "Zeta", "alpha"]], [["alpha", "z"]], [["zeta", "alpha"], ["ab1"]]]).set_column(0, "doc_ord", pa.array([9, 3, 5], pa.int64()))
    for placed in (False, True):
        (found,) = counting._counts(INDEX_V2, False, (), placed)([pages])
        rows = list(zip(*(found.column(c).to_pylist() for c in ("token", "doc_ord")), strict=True))
        assert rows == [("Zeta", 9), ("ab1", 5), ("alpha", 3), ("alpha", 5), ("alpha", 9), ("zeta", 5), ("zeta", 9)]


def test_lists_are_put_together_before_they_leave_a_worker(monkeypatch):
    """Slices' lists of a token and chunk become one row where their documents lie apart; their words aren't sorted again."""
    monkeypatch.setattr(counting, "SLICE_TOKENS", 6)
    made = lambda docs: [tuple(r.values()) for b in counting._lists(INDEX_V2, False, (), 10)([batch([[["one"]]] * len(docs)).set_column(0, "doc_ord", pa.array(docs, pa.int64()))]) for r in b.to_pylist()]
    each = "t1i1b1c1r1l1"
    assert made([1, 2, 8, 11]) == [("one", 0, 1, 8, f"d1{each}d2{each}d8{each}"), ("one", 1, 11, 11, f"d11{each}")]
    assert sorted(made([4, 4, 1])) == [("one", 0, 1, 4, f"d1{each}d4{each}"), ("one", 0, 4, 4, f"d4{each}")]


def test_posting_texts_of_any_counts(spark):
    """Counts by few or many values, small or large, are written as encode_posting() writes them."""
    rows = [(d, *((d * 37 + f * 11) % m * (d >> f & 1) for f, m in enumerate((2, 3, 500, 7, 1 << 20, 90_000)))) for d in range(1, 64)]
    df = spark.createDataFrame(rows, "doc_ord long, " + ", ".join(f"{f} int" for f in FIELDS))
    want = [r["p"] for r in df.orderBy("doc_ord").select(encode_posting().alias("p")).collect()]
    number = np.arange(len(rows))
    c = counting._Counted(pa.array(["w"]), pa.array([r[0] for r in rows]), number * 0, number, [np.array(x, np.int32) for x in zip(*(r[1:] for r in rows), strict=True)], number, number, number)
    assert counting._encoded(c).to_pylist() == want
