import random

import pytest
from pyspark.sql import functions as F

from quillstone import runtime
from quillstone.operators.boolean import Malformed, boolean_matches, cover, parse_boolean
from quillstone.operators.counting import row_postings
from quillstone.operators.extract import extract_fields
from quillstone.operators.links import link_graph, link_rank

LINES = ["thor", "thor AND odin", "thor odin", "thor OR loki AND odin", "(thor OR loki) odin", "NOT thor", "NOT (thor OR odin) storm", "thor NOT odin", "t:thor", "t:thor OR NOT b:odin", "NOT NOT thor", "unknown OR thor", "unknown thor", "NOT unknown", "", "thor thor", "((thor))", "thor AND NOT NOT (loki OR NOT odin)"]


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(6)
    words = ["thor", "odin", "loki", "storm"]
    return [(i, " ".join(rng.sample(words, rng.randint(0, 2))), " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for i in range(50)]


def truth(line, title, text):
    """Python's own operators, of the words' truth."""
    out = []
    for piece in line.replace("(", " ( ").replace(")", " ) ").split():
        word = piece not in ("AND", "OR", "NOT", "(", ")")
        if out and (word or piece in ("NOT", "(")) and out[-1] not in ("and", "or", "not", "("):
            out.append("and")
        field, _, name = piece.rpartition(":")
        where = {"t": title, "b": text, "": f"{title} {text}"}[field]
        out.append(str(name in where.split()) if word else piece.lower())
    return bool(out) and eval(" ".join(out))  # noqa: S307


def test_boolean_lines_against_brute_force(spark, pages):
    df = spark.createDataFrame(pages, "doc_ord long, title string, text string")
    found = row_postings(extract_fields(df), stem=False)
    frequencies = found.groupBy("token").agg(F.count("*").alias("df"))
    lines = spark.createDataFrame([*enumerate(LINES), (98, None), (99, "( thor")], "query_id int, line string")
    got = sorted(map(tuple, boolean_matches(lines, found, frequencies, df.select("doc_ord", "title"), stem=False).collect()))
    assert got == sorted((q, i) for q, line in enumerate(LINES) for i, title, text in pages if truth(line, title, text))
    stemmed = row_postings(extract_fields(df))
    one = spark.createDataFrame([(0, "storms AND NOT thors")], "query_id int, line string")
    got = boolean_matches(one, stemmed, stemmed.groupBy("token").agg(F.count("*").alias("df")), df.select("doc_ord", "title"))
    assert sorted(r["doc_ord"] for r in got.collect()) == [i for i, t, x in pages if "storm" in f"{t} {x}" and "thor" not in f"{t} {x}"]


def test_programs_and_covers():
    program, words = parse_boolean("a b OR NOT (c AND t:a)")
    assert words == [("z", "a"), ("z", "b"), ("z", "c"), ("t", "a")]
    assert [op if i < 0 else words[i][1] for op, i in program] == ["a", "b", "and", "c", "a", "and", "not", "or"]
    for bad in ("(", ")", "a )", "( a", "AND a", "a OR", "NOT", "a AND OR b", "()"):
        with pytest.raises(Malformed):
            parse_boolean(bad)
    plan = lambda line, *df: cover(parse_boolean(line)[0], list(df))
    assert plan("a b c", 5, 2, 9) == [1] and plan("a OR b", 5, 2) == [0, 1] and plan("NOT a", 5) is None and plan("a OR NOT b", 1, 1) is None
    assert plan("(a OR b) c", 1, 1, 9) == [0, 1] and plan("NOT (NOT a OR b)", 5, 1) == [0] and plan("") is None


def power(edges, nodes, damping, rounds=300):
    nodes = sorted({x for e in edges for x in e} | set(nodes))
    out = {v: [b for a, b in edges if a == v] for v in nodes}
    rank = {v: 1 / len(nodes) for v in nodes}
    for _ in range(rounds):
        lost = sum(rank[v] for v in nodes if not out[v])
        new = {v: (1 - damping) / len(nodes) + damping * lost / len(nodes) for v in nodes}
        for v in nodes:
            for w in out[v]:
                new[w] += damping * rank[v] / len(out[v])
        rank = new
    return rank


@pytest.mark.parametrize("hot", [256, 2])
def test_ranks_equal_power_iteration(spark, monkeypatch, hot):
    monkeypatch.setattr(runtime, "HOT_ROWS", hot)
    rng = random.Random(8)
    edges = {(f"n{rng.randrange(30)}", f"n{rng.randrange(20)}") for _ in range(80)} | {(f"n{i}", "n0") for i in range(1, 30)} | {("n1", f"n{i}") for i in range(2, 30)}
    edges = {e for e in edges if e[0] != e[1]}
    links = spark.createDataFrame([*edges, *list(edges)[:5], (None, "n1"), ("n1", None)], "source string, target string")
    ranks = {r["node"]: r["rank"] for r in link_rank(links, spark.createDataFrame([("alone",), (None,)], "node string")).collect()}
    want = power(edges, ["alone"], 0.85)
    assert ranks.keys() == want.keys() and all(abs(ranks[v] - want[v]) < 1e-9 for v in want) and abs(sum(ranks.values()) - 1) < 1e-9
    assert link_rank(links.limit(0)).collect() == []


def test_links_are_resolved(spark):
    html = """<a href="/a/b/../c?x=1#y"> <A HREF='HTTPS://Other.org/P/'> <a href="//cdn.net"> <a href="#top"> <a href=""> <a href="mailto:x@y"> <a href="sub/./d"> <a href="../../up">
    <a href="/a/b"> <a href="/a/c"> <a href="?q=1"> <a href="http://h.com/a/b/#self"> <a href="e&amp;f">"""
    rows = [("http://H.com/a/b/?q", html), ("https://h.com", '<a href="x">'), (None, html), ("ftp://h.com/", html), ("http://h.com/z", None), ("not a url", html)]
    found = sorted(map(tuple, link_graph(spark.createDataFrame(rows, "url string, html string")).collect()))
    own = ["cdn.net/", "h.com/a/b/e&f", "h.com/a/b/sub/d", "h.com/a/c", "h.com/up", "other.org/P"]
    assert found == sorted([("h.com/a/b", t) for t in own] + [("h.com/", "h.com/x")])
