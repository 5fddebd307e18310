"""Boolean queries: words, t:word (one field), AND, OR, NOT and brackets; words next to each other are both wanted.

NOT binds before AND, AND before OR. A line becomes a program in postfix order, which is evaluated for each document that can
match by the set of the line's words that it holds. Which documents can match follows from a cover: words of
which every match holds one at least. Of several parts that are all wanted the one whose cover has the smallest document frequencies is
taken, of alternatives all; only documents of the cover's postings are looked at, so a rare word spares the rest. A line
without a cover, such as NOT word, looks at all documents.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import FIELDS
from ..functions.stemming import stemmer
from ..runtime import materialize, ship

PROGRAM = "array<struct<op:string,leaf:int>>"
_PIECES = re.compile(r"[()]|[^\s()]+")


class Malformed(ValueError):
    pass


def parse_boolean(line: str | None) -> tuple[list[tuple[str, int]], list[tuple[str, str]]]:
    """(program, words) of a line: steps (leaf, number), (not, -1), (and, -1), (or, -1), and (field, word) by number.

    An empty line has no program. Brackets that don't fit and operators without operands are Malformed.
    """
    pieces = _PIECES.findall(line or "")
    program: list[tuple[str, int]] = []
    words: dict[tuple[str, str], int] = {}
    at = 0

    def peek() -> str | None:
        return pieces[at] if at < len(pieces) else None

    def either() -> None:
        nonlocal at
        both()
        while peek() == "OR":
            at += 1
            both()
            program.append(("or", -1))

    def both() -> None:
        nonlocal at
        one()
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                at += 1
            one()
            program.append(("and", -1))

    def one() -> None:
        nonlocal at
        piece = peek()
        if piece is None or piece in (")", "AND", "OR"):
            raise Malformed(f"a word is missing before {piece or 'the end'}")
        at += 1
        if piece == "NOT":
            one()
            program.append(("not", -1))
        elif piece == "(":
            either()
            if peek() != ")":
                raise Malformed("a bracket isn't closed")
            at += 1
        else:
            field, mark, word = piece.partition(":")
            leaf = (field, word.lower()) if mark and field in FIELDS and word else ("z", piece.lower())
            program.append(("leaf", words.setdefault(leaf, len(words))))

    if pieces:
        either()
        if at < len(pieces):
            raise Malformed("a bracket isn't opened")
    return program, list(words)


def cover(program: list[tuple[str, int]], frequency: list[int]) -> list[int] | None:
    """Words of which every match holds one at least, of small document frequencies; None if there are none such."""
    # what a part needs to be true, and what it needs to be false: (documents, words), or None for any document
    stack: list[tuple] = []
    for op, leaf in program:
        if op == "leaf":
            stack.append(((frequency[leaf], [leaf]), None))
        elif op == "not":
            stack.append(stack.pop()[::-1])
        else:
            b, a = stack.pop(), stack.pop()
            any_ = lambda x, y: None if x is None or y is None else (x[0] + y[0], x[1] + y[1])
            all_ = lambda x, y: min((v for v in (x, y) if v is not None), key=lambda v: v[0], default=None)
            first, second = (all_, any_) if op == "and" else (any_, all_)
            stack.append((first(a[0], b[0]), second(a[1], b[1])))
    return sorted(set(stack[0][0][1])) if stack and stack[0][0] is not None else None


def _parsed(batches):
    for batch in batches:
        rows = {"row": [], "program": [], "words": [], "error": []}
        for i, line in enumerate(batch.column("line").to_pylist()):
            try:
                program, words, error = *parse_boolean(line), None
            except Malformed as e:
                program, words, error = [], [], str(e)
            rows["row"].append(i)
            rows["program"].append([{"op": op, "leaf": leaf} for op, leaf in program])
            rows["words"].append([{"field": f, "word": w} for f, w in words])
            rows["error"].append(error)
        step = pa.list_(pa.struct([("op", pa.string()), ("leaf", pa.int32())]))
        word = pa.list_(pa.struct([("field", pa.string()), ("word", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(rows["program"], step), pa.array(rows["words"], word), pa.array(rows["error"], pa.string())], names=["query_id", "program", "words", "error"])


def parse_lines(lines: DataFrame) -> DataFrame:
    """(query_id, program, words, error) of lines(query_id, line); a malformed line has an error and no program."""
    ship(lines.sparkSession)
    kind = lines.schema["query_id"].dataType.simpleString()
    return lines.select("query_id", "line").mapInArrow(_parsed, f"query_id {kind}, program {PROGRAM}, words array<struct<field:string,word:string>>, error string")


def _covers(batches):
    for batch in batches:
        found = []
        for program, known in zip(batch.column("program").to_pylist(), batch.column("known").to_pylist(), strict=True):
            frequency = {k["leaf"]: k["df"] for k in known}
            steps = [(s["op"], s["leaf"]) for s in program]
            found.append(cover(steps, [frequency.get(i, 0) for i in range(1 + max((leaf for _, leaf in steps), default=-1))]))
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("program"), pa.array(found, pa.list_(pa.int32()))], names=["query_id", "program", "cover"])


def holds(program: Column, leaves: Column) -> Column:
    """Whether a program is true of a set of words: a stack of truth values, as a column expression."""
    top, second = (lambda st: F.element_at(st, -1)), (lambda st: F.element_at(st, -2))
    under = lambda st, n: F.slice(st, F.lit(1), F.size(st) - n)

    def step(st: Column, s: Column) -> Column:
        leaf = F.concat(st, F.array(F.array_contains(leaves, s["leaf"])))
        both = F.when(F.size(st) > 1, F.concat(under(st, 2), F.array(F.when(s["op"] == "and", top(st) & second(st)).otherwise(top(st) | second(st))))).otherwise(st)
        return F.when(s["op"] == "leaf", leaf).when(s["op"] == "not", F.concat(under(st, 1), F.array(~top(st)))).otherwise(both)

    return F.element_at(F.aggregate(program, F.array().cast("array<boolean>"), step), 1)


def boolean_matches(lines: DataFrame, found: DataFrame, frequencies: DataFrame, titles: DataFrame, stem: bool = True) -> DataFrame:
    """(query_id, doc_ord) of all documents of postings that answer lines(query_id, line); empty and malformed lines have none.

    titles are all documents, which lines without a cover look at.
    """
    parsed = materialize(parse_lines(lines).where("size(program) > 0").select("query_id", "program", "words"), "programs")
    words = parsed.select("query_id", F.posexplode("words").alias("leaf", "w")).select("query_id", "leaf", F.col("w.field").alias("field"), F.col("w.word").alias("word"))
    token = stemmer(lines.sparkSession)(F.col("word")) if stem else F.col("word")
    terms = materialize(words.select("query_id", F.col("leaf").cast("int").alias("leaf"), "field", token.alias("token")).join(frequencies, "token", "left"), "terms")
    known = terms.groupBy("query_id").agg(F.collect_list(F.struct("leaf", F.coalesce("df", F.lit(0)).cast("long").alias("df"))).alias("known"))
    kind = lines.schema["query_id"].dataType.simpleString()
    planned = parsed.join(known, "query_id").select("query_id", "program", "known")
    planned = materialize(planned.mapInArrow(_covers, f"query_id {kind}, program {PROGRAM}, cover array<int>"), "covers")
    held = F.col("field") == "z"
    for f in FIELDS:
        held = held | ((F.col("field") == f) & (F.col(f) > 0))
    asked = terms.where("df IS NOT NULL").select("query_id", "leaf", "field", "token").join(planned.select("query_id", "cover"), "query_id")
    own = lambda part: found.join(part, "token").where(held).select("query_id", "doc_ord", "leaf")
    first = asked.where(F.array_contains("cover", F.col("leaf")))
    rest = asked.where(F.col("cover").isNull() | ~F.array_contains("cover", F.col("leaf")))
    candidates = materialize(own(first), "candidates")
    others = own(rest)
    within = others.join(candidates.select("query_id", "doc_ord").distinct(), ["query_id", "doc_ord"], "left_semi")
    open_ = planned.where("cover IS NULL").select("query_id")
    every = titles.select("doc_ord").join(open_, F.lit(True)).select("query_id", "doc_ord", F.lit(None).cast("int").alias("leaf"))  # the stated lines against all documents
    loose = others.join(open_, "query_id", "left_semi")
    met = candidates.unionByName(within).unionByName(every).unionByName(loose)
    sets = met.groupBy("query_id", "doc_ord").agg(F.collect_set("leaf").alias("leaves"))
    return sets.join(planned, "query_id").where(holds(F.col("program"), F.col("leaves"))).select("query_id", "doc_ord")
