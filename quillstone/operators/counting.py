"""Postings made in a page's own row: what a page holds is counted, or placed, without any shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import FIELDS
from ..functions.stemming import stem_words
from ..functions.stopwords import STOP_WORDS
from ..functions.text import INDEX_V1, INDEX_V2, URL, TokenizerConfig, byte_classes, tokens
from ..runtime import bounded_batches, ship
from .postings import CHUNK_DOCS

NAMES = {"t": "title", "i": "infobox", "b": "body", "c": "category", "r": "references", "l": "links"}
#: A fragment's tokens are numbered from so many times its number, so that no two fragments' tokens are neighbours.
FRAGMENT_SHIFT = 32
#: Postings whose lists are put together before they leave a worker.
LIST_POSTINGS = 1 << 20
#: Tokens that are counted at once; a single longer page is counted on its own.
SLICE_TOKENS = 1 << 18


def token_lists(fields: DataFrame, config: TokenizerConfig = INDEX_V2) -> DataFrame:
    """doc_ord and, for each field's letter, its tokens as they stand, an array for each fragment; titles and bodies have one."""

    def found(field: str) -> Column:
        text = F.col(NAMES[field])
        if field in ("t", "b"):
            return F.array(tokens(text, config))
        if config is INDEX_V1:  # joins fragments before it tokenizes
            return F.array(tokens(F.array_join(text, " "), config))
        return F.transform(text, lambda x: tokens(x, config))

    return fields.select("doc_ord", *(found(f).alias(f) for f in FIELDS))


def text_lists(fields: DataFrame) -> DataFrame:
    """doc_ord and, for each field's letter, its texts, one for each fragment; titles and bodies have one."""
    return fields.select("doc_ord", *((F.array(F.col(NAMES[f])) if f in ("t", "b") else F.col(NAMES[f])).alias(f) for f in FIELDS))


def split_texts(texts: pa.Array, config: TokenizerConfig) -> pa.ListArray:
    """The tokens of each text as tokens() gives them, for a configuration that keeps only ASCII and pads letters."""
    ends, data = _bytes(texts)
    if len(data) and data.max() > 127:
        kept = data < 128
        ends, data = np.concatenate(([0], np.cumsum(kept)))[ends], data[kept]
    if b"http" in data.tobytes():
        ends, data = _bytes(pc.replace_substring_regex(_strings(ends, data), pattern=URL, replacement=" "))
    kind = byte_classes(config)[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[ends[:-1][ends[:-1] < len(data)]] = True
    begins = np.flatnonzero(new)
    lengths = np.diff(np.append(begins, len(data)))
    words = kind[begins] > 0
    found = _strings(np.concatenate(([0], np.cumsum(lengths[words]))), data[kind > 0])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begins[words], ends).astype(np.int32)), found)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where texts end, after a 0, and their bytes; null as empty."""
    texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], data


def _strings(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _of_texts(made: Callable, config: TokenizerConfig) -> Callable:
    """What makes rows of tokens, as a function of texts that are split here."""

    def split(column: pa.Array) -> pa.ListArray:
        ends = column.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(ends - ends[0]), split_texts(column.flatten(), config))

    def run(batches):
        return made(pa.RecordBatch.from_arrays([b.column("doc_ord"), *(split(b.column(f)) for f in FIELDS)], names=["doc_ord", *FIELDS]) for b in batches)

    return run


def _mapped(fields: DataFrame, config: TokenizerConfig, made: Callable, schema: str) -> DataFrame:
    """Rows that made() makes of the tokens of fields; ASCII texts are split in Arrow batches, by bytes, others by expressions."""
    ship(fields.sparkSession)
    bounded_batches(fields.sparkSession)
    by_bytes = config.ascii_only and config.pad_letters
    lists = (text_lists(fields) if by_bytes else token_lists(fields, config)).withColumn("doc_ord", F.col("doc_ord").cast("long"))
    return lists.mapInArrow(_of_texts(made, config) if by_bytes else made, schema)


def _vocabulary(config: TokenizerConfig, stem: bool, extra: tuple[str, ...]) -> Callable[[pa.Array], pa.Array]:
    """What distinct words are indexed as; null for stop words and short ones."""
    stop, least = pa.array(sorted({*STOP_WORDS, *extra}), pa.string()), config.min_length

    def named(words: pa.Array) -> pa.Array:
        long_enough = pc.greater_equal(pc.utf8_length(words), least)
        kept = pc.if_else(pc.and_not(long_enough, pc.is_in(words, stop)), words, pa.scalar(None, pa.string()))
        return pa.array(stem_words(kept.to_pylist()), pa.string()) if stem else kept

    return named


@dataclass
class _Counted:
    """Postings of a slice by (word, document): what words are, and of each posting its word, its row by document and a column of counts by field.

    With places, key numbers (posting, field) by occurrence, and gaps has an occurrence's place or its distance from the one before.
    """

    words: pa.Array
    docs: pa.Array
    word: np.ndarray
    row: np.ndarray
    counts: list[np.ndarray]
    fields: np.ndarray
    starts: np.ndarray
    posting: np.ndarray
    gaps: np.ndarray | None = None


def _counted(batch: pa.RecordBatch, named: Callable[[pa.Array], pa.Array], placed: bool = False) -> _Counted:
    """Words are filtered and numbered in binary order once a slice, so that one sort of integers brings a slice into the order of an index."""
    by = pc.sort_indices(batch.column("doc_ord"))
    row = np.empty(len(by), np.int64)
    row[by.to_numpy()] = np.arange(len(by))
    columns = [batch.column(f) for f in FIELDS]
    of = np.concatenate([np.repeat(row << 3 | i, np.diff(_ends(c), prepend=0)) for i, c in enumerate(columns)])
    occurring = pa.concat_arrays([c.flatten().flatten() for c in columns]).dictionary_encode()
    known = named(occurring.dictionary).dictionary_encode()
    order = pc.sort_indices(known.dictionary).to_numpy()
    number = np.full(len(order) + 1, -1, np.int64)  # the last is that of null
    number[order] = np.arange(len(order))
    word = number[known.indices.fill_null(-1).to_numpy()][occurring.indices.to_numpy()] if len(of) else np.zeros(0, np.int64)
    kept = word >= 0
    key = word[kept] << 35 | of[kept]
    if placed:
        at = np.argsort(key, kind="stable")
        key, place = key[at], np.concatenate([_standing(c) for c in columns])[kept][at]
    else:
        key = np.sort(key)
    starts = _changes(key)
    n = np.diff(np.append(starts, len(key)))
    fields = key[starts] & 7
    both = key[starts] >> 3
    first = _changes(both)
    posting = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(both))))
    counts = []
    for i in range(len(FIELDS)):
        mine = fields == i
        counts.append(np.zeros(len(first), np.int32))
        counts[i][posting[mine]] = n[mine]
    found = _Counted(known.dictionary.take(pa.array(order)), batch.column("doc_ord").take(by), both[first] >> 32, both[first] & 0xFFFFFFFF, counts, fields, starts, posting)
    if placed:
        found.gaps = np.diff(place, prepend=0)
        found.gaps[starts] = place[starts]
    return found


def _changes(keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))


def _standing(column: pa.Array) -> np.ndarray:
    """The place of every token of a column of arrays of arrays in its row."""
    fragments = column.flatten()
    per_row, per_fragment = (np.diff(x.offsets.to_numpy()) for x in (column, fragments))
    ordinal = np.arange(len(per_fragment)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    begins = np.cumsum(per_fragment, dtype=np.int64) - per_fragment
    return np.repeat((ordinal << FRAGMENT_SHIFT) - begins, per_fragment) + np.arange(int(per_fragment.sum()))


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into, or put together to, runs of rows with about size tokens; what a worker holds doesn't grow with a batch."""
    held, holds = [], 0
    for batch in batches:
        ends = sum(_ends(batch.column(f)) for f in FIELDS)
        at = 0
        while at < batch.num_rows:
            begun = ends[at - 1] if at else 0
            to = at + int(np.searchsorted(ends[at:], begun + size - holds, "right"))
            if to > at or not held:
                to = max(at + 1, to)
                held.append(batch.slice(at, to - at))
                holds += int(ends[to - 1] - begun)
                at = to
            if at < batch.num_rows:
                yield _whole(held)
                held, holds = [], 0
    if held:
        yield _whole(held)


def _whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _ends(column: pa.Array) -> np.ndarray:
    """Tokens of a column of arrays of arrays up to and with each row."""
    fragments = column.flatten()
    to = fragments.offsets.to_numpy().astype(np.int64)
    rows = column.offsets.to_numpy()
    return to[rows[1:] - rows[0]] - to[0]


def _counts(config: TokenizerConfig, stem: bool, extra: tuple[str, ...], placed: bool = False):
    def run(batches):
        named = _vocabulary(config, stem, extra)
        for batch in _slices(batches, SLICE_TOKENS):
            c = _counted(batch, named, placed)
            columns = [c.words.take(pa.array(c.word)), c.docs.take(pa.array(c.row)), *map(pa.array, c.counts)]
            if placed:
                ends = np.append(c.starts[_changes(c.posting)], len(c.gaps)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(c.gaps)))
            yield pa.RecordBatch.from_arrays(columns, names=["token", "doc_ord", *FIELDS, *(["gaps"] if placed else [])])

    return run


def row_postings(fields: DataFrame, config: TokenizerConfig = INDEX_V2, stem: bool = True, extra_stop_words: tuple[str, ...] = (), placed: bool = False) -> DataFrame:
    """(token, doc_ord, t, i, b, c, r, l): counts of each token, or each stem, of a page by field, a page being one row of fields.

    Words are numbered by slices of a worker's pages, so each is filtered and stemmed once a slice, and a worker remembers
    stems. Rows of a slice are sorted by token and document, so that sorting them all means merging. With placed there is a
    column gaps too, from which positions_of() makes the places.
    """
    schema = "token string, doc_ord long, " + ", ".join(f"{f} int" for f in FIELDS) + (", gaps array<long>" if placed else "")
    return _mapped(fields, config, _counts(config, stem, tuple(extra_stop_words), placed), schema)


def positions_of(found: DataFrame) -> DataFrame:
    """(token, doc_ord, field, gaps), as positional_postings() makes them, of postings with gaps: those of the first field come first."""
    parts, before = [], F.lit(1)
    for f in FIELDS:
        parts.append(F.struct(F.lit(f).alias("field"), F.slice("gaps", before, F.col(f)).alias("gaps")))
        before = before + F.col(f)
    each = F.explode(F.filter(F.array(*parts), lambda x: F.size(x["gaps"]) > 0))
    return found.select("token", "doc_ord", each.alias("p")).select("token", "doc_ord", "p.field", "p.gaps")


def _encoded(c: _Counted) -> pa.Array:
    """Each posting as encode_posting() writes it."""
    code, texts = np.zeros(len(c.row), np.int64), [""]
    for f, n in zip(FIELDS, c.counts, strict=True):
        if n.any():  # combinations of counts that occur are numbered anew with each field
            every, at = _numbered(n)
            every, code = _numbered(code * len(at_least := [f"{f}{k}" if k else "" for k in every.tolist()]) + at)
            texts = [texts[k // len(at_least)] + at_least[k % len(at_least)] for k in every.tolist()]
    docs = pc.binary_join_element_wise("d", pc.cast(c.docs, pa.string()), "")
    return pc.binary_join_element_wise(docs.take(pa.array(c.row)), pa.array(texts, pa.string()).take(pa.array(code)), "")


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, none below 0, in order, and the place of each value among them; without sorting where the largest is no larger than their number."""
    if not len(values) or values.max() > max(1 << 16, len(values)):
        return np.unique(values, return_inverse=True)
    every = np.flatnonzero(np.bincount(values))
    at = np.zeros(int(every[-1]) + 1, np.int64)
    at[every] = np.arange(len(every))
    return every, at[values]


LIST_NAMES = ["token", "chunk", "first", "last", "postings"]


def _lists_of(c: _Counted, chunk: int) -> pa.RecordBatch:
    """A row for each token and chunk: the first and the last document and the postings between, by document."""
    docs = c.docs.to_numpy()
    word, doc, posting = c.word, docs[c.row], _encoded(c)
    if np.any(docs[1:] == docs[:-1]):  # a page that came twice
        order = np.lexsort((pc.rank(posting).to_numpy(), doc, word)) if len(doc) else np.zeros(0, np.int64)
        word, doc, posting = word[order], doc[order], posting.take(pa.array(order))
    part = doc // chunk
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(doc)), bool), (word[1:] != word[:-1]) | (part[1:] != part[:-1]))))
    until = np.append(starts, len(doc))
    ends, data = _bytes(posting)
    columns = [c.words.take(pa.array(word[starts])), *map(pa.array, (part[starts], doc[starts], doc[until[1:] - 1]))]
    return pa.RecordBatch.from_arrays([*columns, _strings(ends[until], data)], names=LIST_NAMES)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Lists of one token and chunk whose documents lie apart as one row, one after the other."""
    if len(batches) == 1:
        return batches[0]
    lists = pa.concat_batches(batches)
    token = lists.column("token").dictionary_encode()
    word = token.indices.to_numpy()
    part, first, last = (lists.column(n).to_numpy() for n in LIST_NAMES[1:4])
    order = np.lexsort((first, part, word))
    word, part, first, last = word[order], part[order], first[order], last[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(word)), bool), (word[1:] != word[:-1]) | (part[1:] != part[:-1]) | (first[1:] <= last[:-1]))))
    until = np.append(starts, len(word))
    ends, data = _bytes(lists.column("postings").take(pa.array(order)))
    columns = [token.dictionary.take(pa.array(word[starts])), *map(pa.array, (part[starts], first[starts], last[until[1:] - 1]))]
    return pa.RecordBatch.from_arrays([*columns, _strings(ends[until], data)], names=LIST_NAMES)


def _lists(config: TokenizerConfig, stem: bool, extra: tuple[str, ...], chunk: int):
    def run(batches):
        named = _vocabulary(config, stem, extra)
        held, size = [], 0
        for batch in _slices(batches, SLICE_TOKENS):
            c = _counted(batch, named)
            if held and size + len(c.word) > LIST_POSTINGS:
                yield _joined(held)
                held, size = [], 0
            if len(c.word):
                held.append(_lists_of(c, chunk))
                size += len(c.word)
        if held:
            yield _joined(held)

    return run


def row_lists(fields: DataFrame, config: TokenizerConfig = INDEX_V2, stem: bool = True, extra_stop_words: tuple[str, ...] = (), chunk: int = CHUNK_DOCS) -> DataFrame:
    """(token, chunk, first, last, postings): postings in text form of pages that lie together, by chunk of documents; merge_lists() makes one row of each token and chunk."""
    return _mapped(fields, config, _lists(config, stem, tuple(extra_stop_words), chunk), "token string, chunk long, first long, last long, postings string")


def _places(config: TokenizerConfig, stem: bool, extra: tuple[str, ...]):
    letters = pa.array(FIELDS, pa.string())

    def run(batches):
        named = _vocabulary(config, stem, extra)
        for batch in _slices(batches, SLICE_TOKENS):
            c = _counted(batch, named, True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(c.starts, len(c.gaps)).astype(np.int32)), pa.array(c.gaps))
            columns = [c.words.take(pa.array(c.word[c.posting])), c.docs.take(pa.array(c.row[c.posting])), letters.take(pa.array(c.fields)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "doc_ord", "field", "gaps"])

    return run


def positional_postings(fields: DataFrame, config: TokenizerConfig = INDEX_V2, stem: bool = True, extra_stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(token, doc_ord, field, gaps): where a token, or stem, stands in a field of a page.

    Places count all tokens of a fragment, stop words too, so words next to each other differ by one. gaps holds the first
    place and then each one's distance from the one before.
    """
    return _mapped(fields, config, _places(config, stem, tuple(extra_stop_words)), "token string, doc_ord long, field string, gaps array<long>")


def places(gaps: Column) -> Column:
    """The places that gaps stand for."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("found"))
    step = lambda acc, gap: F.struct((acc["at"] + gap).alias("at"), F.concat(acc["found"], F.array(acc["at"] + gap)).alias("found"))
    return F.aggregate(gaps, start, step, lambda acc: acc["found"])
