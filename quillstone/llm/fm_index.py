"""Benchmark decontamination by an FM-index of every training shard.

A task indexes the texts it reads, a bounded shard at a time. A shard's symbols are words of the test
phrases; a maximal run of such words that is shorter than every phrase can't hold one and isn't
indexed, and each run ends in a separator of its own. The index is a Burrows-Wheeler transform in a
wavelet matrix. All phrases are searched backwards at once, their occurrences are located through
sampled suffix positions, and overlapping ones merge into removal spans.

A phrase (window) is `window` consecutive words of a test item, or all words of a shorter item.
Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case.

A benchmark whose phrases fit in BLOCK_BYTES is broadcast once. A larger one is cut into blocks of at most that size
(only a single item that is larger makes a larger one), and each block is a pass over the texts of its own: it is
broadcast, the word spans and items it finds are written to a table, and it is destroyed before the next one is
read. So driver, executors and workers hold one block at a time, whatever the benchmark's size. The tables
hold rows only for texts that were hit, by a hash of the text; a last pass merges them, equal texts of very many rows
dealt out to several tasks.

Defined cases: null texts and texts without words have no words and no hits; items with a null or
wordless text have no windows; an item whose id is null hits words but isn't listed; rows that repeat
are judged one by one; an empty table on either side gives no hits; a text longer than a shard is a shard of its own and is
indexed whole; other columns are ignored, whatever their names, and a kept column with the name of a result column is
replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import fresh, materialize, salted_join
from ._rows import chunks, map_texts

WINDOW = 10
#: Bytes of phrases that one broadcast holds.
BLOCK_BYTES = 64 << 20
#: Bytes of text in a shard; its index takes some 20 bytes for each word of a kept run.
SHARD_BYTES = 16 << 20
#: Of so many suffix positions one is sampled.
SAMPLE = 8

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_FOLD = bytes(c if c in _KEEP else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_BREAK = b"\x01"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


class WaveletMatrix:
    """Symbols in bit planes with packed rank counts: access and rank in one step a plane."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.planes = []
        top = max(1, int(symbols.max(initial=0)).bit_length())
        for b in range(top - 1, -1, -1):
            bits = (symbols >> b & 1).astype(bool)
            packed = np.packbits(np.concatenate((bits, np.zeros(64 - self.n % 64, bool))), bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            zeros = self.n - int(before[-1])
            self.planes.append((b, packed, before, zeros))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))

    @staticmethod
    def _ones(packed, before, i):
        w = i >> 6
        return before[w] + np.bitwise_count(packed[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        at, node = i.astype(np.int64), np.zeros(len(i), np.int64)
        for b, packed, before, zeros in self.planes:
            one = (symbols >> b & 1).astype(bool)
            up, low = self._ones(packed, before, at), self._ones(packed, before, node)
            at, node = np.where(one, zeros + up, at - up), np.where(one, zeros + low, node - low)
        return at - node

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before."""
        at, node, symbol = i.astype(np.int64), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for b, packed, before, zeros in self.planes:
            one = (packed[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            up, low = self._ones(packed, before, at), self._ones(packed, before, node)
            at, node = np.where(one, zeros + up, at - up), np.where(one, zeros + low, node - low)
            symbol |= one.astype(np.int64) << b
        return symbol, at - node


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Rank of every suffix, where each separator (0) differs from all others: doubling over what is still tied."""
    n = len(symbols)
    ends = symbols == 0
    base = int(ends.sum())
    key = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + base)
    rank = np.empty(n, np.int64)
    tied, old, shift = np.arange(n), np.zeros(n, np.int64), 0
    while tied.size:
        if shift:
            old = rank[tied]
            key = old * (n + 1) + rank[tied + shift]
        order = np.argsort(key, kind="stable")
        tied, key, old = tied[order], key[order], old[order]
        first_old = np.concatenate(([True], old[1:] != old[:-1]))
        heads = np.flatnonzero(first_old)
        place = old + np.arange(len(tied)) - heads[np.cumsum(first_old) - 1]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        groups = np.cumsum(fresh) - 1
        rank[tied] = place[fresh][groups]
        tied = tied[np.diff(np.append(np.flatnonzero(fresh), len(tied)))[groups] > 1]
        shift = max(1, 2 * shift)
    return rank


class FMIndex:
    """Index of symbols in which every run ends in 0; patterns hold no 0."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        n = len(symbols)
        rank = suffix_ranks(symbols)
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        self.bwt = WaveletMatrix(symbols[suffixes - 1])
        size = int(symbols.max()) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size))))
        starts = np.concatenate(([True], symbols[:-1] == 0))  # a walk never leaves its run
        chosen = (suffixes % sample == 0) | starts[suffixes]
        self.chosen = np.concatenate(([0], np.cumsum(chosen)))
        self.sampled = chosen
        self.positions = suffixes[chosen]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of equally long patterns, one a row; empty ranges where there is no occurrence."""
        last = patterns[:, -1]
        known = last < len(self.first) - 1
        last = np.where(known, last, 0)
        low, high = np.where(known, self.first[last], 0), np.where(known, self.first[last + 1], 0)
        live = np.flatnonzero(low < high)
        for j in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[live, j]
            ok = c < len(self.first) - 1
            high[live[~ok]] = low[live[~ok]]
            live, c = live[ok], c[ok]
            both = self.bwt.rank(np.concatenate((c, c)), np.concatenate((low[live], high[live])))
            low[live], high[live] = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to the nearest sampled one."""
        found, open_, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while open_.size:
            done = self.sampled[at]
            found[open_[done]] = self.positions[self.chosen[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            symbol, before = self.bwt.access(at)
            at, steps = self.first[symbol] + before, steps + 1
        return found


class Phrases:
    """Windows of a block of test items over a vocabulary of their own."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str | None] = []
        known: dict[tuple[int, ...], set[int]] = {}
        for name, tokens in items:
            if not tokens:
                continue
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens]
            span = min(window, len(codes))
            for i in range(len(codes) - span + 1):
                known.setdefault(tuple(codes[i : i + span]), set()).add(len(self.ids))
            self.ids.append(name)
        self.by_length: dict[int, tuple[np.ndarray, list[set[int]]]] = {}
        for span in sorted({len(k) for k in known}):
            own = [k for k in known if len(k) == span]
            self.by_length[span] = (np.array(own, np.int64), [known[k] for k in own])
        self.shortest = min(self.by_length, default=0)


def phrase_blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[Phrases]:
    """The benchmark's phrases, in blocks of bounded size, streamed through the driver."""
    held, size = [], 0
    for row in benchmark.select(benchmark[id_col].cast("string"), benchmark[text_col]).toLocalIterator():
        tokens = words(row[1])
        cost = 60 * len(tokens) + 8 * window * len(tokens)
        if held and size + cost > BLOCK_BYTES:
            if any(t for _, t in held):
                yield Phrases(held, window)
            held, size = [], 0
        held.append((row[0], tokens))
        size += cost
    if any(t for _, t in held):
        yield Phrases(held, window)


def _runs(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of known words that can hold a phrase."""
    edge = np.diff(np.concatenate(([0], (codes > 0).astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    return starts[long], (ends - starts)[long]


def _codes(raws: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """Codes of all words, 0 for unknown ones, -1 before each text, a few texts at a time."""
    parts, at = [], 0
    while at < len(raws):
        end, held = at, 0
        while end < len(raws) and (end == at or held + len(raws[end]) <= 2 << 20):
            held += len(raws[end])
            end += 1
        tokens = b" ".join(_BREAK + b" " + r.translate(_FOLD) for r in raws[at:end]).split()
        parts.append(np.fromiter(map(vocabulary.get, tokens, repeat(0)), np.int32, len(tokens)))
        at = end
    return np.concatenate(parts)


def _occurrences(codes: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, list[set[int]], np.ndarray]]]:
    """Word positions and lengths of all occurrences in a shard, and by length which phrases they are."""
    starts, lengths = _runs(codes, phrases.shortest)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    offsets = np.cumsum(lengths + 1) - (lengths + 1)
    symbols = np.zeros(int((lengths + 1).sum()), np.int64)
    source = np.repeat(starts - offsets, lengths + 1) + np.arange(len(symbols))  # word that each symbol stands for
    ends = offsets + lengths
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = codes[source[inside]]
    used, packed = np.unique(symbols, return_inverse=True)  # only symbols that the shard has; 0 stays 0
    index = FMIndex(packed.astype(np.int64))
    at, span, which = [], [], []
    for length, (patterns, owners) in phrases.by_length.items():
        mapped = np.searchsorted(used, patterns)
        missing = (mapped >= len(used)) | (used[np.minimum(mapped, len(used) - 1)] != patterns)
        usable = np.flatnonzero(~missing.any(1))
        if not len(usable):
            continue
        low, high = index.search(mapped[usable])
        n = high - low
        rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        positions = source[index.locate(rows)]
        at.append(positions)
        span.append(np.full(len(positions), length, np.int64))
        which.append((np.repeat(usable, n), owners, positions))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    return np.concatenate(at), np.concatenate(span), which


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    cleaned: bool = False,
) -> DataFrame:
    """The kept columns with n_words, n_hit, items (ids of test items found, sorted as strings) and spans.

    spans are the merged removal spans as [start, end) in characters. With cleaned, a column of the
    text column's name follows in which each span is replaced by a space.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPANS)]
    if cleaned:
        fields.append(T.StructField(text_col, docs.schema[text_col].dataType))
    blocks = phrase_blocks(benchmark, window, item_col, item_text)
    first, second = next(blocks, None), next(blocks, None)
    if second is not None:
        return _mark_in_passes(docs, chain([first, second], blocks), keep, fields, text_col, cleaned)
    shared = docs.sparkSession.sparkContext.broadcast(first or Phrases([], 1))

    def factory():
        def apply(texts: pa.Array) -> dict:
            raws = [r or b"" for r in texts.cast(pa.binary()).to_pylist()]
            return _result(texts, *_find(raws, shared.value), text_col if cleaned else None)

        return apply

    return map_texts(docs, keep, fields, factory, text=text_col, size=SHARD_BYTES)


def _mark_in_passes(docs: DataFrame, blocks: Iterator[Phrases], keep: list[str], fields: list[T.StructField], text_col: str, cleaned: bool) -> DataFrame:
    """mark() where the phrases are more than a block."""
    key, deal, text, hits = (fresh(c, docs) for c in ("text_key", "deal", "text_", "hits"))
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    keyed = docs.select(*keep, docs[text_col].alias(text), F.sha2(docs[text_col], 256).alias(key))
    found = None
    for n, phrases in enumerate(blocks):
        one = _spans_of_block(keyed, phrases, key, text).withColumn("block", F.lit(n))
        found = one if found is None else found.unionByName(one)
    # rows of equal texts found the same, so one row of each text and block is enough
    each = found.groupBy(key, "block").agg(F.first("hit").alias("hit"))
    hit = each.groupBy(key).agg(F.collect_list("hit").alias(hits))
    dealt = keyed.withColumn(deal, F.xxhash64(*keep) if keep else F.lit(0))
    joined = salted_join(dealt, hit, key, deal, "left").select(*keep, text, hits)
    types = {f.name: to_arrow_type(f.dataType) for f in fields}

    def merge(batches):
        import pyarrow.compute  # noqa: F401  used by chunks()

        for part in chunks(batches, text, SHARD_BYTES):
            texts = part.column(text)
            n_words = np.array([len(words(t)) for t in texts.cast(pa.binary()).to_pylist()], np.int64)
            begins = np.cumsum(n_words + 1) - (n_words + 1)
            covered, items = np.zeros(int((n_words + 1).sum()) + 1, np.int64), []
            for begin, own in zip(begins.tolist(), part.column(hits).to_pylist()):
                items.append({i for h in own or () for i in h["items"]})
                for h in own or ():
                    np.add.at(covered, begin + 1 + np.array([s["start"] for s in h["spans"]], np.int64), 1)
                    np.add.at(covered, begin + 1 + np.array([s["end"] for s in h["spans"]], np.int64), -1)
            made = _result(texts, begins, n_words, covered, items, text_col if cleaned else None)
            columns = [v if isinstance(v := made[f.name], pa.Array) else pa.array(v, types[f.name]) for f in fields]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], names=[*keep, *(f.name for f in fields)])

    return joined.mapInArrow(merge, T.StructType([*(docs.schema[c] for c in keep), *fields]))


def _spans_of_block(keyed: DataFrame, phrases: Phrases, key: str, text: str) -> DataFrame:
    """(key, hit) of each row whose text a block's phrases hit: word spans and items. The block is destroyed once these are written."""
    shared = keyed.sparkSession.sparkContext.broadcast(phrases)
    hit = T.StructType([T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])

    def factory():
        def apply(texts: pa.Array) -> dict:
            begins, n_words, covered, items = _find([r or b"" for r in texts.cast(pa.binary()).to_pylist()], shared.value)
            flags = np.cumsum(covered)[:-1] > 0
            return {"hit": [{"spans": s, "items": sorted(i for i in own if i is not None)} if (s := _stretches(flags, b, n)) else None for b, n, own in zip(begins.tolist(), n_words.tolist(), items)]}

        return apply

    try:
        return materialize(map_texts(keyed, [key], [T.StructField("hit", hit)], factory, text=text, size=SHARD_BYTES).where("hit is not null"), "hits")
    finally:
        shared.destroy()


def _stretches(flags: np.ndarray, begin: int, n_words: int) -> list[dict]:
    """[start, end) in words of the stretches that are hit in the text that begins there."""
    edge = np.diff(np.concatenate(([0], flags[begin + 1 : begin + 1 + n_words].astype(np.int8), [0])))
    return [{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]


def _find(raws: list[bytes], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set]]:
    """Where each text of a shard begins, its words, how many more occurrences cover each word than the one before, and the items of each text."""
    codes = _codes(raws, {_BREAK: -1} | phrases.vocabulary)
    begins = np.flatnonzero(codes == -1)
    covered, items = np.zeros(len(codes) + 1, np.int64), [set() for _ in raws]
    if phrases.by_length:
        at, span, which = _occurrences(codes, phrases)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + span, -1)
        for kinds, owners, positions in which:
            whose = np.searchsorted(begins, positions, side="right") - 1
            for pair in np.unique(whose * np.int64(len(owners)) + kinds).tolist():
                items[pair // len(owners)].update(phrases.ids[k] for k in owners[pair % len(owners)])
    return begins, np.diff(np.append(begins, len(codes))) - 1, covered, items


def _result(texts: pa.Array, begins: np.ndarray, n_words: np.ndarray, covered: np.ndarray, items: list[set], cleaned: str | None) -> dict:
    hit = np.cumsum(covered)[:-1] > 0
    n_hit = np.add.reduceat(hit.astype(np.int64), begins) if len(begins) else np.zeros(0, np.int64)
    spans: list[list[dict]] = [[] for _ in items]
    values = texts.to_pylist() if cleaned else None
    for d in np.flatnonzero(n_hit).tolist():
        text = texts[d].as_py()
        places = [m.span() for m in WORD.finditer(text)]
        spans[d] = [{"start": places[s["start"]][0], "end": places[s["end"] - 1][1]} for s in _stretches(hit, begins[d], n_words[d])]
        if cleaned:
            kept, last = [], 0
            for s in spans[d]:
                kept.append(text[last : s["start"]])
                last = s["end"]
            values[d] = " ".join([*kept, text[last:]])
    made = {"n_words": n_words, "n_hit": n_hit, "items": [sorted(i for i in s if i is not None) for s in items], "spans": spans}
    return made | ({cleaned: values} if cleaned else {})
