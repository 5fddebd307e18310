"""Ranked lexical search by Block-Max WAND over compressed posting blocks.

Terms are runs of letters and digits of ASCII and of all other characters beyond ASCII; A-Z is lower-cased.

Index. A task reads whole texts, a segment of about SEGMENT_BYTES at a time, and writes a row for each term of the
segment: its postings in blocks of BLOCK, each of variable-length gaps and counts that can be read without the others,
and for each block its first and last document and its competitive impacts. These are the pairs (count, length of the
document) that no other posting of the block beats in both; whatever the statistics of the corpus, the largest impact
of the block is the largest of these pairs. So the index is written in one pass, before the statistics are
known. A row without a term holds the segment's documents, in order of id, and their lengths.

Search. Frequencies of the asked terms are summed over segments. Then every segment answers every item: the blocks'
first and last documents of all of an item's lists cut the segment into windows, in each of which every list has one
block or none. One shallow move of all pointers gives each window's bound, the sum of its blocks' largest weighted
impacts, and nothing is decompressed for it. Windows are visited by falling bound, a few first and then more, until the bound is
below the score of the k-th best document found: the blocks below are never decompressed. Blocks that are, are kept for
the segment's other items. The segments' best are ranked once more; tasks keep only k for each item.

Bounds: a segment is bounded, but for a single longer text, whose words are counted a slice at a time; items are read in
blocks of some BLOCK_TERMS terms, with a job for each block, which the driver holds and broadcasts. A segment's group
holds its own postings only, however frequent a term is in the corpus.

Defined cases: a null or empty text, and one without terms, takes no part in N or L and is never found; a term
that an item repeats counts once; rows that repeat an item id are one item with the terms of all; a null item id is an
item too; an item without known terms has no rows. Rows that repeat a document id are documents of their own; a null id
comes last among equal scores. Terms of more than TERM_BYTES bytes are compared by SHA-256. An empty table gives an empty
result. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, ship, spread
from ._rows import bounded_batches

#: Postings of a block.
BLOCK = 128
#: Bytes of text and documents of a segment, at most, but for a single longer text.
SEGMENT_BYTES, SEGMENT_DOCS = 16 << 20, 1 << 16
#: Bytes of text that are split into words at once, and words that are counted at once.
SLICE_BYTES, SLICE_WORDS = 4 << 20, 1 << 19
#: Pairs of item and term that are searched in one job.
BLOCK_TERMS = 100_000
#: Longer terms go by their hash.
TERM_BYTES = 64

_BLANK = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else _BLANK[c] for c in range(256))
INDEX = "segment string, term string, n long, words long, first binary, last binary, ends binary, counts binary, impacts binary, data binary"


def slices(text: bytes):
    """The words of a text, a bounded number of bytes at a time (a longer word is a slice of its own)."""
    if len(text) <= SLICE_BYTES:
        yield text.translate(_TABLE).split()
        return
    at = 0
    while at < len(text):
        end = at + SLICE_BYTES
        part = text[at:end].translate(_TABLE)
        cut = len(part) if end >= len(text) else part.rfind(b" ") + 1
        while not cut:  # one word and no end yet
            more = text[end : end + SLICE_BYTES].translate(_TABLE)
            part, end = part + more, end + len(more)
            cut = len(part) if end >= len(text) else part.find(b" ", len(part) - len(more)) + 1
        yield part[:cut].split()
        at += cut


def key(word: bytes) -> bytes:
    """How the index names a term; no term has a # of its own."""
    return word if len(word) <= TERM_BYTES else b"#" + hashlib.sha256(word).hexdigest().encode()


class _Words(dict):
    """Numbers of words, given as they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of 7 bits a byte, the top bit set where more follow, and where each value ends."""
    v = values.astype(np.uint64)
    length = np.ones(len(v), np.int64)
    for bits in (7, 14, 21, 28, 35):
        length += v >= np.uint64(1 << bits)
    ends = np.cumsum(length)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    starts = ends - length
    for i in range(int(length.max(initial=0))):
        has = length > i
        out[starts[has] + i] = ((v[has] >> np.uint64(7 * i)) & np.uint64(127)).astype(np.uint8) | ((length[has] > i + 1).astype(np.uint8) << 7)
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    """The values that pack() made."""
    if not len(data) or data.max() < 128:
        return data.astype(np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    shift = (np.arange(len(data)) - np.repeat(starts, ends - starts + 1)) * 7
    return np.add.reduceat((data & 127).astype(np.int64) << shift, starts)


def competitive(block: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions of the pairs (tf, n) that no other pair of their block beats with a tf as large and a smaller n."""
    order = np.lexsort((n, -tf, block))
    least = n[order] - (block[order] << 33)  # a block's are below all of the block before, so the minimum starts anew
    seen = np.minimum.accumulate(least)
    return order[np.concatenate(([True], least[1:] < seen[:-1]))] if len(order) else order


class Segment:
    """Texts as they come, and their posting blocks."""

    def __init__(self, name: str):
        self.name, self.size = name, 0
        self.words = _Words()
        self.ids: list = []
        self.lengths: list[int] = []
        self.waiting: list[bytes] = []
        self.owners: list[tuple[int, int]] = []
        self.counted: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc_id, text: bytes) -> None:
        total = 0
        for found in slices(text):
            total += len(found)
            self.waiting += found
            self.owners.append((len(self.ids), len(found)))
            if len(self.waiting) >= SLICE_WORDS:
                self._count()
        self.size += len(text)
        if total:
            self.ids.append(doc_id)
            self.lengths.append(total)
        elif self.owners and self.owners[-1][1] == 0:
            self.owners.pop()

    def _count(self) -> None:
        if not self.waiting:
            return
        words = np.fromiter(map(self.words.__getitem__, self.waiting), np.int64, len(self.waiting))
        docs, times = np.array(self.owners, np.int64).reshape(-1, 2).T
        self.counted.append(np.unique((words << 32) | np.repeat(docs, times), return_counts=True))
        self.waiting, self.owners = [], []

    def rows(self) -> pa.Table | None:
        """The segment's rows of the index; None without documents."""
        self._count()
        if not self.ids:
            return None
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)[order]
        keys, counts = (np.concatenate(x) for x in zip(*self.counted, strict=True))
        keys = (keys >> 32 << 32) | place[keys & 0xFFFFFFFF]
        at = np.argsort(keys, kind="stable")
        keys, counts = keys[at], counts[at]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))  # a long text's slices are added up
        keys, tf = keys[first], np.add.reduceat(counts, first)
        term, doc = keys >> 32, keys & 0xFFFFFFFF
        n_terms = len(self.words)
        size = np.bincount(term, minlength=n_terms)
        begin = np.cumsum(size) - size
        inside = np.arange(len(term)) - begin[term]
        blocks = -(-size // BLOCK)
        first_block = np.cumsum(blocks) - blocks
        block = first_block[term] + inside // BLOCK
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        sizes = np.diff(np.append(starts, len(block)))
        gap = np.where(inside == 0, doc + 1, doc - np.concatenate(([0], doc[:-1])))
        values = np.empty(2 * len(term), np.int64)
        where = starts[block] + np.arange(len(term))  # a block's gaps, then its counts
        values[where], values[where + sizes[block]] = gap, tf
        data, ends = pack(values)
        block_end = ends[2 * (starts + sizes) - 1]
        term_end = block_end[first_block + blocks - 1]
        term_start = np.concatenate(([0], term_end[:-1]))
        best = competitive(block, tf, lengths[doc])
        pairs = np.stack((tf[best], lengths[doc[best]]), 1).astype(np.uint32)
        per_block = np.bincount(block[best], minlength=len(starts))
        per_term = np.add.reduceat(per_block, first_block)
        names = [key(w) for w in self.words]
        docs = (np.array([i or 0 for i in self.ids], np.int64)[order], np.array([i is None for i in self.ids], np.uint8)[order])
        head = pa.table(
            [
                pa.array([self.name]), pa.array([None], pa.string()), pa.array([len(order)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()),
                pa.array([b""], pa.binary()), pa.array([lengths.tobytes()], pa.binary()), pa.array([docs[1].tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()),
                pa.array([docs[0].tobytes()], pa.binary()),
            ],
            names=_NAMES,
        )
        body = pa.table(
            [
                pa.array([self.name] * n_terms), pa.array(names, pa.binary()).cast(pa.string()), pa.array(size, pa.int64()), pa.nulls(n_terms, pa.int64()),
                _parts(doc[starts].astype(np.uint32), blocks), _parts(doc[starts + sizes - 1].astype(np.uint32), blocks),
                _parts((block_end - np.repeat(term_start, blocks)).astype(np.uint32), blocks),
                _parts(per_block.astype(np.uint8), blocks), _parts(pairs, per_term), _parts(data, term_end - term_start),
            ],
            names=_NAMES,
        )
        return pa.concat_tables([head, body])


_NAMES = [f.split()[0] for f in INDEX.split(", ")]


def _parts(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow array of pieces of values, so many each, as bytes."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = np.concatenate(([0], np.cumsum(counts) * width)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _indexed(batches):
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    segment = Segment(f"{task}-0")
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        for i, doc_id in enumerate(ids):
            text = texts[i].as_py() or b""
            if segment.ids and (segment.size + len(text) > SEGMENT_BYTES or len(segment.ids) >= SEGMENT_DOCS):
                yield from _batches(segment)
                number += 1
                segment = Segment(f"{task}-{number}")
            segment.add(doc_id, text)
    yield from _batches(segment)


def _batches(segment: Segment):
    rows = segment.rows()
    return rows.combine_chunks().to_batches(max_chunksize=20_000) if rows else ()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs, whose ids are integers, as a scratch table; see the module's text."""
    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    texts = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return materialize(texts.mapInArrow(_indexed, INDEX), "blocks")


def _terms(batches):
    for batch in batches:
        kept, found = [], []
        for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            own = {key(w) for words in slices(text or b"") for w in words}
            kept += [i] * len(own)
            found += own
        item = batch.column(0).take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([item, pa.array(found, pa.binary()).cast(pa.string())], names=["item", "term"])


class Postings:
    """A term's posting blocks in a segment, decompressed block by block when they are first asked for."""

    def __init__(self, row: dict, norms: np.ndarray, stats: tuple[int, int]):
        self.norms = norms
        self.first, self.last = (np.frombuffer(row[c], np.uint32).astype(np.int64) for c in ("first", "last"))
        self.begins = np.append(self.first, np.iinfo(np.int64).max)  # there is none behind the last block
        self.before = np.concatenate(([-1], self.last[:-1]))
        self.ends = np.concatenate(([0], np.frombuffer(row["ends"], np.uint32).astype(np.int64)))
        self.data = np.frombuffer(row["data"], np.uint8)
        tf, n = np.frombuffer(row["impacts"], np.uint32).reshape(-1, 2).T.astype(np.int64)
        counts = np.frombuffer(row["counts"], np.uint8).astype(np.int64)
        self.most = np.maximum.reduceat(impact(tf, norm(n, stats)), np.cumsum(counts) - counts)
        self.bounds = np.append(self.most, 0)
        self.sizes = np.full(len(self.last), BLOCK, np.int64)
        self.sizes[-1] = row["n"] - BLOCK * (len(self.last) - 1)
        self.have = np.zeros(len(self.last), bool)
        self.docs = np.empty(row["n"], np.int64)
        self.impacts = np.empty(row["n"], np.int64)

    def read(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the wanted blocks (a truth value for each)."""
        if (missing := np.flatnonzero(wanted & ~self.have)).size:
            for run in np.split(missing, np.flatnonzero(np.diff(missing) > 1) + 1):
                self._decode(run[0], run[-1] + 1)
        if wanted.all():
            return self.docs, self.impacts
        part = np.repeat(wanted, self.sizes)
        return self.docs[part], self.impacts[part]

    def _decode(self, first: int, end: int) -> None:
        values = unpack(self.data[self.ends[first] : self.ends[end]])
        full = end - first - (self.sizes[end - 1] < BLOCK)
        pieces = [(values[: full * 2 * BLOCK].reshape(full, 2 * BLOCK), BLOCK, first)] if full else []
        if full < end - first:
            pieces.append((values[full * 2 * BLOCK :].reshape(1, -1), int(self.sizes[end - 1]), end - 1))
        for part, size, block in pieces:
            docs = (np.cumsum(part[:, :size], axis=1) + self.before[block : block + len(part), None]).ravel()
            at = block * BLOCK
            self.docs[at : at + len(docs)] = docs
            self.impacts[at : at + len(docs)] = impact(part[:, size:].ravel(), self.norms[docs])
        self.have[first:end] = True


def norm(n: np.ndarray, stats: tuple[int, int]) -> np.ndarray:
    """What a document of n terms divides by, among so many documents with so many terms together."""
    docs, words = stats
    if 90 * docs * int(n.max(initial=0)) >= 1 << 63:
        return np.array([10 + 90 * int(x) * docs // words for x in n], np.int64)
    return 10 + 90 * n * docs // words


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def best(lists: list[tuple[int, Postings]], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k documents of highest score above 0 of a segment of so many documents, and their scores; ties by place."""
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not lists:
        return docs, scores
    cuts = np.unique(np.concatenate([x for _, p in lists for x in (p.last, p.first - 1)]))
    cuts = cuts[cuts >= 0]
    bound = np.zeros(len(cuts), np.int64)
    for w, p in lists:  # the shallow move: each list's block in each window
        block = np.searchsorted(p.last, cuts)
        bound += w * np.where(p.begins[block] <= cuts, p.bounds[block], 0)
    order = np.argsort(-bound, kind="stable")
    begins = np.concatenate(([0], cuts[:-1] + 1))
    total = np.zeros(size, np.int64)
    at, step, least = 0, 8, 1
    while at < len(order) and bound[order[at]] >= least:
        window = order[at : at + step]
        window = window[bound[window] >= least]
        edges = np.zeros(size + 1, np.int8)
        edges[begins[window]] += 1
        edges[cuts[window] + 1] -= 1
        inside = np.cumsum(edges[:-1]).astype(bool)
        so_far = np.concatenate(([0], np.cumsum(inside)))
        for w, p in lists:
            wanted = so_far[p.last + 1] > so_far[p.first]
            if wanted.any():
                found, value = p.read(wanted)
                total[found] += w * value
        found = np.flatnonzero(inside & (total >= least))
        docs, scores = np.concatenate((docs, found)), np.concatenate((scores, total[found]))
        keep = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[keep], scores[keep]
        if len(docs) == k:
            least = int(scores[-1])  # an equal score may still go with a smaller place
        total[:] = 0
        at, step = at + step, step * 4
    return docs, scores


def _answers(shared, stats: tuple[int, int], k: int, item_type: pa.DataType):
    """Every item's best documents of a segment."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["term"] is None)
        norms = norm(np.frombuffer(head["last"], np.int64), stats)
        ids, missing = np.frombuffer(head["data"], np.int64), np.frombuffer(head["ends"], np.uint8).astype(bool)
        lists = {r["term"]: Postings(r, norms, stats) for r in rows if r["term"] is not None}
        items, docs, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for item, terms in shared.value:
            found, score = best([(w, lists[t]) for t, w in terms if w and t in lists], len(ids), k)
            items += [item] * len(found)
            docs.append(found)
            scores.append(score)
        found = np.concatenate(docs)
        return pa.table({"item": pa.array(items, item_type), "doc": pa.array(ids[found], pa.int64(), mask=missing[found]), "score": pa.array(np.concatenate(scores), pa.int64())})

    return run


def search(index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, rank, doc_id, score) of each item's k best documents of an index."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = index.sparkSession
    ship(spark)
    item = items.schema[item_col]
    asked = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    pairs = T.StructType([T.StructField("item", item.dataType), T.StructField("term", T.StringType())])
    terms = materialize(spread(asked).mapInArrow(_terms, pairs).distinct(), "terms")
    heads = index.where(F.col("term").isNull())
    n_docs, n_words, n_pairs = *heads.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first(), terms.count()
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1)))
    known = index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weighed = materialize(terms.join(known.select("term", weight.alias("w")), "term"), "weighed")
    blocks = max(1, -(-n_pairs // BLOCK_TERMS))
    schema = T.StructType([T.StructField("item", item.dataType), T.StructField("doc", T.LongType()), T.StructField("score", T.LongType())])
    parts = []
    for b in range(blocks):
        block = weighed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast([(r["item"], list(zip(r["terms"], r["weights"], strict=True))) for r in _listed(block)])
        if not shared.value:
            continue
        own = index.join(F.broadcast(block.select("term").distinct()), "term", "left_semi").select(*_NAMES)
        answers = own.unionByName(heads).groupBy("segment").applyInArrow(_answers(shared, (n_docs, n_words), k, to_arrow_type(item.dataType)), schema)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
        ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        parts.append(materialize(ranked, "ranked"))
    out = parts[0] if parts else spark.createDataFrame([], T.StructType([*schema, T.StructField("rank", T.IntegerType())]))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("item").alias(item_col), "rank", F.col("doc").alias("doc_id"), "score")


def _listed(block: DataFrame):
    """A row (item, terms, weights) for each item of a block of bounded size."""
    pair = F.array_sort(F.collect_list(F.struct("term", "w")))
    return block.groupBy("item").agg(pair.alias("p")).select("item", F.col("p.term").alias("terms"), F.col("p.w").alias("weights")).toLocalIterator()


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Index docs and answer items: (item, rank, doc_id, score)."""
    return search(build_index(docs, id_col, text_col), items, k, item_col, item_text_col)
