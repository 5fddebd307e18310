"""Substring dedup by relative Lempel-Ziv parsing on words.

The reference of a document is everything in documents with smaller ids. A factor is a stretch of at least
WINDOW words that is copied from one place of the reference: (start, length, ref_id, ref_start). Removed are the
words of all factors.

1. A task takes its documents in blocks. A block is indexed by its windows of WINDOW words, and each of its
   documents is parsed against it on the spot. What remains is, for each window, where it is first met.
2. These are sent to where the other blocks' windows of the same anchor are: the anchor of a window is
   its smallest hash of ANCHOR words, so neighbouring windows mostly travel together as one segment. Blocks
   that have a passage in common send it once each, however many of their documents hold it; a task remembers what
   its blocks repeat, and sends that once.
3. There the blocks' indexes are one, and every segment is parsed against all of them: a window is matched
   with its first place in the corpus, and matches that continue each other are one factor. Windows across
   the boundary of two factors are looked up like all others, so none is missed.
4. A document's factors from all anchors are gathered, joined where they continue each other, and its text
   is read once more to remove the words.

A window counts as found if its anchor's 64 bits and 48 further bits of its own hash agree.

Defined cases: words are split at ASCII white space and otherwise left as they are; a null text or one
of fewer than WINDOW words has no windows; a null id has no smaller or larger ones, so its row is left
whole and isn't part of the reference; rows with equal ids don't take words from each other, and equal rows
are cut alike; texts of any length are indexed and cut whole; an empty table gives an empty result; other columns
don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import fresh, ship, spread, stored_bytes
from ._rows import bounded_batches
from ._words import WordHasher, mix, windows

WINDOW, ANCHOR = 13, 4
#: Text of a reference block that a task indexes at once.
BLOCK_BYTES = 3 << 20
#: Input bytes, as stored, of a group of anchors.
GROUP_BYTES = 1 << 20
#: Windows of repeated passages that a task remembers, some 20 bytes each.
MAX_PASSAGES = 1 << 19

FACTOR = np.dtype([("start", "<i4"), ("length", "<i4"), ("ref_id", "<i8"), ("ref_start", "<i4")])


def _anchors(grams: np.ndarray, n: int) -> np.ndarray:
    """For each of n windows the position of its smallest gram, the first of equal ones."""
    width = WINDOW - ANCHOR + 1
    best, at = grams[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, width):
        x = grams[j : j + n]
        less = x < best
        best[less] = x[less]
        at[less] = j
    return np.arange(n) + at


class Block:
    """Windows of the documents of a block, documents in order of their ids."""

    def __init__(self, ids: np.ndarray, raws: list[bytes | None], hasher: WordHasher):
        order = np.argsort(ids, kind="stable")
        self.ids, self.order = ids[order], order
        words: list[bytes] = []
        ends = []
        for i in order:
            if raws[i]:
                words += raws[i].split()
            ends.append(len(words))
        hashes = hasher(words)
        ends = np.array(ends, np.int64)
        begins = np.concatenate(([0], ends[:-1]))
        n = max(0, len(hashes) - WINDOW + 1)
        count = np.maximum(0, ends - begins - WINDOW + 1)
        doc = np.repeat(np.arange(len(ids)), count)
        at = np.repeat(begins - (np.cumsum(count) - count), count) + np.arange(count.sum())
        self.doc, self.start = doc, (at - begins[doc]).astype(np.int32)
        self.hash = windows(hashes, WINDOW)[at]
        grams = windows(hashes, ANCHOR)
        where = _anchors(grams, n)[at] if n else np.zeros(0, np.int64)
        self.anchor, self.anchor_at = grams[where], where
        self.at = at


def runs(breaks: np.ndarray) -> np.ndarray:
    """Where runs begin, given for each element but the first whether it begins one."""
    return np.flatnonzero(np.concatenate(([True], breaks))) if len(breaks) + 1 else np.zeros(0, np.int64)


def first_places(keys: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each window the index of the first one with its key, by (id, start)."""
    order = np.lexsort((starts, ids, keys))
    same = np.concatenate(([False], keys[order][1:] == keys[order][:-1])) if len(keys) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(keys)))) if len(keys) else np.zeros(0, np.int64)
    first = np.empty(len(keys), np.int64)
    first[order] = order[head]
    return first


def parse(rows: np.ndarray, doc: np.ndarray, start: np.ndarray, ref_id: np.ndarray, ref_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors of matched windows (given in order): their documents and FACTOR records."""
    doc, start, ref_id, ref_start = doc[rows], start[rows], ref_id[rows], ref_start[rows]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, FACTOR)
    breaks = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (ref_id[1:] != ref_id[:-1]) | (ref_start[1:] != ref_start[:-1] + 1)
    at = runs(breaks)
    found = np.zeros(len(at), FACTOR)
    found["start"], found["ref_id"], found["ref_start"] = start[at], ref_id[at], ref_start[at]
    found["length"] = np.diff(np.append(at, len(rows))) + WINDOW - 1
    return doc[at], found


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(a.tobytes() for a in arrays), 1)


def _unpack(raw: bytes) -> bytes:
    return zlib.decompress(raw)


def _by_document(ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, found: np.ndarray):
    """(id, tag, factors) of each document that has any; doc is in runs."""
    if not len(doc):
        return [], [], []
    order = np.argsort(doc, kind="stable")
    doc, found = doc[order], found[order]
    at = runs(doc[1:] != doc[:-1])
    ends = np.append(at[1:], len(doc))
    return ids[doc[at]].tolist(), tags[doc[at]].tolist(), [found[a:b].tobytes() for a, b in zip(at, ends)]


def _rows_of(group: list[int], body: list[bytes | None], ids: list, tags: list, factors: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(group, pa.int32()), pa.array(body, pa.binary()), pa.array(ids, pa.int64()), pa.array(tags, pa.int32()), pa.array(factors, pa.binary())],
        names=["group", "body", "id", "tag", "factors"],
    )


class Passages:
    """Windows that several documents of a task's blocks hold, with the first place seen: a passage that every block
    holds is sent once a task rather than once a block. What is forgotten is only sent again."""

    def __init__(self):
        self.keys, self.ids, self.starts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def earlier(self, keys: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places given, or those remembered where their ids are smaller."""
        if not len(self.keys):
            return ids, starts
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        smaller = (self.keys[at] == keys) & (self.ids[at] < ids)
        return np.where(smaller, self.ids[at], ids), np.where(smaller, self.starts[at], starts)

    def learn(self, keys: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        if len(self.keys) + len(keys) > MAX_PASSAGES:
            self.__init__()
        keys, ids, starts = np.append(self.keys, keys), np.append(self.ids, ids), np.append(self.starts, starts)
        order = np.lexsort((starts, ids, keys))
        order = order[np.concatenate(([True], keys[order][1:] != keys[order][:-1]))] if len(order) else order
        self.keys, self.ids, self.starts = keys[order][:MAX_PASSAGES], ids[order][:MAX_PASSAGES], starts[order][:MAX_PASSAGES]


def _index_block(ids: np.ndarray, tags: np.ndarray, raws: list, hasher: WordHasher, groups: int, passages: Passages):
    """Factors that a block finds in itself and in remembered passages, and its other windows as packed segments by group."""
    b = Block(ids, raws, hasher)
    tags = tags[b.order]
    if not len(b.hash):
        return
    window_ids = b.ids[b.doc]
    first = first_places(b.hash, window_ids, b.start)
    ref_ids, ref_starts = passages.earlier(b.hash, window_ids[first], b.start[first])
    known = ref_ids < window_ids
    rows = np.flatnonzero(known)
    doc, found = parse(rows, b.doc, b.start, ref_ids, ref_starts)
    repeated = np.flatnonzero(np.bincount(first, minlength=len(first)) > 1)
    passages.learn(b.hash[repeated], ref_ids[repeated], ref_starts[repeated])
    own_ids, own_tags, factors = _by_document(b.ids, tags, doc, found)
    if own_ids:
        n = len(own_ids)
        spread = (mix(np.array(own_ids, np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64).tolist()
        yield _rows_of(spread, [None] * n, own_ids, own_tags, factors)

    sent = np.flatnonzero(~known)
    if not len(sent):
        return
    breaks = (b.at[sent][1:] != b.at[sent][:-1] + 1) | (b.anchor_at[sent][1:] != b.anchor_at[sent][:-1]) | (b.doc[sent][1:] != b.doc[sent][:-1])
    at = runs(breaks)
    size = np.diff(np.append(at, len(sent))).astype(np.uint8)
    head = sent[at]
    group = (b.anchor[head] % np.uint64(groups)).astype(np.int32)
    order = np.argsort(group, kind="stable")
    cuts = runs(group[order][1:] != group[order][:-1])
    low = b.hash[sent].view(np.uint8).reshape(-1, 8)[:, :6]
    made_group, made = [], []
    for a, z in zip(cuts, np.append(cuts[1:], len(order))):
        own = order[a:z]
        n = size[own].astype(np.int64)
        rows = np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        docs, code = np.unique(b.doc[head[own]], return_inverse=True)
        header = np.array([len(own), len(docs), len(rows)], np.int64).tobytes()
        small = _pack(b.ids[docs], tags[docs], code.astype(np.uint32), b.start[head[own]], size[own])
        made_group.append(int(group[own[0]]))
        made.append(header + len(small).to_bytes(8, "little") + small + b.anchor[head[own]].tobytes() + np.ascontiguousarray(low[rows]).tobytes())
    n = len(made)
    yield _rows_of(made_group, made, [None] * n, [None] * n, [None] * n)


def _read(body: bytes) -> tuple[np.ndarray, ...]:
    """Ids, tags, and for each window document, start, anchor and hash."""
    n, n_docs, n_windows, packed = np.frombuffer(body, np.int64, 4)
    small = _unpack(body[32 : 32 + packed])
    cut = np.cumsum([8 * n_docs, 4 * n_docs, 4 * n, 4 * n])
    ids, tags = np.frombuffer(small[: cut[0]], np.int64), np.frombuffer(small[cut[0] : cut[1]], np.int32)
    code, start, size = np.frombuffer(small[cut[1] : cut[2]], np.uint32), np.frombuffer(small[cut[2] : cut[3]], np.int32), np.frombuffer(small[cut[3] :], np.uint8)
    anchor = np.frombuffer(body, np.uint64, n, 32 + packed)
    low = np.frombuffer(body, np.uint8, 6 * n_windows, 32 + packed + 8 * n).reshape(-1, 6)
    hashes = np.zeros((n_windows, 8), np.uint8)
    hashes[:, :6] = low
    size = size.astype(np.int64)
    step = np.arange(n_windows) - np.repeat(np.cumsum(size) - size, size)
    return ids, tags, np.repeat(code.astype(np.int64), size), np.repeat(start, size) + step.astype(np.int32), np.repeat(anchor, size), hashes.reshape(-1).view(np.uint64)


def _parse_group(table: pa.Table) -> pa.Table:
    """Parse the segments of a group of anchors against all blocks' windows there."""
    done = table.filter(pa.compute.is_valid(table["factors"])).select(["id", "tag", "factors"])
    bodies = [_read(b) for b in table["body"].drop_null().to_pylist()]
    schema = pa.schema([("id", pa.int64()), ("tag", pa.int32()), ("factors", pa.binary())])
    if not bodies:
        return done.cast(schema)
    ids, tags = np.concatenate([b[0] for b in bodies]), np.concatenate([b[1] for b in bodies])
    shift = np.cumsum([0, *(len(b[0]) for b in bodies[:-1])])
    doc = np.concatenate([b[2] + s for b, s in zip(bodies, shift)])
    start, anchor, low = (np.concatenate([b[i] for b in bodies]) for i in (3, 4, 5))
    del bodies
    window_ids = ids[doc]
    # both parts of the key are compared; the order of keys doesn't matter
    key_order = np.lexsort((start, window_ids, low, anchor))
    same = np.zeros(len(doc), bool)
    same[1:] = (low[key_order][1:] == low[key_order][:-1]) & (anchor[key_order][1:] == anchor[key_order][:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
    first = np.empty(len(doc), np.int64)
    first[key_order] = key_order[head]
    rows = np.flatnonzero(window_ids[first] < window_ids)
    found_doc, found = parse(rows, doc, start, window_ids[first], start[first])
    made = _by_document(ids, tags, found_doc, found)
    return pa.concat_tables([done.cast(schema), pa.table([pa.array(m, t) for m, t in zip(made, schema.types)], schema=schema)])


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, factors) of every document that has any; tag is the hash of its text, factors a list of packed FACTOR records."""
    spark = docs.sparkSession
    ship(spark)
    bounded_batches(spark)
    size = stored_bytes(docs.select(id_col, text_col))
    if size is None:  # the optimizer can't tell for more than a scan, so texts are measured
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(4, size // GROUP_BYTES)

    def index(batches):
        hasher, passages = WordHasher(), Passages()
        ids, tags, raws, held = [], [], [], 0
        for b in batches:
            for i, t, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                ids.append(i)
                tags.append(t)
                raws.append(r)
                held += len(r)
                if held >= BLOCK_BYTES:
                    yield from _index_block(np.array(ids, np.int64), np.array(tags, np.int32), raws, hasher, groups, passages)
                    ids, tags, raws, held = [], [], [], 0
        if ids:
            yield from _index_block(np.array(ids, np.int64), np.array(tags, np.int32), raws, hasher, groups, passages)

    def parse_group(table):
        import pyarrow.compute  # noqa: F401

        return _parse_group(table)

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.hash(text_col).alias("tag"), F.col(text_col).alias("text"))
    sent = spread(rows).mapInArrow(index, "group int, body binary, id long, tag int, factors binary")
    parsed = sent.groupBy("group").applyInArrow(parse_group, "id long, tag int, factors binary")
    return parsed.groupBy("id", "tag").agg(F.collect_list("factors").alias("factors"))


def join_factors(packed: list[bytes] | None) -> np.ndarray:
    """All factors of a document by start; those that continue each other are one."""
    if not packed:
        return np.zeros(0, FACTOR)
    found = np.unique(np.frombuffer(b"".join(packed), FACTOR))
    offset = found["ref_start"].astype(np.int64) - found["start"]
    order = np.lexsort((found["start"], offset, found["ref_id"]))
    found, offset = found[order], offset[order]
    end = found["start"] + found["length"]
    reach = end.copy()
    new = np.ones(len(found), bool)
    for i in range(1, len(found)):
        if found["ref_id"][i] == found["ref_id"][i - 1] and offset[i] == offset[i - 1] and found["start"][i] <= reach[i - 1]:
            new[i], reach[i] = False, max(reach[i], reach[i - 1])
    at = np.flatnonzero(new)
    joined = found[at]
    joined["length"] = reach[np.append(at[1:], len(found)) - 1] - joined["start"]
    return joined[np.argsort(joined["start"], kind="stable")]


def covered(packed: list[bytes] | None, n_words: int) -> np.ndarray:
    """Which words lie in a factor."""
    flags = np.zeros(n_words + 1, np.int64)
    if packed:
        found = np.frombuffer(b"".join(packed), FACTOR)
        np.add.at(flags, found["start"], 1)
        np.add.at(flags, found["start"] + found["length"], -1)
    return np.cumsum(flags)[:-1] > 0


def remove_duplicates(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", texts: bool = True, details: bool = False) -> DataFrame:
    """The kept columns with n_words, n_removed and kept_sha256; with texts, the text column holds the kept words
    joined by spaces; with details, factors lists the parse: struct(start, length, ref_id, ref_start)."""
    own = sorted({id_col, text_col, *keep})
    source = docs.select(*own)
    hashed, there, tag, packed_col, whole = (fresh(c, source) for c in ("hash", "id_there", "tag", "packed", "whole"))
    found = factors(docs, id_col, text_col).select(F.col("id").alias(there), F.col("tag").alias(tag), F.col("factors").alias(packed_col))
    source = source.withColumn(hashed, F.hash(text_col))
    joined = source.join(found, (source[id_col] == found[there]) & (source[hashed] == found[tag]), "left")
    parts = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("ref_id", T.LongType()), T.StructField("ref_start", T.IntegerType())]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if texts:
        fields.append(docs.schema[text_col])
    if details:
        fields.append(T.StructField("factors", parts))
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    schema = T.StructType([*(docs.schema[c] for c in keep), *fields])

    def cut(batches):
        for b in batches:
            made: dict[str, list] = {f.name: [] for f in fields}
            for raw, packed in zip(b.column(len(keep)).cast(pa.binary()).to_pylist(), b.column(len(keep) + 1).to_pylist()):
                words = (raw or b"").split()
                if packed:
                    gone = covered(packed, len(words))
                    kept = [words[i] for i in np.flatnonzero(~gone)]
                else:
                    kept = words
                body = b" ".join(kept)
                made["n_words"].append(len(words))
                made["n_removed"].append(len(words) - len(kept))
                made["kept_sha256"].append(hashlib.sha256(body).hexdigest())
                if texts:
                    made[text_col].append(None if raw is None else body.decode())
                if details:
                    made["factors"].append([dict(zip(FACTOR.names, f.tolist())) for f in join_factors(packed)])
            types = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), text_col: pa.string()}
            arrays = [pa.array(made[f.name], types[f.name]) if f.name in types else pa.array(made[f.name], _parts_type()) for f in fields]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *arrays], names=[*keep, *made])

    return joined.select(*(source[c] for c in keep), source[text_col].alias(whole), packed_col).mapInArrow(cut, schema)


def _parts_type() -> pa.DataType:
    return pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())]))
