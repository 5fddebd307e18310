"""MinHash near-duplicates with odd sketches and exact confirmation.

1. Every text becomes its set of word shingles, hashed to 64 bits. Texts with equal sets form a class;
   only one member of a class, its smallest id, goes on.
2. MinHash: BANDS bands of ROWS values. Two sets of similarity 0.75 miss each other in all bands with a
   probability of (1 - 0.75 ** ROWS) ** BANDS, about 5e-6. The same MinHash values are folded into an odd sketch,
   a bitmap of parities; the population count of the XOR of two sketches estimates how many values differ.
3. The members of a band bucket are compared with the bucket's smallest member, never all with all: pairs
   whose sketches estimate less than REJECT (some five standard deviations below the bound) are dropped,
   and of the others first the one with the smallest partner is confirmed on the full sets.
4. Confirmed links give components. In buckets that hold several components yet, a member may be linked with
   another one than the smallest. Of their members, those that share a shingle of their prefixes (the rarest quarter
   of each set, which linked sets can't but share) with one of another component and of fitting size are
   compared on their full sets, in pairs of blocks of bounded size that return the links which join components,
   never all pairs. So no candidate is lost; a group of copies costs one comparison a member, and documents that only
   share a common passage aren't compared, since what they share isn't rare.
5. Joins on a leader, a bucket, a component or a shingle that very many rows share deal these rows out to several tasks.

A link needs 100 * |A and B| >= threshold * |A or B|, counted on the full sets. Sets hold 64-bit hashes;
two different shingles of compared texts share one with a probability of some 1e-13 a pair.

Defined cases: words are split at ASCII white space, A-Z lower-cased; a text of fewer than SHINGLE words
is one shingle; a null text or one without words has an empty set and is linked with nothing; rows with
one id count as one document; a null id is linked with nothing, has a null component and is kept; an empty
table gives an empty result; a text of any length is compared whole; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, salted_join
from ._rows import map_texts
from ._words import FOLD, MULTIPLIER, WordHasher, mix, windows
from .components import components

SHINGLE = 5
THRESHOLD = 75
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
REJECT = 0.55
#: Shingles that are hashed at once, so that they stay in the cache.
TILE = 16_384
#: Of a block of nodes that are compared with each other: nodes, shingles; and columns of a matrix at once.
BLOCK_ROWS, BLOCK_SHINGLES, MATRIX_COLUMNS = 1024, 1_000_000, 4096

_rng = np.random.default_rng(20240229)
MULTIPLIERS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.int64).astype(np.uint64)


def shingle_sets(raws: list[bytes | None], hasher: WordHasher, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words: list[bytes] = []
    ends = []
    for r in raws:
        if r:
            words += r.translate(FOLD).split()
        ends.append(len(words))
    hashes = hasher(words)
    grams = windows(hashes, k)
    sets, a = [], 0
    for b in ends:
        n = b - a
        if n >= k:
            sets.append(np.unique(grams[a : b - k + 1]))
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in hashes[a:b]:
                    h = h * MULTIPLIER + x
            sets.append(mix(np.array([h], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
        a = b
    return sets


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, [set, function]; empty sets have the largest number everywhere."""
    out = np.full((len(sets), len(MULTIPLIERS)), np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (end == at or held + len(sets[end]) <= TILE):
            held += len(sets[end])
            end += 1
        own = [i for i in range(at, end) if len(sets[i])]
        if own:
            joined = np.concatenate([sets[i] for i in own])
            starts = np.cumsum([0, *(len(sets[i]) for i in own[:-1])])
            for f, m in enumerate(MULTIPLIERS):
                out[own, f] = np.minimum.reduceat(joined * m, starts)
        at = end
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A bucket key for each band, [set, band]."""
    h = np.zeros((len(values), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        h = h * MULTIPLIER + values[:, r::ROWS]
    return mix(h).view(np.int64)


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """Parity bitmaps of MinHash values as 64-bit words, [set, word]."""
    n = len(values)
    bits = (mix(values + _SALTS) % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS
    odd = np.bincount(bits.reshape(-1), minlength=n * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, SKETCH_BITS // 64)


def estimate(a: Column, b: Column) -> Column:
    """Similarity estimated from two odd sketches: each differing MinHash value flips two parities."""
    z = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    left = F.greatest(1 - 2 * z / F.lit(float(SKETCH_BITS)), F.lit(1e-9))
    return 1 - F.log(left) / F.lit(math.log(1 - 2 / SKETCH_BITS) * 2 * BANDS * ROWS)


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def factory():
        hasher = WordHasher()

        def apply(texts: pa.Array) -> dict:
            sets = shingle_sets(texts.cast(pa.binary()).to_pylist(), hasher)
            values = min_hashes(sets)
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.reshape(-1)))
            return {
                "n_shingles": [len(s) for s in sets],
                "same": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "bands": lists(band_keys(values)),
                "sketch": lists(odd_sketches(values)),
            }

        return apply

    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("same", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.ArrayType(T.LongType())),
    ]
    return map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], fields, factory)


def _full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, full) of the wanted nodes: their whole shingle sets."""

    def factory():
        hasher = WordHasher()

        def apply(texts: pa.Array) -> dict:
            sets = shingle_sets(texts.cast(pa.binary()).to_pylist(), hasher)
            offsets = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            return {"full": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))}

        return apply

    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")).join(nodes, "node", "left_semi")
    return map_texts(texts, ["node"], [T.StructField("full", T.ArrayType(T.LongType()))], factory)


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those stored pairs (a, b) whose full sets are similar enough; a node may be b of very many pairs."""
    left, right = sets.select(F.col("node").alias("a"), F.col("full").alias("x")), sets.select(F.col("node").alias("b"), F.col("full").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    both = salted_join(pairs, right, "b", "a").join(left, "a").select("a", "b", shared.alias("s"), (F.size("x") + F.size("y")).cast("long").alias("t"))
    return both.where(100 * F.col("s") >= threshold * (F.col("t") - F.col("s"))).select("a", "b").distinct()


def _likely(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """Stored pairs (a, b) that their sizes and odd sketches don't rule out; a node may be b of very many pairs."""
    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    both = salted_join(pairs, right, "b", "a").join(left, "a")
    fits = 100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    return both.where(fits & (estimate(F.col("s_a"), F.col("s_b")) >= REJECT)).select("a", "b").distinct()


def prefix_groups(nodes: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) that connect all nodes(node, label, full), stored, which may be linked with one of another label.

    Sets of similarity t share at least a share t of either, so under any one order of shingles they share one among
    the first n - ceil(t n) + 1 of either: the prefix. The order is that of rareness among these nodes, so a
    passage that very many of them hold is in few prefixes. Sizes must fit as well: nodes meet in classes
    of size of a ratio t, each in its own and the next one.
    """
    terms = nodes.select("node", "label", F.explode("full").alias("h"))
    seen = materialize(terms.groupBy("h").agg(F.count("*").alias("rows"), (F.min("label") < F.max("label")).alias("mixed")), "shingles")
    placed = salted_join(terms, seen.withColumnRenamed("rows", "df"), "h", "node", sizes=seen.select("h", "rows"))
    lists = placed.groupBy("node", "label").agg(F.sort_array(F.collect_list(F.struct("df", "h", "mixed"))).alias("own"))
    n = F.size("own")
    first = F.slice("own", 1, n - F.ceil(n * threshold / 100).cast("int") + 1)
    at = F.floor(F.log(n.cast("double")) / math.log(100 / threshold))
    # the prefix is a column of its own before it is exploded, so that no row carries a set along
    lists = lists.select("node", "label", at.alias("at"), F.filter(first, lambda s: s["mixed"]).alias("prefix"))
    rows = lists.select("node", "label", "at", F.explode("prefix").alias("s")).select("node", "label", F.explode(F.array("at", F.col("at") + 1)).alias("at"), "s.h")
    rows = materialize(rows.select("node", "label", F.xxhash64("h", "at").alias("key")), "prefixes")
    groups = rows.groupBy("key").agg(F.min("node").alias("b"), F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("rows"))
    groups = materialize(groups.where(F.col("x") < F.col("y")), "groups")
    met = salted_join(rows, groups.select("key", "b"), "key", "node", sizes=groups.select("key", "rows"))
    return met.select(F.col("node").alias("a"), "b").distinct()


def _settle(open_: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) that join components, among the nodes (node, label) of buckets that hold several.

    Nodes that prefixes connect make a group. Its full sets are compared in pairs of blocks of bounded size,
    by the product of their incidence matrices, but the group's largest component isn't compared with itself. What
    leaves a pair of blocks is a spanning forest of its components, never its pairs.
    """
    tasks = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as these few rows are much work
    nodes = open_.join(sets.dropDuplicates(["node"]), "node").select("node", "label", "full").repartition(tasks, "node")
    nodes = materialize(nodes, "open")
    groups = components(prefix_groups(nodes, threshold))
    nodes = nodes.join(groups.withColumnRenamed("label", "group"), "node")
    nodes = materialize(nodes.select("group", "node", "label", "full"), "groups")
    parts = nodes.groupBy("group", "label").agg(F.count("*").alias("m"), F.sum(F.size("full")).alias("s"))
    sizes = parts.groupBy("group").agg(F.max(F.struct("m", "label", "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    blocks = lambda m, s: F.greatest(F.lit(1), F.ceil(m / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select("group", "m", F.col("top.label").alias("largest"), blocks(F.col("top.m"), F.col("top.s")).alias("inner"), blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("others"))
    sizes = materialize(sizes, "sizes")
    split = salted_join(nodes, sizes.drop("m"), "group", "node", sizes=sizes.select("group", F.col("m").alias("rows")))
    place, inside = F.xxhash64("node"), F.col("label") == F.col("largest")
    split = split.withColumn("block", F.when(inside, F.col("others") + F.pmod(place, "inner")).otherwise(F.pmod(place, "others")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(inside, 0).otherwise(F.col("inner")))))
    split = split.select("group", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "node", "label", "full")

    def compare(table: pa.Table) -> pa.Table:
        return forest(table, threshold)

    return split.groupBy("group", "b1", "b2").applyInArrow(compare, "a long, b long").distinct()


def forest(table: pa.Table, threshold: int) -> pa.Table:
    """Links between two blocks (or inside one) that join different labels, without cycles."""
    block = table["block"].to_numpy()
    node, label = table["node"].to_numpy(), table["label"].to_numpy()
    full = table["full"].combine_chunks()
    size = np.diff(full.offsets.to_numpy())
    values = full.values.to_numpy()[full.offsets[0].as_py() : full.offsets[-1].as_py()]
    kinds, code, seen = np.unique(values, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(node)), size)
    shared = seen[code] > 1  # a shingle of one set only is in no intersection
    row, code = row[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    left = np.flatnonzero(block == table["b1"][0].as_py())
    right = np.flatnonzero(block == table["b2"][0].as_py())
    both = np.zeros((len(left), len(right)), np.float32)
    place = np.zeros(len(node), np.int64)
    place[left] = np.arange(len(left))
    place_right = np.zeros(len(node), np.int64)
    place_right[right] = np.arange(len(right))
    in_left, in_right = np.isin(row, left), np.isin(row, right)
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, MATRIX_COLUMNS):
        a, z = np.searchsorted(code, [first, first + MATRIX_COLUMNS])
        x, y = np.zeros((len(left), MATRIX_COLUMNS), np.float32), np.zeros((len(right), MATRIX_COLUMNS), np.float32)
        l, r = np.flatnonzero(in_left[a:z]) + a, np.flatnonzero(in_right[a:z]) + a
        x[place[row[l]], code[l] - first] = 1
        y[place_right[row[r]], code[r] - first] = 1
        both += x @ y.T
    union = size[left][:, None] + size[right][None, :] - both
    i, j = np.nonzero((100 * both >= threshold * union) & (label[left][:, None] != label[right][None, :]))
    parent = {int(x): int(x) for x in np.unique(label)}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for a, b in zip(left[i].tolist(), right[j].tolist()):
        x, y = root(int(label[a])), root(int(label[b]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            found.append((int(node[a]), int(node[b])))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; component_id is the smallest id reachable over links."""
    rows = materialize(_signatures(docs, id_col, text_col), "signatures")
    full = rows.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = full.groupBy("same").agg(
        F.min("id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    classes = materialize(classes, "classes")
    sketches = classes.select("node", "n", "sketch")

    buckets = classes.select("node", F.explode("bands").alias("key"))
    leaders = buckets.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("rows"))
    leaders = materialize(leaders.where(F.col("lead") < F.col("last")), "leaders")
    members = materialize(salted_join(buckets, leaders.select("key", "lead"), "key", "node", sizes=leaders.select("key", "rows")), "buckets")
    starred = members.where(F.col("lead") < F.col("node")).select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    likely = materialize(_likely(materialize(starred, "pairs"), sketches, threshold), "pairs")

    wanted = members.select("node").distinct()
    sets = materialize(_full_sets(docs, wanted, id_col, text_col), "sets")
    nearest = materialize(likely.groupBy("a").agg(F.min("b").alias("b")), "pairs")
    links = materialize(_confirm(nearest, sets, threshold), "links")
    labels = components(links)

    # buckets that still hold several components
    labelled = materialize(members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("rows")).where(F.col("x") < F.col("y"))
    mixed = materialize(mixed, "mixed")
    if mixed.isEmpty():
        return _with_components(rows, classes, labels, id_col)
    open_ = salted_join(labelled, mixed.select("key"), "key", "node", sizes=mixed.select("key", "rows")).select("node", "label").distinct()
    more = materialize(_settle(open_, sets, threshold), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    return _with_components(rows, classes, labels, id_col)


def _with_components(rows: DataFrame, classes: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    component = classes.select("same", "node").join(labels, "node", "left").select("same", F.coalesce("label", "node").alias("component_id"))
    out = rows.select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("same")).alias("same"))
    out = salted_join(out, component, "same", "id", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )
