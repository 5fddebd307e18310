"""The trie of conversation prefixes, as a Cartesian tree over sorted conversations.

Every turn becomes a digest of its role and text, a conversation the sequence of its turns' digests. Equal conversations are one
entry. Entries are sorted by ranges of sequences; the LCP array holds how many turns each shares with the one before it, and
a range's entries are a block. The trie's branching nodes are the nodes of the Cartesian tree of that array, where
equal values next to each other in the tree are one node: the node of a value spans the entries from the nearest smaller value
before it to the nearest smaller value behind it. The leaves of the trie are entries that the next one doesn't continue.

All nearest smaller values, in parallel: a block resolves its own with a stack. What it leaves open, one node for each
depth at most, is looked for in the blocks' minima, of which every task has all (a short row a block): they name the
nearest block with a smaller value. That block answers from its chain of suffix (or prefix) minima, again a row
for each depth at most, in a join by block. The chains carry the sums of their parts of the block, whole blocks between are
summed from the short rows, and nodes that several blocks have found are merged. A node with one child per turn
up to the next branching is expanded last: all of them have the same members.

Sums over an interval of entries are all that a node needs. With c turns' code points in a conversation, those that a subtree
saves are what its members hold below the node's parent, less what its distinct turns hold.

Bounds: a conversation, 24 bytes a turn, is a row; texts are read once and never shuffled. Blocks have some BLOCK_ENTRIES distinct
conversations. The ids that end at a node are sorted by ranges and joined to pieces of PIECE_BYTES there; a
node's pieces then pass through one task as a stream, since their SHA-256 is one, and are never held.

Defined cases: rows without a conversation id belong to none and are left out; turns are in order of turn, null first, those
with equal numbers in order of their digests; a null role or text is empty; a repeated row is a turn of its own; a conversation that is
rebuilt of nothing is a member of the root; an empty table has no nodes. Columns other than these four are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, ship, spread

#: Distinct conversations of a block, on average.
BLOCK_ENTRIES = 1 << 15
#: Bytes of a piece of the list of ids that end at a node.
PIECE_BYTES = 1 << 16
#: Bytes of a turn's digest.
WIDTH = 16
#: Turns at the beginning of a conversation that others may be rebuilt with.
MOST_SHARED = 5
NOTHING = hashlib.sha256().hexdigest()

SUMS = ("n", "leaves", "held", "fresh")
_PARTS = (
    "kind string, block int, no int, depth int, pos long, count long, lblock int, rblock int, n long, leaves long, held long, fresh long, conv long, "
    "pd int, pblock int, pno int, parent long, before array<long>, own long, whole long, ends string"
)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, chars): the first h turns of conversation c - c % 100, then c's own turns after its first h.

    seq is the digests of all turns one after the other, chars their code points; h is the CRC-32 of the decimal id modulo 6.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = spread(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")).where("conv_id IS NOT NULL")
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", digest.alias("d"), F.length(text).alias("c"))
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    own = materialize(own.select("conv_id", F.transform("turns", lambda t: F.struct(t["d"].alias("d"), t["c"].alias("c"))).alias("turns")), "turns")
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    joined = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 100, "h": h}).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(own.schema["turns"].dataType))
    tail = F.slice("turns", F.col("h") + 1, F.size("turns"))
    both = joined.select("conv_id", F.concat(head, tail).alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join("turns.d", "")).alias("seq"), F.col("turns.c").alias("chars"))


def _pieces(batches):
    """Ids of rows in order of (name, conv_id), joined to pieces."""
    name, ids, size = None, [], 0
    out: list[tuple] = []

    def end():
        nonlocal ids, size
        if ids:
            out.append((name, ids[0], len(ids), ",".join(map(str, ids))))
        ids, size = [], 0

    def made():
        nonlocal out
        rows, out = out, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["name", "first", "n", "piece"])

    for batch in batches:
        for s, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if s != name or size > PIECE_BYTES:
                end()
                name = s
            ids.append(i)
            size += 12
        if len(out) >= 1000:
            yield made()
    end()
    if out:
        yield made()


def _hashed(batches):
    """SHA-256, number and least of each name's ids, from pieces in order of (name, first)."""
    name, state, n, least = None, hashlib.sha256(), 0, 0
    out: list[tuple] = []

    def made():
        nonlocal out
        rows, out = out, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["name", "n", "conv", "ends"])

    for batch in batches:
        for s, first, count, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if s != name:
                if name is not None:
                    out.append((name, n, least, state.hexdigest()))
                name, state, n, least = s, hashlib.sha256(), 0, first
            else:
                state.update(b",")
            state.update(piece.encode())
            n += count
        if len(out) >= 1000:
            yield made()
    if name is not None:
        out.append((name, n, least, state.hexdigest()))
    if out:
        yield made()


def entries(conversations: DataFrame) -> DataFrame:
    """(part, seq, chars, n, conv, ends) of every distinct sequence: members, the least of them, the hash of their ids; parts are ranges of seq."""
    ship(conversations.sparkSession)
    members = materialize(rebuilt(conversations).withColumn("name", F.md5("seq")), "members")
    ids = members.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    pieces = ids.mapInArrow(_pieces, "name string, first long, n long, piece string")
    ends = pieces.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_hashed, "name string, n long, conv long, ends string")
    distinct = members.select("name", "seq", "chars").dropDuplicates(["name"]).join(ends, "name").drop("name")
    distinct = materialize(distinct, "distinct")
    parts = max(1, distinct.count() // BLOCK_ENTRIES)
    return materialize(distinct.repartitionByRange(parts, "seq").withColumn("part", F.spark_partition_id()), "entries")


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common at their beginning."""
    most, n, step = min(len(a), len(b)), 0, WIDTH
    while n < most and a[n : n + step] == b[n : n + step]:  # longer and longer stretches, then shorter ones
        n, step = min(n + step, most), step * 2
    while step > WIDTH:
        step //= 2
        if a[n : n + step] == b[n : n + step]:
            n = min(n + step, most)
    return min(n, most) // WIDTH


def _sorted(table: pa.Table) -> tuple[list[bytes], pa.Table]:
    table = table.take(pa.compute.sort_indices(table, sort_keys=[("seq", "ascending")]))
    return table.column("seq").to_pylist(), table


def _lcps(seqs: list[bytes]) -> list[int]:
    return [shared_turns(a, b) for a, b in zip(seqs, seqs[1:], strict=False)]


def _summary(table: pa.Table) -> pa.Table:
    """One row: a block's size, its ends and the least value between its entries."""
    import pyarrow.compute  # noqa: F401

    seqs, table = _sorted(table)
    return pa.table({"part": table.column("part")[:1], "size": pa.array([len(seqs)], pa.int64()), "least": pa.array([min(_lcps(seqs), default=None)], pa.int32()), "first": pa.array(seqs[:1], pa.binary()), "last": pa.array(seqs[-1:], pa.binary())})


def _edges(batches):
    """The value at each block's beginning; -1 where nothing stands before it."""
    for b in batches:
        edge = [-1 if p is None else shared_turns(p, f) for p, f in zip(b.column("previous").to_pylist(), b.column("first").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("size"), b.column("least"), pa.array(edge, pa.int32())], names=["part", "size", "least", "edge"])


class Blocks:
    """What every task knows of all blocks: order, offsets, the value at each beginning, and minima; a short row a block."""

    def __init__(self, rows: list):
        self.of = {r["part"]: i for i, r in enumerate(rows)}
        self.offset = np.concatenate(([0], np.cumsum([r["size"] for r in rows]))).astype(np.int64)
        self.edge = [*(r["edge"] for r in rows), -1]
        self.least = np.array([r["edge"] if r["least"] is None else min(r["edge"], r["least"]) for r in rows] + [-1], np.int64)

    def before(self, block: int, depth: int) -> int:
        """The last block before this one that has a value below depth."""
        return int(np.flatnonzero(self.least[:block] < depth)[-1])

    def behind(self, block: int, depth: int) -> int:
        """The first block behind this one that has one; the end of all blocks has -1."""
        return block + 1 + int(np.argmax(self.least[block + 1 :] < depth))


def nearest_smaller(values: list[int]) -> tuple[list[list], list[int]]:
    """Nodes [value, place of the last smaller value before, place of the next smaller one, occurrences] and each place's node.

    None where the list ends before a smaller value is found. Equal values with none smaller between them are one node.
    """
    nodes: list[list] = []
    of: list[int] = []
    stack: list[tuple[int, int]] = []  # node, last place of its value
    for i, v in enumerate(values):
        while stack and nodes[stack[-1][0]][0] > v:
            nodes[stack.pop()[0]][2] = i
        if stack and nodes[stack[-1][0]][0] == v:
            no = stack.pop()[0]
            nodes[no][3] += 1
        else:
            no = len(nodes)
            nodes.append([v, stack[-1][1] if stack else None, None, 1])
        stack.append((no, i))
        of.append(no)
    return nodes, of


class _Least:
    """Least of any interval, from those of intervals of powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while len(self.rows[-1]) > 1 << (len(self.rows) - 1):
            w = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-w], self.rows[-1][w:]))

    def __call__(self, begin: int, end: int) -> int:
        k = (end - begin).bit_length() - 1
        return int(min(self.rows[k][begin], self.rows[k][end - (1 << k)]))


def _parts(blocks: Blocks):
    """A block's nodes: resolved ones, open ones, both chains of minima and the block's own sums."""

    def run(table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        seqs, table = _sorted(table)
        block, size = blocks.of[table.column("part")[0].as_py()], len(seqs)
        values = [blocks.edge[block], *_lcps(seqs)]
        behind = [*values[1:], blocks.edge[block + 1]]
        depth = [len(s) // WIDTH for s in seqs]
        n, conv = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "conv"))
        ends = table.column("ends").to_pylist()
        above = [np.concatenate(([0], np.cumsum(c, dtype=np.int64))) for c in table.column("chars").to_pylist()]
        whole = np.array([a[-1] for a in above], np.int64)
        own = np.array([a[-1] - a[max(v, 0)] for a, v in zip(above, values, strict=True)], np.int64)
        leaf = np.array([v < d for v, d in zip(behind, depth, strict=True)], np.int64)
        sums = [np.concatenate(([0], np.cumsum(x))) for x in (n, leaf, n * whole, own)]
        least = _Least(conv)
        rows: list[dict] = []

        def summed(begin: int, end: int) -> dict:
            return {k: int(s[end] - s[begin]) for k, s in zip(SUMS, sums, strict=True)} | {"conv": least(begin, end) if end > begin else None}

        def entry(i: int, top: int, bottom: int) -> dict:
            """Entry i as the first one of nodes from depth top + 1 to bottom."""
            return {"before": [int(above[i][max(d - 1, 0)]) for d in range(top + 1, bottom + 1)], "own": int(own[i]), "whole": int(whole[i]), "ends": ends[i] if depth[i] == bottom else None}

        nodes, of = nearest_smaller(values)
        closed = [left is not None and right is not None for _, left, right, _ in nodes]
        members = [summed(left, right) if done else None for (_, left, right, _), done in zip(nodes, closed, strict=True)]

        def hung(i: int, j: int) -> dict:
            """The parent of what lies between the values at i and j: the node of the larger one."""
            a, b = values[i], values[j] if j < size else blocks.edge[block + 1]
            if max(a, b) < 0:
                return {"pd": -1}
            if b > a and j == size:
                return {"pd": b, "pblock": block + 1, "pno": 0}  # the value at a block's beginning is its first node
            no = of[i] if a >= b else of[j]
            return {"pd": max(a, b)} | ({"parent": members[no]["conv"]} if closed[no] else {"pblock": block, "pno": no})

        for i in range(size):
            if leaf[i]:
                up = hung(i, i + 1)
                rows.append({"kind": "node", "depth": depth[i], "count": -1} | summed(i, i + 1) | up | entry(i, up["pd"], depth[i]))
        for no, (v, left, right, count) in enumerate(nodes):
            place = {"block": block, "no": no, "depth": v, "count": count}
            if closed[no]:
                up = hung(left, right)
                rows.append({"kind": "node"} | place | members[no] | up | entry(left, up["pd"], v))
            elif v >= 0:
                rows.append({"kind": "open"} | place | {"lblock": block if left is not None else blocks.before(block, v), "rblock": block if right is not None else blocks.behind(block, v)})
        lowest = None
        for i in range(size - 1, -1, -1):
            if lowest is None or values[i] < lowest:
                lowest = values[i]
                rows.append({"kind": "left", "block": block, "no": of[i], "depth": lowest, "pos": int(blocks.offset[block]) + i} | summed(i, size) | entry(i, -1, depth[i]))
        lowest = None
        for i in range(size):
            if lowest is None or values[i] < lowest:
                lowest = values[i]
                rows.append({"kind": "right", "block": block, "no": of[i], "depth": lowest, "pos": int(blocks.offset[block]) + i} | summed(0, i))
        rows.append({"kind": "block", "block": block} | summed(0, size))
        return pa.Table.from_pylist(rows, _SCHEMA)

    return run


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in _PARTS.split(", ")])


def _between(last: int, totals: list):
    """Adds the sums of the whole blocks between to those of a node's parts in its first and its last block."""
    order = sorted(totals, key=lambda r: r["block"])
    upto = {k: np.concatenate(([0], np.cumsum([r[k] for r in order]))) for k in SUMS}
    least = _Least(np.array([r["conv"] for r in order], np.int64)) if order else None

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                first, end = r["lblock"] + 1, min(r["rblock"], last)
                for k in SUMS:
                    r[k] += (r[f"r_{k}"] or 0) + int(upto[k][end] - upto[k][first])
                r["conv"] = min(x for x in (r["conv"], r["r_conv"], least(first, end) if end > first else None) if x is not None)
            yield pa.RecordBatch.from_pylist([{f.name: r[f.name] for f in _OPEN} for r in rows], _OPEN)

    return run


_OPENED = "block int, no int, depth int, pos long, count long, n long, leaves long, held long, fresh long, conv long, pd int, pblock int, pno int, before array<long>, own long, whole long, ends string"
_OPEN = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in _OPENED.split(", ")])


def _resolved(parts: DataFrame, blocks: Blocks) -> DataFrame:
    """Open nodes, a row for each block that has found one, with what the blocks at both ends and those between hold."""
    opened = parts.where("kind = 'open'").select("block", "no", "depth", "count", "lblock", "rblock")
    last = len(blocks.of)

    def answers(side: str, best) -> DataFrame:
        """(lblock or rblock, depth, a): the nearest value below depth in that block."""
        name = f"{side[0]}block"
        wanted = opened.where(F.col(name) < last).select(F.col(name), "depth").distinct()
        fields = ["pos", "no", *SUMS, "conv", *(["before", "own", "whole", "ends"] if side == "left" else [])]
        chain = parts.where(F.col("kind") == side).select(F.col("block").alias(name), F.col("depth").alias("value"), F.struct(F.col("depth").alias("value"), *fields).alias("a"))
        met = wanted.join(chain, name).where(F.col("value") < F.col("depth"))
        return met.groupBy(name, "depth").agg(best("a", F.col("a.pos")).alias(side))

    found = opened.join(answers("left", F.max_by), ["lblock", "depth"]).join(answers("right", F.min_by), ["rblock", "depth"], "left")
    right = F.coalesce(F.col("right.value"), F.lit(-1))  # behind all blocks
    pd = F.greatest(F.col("left.value"), right)
    mine = F.col("left.value") >= right
    top = pd + 1
    rows = found.select(
        "block", "no", "depth", F.col("left.pos").alias("pos"), "count", "lblock", "rblock",
        *(F.col(f"left.{k}").alias(k) for k in (*SUMS, "conv", "own", "whole")),
        *(F.col(f"right.{k}").alias(f"r_{k}") for k in (*SUMS, "conv")),
        pd.alias("pd"), F.when(pd >= 0, F.when(mine, F.col("lblock")).otherwise(F.col("rblock"))).alias("pblock"),
        F.when(pd >= 0, F.when(mine, F.col("left.no")).otherwise(F.col("right.no"))).alias("pno"),
        F.slice("left.before", top + 1, F.col("depth") - top + 1).alias("before"),
        F.when(F.size("left.before") == F.col("depth") + 1, F.col("left.ends")).alias("ends"),
    )
    totals = parts.where("kind = 'block'").select("block", *SUMS, "conv").collect()  # a short row a block
    return rows.mapInArrow(_between(last, totals), _OPENED)


def build_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = entries(conversations)
    ends = found.select("part", "seq").groupBy("part").applyInArrow(_summary, "part int, size long, least int, first binary, last binary")
    previous = F.lag("last").over(Window.orderBy("part"))  # over one row a block
    edges = ends.withColumn("previous", previous).mapInArrow(_edges, "part int, size long, least int, edge int")
    blocks = Blocks(sorted(edges.collect(), key=lambda r: r["part"]))  # a short row a block
    parts = materialize(found.groupBy("part").applyInArrow(_parts(blocks), _PARTS), "nodes")
    closed = parts.where("kind = 'node'")
    opened = materialize(_resolved(parts, blocks), "open")
    names = closed.where("no IS NOT NULL").select("block", "no", "conv").unionByName(opened.select("block", "no", "conv"))
    parents = names.select(F.col("block").alias("pblock"), F.col("no").alias("pno"), F.col("conv").alias("above"))
    same = [*SUMS, "conv", "pd", "pblock", "pno", "before", "own", "whole", "ends"]  # in every block that has found the node
    columns = ["depth", "count", *same]
    merged = opened.groupBy("pos", "depth").agg(F.sum("count").alias("count"), *(F.min(c).alias(c) for c in same)).withColumn("parent", F.lit(None).cast("long"))
    nodes = closed.select(*columns, "parent").unionByName(merged.select(*columns, "parent"))
    nodes = nodes.join(parents, ["pblock", "pno"], "left").withColumn("parent", F.coalesce("parent", "above"))
    each = nodes.select("*", F.posexplode("before").alias("i", "upto"))
    depth, bottom = (F.col("pd") + 1 + F.col("i")).alias("depth"), F.col("pd") + 1 + F.col("i") == F.col("depth")
    saved = F.col("held") - F.col("n") * F.col("upto") - (F.col("fresh") - F.col("own") + F.col("whole") - F.col("upto"))
    kids = F.when(F.col("count") < 0, 0).otherwise(F.col("count") + 1 - F.col("ends").isNotNull().cast("int"))
    out = each.select(
        F.col("conv").alias("conv_id"), depth.cast("long").alias("depth"), F.when(F.col("i") == 0, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(bottom, kids).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.when(bottom, F.coalesce("ends", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"),
    )
    return out
