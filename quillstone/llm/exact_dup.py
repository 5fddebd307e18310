"""Exact deduplication by two-pass Bloom filtering.

Texts are equal if they are identical after deleting blanks (space, tab, line feed, vertical tab, form feed, carriage
return). Each row becomes a narrow one: id, SHA-256 of what is left, code points of the original text.

Pass 1 finds hashes that may occur more than once. A task sends each of its distinct hashes once, as 32 bits a hash and
marked if the task itself has met it again, to the block of the filter that the hash falls into. A block counts
how many times each of its cells was met, up to two; the cells met twice are its part of the second filter. So a
text of a third of all rows costs one number a task.

Pass 2 tests every row against the second filter. A row with a cell that was met once only is alone: it passes straight
through with a group of its own and is never shuffled. The others, copies and a few false positives, are grouped by
hash and counted as in any grouping; what the filter lets through wrongly ends as a group of one, so results are exact.

Bounds: a filter has CELLS cells a row (1 % of the single rows pass it wrongly) and FILTER_BYTES at most, which is what a
broadcast and the driver hold. More rows than that are dealt out into RANGES ranges of hashes at most, each with a
filter of its own. Beyond RANGES filters, which is 2.9e9 rows, cells a row become fewer and more single rows are
shuffled as narrow rows; nothing else changes. A block counts the hashes of one block only, and in a group of
copies each row is compared with its group's one row, dealt out by salts where the group is large.

Defined cases: a null text counts as empty, and all empty or blank texts are equal; a text of any length is hashed
whole; of equal texts the longest original stays, then the smallest id, a null id last; of rows alike in both the one
that comes first in the scratch table, so exactly one row of each group stays even where rows or ids repeat; keep_id is null
where the row that stays has no id; an empty table gives an empty result. Columns of the input other than id and text
are ignored, unless they are named in keep; a kept column with the name of a result column is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import fresh, materialize, salted_join, scratch_path, ship, spread

#: Characters that don't count.
BLANKS = " \t\n\x0b\x0c\r"
#: Cells of a filter for each row, bits that a row sets, cells of a block.
CELLS, BLOCK = 12, 1 << 20
#: Bytes of the filter of one range of hashes, and ranges, at most.
FILTER_BYTES, RANGES = 64 << 20, 64
#: Hashes that a task gathers before it sends them.
FLUSH = 1 << 20

_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)  # odd: each takes other bits of a hash to the top
_RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def filter_blocks(rows: int) -> tuple[int, int]:
    """(blocks, ranges) of the filters for so many rows."""
    a_range = FILTER_BYTES * 8 // BLOCK
    blocks = min(max(1, -(-rows * CELLS // BLOCK)), RANGES * a_range)
    return blocks, -(-blocks // a_range)


def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, from its upper half, and the lower half, which sets cells inside."""
    return ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), hashes.astype(np.uint32)


def cells(inner: np.ndarray) -> np.ndarray:
    """The cells that a hash sets in its block, a row for each."""
    return (inner[None, :] * _FACTORS[:, None]) >> np.uint32(12)


def met_twice(once: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Bits of the cells of a block that were met at least twice; hashes in again count twice."""
    met = np.zeros(BLOCK, np.uint32)
    for part, times in ((once, 1), (again, 2)):
        for row in cells(part):
            met += np.bincount(row, minlength=BLOCK).astype(np.uint32) * np.uint32(times)
    return np.packbits(met >= 2)


def _sent(blocks: int):
    """Pass 1 of a task: its distinct hashes by block."""

    def run(batches):
        held, n = [], 0

        def flush():
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            block, inner = places(hashes, blocks)
            cuts = np.flatnonzero(np.diff(block)) + 1  # hashes are sorted, and so are their blocks
            rows: dict[str, list] = {"block": [], "once": [], "again": []}
            for b, part, count in zip(block[np.concatenate(([0], cuts))], np.split(inner, cuts), np.split(counts, cuts), strict=True):
                rows["block"].append(int(b))
                rows["once"].append(part[count == 1].tobytes())
                rows["again"].append(part[count > 1].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows["block"], pa.int32()), pa.array(rows["once"], pa.binary()), pa.array(rows["again"], pa.binary())], names=list(rows))

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                n += batch.num_rows
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return run


def _counted(table: pa.Table) -> pa.Table:
    """Pass 1 of a block: cells that were met twice."""
    once, again = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32) for c in ("once", "again"))
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "bits": pa.array([met_twice(once, again).tobytes()], pa.binary())})


def _tested(shared, blocks: int, at: int, maybe: bool):
    """Pass 2: the rows whose hash may (maybe) or can't occur twice; the hash is column number at, and is dropped."""

    def run(batches):
        first, bits = shared.value
        bits = np.frombuffer(bits, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            block, inner = places(batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64), blocks)
            base = (block.astype(np.int64) - first) * BLOCK
            found = np.ones(batch.num_rows, bool)
            for row in cells(inner):
                cell = base + row
                found &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            rest = batch.select([i for i in range(batch.num_columns) if i != at])
            yield rest.filter(pa.array(found if maybe else ~found))

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) and the kept columns of every row."""
    spark = docs.sparkSession
    ship(spark)
    keep = [c for c in keep or [] if c != id_col and c not in _RESULT]
    row, length, place, number, part = (fresh(c, docs) for c in ("row", "length", "place", "number", "part"))
    text = fresh("body", docs)
    source = spread(docs.select(F.col(id_col).alias(row), *keep, F.col(text_col).alias(text)))
    plain = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.translate(plain, BLANKS, "").cast("binary"), 256)
    narrow = source.select(row, *keep, digest.alias("text_sha256"), F.length(plain).cast("long").alias(length))
    narrow = materialize(narrow.withColumns({place: F.monotonically_increasing_id(), number: F.xxhash64("text_sha256")}), "narrow")
    total = narrow.count()
    blocks, ranges = filter_blocks(total)
    bits = materialize(
        narrow.select(number).mapInArrow(_sent(blocks), "block int, once binary, again binary").groupBy("block").applyInArrow(_counted, "block int, bits binary"),
        "filter",
    )
    if ranges > 1:  # each range's rows are read once
        block = F.shiftright(F.shiftrightunsigned(number, 32) * blocks, 32)
        narrow = _by_range(narrow.withColumn(part, F.floor(block * ranges / blocks).cast("int")), part)
    columns = [c for c in narrow.columns if c != part]
    schema = T.StructType([narrow.schema[c] for c in columns if c != number])
    straight, flagged = [], []
    for r in range(ranges):
        first, end = -(-r * blocks // ranges), -(-(r + 1) * blocks // ranges)
        shared = spark.sparkContext.broadcast((first, _joined(bits, first, end)))
        rows = (narrow.where(F.col(part) == r) if ranges > 1 else narrow).select(*columns)
        straight.append(rows.mapInArrow(_tested(shared, blocks, columns.index(number), False), schema))
        flagged.append(rows.mapInArrow(_tested(shared, blocks, columns.index(number), True), schema))
    single, repeated = (_union(parts) for parts in (straight, flagged))
    repeated = materialize(repeated, "repeated")
    order = F.struct((-F.col(length)).alias("l"), F.col(row).isNull().alias("n"), F.col(row).alias("i"), F.col(place).alias("p"))
    best, n = fresh("best", narrow), fresh("rows", narrow)
    groups = materialize(repeated.groupBy("text_sha256").agg(F.min(order).alias(best), F.count("*").alias(n)), "groups")
    grouped = salted_join(repeated, groups, "text_sha256", place, sizes=groups.select("text_sha256", F.col(n).alias("rows")))
    names = [F.col(row).alias(id_col), *keep]
    out = grouped.select(*names, F.col(best)["i"].alias("keep_id"), F.col(n).alias("group_size"), (F.col(place) == F.col(best)["p"]).alias("kept"), "text_sha256")
    alone = single.select(*names, F.col(row).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(out)


def _by_range(rows: DataFrame, part: str) -> DataFrame:
    """rows, stored with a folder for each range."""
    path = scratch_path(rows.sparkSession, "ranges")
    rows.write.option("compression", "zstd").partitionBy(part).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _joined(bits: DataFrame, first: int, end: int) -> bytes:
    """The blocks from first to before end as one piece, of FILTER_BYTES at most; a block without hashes is empty."""
    held = bytearray((end - first) * BLOCK // 8)
    for r in bits.where(F.col("block").between(first, end - 1)).toLocalIterator():
        at = (r["block"] - first) * BLOCK // 8
        held[at : at + BLOCK // 8] = r["bits"]
    return bytes(held)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
