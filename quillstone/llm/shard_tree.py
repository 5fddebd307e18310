"""Sharding by a hierarchical weighted hash tree.

A tree has places: regions, racks in each region, shards in each rack, as many of each as it is declared with. A place holds a shard
of some weight or none. A row descends from the root: at each node a hash of its key, the node's name and a salt draws one of the
node's children, and at the place where it ends one more draw takes the shard with its weight, out of the largest weight that the tree is
declared with. A row that ends at an empty place, or isn't taken, descends again with the next salt. So a region's or rack's share
is the weights below it, and a draw depends on the key, the node's name and the salt only, never on what other nodes hold. When a
weight changes, or a shard comes or goes, rows move into or out of that shard and nowhere else: a new one takes just those rows that had met
its place before the one that they ended at. A row costs a draw for each level, and as many descents on average as the tree has
places for each weight held; it doesn't cost a draw for each shard.

Defined cases: a null key is hashed as the empty string; rows with equal keys share a shard; a text
that is null has no bytes, so size 1 and CRC 0; an empty table gives an empty result; columns of the
input other than key and text are ignored, whatever their names; a text of any length is measured whole. More shards than the tree has
places, two at one place, a weight above the largest and a tree without weights are errors. A row that MOST_DESCENTS don't place (at a quarter of the
places one row of 1e128) goes to the shard of least number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

#: Rows that a slot bucket holds on average; each bucket is numbered on its own.
BUCKET_ROWS = 50_000


#: Descents that are tried at once, each number more than the one before; few rows need the later ones.
DESCENTS = (4, 16, 64, 1024)
MOST_DESCENTS = DESCENTS[-1]


@dataclass(frozen=True)
class Tree:
    """Places of a tree: children of the root, of a region and of a rack; and the largest weight of a shard."""

    regions: int = 4
    racks: int = 4
    shards: int = 4
    weight: float = 1.0

    @property
    def places(self) -> int:
        return self.regions * self.racks * self.shards


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    slot: int
    number: int
    weight: float = 1.0


def layout(n: int, tree: Tree = Tree()) -> list[Shard]:  # noqa: B008  a frozen value
    """n shards of weight 1, dealt to regions and then to racks in turn; places never change as n grows."""
    if n > tree.places:
        raise ValueError(f"{n} shards, but the tree has {tree.places} places; declare a larger one from the start")
    return [Shard(i % tree.regions, i // tree.regions % tree.racks, i // (tree.regions * tree.racks), i) for i in range(n)]


def _draw(key: Column, salt: Column, level: int, node: Column, children: int) -> Column:
    """One of a node's children, in equal parts, by a hash of key, salt, and level and place of the node."""
    return F.floor(_uniform(key, salt, level, node) * children).cast("int")


def _uniform(key: Column, salt: Column, level: int, node: Column) -> Column:
    """A number in [0, 1) of 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(key, salt, F.lit(level), node), 11).cast("double") / F.lit(float(1 << 53))


def descents(key: Column, salts: Column, tree: Tree, held: dict[int, Shard]) -> Column:
    """For each salt the number of the shard that a key's descent ends at and that takes it, or null. A level is one step for all salts."""
    at = F.transform(salts, lambda salt: F.struct(salt.alias("salt"), F.lit(0).alias("node")))
    for level, children in enumerate((tree.regions, tree.racks, tree.shards)):
        at = F.transform(at, lambda x: F.struct(x["salt"].alias("salt"), (x["node"] * children + _draw(key, x["salt"], level, x["node"], children)).alias("node")))  # noqa: B023  called at once
    numbers = F.array(*(F.lit(held[i].number if i in held else None).cast("int") for i in range(tree.places)))
    if all(s.weight == tree.weight for s in held.values()):
        return F.transform(at, lambda x: F.get(numbers, x["node"]))
    weights = F.array(*(F.lit(held[i].weight / tree.weight if i in held else 0.0) for i in range(tree.places)))
    return F.transform(at, lambda x: F.when(_uniform(key, x["salt"], 3, x["node"]) < F.get(weights, x["node"]), F.get(numbers, x["node"])))


def place(key: Column, shards: list[Shard], tree: Tree = Tree()) -> Column:  # noqa: B008
    """The shard of a key: the first descent that ends at a shard which takes it."""
    held = {(s.region * tree.racks + s.rack) * tree.shards + s.slot: s for s in shards if s.weight > 0}
    if len(held) < sum(s.weight > 0 for s in shards):
        raise ValueError("two shards at one place")
    if not held or max(held) >= tree.places or max(s.weight for s in held.values()) > tree.weight:
        raise ValueError("no shard, a place outside the tree or a weight above its largest")
    tried, begin = [], 0
    for end in DESCENTS:
        salts = F.sequence(F.lit(begin), F.lit(end - 1))
        tried.append(F.try_element_at(F.filter(descents(key, salts, tree, held), lambda n: n.isNotNull()), F.lit(1)))
        begin = end
    return F.coalesce(*tried, F.lit(min(s.number for s in held.values())))


def assign(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None, tree: Tree = Tree(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """Shard and slot of every row: (id, size, text_crc32, shard, slot, grown_shard).

    Slots count from 0 without gaps in each shard. They are numbered in hash buckets of about
    BUCKET_ROWS rows, each offset by the counts of the buckets before it, so no shard is ever sorted
    in one task.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        place(key, shards, tree).cast("int").alias("shard"),
        (place(key, grown, tree) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    rows = materialize(rows, "shards")
    buckets = max(1, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(id_col, "text_crc32"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy(F.col(id_col), "text_crc32", "size")
    numbered = rows.withColumn("i", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        id_col, "size", "text_crc32", "shard", (F.col("offset") + F.col("i")).cast("long").alias("slot"), "grown_shard"
    )
