"""Nearest neighbours by inner product over an inverted multi-index.

The two halves of the vectors are quantised on their own, with CENTROIDS centroids each, trained by
k-means on TRAIN_ROWS vectors at most (those whose ids hash smallest); a cell is a pair of centroids. A
query visits cells in order of the summed nearness of its halves to the two centroids, taking pairs from a
heap (multi-sequence algorithm), until the visited cells hold a share of PROBE of all vectors, and
at least LEAST of them. Candidates are reranked by their inner product in double precision: a matrix product
preselects those that can be among the k best in spite of its rounding errors, and their scores are then
computed anew, each in the same order of additions, so equal vectors have equal scores.

PROBE suits vectors without any cluster structure, where recall needs it; for vectors that do cluster a
small part of it is enough.

Every vector is indexed. Cells with neighbouring first centroids make a group. A query is sent to the groups
it visits, with a bit for each cell of the group, in blocks of at most BLOCK vectors and BLOCK queries, so a
cell that holds very many vectors, or that all queries visit, is spread over tasks; a block returns the
k best of each of its queries.

Defined cases: vectors that are null, all zero, or hold a null or non-finite component take no part, as a
query or as a candidate; the common length is the most frequent one, and vectors of another
length take no part, vectors of one component are like all others; ties go to the smaller id; rows with one id are all candidates, and each that
qualifies asks once per id with the smallest vector; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, ship

CENTROIDS = 128
TRAIN_ROWS = 20_000
PROBE, LEAST = 0.45, 1000
#: Of a block, vectors or queries; queries that are scored at once; first centroids of a group of cells.
BLOCK, BATCH, GROUP = 16_384, 128, 8


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Centroids of rows; fewer if there are fewer distinct rows, one if rows have no columns."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        nearest = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full][:, None]
    return centres


class Quantiser:
    """Centroids of both halves and the number of vectors in each cell."""

    def __init__(self, x: np.ndarray, k: int = CENTROIDS):
        self.half = (x.shape[1] + 1) // 2
        self.parts = [kmeans(x[:, : self.half], k), kmeans(x[:, self.half :], k)]
        self.counts = np.zeros((len(self.parts[0]), len(self.parts[1])), np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        codes = []
        for part, centres in zip((x[:, : self.half], x[:, self.half :]), self.parts):
            codes.append(((centres**2).sum(1)[None, :] - 2 * part @ centres.T).argmin(1))
        return codes[0] * len(self.parts[1]) + codes[1]

    def visit(self, q: np.ndarray, wanted: int) -> list[int]:
        """Occupied cells in order of summed nearness, until they hold as many vectors as wanted."""
        near = [centres @ part for part, centres in zip((q[: self.half], q[self.half :]), self.parts)]
        order = [np.argsort(-n, kind="stable").tolist() for n in near]
        width, held, found = len(self.parts[1]), 0, []
        score = lambda i, j: -(near[0][order[0][i]] + near[1][order[1][j]])
        heap, pushed = [(score(0, 0), 0, 0)], {(0, 0)}
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            n = int(self.counts[order[0][i], order[1][j]])
            if n:
                found.append(order[0][i] * width + order[1][j])
                held += n
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(order[0]) and b < len(order[1]) and (a, b) not in pushed:
                    pushed.add((a, b))
                    heapq.heappush(heap, (score(a, b), a, b))
        return found


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, as doubles."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", probe: float = PROBE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each vector whose id is divisible by every."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    out = f"query_id long, rank int, {id_col} long, score double"
    if lengths is None:
        return spark.createDataFrame([], out)
    width, total = lengths["w"], lengths["n"]
    rows = rows.where(F.size("v") == width)
    share = min(1.0, 1.5 * TRAIN_ROWS / total)
    sampled = rows.withColumn("h", F.xxhash64("id")).where(F.pmod("h", F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    sample = _matrix(sampled.orderBy("h", "id", "v").limit(TRAIN_ROWS).select("v").toArrow()["v"].combine_chunks(), width)
    if not len(sample):
        sample = _matrix(rows.orderBy("id").limit(CENTROIDS).select("v").toArrow()["v"].combine_chunks(), width)
    quantiser = Quantiser(sample)
    model = spark.sparkContext.broadcast(quantiser)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                cells = model.value.cells(_matrix(b.column(1), width))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.int32())], names=["id", "v", "cell"])

    indexed = materialize(rows.mapInArrow(assign, "id long, v array<double>, cell int"), "cells")
    sizes = indexed.groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # CENTROIDS ** 2 rows at most
    quantiser.counts.reshape(-1)[sizes["cell"].to_numpy()] = sizes["n"].to_numpy()
    ready = spark.sparkContext.broadcast(quantiser)
    wanted = max(math.ceil(probe * total), least, k + 1)

    span = GROUP * len(quantiser.parts[1])  # cells of a group

    def visits(batches):
        cells = ready.value.counts.size
        groups = -(-cells // span)
        for b in batches:
            if not b.num_rows:
                continue
            at, group, bits = [], [], []
            for i, q in enumerate(_matrix(b.column(1), width)):
                seen = np.zeros(groups * span, bool)
                seen[ready.value.visit(q, wanted)] = True
                for g in np.flatnonzero(seen.reshape(groups, span).any(1)).tolist():
                    at.append(i)
                    group.append(g)
                    bits.append(np.packbits(seen[g * span : (g + 1) * span]).tobytes())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(group, pa.int32()), pa.array(bits, pa.binary())], names=["query", "q", "grp", "seen"])

    asking = indexed.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("q")).select(F.col("id").alias("query"), "q")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, as few rows are much work; by no key, as dealing by the key just grouped by is left out
    asked = materialize(asking.repartition(tasks).mapInArrow(visits, "query long, q array<double>, grp int, seen binary"), "visits")

    # blocks of groups: vectors go to each block of the group's queries, and queries to each block of its vectors
    grouped = indexed.withColumn("grp", F.floor(F.col("cell") / span).cast("int"))
    blocks = asked.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks"))
    blocks = blocks.join(grouped.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("v_blocks")), "grp")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = grouped.join(blocks, "grp").select("grp", own("id", "v_blocks").alias("vb"), every_one("q_blocks").alias("qb"), "id", "v", (F.col("cell") % span).alias("cell"))
    right = asked.join(blocks, "grp").select("grp", every_one("v_blocks").alias("vb"), own("query", "q_blocks").alias("qb"), "query", "q", "seen")

    def rerank(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        ids = candidates["id"].to_numpy()
        found: list[list] = [[], [], []]
        if len(ids) and queries.num_rows:
            v, cell = _matrix(candidates["v"].combine_chunks(), width), candidates["cell"].to_numpy()
            largest = np.abs(v).max(0)
            for first in range(0, queries.num_rows, BATCH):
                part = queries.slice(first, BATCH)
                seen = np.unpackbits(np.frombuffer(b"".join(part["seen"].to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1)
                q = _matrix(part["q"].combine_chunks(), width)
                scores = q @ v.T
                scores[seen[:, cell] == 0] = -np.inf
                asks = part["query"].to_numpy()
                scores[asks[:, None] == ids[None, :]] = -np.inf
                error = 2 * width * np.finfo(float).eps * np.abs(q) @ largest  # of a score, at most
                least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(asks), -np.inf)
                for i, query in enumerate(asks.tolist()):
                    best = np.flatnonzero((scores[i] >= least[i] - 2 * error[i]) & (scores[i] > -np.inf))
                    exact = (v[best] * q[i]).sum(1)
                    order = np.lexsort((ids[best], -exact))[:k]
                    found[0] += [query] * len(order)
                    found[1] += ids[best[order]].tolist()
                    found[2] += exact[order].tolist()
        return pa.table({"query": pa.array(found[0], pa.int64()), "id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    keys = ("grp", "vb", "qb")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rerank, "query long, id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
