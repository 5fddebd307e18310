"""Session helpers shared by the whole library: shared scratch tables, code shipping, row numbers, skewed joins."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stored bytes of a table that is dealt out to all cores; larger ones have splits enough or aren't worth a shuffle.
SPREAD_BYTES = 256 << 20
#: Keys that a salted join counts as hot, at most, and the fewest rows that make a key hot.
HOT_KEYS, HOT_ROWS = 10_000, 256
#: Settings of Arrow batches that are sent to Python: rows and bytes of one.
BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

_NARROW = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "LocalRelation", "Relation"}
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python stages can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillstone-")) / "quillstone.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("quillstone") / p.relative_to(root)))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches, so that a batch is small whatever a partition's size and however long its texts.

    Batches are cut when a plan runs, so the settings have to stay; one that was set by hand is left alone.
    """
    for key, value in BATCH_SETTINGS.items():
        if not spark._jsparkSession.sessionState().conf().contains(key):
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
    os.makedirs("/tmp/checkpoints", exist_ok=True)
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillstone-", dir="/tmp/checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes with the scratch tables."""
    path = f"{shared_dir(spark)}/quillstone-{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, compared without case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored_bytes(df: DataFrame) -> int | None:
    """Bytes of the table that df reads, where df is a file or local table with nothing but filters and projections; else None.

    The optimizer's figures are read; nothing is planned or run.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaf, width = plan, 1
    while width == 1:
        if leaf.nodeName().split()[0] not in _NARROW:
            return None
        children = leaf.children()
        width = children.size()
        if width == 1:
            leaf = children.head()
    size = int(str(leaf.stats().sizeInBytes()))
    return size if width == 0 and size < 1 << 60 else None


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table that lies in fewer splits than there are cores out to all of them.

    Only tables of SPREAD_BYTES at most are dealt, and only where df reads them directly: a large table is never
    shuffled for this, and no upstream shuffle is run to count partitions.
    """
    size = stored_bytes(df)
    if size is None or size > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def numbered(stored: DataFrame, place: str, ordinal: str, *source: str) -> DataFrame:
    """stored with an ordinal from 0 without gaps, and without the place column and the source columns.

    place holds monotonically_increasing_id() from when the table was written. Without source columns, rows are
    in order of place; with them (path and first byte of a split), in order of these, then of place. Each
    partition's or split's offset is the sum of the rows of those before it, in a window over one short row a task of the job that
    wrote the table; the driver holds none of them as Python rows, and the broadcast is of those short rows.
    """
    keys = list(source) or [fresh("part", stored)]
    rows = stored if source else stored.withColumn(keys[0], F.shiftright(place, 33))
    n, least, offset = (fresh(c, rows) for c in ("n", "least", "offset"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias(n), F.min(place).alias(least))
    before = F.coalesce(F.sum(n).over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = F.broadcast(counts.select(*keys, (before - F.col(least)).alias(offset)))  # a row a split
    return rows.join(table, keys).withColumn(ordinal, F.col(offset) + F.col(place)).drop(*keys, offset, place)


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """many joined with one on key, which is unique in one; rows of many with a hot key are dealt out by a hash of column by.

    A key is hot if it has more than HOT_ROWS rows and a HOT_KEYS-th of all of them, so there are HOT_KEYS hot keys
    at most; these are counted first and broadcast. A hot key's row of one is repeated once for each deal of so many
    rows. many should be a stored table: it is read again for the counts, unless sizes(key, rows) has them.
    Rows with a null key are dealt out too.
    """
    sizes = many.groupBy(key).agg(F.count("*").alias("rows")) if sizes is None else sizes
    total, most = sizes.agg(F.sum("rows"), F.max("rows")).first()
    bound = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= bound:
        return many.join(one, key, how)
    salts, salt = fresh("salts", many, one), fresh("salt", many, one)
    hot = sizes.where(F.col("rows") > bound).select(key, F.ceil(F.col("rows") / bound).cast("int").alias(salts)).collect()
    table = F.broadcast(many.sparkSession.createDataFrame(hot, T.StructType([many.schema[key], T.StructField(salts, T.IntegerType())])))
    deals = F.when(F.col(key).isNull(), 1 << 20).otherwise(F.coalesce(salts, F.lit(1)))
    dealt = many.join(table, key, "left").withColumn(salt, F.pmod(F.xxhash64(by), deals).cast("int")).drop(salts)
    repeated = one.join(table, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))).drop(salts)
    return dealt.join(repeated, [key, salt], how).drop(salt)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(since: int = 0) -> None:
    """Delete the scratch tables of this process, but for the first `since` of them."""
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder goes with it
            return


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Delete a table that has been written at path when the process ends."""
    _written.insert(0, (spark, path))


@contextmanager
def scratch() -> Iterator[None]:
    """Scratch tables that are written inside are deleted at the end; nothing lazy that reads them may leave."""
    mark = _written[-1] if _written else None
    try:
        yield
    finally:
        while _written and _written[-1] is not mark:
            release(len(_written) - 1)


atexit.register(release)
