"""Arrow plumbing for operators that read whole texts in Python, a bounded chunk of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import fresh, ship, spread

#: Text bytes that a chunk holds; a single longer text makes a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Rows of an Arrow batch: keeps a batch of long texts small enough for a Python worker.
BATCH_ROWS = 1000


def bounded_batches(spark) -> None:
    """Lower the session's Arrow batch to BATCH_ROWS rows, so that a batch of very long texts stays small.

    Batches are cut when a plan runs, so the setting has to stay; one that was set by hand is left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Split batches into slices of about size bytes of text; never joins two batches."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i in range(n):
            if held and held + lengths[i] > size:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += int(lengths[i])
        yield batch.slice(at, n - at)


def map_texts(
    df: DataFrame,
    keep: list[str],
    fields: list[T.StructField],
    factory: Callable[[], Callable[[pa.Array], dict]],
    text: str = "text",
    size: int = CHUNK_BYTES,
) -> DataFrame:
    """Apply a chunk function to a text column.

    factory() is called once per task; what it returns gets each chunk's text as an Arrow array and
    returns a list or Arrow array for each field. Columns in keep pass through; where a field has
    the name of a kept column, the field replaces it. The text travels under a name that df lacks.
    """
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    hidden = fresh("text", df)
    source = spread(df.select(*keep, df[text].alias(hidden)))
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    types = {f.name: to_arrow_type(f.dataType) for f in fields}

    def run(batches):
        import pyarrow.compute  # noqa: F401  used by chunks()

        fn = factory()
        for part in chunks(batches, hidden, size):
            made = fn(part.column(hidden))
            columns = [part.column(c) for c in keep]
            for f in fields:
                v = made[f.name]
                columns.append(v if isinstance(v, pa.Array) and v.type == types[f.name] else pa.array(v, types[f.name]))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(f.name for f in fields)])

    return source.mapInArrow(run, schema)
