"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massflow.session import written

#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE_ROWS = 1024
#: Most bytes of an Arrow batch between Spark and Python (a larger row is alone).
BATCH_BYTES = 8 << 20

#: The class of the ASCII white space that separates words, as a Java regex.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

#: Most rows that are broadcast after a count (of short columns, so some MB).
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    return written(df, tag)[0]


def bucket5(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; a null id counts as the empty text (0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_BYTES``: each is held by the
    JVM, outside its heap, and by the Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return a worker's free memory to the system: workers are reused."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with bounded batches."""
    bound_batches(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(lean, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def map_text(
    df: DataFrame,
    keep: list[str],
    make: Callable[[], Callable[[list[bytes | None], pa.RecordBatch], list[pa.Array]]],
    fields: list[T.StructField],
    text: str = "text",
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """``keep`` columns of ``df`` plus ``fields`` computed from ``text``.

    ``make()`` is called once a task and returns the function of a slice's
    texts (UTF-8 bytes or None) and its Arrow batch."""
    src = df.select(*keep, *([] if text in keep else [text]))
    schema = T.StructType([src.schema[k] for k in keep] + fields)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                cols = [part.column(j) for j in range(len(keep))]
                yield pa.RecordBatch.from_arrays(cols + fn(as_bytes(part.column(at)), part), names=names)

    return map_arrow(src, run, schema)
