"""Shared helpers of the corpus operators: tables in the shared folder, and Arrow passes over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import drop_folder, drop_stored, shared_dir, stored  # noqa: F401  (for the operators of this folder)

#: Bytes of text that one call of a batch function gets, so a task's memory does not follow the batch's rows.
CHUNK_BYTES = 4 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes together; one longer text is a slice by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if sizes:
        yield batch.slice(start)


def map_texts(df: DataFrame, make: Callable[[], Callable], fields: list[T.StructField], text: str = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """`df` with new columns from its text column, in one Arrow pass without a shuffle.

    `make()` runs once in a task and gives a function from a list of texts (None for null) to a list of Arrow arrays,
    one for each of `fields`. New columns take the place of columns of the same name, in either case.
    """
    new = {f.name.lower() for f in fields}
    if text.lower() in new:
        raise ValueError(f"{text} is both read and made")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in chunks(batch, text, most):
                made = fn(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*keep, *[f.name for f in fields]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)
