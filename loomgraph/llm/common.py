"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from ..sources.shared import settle  # noqa: F401  the operators' own name for it

#: White space as the operators mean it: blank and \t \n \v \f \r, nothing else.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes up to which a table may be broadcast; beyond either Spark plans a shuffled join.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def width(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory."""

    def of(column: Column, kind: DataType) -> Column:
        if isinstance(kind, StringType | BinaryType):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 16
        if isinstance(kind, ArrayType):
            return 16 + F.aggregate(F.coalesce(column, F.array().cast(kind)), F.lit(0), lambda a, x: a + of(x, kind.elementType).cast("int"))
        if isinstance(kind, StructType):
            return sum((of(column[f.name], f.dataType) for f in kind.fields), F.lit(8))
        return F.lit(8)

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a settled table may be broadcast: it has at most ``rows`` rows and about ``size`` bytes, as Spark counts."""
    n, held = df.agg(F.count("*"), F.sum(width(df))).first()
    return n <= rows and (held or 0) <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a settled table for broadcast if it ``is_small``; otherwise for a shuffled join, as Spark's estimate from files may be too low
    for either side."""
    return F.broadcast(df) if is_small(df, rows, size) else df.hint("merge")


def spare(df: DataFrame, name: str) -> str:
    """A column name that a table doesn't have yet, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def digest(column: str = "text") -> Column:
    """What tells a text from others, as a key for joins: 128 bits. Null has none."""
    return F.md5(F.col(column).cast("binary"))


def utf8(column: str = "text"):
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(column)


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about ``limit`` bytes of ``column``; a longer row stands alone, whole."""
    sizes = [len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column)]
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def over_batches(df: DataFrame, schema: str, column: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], limit: int = 4 << 20) -> DataFrame:
    """Apply a function to slices of Arrow batches.

    ``make`` runs once a task and returns the function; it gets a slice of at most about ``limit`` bytes of
    ``column`` and returns the columns of ``schema`` by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in slices(batch, column, limit):
                yield pa.RecordBatch.from_pydict(apply(part), schema=wanted)

    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(StructType.fromDDL(schema))
    # Whole texts travel in these batches: Spark's default of 10,000 rows is made for short ones. A session's own choice stays.
    if df.sparkSession.conf.get(BATCH, "10000") == "10000":
        df.sparkSession.conf.set(BATCH, "1000")
    return df.mapInArrow(run, schema)
