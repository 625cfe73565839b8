"""Joins and windows over tables that the graph is built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _seconds(c: str, kind: T.DataType) -> Column:
    """A time as seconds; of a local time (without a zone) those of its own clock, so that none come out of order where clocks change."""
    if isinstance(kind, T.TimestampNTZType):
        return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.col(c).cast("timestamp" if isinstance(kind, T.DateType) else kind).cast("long")


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str, width: int | None = None) -> DataFrame:
    """Each left row with the last right value at or before its time, by key; null where there is none.

    Both sides are laid in one stream by key and time, and the last value is carried on: one shuffle and one sort, and no
    pairs. Of right rows at the same time the largest value counts. Adds ``asof_value``. With ``width`` (of times as whole
    numbers: seconds of timestamps) a key's stream is cut into stretches of that width, so that a key with very many rows is
    many tasks' work; what a stretch starts with comes from the last values of those before it, a row each.
    """
    names = left.columns
    rows = left.select(F.col(by).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*names).alias("_row"))
    marks = right.select(F.col(by).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_o"), F.col(value).alias("_v"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    keys = ["_k"] if width is None else ["_k", "_b"]
    cut = lambda df: df if width is None else df.withColumn("_b", F.floor(_seconds("_t", df.schema["_t"].dataType) / width))
    stream, marks = cut(rows.union(marks)), cut(marks)
    last = F.last("_v", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_t", "_o", F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    found = stream.withColumn("asof_value", last).filter("_o = 1")
    if width is not None:
        ends = marks.filter("_v is not null").groupBy("_k", "_b").agg(F.max(F.struct("_t", "_v"))["_v"].alias("_end"))
        # Every stretch that has left rows or ends, with the last end before it.
        stretches = ends.unionByName(rows.transform(cut).select("_k", "_b").distinct(), allowMissingColumns=True).groupBy("_k", "_b").agg(F.max("_end").alias("_end"))
        before = F.last("_end", ignorenulls=True).over(W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
        carried = stretches.select(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), before.alias("_before"))
        found = found.join(carried, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_b") == F.col("_b2")), "left").withColumn("asof_value", F.coalesce("asof_value", "_before"))
    return found.select(*[F.col(f"_row.{n}").alias(n) for n in names], "asof_value")


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Points within spans (low <= point < high), by buckets of ``width``: an equality that Spark can hash or sort on.

    A span goes to each bucket it touches; ``width`` near the usual length of spans keeps these few.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    cut = spans.withColumn("_b", F.explode(F.sequence(bucket(low), F.greatest(bucket(low), F.floor((F.col(high) - 1) / width)))))
    return points.withColumn("_b", bucket(point)).join(cut, "_b").filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_b")


def top_k(table: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps k rows a group before it shuffles. Adds ``rank``."""
    return table.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def salted_sum(table: DataFrame, key: str, value: str, salts: int = 16) -> DataFrame:
    """``key, n, total`` by two levels of grouping, for keys that hold a large share of all rows."""
    part = table.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy(key, "_salt").agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return part.groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
