"""JSON as VARIANT: parsed once, read by typed paths, and laid out as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed_once(table: DataFrame, column: str, name: str | None = None, strict: bool = False) -> DataFrame:
    """``column`` as a VARIANT (called ``name``, or as before). Text that is no JSON is null, or raises if ``strict``."""
    return table.withColumn(name or column, (F.parse_json if strict else F.try_parse_json)(F.col(column)))


def at(column: str, path: str, kind: str, strict: bool = False) -> Column:
    """The value at a JSONPath as a type; null where it is missing, or (unless ``strict``) of another form."""
    return (F.variant_get if strict else F.try_variant_get)(F.col(column), path, kind)


def shredded(table: DataFrame, column: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Beside a VARIANT, columns by name for some (path, type): what is stored so is read, pruned and pushed down like any column."""
    return table.withColumns({name: at(column, path, kind) for name, (path, kind) in paths.items()})


def shapes(table: DataFrame, column: str) -> DataFrame:
    """``shape``: the one schema that all values of a VARIANT fit, merged in Spark without bringing rows to the driver."""
    return table.agg(F.schema_of_variant_agg(column).alias("shape"))


def entries(table: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """A row for each top-level key of a VARIANT that is an object, or element of one that is a list: ``keep``, ``pos``, ``key``, ``value``."""
    return table.lateralJoin(table.sparkSession.tvf.variant_explode(F.col(column).outer())).select(*keep, "pos", "key", "value")
