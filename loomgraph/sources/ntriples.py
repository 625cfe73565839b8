"""Graphs as N-Triples and N-Quads: lines out, lines in, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import GRAPH, XSD, escape, identity, unescape

NODE = r"(?:<([^>]*)>|(_:[^\s<>\"]+))"
#: No part goes back, so that long literals need no deep stack.
_TRIPLE = rf'^\s*{NODE}\s+<([^>]*)>\s+(?:{NODE}|"((?:[^"\\]++|\\.)*+)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)'
LINE = _TRIPLE + r"\s*\.\s*(?:#.*)?$"
QUAD = _TRIPLE + rf"(?:\s*{NODE})?\s*\.\s*(?:#.*)?$"


def line(graphs: bool = False) -> Column:
    """A triple's N-Triples line; with ``graphs`` a quad's N-Quads line, where the default graph has no name."""
    iri = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    text = F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_datatype").isNotNull() & (F.col("o_datatype") != XSD + "string"), F.concat(F.lit("^^"), iri("o_datatype"))).otherwise("")
    return F.concat_ws(" ", iri("s"), iri("p"), F.when(F.col("o_kind") != "literal", iri("o")).otherwise(F.concat(text, tail)), *([F.when(F.col(GRAPH).isNotNull(), iri(GRAPH))] if graphs else []), F.lit("."))


def write_ntriples(triples: DataFrame, path: str, one_file: bool = False) -> None:
    """Write lines in no order, quads where triples have a graph; ``one_file`` is for exports that a single task can write."""
    lines = triples.select(line(GRAPH in triples.columns).alias("value"))
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Read lines back. Comments and empty lines go; any other line that isn't a triple raises when it is reached."""
    return parse_lines(spark.read.text(path), LINE)


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """Read quads (or triples, of the default graph) back, with their graph as ``g``."""
    return parse_lines(spark.read.text(path), QUAD)


def parse_lines(lines: DataFrame, pattern: str = LINE) -> DataFrame:
    """Triples, or quads, of lines in a column ``value``."""
    rows = lines.filter(~F.col("value").rlike(r"^\s*(#|$)"))
    part = lambda k: F.regexp_extract("value", pattern, k)
    checked = rows.withColumn("value", F.when(F.col("value").rlike(pattern), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), F.col("value")))))
    literal = (part(4) == "") & (part(5) == "")
    some = lambda k: F.when(part(k) != "", part(k))
    node = lambda k: F.when(part(k + 1) != "", part(k + 1)).otherwise(unescape(part(k)))
    return checked.select(
        node(1).alias("s"),
        unescape(part(3)).alias("p"),
        F.when(literal, unescape(part(6))).otherwise(node(4)).alias("o"),
        F.when(literal, "literal").when(part(5) != "", "blank").otherwise("iri").alias("o_kind"),
        F.when(literal & (part(8) == ""), F.coalesce(some(7), F.lit(XSD + "string"))).alias("o_datatype"),
        F.when(literal, some(8)).alias("o_lang"),
        F.lit(None).cast("string").alias("src"),
        *([F.coalesce(some(10), unescape(some(9))).alias(GRAPH)] if pattern == QUAD else []),
    )


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Triples that only one of two graphs holds, with ``side`` left or right. One shuffle of both, counted by triple.

    Quads are told apart by their graph as well; a graph of triples is the default graph.
    """
    own = identity([*left.columns, *right.columns])
    all_ = lambda df: [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in own]
    tagged = left.select(*all_(left), F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(*all_(right), F.lit(0), F.lit(1)))
    sides = tagged.groupBy(*own).agg(F.max("l").alias("l"), F.max("r").alias("r")).filter("l <> r")
    return sides.select(*own, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))
