"""Tables that rules read: CSV files with all columns as text, or Parquet."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import settle


class MissingSource(FileNotFoundError):
    """Sources that rules name and that aren't there."""


#: Files larger than this are cut at quotes in two passes, where cells may hold line breaks.
CUT_BYTES = 256 << 20
_CSV = {"header": "false", "escape": '"', "mode": "FAILFAST"}


def read_csv(spark: SparkSession, paths: list[str] | str, columns: list[str], multi_line: bool = True, cut: int = CUT_BYTES) -> DataFrame:
    """Rows of CSV files with a header. Columns are text: a number keeps its form. Empty cells are null, backslashes mean nothing.

    Quoted cells may hold line breaks, so a file of up to ``cut`` bytes is one task's, many files are many tasks'; where a file is larger,
    all are read by ``read_cut_csv``. Where no cell holds one, ``multi_line`` may be false: then Spark cuts large files as well.
    """
    if multi_line and max(_sizes(spark, [paths] if isinstance(paths, str) else paths), default=0) > cut:
        return read_cut_csv(spark, paths, columns)
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("encoding", "UTF-8").option("enforceSchema", True).option("multiLine", multi_line).csv(paths)


def _sizes(spark: SparkSession, paths: list[str]) -> list[int]:
    """Bytes of the files at paths, and in folders there."""
    out = []
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(hadoop):
            out += [x.getLen() for x in files.listStatus(hadoop) if x.isFile()]
    return out


def read_cut_csv(spark: SparkSession, paths: list[str] | str, columns: list[str]) -> DataFrame:
    """The rows that ``read_csv`` gives, of files of any size: Spark cuts them at line ends, wherever these lie.

    A first pass counts the quotes of each block of a file; running sums say which blocks begin within a quoted cell. A second puts
    lines together to records, block by block. What a block has of a record that began before it, and of one that ends after
    it, are pieces, at most two a block, that a grouping joins. The first record of a file is its header.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    opened = settle(counted.select("file", "block", (before % 2 == 1).alias("inside")))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, inside, started, header = None, [], False, False, False
        out: list[tuple] = []

        def close(ended: bool) -> None:
            """What is held is a whole record, or a piece: of a record begun before, or that goes on."""
            nonlocal held, started, header
            if held and not header:
                kind = "whole" if started and ended else "head" if started else "tail" if ended else "middle"
                out.append((*at, kind, "\n".join(held)))
            held, started, header = [], True, False

        for batch in batches:
            for value, file, block, begun in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != at:
                    if at is not None:
                        close(not inside)
                    at, inside, started, header = (file, block), begun, not begun, block == 0
                held.append(value)
                if value.count('"') % 2:
                    inside = not inside
                if not inside:
                    close(True)
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pydict(dict(zip(("file", "block", "kind", "value"), zip(*out), strict=True)))
                    out = []
        if at is not None:
            close(not inside)
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("file", "block", "kind", "value"), zip(*out), strict=True)))

    # The join with so few rows keeps the lines' order, as does the pass over them.
    marked = lines.join(F.broadcast(opened), ["file", "block"]).select("value", "file", "block", "inside")
    found = marked.mapInArrow(records, "file string, block bigint, kind string, value string")
    whole = found.filter("kind = 'whole'").select("file", "block", "value")
    pieces = settle(found.filter("kind <> 'whole'"))
    run = F.count_if(F.col("kind") == "head").over(W.partitionBy("file").orderBy("block", F.col("kind") == "head"))
    joined = pieces.withColumn("run", run).filter("run > 0").groupBy("file", "run").agg(F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts"))
    joined = joined.select("file", "block", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    text = F.rtrim("value", F.lit("\r"))
    rows = whole.union(joined).filter(F.length(F.trim(text)) > 0)
    schema = ", ".join(f"`{c}` string" for c in columns)
    return rows.select(F.from_csv(text, schema, _CSV).alias("r")).select("r.*")


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names in the first line of a CSV file, or of a folder's first one, read on the driver without a job."""
    jvm, hadoop = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(hadoop).isDirectory():
        hadoop = min((x.getPath() for x in files.listStatus(hadoop) if x.getPath().getName()[0] not in "_." and x.getLen()), key=lambda x: x.getName())
    stream = files.open(hadoop)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()
    return next(csv.reader([line]), [])


def read_listed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV rows with ``listed``, their order: graphs are sets, so what depends on order is settled before.

    Rows are in the order of their file, and files of a folder in that of their names, as a sorted table is written. Within a file ids
    grow along it, in and between the parts that Spark cuts it into.
    """
    rows = read_csv(spark, path, columns, cut=1 << 62)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("listed", place)


def first_listed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """For each key the value listed first."""
    return rows.groupBy(key).agg(F.min_by(value, "listed").alias(value))
