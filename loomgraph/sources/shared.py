"""The folder that driver and executors share, and tables and texts in it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: What this process has made in the shared folder and not removed, oldest first; and where settled tables lie.
MADE: dict[str, None] = {}
SETTLED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a folder of its own; on a cluster that would
    lie on one machine's disk, so it raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.loomgraph.shared", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.loomgraph.shared", folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet. ``release`` removes what comes to lie there."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    MADE[path] = None
    return path


def settle(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """Cut lineage by a table in the shared folder. ``instead`` is a settled table that this one replaces; its files go."""
    spark = df.sparkSession
    path = fresh(spark, "graph")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    SETTLED[out] = path
    if instead is not None and instead in SETTLED:
        remove(spark, SETTLED.pop(instead))
    return out


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system Spark reads it from."""
    files, at = _at(spark, path)
    return files.exists(at)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path is a file, and no folder of files."""
    files, at = _at(spark, path)
    return files.getFileStatus(at).isFile()


def file_size(spark: SparkSession, path: str) -> int:
    """A file's bytes, by the URI that Spark gives it."""
    from urllib.parse import unquote

    files, at = _at(spark, unquote(path))
    return files.getFileStatus(at).getLen()


def remove(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)
    MADE.pop(path, None)


def release(spark: SparkSession, keep: Iterable[DataFrame] = (), since: int = 0) -> None:
    """Remove what this process has made in the shared folder, but for the first ``since`` of it and the settled tables to ``keep``.

    Results are plans that read these tables, also where Python has forgotten them: write a result before what it reads goes.
    """
    kept = {SETTLED[df] for df in keep}
    for path in list(MADE)[since:]:
        if path not in kept:
            remove(spark, path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """What is made in the shared folder within goes at the end, but for settled tables that are put into the list given."""
    since, keep = len(MADE), []
    try:
        yield keep
    finally:
        release(spark, keep, since)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file: from any file system that Spark reads where the path names one, else from the driver's disk."""
    if "://" not in path and not path.startswith("file:"):
        with open(path, "rb") as file:
            return file.read()
    files, at = _at(spark, path)
    stream = files.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, from any file system that Spark reads."""
    files, at = _at(spark, path)
    return read_bytes(spark, files.makeQualified(at).toString()).decode("utf-8")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file."""
    files, at = _at(spark, path)
    stream = files.create(at)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
