"""Graphs that grow: rules over streams of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.terms import IDENTITY
from ..plans.compiler import generate, triples_of
from ..sources.rules import Rule
from ..sources.shared import exists, passing, settle


def stream_triples(rows: DataFrame, rules: list[Rule], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Triples of a stream of rows, each once.

    With ``time``, state is dropped after ``late``: a triple that comes again within it is dropped, one that comes again
    after it may be sent again, which a set tolerates. Without, state grows with the graph.
    """
    if time is None:
        return generate(rows, rules).dropDuplicates(IDENTITY)
    marked = rows.withWatermark(time, late)
    flat = marked.select(F.col(time).alias("seen_at"), F.explode(triples_of(rules, marked.schema)).alias("t")).select("seen_at", "t.*")
    return flat.filter("s is not null and o is not null").dropDuplicatesWithinWatermark(IDENTITY)


#: Folders of a graph's first level, and the bytes that a folder holds before the next level, of twice as many, is begun.
BUCKETS, BUCKET_BYTES = 64, 64 << 20


def _levels(spark: SparkSession, path: str, buckets: int, size: int) -> tuple[list[int], int]:
    """The levels that a stored graph has, and the one that rows are added to: the first whose folders aren't full."""
    if not exists(spark, path):
        return [], 0
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    held = {int(x.getPath().getName().partition("=")[2]): files.getContentSummary(x.getPath()).getLength() for x in files.listStatus(hadoop) if x.getPath().getName().startswith("level=")}
    last = max(held, default=0)
    return sorted(held), last + (held.get(last, 0) >= (buckets << last) * size)


def append_new(stream: DataFrame, path: str, checkpoint: str, once: bool = True, buckets: int = BUCKETS, size: int = BUCKET_BYTES) -> StreamingQuery:
    """Append to the graph at ``path`` what it lacks, batch by batch. A batch that runs again finds its triples there.

    The graph lies in folders by ``level`` and by ``bucket``, the subjects' hashes; a batch reads those alone that its own subjects fall
    into, and of them the columns that tell triples apart. Each level has twice the last one's folders, and is begun as those are
    full: folders keep their size as the graph grows, so that what a batch reads grows with its own subjects and the number of levels (the
    logarithm of the graph). Nothing is written anew.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        levels, now = _levels(spark, path, buckets, size)
        bucket = lambda level: F.pmod(F.xxhash64("s"), F.lit(buckets << level)).cast("int")
        with passing(spark):
            new = settle(batch.dropDuplicates(IDENTITY))
            left, stored = new, T.StructType([*new.schema.fields, T.StructField("level", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
            for level in levels:
                marked = new.select(bucket(level).alias("bucket")).distinct()
                touched = [r[0] for r in marked.collect()]  # no more than the level has folders
                old = spark.read.schema(stored).option("basePath", path).parquet(f"{path}/level={level}").filter(F.col("bucket").isin(touched)).select(*IDENTITY)
                left = left.join(old, [left[c].eqNullSafe(old[c]) for c in IDENTITY], "left_anti")
            fresh_ = left.withColumn("level", F.lit(now)).withColumn("bucket", bucket(now))
            fresh_.hint("rebalance", "bucket").write.mode("append").partitionBy("level", "bucket").parquet(path)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """``start, key, n`` in tumbling windows; windows close ``late`` after their end."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """``key, start, end, n`` of sessions that ``gap`` without events ends."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
