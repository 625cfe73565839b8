"""Entailed classes that are kept up to date as types and class edges come and go, without reading the graph again.

Each node's class is held with the number of its stated classes that imply it; a change adds and subtracts such numbers for its own
consequences alone. What is stored only grows by rows: a change writes the differences it makes, as a version of its own, and a
small file names the last version that is whole. A change that stops half way has no effect, and may be made again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import exists, read_text, remove, write_text
from .reasoning import closure, dimension, reflexive

STATED, COUNTS, EDGES = "stated", "counts", "edges"
TYPES, LINKS = "s string, class string", "sub string, super string"


@dataclass(frozen=True)
class Head:
    """The versions that count: from ``base`` (put together of all before) to ``last``. ``edges`` names the class edges' table."""

    base: int
    last: int
    edges: str
    buckets: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("s"), F.lit(buckets)).cast("int")


class MaintainedTypes:
    """Stated types and the classes they imply, stored below a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def create(spark: SparkSession, path: str, types: DataFrame, edges: DataFrame, buckets: int = 16) -> MaintainedTypes:
        """Begin with types (s, class) and class edges (sub, super). Nulls are left out, repeated rows count once."""
        own = MaintainedTypes(spark, path)
        own._write_edges(edges.select("sub", "super").dropna().distinct(), name := uuid.uuid4().hex)
        own._commit(Head(0, 0, name, buckets))
        own.change(added=types)
        return own

    # What is stored.

    def head(self) -> Head:
        return Head(**json.loads(read_text(self.spark, f"{self.path}/head.json")))

    def _commit(self, head: Head) -> None:
        write_text(self.spark, f"{self.path}/head.json", json.dumps(head.__dict__))

    def _write_edges(self, edges: DataFrame, name: str) -> None:
        edges.write.mode("overwrite").parquet(f"{self.path}/{EDGES}/{name}")

    def edges(self) -> DataFrame:
        return self.spark.read.schema(LINKS).parquet(f"{self.path}/{EDGES}/{self.head().edges}")

    def _deltas(self, what: str, head: Head) -> DataFrame:
        """Differences (s, class, d) of all versions that count. Folders are by version, class and bucket of the node, so that filters
        on these choose files."""
        schema = "s string, d bigint, version int, class string, bucket int"
        if not exists(self.spark, f"{self.path}/{what}"):
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(f"{self.path}/{what}")
        return read.filter(F.col("version").between(head.base, head.last))

    def _append(self, what: str, deltas: DataFrame, version: int, buckets: int) -> None:
        """Write a version's differences; one that was left half written is replaced."""
        target = f"{self.path}/{what}/version={version}"
        marked = deltas.withColumn("bucket", _bucket(buckets))
        # Rebalancing cuts classes that very many nodes have.
        marked.hint("rebalance", "class", "bucket").sortWithinPartitions("class", "bucket", "s").write.mode("overwrite").partitionBy("class", "bucket").parquet(target)

    def stated(self) -> DataFrame:
        """``s, class`` as stated now."""
        return self._deltas(STATED, self.head()).groupBy("s", "class").agg(F.sum("d").alias("d")).filter("d > 0").select("s", "class")

    def counts(self) -> DataFrame:
        """``s, class, n``: how many stated classes of a node imply a class of it."""
        return self._deltas(COUNTS, self.head()).groupBy("s", "class").agg(F.sum("d").alias("n")).filter("n > 0")

    def current(self) -> DataFrame:
        """``s, class`` stated or implied now."""
        return self.counts().select("s", "class")

    def instances(self, cls: str) -> DataFrame:
        """``s`` of a class, stated or implied: its own folders are read."""
        found = self._deltas(COUNTS, self.head()).filter(F.col("class") == cls)
        return found.groupBy("s").agg(F.sum("d").alias("n")).filter("n > 0").select("s")

    # Changes.

    def _touched(self, types: DataFrame, head: Head) -> DataFrame:
        """What is stated of the classes, in the buckets, that some types fall into. These are as many as classes times buckets at
        most, and choose the folders that are read."""
        places = [tuple(r) for r in types.select("class", _bucket(head.buckets)).distinct().collect()]
        there = self._deltas(STATED, head)
        if not places:
            return there.limit(0).select("s", "class", "d")
        own = there.filter(F.col("class").isin(sorted({c for c, _ in places})) & F.col("bucket").isin(sorted({b for _, b in places})))
        return own.groupBy("s", "class").agg(F.sum("d").alias("d")).filter("d > 0")

    def _differences(self, added: DataFrame | None, removed: DataFrame | None, head: Head) -> DataFrame:
        """``s, class, d``: types that become stated (1) and that cease to be (-1). A type that is both removed and added is there after."""
        none = self.spark.createDataFrame([], TYPES)
        new, gone = (x.select("s", "class").dropna() if x is not None else none for x in (added, removed))
        wish = new.withColumn("want", F.lit(1)).union(gone.withColumn("want", F.lit(0))).groupBy("s", "class").agg(F.max("want").alias("want"))
        have = self._touched(wish, head).select("s", "class", F.lit(1).alias("have"))
        return wish.join(have, ["s", "class"], "left").select("s", "class", (F.col("want") - F.coalesce("have", F.lit(0))).cast("bigint").alias("d")).filter("d <> 0")

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None, edges_added: DataFrame | None = None, edges_removed: DataFrame | None = None) -> DataFrame:
        """Add and remove types (s, class) and class edges (sub, super), and return what that does: ``s, class, d``, where d is the
        change of the number of stated classes that imply the class.

        Removals of what isn't there, and additions of what is, do nothing. New counts are old ones, plus changed types under the new
        closure, plus types as they were under the closure's difference: so only changed types, and nodes of classes whose
        superclasses change, are looked at.
        """
        head = self.head()
        version = head.last + 1
        types = self._differences(added, removed, head)
        self._append(STATED, types, version, head.buckets)
        types = self.spark.read.schema("s string, d bigint, class string, bucket int").parquet(f"{self.path}/{STATED}/version={version}").select("s", "class", "d")
        before, name = self.edges(), head.edges
        after = before
        if edges_added is not None or edges_removed is not None:
            if edges_removed is not None:
                after = after.join(edges_removed.select("sub", "super"), ["sub", "super"], "left_anti")
            if edges_added is not None:
                after = after.union(edges_added.select("sub", "super").dropna()).distinct()
            self._write_edges(after, name := uuid.uuid4().hex)
            after = self.spark.read.schema(LINKS).parquet(f"{self.path}/{EDGES}/{name}")
        # A class that has no relatives implies itself.
        new_up = reflexive(closure(after)).filter("sub <> super")
        parts = [types, types.join(dimension(new_up), F.col("class") == F.col("sub")).select("s", F.col("super").alias("class"), "d")]
        if name != head.edges:
            old_up = reflexive(closure(before)).filter("sub <> super")
            moved = new_up.withColumn("e", F.lit(1)).union(old_up.withColumn("e", F.lit(-1))).groupBy("sub", "super").agg(F.sum("e").alias("e")).filter("e <> 0")
            classes = [r[0] for r in moved.select("sub").distinct().collect()]
            if classes:
                own = self._deltas(STATED, head).filter(F.col("class").isin(classes)).groupBy("s", "class").agg(F.sum("d").alias("d")).filter("d > 0")
                parts.append(own.join(dimension(moved), F.col("class") == F.col("sub")).select("s", F.col("super").alias("class"), F.col("e").cast("bigint").alias("d")))
        deltas = parts[0]
        for p in parts[1:]:
            deltas = deltas.union(p)
        self._append(COUNTS, deltas.groupBy("s", "class").agg(F.sum("d").alias("d")).filter("d <> 0"), version, head.buckets)
        self._commit(Head(head.base, version, name, head.buckets))
        return self.spark.read.schema("s string, d bigint, class string, bucket int").parquet(f"{self.path}/{COUNTS}/version={version}").select("s", "class", "d")

    def compact(self) -> None:
        """Put all versions together, so that reads don't grow with the number of changes. Readers of older versions must have ended."""
        head = self.head()
        if head.base == head.last:
            return
        version = head.last + 1
        for what, now in ((STATED, self.stated().withColumn("d", F.lit(1).cast("bigint"))), (COUNTS, self.counts().withColumnRenamed("n", "d"))):
            self._append(what, now, version, head.buckets)
        self._commit(Head(version, version, head.edges, head.buckets))
        for what in (STATED, COUNTS):
            for old in range(head.base, version):
                remove(self.spark, f"{self.path}/{what}/version={old}")
