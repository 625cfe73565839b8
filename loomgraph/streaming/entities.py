"""Streams of entities: the newest row of each key, as additions and retractions; and joins of streams within a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Newest(StatefulProcessor):
    """Keeps one row a key. Rows travel as JSON text beside their rank, so that any columns can be kept."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "at long, rank string, row string")

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:
        # Every call asks the JVM; there is none for what isn't there but this.
        found = self.kept.get()
        best = have = None if found is None else tuple(found)
        for row in rows:
            if best is None or (row["at"], row["rank"]) > best[:2]:
                best = (row["at"], row["rank"], row["row"])
        if best is have:
            return
        self.kept.update(best)
        if self.idle_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            # A timer that lies behind the watermark would never ring.
            self.handle.registerTimer(max(best[0], timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        out = [(best[2], 1)] if have is None else [(have[2], -1), (best[2], 1)] if have[2] != best[2] else []
        yield from (Row(row=row, d=d) for row, d in out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Any]:
        self.kept.clear()
        yield from ()

    def close(self) -> None:
        pass


#: Rows of a task that are looked at together before they go to their keys' states.
TOGETHER = 1 << 17


def _newest_of_many(batches: Iterator[Any]) -> Iterator[Any]:
    """Of up to about TOGETHER rows at a time (key, at, rank, row, time), the newest of each key. A row costs a state far more than it costs here."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def newest(held: list[Any]) -> Iterator[Any]:
        table = pa.Table.from_batches(held)
        order = pc.sort_indices(table, sort_keys=[("key", "ascending"), ("at", "descending"), ("rank", "descending")])
        keys = table.column("key").combine_chunks().take(order)
        first = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))
        yield from table.take(order.filter(pa.concat_arrays([pa.array([True]), first]))).combine_chunks().to_batches()

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= TOGETHER:
            yield from newest(held)
            held, n = [], 0
    if held:
        yield from newest(held)


def entity_changes(rows: DataFrame, key: str, time: str, revision: str | None = None, late: str = "1 hour", idle_seconds: int = 0) -> DataFrame:
    """The columns of ``rows`` and ``d``: 1 for a row that is a key's newest, -1 for one that no longer is.

    Newest is the latest ``time``, then the largest ``revision``, then the largest row as text, so that the order in which rows come
    makes no difference: the sum of ``d`` by row is the table of newest rows. Rows that come again change nothing; a late row
    does if it is newer than what is known, as a correction is by its revision. Rows without a key or time are left out. With
    ``idle_seconds`` a key's state goes that long (in event time) after its newest row; a row that comes later counts as new. The state
    store is RocksDB, and state lives with the stream's checkpoint.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    marked = rows.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    # Revisions of any whole number are compared as text of one length, shifted so that negative ones come first.
    rank = F.lit("") if revision is None else F.lpad((F.coalesce(F.col(revision), F.lit(-(1 << 62))).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    slim = marked.select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(time).cast("timestamp")).alias("at"), F.concat(rank, row).alias("rank"), row.alias("row"), time)
    # A key's rows meet in one task and few of them are left: the newest of all is among them, with the latest time for the watermark.
    slim = slim.repartition("key").mapInArrow(_newest_of_many, slim.schema).withWatermark(time, late)
    out = slim.groupBy("key").transformWithState(_Newest(idle_seconds * 1000), "row string, d int", "Append", "EventTime" if idle_seconds else "None")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    read = F.from_json("row", schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return out.select(read.alias("r"), "d").select("r.*", "d")


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, within: str, left_late: str | None = "1 hour", right_late: str | None = "1 hour", how: str = "inner") -> DataFrame:
    """Left rows with the right rows of the same ``on`` whose time lies from theirs on until ``within`` later (both ends count).

    Both streams have watermarks (None: one that is there already), and the condition bounds their times against each other, so that either side's state goes as time
    passes. Of batches the same rows are joined. With ``how="leftOuter"`` left rows without a partner come once none can come any
    more. Columns of the right side that clash get the suffix ``_right``.
    """
    a = left if left_late is None else left.withWatermark(left_time, left_late)
    renamed = {c: f"{c}_right" for c in right.columns if c in left.columns}
    b = (right if right_late is None else right.withWatermark(right_time, right_late)).withColumnsRenamed(renamed)
    name = lambda c: renamed.get(c, c)
    same = [F.col(c) == F.col(name(c)) for c in on]
    near = (F.col(name(right_time)) >= F.col(left_time)) & (F.col(name(right_time)) <= F.col(left_time) + F.expr(f"INTERVAL {within}"))
    condition = near
    for s in same:
        condition = s & condition
    return a.join(b, condition, how)
