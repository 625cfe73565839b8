"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest, over_batches, settle, small, spare, utf8

SEED = 42
#: Links at so many differing bits or fewer: one half of two such fingerprints then differs in at most two.
DISTANCE = 4
#: The bits set in each byte value, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """The SimHash of a text's word shingles: a bit is 1 if it is set in over half their hashes; no words give 0."""
    tokens = text.lower().split()  # bytes: lower() and split() know ASCII only
    if not tokens:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(tokens[i : i + words]), SEED) for i in range(max(1, len(tokens) - words + 1))], dtype="<u8")
    columns = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 200:
        counts = np.unpackbits(columns, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4) -> DataFrame:
    """``doc_id, fp`` of whole texts; the fingerprint's 64 bits as a long."""

    def make():
        def apply(batch: pa.RecordBatch) -> dict:
            found = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "fp": np.array(found, dtype=np.uint64).view(np.int64)}

        return apply

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_batches(docs.select("doc_id", utf8(text).alias("_t")), f"doc_id {kind}, fp bigint", "_t", make)


def _half(fp: Column, k: int) -> Column:
    """Half k of a fingerprint, tagged with k in a bit of its own, so that both tables share one key column."""
    return (fp if k == 0 else F.shiftrightunsigned(fp, 32)).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(k << 32))


def _balls(fps: DataFrame) -> DataFrame:
    """``key, fp``: each half of a fingerprint and all values one bit from it, 66 rows.

    Two halves differ in at most two bits if and only if these balls meet, so radius 1 on either side does
    the work of radius 2 on one, with 33 keys a half instead of 529, and each table keeps 32 bits of selectivity.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b) for b in range(32)])
    ball = lambda half: F.transform(flips, lambda f: half.bitwiseXOR(f))
    keys = F.concat(ball(_half(F.col("fp"), 0)), ball(_half(F.col("fp"), 1)))
    return fps.select(F.explode(keys).alias("key"), "fp")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """All pairs ``a, b`` (a < b) of different fingerprints at ``distance`` (4 at most) or fewer differing bits."""
    if distance > DISTANCE:
        raise ValueError("balls of radius 1 in two halves find at most 4 differing bits")
    balls = _balls(fps)
    left, right = balls.withColumnRenamed("fp", "a"), balls.withColumnRenamed("fp", "b")
    own = lambda c: F.when(F.col("key") < F.lit(1 << 32), _half(F.col(c), 0)).otherwise(_half(F.col(c), 1))
    # Equal halves meet at 33 keys and are taken at the exact one alone.
    met = (own("a") != own("b")) | (own("a") == F.col("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    # Spark takes a ball for as large as its fingerprint, and would broadcast 66 times what it reckons with.
    return left.join(right.hint("merge"), "key").filter((F.col("a") < F.col("b")) & met & near).select("a", "b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on the smallest node around it.

    The smallest is a partial aggregate, and comes back by a join whose long side adaptive execution may split: a node
    with very many neighbours is no task of its own.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.least("a", "m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of these. Edges come as a < b, and leave so."""
    lowest = edges.groupBy("b").agg(F.min("a").alias("m"))
    # The row whose a is m, which each b has, stands for (m, b); the others hang a itself on m.
    return edges.join(lowest, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()


def components(edges: DataFrame, most: int = 200) -> DataFrame:
    """``node, root``: the smallest node reachable over ``edges`` (a < b), for every node that has any.

    Alternating large and small stars shrink the graph to one star a component, in rounds that grow with the logarithm of
    its size; no round holds more edges than the one before, and nothing but a checksum comes to the driver. Unfinished after
    ``most`` rounds, it raises.
    """
    now, seen = edges.select("a", "b"), None
    for _ in range(most):
        now = settle(_small_star(_large_star(now)), now)
        sums = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if sums == seen:
            break
        seen = sums
    else:
        raise RuntimeError(f"the components did not settle after {most} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)


def simhash_groups(docs: DataFrame, text: str = "text", words: int = 4, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id, n_links`` for each row of ``docs``; ``root`` numbers components.

    Exact copies share a fingerprint and meet as one node, so a group of copies costs one row. Null or empty texts have
    fingerprint 0 and are linked like others. ``component_id`` is the smallest doc_id reachable; ``n_links`` counts other
    fingerprints linked directly. Repeated rows each get a row; a null doc_id is grouped but never names a group.
    """
    prints = settle(fingerprints(docs, text, words))
    known = _grouped(prints, distance)
    # A hot fingerprint is split by adaptive execution: this side of the left join may be cut at will.
    found = prints.join(known, "fp", "left")
    return found.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def _grouped(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp, root, component_id, n_links`` of each fingerprint: ``root`` is the smallest one reachable."""
    nodes = settle(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("label")))
    edges = settle(links(nodes.select(F.col("node").alias("fp")), distance))
    roots = settle(components(edges))
    least = settle(roots.join(nodes, "node").groupBy("root").agg(F.min("label").alias("joined")))
    joined = settle(roots.join(small(least), "root").select("node", "root", "joined"))
    degree = settle(edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links")))
    known = nodes.join(small(joined), "node", "left").join(small(degree), "node", "left")
    return known.select(F.col("node").alias("fp"), F.coalesce("root", "node").alias("root"), F.coalesce("joined", "label").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Keep of each group the row of the smallest doc_id, of these the one whose text has the smallest digest.

    Rows are told apart by id and text, so texts that share an id are judged each by itself; of rows that agree in
    both, one is kept. Rows with a null doc_id can't be named as copies and stay. Texts are shuffled only where kept rows repeat,
    or where those to drop are too many to broadcast.
    """
    name = spare(docs, "_key")
    marked = docs.withColumn(name, F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), F.coalesce(digest(text), F.lit("")).alias("digest"))))
    prints = settle(fingerprints(marked.filter(F.col(name).isNotNull()).select(F.col(name).alias("doc_id"), F.col(text).alias("text"))))
    groups = prints.join(_grouped(prints).select("fp", "component_id"), "fp", "left")
    each = settle(groups.groupBy(F.col("doc_id").alias(name), (F.col("doc_id") == F.col("component_id")).alias("first")).agg(F.count("*").alias("n")))
    copies, again = small(settle(each.filter("not first").select(name))), small(settle(each.filter("first and n > 1").select(name)))
    left = marked.join(copies, name, "left_anti")
    once = left.join(again, name, "left_anti").select(docs.columns)
    return once.union(left.join(again, name, "left_semi").dropDuplicates([name]).select(docs.columns))
