"""Blank nodes: names that follow from a graph's own form, and differences of graphs that don't depend on how blank nodes are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import identity
from ..sources.shared import settle
from .reasoning import dimension

#: Bits of the map that tells which nodes may need a name.
BITS = 1 << 24


def _blank(c: str) -> Column:
    return F.col(c).startswith("_:")


def _blank_in(triples: DataFrame, c: str) -> Column:
    """Whether a triple's subject or object is a blank node; a literal may begin like a blank node's name."""
    return _blank(c) & F.coalesce(F.col("o_kind") != "literal", F.lit(True)) if c == "o" and "o_kind" in triples.columns else _blank(c)


def _coloured(triples: DataFrame, graph: list[str], most: int) -> DataFrame:
    """``colours`` of triples that are there once each, colours as bytes; of several graphs, told apart by the columns ``graph``, in the same rounds.

    What no round changes, the triples of a blank node with no other one, is summed once. Rounds move the links between blank
    nodes alone; without these there are none.
    """
    keys = [c for c in identity(triples.columns) if c not in ("s", "o")]
    told = triples.withColumn("o", F.when(_blank("o") & ~_blank_in(triples, "o"), F.concat(F.lit("\2"), "o")).otherwise(F.col("o")))
    side = lambda own, other: told.filter(_blank(own)).select(*graph, F.col(own).alias("node"), F.when(_blank(other), F.col(other)).alias("near"), F.concat_ws("\0", F.lit(own), *[F.coalesce(k, F.lit("\1")) for k in keys], F.when(~_blank(other), F.col(other))).alias("rest"), (F.col("s") == F.col("o")).alias("loop"))
    around = side("s", "o").union(side("o", "s"))
    node, moving = [*graph, "node"], F.col("near").isNotNull() & ~F.col("loop")
    sums = lambda piece, where: [F.coalesce(F.sum(F.when(where, F.xxhash64(piece, F.lit(i)).cast("decimal(38,0)"))), F.lit(0)).alias(f"_{i}") for i in range(2)]
    digest = lambda *parts: F.unhex(F.md5(F.concat_ws(",", *parts)))
    still = around.groupBy(*node).agg(*sums(F.concat_ws("\0", "rest", F.when(F.col("loop"), "itself").otherwise("\1")), ~moving), F.count("*").alias("_n"))
    now = settle(still.select(*node, digest("_n", "_0", "_1").alias("colour")))
    links = settle(around.filter(moving).drop("loop"))
    if links.isEmpty():
        return now
    known = now.select("colour").distinct().count()
    for _ in range(most):
        near = links.join(now.withColumnsRenamed({"node": "near", "colour": "_near"}), [*graph, "near"])
        summed = near.groupBy(*node).agg(*sums(F.concat_ws("\0", "rest", F.hex("_near")), F.lit(True)))
        # The colour before is part of the next one: nodes once told apart stay so.
        new = now.join(summed, node, "left").select(*node, F.when(F.col("_0").isNull(), F.col("colour")).otherwise(digest(F.hex("colour"), "_0", "_1")).alias("colour"))
        now = settle(new, now)
        n = now.select("colour").distinct().count()
        if n == known:
            return now
        known = n
    raise RuntimeError(f"the colours did not settle after {most} rounds")


def colours(triples: DataFrame, most: int = 1000) -> DataFrame:
    """``node, colour`` of the blank nodes of a graph (a set of triples or quads).

    A node's colour is a digest of the triples around it, in which other blank nodes stand by their colours of the round before. Rounds end when
    they tell no further nodes apart; each is a sum of 128-bit hashes by node, so that hubs are pre-aggregated. Nodes that differ only
    in ways that no such round sees (as in regular graphs of equal degrees) share a colour.
    """
    found = _coloured(settle(triples.select(*identity(triples.columns)).distinct()), [], most)
    return found.select("node", F.lower(F.hex("colour")).alias("colour"))


def _place(graph: list[str], c: str) -> Column:
    return F.pmod(F.xxhash64(*graph, c), F.lit(BITS))


def _sieve(names: DataFrame, graph: list[str]) -> DataFrame:
    """A bit for each node's hash, 2 MB in all at most."""
    at = _place(graph, "node")
    return names.groupBy(F.bitmap_bucket_number(at).alias("_at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))


def _sieved(triples: DataFrame, sieve: DataFrame, graph: list[str], c: str) -> DataFrame:
    """Triples whose node's bit is set, without a shuffle of the others."""
    at = F.bitmap_bit_position(_place(graph, c))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.bitmap_bucket_number(_place(graph, c)) == F.col("_at")
    return triples.join(F.broadcast(sieve), held & (byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0), "left_semi")


def _named(triples: DataFrame, names: DataFrame, graph: list[str], sieve: DataFrame | None = None) -> DataFrame:
    """Triples with blank nodes called by their colours; those whose nodes have none go."""
    out = triples
    for c in ("s", "o"):
        mine = names.select(*graph, F.col("node").alias(c), F.concat(F.lit("_:c"), F.lower(F.hex("colour"))).alias("_name"))
        blank = _blank_in(triples, c)
        # Only blank nodes look for a name, so that no other node is a hot key of the join.
        found = out.filter(blank) if sieve is None else _sieved(out.filter(blank), sieve, graph, c)
        out = out.filter(~blank).withColumn("_name", F.lit(None).cast("string")).unionByName(found.join(mine, [*graph, c]))
        out = out.withColumn(c, F.coalesce("_name", c)).drop("_name")
    return out.select(triples.columns)


def canonical(triples: DataFrame) -> DataFrame:
    """The graph with blank nodes called by their colours. Nodes of the same colour get the same name, so that triples may repeat."""
    return _named(triples, colours(triples).withColumn("colour", F.unhex("colour")), [])


def diff_graphs(left: DataFrame, right: DataFrame, most: int = 1000) -> DataFrame:
    """Triples that one of two graphs has more often, blank nodes called by their colours: with ``side`` and ``n``, how many more.

    Graphs that differ only by their blank nodes' names don't differ. Where nodes share a colour, their triples are compared by number.
    Both graphs are coloured in the same rounds. A colour that as many nodes have on either side has the same triples around it there,
    so only triples whose blank nodes all have other colours are named and compared.
    """
    own = identity([*left.columns, *right.columns])
    wide = lambda df, d: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in own]).repartition("s").distinct().withColumn("d", F.lit(d))
    # By subject, so that what a task sums of a node is nearly all of it.
    both = settle(wide(left, 1).union(wide(right, -1)))
    named = _coloured(both, ["d"], most)
    uneven = settle(named.groupBy("colour").agg(F.sum("d").alias("n")).filter("n <> 0").select("colour"))
    names = settle(named.join(dimension(uneven), "colour"))
    few = dimension(names)
    tagged = _named(both, few, ["d"], None if few is not names else _sieve(names, ["d"]))
    more = tagged.groupBy(*own).agg(F.sum("d").alias("d")).filter("d <> 0")
    return more.select(*own, F.when(F.col("d") > 0, "left").otherwise("right").alias("side"), F.abs("d").alias("n"))
