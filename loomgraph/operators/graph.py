"""Graph measures and algorithms over triples and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, identity
from ..plans.paths import Seen
from ..sources.shared import settle


def links(triples: DataFrame) -> DataFrame:
    """``s, p, o`` between nodes: IRIs, types left out."""
    return triples.filter((F.col("o_kind") == "iri") & (F.col("p") != RDF_TYPE)).select("s", "p", "o")


def degree(triples: DataFrame) -> DataFrame:
    """``node, degree``: links in and out. Both ends of a link come from one scan; sums are partial before the shuffle."""
    return links(triples).select(F.explode(F.array("s", "o")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def entities(triples: DataFrame) -> DataFrame:
    """``node``: what has a type."""
    return triples.filter(F.col("p") == RDF_TYPE).select(F.col("s").alias("node")).distinct()


def isolated(triples: DataFrame) -> DataFrame:
    """``node``: entities without a link."""
    return entities(triples).join(degree(triples).hint("merge"), "node", "left_anti")


def connectivity(triples: DataFrame) -> DataFrame:
    """``entities, unlinked, ratio``: the share of entities with a link, over one join."""
    flagged = entities(triples).join(degree(triples).hint("merge"), "node", "left")
    counted = flagged.agg(F.count("*").alias("entities"), F.count_if(F.col("degree").isNull()).alias("unlinked"))
    return counted.select("entities", "unlinked", F.try_divide(F.col("entities") - F.col("unlinked"), F.col("entities")).alias("ratio"))


def connected_components(edges: DataFrame, most: int = 200) -> DataFrame:
    """``node, component`` for all nodes of ``edges`` (a, b): the smallest node reachable.

    Alternating stars: each node hangs its larger neighbours, then its smaller ones, on the smallest node around it. No
    round has more edges than the one before. Smallest nodes are partial aggregates, joined back; a node with very many
    neighbours is skew that adaptive execution splits. Unfinished after ``most`` rounds, it raises.
    """
    loops = edges.filter("a = b").select(F.col("a").alias("node")).distinct()
    now = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    seen = None
    for _ in range(most):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.least("a", "m").alias("a"), "b").distinct()
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        now = settle(large.join(lowest, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct(), now)
        sums = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if sums == seen:
            break
        seen = sums
    else:
        raise RuntimeError(f"the components did not settle after {most} rounds")
    found = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    found = found.union(now.select("a", F.col("a").alias("component")).distinct())
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(alone)


def _reached(edges: DataFrame, first: DataFrame, most: int, source: str) -> tuple[DataFrame, int]:
    """Pairs (``source``, node, hops) along ``edges`` (a, b), from ``first`` until nothing is new, and the number of rounds.

    Each round joins the last round's pairs alone, and leaves out what earlier rounds have, which are put together now and then.
    """
    seen = Seen(first, [source, "node"])
    onward = edges.select(F.col("a").alias("node"), F.col("b").alias("_next"))
    for hop in range(1, most + 1):
        step = seen.last.join(onward, "node").select(source, F.col("_next").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        if not seen.add(step):
            return seen.all(), hop
    return seen.all(), most + 1


def k_hop(edges: DataFrame, start: DataFrame, k: int) -> DataFrame:
    """``start, node, hops``: nodes within ``k`` directed steps of ``start`` (node), at their fewest steps."""
    first = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"))
    return _reached(edges, first, k, "start")[0]


def lineage(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """``node, ancestor, steps`` over ``edges`` (a derives from b): every ancestor once, at its fewest steps.

    Nodes may derive from several, by paths of different lengths; a node on a cycle is an ancestor of itself. Rounds are as
    many as the longest shortest path, and end by themselves; deeper than ``most`` raises.
    """
    pairs = settle(edges.select("a", "b").distinct())
    first = pairs.select(F.col("a").alias("source"), F.col("b").alias("node"), F.lit(1).alias("hops"))
    found, rounds = _reached(pairs, first, most, "source")
    if rounds > most:
        raise RuntimeError(f"the lineage is deeper than {most} steps")
    return found.select(F.col("source").alias("node"), F.col("node").alias("ancestor"), F.col("hops").alias("steps"))


def category_rollup(triples: DataFrame, predicate: str) -> DataFrame:
    """``category, n, n_links``: how many nodes a link of the same class gathers under a shared node, and the links these have.

    Such a link (a case to the shared case that it is one of) is an ordinary edge, and no type.
    """
    cases = triples.filter(F.col("p") == predicate).select(F.col("s").alias("case"), F.col("o").alias("category")).distinct()
    out = links(triples).filter(F.col("p") != predicate).groupBy(F.col("s").alias("case")).agg(F.count("*").alias("n"))
    joined = cases.join(out, "case", "left")
    return joined.groupBy("category").agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"))


def predicate_histogram(triples: DataFrame) -> DataFrame:
    """``p, n, n_subjects``."""
    return triples.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("n_subjects"))


def reciprocal(left: DataFrame, right: DataFrame) -> DataFrame:
    """``a, b, side``: pairs that one of two relations has and the other, reversed, has not."""
    l, r = left.select("a", "b").distinct().withColumn("l", F.lit(1)), right.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct().withColumn("r", F.lit(1))  # noqa: E741
    return l.join(r, ["a", "b"], "full").filter("l is null or r is null").select("a", "b", F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


#: SKOS matches by strength, strongest first.
MATCHES = ["exactMatch", "closeMatch", "broadMatch", "narrowMatch", "relatedMatch"]


def best_match(matches: DataFrame) -> DataFrame:
    """``iri, match, external_iri``: for each node its strongest match, of equals the first by IRI."""
    rank = F.array_position(F.array(*[F.lit(m) for m in MATCHES]), F.col("match"))
    return matches.groupBy("iri").agg(F.min(F.struct(rank.alias("rank"), "external_iri", "match")).alias("best")).select("iri", "best.match", "best.external_iri")


def merge_aligned(triples: DataFrame, same: str, prefer: str | None = None) -> DataFrame:
    """The graph with nodes that ``same`` (a predicate of equality, in either direction and over any number of steps) joins as one.

    Each group goes by its smallest name, of those below ``prefer`` if there are any; links of ``same`` go, triples that become equal
    are one, and ``src`` is the smallest of theirs. Only nodes of a group look for a name: of all others triples stay where they are.
    Groups come from ``connected_components``, so that long chains and large groups are no task's own.
    """
    links_ = triples.filter((F.col("p") == same) & (F.col("o_kind") != "literal")).select(F.col("s").alias("a"), F.col("o").alias("b"))
    found = settle(connected_components(links_))
    own = F.lit(True) if prefer is None else F.col("node").startswith(prefer)
    # What is preferred comes first, then the smallest.
    first = found.groupBy("component").agg(F.min(F.struct((~own).alias("other"), "node"))["node"].alias("name"))
    names = settle(found.join(first, "component").filter("node <> name").select("node", "name"))
    out = triples.filter((F.col("p") != same) | (F.col("o_kind") == "literal"))
    for c in ("s", "o"):
        # Literals are no nodes; they don't take part in the join, so that a common one is no hot key.
        part = out if c == "s" else out.filter("o_kind <> 'literal'")
        rest = None if c == "s" else out.filter("o_kind = 'literal'")
        named = part.join(names.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("name", c)).drop("name").select(triples.columns)
        out = named if rest is None else named.unionByName(rest)
    return out.groupBy(*identity(triples.columns)).agg(F.min("src").alias("src"))
