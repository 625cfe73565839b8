"""Class closure, type entailment, and the checks of a graph against its ontology.

Ontology tables are dimensions of at most some thousand rows, so they are broadcast; ``dimension`` checks that they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, valid_lexical
from ..sources.shared import settle

DIMENSION_ROWS, DIMENSION_BYTES = 100_000, 32 << 20


def dimension(table: DataFrame, rows: int = DIMENSION_ROWS, size: int = DIMENSION_BYTES) -> DataFrame:
    """Mark an ontology table for broadcast if it has at most ``rows`` rows and about ``size`` bytes; beyond, Spark shuffles the join."""
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])))
    n, held = table.agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(table) if n <= rows and (held or 0) <= size else table


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """``sub, super, depth`` for all strict ancestors, each once at its shortest depth. Cycles end, as pairs don't repeat.

    Pairs are joined with themselves, so that rounds grow with the logarithm of the depth.
    """
    pairs = settle(edges.select("sub", "super").filter("sub <> super").distinct().withColumn("depth", F.lit(1)))
    known = -1
    for _ in range(most):
        longer = pairs.alias("l").join(pairs.alias("r"), F.col("l.super") == F.col("r.sub")).select("l.sub", "r.super", (F.col("l.depth") + F.col("r.depth")).alias("depth"))
        pairs = settle(pairs.union(longer.filter("sub <> super")).groupBy("sub", "super").agg(F.min("depth").alias("depth")), pairs)
        n = pairs.agg(F.count("*"), F.sum("depth")).first()
        if n == known:
            return pairs
        known = n
    raise ValueError(f"the closure did not end after {most} rounds")


def reflexive(closed: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``sub, super`` with every class above itself; ``classes`` (iri) adds those without relatives."""
    named = closed.select(F.col("sub").alias("c")).union(closed.select("super"))
    named = named.union(classes.select("iri")) if classes is not None else named
    return closed.select("sub", "super").union(named.distinct().select("c", F.col("c").alias("super")))


def asserted(triples: DataFrame) -> DataFrame:
    """``s, class`` as stated."""
    return triples.filter(F.col("p") == RDF_TYPE).select("s", F.col("o").alias("class"))


def entailed(triples: DataFrame, closed: DataFrame) -> DataFrame:
    """``s, class`` stated or implied by superclasses, each once."""
    types = asserted(triples)
    up = dimension(closed.select("sub", "super"))
    return types.union(types.join(up, F.col("class") == F.col("sub")).select("s", F.col("super").alias("class"))).distinct()


def _types_of(triples: DataFrame, closed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each typed node with those of its classes, stated or implied, that ``wanted`` (class) has: one row a node, for one join.

    The closure is cut to those classes first, so that others are neither made nor shuffled.
    """
    up = closed.select("sub", "super").union(wanted.select("class", "class")).join(dimension(wanted), F.col("super") == F.col("class"), "left_semi").distinct()
    return asserted(triples).join(dimension(up), F.col("class") == F.col("sub"), "left").groupBy("s").agg(F.collect_set("super").alias("classes"))


def check_side(triples: DataFrame, sides: DataFrame, closed: DataFrame, side: str, strict: bool = False) -> DataFrame:
    """``s, p, o, node, verdict`` for each statement whose property declares classes on this side.

    Verdicts are ok, violation, and unknown for nodes without a type. Alternatives of a union are any-of; several
    declarations are any-of too, or all-of if ``strict``. Classes outside of the ontology's own tables (datatypes) are
    no business of this check: give it object properties' sides.
    """
    choices = sides.filter(F.col("side") == side).groupBy("property", "choice").agg(F.collect_set("class").alias("any"))
    wanted = choices.groupBy("property").agg(F.collect_list("any").alias("choices"))
    node = "s" if side == "domain" else "o"
    edges = triples.filter(F.col("o_kind") == "iri") if side == "range" else triples
    edges = edges.join(dimension(wanted), F.col("p") == F.col("property")).select("s", "p", "o", F.col(node).alias("node"), "choices")
    named = sides.filter(F.col("side") == side).select("class").distinct()
    types = _types_of(triples, closed, named).withColumnRenamed("s", "node")
    fits = F.forall if strict else F.exists
    verdict = F.when(F.col("classes").isNull(), "unknown").when(fits("choices", lambda c: F.arrays_overlap(c, F.col("classes"))), "ok").otherwise("violation")
    return edges.join(types, "node", "left").select("s", "p", "o", "node", verdict.alias("verdict"))


def check_literals(triples: DataFrame, sides: DataFrame) -> DataFrame:
    """``s, p, o, o_datatype, problem``: literals whose datatype isn't the declared range, or whose text isn't valid for it."""
    declared = sides.filter("side = 'range'").groupBy("property").agg(F.collect_set("class").alias("ranges"))
    literals = triples.filter(F.col("o_kind") == "literal").join(dimension(declared), F.col("p") == F.col("property"), "left")
    wrong = F.col("ranges").isNotNull() & ~F.array_contains("ranges", F.col("o_datatype"))
    problem = F.when(wrong, "datatype").when(~valid_lexical(F.col("o"), F.col("o_datatype")), "lexical")
    return literals.select("s", "p", "o", "o_datatype", problem.alias("problem")).filter("problem is not null")


def dangling(triples: DataFrame, prefix: str) -> DataFrame:
    """Links to nodes below ``prefix`` that have no type: their table isn't there, or lacks them.

    Nodes are as many as rows, and the size of what a row gives can't be told from its file's: both sides are shuffled, none is broadcast.
    """
    links = triples.filter((F.col("o_kind") == "iri") & F.col("o").startswith(prefix) & (F.col("p") != RDF_TYPE))
    known = asserted(triples).select(F.col("s").alias("known")).distinct().hint("merge")
    return links.join(known, F.col("o") == F.col("known"), "left_anti").select("s", "p", "o")


def disjoint_violations(triples: DataFrame, disjoint: DataFrame, closed: DataFrame) -> DataFrame:
    """``s, a, b``: nodes that are of both classes of a disjoint pair."""
    types = entailed(triples, closed)
    left = types.join(dimension(disjoint), F.col("class") == F.col("a")).select("s", "a", "b")
    return left.join(types, (left["s"] == types["s"]) & (left["b"] == types["class"]), "left_semi")


def unknown_classes(triples: DataFrame, terms: DataFrame) -> DataFrame:
    """``class, n``: classes that nodes have and the ontology lacks."""
    return asserted(triples).join(dimension(terms.filter("kind = 'class'")), F.col("class") == F.col("iri"), "left_anti").groupBy("class").agg(F.count("*").alias("n"))


def unmapped_properties(terms: DataFrame, triples: DataFrame) -> DataFrame:
    """``iri, kind``: declared properties that no triple uses."""
    used = triples.select("p").distinct()
    return terms.filter("kind <> 'class'").join(used, F.col("iri") == F.col("p"), "left_anti").select("iri", "kind")


def missing_notes(terms: DataFrame, notes: DataFrame, wanted: list[str]) -> DataFrame:
    """``iri, note``: annotations that a term lacks."""
    pairs = terms.select("iri").distinct().select("iri", F.explode(F.array(*[F.lit(w) for w in wanted])).alias("note"))
    return pairs.join(notes.select("iri", "note").distinct(), ["iri", "note"], "left_anti")


def rollup_histogram(triples: DataFrame, closed: DataFrame) -> DataFrame:
    """``class, asserted, entailed``: nodes of each class as stated, and with its subclasses' nodes.

    A node's classes are gathered once; nodes of the same classes are counted together, and what these imply is worked out
    for each such set alone, of which there are few.
    """
    sets = asserted(triples).groupBy("s").agg(F.sort_array(F.collect_set("class")).alias("classes")).groupBy("classes").agg(F.count("*").alias("n"))
    stated = sets.select("classes", "n", F.explode("classes").alias("class"))
    up = closed.select("sub", "super").union(closed.select(F.col("sub").alias("c")).union(closed.select("super")).distinct().select("c", F.col("c").alias("super")))
    implied = stated.join(dimension(up), F.col("class") == F.col("sub"), "left").select("classes", "n", F.coalesce("super", "class").alias("class")).distinct()
    asserted_ = stated.groupBy("class").agg(F.sum("n").alias("asserted"))
    return implied.groupBy("class").agg(F.sum("n").alias("entailed")).join(asserted_, "class", "left").select("class", F.coalesce("asserted", F.lit(0)).alias("asserted"), "entailed")


def all_violations(triples: DataFrame, sides: DataFrame, closed: DataFrame) -> DataFrame:
    """``check, n`` of domain and range violations and unknowns."""
    checks = [check_side(triples, sides, closed, side).groupBy("verdict").agg(F.count("*").alias("n")).select(F.concat_ws("_", F.lit(side), "verdict").alias("check"), "n") for side in ("domain", "range")]
    return reduce(DataFrame.union, checks)
