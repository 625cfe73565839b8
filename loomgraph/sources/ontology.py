"""Ontologies as small DataFrames."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .turtle import RDF, Blank, Iri, Literal, Term, parse

OWL, RDFS, SKOS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2004/02/skos/core#"
KINDS = {OWL + "Class": "class", OWL + "ObjectProperty": "object_property", OWL + "DatatypeProperty": "datatype_property"}
NOTES = (RDFS + "label", RDFS + "comment", SKOS + "definition")
MATCHES = ("exactMatch", "closeMatch", "broadMatch", "narrowMatch", "relatedMatch")


@dataclass(frozen=True)
class Ontology:
    """``terms`` (iri, kind), ``class_edges`` (sub, super), ``sides`` (property, side, choice, class), ``disjoint`` (a, b),
    ``notes`` (iri, note, text, lang) and ``matches`` (iri, match, external_iri).

    ``side`` is domain or range. Classes of one ``choice`` are alternatives (a union); several choices of a side are
    alternatives as well, unless a check is told to be strict.
    """

    terms: DataFrame
    class_edges: DataFrame
    sides: DataFrame
    disjoint: DataFrame
    notes: DataFrame
    matches: DataFrame


def read_ontology(spark: SparkSession, text: str) -> Ontology:
    """Load a Turtle ontology. An ontology is a few thousand statements, parsed on the driver."""
    about: dict[Term, dict[str, list[Term]]] = defaultdict(lambda: defaultdict(list))
    for s, p, o in parse(text):
        about[s][p].append(o)

    def members(node: Term) -> list[str]:
        if isinstance(node, Iri):
            return [node.value]
        out, cell = [], about[node][OWL + "unionOf"][0] if about[node][OWL + "unionOf"] else None
        while isinstance(cell, Blank):
            out += members(about[cell][RDF + "first"][0])
            cell = about[cell][RDF + "rest"][0]
        return out

    terms, edges, sides, disjoint, notes, matches = [], [], [], [], [], []
    for s in [x for x in list(about) if isinstance(x, Iri)]:
        for kind in {KINDS[t.value] for t in about[s][RDF + "type"] if isinstance(t, Iri) and t.value in KINDS}:
            terms.append((s.value, kind))
        edges += [(s.value, o.value) for o in about[s][RDFS + "subClassOf"] if isinstance(o, Iri)]
        for side in ("domain", "range"):
            for choice, o in enumerate(about[s][RDFS + side]):
                sides += [(s.value, side, choice, c) for c in members(o)]
        disjoint += [(s.value, o.value) for o in about[s][OWL + "disjointWith"] if isinstance(o, Iri)]
        for p in NOTES:
            notes += [(s.value, p, o.value, o.lang) for o in about[s][p] if isinstance(o, Literal)]
        for name in MATCHES:
            matches += [(s.value, name, o.value) for o in about[s][SKOS + name] if isinstance(o, Iri)]
    return Ontology(
        spark.createDataFrame(terms, "iri string, kind string"),
        spark.createDataFrame(edges, "sub string, super string"),
        spark.createDataFrame(sides, "property string, side string, choice int, class string"),
        spark.createDataFrame(disjoint, "a string, b string"),
        spark.createDataFrame(notes, "iri string, note string, text string, lang string"),
        spark.createDataFrame(matches, "iri string, match string, external_iri string"),
    )


def graph_ontology(triples: DataFrame) -> Ontology:
    """The ontology that a graph states itself, of any size: nothing comes to the driver. Lists of alternatives (blank nodes) are left
    to ``read_ontology``; each stated class of a side is a choice of its own."""
    of = lambda *names: triples.filter(F.col("p").isin(*names))
    iris = lambda *names: of(*names).filter("o_kind = 'iri'")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    side = F.regexp_extract("p", "[a-z]+$", 0)
    return Ontology(
        iris(RDF + "type").select(F.col("s").alias("iri"), F.try_element_at(kind, F.col("o")).alias("kind")).filter("kind is not null").distinct(),
        iris(RDFS + "subClassOf").select(F.col("s").alias("sub"), F.col("o").alias("super")).distinct(),
        iris(RDFS + "domain", RDFS + "range").select(F.col("s").alias("property"), side.alias("side"), F.xxhash64("o").cast("int").alias("choice"), F.col("o").alias("class")).distinct(),
        iris(OWL + "disjointWith").select(F.col("s").alias("a"), F.col("o").alias("b")).distinct(),
        of(*NOTES).filter("o_kind = 'literal'").select(F.col("s").alias("iri"), F.col("p").alias("note"), F.col("o").alias("text"), F.col("o_lang").alias("lang")).distinct(),
        iris(*(SKOS + m for m in MATCHES)).select(F.col("s").alias("iri"), F.substring_index("p", "#", -1).alias("match"), F.col("o").alias("external_iri")).distinct(),
    )


def used_terms(triples: DataFrame) -> DataFrame:
    """``iri, kind`` of the classes and properties that a graph uses: a property is an object property if it links to a node anywhere."""
    classes = triples.filter(F.col("p") == RDF + "type").select(F.col("o").alias("iri"), F.lit("class").alias("kind")).distinct()
    links = triples.filter(F.col("p") != RDF + "type").groupBy(F.col("p").alias("iri")).agg(F.bool_or(F.col("o_kind") != "literal").alias("links"))
    return classes.union(links.select("iri", F.when(F.col("links"), "object_property").otherwise("datatype_property")))
