"""Closure, entailment, checks and measures, on graphs with planted faults."""

import pytest

from loomgraph.functions.terms import RDF_TYPE, TRIPLE, XSD
from loomgraph.operators import graph as G
from loomgraph.operators import reasoning as R
from loomgraph.sources.ontology import read_ontology

ONTOLOGY = """@prefix : <http://o#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix skos: <http://www.w3.org/2004/02/skos/core#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:Thing a owl:Class ; rdfs:comment "c"@en ; skos:definition "d"@en .
:A a owl:Class ; rdfs:subClassOf :Thing ; rdfs:comment "c"@en ; owl:disjointWith :B .
:B a owl:Class ; rdfs:subClassOf :Thing . :AA a owl:Class ; rdfs:subClassOf :A . :C a owl:Class .
:near a owl:ObjectProperty ; rdfs:domain [ a owl:Class ; owl:unionOf ( :A :C ) ] ; rdfs:range :B ; skos:exactMatch <http://x/near> .
:both a owl:ObjectProperty ; rdfs:domain :A , :B . :unused a owl:DatatypeProperty .
:size a owl:DatatypeProperty ; rdfs:range xsd:decimal .
"""


def iri(s, p, o):
    return (f"http://d/{s}", RDF_TYPE if p == "a" else f"http://o#{p}", f"http://o#{o}" if p == "a" else f"http://d/{o}", "iri", None, None, "t")


def number(s, o, kind="decimal"):
    return (f"http://d/{s}", "http://o#size", o, "literal", XSD + kind, None, "t")


@pytest.fixture(scope="module")
def onto(spark):
    return read_ontology(spark, ONTOLOGY)


@pytest.fixture(scope="module")
def triples(spark):
    rows = [iri("a", "a", "AA"), iri("b", "a", "B"), iri("ab", "a", "A"), iri("ab", "a", "B"), iri("lone", "a", "C"), iri("odd", "a", "Nope")]
    rows += [iri("a", "near", "b"), iri("b", "near", "a"), iri("x", "near", "b"), iri("a", "near", "gone"), iri("a", "both", "b"), iri("ab", "both", "b")]
    rows += [number("a", "4.20"), number("b", "x"), number("ab", "1", "integer")]
    return spark.createDataFrame(rows, TRIPLE).cache()


def closed(onto):
    return R.closure(onto.class_edges)


def names(df, *columns):
    cut = lambda v: v.rpartition("#")[2].rpartition("/")[2] if isinstance(v, str) else v
    return sorted(tuple(cut(v) for v in r) for r in df.select(*columns).collect())


def test_closure_is_transitive_irreflexive_and_ends_on_cycles(spark, onto):
    assert names(closed(onto), "sub", "super", "depth") == [("A", "Thing", 1), ("AA", "A", 1), ("AA", "Thing", 2), ("B", "Thing", 1)]
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "sub string, super string")
    assert names(R.closure(ring), "sub", "super") == [(x, y) for x in "abc" for y in "abc" if x != y]
    assert R.closure(ring.limit(0)).count() == 0


def test_entailment(triples, onto):
    got = names(R.entailed(triples, closed(onto)), "s", "class")
    assert [c for s, c in got if s == "a"] == ["A", "AA", "Thing"]
    assert [c for s, c in got if s == "odd"] == ["Nope"]


def test_domain_and_range_tell_violations_from_unknowns(triples, onto):
    got = {(s, o): v for s, p, o, v in names(R.check_side(triples, onto.sides, closed(onto), "domain"), "s", "p", "o", "verdict") if p == "near"}
    assert got == {("a", "b"): "ok", ("b", "a"): "violation", ("x", "b"): "unknown", ("a", "gone"): "ok"}
    got = {(s, o): v for s, p, o, v in names(R.check_side(triples, onto.sides, closed(onto), "range"), "s", "p", "o", "verdict")}
    assert got == {("a", "b"): "ok", ("b", "a"): "violation", ("x", "b"): "ok", ("a", "gone"): "unknown"}


def test_several_domains_are_any_of_unless_strict(triples, onto):
    side = lambda strict: {s: v for s, p, v in names(R.check_side(triples, onto.sides, closed(onto), "domain", strict), "s", "p", "verdict") if p == "both"}
    assert side(False) == {"a": "ok", "ab": "ok"}
    assert side(True) == {"a": "violation", "ab": "ok"}


def test_literals_dangling_disjoint_unknown_unmapped_notes(triples, onto):
    assert names(R.check_literals(triples, onto.sides), "s", "problem") == [("ab", "datatype"), ("b", "lexical")]
    assert names(R.dangling(triples, "http://d/"), "s", "o") == [("a", "gone")]
    assert names(R.disjoint_violations(triples, onto.disjoint, closed(onto)), "s", "a", "b") == [("ab", "A", "B")]
    assert names(R.unknown_classes(triples, onto.terms), "class", "n") == [("Nope", 1)]
    assert names(R.unmapped_properties(onto.terms, triples), "iri") == [("unused",)]
    missing = names(R.missing_notes(onto.terms, onto.notes, ["http://www.w3.org/2000/01/rdf-schema#comment"]), "iri")
    assert ("A",) not in missing and ("AA",) in missing


def test_measures(triples):
    assert dict(names(G.degree(triples), "node", "degree"))["a"] == 4
    assert names(G.isolated(triples), "node") == [("lone",), ("odd",)]
    assert tuple(G.connectivity(triples).first())[:2] == (5, 2)
    assert G.connectivity(triples.limit(0)).first()["ratio"] is None


def test_components_on_chains_rings_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (5, 5), (9, 200), (200, 1)]
    got = dict(names(G.connected_components(spark.createDataFrame(chain, "a int, b int")), "node", "component"))
    assert {got[i] for i in range(100, 161)} == {100}
    assert (got[7], got[3], got[5], got[9], got[200], got[1]) == (3, 3, 5, 1, 1, 1)


def test_k_hop_takes_fewest_steps(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "a string, b string")
    start = spark.createDataFrame([("a",)], "node string")
    assert names(G.k_hop(edges, start, 3), "node", "hops") == [("a", 0), ("b", 1), ("c", 1)]


def test_k_hop_plans_grow_by_a_table_a_hop(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)], "a string, b string")
    start = spark.createDataFrame([("0",)], "node string")
    leaves = lambda k: G.k_hop(edges, start, k)._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert [leaves(k) for k in (2, 4, 8)] == [3, 5, 9]
    assert names(G.k_hop(edges, start, 99), "node", "hops") == sorted((str(i), i) for i in range(13))


def test_lineage_over_paths_that_meet_and_cycles(spark):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "x"), ("x", "a"), ("a", "a"), ("p", "q"), ("q", "p"), ("d", "b")], "a string, b string")
    want = [("a", "a", 1), ("b", "a", 1), ("c", "a", 2), ("c", "x", 1), ("d", "a", 2), ("d", "b", 1), ("d", "c", 1), ("d", "x", 2), ("p", "p", 2), ("p", "q", 1), ("q", "p", 1), ("q", "q", 2), ("x", "a", 1)]
    assert names(G.lineage(edges), "node", "ancestor", "steps") == want
    assert G.lineage(edges.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        G.lineage(edges, most=1)


def test_category_rollup(spark):
    rows = [iri("a", "kind", "t"), iri("b", "kind", "t"), iri("b", "kind", "t"), iri("c", "kind", "u"), iri("a", "near", "x"), iri("a", "near", "y"), iri("c", "a", "A")]
    got = names(G.category_rollup(spark.createDataFrame(rows, TRIPLE), "http://o#kind"), "category", "n", "n_links")
    assert got == [("t", 2, 2), ("u", 1, 0)]


def test_histogram_counts_sets_of_classes(triples, onto):
    got = {c: (a, e) for c, a, e in names(R.rollup_histogram(triples, closed(onto)), "class", "asserted", "entailed")}
    assert got == {"AA": (1, 1), "A": (1, 2), "B": (2, 2), "C": (1, 1), "Thing": (0, 3), "Nope": (1, 1)}
    plan = R.rollup_histogram(triples, closed(onto))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") <= 2


def test_unfinished_rounds_raise_and_settled_tables_go(spark):
    import os

    from loomgraph.sources import shared

    edges = spark.createDataFrame([(i, i + 1) for i in range(70)], "a int, b int")
    with pytest.raises(RuntimeError):
        G.connected_components(edges, most=1)
    first = shared.settle(edges)
    path = shared.SETTLED[first].removeprefix("file://")
    second = shared.settle(first, first)
    assert not os.path.exists(path) and second.count() == 70


def test_best_match_and_reciprocal(spark):
    m = spark.createDataFrame([("n", "closeMatch", "z"), ("n", "exactMatch", "b"), ("n", "exactMatch", "a"), ("k", "relatedMatch", "q")], "iri string, match string, external_iri string")
    assert names(G.best_match(m), "iri", "match", "external_iri") == [("k", "relatedMatch", "q"), ("n", "exactMatch", "a")]
    l, r = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int"), spark.createDataFrame([(2, 1), (6, 5)], "a int, b int")  # noqa: E741
    assert names(G.reciprocal(l, r), "a", "b", "side") == [(3, 4, "left"), (5, 6, "right")]
