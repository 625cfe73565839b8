"""Turtle, rules, options, and the building of graphs from CSV."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.terms import RDF_TYPE, XSD
from loomgraph.plans.compiler import build_csv, dedupe, is_relation, store
from loomgraph.sources.config import read_config
from loomgraph.sources.ntriples import diff, read_ntriples
from loomgraph.sources.rules import UnsupportedRule, read_rules
from loomgraph.sources.tables import MissingSource, first_listed, read_listed
from loomgraph.sources.turtle import Iri, Literal, TurtleError, parse

HEAD = """@prefix rr: <http://www.w3.org/ns/r2rml#> .
@prefix rml: <http://semweb.mmlab.be/ns/rml#> .
@prefix ql: <http://semweb.mmlab.be/ns/ql#> .
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
@base <http://m/> .
"""


def rule(name, source, key, objects):
    pairs = " ; ".join(f"rr:predicateObjectMap [ rr:predicate {p} ; rr:objectMap [ {o} ] ]" for p, o in objects)
    return f'<#{name}> a rr:TriplesMap ; rml:logicalSource [ rml:source "{source}" ; rml:referenceFormulation ql:CSV ] ; rr:subjectMap [ rr:template "http://d/{{{key}}}" ] ; {pairs} .\n'


UNITS = rule("units", "e/units.csv", "id", [("rdf:type", "rr:constant <http://o/Unit>"), ("<http://o/name>", 'rml:reference "name"'), ("<http://o/size>", 'rml:reference "size" ; rr:datatype <http://www.w3.org/2001/XMLSchema#decimal>')])
TYPES = rule("types", "e/types.csv", "id", [("rdf:type", 'rr:template "http://o/{cls}" ; rr:termType rr:IRI')])
LINK = rule("has_unit", "r/has_unit.csv", "obs", [("<http://o/hasUnit>", 'rr:template "http://d/{unit}" ; rr:termType rr:IRI')])
ALIGN = rule("align", "a/exact.csv", "node", [("<http://www.w3.org/2004/02/skos/core#exactMatch>", 'rml:reference "iri" ; rr:termType rr:IRI')])
GONE = rule("gone", "e/gone.csv", "id", [("rdf:type", "rr:constant <http://o/Gone>")])


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    top = tmp_path_factory.mktemp("with space")
    for path, text in {
        "e/units.csv": 'id,name,size\r\nm,"metre, ""long""",4.2150\r\ns,a\\b,\r\nx y,,1e\r\n"z","two\nlines, and\n\nmore",7\r\n',
        "e/types.csv": "id,cls\r\nm,Unit\r\nm,Length\r\n",
        "r/has_unit.csv": "obs,unit\r\no1,m\r\no2,s\r\n,m\r\no3,\r\n",
        "a/exact.csv": "node,iri\r\nm,http://x.org/M?a=1&b=2\r\n",
    }.items():
        (top / path).parent.mkdir(exist_ok=True)
        (top / path).write_bytes(text.encode())
    return str(top)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_turtle_reads_lists_languages_and_nested_nodes():
    triples = parse('@prefix : <http://x#> . :a :p "é\\n\\u0041"@en, 4.5, true ; :q [ :r ( :b :c ) ] ; . # end\n')
    assert (Iri("http://x#a"), "http://x#p", Literal("é\nA", lang="en")) in triples
    assert sum(p.endswith("first") for _, p, _ in triples) == 2
    assert parse("") == []


@pytest.mark.parametrize("text", ["@prefix : <x> . :a :b", ":a :b :c .", "<a> <b> ] .", "<a> <b> \x00 ."])
def test_turtle_refuses_what_it_cannot_read(text):
    with pytest.raises(TurtleError):
        parse(text)


def test_rules_have_every_shape():
    rules = {r.name: r for r in read_rules(HEAD + UNITS + TYPES + LINK + ALIGN)}
    assert rules["units"].columns() == ["id", "name", "size"]
    assert [o.iri for o in rules["units"].objects] == [True, False, False]
    assert rules["units"].objects[1].datatype == XSD + "string"
    assert rules["align"].objects[0].iri and rules["align"].objects[0].reference == "iri"
    assert [is_relation(rules[n]) for n in ("units", "types", "has_unit", "align")] == [False, True, True, True]


@pytest.mark.parametrize("bad", ["rr:joinCondition [ ]", "rr:language \"en\"", 'rr:template "a" ; rml:reference "b"', "rr:termType rr:BlankNode ; rml:reference \"b\""])
def test_unknown_rule_terms_raise(bad):
    with pytest.raises(UnsupportedRule):
        read_rules(HEAD + rule("r", "x.csv", "id", [("rdf:type", bad)]))


def test_build_keeps_lexical_forms_and_drops_blanks(spark, base):
    built = build_csv(spark, read_rules(HEAD + UNITS + TYPES + LINK + ALIGN + GONE), base)
    assert built.missing == ["e/gone.csv"]
    graph = built.graph()
    got = rows(graph, "s", "p", "o", "o_kind")
    assert ("http://d/m", "http://o/size", "4.2150", "literal") in got
    assert ("http://d/m", "http://o/name", 'metre, "long"', "literal") in got
    assert ("http://d/s", "http://o/name", "a\\b", "literal") in got
    assert ("http://d/z", "http://o/name", "two\nlines, and\n\nmore", "literal") in got
    assert ("http://d/x%20y", RDF_TYPE, "http://o/Unit", "iri") in got
    assert ("http://d/m", "http://www.w3.org/2004/02/skos/core#exactMatch", "http://x.org/M?a=1&b=2", "iri") in got
    assert [x for x in got if x[1] == "http://o/hasUnit"] == [("http://d/o1", "http://o/hasUnit", "http://d/m", "iri"), ("http://d/o2", "http://o/hasUnit", "http://d/s", "iri")]
    assert built.triples.count() == graph.count() + 1  # Unit is stated of m by two rules
    assert rows(dedupe(graph), "s", "p", "o", "src") == rows(graph, "s", "p", "o", "src")


def test_strict_build_names_missing_sources(spark, base):
    with pytest.raises(MissingSource, match="gone"):
        build_csv(spark, read_rules(HEAD + UNITS + GONE), base, strict=True)
    assert build_csv(spark, read_rules(HEAD + GONE), base).triples.count() == 0


def test_building_distributes_over_rules(spark, base):
    both = build_csv(spark, read_rules(HEAD + UNITS + TYPES), base).graph()
    apart = build_csv(spark, read_rules(HEAD + UNITS), base).triples.union(build_csv(spark, read_rules(HEAD + TYPES), base).triples)
    assert rows(both, "s", "p", "o") == rows(dedupe(apart), "s", "p", "o")


def test_one_scan_serves_all_rules_of_a_source(spark, base):
    text = HEAD + UNITS + rule("more", "e/units.csv", "id", [("<http://o/label>", 'rml:reference "name"')])
    plan = build_csv(spark, read_rules(text), base).triples._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1


def test_store_is_read_by_predicate(spark, base, tmp_path):
    store(build_csv(spark, read_rules(HEAD + UNITS + LINK), base).graph(), str(tmp_path / "g"))
    part = spark.read.parquet(str(tmp_path / "g")).filter("p = 'http://o/hasUnit'")
    assert part.count() == 2
    assert "PartitionFilters: [isnotnull(p" in part._jdf.queryExecution().executedPlan().toString()


def test_config():
    text = "[default]\nmain_directory: .\n[datasets]\nnumber_of_datasets: 1\noutput_folder: ./out\nremove_duplicate: yes\nordered: no\nname: g\n[dataset1]\nname: g\nmapping: ./m.ttl\n"
    got = read_config(text)
    assert (got.mappings, got.output_folder, got.remove_duplicate, got.recorded) == (("./m.ttl",), "./out", True, (("ordered", "no"),))
    with pytest.raises(ValueError):
        read_config(text.replace("datasets: 1", "datasets: 2"))


def test_build_from_options_writes_lines_once(spark, base, tmp_path):
    from loomgraph.build import build

    (tmp_path / "rml").mkdir()
    (tmp_path / "rml" / "m.ttl").write_text(HEAD + UNITS + TYPES + LINK + ALIGN + GONE)
    (tmp_path / "rml" / "c.ini").write_text("[datasets]\nnumber_of_datasets: 1\noutput_folder: ./kg\nremove_duplicate: yes\nall_in_one_file: yes\nname: g\n[dataset1]\nmapping: ./rml/m.ttl\n")
    for part in ("e", "r", "a"):
        (tmp_path / part).symlink_to(f"{base}/{part}")
    report = build(spark, str(tmp_path / "rml" / "c.ini"), parquet=str(tmp_path / "stored"))
    again = read_ntriples(spark, report.path)
    assert report.missing == ("e/gone.csv",) and report.triples == again.count() == again.distinct().count()
    assert diff(again, spark.read.parquet(str(tmp_path / "stored"))).count() == 0
    with pytest.raises(MissingSource):
        build(spark, str(tmp_path / "rml" / "c.ini"), strict=True)


def test_each_data_set_has_a_file(spark, base, tmp_path):
    from loomgraph.build import build

    (tmp_path / "rml").mkdir()
    (tmp_path / "rml" / "a.ttl").write_text(HEAD + UNITS)
    (tmp_path / "rml" / "b.ttl").write_text(HEAD + LINK)
    options = "[datasets]\nnumber_of_datasets: 2\noutput_folder: ./kg\nremove_duplicate: yes\nname: g\n[dataset1]\nname: first\nmapping: ./rml/a.ttl\n[dataset2]\nname: second\nmapping: ./rml/b.ttl\n"
    (tmp_path / "rml" / "c.ini").write_text(options)
    (tmp_path / "rml" / "one.ini").write_text(options.replace("name: g", "name: g\nall_in_one_file: yes"))
    for part in ("e", "r", "a"):
        (tmp_path / part).symlink_to(f"{base}/{part}")
    report = build(spark, str(tmp_path / "rml" / "c.ini"))
    assert [p.rpartition("/")[2] for p in report.paths] == ["first.nt", "second.nt"]
    apart = [read_ntriples(spark, p) for p in report.paths]
    assert {r.p for r in apart[1].collect()} == {"http://o/hasUnit"} and report.triples == sum(x.count() for x in apart)
    whole = build(spark, str(tmp_path / "rml" / "one.ini"))
    assert [p.rpartition("/")[2] for p in whole.paths] == ["g.nt"]
    assert diff(read_ntriples(spark, whole.path), apart[0].union(apart[1])).count() == 0


def test_relations_in_folders_are_read(spark, tmp_path):
    for part in ("one", "two"):
        (tmp_path / "r" / "has_unit.csv").mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / "has_unit.csv" / f"{part}.csv").write_text(f"obs,unit\n{part},m\n")
    assert rows(build_csv(spark, read_rules(HEAD + LINK), str(tmp_path)).triples, "s") == [("http://d/one",), ("http://d/two",)]


def test_numbers_keep_their_digits_without_exponents(spark):
    from decimal import Decimal

    from loomgraph.functions.terms import plain_number

    values = [0.12345, 1e17, 1.5e300, -2.5e-7, 1 / 3, 100.0, 0.0, 123456789.125, 1e7, 9999999.5, -1e-300, 1.7976931348623157e308, 5.0, 12345678901234567.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(plain_number(F.col("v"))).collect()]
    assert [float(x) for x in got] == values and not any("E" in x or "e" in x for x in got)
    plain = [format(Decimal(repr(v)), "f") for v in values]
    assert [Decimal(x) for x in got] == [Decimal(x) for x in plain] and got[:2] == ["0.12345", "100000000000000000.0"]
    assert [r[0] for r in spark.createDataFrame([(None,)], "v double").select(plain_number(F.col("v"))).collect()] == [None]


def test_a_synthetic_snapshot_has_its_known_figures(spark, tmp_path):
    """Repeated rows, one name for two things, keys that nothing describes, blank cells: what real tables hold."""
    from loomgraph.functions.terms import RDF_TYPE
    from loomgraph.operators import graph, reasoning

    files = {
        "e/study.csv": "id,title,year\ns1,A study,2001\ns2,\"Wind, and waves\",\ns3,A study,2003\ns3,A study,2003\n",
        "e/resource.csv": "id,cls\nwind,Resource\nsolar,Resource\n",
        "r/study_resource.csv": "study,resource\ns1,wind\ns1,solar\ns2,solar\ns2,hydro\ns3,wind\ns3,wind\n,wind\n",
        "r/heights.csv": "set,height\nd1,10.0\nd1,10.0\nd1,100.50\n",
    }
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    text = HEAD + rule("study", "e/study.csv", "id", [("rdf:type", "rr:constant <http://o/Study>"), ("<http://o/title>", 'rml:reference "title"'), ("<http://o/label>", 'rml:reference "title"'), ("<http://o/year>", 'rml:reference "year" ; rr:datatype <http://www.w3.org/2001/XMLSchema#gYear>')])
    text += rule("resource", "e/resource.csv", "id", [("rdf:type", 'rr:template "http://o/{cls}" ; rr:termType rr:IRI')])
    text += rule("uses", "r/study_resource.csv", "study", [("<http://o/uses>", 'rr:template "http://d/{resource}" ; rr:termType rr:IRI')])
    text += rule("heights", "r/heights.csv", "set", [("<http://o/height>", 'rml:reference "height" ; rr:datatype <http://www.w3.org/2001/XMLSchema#decimal>')])
    built = build_csv(spark, read_rules(text), str(tmp_path))
    g = built.graph()
    # 4 + 4 + 4 + 3 of studies, 2 of resources, 6 links, 3 heights; 4 and 1 and 1 of these are repeats.
    assert (built.triples.count(), g.count()) == (26, 20)
    assert graph.entities(g).count() == 5 and graph.links(g).count() == 5
    assert rows(reasoning.dangling(g, "http://d/"), "s", "o") == [("http://d/s2", "http://d/hydro")]
    assert tuple(graph.connectivity(g).first())[:2] == (5, 0)
    firsts = first_listed(read_listed(spark, str(tmp_path / "r/study_resource.csv"), ["study", "resource"]).filter("study is not null"), "study", "resource")
    assert rows(firsts.groupBy("resource").count(), "resource", "count") == [("solar", 1), ("wind", 2)]
    assert g.filter(F.col("p") == RDF_TYPE).count() == 5


def test_first_listed_follows_the_file(spark, tmp_path):
    (tmp_path / "l.csv").write_text("k,v\n" + "".join(f"{i % 50},{i}\n" for i in range(5000)))
    got = first_listed(read_listed(spark, str(tmp_path / "l.csv"), ["k", "v"]), "k", "v")
    assert {int(r.k): int(r.v) for r in got.collect()} == {k: k for k in range(50)}
