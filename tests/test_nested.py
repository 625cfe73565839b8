"""Rules over nested documents, rules that join, named graphs, and functions in rules."""

import json
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import calls
from loomgraph.plans.compiler import build_csv, build_tables, needs_join, own_parent, prune
from loomgraph.plans.fields import parsed, shape, steps
from loomgraph.queries import PREFIXES, mapping
from loomgraph.sources.ntriples import diff, read_nquads, read_ntriples, write_ntriples
from loomgraph.sources.rules import ObjectMap, Rule, UnsupportedRule, Value, call, read_rules

D = "http://d/"
JSON = "JSONPath"


def at(path):
    return f'rr:template "{D}{path}"'


def pair(predicate, term):
    return f"rr:predicate o:{predicate} ; rr:objectMap [ {term} ]"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


DOCS = [
    {"id": 1, "name": {"first": "A b"}, "tags": ["x", None, "y"], "parts": [{"n": "1.50", "subs": [{"k": 1e3}, {"k": 12345678901234567890}]}, {"n": None, "subs": None}]},
    {"id": 2, "name": None, "tags": None, "parts": None},
    {"id": None, "name": {"first": "C"}, "tags": [], "parts": [None, {"n": "2", "subs": [None, {}]}]},
]
RULES = PREFIXES + "".join([
    mapping("doc", "d.json", at("doc/{id}"), pair("first", 'rml:reference "name.first"'), pair("tag", "rml:reference \"$['tags'][*]\""), kind=JSON),
    mapping("part", "d.json", at("part/{n}"), pair("of", at("doc/{$.id}")), pair("sub", 'rml:reference "subs[*].k" ; rr:datatype xsd:decimal'), kind=JSON, more='; rml:iterator "$.parts[*]"'),
    mapping("sub", "d.json", at("sub/{k}"), pair("seen", 'rr:constant "yes" ; rr:termType rr:Literal'), kind=JSON, more='; rml:iterator "$.parts[*].subs[*]"'),
])


def test_documents_of_all_shapes(spark, tmp_path):
    (tmp_path / "d.json").write_text("\n".join(json.dumps(x) for x in DOCS) + "\n")
    built = build_csv(spark, read_rules(RULES), str(tmp_path))
    got = rows(built.triples, "s", "p", "o")
    numbers = [o for _, p, o in got if p.endswith("#sub")]
    assert numbers[1] == "12345678901234567890" and float(numbers[0]) == 1000
    k = re.sub("^.*/", "", next(s for s, p, _ in got if p.endswith("#seen") and "123456" not in s))
    o = "http://example.org/ontology#"
    assert got == sorted([
        (D + "doc/1", o + "first", "A b"), (D + "doc/1", o + "tag", "x"), (D + "doc/1", o + "tag", "y"),
        (D + "part/1.50", o + "of", D + "doc/1"), (D + "part/1.50", o + "sub", k), (D + "part/1.50", o + "sub", "12345678901234567890"),
        (D + f"sub/{k}", o + "seen", "yes"), (D + "sub/12345678901234567890", o + "seen", "yes"),
    ], key=repr)
    plan = built.triples._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1 and "more" not in plan


def test_lists_of_documents_and_whole_files(spark, tmp_path):
    """A list at the top has its elements as documents, in a line or (below ``*.docs``) in a file of many lines."""
    (tmp_path / "d.json").write_text(json.dumps(DOCS[:2]) + "\n" + json.dumps(DOCS[2]))
    (tmp_path / "e.docs").mkdir()
    (tmp_path / "e.docs" / "1.json").write_text(json.dumps(DOCS, indent=1))
    rules = read_rules(RULES)
    lines = rows(build_csv(spark, rules, str(tmp_path)).triples, "s", "p", "o")
    files = read_rules(RULES.replace("d.json", "e.docs").replace('"$.parts', '"$[*].parts'))
    assert len(lines) == 8 and rows(build_csv(spark, files, str(tmp_path)).triples, "s", "p", "o") == lines


def test_broken_documents_raise_and_null_texts_do_not(spark):
    rules = read_rules(RULES)
    texts = spark.createDataFrame([(json.dumps(DOCS[0]),), (None,), ("{}",)], "text string")
    assert build_tables(rules, {"d.json": parsed(texts, "text", rules)}).triples.count() == 8
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        build_tables(rules, {"d.json": parsed(spark.createDataFrame([("{'a",)], "text string"), "text", rules)}).triples.collect()


def test_shapes_come_from_rules():
    assert shape(read_rules(RULES)).simpleString() == "struct<id:string,name:struct<first:string>,tags:array<string>,parts:array<struct<n:string,subs:array<struct<k:string>>>>>"
    assert steps("$.a['b c'][*].d") == ["a", "b c", "*", "d"] and steps("@.x") == ["x"] and steps("$") == []
    for path in ("$..a", "$.a[0]", "$.a[?(@.b)]"):
        with pytest.raises(UnsupportedRule):
            steps(path)
    clash = PREFIXES + mapping("m", "x.json", at("{a}"), pair("p", 'rml:reference "b[*]"'), pair("q", 'rml:reference "b.c"'), kind=JSON)
    with pytest.raises(UnsupportedRule, match="list and as an object"):
        shape(read_rules(clash))
    with pytest.raises(UnsupportedRule, match="iterated"):
        read_rules(PREFIXES + mapping("m", "x", at("{a}"), more='; rml:iterator "$.a"'))


def join(parent, *columns):
    return f"rr:parentTriplesMap <#{parent}>" + "".join(f' ; rr:joinCondition [ rr:child "{a}" ; rr:parent "{b}" ]' for a, b in columns)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_only_where_they_are_needed(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, "c", 99), (4, "a", 10)], "id long, code string, ref long")
    right = spark.createDataFrame([(10, "X y", "10"), (10, "Z", "10"), (None, "N", None), (11, "W", "11")], "key long, name string, text string")
    tables = {"left": left, "right": right}
    head = mapping("other", "right", at("other/{key}")) + mapping("name", "right", at("name/{name}")) + mapping("code", "left", at("code/{code}"))
    build = lambda *pairs: build_tables(read_rules(PREFIXES + mapping("m", "left", at("m/{id}"), *pairs) + head), tables).triples
    semi = build(pair("p", join("other", ("ref", "key"))))
    assert rows(semi, "s", "o") == [(D + "m/1", D + "other/10"), (D + "m/4", D + "other/10")]
    assert plan_of(semi).count("LeftSemi") == 1 and plan_of(semi).count("Join") == 1
    inner = build(pair("p", join("name", ("ref", "key"))))
    assert rows(inner, "s", "o") == [(D + f"m/{i}", D + f"name/{n}") for i in (1, 4) for n in ("X%20y", "Z")]
    assert plan_of(inner).count("Join") == 1
    text = build(pair("p", join("name", ("ref", "text"))))  # a number and a text
    assert rows(text, "s", "o") == rows(inner, "s", "o")
    for own in (build(pair("p", join("code"))), build(pair("p", join("code", ("code", "code"))))):
        assert rows(own, "s", "o") == [(D + f"m/{i}", D + f"code/{c}") for i, c in ((1, "a"), (2, "b"), (3, "c"), (4, "a"))]
        assert "Join" not in plan_of(own)
    # Another column of the same rows: all that have the key are meant.
    both = build_tables(read_rules(PREFIXES + mapping("m", "left", at("m/{id}"), pair("p", join("m", ("code", "code"))))), tables).triples
    assert rows(both, "s", "o") == sorted((D + f"m/{a}", D + f"m/{b}") for a, b in [(1, 1), (1, 4), (4, 1), (4, 4), (2, 2), (3, 3)])
    with pytest.raises(UnsupportedRule, match="needs join conditions"):
        build(pair("p", join("name")))
    with pytest.raises(UnsupportedRule, match="no rule"):
        build(pair("p", join("nobody")))


def test_joins_of_documents_and_pruned_rules(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "items": [{"sku": "s1"}, {"sku": 7}, {}]}\n')
    (tmp_path / "b.csv").write_text("sku,name\ns1,one\n7,seven\n8,eight\n")
    text = PREFIXES + mapping("item", "a.json", at("i/{sku}"), pair("named", join("product", ("sku", "sku"))), kind=JSON, more='; rml:iterator "$.items[*]"') + mapping("product", "b.csv", at("n/{name}"), pair("label", 'rml:reference "name"'))
    rules = read_rules(text)
    found = build_csv(spark, rules, str(tmp_path))
    links = [(D + "i/7", D + "n/seven"), (D + "i/s1", D + "n/one")]
    assert rows(found.triples.filter("o_kind = 'iri'"), "s", "o") == links
    kept = prune(rules, {"http://example.org/ontology#named"})
    assert [(r.name, len(r.objects)) for r in kept] == [("item", 1), ("product", 0)]
    assert rows(build_csv(spark, kept, str(tmp_path)).triples, "s", "o") == links
    (tmp_path / "b.csv").unlink()
    lost = build_csv(spark, rules, str(tmp_path))
    assert lost.missing == ["b.csv"] and lost.triples.count() == 0
    known = {r.name: r for r in rules}
    assert needs_join(rules[0], known) and own_parent(rules[0], rules[0].objects[0], known) is None


def test_quads_go_out_and_come_back(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", 'q"\n'), (2, None, "t"), (1, "a", 'q"\n')], "id long, g string, v string")
    graphs = f" ; rr:graphMap [ {at('g/{g}')} ] ; rr:graph rr:defaultGraph"
    text = PREFIXES + mapping("m", "t", at("m/{id}") + graphs, pair("v", 'rml:reference "v"'), pair("w", 'rml:reference "v"') + " ; rr:graph o:w")
    built = build_tables(read_rules(text), {"t": table})
    graph = built.graph()
    o = "http://example.org/ontology#"
    wanted = [(D + f"m/{i}", o + p, v, g) for i, v, own in ((1, 'q"\n', D + "g/a"), (2, "t", None)) for p in "vw" for g in ([own] if own else []) + [None] + ([o + "w"] if p == "w" else [])]
    assert rows(graph, "s", "p", "o", "g") == sorted(wanted, key=repr)
    write_ntriples(graph, str(tmp_path / "q"))
    back = read_nquads(spark, str(tmp_path / "q"))
    assert rows(back, "s", "p", "o", "g") == rows(graph, "s", "p", "o", "g") and diff(back, graph).count() == 0
    moved = back.withColumn("g", F.when(F.col("g").isNull(), o + "w").otherwise(F.col("g")))
    assert rows(diff(back, moved), "p", "g", "side") == sorted([(o + p, None, "left") for p in "vw"] * 2 + [(o + "v", o + "w", "right")] * 2, key=repr)
    with pytest.raises(Exception, match="not a triple"):
        read_ntriples(spark, str(tmp_path / "q")).collect()
    (tmp_path / "r").write_text("<http://a> <http://b> _:c _:g .\n<http://a> <http://b> \"x\"@en<http://g> . # note\n<http://a> <http://b> <http://c>.\n")
    assert rows(read_nquads(spark, str(tmp_path / "r")), "o", "g") == [("_:c", "_:g"), ("http://c", None), ("x", "http://g")]


def test_a_graph_of_triples_keeps_its_columns(spark):
    rules = [Rule("m", "t", D + "{id}", (ObjectMap("p", reference="v", iri=False),))]
    assert "g" not in build_tables(rules, {"t": spark.createDataFrame([(1, "x")], "id long, v string")}).graph().columns


def test_functions_by_name(spark):
    row = spark.createDataFrame([(" a B ", "12.50", "x", None, "-3", "2024-05-06")], "a string, n string, b string, z string, m string, d string")

    def value(c):
        rules = [Rule("m", "t", D + "s", (ObjectMap("p", call=c, iri=False),))]
        got = build_tables(rules, {"t": row}).triples.collect()
        return got[0]["o"] if got else None

    c = call
    upper = c("toUpperCase", valueParameter=c("string_trim", valueParameter="{a}"))
    cases = [
        (upper, "A B"), (c("string_length", valueParameter=upper), "3"), (c("string_replace", valueParameter=upper, p_string_find=" ", p_string_replace="_"), "A_B"),
        (c("string_substring", valueParameter="{n}", param_int_i_from="1", param_int_i_opt_to="3"), "2."), (c("string_substring", valueParameter="{n}", param_int_i_from="3"), "50"),
        (c("math_round", p_dec_n="{n}"), "13"), (c("math_floor", p_dec_n="{m}"), "-3"), (c("math_abs", p_dec_n="{m}"), "3"), (c("math_max", p_dec_n="{n}", p_dec_n2="{m}"), "12.5"), (c("math_round", p_dec_n="{a}"), None),
        (c("controls_if", bool_b=c("boolean_not", bool_b=c("string_contains", valueParameter="{a}", string_sub="B")), any_true="1", any_false="{z}"), None),
        (c("controls_if", bool_b=c("string_startsWith", valueParameter="{a}", string_sub=" a"), any_true="{b}", any_false="{z}"), "x"),
        (c("concat", str="{z}", otherStr="{b}", delimiter="-"), "x"), (c("concat", str="{b}", otherStr="{b}", delimiter="-"), "x-x"), (c("concat", str="{z}", otherStr="{z}"), None),
        (c("equal", valueParameter="{z}", valueParameter2="{b}"), "false"), (c("notEqual", valueParameter="{z}", valueParameter2="{b}"), "true"), (c("isNull", str="{z}"), "true"),
        (c("trueCondition", strBoolean=c("equal", valueParameter="{b}", valueParameter2="x"), str=Value(template="{n}/{a}")), "12.50/%20a%20B%20"),
        (c("date_part_year", p_date_d="{d}"), "2024"), (c("toUpperCaseURL", str="{b}"), "HTTP://X"), (c("string_md5", valueParameter="{b}"), "9dd4e461268c8034f5c8564e155c67a6"),
    ]
    assert [(i, value(x)) for i, (x, _) in enumerate(cases)] == [(i, w) for i, (_, w) in enumerate(cases)]
    plan = plan_of(build_tables([Rule("m", "t", upper, (ObjectMap("p", call=upper),))], {"t": row}).triples)
    assert "Python" not in plan and "Pandas" not in plan


def test_own_functions_and_unknown_ones(spark):
    iri = "http://own/fn#twice"
    calls.register(iri, [("http://own/fn#of", "integer")], "integer", lambda n: n * 2)
    text = PREFIXES.replace("@prefix o:", "@prefix own: <http://own/fn#> . @prefix o:") + mapping("m", "t", at("{id}"), pair("p", 'fnml:functionValue [ rr:predicateObjectMap [ rr:predicate fno:executes ; rr:object own:twice ] ; rr:predicateObjectMap [ rr:predicate own:of ; rr:objectMap [ rml:reference "id" ] ] ]'))
    assert rows(build_tables(read_rules(text), {"t": spark.createDataFrame([(21,)], "id long")}).triples, "o", "o_kind") == [("42", "literal")]
    with pytest.raises(UnsupportedRule, match="not known"):
        read_rules(text.replace("own:twice", "own:thrice"))
    with pytest.raises(UnsupportedRule, match="no parameter"):
        read_rules(text.replace("own:of", "own:off"))
    with pytest.raises(ValueError, match="types are"):
        calls.register("x", [], "number", F.upper)
