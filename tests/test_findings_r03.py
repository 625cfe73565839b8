"""Findings of the third round, each on rows that went wrong before."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from loomgraph import queries as trade_queries
from loomgraph.functions.terms import XSD, plain_number
from loomgraph.operators import blanks
from loomgraph.plans import paths
from loomgraph.plans.compiler import WRITERS, build_tables, dedupe, store
from loomgraph.sources.rules import Rule, link, literal


@pytest.fixture
def tables(spark, tmp_path):
    """Writes small tables and gives their folder."""

    def write(**rows) -> str:
        for name, (data, schema) in rows.items():
            spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_weighted_mixture_rounds_halves_as_sql_does(spark, tables):
    # 0.0003 * 10000 / 2 is 1.5; 0.0003 as a double, times 10000, is less than 3.
    rows = [(1, 1, 1, 0.03, 0.01, 0.0), (1, 1, 2, 1.97, 0.0, 0.0)]
    d = tables(lineitem=(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_extendedprice double"))
    assert [tuple(r) for r in trade_queries.weighted_mixture(spark, d).collect()] == [(1, 2)]


@pytest.mark.parametrize("name", ["dangling_links", "isolated_nodes", "connectivity_ratio"])
def test_nodes_are_not_broadcast(spark, sf_dir, name):
    # Files are small where triples aren't: the estimate from the file let the driver collect all nodes.
    plan = trade_queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_a_graph_is_shuffled_by_rows_and_gathered_by_no_task_before(spark, sf_dir):
    # Triples of all distinct rows were hashed in the tasks that read them, however many these were.
    plan = trade_queries.materialize_customer(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    shuffled = plan.index("Exchange hashpartitioning(s#")
    assert "Generate inline" in plan[:shuffled] and "Generate" not in plan[shuffled:]


def test_a_graph_of_rows_keeps_signs_of_zero_repeats_and_the_first_source(spark):
    rows = spark.createDataFrame([(1, 0.0, "a", None), (1, -0.0, "a", None), (1, -0.0, "a", "g"), (None, 1.0, "b", None), (2, None, "a", "h")], "k long, x double, t string, n string")
    number, text = literal("x", "x", XSD + "double"), literal("t", "t", XSD + "string")
    rules = [Rule("b", "t", "n/{k}", (text, number)), Rule("a", "t", "n/{k}", (text,)), Rule("c", "t", "m/{t}", (link("of", "n/{k}"), literal("n", "n", XSD + "string")))]
    built = build_tables(rules, {"t": rows})
    columns = ["s", "p", "o", "o_kind", "o_datatype", "o_lang", "src"]
    got, want = [sorted((tuple(r) for r in df.select(columns).collect()), key=str) for df in (built.graph(), dedupe(built.triples))]
    assert built.once is not None and got == want
    assert ("n/1", "x", "-0.0", "literal", XSD + "double", None, "b") in got and ("n/1", "t", "a", "literal", XSD + "string", None, "a") in got


def test_places_that_starts_share_are_searched_once(spark, monkeypatch):
    """Ten starts come to one hub of a hundred nodes: rounds hold what the hub reaches once, and not for each start."""
    rows = [(f"s{i}", "in", "hub") for i in range(10)] + [("hub", "has", f"n{i}") for i in range(100)] + [("s0", "has", "n7"), ("s0", "has", "alone"), ("s1", "in", "other"), ("other", "has", "n1"), ("other", "has", "far")]
    triples = spark.createDataFrame([(s, p, o, "iri") for s, p, o in rows], "s string, p string, o string, o_kind string")
    settled = []
    monkeypatch.setattr(paths, "settle", lambda df, instead=None, real=paths.settle: settled.append(real(df, instead)) or settled[-1])
    starts = triples.filter("p = 'in'").select(F.col("s").alias("node"))
    got = sorted(tuple(r) for r in paths.reach(triples, paths.seq(paths.optional("in"), "has"), starts).collect())
    want = {(f"s{i}", f"n{k}") for i in range(10) for k in range(100)} | {("s0", "alone"), ("s1", "far")}
    assert got == sorted(want)
    assert sum(df.count() for df in settled) < 600  # the pairs alone are more than a thousand


def test_rules_of_numbers_make_code_that_the_jvm_compiles(spark, sf_dir):
    # Methods of more than 8,000 bytes are interpreted: a rule with two numbers made one of 18,740, and graphs twice that to look at arrays' sizes.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for made in (trade_queries.bag(spark, sf_dir, "lineitem"), trade_queries.kg(spark, sf_dir, "lineitem")):
            stages = made._jdf.queryExecution().debug().codegenToSeq().iterator()
            sizes = []
            while stages.hasNext():
                sizes.append(stages.next()._3().maxMethodCodeSize())
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_numbers_with_exponents_are_written_out(spark):
    numbers = spark.createDataFrame([(x,) for x in (1e7, -1.25e9, 1.5e-7, 12345678.5, 0.0, -2.5, 1e22, None)], "x double")
    got = [r[0] for r in numbers.select(plain_number(F.col("x"))).collect()]
    assert got == ["10000000.0", "-1250000000.0", "0.00000015", "12345678.5", "0.0", "-2.5", "10000000000000000000000.0", None]


def test_walks_that_meet_no_other_are_not_held_against_all_pairs(spark, monkeypatch):
    """A chain, a ring, a tree and a start with two ways on: no round compares its pairs with those of all rounds before."""
    rows = [(f"c{i}", "next", f"c{i + 1}") for i in range(5)] + [(f"r{i}", "next", f"r{(i + 1) % 3}") for i in range(3)] + [("t", "next", "u"), ("t", "next", "v"), ("u", "next", "w"), ("loop", "next", "loop")]
    triples = spark.createDataFrame([(s, p, o, "iri") for s, p, o in rows], "s string, p string, o string, o_kind string")
    monkeypatch.setattr(paths.Seen, "add", lambda *_: pytest.fail("pairs of all rounds were compared"))
    got = sorted(tuple(r) for r in paths.reach(triples, paths.plus("next")).collect())
    chain = {(f"c{i}", f"c{k}") for i in range(6) for k in range(i + 1, 6)}
    ring = {(f"r{i}", f"r{k}") for i in range(3) for k in range(3)}
    assert got == sorted(chain | ring | {("t", "u"), ("t", "v"), ("t", "w"), ("u", "w"), ("loop", "loop")})
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("loomgraph_")]
    with pytest.raises(RuntimeError):
        paths.reach(triples, paths.plus("next"), most=3).collect()


@pytest.mark.parametrize("rows", [[("a", "b"), ("x", "b"), ("b", "c")], [("a", "b"), ("a", "c"), ("a", "d"), ("b", "e"), ("c", "f"), ("d", "g"), ("g", "a")]])
def test_walks_that_meet_are_told_apart(spark, rows):
    triples = spark.createDataFrame([(s, "next", o, "iri") for s, o in rows], "s string, p string, o string, o_kind string")
    want, far = set(rows), set(rows)
    while far := {(a, d) for a, b in far for c, d in rows if b == c} - want:
        want |= far
    got = [tuple(r) for r in paths.reach(triples, paths.plus("next")).collect()]
    assert sorted(got) == sorted(want)


def _blanks(spark, rows):
    return spark.createDataFrame([(s, p, o, "blank" if o.startswith("_:") else "literal", None, None) for s, p, o in rows], "s string, p string, o string, o_kind string, o_datatype string, o_lang string")


def test_graphs_of_blank_nodes_are_coloured_in_the_same_rounds(spark):
    # The right graph's chain takes more rounds than the left has; its node of the name x was called otherwise for that.
    left = _blanks(spark, [("_:a", "name", "x"), ("_:l", "near", "_:m")])
    right = _blanks(spark, [("_:b", "name", "x"), *[(f"_:c{i}", "near", f"_:c{i + 1}") for i in range(5)]])
    found = blanks.diff_graphs(left, right).collect()
    assert {r["p"] for r in found} == {"near"} and sum(r["n"] for r in found if r["side"] == "right") - sum(r["n"] for r in found if r["side"] == "left") == 4


def test_blank_nodes_without_links_need_no_rounds_and_even_ones_no_names(spark, monkeypatch):
    settled = []
    monkeypatch.setattr(blanks, "settle", lambda df, instead=None, real=blanks.settle: settled.append(real(df, instead)) or settled[-1])
    rows = [(f"_:n{i}", p, f"{p}{i}") for i in range(50) for p in "pq"]
    found = blanks.diff_graphs(_blanks(spark, rows), _blanks(spark, [(s.replace("n", "m"), p, "other" if o == "q7" else o) for s, p, o in rows])).collect()
    assert sorted((r["o"], r["side"], r["n"]) for r in found) == [("other", "right", 1), ("p7", "left", 1), ("p7", "right", 1), ("q7", "left", 1)]
    # Both graphs, their colours, no links, the uneven colours, and their nodes.
    assert [df.count() for df in settled] == [200, 100, 0, 2, 2]


def test_many_uneven_nodes_are_sieved_before_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(blanks, "dimension", lambda df: df)
    rows = [(f"_:n{i}", p, f"{p}{i}") for i in range(300) for p in "pq"] + [(f"c{i}", "has", f"_:n{i}") for i in range(300)]
    others = [(s.replace("_:n", "_:m"), p, ("other" if i % 20 == 1 else o).replace("_:n", "_:m")) for i, (s, p, o) in enumerate(rows)]
    left, right = _blanks(spark, rows), _blanks(spark, others)
    want = sorted(map(str, blanks.diff_graphs(left, right).collect()))
    monkeypatch.setattr(blanks, "_sieve", lambda *_: None)
    assert want == sorted(map(str, blanks.diff_graphs(left, right).collect())) and len(want) > 60
    monkeypatch.undo()
    names = spark.range(40).select(F.concat(F.lit("_:"), "id").alias("node"))
    told = spark.range(4000).select(F.concat(F.lit("_:"), "id").alias("s"))
    kept = {r["s"] for r in blanks._sieved(told, blanks._sieve(names, []), [], "s").collect()}
    assert {f"_:{i}" for i in range(40)} <= kept and len(kept) < 45


def test_a_graph_is_stored_without_a_sort_of_its_rows(spark, tmp_path):
    # Sorted rows took a task many times the memory that rebalancing had packed them in.
    rows = [(f"n{i}", f"p{i % 20}" if i < 40 else "hot", f"o{i}") for i in range(3000)]
    store(spark.createDataFrame(rows, "s string, p string, o string"), str(tmp_path / "g"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "g")).select("s", "p", "o").collect()) == sorted(rows)
    assert spark.conf.get(WRITERS) == "0"
    few = spark.createDataFrame([r for r in rows if r[1] == "hot"], "s string, p string, o string")
    store(few, str(tmp_path / "h"))
    none = spark._jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    last = next(stages.apply(i) for i in range(stages.size()) if stages.apply(i).outputRecords() == 2960)
    assert last.peakExecutionMemory() == 0
