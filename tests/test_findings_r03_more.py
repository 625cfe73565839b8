"""Further findings of the third round."""

from __future__ import annotations

from loomgraph import queries as trade_queries
from loomgraph.functions.terms import XSD
from loomgraph.plans import compiler, patterns
from loomgraph.plans.compiler import build_tables, prune
from loomgraph.sources.rules import Rule, link, literal


def test_stars_over_rows_match_as_stars_over_triples(spark):
    """Subjects of several rows, objects that two rules state, constants, nulls, a predicate of two kinds, and one that no rule states."""
    rows = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 2), (1, "b", "x", 1), (2, "a", None, 3), (3, "c", "z", None), (None, "d", "z", 4)], "k long, t string, u string, v long")
    rules = [
        Rule("one", "t", "n/{k}", (literal("t", "t", XSD + "string"), literal("u", "u", XSD + "string"), link("to", "m/{t}"))),
        Rule("two", "t", "n/{k}", (literal("u", "u", XSD + "string"), literal("v", "v", XSD + "integer"), literal("w", "v", XSD + "integer"))),
        Rule("three", "t", "n/{k}", (literal("w", "v", XSD + "string"),)),
        Rule("far", "s", "m/{t}", (literal("size", "n", XSD + "integer"),)),
    ]
    tables = {"t": rows, "s": spark.createDataFrame([("a", 5), ("b", 6), ("e", 7)], "t string, n long")}
    seen = []
    parts = lambda only: seen.append(only) or build_tables(prune(rules, set(only)), tables)
    whole = build_tables(rules, tables).graph()
    for own in (
        [("?n", "t", "?t"), ("?n", "u", "?u"), ("?n", "v", "?v"), ("?n", "to", "?m"), ("?m", "size", "?s")],
        [("?n", "t", "?t"), ("?n", "w", "?w")],
        [("?n", "t", "a"), ("?n", "u", "?u")],
        [("?n", "t", "a"), ("?n", "v", "2")],
        [("?n", "u", "?u")],
    ):
        want, got = patterns.match(whole, own), patterns.match(parts, own)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and not want.isEmpty()
    assert seen[0] == ["t", "to", "u", "v"] and seen[1] == ["size"]
    assert patterns.match(lambda _: build_tables(prune(rules, {"t"}), tables), [("?n", "t", "?t"), ("?n", "none", "?x")]).isEmpty()


def test_snowflake_reads_each_table_once_and_broadcasts_none(spark, sf_dir):
    # Each part went through the triples of all three tables, and triples were grouped twice.
    plan = trade_queries.bgp_snowflake(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3 and "Broadcast" not in plan and "SortMergeJoin [_h" in plan


def test_states_get_one_row_of_a_key_where_a_task_has_many(spark):
    # Every row went to its key's state, by itself.
    import pyarrow as pa

    from loomgraph.streaming import entities

    rows = [(f"k{i % 7}", i % 50, f"r{i:04}", f"row{i}", i) for i in range(1000)] + [("k3", 49, "r9", "last", 0), ("é", -1, "", "x", 1)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "at", "rank", "row", "t"), r)) for r in rows[i : i + 100]]) for i in range(0, len(rows), 100)]
    got = [r for b in entities._newest_of_many(iter(batches)) for r in b.to_pylist()]
    want = {}
    for r in rows:
        want[r[0]] = max(want.get(r[0], r), r, key=lambda x: (x[1], x[2]))
    assert sorted(tuple(r.values()) for r in got) == sorted(want.values())
    assert list(entities._newest_of_many(iter([batches[0].slice(0, 0)]))) == []


def test_graphs_of_larger_files_are_gathered_in_more_parts(spark, sf_dir, tmp_path, monkeypatch):
    # A task's share grew with the input: the session's number of parts was all there was.
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    assert compiler.partitions(table) == compiler.partitions(spark.range(3)) == own
    want = {name: sorted(map(str, trade_queries.QUERIES[name](spark, sf_dir).collect())) for name in ("named_graphs", "nested_documents")}
    monkeypatch.setattr(compiler, "PACKED", 100)
    monkeypatch.setattr(compiler, "PLAIN", 20_000)
    table.write.parquet(str(tmp_path / "a b%20c"))
    for path in (f"{sf_dir}/supplier.parquet", str(tmp_path / "a b%20c")):
        assert compiler.partitions(spark.read.parquet(path)) > own
    for name, rows in want.items():
        found = trade_queries.QUERIES[name](spark, sf_dir)
        assert sorted(map(str, found.collect())) == rows
    # The last is the graph of documents; that of quads was written before.
    assert "Exchange hashpartitioning(s#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and f", {own}), REPARTITION" not in plan and "REPARTITION_BY_NUM" in plan
