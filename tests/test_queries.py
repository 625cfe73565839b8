"""Every query with SQL gives the rows that DuckDB gives for it; the snapshot, where there is one, gives its known figures."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from loomgraph import queries as Q
from loomgraph.sources.shared import passing, release, settle, shared_folder

TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return v.isoformat() if isinstance(v, (datetime.datetime, datetime.date)) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def there(spark):
    folder = shared_folder(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    release(spark)
    before = there(spark)
    got = Q.QUERIES[name](spark, sf_dir)
    want = con.execute(Q.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    found = rows(got.columns, got.collect())
    assert found == rows(names, want.fetchall()) and found
    release(spark)
    assert there(spark) <= before


def test_what_passes_goes_and_what_is_kept_stays(spark):
    release(spark)
    old = there(spark)
    left_over = lambda: there(spark) - old
    before = settle(spark.range(3).toDF("a"))
    with passing(spark) as kept:
        settle(spark.range(4).toDF("a"))
        last = settle(spark.range(5).toDF("a"))
        kept.append(last)
    assert (before.count(), last.count(), len(left_over())) == (3, 5, 2)
    with pytest.raises(RuntimeError), passing(spark):
        settle(spark.range(2).toDF("a"))
        raise RuntimeError
    after = settle(last.filter("a > 1"), last)
    assert after.count() == 3 and len(left_over()) == 2
    release(spark)
    assert not left_over()


def test_patterns_read_the_columns_they_use(spark, sf_dir):
    plan = Q.QUERIES["bgp_path"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan and "o_orderdate" not in plan


def test_entry_without_the_training_operators():
    import __spark_entry__

    assert set(Q.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_snapshot_figures(spark):
    """Set LOOMGRAPH_SNAPSHOT to a folder with rml/*.ttl, ontology/*.ttl and the CSV files that the rules name."""
    base = os.environ.get("LOOMGRAPH_SNAPSHOT")
    if not base:
        pytest.skip("no snapshot here")
    from loomgraph.operators import graph, reasoning
    from loomgraph.plans.compiler import build_csv
    from loomgraph.sources.ontology import read_ontology
    from loomgraph.sources.rules import read_rules

    read = lambda kind: open(glob.glob(f"{base}/{kind}/*.ttl")[0], encoding="utf-8").read()
    rules, onto = read_rules(read("rml")), read_ontology(spark, read("ontology"))
    built = build_csv(spark, rules, base)
    g = built.graph().cache()
    closed = reasoning.closure(onto.class_edges)
    data = rules[0].subject.partition("{")[0]
    links = graph.links(g).filter(g.o.startswith(data))
    verdicts = {r["check"]: r["n"] for r in reasoning.all_violations(g, onto.sides, closed).collect()}
    got = [len(rules), len(built.missing), built.triples.count(), g.count(), closed.count(), reasoning.entailed(g, closed).count(), graph.entities(g).count(), links.count(), reasoning.dangling(g, data).count()]
    assert got == [212, 61, 20334, 20302, 343, 6187, 3331, 11427, 1928]
    assert (verdicts["domain_ok"], verdicts["range_ok"]) == (9195, 9499)
    assert not {"domain_violation", "range_violation"} & set(verdicts)
