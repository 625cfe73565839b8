"""Pairs of starts and nodes are searched by number, and made in groups of a bounded size."""

import pytest
from pyspark.sql import functions as F

from loomgraph.plans import paths

TRIPLES = "s string, p string, o string, o_kind string"


PATTERN = paths.seq(paths.star(paths.seq("in", paths.inverse("in"))), paths.optional("has"))


def hubs(spark):
    """Two hubs of unequal size, a node in a hub of its own, one in none, and a start without a link."""
    rows = [(f"s{i}", "in", f"hub{i % 7 // 5}") for i in range(70)] + [("alone", "in", "own"), ("none", "has", "o3")]
    rows += [(s, "has", f"o{i}") for i, (s, _, _) in enumerate(rows[:71]) if i % 2]
    starts = [f"s{i}" for i in range(0, 70, 2)] + ["alone", "none", "unknown"]
    near = {s: {a for a, p, h in rows if p == "in" and (s, "in", h) in rows} | {s} for s in starts}
    want = {(s, n) for s in starts for n in near[s] | {o for a, p, o in rows if p == "has" and a in near[s]}}
    return spark.createDataFrame([(*r, "iri") for r in rows], TRIPLES), spark.createDataFrame([(s,) for s in starts], "node string"), want


@pytest.mark.parametrize(("group", "task", "size"), [(1 << 22, 1 << 24, 1 << 10), (40, 200, 8), (1, 16, 1)])
def test_pairs_of_hubs_are_made_in_groups_and_tasks_of_a_bounded_size(spark, monkeypatch, group, task, size):
    for name, value in (("GROUP", group), ("TASK", task), ("LIST", size)):
        monkeypatch.setattr(paths, name, value)
    triples, starts, want = hubs(spark)
    found = paths.reach(triples, PATTERN, starts)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    made = found.withColumn("part", F.spark_partition_id()).groupBy("part").count().agg(F.max("count"), F.count("*")).first()
    if group == 40:
        # The larger hub's 25 starts and 75 nodes made 1,875 rows in one task.
        assert made[0] < 700 and made[1] > 8


def test_rounds_hold_numbers_and_no_names(spark, monkeypatch):
    triples, starts, _ = hubs(spark)
    kinds = []
    monkeypatch.setattr(paths.Seen, "add", lambda self, found, real=paths.Seen.add: kinds.append(dict(found.dtypes)) or real(self, found))
    paths.reach(triples, PATTERN, starts)
    assert kinds and all(k == {"start": "bigint", "node": "bigint", "state": "int"} for k in kinds)
