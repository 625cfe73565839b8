"""Regular paths against the algebra of relations, and entailed classes kept through changes against building anew."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, reasoning
from loomgraph.operators.maintained import MaintainedTypes
from loomgraph.plans import paths
from loomgraph.plans.paths import alt, inverse, optional, plus, reach, seq, star
from loomgraph.sources.shared import fresh

TRIPLES = "s string, p string, o string, o_kind string"


def pairs(df):
    found = [tuple(r) for r in df.select("start", "node").collect()]
    assert len(found) == len(set(found))
    return set(found)


def algebra(pattern, links, nodes):
    """Pairs of a pattern that is written as nested tuples."""
    if isinstance(pattern, str):
        return {(a, b) for a, p, b in links if p == pattern}
    kind, *parts = pattern
    got = [algebra(x, links, nodes) for x in parts]
    join = lambda x, y: {(a, d) for a, b in x for c, d in y if b == c}
    if kind == "seq":
        out = got[0]
        for g in got[1:]:
            out = join(out, g)
        return out
    if kind == "alt":
        return set().union(*got)
    if kind == "inverse":
        return {(b, a) for a, b in got[0]}
    out = set(got[0])
    if kind in ("plus", "star"):
        while not (more := join(out, got[0])) <= out:
            out |= more
    return out | {(n, n) for n in nodes} if kind in ("star", "optional") else out


MAKE = {"seq": seq, "alt": alt, "inverse": inverse, "plus": plus, "star": star, "optional": optional}


def built(pattern):
    return pattern if isinstance(pattern, str) else MAKE[pattern[0]](*map(built, pattern[1:]))


def some_pattern(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice("abc")
    kind = rng.choice(list(MAKE))
    return (kind, *(some_pattern(rng, depth - 1) for _ in range(rng.randint(2, 3) if kind in ("seq", "alt") else 1)))


def test_random_patterns_equal_the_algebra(spark):
    rng = random.Random(5)
    nodes = [f"n{i}" for i in range(9)]
    links = sorted({(rng.choice(nodes), rng.choice("abc"), rng.choice(nodes)) for _ in range(16)})
    df = spark.createDataFrame([(a, p, b, "iri") for a, p, b in links] + [("n0", "d", "text", "literal")], TRIPLES).cache()
    known = sorted({n for a, _, b in links for n in (a, b)} | {"n0"})
    for pattern in [("alt", ("plus", ("seq", "a", "b")), ("inverse", "c")), ("star", ("alt", "a", ("inverse", "a"))), *(some_pattern(rng, 3) for _ in range(5))]:
        wanted = algebra(pattern, links, known)
        assert pairs(reach(df, built(pattern))) == wanted, pattern
        few = spark.createDataFrame([(n,) for n in known[:3]] * 2 + [(None,)], "node string")
        assert pairs(reach(df, built(pattern), starts=few)) == {x for x in wanted if x[0] in known[:3]}, pattern
        assert pairs(reach(df, built(pattern), ends=few)) == {x for x in wanted if x[1] in known[:3]}, pattern
        assert pairs(reach(df, built(pattern), few, few)) == {x for x in wanted if x[0] in known[:3] and x[1] in known[:3]}, pattern


def test_paths_of_long_chains_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(paths, "APART", 3)
    chain = spark.createDataFrame([(f"{i:02d}", "a", f"{i + 1:02d}", "iri") for i in range(14)], TRIPLES)
    assert pairs(reach(chain, plus("a"), spark.createDataFrame([("00",), ("zz",)], "node string"))) == {("00", f"{i:02d}") for i in range(1, 15)}
    assert pairs(reach(chain, plus(seq("a", "a")))) == {(f"{i:02d}", f"{j:02d}") for i, j in itertools.combinations(range(15), 2) if (j - i) % 2 == 0}
    assert pairs(reach(chain.limit(0), star("a"))) == set()
    with pytest.raises(RuntimeError, match="did not end"):
        reach(chain, plus("a"), most=5)
    with pytest.raises(RuntimeError, match="deeper"):
        graph.lineage(chain.select(F.col("s").alias("a"), F.col("o").alias("b")), most=5)


def rebuilt(spark, types, edges):
    df = spark.createDataFrame([(s, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", c, "iri") for s, c in sorted(types)], TRIPLES)
    closed = reasoning.closure(spark.createDataFrame(sorted(edges), "sub string, super string"))
    return {tuple(r) for r in reasoning.entailed(df, closed).collect()}


def test_changes_equal_building_anew(spark):
    rng = random.Random(3)
    types = {(f"s{i}", f"c{rng.randrange(6)}") for i in range(30)}
    edges = {("c0", "c1"), ("c1", "c2"), ("c3", "c2"), ("c2", "c4"), ("c4", "c1")}  # with a cycle
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    own = MaintainedTypes.create(spark, fresh(spark, "kept"), frame(types, "s string, class string").union(spark.createDataFrame([(None, "c1"), ("s1", None)], "s string, class string")), frame(edges, "sub string, super string"), buckets=3)
    state = {tuple(r) for r in own.current().collect()}
    assert state == rebuilt(spark, types, edges)
    for step in range(3):
        gone = set(rng.sample(sorted(types), 4)) | {("nobody", "c1")}
        new = {(f"s{rng.randrange(40)}", f"c{rng.randrange(7)}") for _ in range(5)} | {rng.choice(sorted(types))}
        edges_gone = {rng.choice(sorted(edges))} if step else set()
        edges_new = {(f"c{rng.randrange(7)}", f"c{rng.randrange(7)}")}
        delta = own.change(frame(new, "s string, class string"), frame(gone, "s string, class string"), frame(edges_new, "sub string, super string"), frame(edges_gone or {("x", "y")}, "sub string, super string"))
        types, edges = types - gone | new, (edges - edges_gone) | edges_new
        now = {tuple(r) for r in own.current().collect()}
        assert now == rebuilt(spark, types, edges) and {tuple(r) for r in own.stated().collect()} == types
        # Only what changes is written.
        touched = {(r["s"], r["class"]) for r in delta.collect()}
        assert now ^ state <= touched
        state = now
        if step == 1:
            own.compact()
    cls = "c1"
    assert {r[0] for r in own.instances(cls).collect()} == {s for s, c in state if c == cls}


def test_a_change_reads_and_writes_its_own_part(spark):
    types = spark.createDataFrame([(f"s{i}", f"c{i % 10}") for i in range(400)], "s string, class string")
    own = MaintainedTypes.create(spark, fresh(spark, "kept"), types, spark.createDataFrame([(f"c{i}", "top") for i in range(10)], "sub string, super string"), buckets=4)
    head = own.head()
    few = spark.createDataFrame([("s3", "c3")], "s string, class string")
    files = lambda df: {f for f in df.inputFiles()}
    plan = own._touched(few, head)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "class" in plan.split("PartitionFilters")[1][:200]
    scan = own._deltas("stated", head).filter("class in ('c3') and bucket in (1)")
    scan.count()
    assert len(files(own._deltas("stated", head))) >= 30
    delta = own.change(removed=few)
    assert sorted(map(tuple, delta.collect())) == [("s3", "c3", -1), ("s3", "top", -1)]
    moved = own.change(edges_removed=spark.createDataFrame([("c4", "top")], "sub string, super string"))
    assert moved.count() == 40 and {(r["class"], r["d"]) for r in moved.collect()} == {("top", -1)}


def test_a_change_that_stops_half_way_counts_for_nothing(spark, monkeypatch):
    one = lambda s, c: spark.createDataFrame([(s, c)], "s string, class string")
    own = MaintainedTypes.create(spark, fresh(spark, "kept"), one("a", "x"), spark.createDataFrame([("x", "y")], "sub string, super string"))
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(own, "_commit", lambda head: (_ for _ in ()).throw(OSError("lost")))
        own.change(added=one("b", "x"))
    assert {tuple(r) for r in own.current().collect()} == {("a", "x"), ("a", "y")}
    own.change(added=one("c", "x"))
    assert {r[0] for r in own.instances("y").collect()} == {"a", "c"}


def test_aligned_nodes_become_one(spark):
    rows = [("b", "same", "a"), ("x/1", "same", "b"), ("c", "same", "x/1"), ("b", "p", "v"), ("a", "p", "v"), ("c", "q", "b"), ("d", "q", "c"), ("e", "same", "e"), ("e", "p", "e")]
    df = spark.createDataFrame([(s, p, o, "literal" if o == "v" else "iri", None, None, f"r{i}") for i, (s, p, o) in enumerate(rows)] + [("b", "p", "a", "literal", None, None, "l"), ("b", "same", "z", "literal", None, None, "l")], TRIPLES + ", o_datatype string, o_lang string, src string")
    got = lambda prefer: {tuple(r) for r in graph.merge_aligned(df, "same", prefer).select("s", "p", "o", "src").collect()}
    assert got("x/") == {("x/1", "p", "v", "r3"), ("x/1", "q", "x/1", "r5"), ("d", "q", "x/1", "r6"), ("e", "p", "e", "r8"), ("x/1", "p", "a", "l"), ("x/1", "same", "z", "l")}
    assert {r[0] for r in got(None)} == {"a", "d", "e"}
    assert graph.merge_aligned(df.limit(0), "same").count() == 0
