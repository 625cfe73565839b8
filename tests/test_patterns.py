"""Patterns, N-Triples, joins over tables, and streams."""

import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions.terms import IDENTITY, TRIPLE, XSD
from loomgraph.operators import analytics
from loomgraph.plans import patterns as P
from loomgraph.sources.ntriples import diff, read_ntriples, write_ntriples
from loomgraph.sources.rules import Rule, constant, literal
from loomgraph.streaming.incremental import append_new, session_counts, stream_triples, windowed_counts


@pytest.fixture(scope="module")
def triples(spark):
    rows = [("a", "p", "1"), ("a", "p", "2"), ("a", "q", "b"), ("b", "p", "3"), ("b", "q", "c"), ("c", "q", "a"), ("a", "r", "x"), ("a", "r", "y")]
    return spark.createDataFrame([(s, p, o, "iri", None, None, "t") for s, p, o in rows], TRIPLE).cache()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def brute(triples, wanted):
    data = [(r.s, r.p, r.o) for r in triples.collect()]
    out = []
    for choice in itertools.product(data, repeat=len(wanted)):
        bound = {}
        if all((t == v if not t.startswith("?") else bound.setdefault(t, v) == v) for pat, row in zip(wanted, choice) for t, v in zip(pat, row)):
            out.append(tuple(bound[k] for k in sorted(bound)))
    return sorted(out)


QUERIES = [
    [("?x", "p", "?v"), ("?x", "r", "?w")],
    [("?x", "q", "?y"), ("?y", "q", "?z"), ("?z", "p", "?v")],
    [("?x", "p", "?v"), ("?x", "q", "b")],
    [("?x", "q", "?y"), ("?x", "p", "2"), ("?y", "p", "?v")],
    [("?x", "?any", "b")],
    [("?x", "p", "?v"), ("?x", "p", "?w")],
]


@pytest.mark.parametrize("wanted", QUERIES)
def test_patterns_agree_with_plain_search_in_any_order(triples, wanted):
    want = brute(triples, wanted)
    for order in itertools.permutations(wanted):
        assert rows(P.match(triples, order)) == want


def test_star_needs_one_grouping(triples):
    plan = P.match(triples, QUERIES[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_patterns_that_share_nothing_are_refused(triples):
    with pytest.raises(ValueError):
        P.match(triples, [("?a", "p", "?b"), ("?c", "q", "?d")])


def test_optional_minus_union(triples):
    p, r = P.match(triples, [("?x", "p", "?v")]), P.match(triples, [("?x", "r", "?w")])
    assert len(rows(P.optional(p, r))) == 5
    assert rows(P.minus(p, r)) == [("3", "b")]
    assert P.union(p, r).count() == 5


TEXT = st.text(alphabet=st.characters(blacklist_categories=["Cs"], blacklist_characters="\x00"), max_size=12)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(TEXT, st.sampled_from([XSD + "string", XSD + "decimal", None])), min_size=1, max_size=8, unique=True))
def test_ntriples_round_trip(spark, tmp_path_factory, values):
    made = [("http://s", "http://p", v, "literal", t, None if t else "en", None) for v, t in values] + [("http://s", "http://p", "http://o", "iri", None, None, None)]
    made = [r for r in made if not set(r[2]) & set("\x0b\x0c\x1c\x1d\x1e\x85  ")]
    path = str(tmp_path_factory.mktemp("nt") / "g")
    left = spark.createDataFrame(made, TRIPLE)
    write_ntriples(left, path)
    assert diff(left, read_ntriples(spark, path)).count() == 0


def test_ntriples_of_other_writers(spark, tmp_path):
    lines = [
        r"""<http://s> <http://p> "café \U0001F600 😀 \\u0041 \b\f\'"@en . # said""",
        "_:a1 <http://p\\u0041> _:b-2 .",
        '<http://s> <http://p> "' + "x\\n" * 200_000 + '" .',
        '<http://s> <http://p> "" .',
        '<http://s> <http://p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .',
    ]
    (tmp_path / "x.nt").write_text("\n".join(lines))
    got = {(r.s, r.p, r.o, r.o_kind, r.o_lang) for r in read_ntriples(spark, str(tmp_path / "x.nt")).collect()}
    assert got == {("http://s", "http://p", "café 😀 😀 \\u0041 \b\f'", "literal", "en"), ("_:a1", "http://pA", "_:b-2", "blank", None), ("http://s", "http://p", "x\n" * 200_000, "literal", None), ("http://s", "http://p", "", "literal", None), ("http://s", "http://p", "5", "literal", None)}
    marks = spark.createDataFrame([("_:x", "http://p", "a\x00\x07\x7f\x0b|", "literal", XSD + "string", None, None), ("http://s", "http://p", "_:y", "blank", None, None, None)], TRIPLE)
    write_ntriples(marks, str(tmp_path / "out"))
    written = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert written == ["<http://s> <http://p> _:y .", '_:x <http://p> "a\\u0000\\u0007\\u007F\\u000B|" .']
    assert diff(marks, read_ntriples(spark, str(tmp_path / "out"))).count() == 0


def test_ntriples_refuses_other_lines(spark, tmp_path):
    (tmp_path / "x.nt").write_text("# fine\n\n<a> <b> c .\n")
    with pytest.raises(Exception, match="not a triple"):
        read_ntriples(spark, str(tmp_path / "x.nt")).collect()


def test_asof_range_topk_salted(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (None, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 2, 10), (1, 5, 7), (1, 5, 8), (3, 1, 1)], "k int, t int, v int")
    got = sorted(map(tuple, analytics.asof_join(left, right, "k", "t", "t", "v").collect()), key=str)
    assert got == sorted([(1, 5, 8), (1, 1, None), (2, 9, None), (None, 3, None)], key=str)
    rng = random.Random(3)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, None]), rng.randrange(200)) for _ in range(150)], "k int, t int")
    right = spark.createDataFrame([(rng.choice([1, 1, 2, 3, None]), rng.randrange(200), rng.choice([None, 1, 2, 3])) for _ in range(40)], "k int, t int, v int")
    plain = lambda w: sorted(map(str, analytics.asof_join(left, right, "k", "t", "t", "v", w).collect()))
    marks = right.collect()
    best = lambda k, t: max(((m.t, m.v) for m in marks if m.k == k and m.t <= t and m.v is not None), default=(0, None))[1]
    assert plain(None) == plain(16) == plain(1000) == sorted(f"Row(k={r.k}, t={r.t}, asof_value={best(r.k, r.t)})" for r in left.collect())
    points, spans = spark.createDataFrame([(x,) for x in range(20)], "x int"), spark.createDataFrame([(0, 3), (2, 17), (5, 5)], "lo int, hi int")
    got = sorted(map(tuple, analytics.range_join(points, spans, "x", "lo", "hi", 4).select("x", "lo").collect()))
    assert got == sorted((x, lo) for x in range(20) for lo, hi in [(0, 3), (2, 17), (5, 5)] if lo <= x < hi)
    assert analytics.top_k(points.withColumn("g", F.col("x") % 2), ["g"], [F.desc("x")], 2).count() == 4
    assert tuple(analytics.salted_sum(points.withColumn("g", F.lit(1)), "g", "x").first()) == (1, 20, 190)


def test_stream_appends_each_triple_once(spark, tmp_path):
    rules = [Rule("r", "t", "http://d/{id}", (constant("a", "http://o/T"), literal("n", "name", XSD + "string")))]
    source = spark.createDataFrame([("1", "x"), ("2", None), ("1", "x")], "id string, name string")
    for _ in range(2):
        source.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
        append_new(stream_triples(stream, rules), str(tmp_path / "g"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "g"))
    assert got.count() == 3 and got.select(IDENTITY).distinct().count() == 3


def test_stream_windows_close_after_lateness(spark, tmp_path):
    source = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 05:00:00", "b")], "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    for name, df in (("w", windowed_counts(read(), "t", "k", "1 hour", "10 minutes")), ("s", session_counts(read(), "t", "k", "15 minutes", "10 minutes"))):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert [r["n"] for r in spark.table("w").collect()] == [2]
    assert sorted(r["n"] for r in spark.table("s").collect()) == [1, 1]


def test_text_ranges_and_conditions(spark):
    from loomgraph.functions.values import condition_holds, errors, text_range

    rows = spark.createDataFrame([("250\u2013300",), (">400",), (" 5 ",), ("-1 - 2.5",), ("about 7",), (None,)], "t string")
    got = [(None if r.low is None else float(r.low), None if r.high is None else float(r.high)) for r in rows.select(text_range(F.col("t")).alias("r")).select("r.*").collect()]
    assert got == [(250, 300), (400, None), (5, 5), (-1, 2.5), (None, None), (None, None)]
    rows = spark.createDataFrame([("5", ">", "4"), ("5", "between", "1-4"), ("a", "=", "a"), ("a", ">", "4"), ("5.0", "=", "5"), ("5", "odd", "5")], "v string, o string, b string")
    assert [r[0] for r in rows.select(condition_holds(F.col("v"), F.col("o"), F.col("b"))).collect()] == [True, False, True, None, True, None]
    rows = spark.createDataFrame([(1.0, 2.0), (4.0, 4.0)], "p double, o double").agg(*errors(F.col("p"), F.col("o"))).first()
    assert (rows.mae, round(rows.rmse, 4), rows.bias, rows.r2) == (0.5, 0.7071, -0.5, 0.5)


def test_stream_with_a_watermark_drops_what_comes_again(spark, tmp_path):
    rules = [Rule("r", "t", "http://d/{id}", (constant("a", "http://o/T"), literal("n", "name", XSD + "string")))]
    rows = [("1", "x", "2024-01-01 00:00:00"), ("1", "x", "2024-01-01 00:05:00"), ("2", None, "2024-01-01 00:06:00")]
    source = spark.createDataFrame(rows, "id string, name string, t string").withColumn("t", F.col("t").cast("timestamp"))
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_triples(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), rules, "t", "1 hour")
    stream.writeStream.format("memory").queryName("marked").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert sorted((r.s[-1], r.p) for r in spark.table("marked").collect()) == [("1", "a"), ("1", "n"), ("2", "a")]
