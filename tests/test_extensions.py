"""The N-Triples data source, entity streams, joins of streams, sketches, blank nodes and VARIANT."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import variants
from loomgraph.operators import blanks, sketches
from loomgraph.sources.linesource import _Reader, scan_lines
from loomgraph.sources.ntriples import read_nquads, read_ntriples
from loomgraph.streaming.entities import entity_changes, interval_join

LINES = [
    "<http://a/1> <http://p/x> <http://a/2> .", "# a comment", "", '<http://a/1> <http://p/y> "a\\n\\"b\\" \\u00e9\\uD83D\\uDE00 \\U0001F600"@en .', "_:b1 <http://p/x> _:b2 . # more",
    '<http://a/3> <http://p/\\u0078> "1.5"^^<http://www.w3.org/2001/XMLSchema#decimal> .', '<http://a/é> <http://p/z> "plain é" .', "<http://a/4> <http://p/x> <http://a/5>.",
]


def all_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_source_equals_reader_at_any_split(spark, tmp_path):
    path = tmp_path / "f.nt"
    path.write_text("\n".join(LINES * 5), encoding="utf-8")
    want = all_rows(read_ntriples(spark, str(path)))
    for split in (1 << 20, 97, 40, 7):
        df = scan_lines(spark, str(path), split=split)
        assert all_rows(df) == want, split
    assert all_rows(scan_lines(spark, str(tmp_path))) == want and all_rows(scan_lines(spark, "file://" + str(path))) == want
    bad = tmp_path / "bad.nt"
    bad.write_text("<http://a> <http://b> <http://c> <http://g> .\n")
    with pytest.raises(Exception, match="not a triple"):
        scan_lines(spark, str(bad)).collect()
    assert all_rows(scan_lines(spark, str(bad), quads=True)) == all_rows(read_nquads(spark, str(bad)))
    with pytest.raises(Exception, match="gone"):
        scan_lines(spark, str(tmp_path / "gone")).collect()


def test_pushed_predicates_take_fewer_lines_apart(spark, tmp_path, monkeypatch):
    from loomgraph.sources import linesource

    path = tmp_path / "f.nt"
    path.write_text("\n".join(LINES * 5 + ["<http://a/9> <http://p/rare> <http://a/9> ."]), encoding="utf-8")
    for p in ("http://p/x", "http://p/rare", "http://p/none"):
        assert all_rows(scan_lines(spark, str(path)).filter(F.col("p") == p)) == all_rows(read_ntriples(spark, str(path)).filter(F.col("p") == p))
    taken = []
    real = linesource._LINE

    class Counting:
        def fullmatch(self, line):
            taken.append(line)
            return real.fullmatch(line)

    monkeypatch.setattr(linesource, "_LINE", Counting())
    from pyspark.sql.datasource import EqualTo

    reader = _Reader({"path": str(path)}, quads=False)
    assert len(list(reader.pushFilters([EqualTo(("p",), "http://p/rare")]))) == 1
    found = [r for split in reader.partitions() for batch in reader.read(split) for r in batch.to_pylist()]
    assert any(r["p"] == "http://p/rare" for r in found) and len(taken) == 11 and all(b"rare" in x or b"\\" in x for x in taken)


def t(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def run(stream, base, spark, name):
    out = f"{base}/{name}"
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{base}/{name}-state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.parquet(out)


def send(spark, base, name, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/{name}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{name}")


ENTITY = "key string, ts timestamp, rev int, value string"


def test_entities_out_of_order_again_and_corrected(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(6)}", t(rng.randrange(50)), rng.choice([None, -1, 0, 2, 10]), rng.choice("abc")) for _ in range(60)]
    rows += [("k0", t(55), 1, None), ("k0", t(55), 2, "fixed"), (None, t(1), 0, "x"), ("k1", None, 0, "x")]
    twice = rows + rows
    rng.shuffle(twice)
    stream = send(spark, tmp_path, "in", [twice[i::3] for i in range(3)], ENTITY)
    changes = run(entity_changes(stream, "key", "ts", "rev", late="2 hours"), tmp_path, spark, "out")
    totals = changes.groupBy("key", "ts", "rev", "value").agg(F.sum("d").alias("d")).collect()
    assert {r["d"] for r in totals} <= {0, 1}
    got = {r["key"]: (r["ts"], r["rev"]) for r in totals if r["d"]}
    want = {}
    for k, ts, rev, _ in rows:
        if k is not None and ts is not None:
            want[k] = max(want.get(k, (t(-1), -(1 << 62))), (ts, -(1 << 62) if rev is None else rev))
    assert got == {k: (ts, None if rev == -(1 << 62) else rev) for k, (ts, rev) in want.items()}
    assert [r["value"] for r in totals if r["d"] and r["key"] == "k0"] == ["fixed"]


def test_idle_entities_are_forgotten(spark, tmp_path):
    batches = [[("a", t(0), 0, "one")], [("b", t(300), 0, "far")], [("c", t(301), 0, "on")], [("a", t(298), 0, "back")]]
    stream = send(spark, tmp_path, "in", batches, ENTITY)
    rows = all_rows(run(entity_changes(stream, "key", "ts", "rev", late="10 minutes", idle_seconds=600), tmp_path, spark, "out").select("key", "value", "d"))
    assert ("a", "one", 1) in rows and ("a", "back", 1) in rows and ("a", "one", -1) not in rows


def test_streams_join_within_a_time(spark, tmp_path):
    schema = "user int, ts timestamp, id int"
    left = [(1, t(0), 1), (1, t(50), 2), (2, t(5), 3), (3, t(7), 4), (None, t(1), 5)]
    right = [(1, t(60), 10), (1, t(50), 11), (1, t(49), 12), (2, t(65), 13), (2, t(66), 14), (3, t(6), 15), (None, t(1), 16), (9, t(500), 17)]
    batch = interval_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["user"], "ts", "ts", "1 HOUR")
    want = [(1, 10), (1, 11), (1, 12), (2, 10), (2, 11), (3, 13)]
    assert all_rows(batch.select("id", "id_right")) == want
    a = send(spark, tmp_path, "l", [left[::2], left[1::2], [(8, t(500), 6)]], schema)
    b = send(spark, tmp_path, "r", [right[1::2], right[::2], [(8, t(501), 18)]], schema)
    found = run(interval_join(a, b, ["user"], "ts", "ts", "1 HOUR", "10 hours", "10 hours"), tmp_path, spark, "inner")
    assert all_rows(found.select("id", "id_right")) == [*want, (6, 18)]
    outer = run(interval_join(a, b, ["user"], "ts", "ts", "1 HOUR", "10 hours", "10 hours", how="leftOuter"), tmp_path, spark, "outer")
    assert {r for r in all_rows(outer.select("id", "id_right")) if r[1] is not None} == {*want, (6, 18)}


def test_sketches_merge_to_what_rows_give(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("unit"), (F.col("id") % 5000).alias("user"), F.when(F.col("id") % 100 > 0, F.col("id").cast("double")).alias("x"))
    path = str(tmp_path / "states")
    for half in ("id < 1", "id >= 1"):
        part = rows.filter(F.expr(half.replace("id", "x")) | F.col("x").isNull() if half == "id < 1" else F.expr(half.replace("id", "x")))
        sketches.add_states(sketches.sketch_states(part, ["day", "unit"], "user", "x"), path)
    stored = spark.read.parquet(path)
    for units in (["unit"], ["day"], []):
        got = sketches.estimates(sketches.merged(stored, units), [0.1, 0.5, 0.9])
        want = {tuple(r[u] for u in units): r for r in rows.groupBy(*units).agg(F.count("*").alias("n"), F.countDistinct("user").alias("k"), F.sort_array(F.collect_list("x")).alias("xs")).collect()}
        for r in got.collect():
            w = want[tuple(r[u] for u in units)]
            assert r["n"] == w["n"] and abs(r["n_distinct"] - w["k"]) <= 0.06 * w["k"]
            for q, v in zip([0.1, 0.5, 0.9], r["quantiles"]):
                assert abs(sum(x <= v for x in w["xs"]) / len(w["xs"]) - q) < 0.03


TRIPLE = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"


def graph(spark, rows):
    return spark.createDataFrame([(s, p, o, "blank" if o.startswith("_:") else "iri" if o.startswith("http") else "literal", None, None) for s, p, o in rows], TRIPLE)


def test_blank_nodes_by_any_name_are_the_same(spark):
    rows = [("_:a", "p", "_:b"), ("_:b", "p", "_:c"), ("_:c", "q", "http://x"), ("_:d", "p", "_:e"), ("_:e", "q", "http://y"), ("_:f", "p", "_:f"), ("http://x", "r", "_:a"), ("_:t1", "z", "text"), ("_:t2", "z", "text"), ("http://w", "z", "w")]
    names = {x: f"_:new{i}" for i, x in enumerate(sorted({v for s, _, o in rows for v in (s, o) if v.startswith("_:")}, reverse=True))}
    other = [(names.get(s, s), p, names.get(o, o)) for s, p, o in rows]
    assert blanks.diff_graphs(graph(spark, rows), graph(spark, other)).count() == 0
    told = {r["node"]: r["colour"] for r in blanks.colours(graph(spark, rows)).collect()}
    assert told["_:t1"] == told["_:t2"] and len(set(told.values())) == len(told) - 1
    # One link moved, one twin lost.
    changed = [r for r in other if r[0] != names["_:t1"]] + [(names["_:a"], "p", names["_:c"])]
    found = blanks.diff_graphs(graph(spark, rows), graph(spark, changed))
    assert found.filter("p = 'z'").select("side", "n").collect() == [("left", 1)] and found.filter("p = 'p' and side = 'right'").count() >= 1
    assert blanks.diff_graphs(graph(spark, rows[-1:]), graph(spark, rows[-1:])).count() == 0
    path3 = [("_:a", "p", "_:b"), ("_:b", "p", "_:c")]
    assert blanks.diff_graphs(graph(spark, path3), graph(spark, path3 + [("_:c", "p", "_:a")])).count() > 0


def test_literals_that_look_like_blank_nodes_stay(spark):
    df = graph(spark, [("_:a", "p", "http://x")]).union(spark.createDataFrame([("_:a", "q", "_:a", "literal", None, None)], TRIPLE))
    assert sorted(r["o"] for r in blanks.canonical(df).collect()) == ["_:a", "http://x"]


def test_variants(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"k": 5, "a": {"b": "x"}, "l": [1, 2]}'), (2, '{"k": "no"}'), (3, "{bad"), (4, None)], "id int, props string")
    own = variants.parsed_once(df, "props")
    wide = variants.shredded(own, "props", {"k": ("$.k", "int"), "b": ("$.a.b", "string"), "second": ("$.l[1]", "long")})
    wide.write.parquet(str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert all_rows(back.select("id", "k", "b", "second")) == sorted([(1, 5, "x", 2), (2, None, None, None), (3, None, None, None), (4, None, None, None)], key=repr)
    plan = back.filter("k = 5").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,5)" in plan and "props" not in plan.split("ReadSchema")[1]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        variants.parsed_once(df, "props", strict=True).select(F.to_json("props")).collect()
    with pytest.raises(Exception, match="INVALID_VARIANT_CAST"):
        own.select(variants.at("props", "$.k", "int", strict=True)).collect()
    assert "k" in variants.shapes(own, "props").first()["shape"]
    keys = variants.entries(own.filter("id < 3"), "props", ["id"]).select("id", "key").collect()
    assert sorted(map(tuple, keys)) == [(1, "a"), (1, "k"), (1, "l"), (2, "k")]
