"""What large inputs need: CSV files that many tasks read, subjects with very many objects, wide dimension tables."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import reasoning
from loomgraph.plans import patterns as P
from loomgraph.sources.tables import read_csv, read_cut_csv


def cell(rng):
    text = "".join(rng.choice(["a", "bc", " ", "é", "\\"]) for _ in range(rng.randrange(6)))
    if rng.random() < 0.4:
        text = '"' + "".join(rng.choice(["x", "\n", '""', ",", "y\n\nz", "\\"]) for _ in range(rng.randrange(8))) + '"'
    return text


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cut_files_give_the_rows_of_whole_ones(spark, tmp_path, end):
    rng = random.Random(len(end))
    for k in range(2):
        lines = ["id,a,b"] + [f"{k}-{i},{cell(rng)},{cell(rng)}" for i in range(300)]
        long = '"' + "long\n" * 400 + '"'
        lines.insert(100, f"{k}-x,{long},end")
        (tmp_path / f"f{k}.csv").write_bytes((end.join(lines) + (end if k else "")).encode())
    paths = [str(tmp_path / f"f{k}.csv") for k in range(2)]
    columns = ["id", "a", "b"]
    want = sorted(map(tuple, read_csv(spark, paths, columns).collect()), key=repr)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    try:
        for size in ("300", "64", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            df = read_cut_csv(spark, paths, columns)
            got = sorted(map(tuple, df.collect()), key=repr)
            assert got == want, size
        assert read_csv(spark, paths, columns, cut=100).count() == len(want)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_subjects_with_many_objects_are_joined(spark):
    rows = [("hub", "p", f"o{i}") for i in range(50)] + [("hub", "q", "c"), ("x", "p", "o"), ("x", "q", "d"), ("x", "r", "e"), ("hub", "r", "f")]
    df = spark.createDataFrame([(s, p, o, "iri") for s, p, o in rows], "s string, p string, o string, o_kind string")
    assert P.hubs(df, 10) == {"p"} and P.hubs(df, 50) == set()
    wanted = [("?s", "p", "?a"), ("?s", "q", "?b"), ("?s", "r", "?c")]
    star, joined = P.match(df, wanted), P.match(df, wanted, many=P.hubs(df, 10))
    assert sorted(map(tuple, star.select("s", "a", "b", "c").collect())) == sorted(map(tuple, joined.select("s", "a", "b", "c").collect()))
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(star) and plan(joined).count("Join") == 1 and plan(joined).count("collect_list(CASE WHEN (p") == 2


def test_dimensions_are_broadcast_by_rows_and_bytes(spark):
    small = spark.createDataFrame([("a" * 100,)] * 10, "c string")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(reasoning.dimension(small)) and not hinted(reasoning.dimension(small, rows=5)) and not hinted(reasoning.dimension(small, size=500))
    assert reasoning.dimension(small.filter(F.lit(False))).count() == 0


def test_appended_graphs_grow_by_levels_and_batches_read_their_part(spark, tmp_path):
    from loomgraph.functions.terms import IDENTITY
    from loomgraph.sources.rules import Rule, literal
    from loomgraph.streaming.incremental import _levels, append_new, stream_triples

    rules = [Rule("r", "t", "http://d/{id}", (literal("n", "name", "http://www.w3.org/2001/XMLSchema#string"),))]
    path, source = str(tmp_path / "g"), str(tmp_path / "in")
    for k in range(5):
        spark.createDataFrame([(i, f"x{i % 3}") for i in range(k * 150, k * 150 + 300)], "id long, name string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, name string").parquet(source)
        append_new(stream_triples(stream, rules), path, str(tmp_path / "c"), buckets=2, size=3000).awaitTermination()
    stored = spark.read.parquet(path)
    assert stored.count() == 900 == stored.select(*IDENTITY).distinct().count()
    levels, now = _levels(spark, path, 2, 3000)
    assert len(levels) >= 2 and now >= levels[-1]
    assert stored.select("level", "bucket").distinct().count() > 2 * len(levels) - 2
    assert _levels(spark, str(tmp_path / "none"), 2, 3000) == ([], 0)
