"""The registered queries: whole tables, contract columns, and digests against brute force."""

import hashlib
import re

import duckdb
import pytest

from loomgraph.llm import queries
from loomgraph.sources.shared import MADE, release

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")

COLUMNS = {
    "op1_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_html_consensus": "page_id url text n_chars",
    "op4_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5_pseudo_likelihood": "doc_id n_tokens log_likelihood",
    "op6_entropy_mix": "doc_id size source_size target taken",
    "op7_simhash": "doc_id fingerprint component_id",
    "op8_language": "doc_id held_out lang_pred score",
    "op9_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op10_licenses": "doc_id n_licenses licenses",
    "op11_align_tokenizers": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op12_vector_codes": "vec_id code error label_error codebooks_sha256",
    "op13_nearest": "query_id rank vec_id score",
}


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def digest(kinds):
    spans = sorted((s, k, name, e) for k, (name, found) in enumerate(kinds) for s, e in found)
    return [len(f) for _, f in kinds], hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, n, e in spans).encode()).hexdigest()


def personal(t):
    span = lambda m: m.span()
    return digest([
        ("email", [span(m) for m in EMAIL.finditer(t)]),
        ("ip", [span(m) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]),
        ("card", [span(m) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]),
        ("phone", [span(m) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]),
    ])


def secret(t):
    return digest([
        ("assign", [m.span() for m in ASSIGN.finditer(t) if len(m[2]) >= 6]),
        ("access", [m.span() for m in ACCESS.finditer(t) if len(m[0]) >= 20]),
        ("hex", [m.span() for m in HEX.finditer(t) if len(m[0]) >= 24]),
    ])


@pytest.mark.parametrize("name", list(COLUMNS))
def test_queries_return_whole_tables(spark, sf_dir, name):
    whole_table(spark, sf_dir, name)
    release(spark)
    assert not MADE


def whole_table(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir).cache()
    assert set(COLUMNS[name].split()) <= set(df.columns)
    table, key = {"op3_html_consensus": ("pages", "page_id"), "op12_vector_codes": ("embeddings", "vec_id"), "op13_nearest": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name == "op13_nearest":
        assert df.count() == 20 * source.filter("vec_id % 20 = 0").count()
        return
    assert df.count() == source.count() and df.select(key).distinct().count() == source.select(key).distinct().count()
    if name in ("op4_secrets", "op9_personal_data"):
        texts = {r.doc_id: r.text for r in source.collect()}
        for r in df.collect():
            counts, sha = (secret if name == "op4_secrets" else personal)(texts[r.doc_id])
            assert ([r[c] for c in df.columns if c.startswith("n_")], r.base_sha256) == (counts, sha)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf_dir).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_entry_lists_all():
    import __spark_entry__

    assert {*COLUMNS, "pipeline"} <= set(__spark_entry__.queries())
