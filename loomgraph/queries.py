"""All queries over the trade tables by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import trade
from .functions import values, variants
from .functions.terms import RDF_TYPE, XSD, local_name, typed
from .operators import analytics, blanks, graph, reasoning, sketches
from .operators.maintained import MaintainedTypes
from .plans import paths, patterns
from .plans.compiler import Build, build_csv, build_tables, prune, store
from .plans.fields import parsed
from .sources.linesource import scan_lines
from .sources.ntriples import diff, line, read_nquads, read_ntriples, write_ntriples
from .sources.ontology import Ontology, graph_ontology, read_ontology, used_terms
from .sources.rules import ObjectMap, Rule, constant, link, literal, read_rules
from .sources.shared import fresh, write_text
from .sources.tables import first_listed as first_listed_of
from .sources.tables import read_listed
from .streaming.entities import entity_changes, interval_join
from .trade import BY_NAME, CLASS_EDGES, DATA, LABEL, LITERAL_RANGES, ONT, SIDES, TERMS, frame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Triples, on either side.

TEXT = {"dateTime": "strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"}


def _sql_template(text: str) -> str:
    out = text
    while "{" in out:
        head, _, rest = out.partition("{")
        column, _, out = rest.partition("}")
        out = f"{head}\0{column}\0{out}"
    parts = out.split("\0")
    return " || ".join(f"CAST({p} AS VARCHAR)" if i % 2 else f"'{p}'" for i, p in enumerate(parts) if p or i % 2)


def _sql_object(o: ObjectMap) -> str:
    if o.constant:
        return f"'{o.constant}'"
    if o.template:
        return _sql_template(o.template)
    return TEXT.get((o.datatype or "").removeprefix(XSD), "CAST({c} AS VARCHAR)").format(c=o.reference)


#: Columns that rules read and tables lack: a year, and products with as many digits as a double has.
_SOURCES = {"orders": "(SELECT *, year(o_orderdate) AS o_year FROM orders)", "lineitem": "(SELECT *, l_extendedprice * l_discount / 3 AS rebate FROM lineitem)"}


def _source(name: str) -> str:
    return _SOURCES.get(name, name)


def sql_triples(*names: str, rules: list[Rule] | None = None, distinct: bool = True) -> str:
    """The triples of rules, as a SQL query."""
    rows = [
        f"SELECT {_sql_template(r.subject)} AS s, '{o.predicate}' AS p, {_sql_object(o)} AS o, '{'iri' if o.iri else 'literal'}' AS o_kind, {f"'{o.datatype}'" if o.datatype else 'NULL'} AS o_datatype FROM {_source(r.source)} WHERE {_sql_object(o)} IS NOT NULL"
        for r in (rules or [BY_NAME[n] for n in names])
        for o in r.objects
    ]
    return (" UNION " if distinct else " UNION ALL ").join(rows)


def iri(kind: str, column: str) -> str:
    return f"'{DATA}{kind}/' || CAST({column} AS VARCHAR)"


def g(*names: str) -> str:
    return f"WITH g AS ({sql_triples(*names)}) "


def built(spark: SparkSession, d: str, *names: str, rules: list[Rule] | None = None) -> Build:
    own = rules or [BY_NAME[n] for n in names]
    return build_tables(own, trade.tables(spark, d, list(dict.fromkeys(r.source for r in own))))


def bag(spark: SparkSession, d: str, *names: str, rules: list[Rule] | None = None) -> DataFrame:
    return built(spark, d, *names, rules=rules).triples


def kg(spark: SparkSession, d: str, *names: str, only: list[str] | None = None, iris: bool = False) -> DataFrame:
    """The graph of some rules; ``only`` and ``iris`` name what the query uses of it."""
    return part_of(spark, d, *names, only=only, iris=iris).graph()


def part_of(spark: SparkSession, d: str, *names: str, only: list[str] | None = None, iris: bool = False) -> Build:
    wanted = None if only is None else {p if ":" in p else ONT + p for p in only}
    return built(spark, d, rules=prune([BY_NAME[n] for n in names], wanted, iris))


def single(source: str, subject: str, o: ObjectMap) -> list[Rule]:
    return [Rule("r", source, subject, (o,))]


def _values(rows: list[tuple], iris: list[int]) -> str:
    cell = lambda v, iri: f"'{ONT}{v}'" if iri else f"'{v}'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(cell(v, i in iris) for i, v in enumerate(r)) + ")" for r in rows)


EDGES_SQL = f"edges(sub, super) AS ({_values(CLASS_EDGES, [0, 1])})"
CLOSED_SQL = f"{EDGES_SQL}, closed AS (SELECT sub, super, 1 AS depth FROM edges UNION ALL SELECT c.sub, e.super, c.depth + 1 FROM closed c JOIN edges e ON c.super = e.sub)"


def closed(spark: SparkSession) -> DataFrame:
    return reasoning.closure(frame(spark, CLASS_EDGES, "sub string, super string", [0, 1]))


# Term generation.


def _terms(name: str, rules: list[Rule], kind: str = "iri") -> None:
    columns = ["s", "p", "o"] + (["o_datatype"] if kind == "literal" else [])
    sql = f"SELECT {', '.join(columns)} FROM ({sql_triples(rules=rules, distinct=False)})"

    def run(spark: SparkSession, d: str) -> DataFrame:
        return bag(spark, d, rules=rules).select(*columns)

    run.__name__ = name
    query(sql)(run)


_terms("subject_template", single("customer", DATA + "customer/{c_custkey}", constant(RDF_TYPE, ONT + "Customer")))
_terms("subject_template_of_two_columns", single("lineitem", DATA + "line/{l_orderkey}-{l_linenumber}", constant(RDF_TYPE, ONT + "OrderLine")))
_terms("constant_object", single("region", DATA + "region/{r_regionkey}", constant(RDF_TYPE, ONT + "Region")))
_terms("class_template", single("customer", DATA + "customer/{c_custkey}", link(RDF_TYPE, ONT + "{c_mktsegment}")))
_terms("link_template", single("nation", DATA + "nation/{n_nationkey}", link(ONT + "inRegion", DATA + "region/{n_regionkey}")))
_terms("typed_literal_string", single("part", DATA + "part/{p_partkey}", literal(ONT + "brand", "p_brand", XSD + "string")), "literal")
_terms("typed_literal_integer", single("part", DATA + "part/{p_partkey}", literal(ONT + "partSize", "p_size", XSD + "integer")), "literal")
_terms("typed_literal_decimal", single("supplier", DATA + "supplier/{s_suppkey}", literal(ONT + "balance", "s_acctbal", XSD + "decimal")), "literal")
_terms("typed_literal_digits", single("lineitem", DATA + "line/{l_orderkey}-{l_linenumber}", literal(ONT + "rebate", "rebate", XSD + "double")), "literal")
_terms("typed_literal_gyear", single("orders", DATA + "order/{o_orderkey}", literal(ONT + "orderYear", "o_year", XSD + "gYear")), "literal")
_terms("typed_literal_datetime", single("orders", DATA + "order/{o_orderkey}", literal(ONT + "orderedAt", "o_orderdate", XSD + "dateTime")), "literal")
_terms("raw_iri_reference", single("pages", DATA + "page/{page_id}", ObjectMap(ONT + "seenAt", reference="url")))
_terms("column_fanout", [Rule("r", "customer", DATA + "customer/{c_custkey}", (literal(ONT + "customerName", "c_name", XSD + "string"), literal(trade.LABEL, "c_name", XSD + "string")))], "literal")
_terms("row_to_triples", [BY_NAME["orders"]])


@query(f"SELECT '{DATA}priority/' || replace(o_orderpriority, ' ', '%20') AS s, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def template_encoding(spark: SparkSession, d: str) -> DataFrame:
    rules = single("orders", DATA + "priority/{o_orderpriority}", constant(RDF_TYPE, ONT + "Priority"))
    return bag(spark, d, rules=rules).groupBy("s").agg(F.count("*").alias("n"))


@query(f"SELECT '{DATA}order/' || CAST(o_orderkey AS VARCHAR) AS s, o_orderstatus AS o FROM orders WHERE o_orderstatus <> 'O'")
def null_suppression(spark: SparkSession, d: str) -> DataFrame:
    blank = trade.tables(spark, d, ["orders"])["orders"].withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("O")))
    return build_tables(single("orders", DATA + "order/{o_orderkey}", literal(ONT + "status", "o_orderstatus", XSD + "string")), {"orders": blank}).triples.select("s", "o")


@query("SELECT DISTINCT 'http://example.org/data/nation/' || CAST(n_nationkey AS VARCHAR) AS iri, CAST(n_nationkey AS VARCHAR) AS name FROM nation")
def iri_local_name(spark: SparkSession, d: str) -> DataFrame:
    return kg(spark, d, "nation", only=[RDF_TYPE]).select(F.col("s").alias("iri"), local_name(F.col("s")).alias("name")).distinct()


# Building.


@query(f"SELECT s, p, o, o_kind, o_datatype FROM ({sql_triples('customer')})")
def materialize_customer(spark: SparkSession, d: str) -> DataFrame:
    return kg(spark, d, "customer").select("s", "p", "o", "o_kind", "o_datatype")


@query(f"SELECT s, o FROM ({sql_triples('customer', 'supplier')}) WHERE p = '{ONT}inNation'")
def stored_by_predicate(spark: SparkSession, d: str) -> DataFrame:
    """A graph kept by predicate, and one predicate's folder read."""
    path = fresh(spark, "store")
    store(kg(spark, d, "customer", "supplier"), path)
    return spark.read.parquet(path).filter(F.col("p") == ONT + "inNation").select("s", "o")


@query("SELECT src, p, CAST(count(*) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS src, p FROM ({sql_triples(n, distinct=False)})" for n in BY_NAME) + ") GROUP BY src, p")
def union_rules(spark: SparkSession, d: str) -> DataFrame:
    return bag(spark, d, *BY_NAME).groupBy("src", "p").agg(F.count("*").alias("n"))


@query(f"SELECT (SELECT CAST(count(*) AS BIGINT) FROM ({sql_triples('customer', 'customer_types', distinct=False)})) AS raw, (SELECT CAST(count(*) AS BIGINT) FROM ({sql_triples('customer', 'customer_types')})) AS kept")
def global_dedupe(spark: SparkSession, d: str) -> DataFrame:
    own = built(spark, d, "customer", "customer_types")
    return own.triples.agg(F.count("*").alias("raw")).crossJoin(own.graph().agg(F.count("*").alias("kept")))


@query(f"SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' ELSE '\"' || replace(replace(o, '\\', '\\\\'), '\"', '\\\"') || '\"' || CASE WHEN o_datatype = '{XSD}string' THEN '' ELSE '^^<' || o_datatype || '>' END END || ' .' AS line FROM ({sql_triples('supplier', 'part', 'nation')})")
def ntriples_lines(spark: SparkSession, d: str) -> DataFrame:
    return kg(spark, d, "supplier", "part", "nation").select(line().alias("line"))


@query(f"WITH l AS ({sql_triples('customer', 'nation')}), r AS ({sql_triples('customer', 'customer_types')}) SELECT s, p, o, 'left' AS side FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT s, p, o, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)")
def graph_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff(built(spark, d, "customer", "nation").graph(), built(spark, d, "customer", "customer_types").graph()).select("s", "p", "o", "side")


@query("SELECT p, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o) AS BIGINT) AS targets FROM (" + sql_triples(*BY_NAME) + f") WHERE o_kind = 'iri' AND p <> '{RDF_TYPE}' GROUP BY p")
def relation_fk_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.links(kg(spark, d, *BY_NAME, iris=True)).groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("o").alias("targets"))


URGENT = "(SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"


@query(f"SELECT c_custkey AS a, c_nationkey AS b, CASE WHEN c_acctbal >= 2000 THEN 'left' ELSE 'right' END AS side FROM customer WHERE (c_acctbal >= 2000) <> (c_custkey IN {URGENT})")
def reciprocal_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Customers of good standing name their nation; nations name customers with an urgent order. Both differ."""
    t = trade.tables(spark, d, ["customer", "orders"])
    own = t["customer"].filter("c_acctbal >= 2000").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("b"))
    back = t["orders"].filter("o_orderpriority = '1-URGENT'").join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("a"), F.col("c_custkey").alias("b"))
    return graph.reciprocal(own, back)


# Closure and entailment.


#: Classes that tables name: brands below the types of their parts, types below Part, segments below Customer, nations below their regions.
_OWL_CLASS, _SUB = "http://www.w3.org/2002/07/owl#Class", "http://www.w3.org/2000/01/rdf-schema#subClassOf"
CLASS_RULES = [
    Rule("brand_class", "part", ONT + "{p_brand}", (constant(RDF_TYPE, _OWL_CLASS), link(_SUB, ONT + "type/{p_type}"))),
    Rule("type_class", "part", ONT + "type/{p_type}", (constant(RDF_TYPE, _OWL_CLASS), constant(_SUB, ONT + "Part"), literal(LABEL, "p_type", XSD + "string"))),
    Rule("segment_class", "customer", ONT + "{c_mktsegment}", (constant(RDF_TYPE, _OWL_CLASS), constant(_SUB, ONT + "Customer"), literal(LABEL, "c_mktsegment", XSD + "string"))),
    Rule("nation_class", "nation", ONT + "nation/{n_nationkey}", (constant(RDF_TYPE, _OWL_CLASS), link(_SUB, ONT + "region/{n_regionkey}"), literal(LABEL, "n_name", XSD + "string"))),
    Rule("region_class", "region", ONT + "region/{r_regionkey}", (constant(RDF_TYPE, _OWL_CLASS), constant(_SUB, ONT + "Place"), literal("http://www.w3.org/2000/01/rdf-schema#comment", "r_name", XSD + "string"))),
]
_BRAND_IRI, _TYPE_IRI = f"'{ONT}' || replace(p_brand, '#', '%23')", f"'{ONT}type/' || replace(p_type, ' ', '%20')"
_CLASS_EDGES_SQL = f"""edges(sub, super) AS (SELECT DISTINCT {_BRAND_IRI}, {_TYPE_IRI} FROM part UNION SELECT DISTINCT {_TYPE_IRI}, '{ONT}Part' FROM part UNION SELECT DISTINCT '{ONT}' || c_mktsegment, '{ONT}Customer' FROM customer
  UNION SELECT '{ONT}nation/' || CAST(n_nationkey AS VARCHAR), '{ONT}region/' || CAST(n_regionkey AS VARCHAR) FROM nation UNION SELECT '{ONT}region/' || CAST(r_regionkey AS VARCHAR), '{ONT}Place' FROM region)"""
_UP_SQL = f"{_CLASS_EDGES_SQL}, far AS (SELECT sub, super, 1 AS depth FROM edges UNION SELECT f.sub, e.super, f.depth + 1 FROM far f JOIN edges e ON f.super = e.sub)"


def stated_classes(spark: SparkSession, d: str) -> Ontology:
    """The ontology that the tables' own classes make."""
    return graph_ontology(kg_of(spark, d, CLASS_RULES))


def kg_of(spark: SparkSession, d: str, rules: list[Rule]) -> DataFrame:
    return built(spark, d, rules=rules).graph()


@query(f"WITH RECURSIVE {_UP_SQL} SELECT sub, super, min(depth) AS depth FROM far GROUP BY sub, super")
def subclass_closure(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.closure(stated_classes(spark, d).class_edges)


ENTAILED = "ent AS (SELECT DISTINCT s, class FROM (SELECT s, o AS class FROM g WHERE p = '" + RDF_TYPE + "' UNION ALL SELECT g.s, c.super FROM g JOIN closed c ON g.o = c.sub WHERE g.p = '" + RDF_TYPE + "'))"


def gc(*names: str) -> str:
    return f"WITH RECURSIVE {CLOSED_SQL}, g AS ({sql_triples(*names)}), {ENTAILED} "


@query(gc("customer", "customer_types", "supplier") + "SELECT s, class FROM ent")
def type_entailment(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.entailed(kg(spark, d, "customer", "customer_types", "supplier", only=[RDF_TYPE]), closed(spark))


@query(gc(*BY_NAME) + f"SELECT class, CAST(coalesce(a.n, 0) AS BIGINT) AS asserted, CAST(e.n AS BIGINT) AS entailed FROM (SELECT class, count(*) AS n FROM ent GROUP BY class) e LEFT JOIN (SELECT o AS class, count(*) AS n FROM g WHERE p = '{RDF_TYPE}' GROUP BY o) a USING (class)")
def class_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.rollup_histogram(kg(spark, d, *BY_NAME, only=[RDF_TYPE]), closed(spark))


@query("SELECT r_name, n_name, c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def class_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = trade.tables(spark, d, ["customer", "nation", "region"])
    joined = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"))


# Validation.

SIDES_SQL = f"sides(property, side, choice, class) AS ({_values(SIDES, [0, 3])})"


def _side_sql(names: list[str], side: str) -> str:
    node = "s" if side == "domain" else "o"
    return (
        f"WITH RECURSIVE {CLOSED_SQL}, {SIDES_SQL}, g AS ({sql_triples(*names)}), {ENTAILED}, typed AS (SELECT DISTINCT s FROM ent), fits AS (SELECT DISTINCT ent.s, d.property FROM sides d JOIN ent ON ent.class = d.class WHERE d.side = '{side}') "
        f"SELECT g.p, CASE WHEN t.s IS NULL THEN 'unknown' WHEN f.s IS NOT NULL THEN 'ok' ELSE 'violation' END AS verdict, CAST(count(*) AS BIGINT) AS n "
        f"FROM g LEFT JOIN typed t ON t.s = g.{node} LEFT JOIN fits f ON f.s = g.{node} AND f.property = g.p WHERE g.p IN (SELECT property FROM sides WHERE side = '{side}') GROUP BY 1, 2"
    )


CHECKED = ["nation", "customer", "customer_types", "supplier", "orders"]
USED = [RDF_TYPE, *dict.fromkeys(s[0] for s in SIDES)]


def sides(spark: SparkSession) -> DataFrame:
    return frame(spark, SIDES, "property string, side string, choice int, class string", [0, 3])


@query(_side_sql(CHECKED, "domain"))
def domain_violations(spark: SparkSession, d: str) -> DataFrame:
    found = reasoning.check_side(kg(spark, d, *CHECKED, only=USED), sides(spark), closed(spark), "domain")
    return found.groupBy("p", "verdict").agg(F.count("*").alias("n"))


@query(_side_sql(CHECKED, "range"))
def range_violations(spark: SparkSession, d: str) -> DataFrame:
    found = reasoning.check_side(kg(spark, d, *CHECKED, only=USED), sides(spark), closed(spark), "range")
    return found.groupBy("p", "verdict").agg(F.count("*").alias("n"))


RANGES_SQL = "ranges(property, class) AS (VALUES " + ", ".join(f"('{ONT}{p}', '{XSD}{c}')" for p, c in LITERAL_RANGES) + ")"


@query(f"WITH {RANGES_SQL}, g AS ({sql_triples('part', 'supplier', 'orders')}) SELECT p, o_datatype, 'datatype' AS problem, CAST(count(*) AS BIGINT) AS n FROM g JOIN ranges ON p = property WHERE o_kind = 'literal' AND o_datatype <> class GROUP BY 1, 2")
def datatype_violations(spark: SparkSession, d: str) -> DataFrame:
    ranges = spark.createDataFrame([(ONT + p, "range", 0, XSD + c) for p, c in LITERAL_RANGES], "property string, side string, choice int, class string")
    return reasoning.check_literals(kg(spark, d, "part", "supplier", "orders", only=[p for p, _ in LITERAL_RANGES]), ranges).groupBy("p", "o_datatype", "problem").agg(F.count("*").alias("n"))


@query(f"SELECT {iri('part', 'p_partkey')} AS s, p_brand AS o, 'lexical' AS problem FROM part WHERE p_brand LIKE 'Brand%'")
def lexical_violations(spark: SparkSession, d: str) -> DataFrame:
    """Names that a rule calls integers."""
    rules = single("part", DATA + "part/{p_partkey}", literal(ONT + "partSize", "p_brand", XSD + "integer"))
    ranges = spark.createDataFrame([(ONT + "partSize", "range", 0, XSD + "integer")], "property string, side string, choice int, class string")
    return reasoning.check_literals(bag(spark, d, rules=rules), ranges).select("s", "o", "problem")


@query("SELECT CAST(p_partkey AS BIGINT) AS part, p_brand AS text, TRY_CAST(replace(p_brand, 'Brand#', '') AS DECIMAL(38,10)) AS number FROM part")
def typed_view(spark: SparkSession, d: str) -> DataFrame:
    part = trade.tables(spark, d, ["part"])["part"]
    number = typed(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")), F.lit(XSD + "decimal"))
    return part.select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("text"), number.alias("number"))


@query(g("nation", "customer", "orders") + f"SELECT s, p, o FROM g WHERE o_kind = 'iri' AND p <> '{RDF_TYPE}' AND o LIKE '{DATA}%' AND o NOT IN (SELECT s FROM g WHERE p = '{RDF_TYPE}')")
def dangling_links(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.dangling(kg(spark, d, "nation", "customer", "orders", iris=True), DATA)


@query(gc("customer", "customer_types") + f"SELECT s, '{ONT}BUILDING' AS a, '{ONT}Customer' AS b FROM ent WHERE class = '{ONT}BUILDING' AND s IN (SELECT s FROM ent WHERE class = '{ONT}Customer')")
def disjoint_violations(spark: SparkSession, d: str) -> DataFrame:
    pair = frame(spark, [("BUILDING", "Customer")], "a string, b string", [0, 1])
    return reasoning.disjoint_violations(kg(spark, d, "customer", "customer_types", only=[RDF_TYPE]), pair, closed(spark))


TERMS_SQL = f"terms(iri, kind) AS ({_values(TERMS, [0])})"


def terms(spark: SparkSession) -> DataFrame:
    return frame(spark, TERMS, "iri string, kind string", [0])


@query(f"WITH {TERMS_SQL}, g AS ({sql_triples(*BY_NAME)}) SELECT o AS class, CAST(count(*) AS BIGINT) AS n FROM g WHERE p = '{RDF_TYPE}' AND o NOT IN (SELECT iri FROM terms WHERE kind = 'class') GROUP BY o")
def unknown_class(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.unknown_classes(kg(spark, d, *BY_NAME, only=[RDF_TYPE]), terms(spark))


@query(f"WITH {TERMS_SQL}, g AS ({sql_triples('region', 'nation', 'customer')}) SELECT iri, kind FROM terms WHERE kind <> 'class' AND iri NOT IN (SELECT p FROM g)")
def unmapped_properties(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.unmapped_properties(terms(spark), kg(spark, d, "region", "nation", "customer"))


_CLASS_NOTES_SQL = f"SELECT DISTINCT {_TYPE_IRI} AS iri, 'label' AS note FROM part UNION SELECT DISTINCT '{ONT}' || c_mktsegment, 'label' FROM customer UNION SELECT '{ONT}nation/' || CAST(n_nationkey AS VARCHAR), 'label' FROM nation UNION SELECT '{ONT}region/' || CAST(r_regionkey AS VARCHAR), 'comment' FROM region"


@query(f"WITH {_CLASS_EDGES_SQL}, wanted AS (SELECT DISTINCT sub AS iri, note FROM edges, (VALUES ('label'), ('comment')) n(note)) SELECT iri, note FROM wanted EXCEPT ({_CLASS_NOTES_SQL})")
def annotation_completeness(spark: SparkSession, d: str) -> DataFrame:
    own = stated_classes(spark, d)
    return reasoning.missing_notes(own.terms, own.notes.withColumn("note", local_name(F.col("note"))), ["label", "comment"])


@query(g(*BY_NAME) + f"SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT o AS iri, 'class' AS kind FROM g WHERE p = '{RDF_TYPE}' UNION ALL SELECT p, CASE WHEN bool_or(o_kind = 'iri') THEN 'object_property' ELSE 'datatype_property' END FROM g WHERE p <> '{RDF_TYPE}' GROUP BY p) GROUP BY kind")
def schema_counts(spark: SparkSession, d: str) -> DataFrame:
    return used_terms(bag(spark, d, *BY_NAME)).groupBy("kind").agg(F.count("*").alias("n"))


# Metrics.


@query(g(*BY_NAME) + "SELECT CAST(count(*) AS BIGINT) AS triples FROM g")
def triple_count(spark: SparkSession, d: str) -> DataFrame:
    return kg(spark, d, *BY_NAME).agg(F.count("*").alias("triples"))


@query(g(*BY_NAME) + f"SELECT CAST(count(DISTINCT s) AS BIGINT) AS entities FROM g WHERE p = '{RDF_TYPE}'")
def entity_count(spark: SparkSession, d: str) -> DataFrame:
    return graph.entities(bag(spark, d, rules=prune(list(BY_NAME.values()), {RDF_TYPE}))).agg(F.count("*").alias("entities"))


@query(g(*BY_NAME) + "SELECT p, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT s) AS BIGINT) AS n_subjects FROM g GROUP BY p")
def predicate_histogram(spark: SparkSession, d: str) -> DataFrame:
    return graph.predicate_histogram(kg(spark, d, *BY_NAME))


LINKED = ["nation", "region", "customer", "supplier", "orders"]
LINKS_SQL = g(*LINKED)[:-1] + f", l AS (SELECT s, o FROM g WHERE o_kind = 'iri' AND p <> '{RDF_TYPE}'), deg AS (SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT s AS node FROM l UNION ALL SELECT o FROM l) GROUP BY node), e AS (SELECT DISTINCT s AS node FROM g WHERE p = '{RDF_TYPE}') "


@query(LINKS_SQL + "SELECT node, degree FROM deg")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree(kg(spark, d, *LINKED, iris=True))


@query(LINKS_SQL + "SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 10")
def top_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree(kg(spark, d, *LINKED, iris=True)).orderBy(F.desc("degree"), "node").limit(10)


PARTLY = ["customer_types", "part", "orders"]
PARTLY_SQL = LINKS_SQL.replace(sql_triples(*LINKED), sql_triples(*PARTLY))


@query(PARTLY_SQL + "SELECT node FROM e WHERE node NOT IN (SELECT node FROM deg)")
def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.isolated(kg(spark, d, *PARTLY, iris=True))


@query(PARTLY_SQL + "SELECT CAST(count(*) AS BIGINT) AS entities, CAST(count(*) FILTER (degree IS NULL) AS BIGINT) AS unlinked, CAST(count(degree) AS DOUBLE) / count(*) AS ratio FROM e LEFT JOIN deg USING (node)")
def connectivity_ratio(spark: SparkSession, d: str) -> DataFrame:
    return graph.connectivity(kg(spark, d, *PARTLY, iris=True))


@query("SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY o_custkey")
def first_listed(spark: SparkSession, d: str) -> DataFrame:
    return trade.tables(spark, d, ["orders"])["orders"].groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"))


# Graph algorithms.

PLACES = f"SELECT '{DATA}customer/' || CAST(c_custkey AS VARCHAR) AS a, '{DATA}nation/' || CAST(c_nationkey AS VARCHAR) AS b, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT '{DATA}nation/' || CAST(n_nationkey AS VARCHAR), '{DATA}region/' || CAST(n_regionkey AS VARCHAR), n_regionkey FROM nation"


def places(spark: SparkSession, d: str) -> DataFrame:
    return graph.links(bag(spark, d, rules=prune([BY_NAME["customer"], BY_NAME["nation"]], iris=True))).select(F.col("s").alias("a"), F.col("o").alias("b"))


@query(f"WITH e AS ({PLACES}), n AS (SELECT DISTINCT node, r FROM (SELECT a AS node, r FROM e UNION ALL SELECT b, r FROM e)) SELECT node, min(node) OVER (PARTITION BY r) AS component FROM n")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(places(spark, d))


@query(f"WITH e AS (SELECT DISTINCT a, b FROM ({PLACES})), st AS (SELECT DISTINCT a AS node FROM e) SELECT node AS start, node, 0 AS hops FROM st UNION SELECT a, b, 1 FROM e UNION SELECT DISTINCT x.a, y.b, 2 FROM e x JOIN e y ON x.b = y.a")
def k_hop(spark: SparkSession, d: str) -> DataFrame:
    edges = places(spark, d)
    return graph.k_hop(edges, edges.select(F.col("a").alias("node")).distinct(), 2)


#: Orders derive from customers and, past them, from nations; regions and their first nations derive from each other.
DERIVED = f"SELECT {iri('order', 'o_orderkey')} AS a, {iri('customer', 'o_custkey')} AS b FROM orders UNION SELECT {iri('order', 'o_orderkey')}, {iri('nation', 'c_nationkey')} FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT {iri('customer', 'c_custkey')}, {iri('nation', 'c_nationkey')} FROM customer UNION SELECT {iri('nation', 'n_nationkey')}, {iri('region', 'n_regionkey')} FROM nation UNION SELECT {iri('region', 'r_regionkey')}, {iri('nation', 'r_regionkey')} FROM region"


@query(f"WITH RECURSIVE e AS ({DERIVED}), up AS (SELECT a, b, 1 AS steps FROM e UNION SELECT up.a, e.b, up.steps + 1 FROM up JOIN e ON up.b = e.a WHERE up.steps < 20) SELECT a AS node, b AS ancestor, min(steps) AS steps FROM up GROUP BY a, b")
def lineage_of_many_paths(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors over paths that meet again, and over cycles."""
    t = trade.tables(spark, d, ["orders", "customer", "nation", "region"])
    node = lambda kind, c: F.concat(F.lit(f"{DATA}{kind}/"), F.col(c).cast("string"))
    edge = lambda df, a, b: df.select(node(*a).alias("a"), node(*b).alias("b"))
    by = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    edges = [edge(t["orders"], ("order", "o_orderkey"), ("customer", "o_custkey")), edge(by, ("order", "o_orderkey"), ("nation", "c_nationkey")), edge(t["customer"], ("customer", "c_custkey"), ("nation", "c_nationkey")), edge(t["nation"], ("nation", "n_nationkey"), ("region", "n_regionkey")), edge(t["region"], ("region", "r_regionkey"), ("nation", "r_regionkey"))]
    return graph.lineage(reduce(DataFrame.union, edges))


@query("SELECT category, CAST(count(*) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS n_links FROM (SELECT c.c_custkey, '" + DATA + "customer/' || CAST(min(x.c_custkey) AS VARCHAR) AS category, 1 AS n FROM customer c JOIN customer x ON x.c_mktsegment = c.c_mktsegment AND x.c_nationkey = c.c_nationkey GROUP BY c.c_custkey) GROUP BY category")
def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose shared case is the first customer of their segment and nation: links of a class to itself, no types."""
    customer = trade.tables(spark, d, ["customer"])["customer"]
    first = customer.groupBy("c_mktsegment", "c_nationkey").agg(F.min("c_custkey").alias("shared"))
    rules = [Rule("r", "customer", DATA + "customer/{c_custkey}", (link(ONT + "hasCustomerType", DATA + "customer/{shared}"), link(ONT + "inNation", DATA + "nation/{c_nationkey}")))]
    built = build_tables(rules, {"customer": customer.join(first, ["c_mktsegment", "c_nationkey"])})
    return graph.category_rollup(built.triples, ONT + "hasCustomerType")


_DERIVED_SQL = f"e AS (SELECT {iri('order', 'o_orderkey')} AS a, {iri('customer', 'o_custkey')} AS b FROM orders UNION ALL SELECT {iri('customer', 'c_custkey')}, {iri('nation', 'c_nationkey')} FROM customer UNION ALL SELECT {iri('nation', 'n_nationkey')}, {iri('region', 'n_regionkey')} FROM nation)"


@query(f"WITH RECURSIVE {_DERIVED_SQL}, far AS (SELECT a AS node, b AS ancestor, 1 AS steps FROM e UNION ALL SELECT far.node, e.b, far.steps + 1 FROM far JOIN e ON far.ancestor = e.a) SELECT node, ancestor, steps FROM far")
def lineage(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.links(kg(spark, d, "orders", "customer", "nation", iris=True))
    return graph.lineage(edges.select(F.col("s").alias("a"), F.col("o").alias("b")))


# Patterns. SQL answers them from the tables themselves.


MONEY = "CAST({} AS VARCHAR)"


@query(f"SELECT {iri('customer', 'c_custkey')} AS c, c_name AS name, {MONEY.format('c_acctbal')} AS balance, {iri('nation', 'c_nationkey')} AS nation FROM customer")
def bgp_star(spark: SparkSession, d: str) -> DataFrame:
    return patterns.match(kg(spark, d, "customer", only=["customerName", "balance", "inNation"]), [("?c", ONT + "customerName", "?name"), ("?c", ONT + "balance", "?balance"), ("?c", ONT + "inNation", "?nation")])


@query(f"SELECT {iri('order', 'o_orderkey')} AS o, {iri('customer', 'o_custkey')} AS c, {iri('nation', 'c_nationkey')} AS n, {iri('region', 'n_regionkey')} AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def bgp_path(spark: SparkSession, d: str) -> DataFrame:
    return patterns.match(kg(spark, d, "orders", "customer", "nation", only=["orderedBy", "inNation", "inRegion"]), [("?o", ONT + "orderedBy", "?c"), ("?c", ONT + "inNation", "?n"), ("?n", ONT + "inRegion", "?r")])


#: Lines of one number in an order are one node, so that each property is a set of its own.
LINE = iri("line", "l_orderkey || '-' || l_linenumber")


@query(f"SELECT x.l, x.o, y.p, y.brand, z.q, x.y FROM (SELECT DISTINCT {LINE} AS l, {iri('order', 'l_orderkey')} AS o, CAST(year(o_orderdate) AS VARCHAR) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x JOIN (SELECT DISTINCT {LINE} AS l, {iri('part', 'l_partkey')} AS p, p_brand AS brand FROM lineitem JOIN part ON l_partkey = p_partkey) y ON x.l = y.l JOIN (SELECT DISTINCT {LINE} AS l, {MONEY.format('l_quantity')} AS q FROM lineitem) z ON x.l = z.l")
def bgp_snowflake(spark: SparkSession, d: str) -> DataFrame:
    return patterns.match(lambda only: part_of(spark, d, "lineitem", "orders", "part", only=only), [("?l", ONT + "ofOrder", "?o"), ("?l", ONT + "ofPart", "?p"), ("?l", ONT + "quantity", "?q"), ("?o", ONT + "orderYear", "?y"), ("?p", ONT + "brand", "?brand")])


@query(f"SELECT {iri('customer', 'c_custkey')} AS c, c_name AS name, CASE WHEN o_orderkey IS NULL THEN NULL ELSE {iri('order', 'o_orderkey')} END AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def bgp_optional(spark: SparkSession, d: str) -> DataFrame:
    t = kg(spark, d, "customer", "orders", only=["customerName", "orderedBy"])
    return patterns.optional(patterns.match(t, [("?c", ONT + "customerName", "?name")]), patterns.match(t, [("?o", ONT + "orderedBy", "?c")])).select("c", "name", "o")


@query(f"SELECT {iri('customer', 'c_custkey')} AS x, c_name AS name, NULL AS nation FROM customer UNION ALL SELECT {iri('supplier', 's_suppkey')}, s_name, {iri('nation', 's_nationkey')} FROM supplier")
def bgp_union(spark: SparkSession, d: str) -> DataFrame:
    t = kg(spark, d, "customer", "supplier", only=["customerName", "supplierName", "inNation"])
    return patterns.union(patterns.match(t, [("?x", ONT + "customerName", "?name")]), patterns.match(t, [("?x", ONT + "supplierName", "?name"), ("?x", ONT + "inNation", "?nation")])).select("x", "name", "nation")


@query(f"SELECT {iri('customer', 'c_custkey')} AS c, c_name AS name FROM customer WHERE c_custkey NOT IN {URGENT}")
def bgp_minus(spark: SparkSession, d: str) -> DataFrame:
    t = kg(spark, d, "customer", "orders", only=["customerName", "orderedBy", "priority"])
    return patterns.minus(patterns.match(t, [("?c", ONT + "customerName", "?name")]), patterns.match(t, [("?o", ONT + "orderedBy", "?c"), ("?o", ONT + "priority", "1-URGENT")]))


@query(f"SELECT {iri('order', 'o_orderkey')} AS o, {MONEY.format('o_totalprice')} AS total FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) BETWEEN 100000 AND 200000")
def bgp_filter_typed(spark: SparkSession, d: str) -> DataFrame:
    return patterns.match(kg(spark, d, "orders", only=["totalPrice"]), [("?o", ONT + "totalPrice", "?total")]).filter(patterns.number("total").between(100000, 200000))


@query(f"SELECT {iri('nation', 'c_nationkey')} AS n, CAST(count(*) AS BIGINT) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def bgp_group_agg(spark: SparkSession, d: str) -> DataFrame:
    found = patterns.match(kg(spark, d, "orders", "customer", only=["orderedBy", "totalPrice", "inNation"]), [("?o", ONT + "orderedBy", "?c"), ("?o", ONT + "totalPrice", "?t"), ("?c", ONT + "inNation", "?n")])
    return found.groupBy("n").agg(F.count("*").alias("n_orders"), F.sum(F.col("t").try_cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))


@query(f"SELECT {iri('customer', 'c_custkey')} AS x, {iri('nation', 'c_nationkey')} AS n FROM customer UNION ALL SELECT {iri('supplier', 's_suppkey')}, {iri('nation', 's_nationkey')} FROM supplier")
def bgp_type_inferred(spark: SparkSession, d: str) -> DataFrame:
    t = kg(spark, d, "customer", "customer_types", "supplier", only=[RDF_TYPE, "inNation"])
    return patterns.instances(t, ONT + "Party", closed(spark)).join(patterns.match(t, [("?x", ONT + "inNation", "?n")]), "x")


@query("WITH b AS (SELECT c_nationkey AS k, CAST(c_acctbal AS DECIMAL(18,2)) AS v FROM customer) SELECT k AS nation, CAST(count(*) AS BIGINT) AS n, round(CAST(sum(v) AS DOUBLE) / count(*), 4) AS mean, CAST(min(v) AS DECIMAL(18,2)) AS low, CAST(max(v) AS DECIMAL(18,2)) AS high FROM b GROUP BY k")
def stats_by_group(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("c_acctbal").cast("decimal(18,2)")
    return trade.tables(spark, d, ["customer"])["customer"].groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.round(F.sum(v).cast("double") / F.count("*"), 4).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))


@query("SELECT l_partkey AS part, CAST(round(sum(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) * 10000 / sum(CAST(l_quantity AS DECIMAL(18,2)))) AS BIGINT) AS weighted FROM lineitem GROUP BY l_partkey")
def weighted_mixture(spark: SparkSession, d: str) -> DataFrame:
    q, x = F.col("l_quantity").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(18,2)")
    mean = (F.sum(q * x) * 10000).cast("double") / F.sum(q).cast("double")
    return trade.tables(spark, d, ["lineitem"])["lineitem"].groupBy(F.col("l_partkey").alias("part")).agg(F.round(mean).cast("long").alias("weighted"))


@query(f"SELECT {iri('supplier', 's_suppkey')} AS s, s_name AS name, {MONEY.format('s_acctbal')} AS balance, {iri('nation', 's_nationkey')} AS nation FROM supplier")
def property_table(spark: SparkSession, d: str) -> DataFrame:
    return patterns.property_table(kg(spark, d, "supplier", only=["supplierName", "balance", "inNation"]), {"name": ONT + "supplierName", "balance": ONT + "balance", "nation": ONT + "inNation"}, first_only=True)


@query("SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS low, max(value) AS high, round(sum(pow(value - m, 3)) / count(*) / pow(stddev_pop(value), 3), 6) AS skewness FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type")
def moments_by_group(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(*values.moments(F.col("value")))
    return e.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "low", "high", F.round("skewness", 6).alias("skewness"))


@query("SELECT p_brand, round(avg(abs(l_extendedprice - p)), 4) AS mae, round(sqrt(avg((l_extendedprice - p) * (l_extendedprice - p))), 4) AS rmse, round(avg(p - l_extendedprice), 4) AS bias, round(avg(CASE WHEN l_extendedprice > 50000 THEN 1.0 ELSE 0.0 END), 8) AS exceedance FROM (SELECT p_brand, l_extendedprice, l_quantity * p_retailprice AS p FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY p_brand")
def error_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = trade.tables(spark, d, ["lineitem", "part"])
    joined = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).withColumn("predicted", F.col("l_quantity") * F.col("p_retailprice"))
    found = joined.groupBy("p_brand").agg(*values.errors(F.col("predicted"), F.col("l_extendedprice")), values.exceedance(F.col("l_extendedprice"), 50000))
    return found.select("p_brand", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "bias")], F.round("exceedance", 8).alias("exceedance"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN CAST(p_size AS DECIMAL(38,10)) WHEN p_size < 30 THEN CAST(p_size AS DECIMAL(38,10)) END AS low, CASE WHEN p_size < 10 THEN CAST(p_size AS DECIMAL(38,10)) WHEN p_size < 30 THEN CAST(p_size + 5 AS DECIMAL(38,10)) ELSE CAST(p_size AS DECIMAL(38,10)) END AS high FROM part")
def text_ranges(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") < 10, size).when(F.col("p_size") < 30, F.concat(size, F.lit("\u2013"), (F.col("p_size") + 5).cast("string"))).otherwise(F.concat(F.lit("<= "), size))
    return trade.tables(spark, d, ["part"])["part"].select("p_partkey", values.text_range(text).alias("r")).select("p_partkey", "r.low", "r.high")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN o_totalprice > 100000 WHEN 'F' THEN o_totalprice <= 100000 ELSE o_totalprice BETWEEN 50000 AND 150000 END AS holds FROM orders")
def stored_conditions(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    operator = F.when(status == "O", ">").when(status == "F", "at most").otherwise("between")
    bound = F.when(status.isin("O", "F"), "100000").otherwise("50000-150000")
    return trade.tables(spark, d, ["orders"])["orders"].select("o_orderkey", values.condition_holds(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), operator, bound).alias("holds"))


# Alignments.

#: Nations as nodes that other vocabularies know, with a match each by rule.
MATCH_SQL = f"SELECT {iri('nation', 'n_nationkey')} AS iri, 'exactMatch' AS match, 'http://example.net/a/' || n_name AS external_iri FROM nation WHERE n_regionkey < 2 UNION ALL SELECT {iri('nation', 'n_nationkey')}, 'closeMatch', 'http://example.net/b/' || n_name FROM nation UNION ALL SELECT {iri('nation', 'n_nationkey')}, 'relatedMatch', 'http://example.net/c/' || CAST(n_regionkey AS VARCHAR) FROM nation"


def matches(spark: SparkSession, d: str) -> DataFrame:
    nation = trade.tables(spark, d, ["nation"])["nation"].withColumn("iri", F.concat(F.lit(DATA + "nation/"), F.col("n_nationkey").cast("string")))
    pair = lambda match, head, tail: F.struct(F.lit(match).alias("match"), F.concat(F.lit("http://example.net/" + head), tail).alias("external_iri"))
    found = F.array(F.when(F.col("n_regionkey") < 2, pair("exactMatch", "a/", F.col("n_name"))), pair("closeMatch", "b/", F.col("n_name")), pair("relatedMatch", "c/", F.col("n_regionkey").cast("string")))
    return nation.select("iri", F.inline(F.array_compact(found)))


@query(f"WITH m AS ({MATCH_SQL}) SELECT iri, match, external_iri FROM (SELECT *, row_number() OVER (PARTITION BY iri ORDER BY CASE match WHEN 'exactMatch' THEN 1 WHEN 'closeMatch' THEN 2 ELSE 5 END, external_iri) AS k FROM m) WHERE k = 1")
def align_best_match(spark: SparkSession, d: str) -> DataFrame:
    return graph.best_match(matches(spark, d))


@query(f"WITH m AS ({MATCH_SQL}) SELECT x.iri AS a, y.iri AS b, x.external_iri FROM m x JOIN m y ON x.external_iri = y.external_iri AND x.iri < y.iri")
def align_union(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    return m.select(F.col("iri").alias("a"), "external_iri").join(m.select(F.col("iri").alias("b"), "external_iri"), "external_iri").filter("a < b").select("a", "b", "external_iri")


# Extensions over the tables.


@query("SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS rank FROM orders")
def window_rank(spark: SparkSession, d: str) -> DataFrame:
    return trade.tables(spark, d, ["orders"])["orders"].select("o_custkey", "o_orderkey", F.rank().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")).alias("rank"))


@query("SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS before, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS last_three FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_frame(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return trade.tables(spark, d, ["orders"])["orders"].select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w.rowsBetween(-2, 0)).cast("decimal(38,2)").alias("last_three"))


@query("SELECT c_mktsegment, c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    t = trade.tables(spark, d, ["customer"])["customer"]
    return t.groupingSets([["c_mktsegment"], ["c_nationkey"], []], "c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark: SparkSession, d: str) -> DataFrame:
    return trade.tables(spark, d, ["orders"])["orders"].cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT e.event_id, e.user_id, p.value AS asof_value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'click'")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return analytics.asof_join(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'"), "user_id", "ts", "ts", "value", width=7 * 86_400).select("event_id", "user_id", "asof_value")


@query("SELECT p_partkey, lo, CAST(p_size AS INTEGER) AS p_size FROM part JOIN (SELECT n_nationkey AS lo, n_nationkey + 7 AS hi FROM nation) ON p_size >= lo AND p_size < hi")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    t = trade.tables(spark, d, ["part", "nation"])
    spans = t["nation"].select(F.col("n_nationkey").alias("lo"), (F.col("n_nationkey") + 7).alias("hi"))
    return analytics.range_join(t["part"], spans, "p_size", "lo", "hi", 8).select("p_partkey", "lo", "p_size")


@query("SELECT l_returnflag, l_orderkey, l_linenumber, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 5")
def topk(spark: SparkSession, d: str) -> DataFrame:
    t = trade.tables(spark, d, ["lineitem"])["lineitem"]
    return analytics.top_k(t, ["l_returnflag"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 5).select("l_returnflag", "l_orderkey", "l_linenumber", "rank")


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM lineitem GROUP BY l_returnflag")
def salted_sum(spark: SparkSession, d: str) -> DataFrame:
    t = trade.tables(spark, d, ["lineitem"])["lineitem"].withColumn("q", F.col("l_quantity").cast("decimal(18,2)"))
    return analytics.salted_sum(t, "l_returnflag", "q").select("l_returnflag", "n", F.col("total").cast("decimal(38,2)").alias("total"))


@query("SELECT 'part' AS what, abs(approx - exact) * 10 <= exact AS near FROM (SELECT count(DISTINCT l_partkey) AS approx, count(DISTINCT l_partkey) AS exact FROM lineitem)")
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    t = trade.tables(spark, d, ["lineitem"])["lineitem"].agg(F.approx_count_distinct("l_partkey", 0.02).alias("approx"), F.countDistinct("l_partkey").alias("exact"))
    return t.select(F.lit("part").alias("what"), (F.abs(F.col("approx") - F.col("exact")) * 10 <= F.col("exact")).alias("near"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    t = trade.tables(spark, d, ["customer", "supplier"])
    return t["customer"].select(F.col("c_nationkey").alias("nation")).intersect(t["supplier"].select("s_nationkey"))


@query(f"SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM {URGENT}")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    t = trade.tables(spark, d, ["customer", "orders"])
    return t["customer"].select(F.col("c_custkey").alias("k")).subtract(t["orders"].filter("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    t = trade.tables(spark, d, ["customer", "orders"])
    return t["customer"].join(t["orders"], F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, key, CAST(json_extract_string(props, '$.' || key) AS BIGINT) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def json_map(spark: SparkSession, d: str) -> DataFrame:
    """Every field of a JSON object, by way of a map."""
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.explode(F.from_json("props", "map<string, bigint>"))).select("event_id", "key", "value")


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows counted over a stream of files; the sink holds what the last batch says."""
    from .streaming.incremental import windowed_counts

    base, events = fresh(spark, "windows"), spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{base}/in")
    counted = windowed_counts(spark.readStream.schema(events.schema).parquet(f"{base}/in"), "ts", "event_type", "1 hour", "1 day")
    put = lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out")
    counted.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM y GROUP BY user_id, k")
def session_window(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


@query(g("customer", "customer_types") + "SELECT p, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY p")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The customer graph built by a stream of files, then counted."""
    from .streaming.incremental import append_new, stream_triples

    base = fresh(spark, "stream")
    source = spark.read.parquet(f"{d}/customer.parquet")
    rows = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(_stream_input(spark, source, base))
    append_new(stream_triples(rows, [BY_NAME["customer"], BY_NAME["customer_types"]]), f"{base}/graph", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/graph").groupBy("p").agg(F.count("*").alias("n"))


def _stream_input(spark: SparkSession, source: DataFrame, base: str) -> str:
    """A folder for the stream: the table's rows, twice, as a source that sends some rows again."""
    source.union(source).repartition(4).write.parquet(f"{base}/in")
    return f"{base}/in"


# Sources: tables written out as files, read back by rules, options and an ontology that are files as well.

#: Names with a line break, quotes and a comma in them; supplier nodes are linked to nations by a relation of its own.
NOTED = "s_name || chr(10) || '\"long\", ' || CAST(s_suppkey AS VARCHAR)"
SKOS_MATCH = "http://www.w3.org/2004/02/skos/core#exactMatch"
HEAD = "@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix ql: <http://semweb.mmlab.be/ns/ql#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @base <http://example.org/rules> .\n"


def _rule(name: str, source: str, key: str, objects: list[tuple[str, str]]) -> str:
    pairs = " ; ".join(f"rr:predicateObjectMap [ rr:predicate {p} ; rr:objectMap [ {o} ] ]" for p, o in objects)
    return f'<#{name}> a rr:TriplesMap ; rml:logicalSource [ rml:source "{source}" ; rml:referenceFormulation ql:CSV ] ; rr:subjectMap [ rr:template "{DATA}supplier/{{{key}}}" ] ; {pairs} .\n'


ENTITIES = HEAD + _rule("suppliers", "entities/suppliers.csv", "s_suppkey", [("rdf:type", f"rr:constant <{ONT}Supplier>"), (f"<{ONT}note>", 'rml:reference "note"'), (f"<{ONT}balance>", 'rml:reference "s_acctbal" ; rr:datatype <http://www.w3.org/2001/XMLSchema#decimal>')]) + _rule("lost", "entities/lost.csv", "id", [("rdf:type", f"rr:constant <{ONT}Lost>")])
RELATIONS = HEAD + _rule("in_nation", "relations/in_nation.csv", "s_suppkey", [(f"<{ONT}inNation>", f'rr:template "{DATA}nation/{{s_nationkey}}" ; rr:termType rr:IRI')]) + _rule("aligned", "alignments/exact.csv", "s_suppkey", [(f"<{SKOS_MATCH}>", 'rml:reference "iri" ; rr:termType rr:IRI')])
OPTIONS = "[default]\nmain_directory: .\n[datasets]\nnumber_of_datasets: 2\noutput_folder: ./kg\nall_in_one_file: no\nremove_duplicate: yes\nenrichment: yes\nname: trade\nordered: no\nlarge_file: false\n[dataset1]\nname: entities\nmapping: ./rml/entities.ttl\n[dataset2]\nname: relations\nmapping: ./rml/relations.ttl\n"


def _files(spark: SparkSession, d: str) -> str:
    """A folder with CSV files of the suppliers, two mapping files and options."""
    base = fresh(spark, "files")
    supplier = trade.tables(spark, d, ["supplier"])["supplier"].select(*[F.col(c).cast("string").alias(c) for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")])
    put = lambda df, path: df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{base}/{path}")
    put(supplier.select("s_suppkey", F.expr("s_name || char(10) || '\"long\", ' || s_suppkey").alias("note"), "s_acctbal"), "entities/suppliers.csv")
    put(supplier.select("s_suppkey", "s_nationkey"), "relations/in_nation.csv")
    put(supplier.select("s_suppkey", F.concat(F.lit("http://example.net/s?a=1&b="), "s_suppkey").alias("iri")), "alignments/exact.csv")
    for path, text in (("rml/entities.ttl", ENTITIES), ("rml/relations.ttl", RELATIONS), ("rml/options.ini", OPTIONS)):
        write_text(spark, f"{base}/{path}", text)
    return base


_BUILT = {
    "entities": f"SELECT {iri('supplier', 's_suppkey')} AS s, '{RDF_TYPE}' AS p, '{ONT}Supplier' AS o, 'iri' AS o_kind, NULL AS o_datatype FROM supplier UNION ALL SELECT {iri('supplier', 's_suppkey')}, '{ONT}note', {NOTED}, 'literal', '{XSD}string' FROM supplier UNION ALL SELECT {iri('supplier', 's_suppkey')}, '{ONT}balance', CAST(s_acctbal AS VARCHAR), 'literal', '{XSD}decimal' FROM supplier",
    "relations": f"SELECT {iri('supplier', 's_suppkey')} AS s, '{ONT}inNation' AS p, {iri('nation', 's_nationkey')} AS o, 'iri' AS o_kind, NULL AS o_datatype FROM supplier UNION ALL SELECT {iri('supplier', 's_suppkey')}, '{SKOS_MATCH}', 'http://example.net/s?a=1&b=' || CAST(s_suppkey AS VARCHAR), 'iri', NULL FROM supplier",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS dataset, s, p, o, o_kind, o_datatype FROM ({sql})" for name, sql in _BUILT.items()))
def build_from_files(spark: SparkSession, d: str) -> DataFrame:
    """A whole build: options, two data sets of rules, CSV files with line breaks in cells, N-Triples out and in again."""
    from .build import build

    report = build(spark, f"{_files(spark, d)}/rml/options.ini")
    read = [read_ntriples(spark, path).select(F.lit(path.rpartition("/")[2].removesuffix(".nt")).alias("dataset"), "s", "p", "o", "o_kind", "o_datatype") for path in report.paths]
    return reduce(DataFrame.union, read)


@query("SELECT 2 AS datasets, 'trade' AS name, 'kg' AS folder, 'enrichment=yes,large_file=false,ordered=no' AS recorded, 'entities/lost.csv' AS missing, CAST(count(*) * 5 AS BIGINT) AS triples FROM supplier")
def build_report(spark: SparkSession, d: str) -> DataFrame:
    """What the options say, and what a build says of itself."""
    from .build import build, load

    base = _files(spark, d)
    config, rules, _ = load(spark, f"{base}/rml/options.ini")
    report = build(spark, f"{base}/rml/options.ini")
    recorded = ",".join(f"{k}={v}" for k, v in config.recorded)
    return spark.createDataFrame([(len(rules), config.name, report.path.split("/")[-2], recorded, ",".join(report.missing), report.triples)], "datasets int, name string, folder string, recorded string, missing string, triples bigint")


#: The N-Triples that a plain writer makes of nations: numbered characters, blank nodes, a language and comments.
@query(f"SELECT '_:n' || CAST(n_nationkey AS VARCHAR) AS s, '{ONT}nationName' AS p, 'é' || chr(128512) || n_name || chr(9) AS o, 'literal' AS o_kind, 'en' AS o_lang FROM nation UNION ALL SELECT {iri('region', 'n_regionkey')}, '{ONT}has', '_:n' || CAST(n_nationkey AS VARCHAR), 'blank', NULL FROM nation")
def read_ntriples_escapes(spark: SparkSession, d: str) -> DataFrame:
    path, key = fresh(spark, "lines"), F.col("n_nationkey").cast("string")
    name = F.concat(F.lit("_:n"), key, F.lit(f' <{ONT}nationName> "\\u00e9\\uD83D\\uDE00'), F.col("n_name"), F.lit('\\t"@en . # a comment'))
    has = F.concat(F.lit(f"<{DATA}region/"), F.col("n_regionkey").cast("string"), F.lit(f"> <{ONT}h\\u0061s> _:n"), key, F.lit(" ."))
    trade.tables(spark, d, ["nation"])["nation"].select(F.explode(F.array(name, has, F.lit("# nothing"))).alias("value")).write.text(path)
    return read_ntriples(spark, path).select("s", "p", "o", "o_kind", "o_lang")


@query(f"SELECT 'subclass' AS what, '{ONT}nation/' || CAST(n_nationkey AS VARCHAR) AS a, '{ONT}region/' || CAST(n_regionkey AS VARCHAR) AS b FROM nation UNION ALL SELECT 'domain', '{ONT}seat' || CAST(n_nationkey AS VARCHAR), '{ONT}nation/' || CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'note', '{ONT}nation/' || CAST(n_nationkey AS VARCHAR), n_name FROM nation")
def ontology_source(spark: SparkSession, d: str) -> DataFrame:
    """A Turtle file of the nations' classes, read back as tables. Nations are few, and such files are made on the driver."""
    from .sources.shared import read_text

    nations = trade.tables(spark, d, ["nation"])["nation"].collect()
    text = "@prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
    for n in nations:
        cls = f"<{ONT}nation/{n['n_nationkey']}>"
        text += f'{cls} a owl:Class ; rdfs:subClassOf <{ONT}region/{n["n_regionkey"]}> ; rdfs:label "{n["n_name"]}" .\n<{ONT}seat{n["n_nationkey"]}> a owl:ObjectProperty ; rdfs:domain {cls} .\n'
    path = f"{fresh(spark, 'ontology')}/o.ttl"
    write_text(spark, path, text)
    onto = read_ontology(spark, read_text(spark, path))
    edges = onto.class_edges.select(F.lit("subclass").alias("what"), F.col("sub").alias("a"), F.col("super").alias("b"))
    return edges.union(onto.sides.select("side", "property", "class")).union(onto.notes.select(F.lit("note"), "iri", "text"))


@query("SELECT first AS name, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_nationkey, min_by(c_mktsegment, c_custkey) AS first FROM customer GROUP BY c_nationkey) GROUP BY first")
def counts_by_first_listed(spark: SparkSession, d: str) -> DataFrame:
    """Of each nation the segment that a listing has first; nations counted by it. The listing is written by as many tasks as it takes."""
    path = fresh(spark, "listed") + "/customer.csv"
    customer = trade.tables(spark, d, ["customer"])["customer"].select("c_nationkey", "c_mktsegment", "c_custkey")
    customer.repartitionByRange(8, "c_custkey").sortWithinPartitions("c_custkey").select("c_nationkey", "c_mktsegment").write.option("header", True).csv(path)
    rows = read_listed(spark, path, ["c_nationkey", "c_mktsegment"])
    return first_listed_of(rows, "c_nationkey", "c_mktsegment").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Build the whole graph, then count its classes with what their trees imply."""
    return class_histogram(spark, d)


# Rules beyond flat tables: nested documents, joins, graphs, functions.

PREFIXES = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix ql: <http://semweb.mmlab.be/ns/ql#> .
@prefix fnml: <http://semweb.mmlab.be/ns/fnml#> . @prefix fno: <https://w3id.org/function/ontology#> . @prefix grel: <http://users.ugent.be/~bjdmeest/function/grel.ttl#> .
@prefix idlab: <http://example.com/idlab/function/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix o: <http://example.org/ontology#> . @base <http://example.org/map> .
"""


def mapping(name: str, source: str, subject: str, *pairs: str, kind: str = "CSV", more: str = "") -> str:
    """A rule as a mapping file has it."""
    objects = "".join(f" ; rr:predicateObjectMap [ {p} ]" for p in pairs)
    return f'<#{name}> a rr:TriplesMap ; rml:logicalSource [ rml:source "{source}" ; rml:referenceFormulation ql:{kind} {more} ] ; rr:subjectMap [ {subject} ]{objects} .\n'


def _at(path: str) -> str:
    return f'rr:template "{DATA}{path}"'


def _map(predicate: str, term: str) -> str:
    return f"rr:predicate o:{predicate} ; rr:objectMap [ {term} ]"


NESTED = PREFIXES + "".join([
    mapping("doc", "docs.json", _at("customer/{id}"), _map("customerName", 'rml:reference "who.name"'), _map("ordered", 'rml:reference "orders[*].status"'), kind="JSONPath"),
    mapping("order", "docs.json", _at("order/{key}"), _map("totalPrice", 'rml:reference "total" ; rr:datatype xsd:decimal'), _map("orderedBy", _at("customer/{$.id}")), kind="JSONPath", more='; rml:iterator "$.orders[*]"'),
    mapping("line", "docs.json", _at("line/{key}"), _map("ofPart", _at("part/{part}")), _map("quantity", 'rml:reference "qty" ; rr:datatype xsd:integer'), kind="JSONPath", more='; rml:iterator "$.orders[*].lines[*]"'),
])
_LINE_KEY = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)"
#: Lines' and orders' keys repeat, and a graph is a set; lines of orders that no customer has aren't in any document.
NESTED_SQL = f"""
SELECT DISTINCT s, p, o, o_datatype FROM (
  SELECT {iri('customer', 'c_custkey')} AS s, '{ONT}customerName' AS p, c_name AS o, '{XSD}string' AS o_datatype FROM customer
  UNION ALL SELECT {iri('customer', 'o_custkey')}, '{ONT}ordered', o_orderstatus, '{XSD}string' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT {iri('order', 'o_orderkey')}, '{ONT}totalPrice', CAST(CAST(o_totalprice * 100 AS BIGINT) AS VARCHAR), '{XSD}decimal' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT {iri('order', 'o_orderkey')}, '{ONT}orderedBy', {iri('customer', 'o_custkey')}, NULL FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT '{DATA}line/' || {_LINE_KEY}, '{ONT}ofPart', {iri('part', 'l_partkey')}, NULL FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT '{DATA}line/' || {_LINE_KEY}, '{ONT}quantity', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '{XSD}integer' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer)
)"""


def _documents(spark: SparkSession, d: str) -> str:
    """A file of nested documents: customers with their orders, and these with their lines."""
    t, base = trade.tables(spark, d, ["customer", "orders", "lineitem"]), fresh(spark, "nested")
    text = lambda *cs: F.concat_ws("-", *[F.col(c).cast("string") for c in cs])
    lines = t["lineitem"].select("l_orderkey", F.struct(text("l_orderkey", "l_linenumber").alias("key"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("bigint").alias("qty")).alias("x")).groupBy("l_orderkey").agg(F.collect_list("x").alias("lines"))
    orders = t["orders"].join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    orders = orders.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total"), "lines")).alias("orders"))
    docs = t["customer"].join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name")).alias("who"), "orders", F.lit("unread").alias("more"))
    docs.write.json(f"{base}/docs.json")
    return base


@query(NESTED_SQL)
def nested_documents(spark: SparkSession, d: str) -> DataFrame:
    """Three iterators over documents of three levels, in one scan; the schema comes from the rules."""
    return build_csv(spark, read_rules(NESTED), _documents(spark, d)).graph().select("s", "p", "o", "o_datatype")


@query(f"SELECT {iri('event', 'event_id')} AS s, '{ONT}k' AS p, json_extract_string(props, '$.k') AS o FROM events")
def json_column(spark: SparkSession, d: str) -> DataFrame:
    """Rules over JSON texts in a column, put beside a key of their row."""
    rules = read_rules(PREFIXES + mapping("props", "events", _at("event/{id}"), _map("k", 'rml:reference "props.k" ; rr:datatype xsd:integer'), kind="JSONPath"))
    events = spark.read.parquet(f"{d}/events.parquet")
    whole = events.select(F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "props": '), F.col("props"), F.lit("}")).alias("doc"))
    return build_tables(rules, {"events": parsed(whole, "doc", rules)}).triples.select("s", "p", "o")


JOINED = PREFIXES + "".join([
    mapping("order", "orders", _at("order/{o_orderkey}"), _map("buyer", "rr:parentTriplesMap <#buyer> ; rr:joinCondition [ rr:child \"o_custkey\" ; rr:parent \"c_custkey\" ]"), _map("named", "rr:parentTriplesMap <#named> ; rr:joinCondition [ rr:child \"o_custkey\" ; rr:parent \"c_custkey\" ]"), _map("state", "rr:parentTriplesMap <#state> ; rr:joinCondition [ rr:child \"o_orderstatus\" ; rr:parent \"o_orderstatus\" ]")),
    mapping("state", "orders", _at("state/{o_orderstatus}"), _map("code", 'rml:reference "o_orderstatus"')),
    mapping("buyer", "customer", _at("customer/{c_custkey}") + " ; rr:class o:Customer"),
    mapping("named", "customer", _at("who/{c_name}")),
])


@query(f"""SELECT {iri('order', 'o_orderkey')} AS s, '{ONT}buyer' AS p, {iri('customer', 'o_custkey')} AS o FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
UNION SELECT {iri('order', 'o_orderkey')}, '{ONT}named', '{DATA}who/' || replace(c_name, '#', '%23') FROM orders JOIN customer ON o_custkey = c_custkey
UNION SELECT {iri('order', 'o_orderkey')}, '{ONT}state', '{DATA}state/' || o_orderstatus FROM orders
UNION SELECT DISTINCT '{DATA}state/' || o_orderstatus, '{ONT}code', o_orderstatus FROM orders
UNION SELECT {iri('customer', 'c_custkey')}, '{RDF_TYPE}', '{ONT}Customer' FROM customer""")
def rules_that_join(spark: SparkSession, d: str) -> DataFrame:
    """Objects that are other rules' subjects: by a join, by a semi join, and of the row itself."""
    return build_tables(read_rules(JOINED), trade.tables(spark, d, ["orders", "customer"])).graph().select("s", "p", "o")


GRAPHS = PREFIXES + "".join([
    mapping("customer", "customer", _at("customer/{c_custkey}") + f" ; rr:graphMap [ {_at('segment/{c_mktsegment}')} ] ; rr:graph <{DATA}all>", _map("customerName", 'rml:reference "c_name"'), _map("inNation", _at("nation/{c_nationkey}")) + f" ; rr:graph <{DATA}places>"),
    mapping("nation", "nation", _at("nation/{n_nationkey}"), _map("nationName", 'rml:reference "n_name"'), _map("inRegion", _at("region/{n_regionkey}")) + " ; rr:graph rr:defaultGraph ; rr:graph <" + DATA + "places>"),
])
_GRAPHS_SQL = f"""q AS (
  SELECT {iri('customer', 'c_custkey')} AS s, p, o, o_kind, g FROM (SELECT c_custkey, unnest([{{'p': '{ONT}customerName', 'o': c_name, 'o_kind': 'literal', 'g': ['{DATA}segment/' || c_mktsegment, '{DATA}all']}}, {{'p': '{ONT}inNation', 'o': {iri('nation', 'c_nationkey')}, 'o_kind': 'iri', 'g': ['{DATA}segment/' || c_mktsegment, '{DATA}all', '{DATA}places']}}]) AS t FROM customer) c, (SELECT 1), LATERAL (SELECT t.p AS p, t.o AS o, t.o_kind AS o_kind, unnest(t.g) AS g)
  UNION ALL SELECT {iri('nation', 'n_nationkey')}, '{ONT}nationName', n_name, 'literal', NULL FROM nation
  UNION ALL SELECT {iri('nation', 'n_nationkey')}, '{ONT}inRegion', {iri('region', 'n_regionkey')}, 'iri', unnest([NULL, '{DATA}places']) FROM nation)"""


@query(f"WITH {_GRAPHS_SQL} SELECT DISTINCT s, p, o, o_kind, g FROM q")
def named_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Quads of constant and computed graphs, written as N-Quads and read again."""
    path = fresh(spark, "quads")
    write_ntriples(build_tables(read_rules(GRAPHS), trade.tables(spark, d, ["customer", "nation"])).graph(), path)
    return read_nquads(spark, path).select("s", "p", "o", "o_kind", "g")


@query(f"WITH {_GRAPHS_SQL}, d AS (SELECT DISTINCT s, p, o, g FROM q) SELECT coalesce(g, 'default') AS g, p, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY ALL")
def graph_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A triple is counted once in each graph that holds it."""
    quads_ = build_tables(read_rules(GRAPHS), trade.tables(spark, d, ["customer", "nation"])).graph()
    return quads_.groupBy(F.coalesce("g", F.lit("default")).alias("g"), "p").agg(F.count("*").alias("n"))


def _function(name: str, **arguments: str) -> str:
    given = "".join(f" ; rr:predicateObjectMap [ rr:predicate {'idlab' if k in ('str', 'otherStr', 'delimiter', 'strBoolean') else 'grel'}:{k} ; rr:objectMap [ {v} ] ]" for k, v in arguments.items())
    return f"fnml:functionValue [ rr:predicateObjectMap [ rr:predicate fno:executes ; rr:objectMap [ rr:constant {name} ] ]{given} ]"


_LOWER = _function("grel:toLowerCase", valueParameter=_function("grel:string_replace", valueParameter='rml:reference "p_brand"', p_string_find='rr:constant "Brand#"', p_string_replace='rr:constant "b-"'))
CALLED = PREFIXES + mapping(
    "part", "part", _function("idlab:concat", str=f'rr:constant "{DATA}"', otherStr=_LOWER, delimiter='rr:constant "brand/"'),
    _map("typeName", _function("grel:toTitlecase", valueParameter=_function("grel:toLowerCase", valueParameter='rml:reference "p_type"'))),
    _map("price", _function("grel:math_round", p_dec_n=_function("grel:math_max", p_dec_n='rml:reference "p_retailprice"', p_dec_n2='rr:constant "950.5"')) + " ; rr:datatype xsd:integer"),
    _map("large", _function("grel:controls_if", bool_b=_function("grel:string_contains", valueParameter='rml:reference "p_type"', string_sub='rr:constant "LARGE"'), any_true='rr:constant "yes"', any_false='rr:constant "no"')),
)


@query(f"""SELECT DISTINCT '{DATA}brand/' || lower(replace(p_brand, 'Brand#', 'b-')) AS s, p, o FROM (
  SELECT p_brand, '{ONT}typeName' AS p, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS o FROM part
  UNION ALL SELECT p_brand, '{ONT}price', CAST(CAST(round(greatest(CAST(p_retailprice AS DECIMAL(20,4)), 950.5), 0) AS BIGINT) AS VARCHAR) FROM part
  UNION ALL SELECT p_brand, '{ONT}large', CASE WHEN contains(p_type, 'LARGE') THEN 'yes' ELSE 'no' END FROM part)""")
def rule_functions(spark: SparkSession, d: str) -> DataFrame:
    """Nested functions in subjects and objects, as built-in expressions."""
    return build_tables(read_rules(CALLED), trade.tables(spark, d, ["part"])).graph().select("s", "p", "o")


# Regular paths.

#: An order's next one of the same customer, by date; two orders of the same day follow by key.
_NEXT_SQL = "nxt AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """The links of orders to customers, and of these to nations."""
    return build_tables(prune([BY_NAME["orders"], BY_NAME["customer"]], {ONT + "orderedBy", ONT + "inNation"}), trade.tables(spark, d, ["orders", "customer"])).graph()


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """The graph of orders with the link ``next`` beside those of the rules."""
    orders = trade.tables(spark, d, ["orders"])["orders"]
    follows = orders.select("o_orderkey", F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("next"))
    rules = [*prune([BY_NAME["orders"], BY_NAME["customer"]], {ONT + "orderedBy", ONT + "inNation"}), Rule("next", "follows", DATA + "order/{o_orderkey}", (link(ONT + "next", DATA + "order/{next}"),))]
    return build_tables(rules, trade.tables(spark, d, ["orders", "customer"]) | {"follows": follows}).graph()


@query(f"""WITH RECURSIVE {_NEXT_SQL}, two AS (SELECT x.a, y.b FROM nxt x JOIN nxt y ON x.b = y.a WHERE y.b IS NOT NULL), far AS (SELECT a, b FROM two UNION SELECT far.a, two.b FROM far JOIN two ON far.b = two.a)
SELECT {iri('order', 'a')} AS start, {iri('order', 'b')} AS node FROM far UNION SELECT {iri('customer', 'o_custkey')}, {iri('order', 'o_orderkey')} FROM orders""")
def regular_path(spark: SparkSession, d: str) -> DataFrame:
    """``(next/next)+ | ^orderedBy`` between all nodes."""
    return paths.reach(_ordered(spark, d), paths.alt(paths.plus(paths.seq(ONT + "next", ONT + "next")), paths.inverse(ONT + "orderedBy")))


@query(f"""SELECT DISTINCT {iri('customer', 'x.c_custkey')} AS start, node FROM customer x, LATERAL (
  SELECT {iri('customer', 'y.c_custkey')} AS node FROM customer y WHERE y.c_nationkey = x.c_nationkey
  UNION ALL SELECT {iri('order', 'o_orderkey')} FROM customer y JOIN orders ON o_custkey = y.c_custkey WHERE y.c_nationkey = x.c_nationkey) t WHERE x.c_custkey % 50 = 0""")
def regular_path_on_cycles(spark: SparkSession, d: str) -> DataFrame:
    """``(inNation/^inNation)*/(^orderedBy)?`` from some customers: every way but the shortest runs in circles."""
    starts = trade.tables(spark, d, ["customer"])["customer"].filter("c_custkey % 50 = 0").select(F.concat(F.lit(DATA + "customer/"), F.col("c_custkey").cast("string")).alias("node"))
    same = paths.star(paths.seq(ONT + "inNation", paths.inverse(ONT + "inNation")))
    return paths.reach(_placed(spark, d), paths.seq(same, paths.optional(paths.inverse(ONT + "orderedBy"))), starts)


@query(f"""WITH RECURSIVE {_NEXT_SQL}, back AS (SELECT o_orderkey AS b, o_orderkey AS a FROM orders WHERE o_orderkey % 100 = 7 UNION SELECT back.b, nxt.a FROM back JOIN nxt ON nxt.b = back.a)
SELECT DISTINCT {iri('customer', 'o_custkey')} AS start, {iri('order', 'b')} AS node FROM back JOIN orders ON o_orderkey = back.a""")
def regular_path_to_ends(spark: SparkSession, d: str) -> DataFrame:
    """``^orderedBy/next*`` to some orders, walked from these."""
    ends = trade.tables(spark, d, ["orders"])["orders"].filter("o_orderkey % 100 = 7").select(F.concat(F.lit(DATA + "order/"), F.col("o_orderkey").cast("string")).alias("node"))
    return paths.reach(_ordered(spark, d), paths.seq(paths.inverse(ONT + "orderedBy"), paths.star(ONT + "next")), ends=ends)


# Entailed classes through changes.

_CUSTOMER_IRI = iri("customer", "c_custkey")
#: At first all customers have their segment's and nation's class. Then every third one of a segment loses that, suppliers get their
#: nations', the first region is no place any more, and one segment becomes a kind of place.
_CHANGED_SQL = f"""{_CLASS_EDGES_SQL.replace('edges(', 'all_edges(')}, edges AS (SELECT sub, super FROM all_edges WHERE sub <> '{ONT}region/0' UNION SELECT '{ONT}BUILDING', '{ONT}Place'),
up AS (SELECT sub, super FROM edges UNION SELECT u.sub, e.super FROM up u JOIN edges e ON u.super = e.sub),
stated AS (SELECT {_CUSTOMER_IRI} AS s, '{ONT}' || c_mktsegment AS class FROM customer WHERE c_mktsegment <> 'MACHINERY' OR c_custkey % 3 <> 0 UNION SELECT {_CUSTOMER_IRI}, '{ONT}nation/' || CAST(c_nationkey AS VARCHAR) FROM customer UNION SELECT {iri('supplier', 's_suppkey')}, '{ONT}nation/' || CAST(s_nationkey AS VARCHAR) FROM supplier)"""


def _types(spark: SparkSession, d: str, *rules: Rule) -> DataFrame:
    return bag(spark, d, rules=list(rules)).select("s", F.col("o").alias("class"))


@query(f"WITH RECURSIVE {_CHANGED_SQL} SELECT s, class FROM stated UNION SELECT s, super FROM stated JOIN up ON class = sub")
def entailment_under_changes(spark: SparkSession, d: str) -> DataFrame:
    """Types and class edges come and go; each change moves its own consequences."""
    customer, supplier = DATA + "customer/{c_custkey}", DATA + "supplier/{s_suppkey}"
    segment, nation = Rule("t", "customer", customer, (link(RDF_TYPE, ONT + "{c_mktsegment}"),)), Rule("t", "customer", customer, (link(RDF_TYPE, ONT + "nation/{c_nationkey}"),))
    own = MaintainedTypes.create(spark, fresh(spark, "kept"), _types(spark, d, segment, nation), stated_classes(spark, d).class_edges)
    key = F.regexp_extract("s", "[0-9]+$", 0).cast("bigint")
    own.change(removed=_types(spark, d, segment).filter((F.col("class") == ONT + "MACHINERY") & (key % 3 == 0)))
    own.change(added=_types(spark, d, Rule("t", "supplier", supplier, (link(RDF_TYPE, ONT + "nation/{s_nationkey}"),))), edges_removed=frame(spark, [("region/0", "Place")], "sub string, super string", [0, 1]))
    own.change(edges_added=frame(spark, [("BUILDING", "Place")], "sub string, super string", [0, 1]))
    return own.current()


# A data source, streams, sketches, blank nodes, variants.


@query(f"SELECT {iri('supplier', 's_suppkey')} AS s, '{ONT}balance' AS p, CAST(s_acctbal AS VARCHAR) AS o, '{XSD}decimal' AS o_datatype FROM supplier UNION ALL SELECT {iri('customer', 'c_custkey')}, '{ONT}balance', CAST(c_acctbal AS VARCHAR), '{XSD}decimal' FROM customer")
def ntriples_source(spark: SparkSession, d: str) -> DataFrame:
    """One predicate's lines of a file, through the data source that takes others apart no further than their bytes."""
    path = fresh(spark, "lines")
    write_ntriples(kg(spark, d, "supplier", "customer", "nation"), path)
    return scan_lines(spark, path, split=1 << 18).filter(F.col("p") == ONT + "balance").select("s", "p", "o", "o_datatype")


def _streamed(spark: SparkSession, table: DataFrame, base: str) -> DataFrame:
    """A stream of a table's rows, sent twice, in files that follow no order."""
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(_stream_input(spark, table, base))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _written(stream: DataFrame, base: str) -> DataFrame:
    """All that a stream over finite input adds."""
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('millisecond', ts) DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def entity_stream(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user, as the sum of a stream's additions and retractions."""
    base = fresh(spark, "entities")
    changes = _written(entity_changes(_streamed(spark, _events(spark, d), base), "user_id", "ts", "event_id", late="30 days"), base)
    return changes.groupBy("event_id", "user_id", "event_type").agg(F.sum("d").alias("d")).filter("d > 0").drop("d")


_PAIRED_SQL = "SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'"


@query(_PAIRED_SQL)
def stream_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and the purchases of the same user within an hour, of two streams; rows that are sent twice join once."""
    base, events = fresh(spark, "pairs"), _events(spark, d).select("event_id", "user_id", "ts", "event_type")
    sides = [_streamed(spark, events.filter(F.col("event_type") == kind).drop("event_type"), f"{base}/{kind}").withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["event_id"]) for kind in ("click", "purchase")]
    joined = interval_join(*sides, ["user_id"], "ts", "ts", "1 HOUR", None, None)
    return _written(joined.select(F.col("event_id").alias("click"), F.col("event_id_right").alias("purchase")), base)


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, TRUE AS distinct_fits, TRUE AS median_fits FROM events GROUP BY event_type")
def sketches_merged(spark: SparkSession, d: str) -> DataFrame:
    """Daily states of event types, stored, merged over days, and held against exact figures: users within 5 %, the median within 2 % of ranks."""
    path, events = fresh(spark, "states"), _events(spark, d)
    sketches.add_states(sketches.sketch_states(events.withColumn("day", F.to_date("ts")), ["day", "event_type"], "user_id", "value"), path)
    found = sketches.estimates(sketches.merged(spark.read.parquet(path), ["event_type"]), [0.5]).select("event_type", "n", "n_distinct", F.col("quantiles")[0].alias("median"))
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    ranks = events.join(F.broadcast(found), "event_type").groupBy("event_type").agg(F.avg(F.when(F.col("value") <= F.col("median"), 1.0).otherwise(0.0)).alias("share"))
    joined = found.join(exact, "event_type").join(ranks, "event_type")
    return joined.select("event_type", "n", (F.abs(F.col("n_distinct") - F.col("users")) <= 0.05 * F.col("users")).alias("distinct_fits"), (F.abs(F.col("share") - 0.5) <= 0.02).alias("median_fits"))


@query(f"""SELECT '{ONT}priority' AS p, o_orderpriority AS o, 'right' AS side, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 50 = 0 GROUP BY o_orderpriority
UNION ALL SELECT '{ONT}priority', 'none', 'left', CAST(count(*) AS BIGINT) FROM orders WHERE o_orderkey % 50 = 0""")
def diff_of_blank_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as blank nodes hung on their customers, called otherwise on either side; every fiftieth has lost its priority on one.

    Orders are told apart by their total and date; those that stay as they were differ by nothing.
    """
    orders = trade.tables(spark, d, ["orders"])["orders"]
    none = F.lit(None).cast("string")

    def side(name: str, priority) -> DataFrame:
        node = F.concat(F.lit(f"_:{name}"), F.xxhash64("o_orderkey", F.lit(name)).cast("string").substr(2, 30))
        triple = lambda s, p, o, kind: F.struct(s.alias("s"), F.lit(ONT + p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang"))
        customer = F.concat(F.lit(DATA + "customer/"), F.col("o_custkey").cast("string"))
        return orders.select(F.inline(F.array(triple(customer, "ordered", node, "blank"), triple(node, "priority", priority, "literal"), triple(node, "total", F.col("o_totalprice").cast("string"), "literal"), triple(node, "key", F.col("o_orderkey").cast("string"), "literal"))))

    lost = F.when(F.col("o_orderkey") % 50 == 0, "none").otherwise(F.col("o_orderpriority"))
    found = blanks.diff_graphs(side("a", lost), side("b", F.col("o_orderpriority")))
    return found.filter(F.col("p") == ONT + "priority").groupBy("p", "o", "side").agg(F.sum("n").alias("n"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, CAST(count(*) FILTER (CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50) AS BIGINT) AS high FROM events GROUP BY event_type")
def variant_properties(spark: SparkSession, d: str) -> DataFrame:
    """Properties parsed once, laid out as a column beside the rest, stored, and read again by that column alone."""
    path = fresh(spark, "variants")
    variants.shredded(variants.parsed_once(_events(spark, d).select("event_type", "props"), "props"), "props", {"k": ("$.k", "bigint")}).write.parquet(path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("k").alias("total"), F.count_if(F.col("k") >= 50).alias("high"))


#: A supplier and the customer of the same key are the same, and so are customers whose keys differ by 1000.
_SAME = "http://www.w3.org/2002/07/owl#sameAs"


@query(f"""WITH g AS ({sql_triples('customer', 'supplier')}),
best AS (SELECT c_custkey % 1000 AS k, min({iri('customer', 'c_custkey')}) AS name FROM customer GROUP BY 1),
member AS (SELECT {iri('customer', 'c_custkey')} AS node, c_custkey % 1000 AS k FROM customer UNION ALL SELECT {iri('supplier', 's_suppkey')}, s_suppkey % 1000 FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer)),
name AS (SELECT node, name FROM member JOIN best USING (k))
SELECT DISTINCT coalesce(n.name, s) AS s, p, coalesce(m.name, o) AS o, o_kind FROM g LEFT JOIN name n ON n.node = g.s LEFT JOIN name m ON m.node = g.o AND g.o_kind = 'iri'""")
def aligned_nodes_merged(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers that are stated to be the same, over chains of statements, as one node each."""
    t = trade.tables(spark, d, ["customer", "supplier"])
    keys = t["customer"].select(F.col("c_custkey").alias("key"))
    node = lambda kind, c: F.concat(F.lit(f"{DATA}{kind}/"), c.cast("string"))
    chain = keys.join(keys.select((F.col("key") + 1000).alias("key"), F.col("key").alias("before")), "key").select(node("customer", F.col("before")).alias("s"), node("customer", F.col("key")).alias("o"))
    pairs = t["supplier"].join(keys, F.col("s_suppkey") == F.col("key")).select(node("supplier", F.col("key")).alias("s"), node("customer", F.col("key")).alias("o"))
    none = F.lit(None).cast("string")
    said = chain.union(pairs).select("s", F.lit(_SAME).alias("p"), "o", F.lit("iri").alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang"), F.lit("same").alias("src"))
    return graph.merge_aligned(kg(spark, d, "customer", "supplier").unionByName(said), _SAME, DATA + "customer/").select("s", "p", "o", "o_kind")
