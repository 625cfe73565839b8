"""A mapping and an ontology over trade tables, for graphs that need no files but Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import RDF_TYPE, XSD
from .sources.rules import Rule, constant, link, literal

DATA, ONT = "http://example.org/data/", "http://example.org/ontology#"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"


def _text(name: str, column: str):
    return literal(ONT + name, column, XSD + "string")


def _number(name: str, column: str, kind: str = "decimal"):
    return literal(ONT + name, column, XSD + kind)


RULES = [
    Rule("region", "region", DATA + "region/{r_regionkey}", (constant(RDF_TYPE, ONT + "Region"), _text("regionName", "r_name"))),
    Rule("nation", "nation", DATA + "nation/{n_nationkey}", (constant(RDF_TYPE, ONT + "Nation"), _text("nationName", "n_name"), link(ONT + "inRegion", DATA + "region/{n_regionkey}"))),
    Rule("customer", "customer", DATA + "customer/{c_custkey}", (constant(RDF_TYPE, ONT + "Customer"), _text("customerName", "c_name"), literal(LABEL, "c_name", XSD + "string"), _number("balance", "c_acctbal"), link(ONT + "inNation", DATA + "nation/{c_nationkey}"))),
    Rule("customer_types", "customer", DATA + "customer/{c_custkey}", (link(RDF_TYPE, ONT + "{c_mktsegment}"), constant(RDF_TYPE, ONT + "Customer"))),
    Rule("supplier", "supplier", DATA + "supplier/{s_suppkey}", (constant(RDF_TYPE, ONT + "Supplier"), _text("supplierName", "s_name"), _number("balance", "s_acctbal"), link(ONT + "inNation", DATA + "nation/{s_nationkey}"))),
    Rule("part", "part", DATA + "part/{p_partkey}", (constant(RDF_TYPE, ONT + "Part"), _text("partName", "p_name"), _text("brand", "p_brand"), _number("partSize", "p_size", "integer"), _number("retailPrice", "p_retailprice"))),
    Rule("orders", "orders", DATA + "order/{o_orderkey}", (constant(RDF_TYPE, ONT + "Order"), _text("priority", "o_orderpriority"), _number("totalPrice", "o_totalprice"), _number("orderYear", "o_year", "gYear"), literal(ONT + "orderedAt", "o_orderdate", XSD + "dateTime"), link(ONT + "orderedBy", DATA + "customer/{o_custkey}"))),
    Rule("lineitem", "lineitem", DATA + "line/{l_orderkey}-{l_linenumber}", (constant(RDF_TYPE, ONT + "OrderLine"), link(ONT + "ofOrder", DATA + "order/{l_orderkey}"), link(ONT + "ofPart", DATA + "part/{l_partkey}"), link(ONT + "fromSupplier", DATA + "supplier/{l_suppkey}"), _number("quantity", "l_quantity"), _number("price", "l_extendedprice"))),
]
BY_NAME = {r.name: r for r in RULES}


def tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    read = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    if "orders" in read:
        read["orders"] = read["orders"].withColumn("o_year", F.year("o_orderdate"))
    if "lineitem" in read:
        read["lineitem"] = read["lineitem"].withColumn("rebate", F.col("l_extendedprice") * F.col("l_discount") / 3)
    return read


CLASS_EDGES = [("Customer", "Party"), ("Supplier", "Party"), ("Party", "Thing"), ("Region", "Place"), ("Nation", "Place"), ("Place", "Thing"), ("Order", "Document"), ("OrderLine", "Document"), ("Document", "Thing"), *[(s, "Customer") for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]]
#: property, side, choice, class. Some are wrong on purpose: a check that never fails shows nothing.
SIDES = [
    ("inRegion", "domain", 0, "Nation"), ("inRegion", "range", 0, "Region"),
    ("inNation", "domain", 0, "Customer"), ("inNation", "domain", 0, "Supplier"), ("inNation", "range", 0, "Place"),
    ("balance", "domain", 0, "Supplier"), ("balance", "domain", 1, "BUILDING"),
    ("orderedBy", "domain", 0, "Document"), ("orderedBy", "range", 0, "AUTOMOBILE"), ("orderedBy", "range", 0, "MACHINERY"),
]
TERMS = [*[(c, "class") for c in ("Customer", "Supplier", "Party", "Thing", "Region", "Nation", "Place", "Order", "Document", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")], *[(p, "object_property") for p in ("inRegion", "inNation", "orderedBy", "shippedVia")], *[(p, "datatype_property") for p in ("regionName", "nationName", "customerName", "balance", "faxNumber")]]
LITERAL_RANGES = [("balance", "decimal"), ("partSize", "decimal"), ("priority", "string"), ("orderYear", "gYear")]


def frame(spark: SparkSession, rows: list[tuple], schema: str, iris: list[int]) -> DataFrame:
    """A small ontology table; positions in ``iris`` hold local names."""
    return spark.createDataFrame([tuple(ONT + v if i in iris else v for i, v in enumerate(r)) for r in rows], schema)
