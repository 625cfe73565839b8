"""Functions that rules may call, as Spark expressions: a registry by IRI, with typed parameters.

Calls nest: an inner call's result goes on with its type, and becomes text once, where a term is made of it. A null argument gives
null unless a function says otherwise. Text that isn't valid for a parameter's type is null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

GREL = "http://users.ugent.be/~bjdmeest/function/grel.ttl#"
IDLAB = "http://example.com/idlab/function/"
DECIMAL = "decimal(38,10)"
TYPES = {"string": "string", "integer": "bigint", "decimal": DECIMAL, "boolean": "boolean", "date": "date"}


@dataclass(frozen=True)
class Function:
    """Parameters (IRI, type) in the order that ``build`` takes their columns, and the result's type: one of TYPES."""

    parameters: tuple[tuple[str, str], ...]
    result: str
    build: Callable[..., Column]


FUNCTIONS: dict[str, Function] = {}
BY_NAME: dict[str, tuple[str, Function]] = {}


def register(iri: str, parameters: list[tuple[str, str]], result: str, build: Callable[..., Column]) -> None:
    """Make a function known to rules, under its IRI and (for rules in Python) what follows the last # or /."""
    if {result, *(t for _, t in parameters)} - set(TYPES):
        raise ValueError(f"{iri}: types are {', '.join(TYPES)}")
    FUNCTIONS[iri] = Function(tuple(parameters), result, build)
    BY_NAME[iri.rpartition("#")[2].rpartition("/")[2]] = (iri, FUNCTIONS[iri])


def evaluate(call, resolve: Callable[[object], Column]) -> tuple[Column, str]:
    """A call's column and type. ``resolve`` gives the text of a value that is no call."""
    function, given = FUNCTIONS[call.function], dict(call.arguments)

    def argument(name: str, kind: str) -> Column:
        value = given.get(name)
        if value is None:
            return F.lit(None).cast(TYPES[kind])
        column, have = evaluate(value.call, resolve) if value.call is not None else (resolve(value), "string")
        return column if have == kind else text_of(column, have) if kind == "string" else text_of(column, have).try_cast(TYPES[kind])

    return function.build(*[argument(p, t) for p, t in function.parameters]), function.result


def text_of(column: Column, kind: str) -> Column:
    """A typed result as text: decimals without zeros at their end."""
    if kind == "decimal":
        text = column.cast("string")
        return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return column.cast("string")


V, S = GREL + "valueParameter", "string"
V2 = GREL + "valueParameter2"
P = lambda name: GREL + name
_text = lambda c: F.coalesce(c, F.lit(""))

register(GREL + "toUpperCase", [(V, S)], S, F.upper)
register(GREL + "toLowerCase", [(V, S)], S, F.lower)
register(GREL + "toTitlecase", [(V, S)], S, F.initcap)
register(GREL + "string_trim", [(V, S)], S, lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))
register(GREL + "string_length", [(V, S)], "integer", lambda v: F.length(v).cast("bigint"))
register(GREL + "string_replace", [(V, S), (P("p_string_find"), S), (P("p_string_replace"), S)], S, lambda v, find, new: F.replace(v, find, new))
register(GREL + "string_substring", [(V, S), (P("param_int_i_from"), "integer"), (P("param_int_i_opt_to"), "integer")], S, lambda v, start, end: F.substr(v, (start + 1).cast("int"), (F.coalesce(end, F.length(v)) - start).cast("int")))
register(GREL + "string_startsWith", [(V, S), (P("string_sub"), S)], "boolean", lambda v, part: F.startswith(v, part))
register(GREL + "string_endsWith", [(V, S), (P("string_sub"), S)], "boolean", lambda v, part: F.endswith(v, part))
register(GREL + "string_contains", [(V, S), (P("string_sub"), S)], "boolean", lambda v, part: F.contains(v, part))
register(GREL + "string_md5", [(V, S)], S, F.md5)
register(GREL + "math_round", [(P("p_dec_n"), "decimal")], "integer", lambda n: F.round(n, 0).cast("bigint"))
register(GREL + "math_floor", [(P("p_dec_n"), "decimal")], "integer", lambda n: F.floor(n).cast("bigint"))
register(GREL + "math_ceil", [(P("p_dec_n"), "decimal")], "integer", lambda n: F.ceil(n).cast("bigint"))
register(GREL + "math_abs", [(P("p_dec_n"), "decimal")], "decimal", lambda n: F.abs(n).cast(DECIMAL))
register(GREL + "math_min", [(P("p_dec_n"), "decimal"), (P("p_dec_n2"), "decimal")], "decimal", F.least)
register(GREL + "math_max", [(P("p_dec_n"), "decimal"), (P("p_dec_n2"), "decimal")], "decimal", F.greatest)
register(GREL + "boolean_and", [(P("param_rep_b"), "boolean"), (P("param_rep_b2"), "boolean")], "boolean", lambda a, b: a & b)
register(GREL + "boolean_or", [(P("param_rep_b"), "boolean"), (P("param_rep_b2"), "boolean")], "boolean", lambda a, b: a | b)
register(GREL + "boolean_not", [(P("bool_b"), "boolean")], "boolean", lambda b: ~b)
register(GREL + "controls_if", [(P("bool_b"), "boolean"), (P("any_true"), S), (P("any_false"), S)], S, lambda b, yes, no: F.when(b, yes).otherwise(no))
register(GREL + "date_part_year", [(P("p_date_d"), "date")], "integer", lambda d: F.year(d).cast("bigint"))
# These say what null gives: a missing part of a concatenation is empty, and whether values are equal is always known.
register(IDLAB + "concat", [(IDLAB + "str", S), (IDLAB + "otherStr", S), (IDLAB + "delimiter", S)], S, lambda a, b, between: F.when(a.isNotNull() | b.isNotNull(), F.concat(_text(a), F.when(a.isNotNull() & b.isNotNull(), _text(between)).otherwise(""), _text(b))))
register(IDLAB + "equal", [(V, S), (V2, S)], "boolean", lambda a, b: a.eqNullSafe(b))
register(IDLAB + "notEqual", [(V, S), (V2, S)], "boolean", lambda a, b: ~a.eqNullSafe(b))
register(IDLAB + "isNull", [(IDLAB + "str", S)], "boolean", lambda a: a.isNull())
register(IDLAB + "trueCondition", [(IDLAB + "strBoolean", "boolean"), (IDLAB + "str", S)], S, lambda b, v: F.when(b, v))
register(IDLAB + "toUpperCaseURL", [(IDLAB + "str", S)], S, lambda v: F.concat(F.when(F.upper(v).startswith("HTTP://"), "").otherwise("HTTP://"), F.upper(v)))
