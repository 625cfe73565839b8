"""RDF terms as Spark column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"

#: One triple a row. ``o_kind`` is iri, literal or blank; blank nodes are written ``_:name``. ``src`` names the rule a triple
#: comes from and is no part of its identity.
TRIPLE = "s string, p string, o string, o_kind string, o_datatype string, o_lang string, src string"
IDENTITY = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]
#: A quad's graph, where there are named graphs: null is the default one.
GRAPH = "g"


def identity(columns: list[str]) -> list[str]:
    """What tells triples apart, or quads where there are graphs."""
    return [*IDENTITY, GRAPH] if GRAPH in columns else IDENTITY

_ESCAPED = r"[\x00-\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7D\x7F]"


def iri_safe(value: Column) -> Column:
    """Percent-encode what an IRI template may not copy: ASCII other than letters, digits and ``- . _ ~``.

    Most keys hold nothing to encode and take the first branch. Null stays null.
    """
    coded = F.array_join(F.transform(F.split(value, ""), lambda c: F.when(c.rlike(_ESCAPED), F.concat(F.lit("%"), F.hex(c.cast("binary")))).otherwise(c)), "")
    return F.when(~value.rlike(_ESCAPED), value).otherwise(coded)


def plain_number(number: Column) -> Column:
    """A double's text, with all digits that it takes to read it back and without an exponent; whole numbers end in .0.

    Numbers with an exponent are written out within a lambda, which is called and not compiled into the code around it: with that
    a rule of one number made methods of more than the 8,000 bytes that the JVM compiles at most.
    """

    def written(text: Column) -> Column:
        part = lambda k: F.regexp_extract(text, r"^(-?)([0-9])\.([0-9]+)E(-?[0-9]+)$", k)
        digits, power = F.concat(part(2), F.when(part(3) == "0", "").otherwise(part(3))), part(4).try_cast("int")
        whole = power + 1 - F.length(digits)
        up = F.when(whole >= 0, F.concat(digits, F.repeat(F.lit("0"), whole), F.lit(".0"))).otherwise(F.concat(digits.substr(F.lit(1), power + 1), F.lit("."), digits.substr(power + 2, F.length(digits))))
        down = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        return F.concat(part(1), F.when(power >= 0, up).otherwise(down))

    # Hardly a number has an exponent; the others take the first branch. Infinity and NaN have no capital E.
    text = number.cast("string")
    return F.when(~text.contains("E"), text).otherwise(F.transform(F.array(text), written)[0])


def lexical(c: Column, kind: T.DataType) -> Column:
    """A column's text as it stands in a literal: strings as they are, doubles with all their digits, times in UTC."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return plain_number(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return c.cast("string")


def encoded(c: Column, kind: T.DataType) -> Column:
    """A column's text as it stands in an IRI. Whole numbers and dates hold nothing to encode."""
    return lexical(c, kind) if isinstance(kind, (T.IntegralType, T.DateType, T.BooleanType)) else iri_safe(lexical(c, kind))


def template(text: str, part: Callable[[str], Column]) -> Column:
    """``http://x/{a}/{b}`` filled in with what ``part`` gives for each name; null if any of them is."""
    parts = []
    for i, piece in enumerate(re.split(r"(?<!\\)\{([^{}]*)\}", text)):
        if i % 2:
            parts.append(part(piece))
        elif piece:
            parts.append(F.lit(piece.replace("\\{", "{").replace("\\}", "}")))
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.lit("")


def local_name(iri: Column) -> Column:
    """What follows the last # or /."""
    return F.regexp_extract(iri, r"([^#/]*)$", 1)


#: Characters that literals hold as numbers; those with a letter of their own come apart.
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
_PIECE = r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\"


def escape(value: Column) -> Column:
    """A literal's text as N-Triples write it."""
    for raw, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(raw), F.lit(coded))
    numbered = F.array_join(F.transform(F.split(value, ""), lambda c: F.when(c.rlike(_CONTROL), F.concat(F.lit("\\u00"), F.hex(c.cast("binary")))).otherwise(c)), "")
    return F.when(value.rlike(_CONTROL), numbered).otherwise(value)


def unescape(value: Column) -> Column:
    """What N-Triples text stands for: marks after a backslash, and characters by number, of four digits (pairs of surrogates
    together) or eight. Most texts hold no backslash and take the first branch."""

    def said(x: Column) -> Column:
        four = F.decode(F.unhex(F.replace(x, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        eight = F.decode(F.unhex(x.substr(3, 8)), "UTF-32")
        out = F.when(x.startswith("\\u") & (F.length(x) > 2), four).when(x.startswith("\\U") & (F.length(x) > 2), eight)
        for letter, raw in (("n", "\n"), ("r", "\r"), ("t", "\t"), ("b", "\b"), ("f", "\f"), ('"', '"'), ("'", "'"), ("\\", "\\")):
            out = out.when(x == "\\" + letter, F.lit(raw))
        return out.otherwise(x)

    pieces = F.regexp_extract_all(value, F.lit(_PIECE), F.lit(0))
    return F.when(~value.contains("\\"), value).otherwise(F.array_join(F.transform(pieces, said), ""))


def typed(value: Column, datatype: Column) -> Column:
    """The numeric value of a literal, or null where its text isn't valid for its datatype; the text itself stays as it is."""
    number = datatype.isin(*[XSD + t for t in ("decimal", "integer", "gYear")])
    return F.when(number, value.try_cast("decimal(38,10)"))


def valid_lexical(value: Column, datatype: Column) -> Column:
    """Whether a literal's text fits its datatype."""
    patterns = {"integer": r"^[+-]?[0-9]+$", "decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$", "gYear": r"^-?[0-9]{4,}(Z|[+-][0-9]{2}:[0-9]{2})?$", "dateTime": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"}
    out = F.lit(True)
    for name, pattern in patterns.items():
        out = F.when(datatype == XSD + name, value.rlike(pattern)).otherwise(out)
    return out
