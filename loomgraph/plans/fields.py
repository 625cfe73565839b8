"""What rules read of a row: columns of a table, or paths into a nested document.

A path is the part of JSONPath that names places: ``$`` (the document), ``.name``, ``['name']`` and ``[*]`` (all of a list). A
rule's paths start at the part that its iterator stands at, or at the document if they start with ``$``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calls import evaluate, text_of
from ..functions.terms import encoded, lexical, template
from ..sources.rules import Rule, UnsupportedRule, Value

ALL = "*"
_STEP = re.compile(r"\.?(?:([^.\[\]'\"$@*]+)|\[\s*'([^']*)'\s*\]|\[\s*\"([^\"]*)\"\s*\]|\[\s*(\*)\s*\])")


def steps(path: str) -> list[str]:
    """A path's names and ``*``; filters, indexes and descents raise."""
    out, at = [], len(path) - len(path.lstrip("$@"))
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise UnsupportedRule(f"the path {path} isn't supported from {path[at:]}")
        out.append(next(g for g in m.groups() if g is not None))
        at = m.end()
    return out


def _within(rule: Rule, path: str) -> list[str]:
    return steps(path) if path.startswith("$") else [*start(rule), *steps(path)]


def start(rule: Rule) -> list[str]:
    """The steps of a rule's iterator. A list at the top has its elements as documents."""
    own = steps(rule.iterator or "$")
    return own[1:] if own[:1] == [ALL] else own


def shape(rules: Iterable[Rule], also: Iterable[tuple[Rule, str]] = ()) -> T.StructType:
    """The schema of documents, as far as rules read them: whatever they read is text, so that numbers keep their form.

    No look at the data is needed. ``also`` names further paths of a rule.
    """
    tree: dict = {}
    wanted = [(r, c) for r in rules for c in r.columns()] + list(also)
    for rule, path in wanted:
        node = tree
        for step in _within(rule, path):
            node = node.setdefault(step, {})
    for rule in rules:
        node = tree
        for step in start(rule):
            node = node.setdefault(step, {})

    def kind(node: dict, path: str) -> T.DataType:
        if not node:
            return T.StringType()
        if ALL in node:
            if len(node) > 1:
                raise UnsupportedRule(f"{path} is read as a list and as an object")
            return T.ArrayType(kind(node[ALL], path + "[*]"))
        return T.StructType([T.StructField(name, kind(x, f"{path}.{name}")) for name, x in node.items()])

    found = kind(tree, "$")
    if not isinstance(found, T.StructType):
        raise UnsupportedRule("documents are objects, or lists of them")
    return found


class Table:
    """Fields of a flat row."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def _at(self, name: str) -> tuple[Column, T.DataType]:
        return F.col(f"`{name}`"), self.schema[name].dataType

    def text(self, value: Value) -> Column:
        """A value as text; null where what it reads is missing."""
        if value.call is not None:
            return text_of(*evaluate(value.call, self.text))
        if value.constant is not None:
            return F.lit(value.constant)
        return template(value.template, lambda n: encoded(*self._at(n))) if value.template is not None else lexical(*self._at(value.reference))

    def several(self, value: Value) -> bool:
        """Whether a value is a list: a path through one."""
        return False

    def over(self, make: Callable[[Table], Column], kind: str) -> Column:
        """What ``make`` gives (arrays of type ``kind``) for each part of the row that the rule iterates over, one after the other."""
        return make(self)


def _walk(node: Column, kind: T.DataType, way: list[str], make: Callable[[Column, T.DataType], Column], empty: Column) -> Column:
    """What ``make`` gives, an array, at each place that a way leads to from a node; missing places give nothing."""
    if not way:
        return make(node, kind)
    if way[0] == ALL:
        parts = F.transform(node, lambda x: _walk(x, kind.elementType, way[1:], make, empty))
        return F.coalesce(F.flatten(parts), empty)
    return _walk(node[way[0]], kind[way[0]].dataType, way[1:], make, empty)


class Document(Table):
    """Fields of one part of a nested row, at ``node``; paths from ``$`` start at the row's top."""

    def __init__(self, schema: T.StructType, rule: Rule, node: Column | None = None, kind: T.DataType | None = None):
        super().__init__(schema)
        self.rule, self.node, self.kind = rule, node, kind

    def _top(self, way: list[str]) -> tuple[Column, T.DataType, list[str]]:
        return F.col(f"`{way[0]}`"), self.schema[way[0]].dataType, way[1:]

    def _place(self, path: str) -> tuple[Column, T.DataType, list[str]]:
        way = steps(path)
        if path.startswith("$") or self.node is None:
            return self._top(way)
        return self.node, self.kind, way

    def _at(self, name: str) -> tuple[Column, T.DataType]:
        node, kind, way = self._place(name)
        if ALL in way:
            raise UnsupportedRule(f"{name} is a list; a template needs one value")
        for step in way:
            node, kind = node[step], kind[step].dataType
        return node, kind

    def several(self, value: Value) -> bool:
        return value.reference is not None and ALL in steps(value.reference)

    def all(self, value: Value) -> Column:
        """The texts of a path through lists, as one array."""
        empty = F.array().cast("array<string>")
        node, kind, way = self._place(value.reference)
        return _walk(node, kind, way, lambda x, k: F.array(lexical(x, k)), empty)

    def over(self, make: Callable[[Table], Column], kind: str) -> Column:
        way = start(self.rule)
        if not way:
            return make(self)
        node, at, rest = self._top(way)
        return _walk(node, at, rest, lambda x, k: make(Document(self.schema, self.rule, x, k)), F.array().cast(kind))


def fields(rule: Rule, schema: T.StructType) -> Table:
    return Document(schema, rule) if rule.formulation == "json" else Table(schema)


def parsed(table: DataFrame, column: str, rules: list[Rule]) -> DataFrame:
    """Documents that a text column holds, as rows that rules read. Null texts give nothing; those that are no JSON raise."""
    texts = table.filter(F.col(column).isNotNull())
    return texts.select(F.from_json(column, shape(rules), {"mode": "FAILFAST"}).alias("_d")).select("_d.*")

