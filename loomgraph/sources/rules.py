"""Mapping rules: how rows of a table, or parts of nested documents, become triples and quads."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from .turtle import RDF, Blank, Iri, Literal, Term, parse

RR = "http://www.w3.org/ns/r2rml#"
RML = "http://semweb.mmlab.be/ns/rml#"
QL = "http://semweb.mmlab.be/ns/ql#"
FNML = "http://semweb.mmlab.be/ns/fnml#"
EXECUTES = "https://w3id.org/function/ontology#executes"
FORMULATIONS = {QL + "CSV": "csv", QL + "JSONPath": "json"}
KNOWN = {
    RDF + "type",
    *(RR + x for x in ("subjectMap", "predicateObjectMap", "predicate", "object", "objectMap", "template", "constant", "termType", "datatype", "class", "graph", "graphMap", "parentTriplesMap", "joinCondition", "child", "parent")),
    *(RML + x for x in ("logicalSource", "source", "referenceFormulation", "reference", "iterator")),
    FNML + "functionValue",
}
STRING = "http://www.w3.org/2001/XMLSchema#string"


class UnsupportedRule(ValueError):
    """A rule uses a term that has no meaning here; it is never passed over."""


@dataclass(frozen=True)
class Call:
    """A function by its IRI, and a value for each of its parameters."""

    function: str
    arguments: tuple[tuple[str, Value], ...] = ()


@dataclass(frozen=True)
class Value:
    """One of a template, a constant, a reference to a column or path, and a function's result."""

    template: str | None = None
    constant: str | None = None
    reference: str | None = None
    call: Call | None = None

    def references(self) -> Iterator[str]:
        """The columns or paths that the value reads, in order."""
        if self.reference is not None:
            yield self.reference
        yield from placeholders(self.template or "")
        for _, v in self.call.arguments if self.call else ():
            yield from v.references()


@dataclass(frozen=True)
class ObjectMap:
    """A value that is an IRI or a literal of ``datatype``; or the subject that the rule ``parent`` gives to the rows whose
    columns equal this row's, by ``joins`` of (child, parent) columns. ``graphs`` are added to those of the rule."""

    predicate: str
    template: str | None = None
    constant: str | None = None
    reference: str | None = None
    iri: bool = True
    datatype: str | None = None
    call: Call | None = None
    parent: str | None = None
    joins: tuple[tuple[str, str], ...] = ()
    graphs: tuple[Value, ...] = ()

    @property
    def value(self) -> Value:
        return Value(self.template, self.constant, self.reference, self.call)


@dataclass(frozen=True)
class Rule:
    """One source, one subject (a template, or a function's result), any number of objects.

    ``iterator`` is the path of the parts of a document that each have a subject. Without ``graphs``, triples are of the default graph.
    """

    name: str
    source: str
    subject: str | Call
    objects: tuple[ObjectMap, ...] = ()
    formulation: str = "csv"
    iterator: str | None = None
    graphs: tuple[Value, ...] = ()

    @property
    def about(self) -> Value:
        return Value(template=self.subject) if isinstance(self.subject, str) else Value(call=self.subject)

    def columns(self) -> list[str]:
        """The columns or paths that the rule reads, in order of first mention."""
        named = list(self.about.references())
        for o in self.objects:
            named += [*o.value.references(), *(child for child, _ in o.joins), *(r for g in o.graphs for r in g.references())]
        named += [r for g in self.graphs for r in g.references()]
        return list(dict.fromkeys(named))

    def plain(self) -> bool:
        """Whether the rule is a flat table's and uses templates, constants and references alone, in the default graph."""
        return self.formulation == "csv" and isinstance(self.subject, str) and not self.graphs and not any(o.call or o.parent or o.graphs for o in self.objects)


def placeholders(template: str) -> list[str]:
    return re.findall(r"(?<!\\)\{([^{}]*)\}", template)


def link(predicate: str, template: str) -> ObjectMap:
    return ObjectMap(predicate, template=template)


def literal(predicate: str, reference: str, datatype: str) -> ObjectMap:
    return ObjectMap(predicate, reference=reference, iri=False, datatype=datatype)


def constant(predicate: str, iri: str) -> ObjectMap:
    return ObjectMap(predicate, constant=iri)


def call(function: str, **arguments) -> Call:
    """A call of a registered function by its name: columns by ``{name}`` templates, other text as constants."""
    from ..functions.calls import BY_NAME

    iri, known = BY_NAME[function]
    wrap = lambda v: v if isinstance(v, Value) else Value(call=v) if isinstance(v, Call) else Value(reference=v[1:-1]) if re.fullmatch(r"\{[^{}]+\}", v) else Value(constant=v)
    names = {p.rpartition("#")[2].rpartition("/")[2]: p for p, _ in known.parameters}
    return Call(iri, tuple((names[k], wrap(v)) for k, v in arguments.items()))


class _Rules:
    """The statements of a mapping file, by subject and predicate."""

    def __init__(self, text: str):
        self.about: dict[Term, dict[str, list[Term]]] = defaultdict(lambda: defaultdict(list))
        for s, p, o in parse(text):
            if p not in KNOWN:
                raise UnsupportedRule(f"{p} is not supported")
            self.about[s][p].append(o)

    def all(self, node: Term, p: str) -> list[Term]:
        return self.about[node][p] if node in self.about else []

    def one(self, node: Term, p: str) -> Term | None:
        values = self.all(node, p)
        if len(values) > 1:
            raise UnsupportedRule(f"{p} is given more than once")
        return values[0] if values else None

    def text(self, node: Term, p: str) -> str | None:
        value = self.one(node, p)
        return value.value if isinstance(value, (Iri, Literal)) else None

    def value(self, node: Term) -> Value:
        """What a term map says: exactly one of template, constant, reference and function."""
        function = self.one(node, FNML + "functionValue")
        given = (self.text(node, RR + "template"), self.text(node, RR + "constant"), self.text(node, RML + "reference"), self.call(function) if function is not None else None)
        if sum(g is not None for g in given) != 1:
            raise UnsupportedRule(f"{node}: a term has one of template, constant, reference and functionValue")
        return Value(*given)

    def call(self, node: Term) -> Call:
        function, arguments = None, []
        for pair in self.all(node, RR + "predicateObjectMap"):
            name = self.text(pair, RR + "predicate")
            value = self._object(pair)
            if name == EXECUTES:
                function = value.constant
            else:
                arguments.append((name, value))
        if function is None:
            raise UnsupportedRule(f"{node}: a function value says what it executes")
        from ..functions.calls import FUNCTIONS

        if function not in FUNCTIONS:
            raise UnsupportedRule(f"the function {function} is not known")
        strange = {a for a, _ in arguments} - {p for p, _ in FUNCTIONS[function].parameters}
        if strange:
            raise UnsupportedRule(f"{function} has no parameter {', '.join(sorted(map(str, strange)))}")
        return Call(function, tuple(arguments))

    def _object(self, pair: Term) -> Value:
        short = self.one(pair, RR + "object")
        return Value(constant=short.value) if isinstance(short, (Iri, Literal)) else self.value(self.one(pair, RR + "objectMap"))

    def graphs(self, node: Term) -> tuple[Value, ...]:
        named = [Value(constant=g.value) for g in self.all(node, RR + "graph") if isinstance(g, Iri)]
        return (*named, *(self.value(g) for g in self.all(node, RR + "graphMap")))

    def objects(self, pair: Term, names: dict[Term, str]) -> Iterator[ObjectMap]:
        predicate, graphs = self.text(pair, RR + "predicate"), self.graphs(pair)
        if predicate is None:
            raise UnsupportedRule(f"{pair}: a constant predicate is needed")
        for short in self.all(pair, RR + "object"):
            literal_ = isinstance(short, Literal)
            yield ObjectMap(predicate, constant=short.value, iri=not literal_, datatype=(short.datatype or STRING) if literal_ else None, graphs=graphs)
        for o in self.all(pair, RR + "objectMap"):
            parent = self.one(o, RR + "parentTriplesMap")
            if parent is not None:
                if parent not in names:
                    raise UnsupportedRule(f"{parent} is no rule here")
                joins = tuple((self.text(j, RR + "child"), self.text(j, RR + "parent")) for j in self.all(o, RR + "joinCondition"))
                if any(side is None for j in joins for side in j):
                    raise UnsupportedRule(f"{pair}: a join condition has a child and a parent")
                yield ObjectMap(predicate, parent=names[parent], joins=joins, graphs=graphs)
                continue
            value, kind, datatype = self.value(o), self.text(o, RR + "termType"), self.text(o, RR + "datatype")
            if kind not in (None, RR + "IRI", RR + "Literal"):
                raise UnsupportedRule(f"{pair}: term type {kind}")
            iri = datatype is None and (kind == RR + "IRI" or (kind is None and value.reference is None and value.call is None))
            yield ObjectMap(predicate, value.template, value.constant, value.reference, iri, None if iri else datatype or STRING, value.call, graphs=graphs)


def _name(node: Term) -> str:
    return node.value.rpartition("#")[2] if isinstance(node, Iri) else str(node)


def read_rules(text: str) -> list[Rule]:
    """Rules of a mapping file, in its order. Terms without a meaning here raise ``UnsupportedRule``."""
    held = _Rules(text)
    maps = [s for s in list(held.about) if Iri(RR + "TriplesMap") in held.all(s, RDF + "type")]
    names, rules = {m: _name(m) for m in maps}, []
    if len(set(names.values())) < len(names):
        raise UnsupportedRule("two rules have the same name")
    for node in maps:
        source, subject = held.one(node, RML + "logicalSource"), held.one(node, RR + "subjectMap")
        if not isinstance(source, Blank) or not isinstance(subject, Blank) or held.text(source, RML + "source") is None:
            raise UnsupportedRule(f"{node}: a logical source and a subject map are needed")
        formulation = FORMULATIONS.get(held.text(source, RML + "referenceFormulation") or QL + "CSV")
        if formulation is None:
            raise UnsupportedRule(f"{node}: only CSV and JSON sources are read")
        iterator = held.text(source, RML + "iterator")
        if iterator is not None and formulation != "json":
            raise UnsupportedRule(f"{node}: rows of a table are not iterated over")
        about = held.value(subject)
        if about.template is None and about.call is None:
            raise UnsupportedRule(f"{node}: a subject is a template or a function's result")
        objects = [ObjectMap(RDF + "type", constant=c.value) for c in held.all(subject, RR + "class")]
        for pair in held.all(node, RR + "predicateObjectMap"):
            objects += held.objects(pair, names)
        rules.append(Rule(names[node], held.text(source, RML + "source"), about.template or about.call, tuple(objects), formulation, iterator, held.graphs(subject)))
    return rules
