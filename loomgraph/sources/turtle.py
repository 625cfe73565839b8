"""Reads the part of Turtle that rule files and ontologies are written in. Such files are small and are read on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urljoin

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
  | (?P<directive>@prefix\b|@base\b)
  | (?P<iri><[^<>"{}|^`\\\s]*>)
  | (?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3})
  | (?P<text>"(?:[^"\\\n]|\\.)*")
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<number>[+-]?(?:[0-9]+\.[0-9]+|[0-9]+))
  | (?P<name>[A-Za-z_][\w.-]*:[\w-]*(?:\.[\w-]+)*|:[\w-]+(?:\.[\w-]+)*|[A-Za-z][\w-]*:|:|\ba\b|true|false)
  | (?P<mark>\^\^|[.;,\[\]()])""",
    re.X | re.S,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Blank:
    number: int


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str | None = None
    lang: str | None = None


Term = Iri | Blank | Literal


class TurtleError(ValueError):
    """The text is no Turtle, or uses a part of it that isn't read here."""


def _unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" else ESCAPES[m[1]], text)


class _Reader:
    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise TurtleError(f"unexpected text at line {text.count(chr(10), 0, at) + 1}: {text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.base, self.prefixes, self.blanks = 0, "", {}, 0
        self.triples: list[tuple[Term, str, Term]] = []

    def take(self, *marks: str) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TurtleError("the text ends within a statement")
        kind, value = self.tokens[self.at]
        if marks and value not in marks:
            raise TurtleError(f"expected {' or '.join(marks)}, found {value!r}")
        self.at += 1
        return kind, value

    def next_is(self, mark: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] == mark

    def blank(self) -> Blank:
        self.blanks += 1
        return Blank(self.blanks)

    def resolve(self, kind: str, value: str) -> Iri:
        if kind == "iri":
            return Iri(urljoin(self.base, value[1:-1]) if not re.match(r"[A-Za-z][\w+.-]*:", value[1:]) else value[1:-1])
        prefix, _, local = value.partition(":")
        if prefix not in self.prefixes:
            raise TurtleError(f"unknown prefix {prefix!r}")
        return Iri(self.prefixes[prefix] + local)

    def term(self) -> Term:
        kind, value = self.take()
        if value == "[":
            node = self.blank()
            if not self.next_is("]"):
                self.properties(node)
            self.take("]")
            return node
        if value == "(":
            items = []
            while not self.next_is(")"):
                items.append(self.term())
            self.take(")")
            node: Term = Iri(RDF + "nil")
            for item in reversed(items):
                cell = self.blank()
                self.triples += [(cell, RDF + "first", item), (cell, RDF + "rest", node)]
                node = cell
            return node
        if kind in ("text", "long"):
            text = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.next_is("^^"):
                self.take()
                return Literal(text, self.resolve(*self.take()).value)
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "lang":
                return Literal(text, lang=self.take()[1][1:])
            return Literal(text)
        if kind == "number":
            return Literal(value, "http://www.w3.org/2001/XMLSchema#" + ("decimal" if "." in value else "integer"))
        if value in ("true", "false"):
            return Literal(value, "http://www.w3.org/2001/XMLSchema#boolean")
        if kind in ("iri", "name") and value != "a":
            return self.resolve(kind, value)
        raise TurtleError(f"unexpected {value!r}")

    def properties(self, subject: Term) -> None:
        while True:
            kind, value = self.take()
            predicate = RDF + "type" if value == "a" else self.resolve(kind, value).value
            while True:
                self.triples.append((subject, predicate, self.term()))
                if not self.next_is(","):
                    break
                self.take()
            while self.next_is(";"):
                self.take()
                if self.next_is(".") or self.next_is("]"):
                    return
                if not self.next_is(";"):
                    break
            else:
                return

    def read(self) -> list[tuple[Term, str, Term]]:
        while self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if kind == "directive":
                self.take()
                if value == "@prefix":
                    name = self.take()[1]
                    self.prefixes[name.rstrip(":")] = self.resolve(*self.take()).value
                else:
                    self.base = self.take()[1][1:-1]
                self.take(".")
                continue
            subject = self.term()
            if not isinstance(subject, Blank) or not self.next_is("."):
                self.properties(subject)
            self.take(".")
        return self.triples


def parse(text: str) -> list[tuple[Term, str, Term]]:
    """All triples of a Turtle text, in order; lists become first/rest cells."""
    return _Reader(text).read()
