"""The query language: lexer, parser and syntax tree.

    query    := selector (combinator selector)*
    selector := (atom | '(' query ['@' name] ')') ('.' field '(' [query] ')')*
    atom     := ['*' | '&'] [type] ['#' (word | "text" | /regex/)]

Combinators: a space (descendant), ``>`` (child), ``+`` (next sibling) and ``~`` (later
sibling); spaces may surround the latter three. Every part of an atom may be absent; the
empty atom stands for any named node.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """A query that can't be read."""


@dataclass(frozen=True)
class Name:
    """A filter on names: the exact text, or a regular expression that is searched for."""

    text: str
    regex: bool = False


@dataclass(frozen=True)
class Atom:
    sigil: str | None = None
    type: str | None = None
    name: Name | None = None


@dataclass(frozen=True)
class Group:
    query: Query
    capture: str | None


@dataclass(frozen=True)
class Access:
    field: str
    inner: Query | None


@dataclass(frozen=True)
class Selector:
    node: Atom | Group
    fields: tuple[Access, ...] = ()


@dataclass(frozen=True)
class Query:
    head: Selector
    tail: tuple[tuple[str, Selector], ...] = ()


_TOKEN = re.compile(r'(?P<space>[ \t]+)|(?P<text>"[^"]*"?)|(?P<regex>/[^/]*/?)|(?P<mark>[*&>+~.()@#])|(?P<word>\w+)|(?P<other>.)', re.DOTALL)


def tokens(source: str) -> list[tuple[str, str]]:
    """(kind, text); an unclosed quote or regular expression ends with the query."""
    out = []
    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m.group()
        if kind == "text":
            text = text[1:-1] if len(text) > 1 and text.endswith('"') else text[1:]
        elif kind == "regex":
            text = text[1:-1] if len(text) > 1 and text.endswith("/") else text[1:]
        elif kind == "other":
            kind = "word"
        elif kind == "mark":
            kind = text
        out.append((kind, text))
    return [*out, ("end", "")]


class _Reader:
    def __init__(self, source: str):
        self.toks, self.i = tokens(source), 0

    @property
    def kind(self) -> str:
        return self.toks[self.i][0]

    def take(self) -> str:
        text = self.toks[self.i][1]
        self.i += self.kind != "end"
        return text

    def spaces(self) -> None:
        while self.kind == "space":
            self.take()

    def expect(self, kind: str, what: str) -> str:
        if self.kind != kind:
            raise QueryError(f"expected {what} at token {self.i}")
        return self.take()

    def query(self) -> Query:
        self.spaces()
        head, tail = self.selector(), []
        while True:
            save = self.i
            self.spaces()
            spaced = self.i > save
            if self.kind in (">", "+", "~"):
                combinator = self.take()
                self.spaces()
            elif spaced and self.kind in ("*", "&", "word", "(", "#"):
                combinator = " "
            else:
                self.i = save
                return Query(head, tuple(tail))
            tail.append((combinator, self.selector()))

    def selector(self) -> Selector:
        if self.kind == "(":
            self.take()
            query = self.query()
            self.spaces()
            capture = None
            if self.kind == "@":
                self.take()
                capture = self.expect("word", "a capture's name after @")
            self.spaces()
            self.expect(")", ")")
            node: Atom | Group = Group(query, capture)
        else:
            node = self.atom()
        fields = []
        while self.kind == ".":
            self.take()
            name = self.expect("word", "a field's name after .")
            self.expect("(", "( after a field's name")
            self.spaces()
            inner = None if self.kind == ")" else self.query()
            self.spaces()
            self.expect(")", ") after a field")
            fields.append(Access(name, inner))
        return Selector(node, tuple(fields))

    def atom(self) -> Atom:
        sigil = self.take() if self.kind in ("*", "&") else None
        type_ = self.take() if self.kind == "word" else None
        name = None
        if self.kind == "#":
            self.take()
            if self.kind not in ("word", "text", "regex"):
                raise QueryError(f"expected a name after # at token {self.i}")
            regex = self.kind == "regex"
            name = Name(self.take(), regex)
        return Atom(sigil, type_, name)


def parse(source: str) -> Query:
    """The query's tree; QueryError where it can't be read."""
    reader = _Reader(source)
    query = reader.query()
    reader.spaces()
    if reader.kind != "end":
        raise QueryError(f"unexpected input at token {reader.i}: {reader.toks[reader.i][1]!r}")
    return query
