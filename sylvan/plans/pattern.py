"""From a query's tree to patterns over syntax nodes, for one language.

A pattern is a node with conditions and related patterns; the search operator turns it
into joins. What the language lacks drops out here: a type without variants gives no
pattern, and an inner query without patterns leaves its selector as it was.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from sylvan.functions.languages import Variant, variants
from sylvan.plans.query import Access, Atom, Group, Name, Query, Selector


@dataclass(frozen=True)
class Pattern:
    """A node of this kind (None: any) whose text meets ``text``, with ``links`` to others.

    ``capture``: the name under which a match reports the node."""

    kind: str | None
    text: Name | None = None
    links: tuple[Link, ...] = ()
    capture: str | None = None
    variant: Variant | None = None

    def captures(self) -> bool:
        return self.capture is not None or any(any(p.captures() for p in x.targets) for x in self.links)


@dataclass(frozen=True)
class Link:
    """How a node is related to one that matches any of ``targets``: ``child`` (with ``field``, or any),
    ``inside`` (anywhere below), ``next`` (sibling) or ``later`` (sibling)."""

    how: str
    targets: tuple[Pattern, ...]
    field: str | None = None


@dataclass(frozen=True)
class Scoped:
    """Matches of ``inner`` anywhere in field ``field`` of matches of ``outer`` (in all of it, if it has no such field)."""

    outer: tuple[Pattern, ...]
    field: str
    inner: tuple[Pattern, ...]


@dataclass(frozen=True)
class Planner:
    """``compat`` keeps older meanings: descendants exactly two levels down, sibling combinators as
    unions, an empty field access as a mere condition, and other fields of a scoped query dropped."""

    lang: str
    compat: bool = False

    def plan(self, query: Query) -> Scoped | tuple[Pattern, ...]:
        """Patterns whose matches are the query's; () if there can be none."""
        if not query.tail:
            found = next(((i, f) for i, f in enumerate(query.head.fields) if f.inner is not None and f.field != "params"), None)
            if found is not None:
                i, access = found
                fields = query.head.fields[:i] + query.head.fields[i + 1 :]
                if self.compat:
                    fields = tuple(f for f in fields if f.inner is None)
                outer = self.selector(replace(query.head, fields=fields))
                inner = self.query(access.inner)
                if outer and inner:
                    return Scoped(distinct(outer), access.field, distinct(inner))
        return distinct(self.query(query))

    def query(self, query: Query) -> list[Pattern]:
        out = self.selector(query.head)
        for combinator, selector in query.tail:
            tail = tuple(distinct(self.selector(selector)))
            if combinator in "+~" and self.compat:
                out += tail
                continue
            if not tail:
                continue  # what the language lacks is no condition
            if combinator == " " and self.compat:
                link = Link("child", (Pattern(None, links=(Link("child", tail),)),))
            else:
                link = Link({">": "child", " ": "inside", "+": "next", "~": "later"}[combinator], tail)
            out = [replace(p, links=(*p.links, link)) for p in out]
        return out

    def selector(self, selector: Selector) -> list[Pattern]:
        if isinstance(selector.node, Group):
            out = [replace(p, capture=selector.node.capture) for p in self.query(selector.node.query)]
        else:
            out = self.atom(selector.node)
        for access in selector.fields:
            out = self.access(out, access)
        return out

    def atom(self, atom: Atom) -> list[Pattern]:
        if atom.type is None:
            return [Pattern(None, atom.name)]
        found = variants(self.lang, atom.type, atom.sigil)
        if found is None:
            return [Pattern(atom.type, atom.name)]
        return [self.variant(v, atom.name) for v in found]

    @staticmethod
    def variant(v: Variant, name: Name | None) -> Pattern:
        if name is None:
            links = (Link("child", (Pattern(v.needs[1]),), v.needs[0]),) if v.needs else ()
            return Pattern(v.kind, links=links, variant=v)
        if v.name is None:  # a node whose name can't be reached matches any
            return Pattern(v.kind, variant=v)
        if not v.name:
            return Pattern(v.kind, name, variant=v)
        inner: Pattern | None = None
        for field, kind in reversed(v.name):
            inner = Pattern(kind, name) if inner is None else Pattern(kind, links=(Link("child", (inner,), below),))
            below = field
        return Pattern(v.kind, links=(Link("child", (inner,), below),), variant=v)

    def access(self, outer: list[Pattern], access: Access) -> list[Pattern]:
        empty = access.inner is None
        inner = (Pattern(None),) if empty else tuple(distinct(self.query(access.inner)))
        if not inner:
            return outer
        out = []
        for p in outer:
            v = p.variant
            if access.field == "params":
                if v is None or v.params is None:
                    continue
                field, container = v.params
                link = Link("child", (Pattern(container, links=(Link("child", inner),)),), field)
                if v.bridge:
                    link = Link("child", (Pattern(None, links=(link,)),))
            elif access.field == "body":
                if v is None or v.body is None:
                    continue
                field, container = v.body
                how = Link("child", (Pattern(None, links=(Link("child", inner),)),)) if self.compat else Link("inside", inner)
                link = Link("child", (Pattern(container, links=(how,)),), field)
            else:
                link = Link("child", inner, access.field)
            if empty and not self.compat:
                out.append(self.field_itself(p, access.field))
                continue
            out.append(replace(p, links=(*p.links, link)))
        return out

    @staticmethod
    def field_itself(p: Pattern, field: str) -> Pattern:
        """The node in a field, where its parent matches ``p``: an empty access returns the field's node."""
        v = p.variant
        if field == "params" and v is not None and v.params is not None:
            target, up = Pattern(v.params[1]), Link("parent", (p,), v.params[0])
            if v.bridge:
                up = Link("parent", (Pattern(None, links=(Link("parent", (replace(p, capture=None),)),)),), v.params[0])
            return replace(target, links=(up,), capture=p.capture)
        name = v.body[0] if field == "body" and v is not None and v.body is not None else field
        return Pattern(None, links=(Link("parent", (replace(p, capture=None),), name),), capture=p.capture)


def distinct(patterns: list[Pattern] | tuple[Pattern, ...]) -> tuple[Pattern, ...]:
    """Each pattern once, in order."""
    return tuple(dict.fromkeys(replace(p, variant=None) for p in patterns))


def describe(plan: Scoped | tuple[Pattern, ...], indent: str = "") -> str:
    """The plan as text."""
    if isinstance(plan, Scoped):
        return f"{indent}outer:\n{describe(plan.outer, indent + '  ')}\n{indent}in field {plan.field}, inner:\n{describe(plan.inner, indent + '  ')}"
    return "\n".join(_one(p, indent) for p in plan) or f"{indent}nothing"


def _one(p: Pattern, indent: str) -> str:
    name = "" if p.text is None else f" ~ /{p.text.text}/" if p.text.regex else f' = "{p.text.text}"'
    head = f"{indent}({p.kind or '_'}){name}" + (f" @{p.capture}" if p.capture else "")
    rest = [f"{indent}  {x.how}{' ' + x.field if x.field else ''}:\n" + "\n".join(_one(t, indent + "    ") for t in x.targets) for x in p.links]
    return "\n".join([head, *rest])
