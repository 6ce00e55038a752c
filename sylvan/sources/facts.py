"""What a file says about definitions, names and calls, as rows.

One pass over a syntax tree gives the rows of all relations:

    outline   item number, parent item, depth, kind, name, line
    def       line, name, qualified path, kind (function | method | signature), receiver
              (type, trait or interface), via_trait, ret (first result type)
    impl      a type (name) and a trait (receiver) that it implements
    import    local name, path; glob: path
    fn        line of a function's scope, receiver (type around it), via_trait
    param     var and type; bound: type parameter and trait
    binding   var, bkind (value | typed | call), type, and the callee it names
    call      a callee: ckind (bare | path | method), name, segs, rkind (self | var | opaque), recv

Rows of a relation are numbered (``ord``) in document order. Definitions of C, C++,
JavaScript and Python are the functions of the outline; their calls are found by name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

from sylvan.functions.languages import FUNCTIONS
from sylvan.sources.cst.tree import Lines, Node

COLUMNS = (
    ("rel", "string"), ("ord", "int"), ("fn_line", "int"), ("line", "int"), ("depth", "int"), ("parent", "int"), ("kind", "string"), ("name", "string"), ("segs", "array<string>"),
    ("receiver", "string"), ("via_trait", "string"), ("ret", "string"), ("var", "string"), ("type", "string"), ("bkind", "string"), ("ckind", "string"), ("rkind", "string"), ("recv", "string"),
)


@dataclass(frozen=True)
class Shape:
    """How a node is an item of an outline: the item's kind; paths to its name, of which the first in the text counts;
    where it is one (``top``, ``inside`` or anywhere); which nodes of its body it holds (a kind, or all; None: it holds
    none and needs a name); a path to a node whose kind makes it another item (path, kinds, item's kind); and the path to
    the node that the other paths start from."""

    kind: str
    paths: tuple[str, ...] = ("name",)
    where: str = ""
    holds: str | None = None
    unless: tuple[str, frozenset[str], str] | None = None
    of: str = ""


def reach(node: Node | None, path: str) -> Node | None:
    """The node at the end of a path: ``field``, ``field:kind`` or ``field:`` for the innermost of nested ones,
    ``>kind`` for the first child of a kind that has what follows (``>kind?field``: that has the field), ``0:kind`` for the
    first child if of a kind."""
    step, _, rest = path.partition("/")
    if node is None or not step:
        return node
    if step[0] == ">":
        kind, _, field = step[1:].partition("?")
        found = (reach(k, rest) for k in node.of(kind) if not field or k.get(field) is not None)
        return next((x for x in found if x is not None), None)
    name, colon, kind = step.partition(":")
    if name == "0":
        at = node.kids[0] if node.kids and node.kids[0].kind == kind else None
    else:
        at = node.get(name)
        if colon and not kind:
            while at is not None and at.kind not in ("identifier", "field_identifier"):
                at = at.get(name) or at.get("name")
        elif kind and at is not None and at.kind != kind:
            at = None
    return reach(at, rest)


_C = {"function_definition": (Shape("fn", ("declarator:",)),), "declaration": (Shape("var", (">identifier", ">init_declarator/declarator"), "top"),)}
_VARIABLE = Shape("var", ("name",), "top", None, ("value", frozenset(("arrow_function", "function")), "fn"), ">variable_declarator?name")
_RUST_VARIABLE = Shape("var", where="top")
#: Language, kind of node, its items.
OUTLINES: dict[str, dict[str, tuple[Shape, ...]]] = {
    "c": _C,
    "cpp": _C | {f"{k}_{end}": (Shape(k, holds=""),) for k, end in (("namespace", "definition"), ("class", "specifier"), ("struct", "specifier"))}
    | {"field_declaration": (Shape("fn", ("declarator:function_declarator/declarator",), "inside"),)},
    "python": {"function_definition": (Shape("fn"),), "class_definition": (Shape("class", holds=""),), "expression_statement": (Shape("var", ("0:assignment/left:identifier",), "top"),)},
    "javascript": {
        "function_declaration": (Shape("fn"),), "method_definition": (Shape("fn", where="inside"),), "class_declaration": (Shape("class", holds="method_definition"),),
        "lexical_declaration": (_VARIABLE,), "variable_declaration": (_VARIABLE,),
    },
    "rust": {"function_item": (Shape("fn"),), "impl_item": (Shape("impl", ("type",), holds=""),), "const_item": (_RUST_VARIABLE,), "static_item": (_RUST_VARIABLE,)}
    | {f"{k}_item": (Shape(k, holds=""),) for k in ("mod", "struct", "enum", "trait")},
    "go": {"function_declaration": (Shape("fn"),), "method_declaration": (Shape("fn"),), "type_declaration": (Shape("type", (">type_spec/name",), "top"),)},
}


class Facts:
    """Collects the rows of a file."""

    def __init__(self, root: Node, source: str, path: str, lang: str):
        self.root, self.source, self.path, self.lang = root, source, path, lang
        self.line_of = Lines(source)
        self.rows: list[dict] = []
        self.numbers: dict[str, int] = {}

    def add(self, rel: str, **values) -> int:
        n = self.numbers.get(rel, 0)
        self.numbers[rel] = n + 1
        self.rows.append({"rel": rel, "ord": n, **values})
        return n

    def text(self, node: Node | None) -> str | None:
        return None if node is None else node.text(self.source)

    def line(self, node: Node) -> int:
        return self.line_of(node.start)

    # ---- outline

    def outline(self, nodes: list[Node], parent: int = -1, depth: int = 0) -> None:
        for node in nodes:
            for kind, name, below in self.items(node, depth == 0):
                n = self.add("outline", parent=parent, depth=depth, kind=kind, name=name, line=self.line(node))
                self.outline(below, n, depth + 1)

    def items(self, node: Node, top: bool) -> Iterator[tuple[str, str, list[Node]]]:
        """What a node adds to the outline: kind, name, and the nodes whose items it holds."""
        for shape in OUTLINES[self.lang].get(node.kind, ()):
            if shape.where not in ("", "top" if top else "inside"):
                continue
            start = reach(node, shape.of)
            ends = sorted(filter(None, (reach(start, path) for path in shape.paths)), key=lambda n: n.start)
            name = (self.text(ends[0]) or "").partition("\n")[0] if ends else ""
            if not name and shape.holds is None:
                continue
            kind = shape.kind
            if shape.unless:
                path, kinds, other = shape.unless
                value = reach(start, path)
                kind = other if value is not None and value.kind in kinds else kind
            body = node.get("body")
            below = [] if shape.holds is None or body is None else [k for k in body.kids if shape.holds in ("", k.kind)]
            yield kind, name or "(anonymous)", below

    def body(self, node: Node) -> list[Node]:
        b = node.get("body")
        return b.kids if b is not None else []

    # ---- relations

    def collect(self) -> list[dict]:
        self.outline(self.root.kids)
        self.definitions()
        return self.rows

    def definitions(self) -> None:
        """Functions of the outline, and the calls in bodies of functions of that name."""
        functions = [r for r in self.rows if r["rel"] == "outline" and r["kind"] == "fn"]
        for r in functions:
            self.add("def", line=r["line"], name=r["name"], segs=[r["name"]], kind="function")
        if not functions:
            return
        wanted = {r["name"] for r in functions}
        bodies: dict[str | None, list[Node]] = {}  # functions by name; None: those whose name can't be reached
        calls: list[Node] = []
        define, call = FUNCTIONS[self.lang]
        call_kinds, def_kinds = {v.kind for v in call}, {v.kind for v in define}
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.kind in call_kinds:
                calls.append(node)
            if node.kind in def_kinds:
                for v in define:
                    if v.kind != node.kind:
                        continue
                    for name in [None] if v.name is None else self.names(node, v.name):
                        if name is None or name in wanted:
                            bodies.setdefault(name, []).append(node)
            stack += reversed(node.kids)
        calls.sort(key=lambda c: (c.start, -c.end))
        starts = [c.start for c in calls]
        for r in functions:
            seen = set()
            outer = sorted({id(n): n for n in bodies.get(r["name"], []) + bodies.get(None, [])}.values(), key=lambda n: (n.start, -n.end))
            for f in outer:
                scope = f.get("body") or f
                for c in calls[bisect_left(starts, scope.start) : bisect_left(starts, scope.end)]:
                    if c.end > scope.end:
                        continue
                    key = (self.line(f), self.first_line(f), self.line(c), self.first_line(c))
                    name = self.callee_text(key[3])
                    if key not in seen and name:
                        self.add("call", fn_line=r["line"], line=key[2], name=name, ckind="name", kind=r["name"])
                    seen.add(key)

    def names(self, node: Node, steps: tuple) -> Iterator[str]:
        at = [node]
        for field, kind in steps:
            at = [k for n in at for k in n.all(field) if k.kind == kind]
        return (n.text(self.source) for n in at)

    def first_line(self, node: Node) -> str:
        end = self.source.find("\n", node.start, node.end)
        return self.source[node.start : node.end if end < 0 else end].removesuffix("\r")

    @staticmethod
    def callee_text(text: str) -> str:
        """The callee's name as a match's text shows it: up to the first bracket, after the last dot."""
        return text.partition(", ")[0].partition("(")[0].strip().rpartition(".")[2].strip()


class Scopes(Facts):
    """Files whose functions have scopes: what Rust and Go share."""

    def callee(self, node: Node | None) -> dict | None:
        raise NotImplementedError

    def call(self, node: Node) -> dict | None:
        return self.callee(node.get("function"))

    def bind(self, fn: int, node: Node, var: str, kind: str, **more) -> None:
        self.add("binding", fn_line=fn, line=self.line(node), var=var, bkind=kind, **more)

    def scope(self, node: Node, fn: int | None) -> None:
        """Calls and bindings below a node belong to the innermost function around them."""
        stack = [(node, fn)]
        while stack:
            n, f = stack.pop()
            inner = self.visit(n, f)
            if inner is not None:
                stack += [(k, g) for k, g in reversed(inner)]

    def visit(self, node: Node, fn: int | None) -> list[tuple[Node, int | None]]:
        raise NotImplementedError

    def opaque(self, node: Node) -> str:
        return self.text(node).split("\n")[0]


class GoFacts(Scopes):
    def definitions(self) -> None:
        package = [s for s in self.path.split("/")[:-1] if s not in ("", ".", "..")]
        for node in self.root.kids:
            line, name = self.line(node), node.get("name")
            if node.kind == "function_declaration" and name is not None:
                self.define(line, name, package, "function", node)
            elif node.kind == "method_declaration" and name is not None:
                receiver = self.receiver(node)
                if receiver is not None:
                    self.define(line, name, [*package, receiver], "method", node, receiver)
            elif node.kind == "type_declaration":
                for spec in node.of("type_spec"):
                    body, owner = spec.get("type"), self.text(spec.get("name"))
                    if body is not None and owner and body.kind == "interface_type":
                        for m in body.of("method_elem"):
                            self.define(self.line(m), m.get("name"), [*package, owner], "signature", m, owner)
        self.scope(self.root, None)

    def define(self, line: int, name: Node, owner: list[str], kind: str, node: Node, receiver: str | None = None) -> None:
        self.add("def", line=line, name=self.text(name), segs=[*owner, self.text(name)], kind=kind, receiver=receiver, ret=self.result(node))

    def receiver(self, node: Node) -> str | None:
        params = node.get("receiver")
        first = next(iter(params.of("parameter_declaration")), None) if params is not None else None
        return self.type_name(first.get("type")) if first is not None else None

    def result(self, node: Node) -> str | None:
        out = node.get("result")
        if out is not None and out.kind == "parameter_list":
            first = next(iter(out.of("parameter_declaration")), None)
            out = first.get("type") if first is not None else None
        return self.type_name(out)

    def type_name(self, node: Node | None) -> str | None:
        while node is not None:
            if node.kind == "type_identifier":
                return self.text(node)
            if node.kind == "qualified_type":
                return self.text(node.get("name"))
            node = node.get("type") if node.kind == "generic_type" else node.kids[0] if node.kind == "pointer_type" and node.kids else None
        return None

    def visit(self, node: Node, fn: int | None) -> list[tuple[Node, int | None]]:
        kind = node.kind
        if kind == "import_declaration":
            self.imports(node)
            return []
        if kind in ("function_declaration", "method_declaration"):
            line = self.line(node)
            self.add("fn", line=line)
            for params in (node.get("receiver"), node.get("parameters")):
                for p in params.of("parameter_declaration") if params is not None else ():
                    type_ = self.type_name(p.get("type"))
                    for name in p.all("name") if type_ else ():
                        self.add("param", fn_line=line, var=self.text(name), type=type_)
            body = node.get("body")
            return [(k, line) for k in body.kids] if body is not None else []
        if fn is not None:
            if kind == "short_var_declaration":
                left, right = node.get("left"), node.get("right")
                if left is not None and right is not None and len(right.kids) == 1 and left.kids and left.kids[0].kind == "identifier":
                    if len(left.kids) == 1 or right.kids[0].kind == "call_expression":
                        self.bind_value(fn, node, self.text(left.kids[0]), right.kids[0])
            elif kind == "var_spec":
                names = [self.text(n) for n in node.all("name") if n.kind == "identifier"]
                type_, value = self.type_name(node.get("type")), node.get("value")
                if type_:
                    for v in names:
                        self.bind(fn, node, v, "typed", type=type_)
                elif len(names) == 1 and value is not None and len(value.kids) == 1:
                    self.bind_value(fn, node, names[0], value.kids[0])
            elif kind == "call_expression":
                c = self.call(node)
                if c is not None:
                    self.add("call", fn_line=fn, line=self.line(node), **c)
        return [(k, fn) for k in node.kids]

    def bind_value(self, fn: int, node: Node, var: str, value: Node) -> None:
        while value is not None and value.kind == "unary_expression":
            value = value.get("operand")
        if value is None:
            return
        if value.kind in ("identifier", "selector_expression"):
            c = self.callee(value)
            if c is not None:
                self.bind(fn, node, var, "value", **c)
        elif value.kind == "composite_literal" and (type_ := self.type_name(value.get("type"))):
            self.bind(fn, node, var, "typed", type=type_)
        elif value.kind == "call_expression" and (c := self.call(value)) is not None:
            self.bind(fn, node, var, "call", **c)

    def callee(self, node: Node | None) -> dict | None:
        while node is not None and node.kind in ("index_expression", "generic_function", "parenthesized_expression"):
            node = node.kids[0] if node.kids else None
        if node is None:
            return None
        if node.kind == "identifier":
            return {"ckind": "bare", "name": self.text(node)}
        if node.kind == "selector_expression":
            on, name = node.get("operand"), node.get("field")
            if on is None or name is None:
                return None
            plain = on.kind == "identifier"
            return {"ckind": "method", "name": self.text(name), "rkind": "var" if plain else "opaque", "recv": self.text(on) if plain else self.opaque(on)}
        return None

    def imports(self, node: Node) -> None:
        # of specs in one list that share a local name the first counts: it comes last
        specs = [s for k in node.kids for s in (reversed(k.kids) if k.kind == "import_spec_list" else [k]) if s.kind == "import_spec"]
        for s in specs:
            path = [x for x in (self.text(s.get("path")) or "").strip('"').split("/") if x]
            name = s.get("name")
            if not path or name is not None and name.kind == "blank_identifier":
                continue
            if name is not None and name.kind == "dot":
                self.add("glob", segs=path)
            else:
                self.add("import", name=self.text(name) if name is not None else path[-1], segs=path)


class RustFacts(Scopes):
    DROPPED = ("crate", "self", "super", "")
    SMART = ("Box", "Rc", "Arc")

    def definitions(self) -> None:
        parts = self.path.split("/")
        dirs, stem = [s for s in parts[:-1] if s not in ("", ".", "..")], parts[-1].rpartition(".")[0] or parts[-1]
        mods = dirs[len(dirs) - dirs[::-1].index("src") :] if "src" in dirs else []
        if stem not in ("lib", "main", "mod"):
            mods = [*mods, stem]
        self.define(self.root.kids, mods, None, None, False)
        stack = [self.root]
        while stack:
            n = stack.pop()
            if n.kind == "impl_item":
                type_, trait = self.type_name(n.get("type")), self.type_name(n.get("trait"))
                if type_ and trait:
                    self.add("impl", name=type_, receiver=trait)
            stack += reversed(n.kids)
        self.owners: dict[int, tuple[str | None, str | None]] = {}
        self.scope(self.root, None)

    def define(self, nodes: list[Node], mods: list[str], owner: str | None, trait: str | None, in_trait: bool) -> None:
        """Definitions among nodes; ``owner``: the type, or trait, whose body they are."""
        for node in nodes:
            name, body = self.text(node.get("name")), self.body(node)
            if node.kind == "function_item" and name:
                kind = "function" if owner is None else "method"
                ret = self.type_name(node.get("return_type"))
                self.add("def", line=self.line(node), name=name, segs=[*mods, *([owner] if owner else []), name], kind=kind, receiver=owner, via_trait=trait, ret=owner if ret == "Self" and owner else ret)
                self.define(body, mods, None, None, False)
            elif node.kind == "function_signature_item" and in_trait and name:
                self.add("def", line=self.line(node), name=name, segs=[*mods, owner, name], kind="signature", receiver=owner, ret=self.type_name(node.get("return_type")))
            elif node.kind == "mod_item" and name:
                self.define(body, [*mods, name], None, None, False)
            elif node.kind == "impl_item" and (type_ := self.type_name(node.get("type"))):
                self.define(body, mods, type_, self.type_name(node.get("trait")), False)
            elif node.kind == "trait_item" and name:
                self.define(body, mods, name, None, True)

    def type_name(self, node: Node | None) -> str | None:
        """The base name: references, generics and paths are stripped, smart pointers seen through, and
        ``dyn`` and ``impl`` types are their trait."""
        if node is None:
            return None
        if node.kind == "type_identifier":
            return self.text(node)
        if node.kind == "scoped_type_identifier":
            return self.text(node.get("name"))
        if node.kind == "reference_type":
            return self.type_name(node.get("type"))
        if node.kind in ("dynamic_type", "abstract_type"):
            return self.type_name(node.get("trait"))
        if node.kind == "generic_type":
            base, args = self.type_name(node.get("type")), node.get("type_arguments")
            inner = self.type_name(args.kids[0]) if base in self.SMART and args is not None and args.kids else None
            return inner or base
        return None

    def path_of(self, node: Node | None) -> list[str]:
        """Segments of a path, without crate, self and super."""
        if node is None:
            return []
        if node.kind in ("scoped_identifier", "scoped_type_identifier"):
            return self.path_of(node.get("path")) + self.path_of(node.get("name"))
        if node.kind == "generic_type":
            return self.path_of(node.get("type"))
        text = self.text(node) if node.kind in ("identifier", "type_identifier", "crate", "self", "super") else ""
        return [] if text in self.DROPPED else [text]

    def use(self, node: Node | None, prefix: list[str]) -> None:
        if node is None:
            return
        kind = node.kind
        if kind in ("use_list", "scoped_use_list"):
            inner = prefix + self.path_of(node.get("path"))
            for k in (node if kind == "use_list" else node.get("list") or node).kids:
                self.use(k, inner)
        elif kind == "use_as_clause":
            if node.get("alias") is not None:
                self.add("import", name=self.text(node.get("alias")), segs=prefix + self.path_of(node.get("path")))
        elif kind == "use_wildcard":
            self.add("glob", segs=prefix + (self.path_of(node.kids[0]) if node.kids else []))
        else:
            path = prefix + self.path_of(node)
            if path:
                self.add("import", name=path[-1], segs=path)

    def visit(self, node: Node, fn: int | None) -> list[tuple[Node, int | None]]:
        kind = node.kind
        if kind == "use_declaration":
            self.use(node.get("argument"), [])
            return []
        if kind in ("impl_item", "trait_item"):
            owner = (self.type_name(node.get("type")), self.type_name(node.get("trait"))) if kind == "impl_item" else (self.text(node.get("name")), None)
            below = self.body(node)
            self.own(below, owner)
            return [(k, fn) for k in below]
        if kind == "function_item":
            line = self.line(node)
            type_, trait = self.owners.get(id(node), (None, None))
            self.add("fn", line=line, receiver=type_, via_trait=trait)
            self.heads(node, line)
            return [(k, line) for k in self.body(node)]
        if fn is not None:
            if kind == "let_declaration":
                self.let(fn, node)
            elif kind == "call_expression":
                c = self.call(node)
                if c is not None:
                    self.add("call", fn_line=fn, line=self.line(node), **c)
        return [(k, fn) for k in node.kids]

    def own(self, nodes: list[Node], owner: tuple[str | None, str | None]) -> None:
        """Every function below belongs to the innermost impl or trait around it."""
        stack = list(nodes)
        while stack:
            n = stack.pop()
            if n.kind == "function_item":
                self.owners[id(n)] = owner
            if n.kind not in ("impl_item", "trait_item"):
                stack += n.kids

    def heads(self, node: Node, line: int) -> None:
        params = node.get("parameters")
        for p in params.of("parameter") if params is not None else ():
            pattern, type_ = p.get("pattern"), self.type_name(p.get("type"))
            if pattern is not None and pattern.kind == "identifier" and type_:
                self.add("param", fn_line=line, var=self.text(pattern), type=type_)
        generic = node.get("type_parameters")
        pairs = [(p.get("name"), p.get("bounds")) for p in (generic.of("type_parameter") if generic is not None else [])]
        pairs += [(p.get("left"), p.get("bounds")) for w in node.of("where_clause") for p in w.of("where_predicate")]
        for name, bounds in pairs:
            for b in bounds.kids if name is not None and bounds is not None else ():
                trait = self.type_name(b)
                if trait:
                    self.add("bound", fn_line=line, var=self.text(name), type=trait)

    def let(self, fn: int, node: Node) -> None:
        pattern, value = node.get("pattern"), node.get("value")
        if pattern is None or pattern.kind != "identifier":
            return
        var, type_ = self.text(pattern), self.type_name(node.get("type"))
        if type_:
            self.bind(fn, node, var, "typed", type=type_)
        elif value is None:
            return
        elif value.kind in ("identifier", "scoped_identifier"):
            c = self.callee(value)
            if c is not None:
                self.bind(fn, node, var, "value", **c)
        elif value.kind == "call_expression":
            c = self.call(value)
            if c is not None:
                self.bind(fn, node, var, "call", **c)
        elif value.kind == "struct_expression":
            path = self.path_of(value.get("name"))
            if path:
                self.bind(fn, node, var, "typed", type=path[-1])

    def callee(self, node: Node | None) -> dict | None:
        while node is not None and node.kind == "generic_function":
            node = node.get("function")
        if node is None:
            return None
        if node.kind == "identifier":
            return {"ckind": "bare", "name": self.text(node)}
        if node.kind == "scoped_identifier":
            segs = self.path_of(node)
            if not segs:
                return None
            return {"ckind": "bare", "name": segs[0]} if len(segs) == 1 else {"ckind": "path", "name": segs[-1], "segs": segs}
        if node.kind == "field_expression":
            on, name = node.get("value"), node.get("field")
            if on is None or name is None:
                return None
            rkind = {"self": "self", "identifier": "var"}.get(on.kind, "opaque")
            return {"ckind": "method", "name": self.text(name), "rkind": rkind, "recv": self.text(on) if rkind == "var" else self.opaque(on)}
        return None


def facts(root: Node, source: str, path: str, lang: str) -> list[dict]:
    return {"go": GoFacts, "rust": RustFacts}.get(lang, Facts)(root, source, path, lang).collect()
