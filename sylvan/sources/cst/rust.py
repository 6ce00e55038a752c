"""Rust."""

from __future__ import annotations

import re

from sylvan.sources.cst.base import Token
from sylvan.sources.cst.expressions import ASSIGN, POWER, Expressions
from sylvan.sources.cst.tree import Node

_OPS = r"<<=|>>=|\.\.\.|\.\.=|&&|\|\||->|=>|::|\.\.|[-+*/%&|^=!<>]=|<<|>>|[-+*/%&|^~!=<>?:;,.(){}\[\]@#$]"
_TOKENS = rf"""(?P<skip>\s+)|(?P<comment>//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*(?:\*/|\Z))|(?P<raw>(?:b|c|br|cr)?r\#*")|(?P<string>(?:b|c)?"(?:[^"\\]|\\.)*(?:"|\Z))
|(?P<char>b?'(?:[^'\\\n]|\\(?:u\{{[^}}]*\}}|x[0-9a-fA-F]{{2}}|.))')|(?P<lifetime>'[^\W\d]\w*)
|(?P<number>0[xXbBoO][0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?(?:[iuf](?:8|16|32|64|128|size))?)|(?P<word>(?:r\#)?[^\W\d]\w*)|(?P<op>{_OPS})"""
KEYWORDS = frozenset("as break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct super trait type unsafe use where while async await".split())
PRIMITIVE = frozenset("u8 i8 u16 i16 u32 i32 u64 i64 u128 i128 isize usize f32 f64 bool str char".split())
BLOCKS = frozenset(("if", "match", "while", "loop", "for", "unsafe"))


class Rust(Expressions):
    TOKENS = re.compile(_TOKENS.replace("\n|", "|"), re.DOTALL)

    def comment_kind(self, text: str) -> str:
        return "line_comment" if text.startswith("//") else "block_comment"

    UNARY = {"!": "unary_expression", "-": "unary_expression", "*": "unary_expression"}
    POWERS = {k: v for k, v in POWER.items() if k not in ("??", "instanceof", "in", "===", "!==", "<=>", "**", "&^", ">>>")}
    structs = True

    def closing(self, i: int) -> int:
        return self.scan_closing(i)  # numbers of tokens change where >> is split

    def raw_end(self, text: str, start: int, at: int) -> int:
        close = '"' + "#" * text.count("#")
        found = self.source.find(close, at)
        return len(self.source) if found < 0 else found + len(close)

    def outer_closes(self, text: str) -> bool:
        return False

    # ---- items

    def file(self) -> list[Node]:
        kids = []
        while not self.end():
            before = self.i
            x = self.item() or self.statement()
            if x is not None:
                kids.append(x)
            if self.i == before:
                kids.append(self.error())
        return kids

    def attribute(self) -> Node:
        start = self.next().start
        inner = self.eat("!")
        kids = []
        if self.at("["):
            close = self.closing(self.i)
            self.next()
            at = self.t.start
            name = self.path() if self.t.type == "word" else None
            while self.i < close:
                self.next()
            kids = [self.node("attribute", at, [name])]
            self.eat("]")
        return self.node("inner_attribute_item" if inner else "attribute_item", start, kids)

    def item(self) -> Node | None:
        """An item; None (and nothing read) where none begins."""
        start, save = self.t.start, self.i
        if self.at("#") and self.peek().text in ("[", "!"):
            return self.attribute()
        if self.eat(";"):
            return Node("empty_statement", start, self.back())
        vis = None
        if self.at("pub") or self.at("crate") and self.peek().type == "word" and self.peek().text not in ("as",):
            self.next()
            if self.at("(") and self.peek().text in ("crate", "super", "self", "in"):
                self.skip_brackets()
            vis = Node("visibility_modifier", start, self.back())
        mods = None
        at = self.t.start
        while self.at("async", "unsafe", "const", "extern", "default", "safe") and (self.peek().text in ("async", "unsafe", "const", "extern", "fn", "trait", "impl") or self.at("extern") and self.peek().type == "string" and self.peek(2).text == "fn"):
            if self.next().text == "extern" and self.t.type == "string":
                self.next()
            mods = Node("function_modifiers", at, self.back())
        t = self.t
        method = {
            "fn": self.fn, "struct": self.struct, "union": self.struct, "enum": self.enum, "trait": self.trait, "impl": self.impl, "mod": self.mod, "use": self.use, "const": self.const,
            "static": self.const, "type": self.alias, "macro_rules": self.macro_rules, "extern": self.extern,
        }.get(t.text) if t.type == "word" else None
        if method is None or t.text == "union" and self.peek().type != "word" or t.text == "macro_rules" and self.peek().text != "!" or t.text == "type" and self.peek().type != "word":
            self.i = save
            return None
        if t.text == "const" and self.peek().text in ("{", "|", "move"):
            self.i = save
            return None
        node = method(start)
        head = [x for x in (vis, mods if node.kind in ("function_item", "function_signature_item") else None) if x]
        node.kids[:0] = head
        return node

    def generics(self) -> Node | None:
        if not self.at("<"):
            return None
        start = self.next().start
        kids: list[Node] = []
        while not self.end() and not self.at(">", ">>"):
            before, at = self.i, self.t.start
            if self.at("#"):
                self.attribute()
                continue
            if self.t.type == "lifetime":
                x = self.leaf("lifetime", "name")
                b = self.bounds() if self.at(":") else None
                kids.append(self.node("lifetime_parameter", at, [x, b]))
            elif self.at("const"):
                self.next()
                name = self.leaf("identifier", "name") if self.t.type == "word" else None
                kind = self.type_("type") if self.eat(":") else None
                value = self.expression(10, "value") if self.eat("=") else None
                kids.append(self.node("const_parameter", at, [name, kind, value]))
            elif self.t.type == "word":
                name = self.leaf("type_identifier", "name")
                b = self.bounds() if self.at(":") else None
                default = self.type_("default_type") if self.eat("=") else None
                kids.append(self.node("type_parameter", at, [name, b, default]))
            self.eat(",")
            if self.i == before:
                self.next()
        self.close_angle()
        return self.node("type_parameters", start, kids, "type_parameters")

    def close_angle(self) -> None:
        """One > of what may be a longer token."""
        t = self.t
        if t.type == "op" and t.text in (">>", ">=", ">>="):
            rest = Token("op", t.text[1:], t.start + 1, t.end, False)
            self.toks[self.i : self.i + 1] = [Token("op", ">", t.start, t.start + 1, t.after_line), rest]
        self.eat(">")

    def bounds(self) -> Node:
        start = self.next().start
        kids = []
        while not self.end():
            at, before = self.t.start, self.i
            if self.t.type == "lifetime":
                kids.append(self.leaf("lifetime"))
            elif self.at("?", "~"):
                self.next()
                self.eat("const")
                kids.append(self.node("removed_trait_bound", at, [self.type_()]))
            elif self.at("for"):
                kids.append(self.higher_ranked())
            else:
                x = self.type_(plus=False)
                if x is not None:
                    kids.append(x)
            if not self.eat("+") or self.i == before:
                break
        return self.node("trait_bounds", start, kids, "bounds")

    def higher_ranked(self) -> Node:
        start = self.next().start
        params = self.generics()
        return self.node("higher_ranked_trait_bound", start, [params, self.type_("type", plus=False)])

    def where(self) -> Node | None:
        if not self.at("where"):
            return None
        start = self.next().start
        kids = []
        while not self.end() and not self.at("{", ";", "="):
            before, at = self.i, self.t.start
            left = self.leaf("lifetime", "left") if self.t.type == "lifetime" else self.higher_ranked() if self.at("for") else self.type_("left", plus=False)
            b = self.bounds() if self.at(":") else None
            kids.append(self.node("where_predicate", at, [left, b]))
            self.eat(",")
            if self.i == before:
                self.next()
        return self.node("where_clause", start, kids)

    def fn(self, start: int) -> Node:
        self.next()
        name = self.leaf("identifier", "name") if self.t.type == "word" else None
        generics = self.generics()
        params = self.parameters() if self.at("(") else None
        result = self.type_("return_type") if self.eat("->") else None
        where = self.where()
        if self.at("{"):
            body = self.block("body")
            return self.node("function_item", start, [name, generics, params, result, where, body])
        self.eat(";")
        return self.node("function_signature_item", start, [name, generics, params, result, where])

    def parameters(self) -> Node:
        start = self.next().start
        return self.node("parameters", start, self.many(")", self.parameter), "parameters")

    def parameter(self) -> Node | None:
        start = self.t.start
        while self.at("#"):
            self.attribute()
        if self.at("..."):
            return self.leaf("variadic_parameter")
        i = self.i
        while self.toks[i].text in ("&", "mut") or self.toks[i].type == "lifetime":
            i += 1
        if self.toks[i].text == "self" and self.toks[i + 1].text in (",", ")"):
            kids = []
            while self.i < i:
                kids.append(self.leaf("lifetime") if self.t.type == "lifetime" else self.leaf("mutable_specifier") if self.at("mut") else None) if not self.at("&") else self.next()
            kids.append(self.leaf("self"))
            return self.node("self_parameter", start, kids)
        mut = self.leaf("mutable_specifier") if self.at("mut") and self.peek().type == "word" else None
        pattern = self.pattern()
        if not self.eat(":"):
            # a type alone, as in a trait's or a pointer's signature
            if pattern is not None and pattern.kind == "identifier":
                pattern.kind = "type_identifier"
            return pattern
        kind = self.type_("type")
        return self.node("parameter", start, [mut, self.tag(pattern, "pattern"), kind])

    def struct(self, start: int) -> Node:
        word = self.next().text
        name = self.leaf("type_identifier", "name") if self.t.type == "word" else None
        generics, where = self.generics(), self.where()
        body = None
        if self.at("{"):
            body = self.fields()
        elif self.at("("):
            at = self.next().start
            body = self.node("ordered_field_declaration_list", at, self.many(")", self.ordered_field), "body")
            where = where or self.where()
        self.eat(";")
        return self.node(word + "_item", start, [name, generics, where, body])

    def fields(self) -> Node:
        at = self.next().start
        return self.node("field_declaration_list", at, self.many("}", self.field_), "body")

    def visibility(self) -> Node | None:
        if not self.at("pub"):
            return None
        start = self.next().start
        if self.at("(") and self.peek().text in ("crate", "super", "self", "in"):
            self.skip_brackets()
        return Node("visibility_modifier", start, self.back())

    def ordered_field(self) -> Node | list | None:
        if self.at("#"):
            return self.attribute()
        vis = self.visibility()
        x = self.type_("type")
        return [k for k in (vis, x) if k is not None]

    def field_(self) -> Node | None:
        if self.at("#"):
            return self.attribute()
        start = self.t.start
        vis = self.visibility()
        if self.t.type != "word":
            return vis
        name = self.leaf("field_identifier", "name")
        kind = self.type_("type") if self.eat(":") else None
        return self.node("field_declaration", start, [vis, name, kind])

    def enum(self, start: int) -> Node:
        self.next()
        name = self.leaf("type_identifier", "name") if self.t.type == "word" else None
        generics, where = self.generics(), self.where()
        body = None
        if self.at("{"):
            at = self.next().start
            body = self.node("enum_variant_list", at, self.many("}", self.variant), "body")
        return self.node("enum_item", start, [name, generics, where, body])

    def variant(self) -> Node | None:
        if self.at("#"):
            return self.attribute()
        start = self.t.start
        if self.t.type != "word":
            return None
        name = self.leaf("identifier", "name")
        body = None
        if self.at("{"):
            body = self.fields()
        elif self.at("("):
            at = self.next().start
            body = self.node("ordered_field_declaration_list", at, self.many(")", self.ordered_field), "body")
        value = self.expression(0, "value") if self.eat("=") else None
        return self.node("enum_variant", start, [name, body, value])

    def declarations(self) -> Node:
        start = self.next().start
        return self.node("declaration_list", start, self.many("}", lambda: self.item() or self.statement(), ()), "body")

    def trait(self, start: int) -> Node:
        self.next()
        name = self.leaf("type_identifier", "name") if self.t.type == "word" else None
        generics = self.generics()
        bounds = self.bounds() if self.at(":") else None
        where = self.where()
        body = self.declarations() if self.at("{") else None
        return self.node("trait_item", start, [name, generics, bounds, where, body])

    def impl(self, start: int) -> Node:
        self.next()
        generics = self.generics() if self.at("<") else None
        self.eat("const")
        negative = self.eat("!")
        del negative
        first = self.type_(plus=False)
        trait = None
        if self.eat("for"):
            trait, first = self.tag(first, "trait"), self.type_(plus=False)
        where = self.where()
        body = self.declarations() if self.at("{") else None
        return self.node("impl_item", start, [generics, trait, self.tag(first, "type"), where, body])

    def mod(self, start: int) -> Node:
        self.next()
        name = self.leaf("identifier", "name") if self.t.type == "word" else None
        body = self.declarations() if self.at("{") else None
        if body is None:
            self.eat(";")
        return self.node("mod_item", start, [name, body])

    def extern(self, start: int) -> Node:
        self.next()
        if self.at("crate"):
            self.next()
            name = self.leaf("identifier", "name") if self.t.type == "word" else None
            alias = self.leaf("identifier", "alias") if self.eat("as") and self.t.type == "word" else None
            self.eat(";")
            return self.node("extern_crate_declaration", start, [name, alias])
        if self.t.type == "string":
            self.next()
        body = self.declarations() if self.at("{") else None
        return self.node("foreign_mod_item", start, [body])

    def const(self, start: int) -> Node:
        word = self.next().text
        self.eat("mut")
        name = self.leaf("identifier", "name") if self.t.type == "word" else None
        kind = self.type_("type") if self.eat(":") else None
        value = self.expression(0, "value") if self.eat("=") else None
        self.eat(";")
        return self.node(word + "_item", start, [name, kind, value])

    def alias(self, start: int) -> Node:
        self.next()
        name = self.leaf("type_identifier", "name") if self.t.type == "word" else None
        generics = self.generics()
        bounds = self.bounds() if self.at(":") else None
        where = self.where()
        kind = self.type_("type") if self.eat("=") else None
        where = where or self.where()
        self.eat(";")
        return self.node("type_item" if kind is not None else "associated_type", start, [name, generics, bounds, where, kind])

    def macro_rules(self, start: int) -> Node:
        self.next()
        self.eat("!")
        name = self.leaf("identifier", "name") if self.t.type == "word" else None
        if self.at("{", "(", "["):
            self.skip_brackets()
        self.eat(";")
        return self.node("macro_definition", start, [name])

    def use(self, start: int) -> Node:
        self.next()
        arg = self.tag(self.use_tree(), "argument")
        while not self.end() and not self.eat(";"):
            if self.t.after_line and self.t.type == "word" and self.t.text in KEYWORDS:
                break
            self.next()
        return self.node("use_declaration", start, [arg])

    def use_tree(self) -> Node | None:
        start = self.t.start
        path: Node | None = None
        self.eat("::")
        while not self.end():
            if self.at("{"):
                at = self.next().start
                items = self.node("use_list", at, self.many("}", self.use_tree))
                if path is None:
                    return items
                return self.node("scoped_use_list", start, [self.tag(path, "path"), self.tag(items, "list")])
            if self.at("*"):
                self.next()
                if path is not None:
                    path.field = None
                return self.node("use_wildcard", start, [path])
            if self.t.type != "word":
                break
            seg = self.leaf(self.t.text if self.t.text in ("crate", "self", "super") else "identifier")
            path = seg if path is None else self.node("scoped_identifier", start, [self.tag(path, "path"), self.tag(seg, "name")])
            if not self.eat("::"):
                break
        if path is not None and self.eat("as"):
            alias = self.leaf("identifier", "alias") if self.t.type == "word" else None
            return self.node("use_as_clause", start, [self.tag(path, "path"), alias])
        return path

    # ---- types

    def type_(self, field: str | None = None, plus: bool = True) -> Node | None:
        self.depth += 1
        try:
            x = self._type(plus)
        finally:
            self.depth -= 1
        return self.tag(x, field) if field else x

    def _type(self, plus: bool) -> Node | None:
        t, start = self.t, self.t.start
        if self.at("&", "&&"):
            double = self.next().text == "&&"
            life = self.leaf("lifetime") if self.t.type == "lifetime" else None
            mut = self.leaf("mutable_specifier") if self.at("mut") else None
            x = self.node("reference_type", start + double, [life, mut, self.type_("type", plus=False)])
            return self.node("reference_type", start, [self.tag(x, "type")]) if double else x
        if self.at("*"):
            self.next()
            mut = self.leaf("mutable_specifier") if self.at("mut") else None
            self.eat("const")
            return self.node("pointer_type", start, [mut, self.type_("type", plus=False)])
        if self.at("("):
            self.next()
            kids = self.many(")", self.type_)
            return self.node("tuple_type" if kids else "unit_type", start, kids)
        if self.at("["):
            self.next()
            x = self.type_("element")
            size = self.expression(0, "length") if self.eat(";") else None
            while not self.end() and not self.eat("]"):
                self.next()
            return self.node("array_type", start, [x, size])
        if self.at("!"):
            return self.leaf("never_type")
        if self.at("_"):
            return self.leaf("type_identifier")
        if t.type == "word" and t.text in ("dyn", "impl") and (self.peek().type in ("word", "lifetime") or self.peek().text in ("?", "(", "::")):
            self.next()
            kids = [self.type_(plus=False) if self.t.type != "lifetime" else self.leaf("lifetime")]
            end = self.i
            while plus and self.eat("+"):
                self.eat("?")
                kids.append(self.leaf("lifetime") if self.t.type == "lifetime" else self.type_(plus=False))
            kids = [k for k in kids if k is not None]
            trait = kids[0] if kids else None
            if len(kids) > 1:
                trait = Node("bounded_type", kids[0].start, self.back(), kids)
            del end
            return self.node("dynamic_type" if t.text == "dyn" else "abstract_type", start, [self.tag(trait, "trait")])
        if self.at("fn", "unsafe", "extern"):
            while self.at("unsafe", "extern") or self.t.type == "string":
                self.next()
            self.eat("fn")
            params = self.parameters() if self.at("(") else None
            result = self.type_("return_type", plus=False) if self.eat("->") else None
            return self.node("function_type", start, [params, result])
        if self.at("for"):
            return self.higher_ranked()
        if self.at("<"):
            self.next()
            self.type_()
            if self.eat("as"):
                self.type_()
            self.close_angle()
            at = Node("bracketed_type", start, self.back())
            return self.scoped_type(at, start)
        if t.type == "word" and (t.text not in KEYWORDS or t.text in ("crate", "super")) or self.at("::"):
            if self.at("::"):
                self.next()
                if self.t.type != "word":
                    return None
            word = self.t.text
            kind = "primitive_type" if word in PRIMITIVE else word if word in ("crate", "self", "super") else "type_identifier"
            x = self.leaf(kind)
            if self.at("!") and self.peek().text in ("(", "[", "{"):
                self.next()
                self.skip_brackets()
                x.kind, x.field = "identifier", "macro"
                return self.node("macro_invocation", start, [x])
            return self.scoped_type(x, start)
        return None

    def scoped_type(self, x: Node, start: int) -> Node:
        while True:
            if self.at("<") or self.at("::") and self.peek().text == "<":
                self.eat("::")
                args = self.type_arguments()
                x = self.node("generic_type", start, [self.tag(x, "type"), args])
            elif self.at("(") and x.kind in ("type_identifier", "scoped_type_identifier") and x.text(self.source).rpartition(":")[2] in ("Fn", "FnMut", "FnOnce"):
                params = self.parameters()
                result = self.type_("return_type", plus=False) if self.eat("->") else None
                x = self.node("function_type", start, [self.tag(x, "trait"), params, result])
            elif self.at("::") and self.peek().type == "word":
                self.next()
                if x.kind == "type_identifier":
                    x.kind = "identifier"
                x = self.node("scoped_type_identifier", start, [self.tag(x, "path"), self.leaf("type_identifier", "name")])
            else:
                x.field = None
                return x

    def type_arguments(self) -> Node:
        start = self.next().start
        kids: list[Node] = []
        while not self.end() and not self.at(">", ">>", ">=", ">>="):
            before, at = self.i, self.t.start
            if self.t.type == "lifetime":
                kids.append(self.leaf("lifetime"))
            elif self.t.type in ("number", "string", "char") or self.at("-", "{") or self.t.text in ("true", "false"):
                x = self.block() if self.at("{") else self.prefix()
                if x:
                    kids.append(x)
            elif self.t.type == "word" and self.peek().text == "=":
                name = self.leaf("type_identifier", "name")
                self.next()
                kids.append(self.node("type_binding", at, [name, self.type_("type")]))
            else:
                x = self.type_()
                if x is not None:
                    if self.at(":"):
                        x = self.node("constrained_type_parameter", at, [self.tag(x, "left"), self.bounds()])
                    kids.append(x)
            self.eat(",")
            if self.i == before:
                break
        self.close_angle()
        return self.node("type_arguments", start, kids, "type_arguments")

    # ---- patterns

    def pattern(self) -> Node | None:
        start = self.t.start
        self.eat("|")
        x = self.one_pattern()
        while x is not None and self.at("|"):
            self.next()
            x = self.node("or_pattern", start, [x, self.one_pattern()])
        return x

    def one_pattern(self) -> Node | None:
        t, start = self.t, self.t.start
        if self.at("&", "&&"):
            self.next()
            mut = self.leaf("mutable_specifier") if self.at("mut") else None
            return self.node("reference_pattern", start, [mut, self.one_pattern()])
        if self.at("mut"):
            mut = self.leaf("mutable_specifier")
            return self.node("mut_pattern", start, [mut, self.one_pattern()])
        if self.at("ref"):
            self.next()
            return self.node("ref_pattern", start, [self.one_pattern()])
        if self.at("_"):
            return self.leaf("_")
        if self.at("(", "["):
            tuple_ = self.next().text == "("
            return self.node("tuple_pattern" if tuple_ else "slice_pattern", start, self.many(")" if tuple_ else "]", self.pattern))
        if self.at(".."):
            return self.leaf("remaining_field_pattern")
        if t.type in ("number", "string", "char") or self.at("-"):
            x = self.node("negative_literal", start, [self.literal()]) if self.eat("-") else self.literal()
            return self.range_pattern(x, start)
        if t.type == "word" and t.text in ("true", "false"):
            return self.leaf("boolean_literal")
        if t.type == "word" and (t.text not in KEYWORDS or t.text in ("crate", "self", "super")) or self.at("::", "<"):
            x = self.path()
            if x is None:
                return None
            if self.at("!") and self.peek().text in ("(", "[", "{"):
                return self.macro(x, start)
            if self.at("("):
                self.next()
                return self.node("tuple_struct_pattern", start, [self.tag(self.path_type(x), "type") if x.kind != "identifier" else self.tag(x, "type"), *self.many(")", self.pattern)])
            if self.at("{") and x.text(self.source)[:1].isupper() | (x.kind != "identifier"):
                self.next()
                if x.kind == "identifier":
                    x.kind = "type_identifier"
                return self.node("struct_pattern", start, [self.tag(self.path_type(x), "type"), *self.many("}", self.field_pattern)])
            if self.at("@"):
                self.next()
                return self.node("captured_pattern", start, [x, self.pattern()])
            return self.range_pattern(x, start)
        return None

    def range_pattern(self, x: Node, start: int) -> Node:
        if self.at("..=", "..", "..."):
            self.next()
            right = None if self.at("=>", ",", ")", "]", "|", "if", "}") else self.one_pattern()
            return self.node("range_pattern", start, [self.tag(x, "left"), self.tag(right, "right")])
        return x

    def field_pattern(self) -> Node | None:
        start = self.t.start
        if self.at(".."):
            return self.leaf("remaining_field_pattern")
        self.eat("ref")
        mut = self.leaf("mutable_specifier") if self.at("mut") else None
        if self.t.type != "word":
            return None
        if self.peek().text == ":":
            name = self.leaf("field_identifier", "name")
            self.next()
            return self.node("field_pattern", start, [mut, name, self.tag(self.pattern(), "pattern")])
        return self.node("field_pattern", start, [mut, self.leaf("shorthand_field_identifier", "name")])

    def path_type(self, x: Node) -> Node:
        if x.kind == "scoped_identifier":
            x.kind = "scoped_type_identifier"
            for k in x.kids:
                if k.field == "name":
                    k.kind = "type_identifier"
        return x

    # ---- statements

    def block(self, field: str | None = None) -> Node:
        start = self.next().start
        save, self.structs = self.structs, True
        kids = self.many("}", self.statement, ())
        self.structs = save
        return self.node("block", start, kids, field)

    def statement(self) -> Node | None:
        start = self.t.start
        x = self.item()
        if x is not None:
            return x
        if self.at("let"):
            return self.let(start)
        x = self.expression()
        if x is None:
            return None
        if self.eat(";"):
            return self.node("expression_statement", start, [x])
        if self.at("}"):
            # the value of a block; blocks in front of its end are statements
            return self.node("expression_statement", start, [x]) if x.kind in ("if_expression", "match_expression", "while_expression", "loop_expression", "for_expression", "block", "unsafe_block") else x
        return self.node("expression_statement", start, [x])

    def let(self, start: int) -> Node:
        self.next()
        mut = self.leaf("mutable_specifier") if self.at("mut") and self.peek().type == "word" else None
        pattern = self.tag(self.pattern(), "pattern")
        kind = self.type_("type") if self.eat(":") else None
        value = self.expression(0, "value") if self.eat("=") else None
        other = self.block("alternative") if self.at("else") and self.next() and self.at("{") else None
        self.eat(";")
        return self.node("let_declaration", start, [mut, pattern, kind, value, other])

    # ---- expressions

    def expression(self, power: int = 0, field: str | None = None) -> Node | None:
        start = self.t.start
        if self.at("..", "..="):
            self.next()
            right = None if self.range_over() else super().expression(2)
            return self.tag(self.node("range_expression", start, [right]), field) if field else self.node("range_expression", start, [right])
        return super().expression(power, field)

    def range_over(self) -> bool:
        return self.at(")", "]", "}", ";", ",", "=>") or self.at("{") and not self.structs or self.end()

    def tail(self, left: Node, start: int, power: int) -> Node:
        if power > 1:
            return left
        if self.at("..", "..="):
            self.next()
            right = None if self.range_over() else self.expression(2)
            left = self.node("range_expression", start, [left, right])
        if self.t.type == "op" and self.t.text in ASSIGN:
            kind = "assignment_expression" if self.next().text == "=" else "compound_assignment_expr"
            return self.node(kind, start, [self.tag(left, "left"), self.expression(0, "right")])
        return left

    def _expression(self, power: int) -> Node | None:
        start = self.t.start
        if self.block_like():
            # an expression that ends with a block ends a statement
            x = self.prefix()
            if x is not None and x.kind in ("if_expression", "match_expression", "while_expression", "loop_expression", "for_expression", "block", "unsafe_block") and self.statement_start and not self.at(".", "?"):
                return x
            if x is None:
                return None
            return self.more(x, start, power)
        return super()._expression(power)

    def more(self, left: Node, start: int, power: int) -> Node:
        while True:
            op = self.operator()
            p = self.POWERS.get(op)
            if p is None or p <= power:
                break
            self.take_operator(op)
            left = self.node(self.BINARY, start, [self.tag(left, "left"), self.expression(p, "right")])
        return self.tail(left, start, power)

    @property
    def statement_start(self) -> bool:
        return self.depth_at_statement

    depth_at_statement = True

    def block_like(self) -> bool:
        t = self.t
        return t.type == "word" and t.text in BLOCKS or self.at("{")

    def prefix(self) -> Node | None:
        t, start = self.t, self.t.start
        if self.at("&", "&&"):
            double = self.next().text == "&&"
            if self.at("raw") and self.peek().text in ("const", "mut"):
                self.next()
                self.next()
            mut = self.leaf("mutable_specifier") if self.at("mut") else None
            x = self.node("reference_expression", start + double, [mut, self.expression(13, "value")])
            return self.node("reference_expression", start, [self.tag(x, "value")]) if double else x
        if self.at("|", "||") or t.text == "move" and self.peek().text in ("|", "||") or t.text in ("async", "static") and self.peek().text in ("|", "||", "move") and self.peek(2).text != "{":
            return self.closure()
        if t.type == "word":
            if t.text in ("return", "break"):
                self.next()
                label = self.leaf("label") if self.t.type == "lifetime" else None
                x = None if self.range_over() else self.expression()
                return self.node(t.text + "_expression", start, [label, x])
            if t.text == "continue":
                self.next()
                label = self.leaf("label") if self.t.type == "lifetime" else None
                return self.node("continue_expression", start, [label])
            if t.text == "yield":
                self.next()
                return self.node("yield_expression", start, [self.expression()])
        x = super().prefix()
        while x is not None and self.at("as"):
            self.next()
            x = self.node("type_cast_expression", start, [self.tag(x, "value"), self.type_("type", plus=False)])
        return x

    def operand_field(self, kind: str) -> str | None:
        return None

    def closure(self) -> Node:
        start = self.t.start
        while self.at("move", "async", "static"):
            self.next()
        at = self.t.start
        params: list[Node] = []
        if self.next().text == "|":
            while not self.end() and not self.at("|"):
                before, s = self.i, self.t.start
                p = self.one_pattern()
                if p is not None and self.eat(":"):
                    p = self.node("parameter", s, [self.tag(p, "pattern"), self.type_("type")])
                if p is not None:
                    params.append(p)
                self.eat(",")
                if self.i == before:
                    self.next()
            self.eat("|")
        head = self.node("closure_parameters", at, params, "parameters")
        result = self.type_("return_type") if self.eat("->") else None
        body = self.block("body") if self.at("{") else self.expression(0, "body")
        return self.node("closure_expression", start, [head, result, body])

    def literal(self) -> Node:
        t = self.t
        if t.type == "number":
            text = t.text.lower()
            real = not text.startswith(("0x", "0b", "0o")) and ("." in text or "e" in text.replace("usize", "").replace("isize", "") or text.endswith(("f32", "f64")))
            return self.leaf("float_literal" if real else "integer_literal")
        if t.type == "char":
            return self.leaf("char_literal")
        if t.type != "string":
            return self.error()
        self.next()
        raw = re.match(r"[bc]?r", t.text) is not None
        a = t.text.index('"') + 1
        b = t.text.rindex('"') if t.text.count('"') > 1 else len(t.text)
        inner = [Node("string_content", t.start + a, t.start + b)] if b > a else []
        return Node("raw_string_literal" if raw else "string_literal", t.start, t.end, inner)

    def path(self) -> Node | None:
        """A name, with segments and turbofish arguments, as an expression."""
        start = self.t.start
        if self.at("<"):
            self.next()
            self.type_()
            if self.eat("as"):
                self.type_()
            self.close_angle()
            x = Node("bracketed_type", start, self.back())
        else:
            self.eat("::")
            if self.t.type != "word":
                return None
            word = self.t.text
            x = self.leaf(word if word in ("self", "crate", "super") else "identifier")
        while self.at("::"):
            if self.peek().text == "<":
                self.next()
                args = self.type_arguments()
                if self.at("::") and self.peek().type == "word":
                    if x.kind == "identifier":
                        x.kind = "type_identifier"
                    elif x.kind == "scoped_identifier":
                        x = self.path_type(x)
                    x = self.node("generic_type", start, [self.tag(x, "type"), args])
                else:
                    return self.node("generic_function", start, [self.tag(x, "function"), args])
            elif self.peek().type == "word":
                self.next()
                x = self.node("scoped_identifier", start, [self.tag(x, "path"), self.leaf("identifier", "name")])
            else:
                self.next()
                break
        x.field = None
        return x

    def macro(self, x: Node, start: int) -> Node:
        self.next()
        at = self.t.start
        a = self.i
        self.skip_brackets()
        inside = [self.token_node(t) for t in self.toks[a + 1 : self.i - 1]]
        tree = Node("token_tree", at, self.back(), [n for n in inside if n is not None])
        return self.node("macro_invocation", start, [self.tag(x, "macro"), tree])

    def token_node(self, t: Token) -> Node | None:
        if t.type == "word":
            kind = t.text if t.text in ("self", "crate", "super") else "boolean_literal" if t.text in ("true", "false") else "primitive_type" if t.text in PRIMITIVE else "identifier"
            return None if t.text in KEYWORDS and kind == "identifier" else Node(kind, t.start, t.end)
        kind = {"string": "string_literal", "char": "char_literal", "number": "integer_literal"}.get(t.type)
        return Node(kind, t.start, t.end) if kind else None

    def primary(self) -> Node | None:
        t, start = self.t, self.t.start
        if t.type in ("number", "string", "char"):
            return self.literal()
        if t.type == "lifetime" and self.peek().text == ":":
            label = self.leaf("label")
            self.next()
            x = self.primary()
            if x is not None:
                x.kids.insert(0, label)
                x.start = start
            return x
        if self.at("#"):
            self.attribute()
            return self.expression(0)
        if self.at("{"):
            return self.block()
        if self.at("("):
            self.next()
            save, self.structs = self.structs, True
            comma = False
            kids: list[Node] = []
            while not self.end() and not self.at(")"):
                before = self.i
                x = self.expression()
                if x is not None:
                    kids.append(x)
                comma = self.eat(",") or comma
                if self.i == before:
                    kids.append(self.error())
            self.eat(")")
            self.structs = save
            return self.node("unit_expression" if not kids else "tuple_expression" if comma else "parenthesized_expression", start, kids)
        if self.at("["):
            self.next()
            save, self.structs = self.structs, True
            kids = self.many("]", self.expression, (",", ";"))
            self.structs = save
            return self.node("array_expression", start, kids)
        if t.type == "word":
            if t.text == "if":
                return self.if_()
            if t.text == "match":
                return self.match_()
            if t.text in ("while", "loop", "for"):
                return self.loop()
            if t.text in ("unsafe", "async", "const", "try") and (self.peek().text == "{" or t.text == "async" and self.peek().text == "move"):
                self.next()
                self.eat("move")
                return self.node({"const": "const_block"}.get(t.text, t.text + "_block"), start, [self.block()])
            if t.text in ("true", "false"):
                return self.leaf("boolean_literal")
            if t.text in KEYWORDS and t.text not in ("crate", "super") or t.text == "self" and False:
                return None
        if t.type == "word" or self.at("::", "<"):
            x = self.path()
            if x is None:
                return None
            if self.at("!") and self.peek().text in ("(", "[", "{"):
                return self.macro(x, start)
            if self.at("{") and self.struct_here(x):
                if x.kind == "identifier":
                    x.kind = "type_identifier"
                x = self.path_type(x)
                at = self.next().start
                body = self.node("field_initializer_list", at, self.many("}", self.field_init), "body")
                return self.node("struct_expression", start, [self.tag(x, "name"), body])
            return x
        return None

    def struct_here(self, x: Node) -> bool:
        if not self.structs or x.kind not in ("identifier", "scoped_identifier", "generic_function"):
            return False
        name = x.text(self.source).rpartition("::")[2]
        a, b = self.peek(), self.peek(2)
        return name[:1].isupper() or a.type == "word" and b.text in (":", ",") and b.text != "::"

    def field_init(self) -> Node | None:
        start = self.t.start
        while self.at("#"):
            self.attribute()
        if self.at(".."):
            self.next()
            return self.node("base_field_initializer", start, [self.expression()])
        if self.t.type not in ("word", "number"):
            return None
        if self.peek().text == ":":
            name = self.leaf("field_identifier" if self.t.type == "word" else "integer_literal", "field")
            self.next()
            return self.node("field_initializer", start, [name, self.expression(0, "value")])
        return self.node("shorthand_field_initializer", start, [self.leaf("identifier")])

    def condition(self) -> Node | None:
        save, self.structs = self.structs, False
        parts: list[Node] = []
        start = self.t.start
        while True:
            if self.at("let"):
                at = self.next().start
                p = self.tag(self.pattern(), "pattern")
                value = self.expression(4, "value") if self.eat("=") else None
                parts.append(self.node("let_condition", at, [p, value]))
            else:
                x = self.expression(3 if parts or self.has_let() else 0)
                if x is not None:
                    parts.append(x)
            if not self.eat("&&"):
                break
        self.structs = save
        if not parts:
            return None
        return self.tag(parts[0] if len(parts) == 1 else self.node("let_chain", start, parts), "condition")

    def has_let(self) -> bool:
        """Whether a let follows before the block of this condition."""
        i, depth = self.i, 0
        while i < len(self.toks) - 1:
            t = self.toks[i]
            if t.type == "op":
                if t.text == "{" and depth == 0:
                    return False
                depth += (t.text in "([{") - (t.text in ")]}")
                if depth < 0 or t.text == ";":
                    return False
            elif t.text == "let" and t.type == "word" and depth == 0:
                return True
            i += 1
        return False

    def if_(self) -> Node:
        start = self.next().start
        kids = [self.condition(), self.block("consequence") if self.at("{") else None]
        if self.at("else"):
            at = self.next().start
            inner = self.if_() if self.at("if") else self.block() if self.at("{") else None
            kids.append(self.node("else_clause", at, [inner], "alternative"))
        return self.node("if_expression", start, kids)

    def match_(self) -> Node:
        start = self.next().start
        save, self.structs = self.structs, False
        value = self.expression(0, "value")
        self.structs = True
        body = None
        if self.at("{"):
            at = self.next().start
            body = self.node("match_block", at, self.many("}", self.arm), "body")
        self.structs = save
        return self.node("match_expression", start, [value, body])

    def arm(self) -> Node | None:
        if self.at("#"):
            return self.attribute()
        start = self.t.start
        p = self.pattern()
        if p is None:
            return None
        guard = None
        if self.eat("if"):
            guard = self.condition()
        pattern = self.node("match_pattern", p.start, [p, guard], "pattern")
        self.eat("=>")
        value = self.expression(0, "value")
        return self.node("match_arm", start, [pattern, value])

    def loop(self) -> Node:
        start = self.t.start
        word = self.next().text
        kids: list[Node | None] = []
        if word == "while":
            kids.append(self.condition())
        elif word == "for":
            kids.append(self.tag(self.pattern(), "pattern"))
            self.eat("in")
            save, self.structs = self.structs, False
            kids.append(self.expression(0, "value"))
            self.structs = save
        kids.append(self.block("body") if self.at("{") else None)
        return self.node(word + "_expression", start, kids)

    def argument(self) -> Node | None:
        save, self.structs = self.structs, True
        x = self.expression()
        self.structs = save
        return x

    def postfix(self, left: Node, start: int) -> Node | None:
        if self.at("("):
            args = self.arguments("arguments")
            return self.node("call_expression", start, [self.tag(left, "function"), args])
        if self.at("."):
            self.next()
            if self.at("await"):
                self.next()
                return self.node("await_expression", start, [left])
            field = None
            if self.t.type == "word":
                field = self.leaf("field_identifier", "field")
            elif self.t.type == "number":
                field = self.leaf("integer_literal", "field")
            x = self.node("field_expression", start, [self.tag(left, "value"), field])
            if self.at("::") and self.peek().text == "<":
                self.next()
                x = self.node("generic_function", start, [self.tag(x, "function"), self.type_arguments()])
            return x
        if self.at("["):
            self.next()
            return self.node("index_expression", start, [left, *self.many("]", self.expression)])
        if self.at("?"):
            self.next()
            return self.node("try_expression", start, [left])
        return None
