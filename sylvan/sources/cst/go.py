"""Go."""

from __future__ import annotations

import re

from sylvan.sources.cst.base import Token
from sylvan.sources.cst.expressions import POWER, Expressions
from sylvan.sources.cst.tree import Node

_OPS = r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|&\^|:=|[-+*/%&|^=!<>]=|<<|>>|[-+*/%&|^~!=<>?:;,.(){}\[\]]"
_TOKENS = rf"""(?P<skip>[ \t\r\n﻿]+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"?|`[^`]*(?:`|\Z))|(?P<rune>'(?:[^'\\\n]|\\.)+'?)
|(?P<number>0[xXbBoO][0-9a-fA-F_.]+(?:[pP][+-]?[0-9_]+)?i?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?i?)|(?P<word>[^\W\d]\w*)|(?P<op>{_OPS})"""
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= &^=".split())
#: After these a line end is a semicolon.
ENDS_LINE = frozenset(("break", "continue", "fallthrough", "return"))


class Go(Expressions):
    TOKENS = re.compile(_TOKENS.replace("\n|", "|"), re.DOTALL)
    UNARY = dict.fromkeys(("!", "-", "+", "^", "*", "&", "<-"), "unary_expression")
    POWERS = {k: v for k, v in POWER.items() if k not in ("??", "instanceof", "in", "===", "!==", "<=>", "**", ">>>", "|", "^", "&")} | {"|": 11, "^": 11, "&": 12, "<<": 12, ">>": 12, "&^": 12}
    composite = True

    def scan(self) -> None:
        super().scan()
        out: list[Token] = []
        for t in self.toks:
            if out and t.after_line and self.closes_line(out[-1]):
                out.append(Token("op", ";", out[-1].end, out[-1].end, False))
            out.append(t)
        if out and self.closes_line(out[-1]):
            out.append(Token("op", ";", out[-1].end, out[-1].end, False))
        self.toks = out

    @staticmethod
    def closes_line(t: Token) -> bool:
        if t.type == "word":
            return t.text not in KEYWORDS or t.text in ENDS_LINE
        return t.type in ("string", "rune", "number") or t.text in ("++", "--", ")", "]", "}")

    def operand_field(self, kind: str) -> str:
        return "operand"

    def outer_closes(self, text: str) -> bool:
        return False

    # ---- declarations

    def file(self) -> list[Node]:
        kids = []
        while not self.end():
            if self.eat(";"):
                continue
            before = self.i
            x = self.top()
            if x is not None:
                kids.append(x)
            if self.i == before:
                kids.append(self.error())
        return kids

    def top(self) -> Node | None:
        start = self.t.start
        if self.at("package"):
            self.next()
            return self.node("package_clause", start, [self.leaf("package_identifier") if self.t.type == "word" else None])
        if self.at("import"):
            self.next()
            if self.at("("):
                at = self.next().start
                specs = self.node("import_spec_list", at, self.many(")", self.import_spec, (";",)))
            else:
                specs = self.import_spec()
            return self.node("import_declaration", start, [specs])
        if self.at("func"):
            return self.function()
        return self.statement()

    def import_spec(self) -> Node | None:
        start = self.t.start
        name = None
        if self.at("."):
            name = self.leaf("dot", "name")
        elif self.t.type == "word":
            name = self.leaf("blank_identifier" if self.t.text == "_" else "package_identifier", "name")
        if self.t.type != "string":
            return name
        return self.node("import_spec", start, [name, self.string("path")])

    def function(self) -> Node:
        start = self.next().start
        receiver = None
        kind = "function_declaration"
        if self.at("("):
            kind = "method_declaration"
            receiver = self.tag(self.parameters(), "receiver")
        name = self.leaf("field_identifier" if receiver else "identifier", "name") if self.t.type == "word" else None
        generic = None
        if self.at("["):
            at = self.next().start
            generic = self.node("type_parameter_list", at, self.many("]", self.type_parameter), "type_parameters")
        params = self.parameters() if self.at("(") else None
        result = self.result()
        body = self.block("body") if self.at("{") else None
        return self.node(kind, start, [receiver, name, generic, params, result, body])

    def type_parameter(self) -> Node:
        start = self.t.start
        names = []
        while self.t.type == "word":
            names.append(self.leaf("identifier", "name"))
            if not (self.at(",") and self.peek().type == "word" and self.peek(2).text in (",",)):
                if not (self.at(",") and self.peek().type == "word" and self.peek(2).type == "word"):
                    break
            self.next()
        at = self.t.start
        parts = []
        while not self.end() and not self.at(",", "]"):
            before = self.i
            self.eat("~")
            x = self.type_()
            if x:
                parts.append(x)
            self.eat("|")
            if self.i == before:
                self.next()
        return self.node("type_parameter_declaration", start, [*names, self.node("type_constraint", at, parts, "type") if parts else None])

    def result(self) -> Node | None:
        if self.at("{", ";", ")", ",", "]", "}", "=", ":=", ":") or self.end() or self.t.type == "string":
            return None
        if self.at("("):
            return self.tag(self.parameters(), "result")
        return self.type_("result")

    def parameters(self) -> Node:
        start = self.next().start
        close = self.closing(self.i - 1)
        # entries, split at commas: names come first if any entry is a word before a type
        entries: list[tuple[int, int]] = []
        i = at = self.i
        depth = 0
        while i < close:
            t = self.toks[i]
            if t.type == "op":
                if t.text in ("(", "[", "{"):
                    depth += 1
                elif t.text in (")", "]", "}"):
                    depth -= 1
                elif t.text == "," and depth == 0:
                    entries.append((at, i))
                    at = i + 1
            i += 1
        if at < close:
            entries.append((at, close))
        named = any(self.toks[a].type == "word" and self.toks[a].text not in KEYWORDS and b - a > 1 and (self.toks[a + 1].text not in (".", "[") or self.toks[a + 1].text == "[" and self.array_follows(a + 1, b)) for a, b in entries)
        kids: list[Node] = []
        names: list[Node] = []
        for a, b in entries:
            self.i = a
            if self.at(";"):
                continue
            if not named:
                s = self.t.start
                kind = "variadic_parameter_declaration" if self.eat("...") else "parameter_declaration"
                kids.append(self.node(kind, s, [self.type_("type")]))
                continue
            if self.t.type == "word":
                names.append(self.leaf("identifier", "name"))
            if self.i >= b or self.at(";"):
                continue
            s = names[0].start if names else self.t.start
            kind = "variadic_parameter_declaration" if self.eat("...") else "parameter_declaration"
            kids.append(self.node(kind, s, [*names, self.type_("type")]))
            names = []
        kids += [self.node("parameter_declaration", n.start, [n]) for n in names]
        self.i = close
        self.eat(")")
        return self.node("parameter_list", start, kids, "parameters")

    def array_follows(self, i: int, b: int) -> bool:
        """Whether ``name [`` begins a slice or array type and not the arguments of a generic type."""
        end = self.closing(i) + 1
        return end < b and (self.toks[end].type == "word" or self.toks[end].text in ("*", "[", "(", "<-"))

    # ---- types

    def type_(self, field: str | None = None) -> Node | None:
        self.depth += 1
        try:
            return self.tag(self._type(), field) if field else self._type()
        finally:
            self.depth -= 1

    def _type(self) -> Node | None:
        t, start = self.t, self.t.start
        if self.at("*"):
            self.next()
            return self.node("pointer_type", start, [self.type_()])
        if self.at("("):
            self.next()
            x = self.type_()
            self.eat(")")
            return self.node("parenthesized_type", start, [x])
        if self.at("["):
            if self.peek().text == "]":
                self.next()
                self.next()
                return self.node("slice_type", start, [self.type_("element")])
            self.next()
            if self.at("..."):
                self.next()
                self.eat("]")
                return self.node("implicit_length_array_type", start, [self.type_("element")])
            size = self.many("]", self.expression)
            return self.node("array_type", start, [*[self.tag(x, "length") for x in size[:1]], self.type_("element")])
        if self.at("map"):
            self.next()
            key = None
            if self.eat("["):
                key = self.type_("key")
                self.eat("]")
            return self.node("map_type", start, [key, self.type_("value")])
        if self.at("chan", "<-"):
            self.next()
            self.eat("chan", "<-")
            return self.node("channel_type", start, [self.type_("value")])
        if self.at("func"):
            self.next()
            params = self.parameters() if self.at("(") else None
            return self.node("function_type", start, [params, self.result()])
        if self.at("struct"):
            self.next()
            body = None
            if self.at("{"):
                at = self.next().start
                body = self.node("field_declaration_list", at, self.many("}", self.field_, (";",)))
            return self.node("struct_type", start, [body])
        if self.at("interface"):
            self.next()
            kids = []
            if self.at("{"):
                self.next()
                kids = self.many("}", self.interface_elem, (";",))
            return self.node("interface_type", start, kids)
        if t.type == "word" and t.text not in KEYWORDS:
            x = self.leaf("type_identifier")
            if self.at(".") and self.peek().type == "word":
                self.next()
                x.kind, x.field = "package_identifier", "package"
                x = self.node("qualified_type", start, [x, self.leaf("type_identifier", "name")])
            if self.at("[") and self.peek().text != "]":
                at = self.next().start
                args = self.node("type_arguments", at, self.many("]", self.type_), "type_arguments")
                x = self.node("generic_type", start, [self.tag(x, "type"), args])
            return x
        return None

    def field_(self) -> Node | None:
        start = self.t.start
        names = []
        if self.t.type == "word" and self.peek().text not in (".", ";", "}") and self.peek().type != "string":
            names.append(self.leaf("field_identifier", "name"))
            while self.at(","):
                self.next()
                if self.t.type == "word":
                    names.append(self.leaf("field_identifier", "name"))
        kind = self.type_("type")
        tag = self.string("tag") if self.t.type == "string" else None
        if kind is None and not names:
            return None
        return self.node("field_declaration", start, [*names, kind, tag])

    def interface_elem(self) -> Node | None:
        start = self.t.start
        if self.t.type == "word" and self.peek().text == "(":
            name = self.leaf("field_identifier", "name")
            params = self.parameters()
            return self.node("method_elem", start, [name, params, self.result()])
        parts = []
        while not self.end() and not self.at(";", "}"):
            before = self.i
            self.eat("~", "|")
            x = self.type_()
            if x:
                parts.append(x)
            if self.i == before:
                self.next()
        return self.node("type_elem", start, parts)

    # ---- statements

    def block(self, field: str | None = None) -> Node:
        start = self.next().start
        save, self.composite = self.composite, True
        kids = self.many("}", self.statement, (";",))
        self.composite = save
        return self.node("block", start, kids, field)

    def specs(self, one) -> list[Node]:
        if self.at("("):
            self.next()
            return self.many(")", one, (";",))
        x = one()
        return [x] if x is not None else []

    def var_spec(self) -> Node | None:
        start = self.t.start
        names = self.names("identifier")
        if not names:
            return None
        kind = self.type_("type") if not self.at("=", ";", ")") else None
        value = self.expressions("value") if self.eat("=") else None
        return self.node("var_spec", start, [*names, kind, value])

    def const_spec(self) -> Node | None:
        x = self.var_spec()
        if x is not None:
            x.kind = "const_spec"
        return x

    def names(self, kind: str) -> list[Node]:
        out = []
        while self.t.type == "word" and self.t.text not in KEYWORDS:
            out.append(self.leaf(kind, "name"))
            if not self.eat(","):
                break
        return out

    def type_spec(self) -> Node | None:
        start = self.t.start
        if self.t.type != "word":
            return None
        name = self.leaf("type_identifier", "name")
        generic = None
        if self.at("[") and self.peek().type == "word" and (self.peek(2).type == "word" or self.peek(2).text in ("*", "~", "[", "interface", ",")):
            at = self.next().start
            generic = self.node("type_parameter_list", at, self.many("]", self.type_parameter), "type_parameters")
        alias = self.eat("=")
        return self.node("type_alias" if alias else "type_spec", start, [name, generic, self.type_("type")])

    def expressions(self, field: str | None = None) -> Node | None:
        start, kids = self.t.start, []
        while True:
            x = self.expression()
            if x is None:
                break
            kids.append(x)
            if not self.eat(","):
                break
        return self.node("expression_list", start, kids, field) if kids else None

    def simple(self) -> Node | None:
        """A simple statement: an expression, a send, an increment, an assignment or a short declaration."""
        start = self.t.start
        if self.at("range"):
            self.next()
            return self.node("range_clause", start, [self.expression(0, "right")])
        left = self.expressions()
        if left is None:
            return None
        if self.at(":=") or self.t.type == "op" and self.t.text in ASSIGN:
            kind = "short_var_declaration" if self.next().text == ":=" else "assignment_statement"
            if self.at("range"):
                self.next()
                return self.node("range_clause", start, [self.tag(left, "left"), self.expression(0, "right")])
            return self.node(kind, start, [self.tag(left, "left"), self.expressions("right")])
        if self.at("++", "--"):
            kind = "inc_statement" if self.next().text == "++" else "dec_statement"
            return self.node(kind, start, left.kids)
        if self.at("<-"):
            self.next()
            return self.node("send_statement", start, [self.tag(left.kids[0], "channel"), self.expression(0, "value")])
        if len(left.kids) == 1:
            return self.node("expression_statement", start, left.kids)
        return left

    def header(self) -> tuple[Node | None, Node | None]:
        """Initializer and condition in front of a block."""
        save, self.composite = self.composite, False
        first = None if self.at("{", ";") else self.simple()
        second = None
        two = False
        if self.at(";") and self.peek().start >= self.t.end and not self.at("{"):
            two = True
            self.next()
            second = None if self.at("{") else self.simple()
        self.composite = save
        return (first, second) if two else (None, first)

    @staticmethod
    def bare(x: Node | None) -> Node | None:
        """The expression of an expression statement."""
        return x.kids[0] if x is not None and x.kind == "expression_statement" and x.kids else x

    def statement(self) -> Node | None:
        t, start = self.t, self.t.start
        if self.at("{"):
            return self.block()
        if t.type == "word":
            word = t.text
            if word in ("var", "const", "type"):
                self.next()
                one = {"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[word]
                kids = self.specs(one)
                return self.node({"var": "var_declaration", "const": "const_declaration", "type": "type_declaration"}[word], start, kids)
            if word == "func" and self.peek().type == "word":
                return self.function()
            if word == "if":
                self.next()
                init, cond = self.header()
                kids = [self.tag(init, "initializer"), self.tag(self.bare(cond), "condition")]
                kids.append(self.block("consequence") if self.at("{") else None)
                if self.eat("else"):
                    kids.append(self.tag(self.statement(), "alternative"))
                return self.node("if_statement", start, kids)
            if word == "for":
                return self.for_()
            if word in ("switch", "select"):
                return self.switch()
            if word in ("go", "defer"):
                self.next()
                return self.node(f"{word}_statement", start, [self.expression()])
            if word == "return":
                self.next()
                return self.node("return_statement", start, [None if self.at(";", "}") else self.expressions()])
            if word in ("break", "continue", "goto", "fallthrough"):
                self.next()
                label = self.leaf("label_name") if self.t.type == "word" else None
                return self.node(f"{word}_statement", start, [label])
            if word not in KEYWORDS and self.peek().text == ":" and self.peek(2).text != "=":
                label = self.leaf("label_name", "label")
                self.next()
                self.eat(";")
                return self.node("labeled_statement", start, [label, None if self.at("}") else self.statement()])
        return self.simple()

    def for_(self) -> Node:
        start = self.next().start
        save, self.composite = self.composite, False
        kids: list[Node | None] = []
        if not self.at("{"):
            at = self.t.start
            first = None if self.at(";") else self.simple()
            if self.at(";"):
                self.next()
                cond = None if self.at(";", "{") else self.bare(self.simple())
                self.eat(";")
                update = None if self.at("{") else self.simple()
                kids.append(self.node("for_clause", at, [self.tag(first, "initializer"), self.tag(cond, "condition"), self.tag(update, "update")]))
            else:
                kids.append(self.bare(first))
        self.composite = save
        kids.append(self.block("body") if self.at("{") else None)
        return self.node("for_statement", start, kids)

    def switch(self) -> Node:
        start = self.t.start
        kind = "select_statement" if self.next().text == "select" else "expression_switch_statement"
        init, value = self.header() if kind != "select_statement" else (None, None)
        value = self.bare(value)
        kids: list[Node | None] = [self.tag(init, "initializer")]
        subject = value
        if value is not None and value.kind == "short_var_declaration":
            right = value.get("right")
            subject = right.kids[0] if right is not None and right.kids else None
        if subject is not None and subject.kind == "type_switch_guard":
            kind = "type_switch_statement"
            if value is not subject:
                kids.append(self.tag(value.get("left"), "alias"))
            kids += [self.tag(k, "value") for k in subject.kids]
        else:
            kids.append(self.tag(value, "value"))
        if self.at("{"):
            self.next()
            self.case_kind = {"select_statement": "communication_case", "type_switch_statement": "type_case"}.get(kind, "expression_case")
            kids += self.many("}", self.case, (";",))
        return self.node(kind, start, kids)

    case_kind = "expression_case"

    def case(self) -> Node | None:
        start, kind = self.t.start, self.case_kind
        kids: list[Node | None] = []
        if self.eat("default"):
            kind = "default_case"
        elif self.eat("case"):
            if kind == "type_case":
                while not self.end() and not self.at(":"):
                    x = self.type_("type")
                    kids.append(x)
                    if not self.eat(",") or x is None:
                        break
            elif kind == "communication_case":
                kids.append(self.tag(self.simple(), "communication"))
            else:
                kids.append(self.expressions("value"))
        else:
            return None
        while not self.end() and not self.at(":", "}", "case", "default"):
            self.next()
        self.eat(":")
        save = self.case_kind
        while not self.end() and not self.at("case", "default", "}"):
            if self.eat(";"):
                continue
            before = self.i
            kids.append(self.statement())
            if self.i == before:
                kids.append(self.error())
        self.case_kind = save
        return self.node(kind, start, kids)

    # ---- expressions

    def string(self, field: str | None = None) -> Node:
        t = self.next()
        raw = t.text.startswith("`")
        inner = [Node("raw_string_literal_content" if raw else "interpreted_string_literal_content", t.start + 1, t.end - 1)] if t.end - t.start > 2 else []
        return Node("raw_string_literal" if raw else "interpreted_string_literal", t.start, t.end, inner, field)

    def primary(self) -> Node | None:
        t, start = self.t, self.t.start
        if t.type == "string":
            return self.string()
        if t.type == "rune":
            return self.leaf("rune_literal")
        if t.type == "number":
            text = t.text.lower()
            kind = "imaginary_literal" if text.endswith("i") else "float_literal" if not text.startswith("0x") and any(c in text for c in ".e") or "p" in text else "int_literal"
            return self.leaf(kind)
        if self.at("func"):
            self.next()
            params = self.parameters() if self.at("(") else None
            result = self.result()
            return self.node("func_literal", start, [params, result, self.block("body") if self.at("{") else None])
        if self.at("[", "map", "struct", "chan", "interface"):
            x = self.type_()
            if self.at("{"):
                return self.node("composite_literal", start, [self.tag(x, "type"), self.literal_value("body")])
            if self.at("(") and x is not None:
                self.next()
                return self.node("type_conversion_expression", start, [self.tag(x, "type"), *[self.tag(k, "operand") for k in self.many(")", self.expression)]])
            return x
        if t.type == "word":
            if t.text in KEYWORDS:
                return None
            if t.text in ("true", "false", "nil", "iota"):
                return self.leaf(t.text)
            return self.leaf("identifier")
        if self.at("("):
            self.next()
            save, self.composite = self.composite, True
            x = self.node("parenthesized_expression", start, self.many(")", self.expression_or_type, (",", ";")))
            self.composite = save
            return x
        return None

    def expression_or_type(self) -> Node | None:
        if self.at("[", "map", "chan", "struct", "interface"):
            return self.primary()
        return self.expression()

    def literal_value(self, field: str | None = None) -> Node:
        start = self.next().start
        save, self.composite = self.composite, True
        kids = self.many("}", self.element, (",", ";"))
        self.composite = save
        return self.node("literal_value", start, kids, field)

    def element(self) -> Node | None:
        start = self.t.start
        first = self.literal_element()
        if self.at(":"):
            self.next()
            return self.node("keyed_element", start, [first, self.literal_element()])
        return first

    def literal_element(self) -> Node | None:
        start = self.t.start
        x = self.literal_value() if self.at("{") else self.expression()
        return self.node("literal_element", start, [x]) if x is not None else None

    def argument(self) -> Node | None:
        start = self.t.start
        save, self.composite = self.composite, True
        x = self.expression_or_type() if not self.at("*") else self.expression()
        self.composite = save
        if x is not None and self.at("..."):
            self.next()
            return self.node("variadic_argument", start, [x])
        return x

    def postfix(self, left: Node, start: int) -> Node | None:
        if self.at("("):
            args = self.arguments("argument_list")
            return self.node("call_expression", start, [self.tag(left, "function"), args])
        if self.at("."):
            self.next()
            if self.at("("):
                self.next()
                if self.at("type"):
                    self.next()
                    self.eat(")")
                    return self.node("type_switch_guard", start, [left])
                kind = self.type_("type")
                self.eat(")")
                return self.node("type_assertion_expression", start, [self.tag(left, "operand"), kind])
            name = self.leaf("field_identifier", "field") if self.t.type == "word" else None
            return self.node("selector_expression", start, [self.tag(left, "operand"), name])
        if self.at("["):
            close = self.closing(self.i)
            sliced = self.top_level_colon(self.i + 1, close)
            self.next()
            save, self.composite = self.composite, True
            if sliced:
                kids = self.many("]", self.expression, (":",))
                out = self.node("slice_expression", start, [self.tag(left, "operand"), *kids])
            else:
                kids = self.many("]", self.expression_or_type)
                if len(kids) > 1:
                    for k in kids:
                        k.kind = "type_identifier" if k.kind == "identifier" else k.kind
                    args = Node("type_arguments", left.end, self.back(), kids, "type_arguments")
                    self.composite = save
                    if self.at("("):
                        self.i = self.i
                        return self.node("call_expression", start, [self.tag(left, "function"), args, self.arguments("argument_list")])
                    return self.node("type_instantiation_expression", start, [self.tag(left, "type"), args])
                out = self.node("index_expression", start, [self.tag(left, "operand"), *[self.tag(k, "index") for k in kids]])
            self.composite = save
            return out
        if self.at("{") and left.kind in ("identifier", "selector_expression", "index_expression") and self.literal_here(left):
            kind = self.as_type(left)
            return self.node("composite_literal", start, [self.tag(kind, "type"), self.literal_value("body")])
        return None

    def top_level_colon(self, i: int, close: int) -> bool:
        depth = 0
        for t in self.toks[i:close]:
            if t.type == "op":
                depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
                if t.text == ":" and depth == 0:
                    return True
        return False

    def literal_here(self, left: Node) -> bool:
        if left.kind == "selector_expression" and (left.kids[0].kind != "identifier"):
            return False
        if left.kind == "index_expression" and left.kids[0].kind not in ("identifier", "selector_expression"):
            return False
        return self.composite

    def as_type(self, x: Node) -> Node:
        """An expression that turned out to be a type."""
        if x.kind == "identifier":
            return Node("type_identifier", x.start, x.end)
        if x.kind == "selector_expression":
            a, b = x.kids[0], x.kids[-1]
            return Node("qualified_type", x.start, x.end, [Node("package_identifier", a.start, a.end, None, "package"), Node("type_identifier", b.start, b.end, None, "name")])
        if x.kind == "index_expression":
            args = [self.as_type(k) for k in x.kids[1:]]
            return Node("generic_type", x.start, x.end, [self.tag(self.as_type(x.kids[0]), "type"), Node("type_arguments", x.kids[0].end, x.end, args, "type_arguments")])
        return x
