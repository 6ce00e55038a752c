"""JavaScript (with JSX read as elements of names and expressions)."""

from __future__ import annotations

import re

from sylvan.sources.cst.base import Token
from sylvan.sources.cst.expressions import ASSIGN, Expressions
from sylvan.sources.cst.tree import Node

_OPS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|\?\.(?![0-9])|\+\+|--|&&|\|\||\?\?|\*\*|[-+*/%&|^=!<>]=|<<|>>|[-+*/%&|^~!=<>?:;,.(){}\[\]@#]"
_TOKENS = rf"""(?P<skip>[\s﻿]+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|\A\#![^\n]*)|(?P<string>"(?:[^"\\\n]|\\.|\\\n)*"?|'(?:[^'\\\n]|\\.|\\\n)*'?)|(?P<template>`)
|(?P<number>0[xXbBoO][0-9a-fA-F_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?n?)|(?P<word>\#?[^\W\d][\w$]*|\#?[$][\w$]*)|(?P<op>{_OPS})"""
#: After these words, and after operators, a slash begins a regular expression.
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
KEYWORDS = frozenset("if for while do switch return break continue try throw function class const let var import export new delete typeof void in of instanceof else case default finally catch with debugger".split())


def shifted(node: Node, by: int) -> Node:
    """The tree of a part of the source, moved to the part's place."""
    stack = [node]
    while stack:
        x = stack.pop()
        x.start += by
        x.end += by
        stack += x.kids
    return node


class JavaScript(Expressions):
    TOKENS = re.compile(_TOKENS.replace("\n|", "|"), re.DOTALL)
    ROOT = "program"
    UNARY = {"!": "unary_expression", "~": "unary_expression", "-": "unary_expression", "+": "unary_expression", "++": "update_expression", "--": "update_expression"}

    def scan(self) -> None:
        at, n, new_line = 0, len(self.source), True
        match = self.TOKENS.match
        self.templates: dict[int, int] = {}  # where a template string begins -> where it ends
        while at < n:
            c = self.source[at]
            if c == "/" and self.regex_here() and (m := REGEX.match(self.source, at)) and self.source[at + 1 : at + 2] not in ("/", "*"):
                self.toks.append(Token("regex", m.group(), at, m.end(), new_line))
                at, new_line = m.end(), False
                continue
            m = match(self.source, at)
            if m is None or m.end() == at:
                at += 1
                continue
            kind, start, at = m.lastgroup, at, m.end()
            if kind in ("skip", "comment"):
                if kind == "comment":
                    self.comments.append(Node("hash_bang_line" if m.group().startswith("#!") else "comment", start, at))
                new_line = new_line or "\n" in m.group()
                continue
            if kind == "template":
                at = self.template_end(start)
            self.toks.append(Token(kind, self.source[start:at], start, at, new_line))
            new_line = False

    def regex_here(self) -> bool:
        if not self.toks:
            return True
        t = self.toks[-1]
        if t.type == "word":
            return t.text in BEFORE_REGEX
        return t.type == "op" and t.text not in (")", "]", "}", "++", "--")

    def template_end(self, start: int) -> int:
        """End of a template string, nested ones included."""
        at, n, s = start + 1, len(self.source), self.source
        while at < n:
            if s[at] == "\\":
                at += 2
            elif s[at] == "`":
                return at + 1
            elif s.startswith("${", at):
                depth, at = 1, at + 2
                while at < n and depth:
                    c = s[at]
                    if c == "`":
                        at = self.template_end(at)
                        continue
                    if c in "'\"":
                        q = at + 1
                        while q < n and s[q] != c and s[q] != "\n":
                            q += 2 if s[q] == "\\" else 1
                        at = q
                    depth += (c == "{") - (c == "}")
                    at += 1
            else:
                at += 1
        return n

    # ---- statements

    def file(self) -> list[Node]:
        kids = []
        while not self.end():
            before = self.i
            x = self.statement()
            if x is not None:
                kids.append(x)
            if self.i == before:
                kids.append(self.error())
        return kids

    def semicolon(self) -> None:
        self.eat(";")

    def block(self, field: str | None = None) -> Node:
        start = self.next().start
        return self.node("statement_block", start, self.many("}", self.statement, ()), field)

    def outer_closes(self, text: str) -> bool:
        return False

    def statement(self) -> Node | None:
        t, start = self.t, self.t.start
        if self.at("{"):
            return self.block()
        if self.at(";"):
            return self.leaf("empty_statement")
        if t.type == "word":
            after = self.peek().text
            if t.text == "async" and after == "function" and not self.peek().after_line:
                return self.function("function_declaration", "generator_function_declaration")
            if t.text == "function":
                return self.function("function_declaration", "generator_function_declaration")
            if t.text == "class":
                return self.class_("class_declaration")
            if t.text in ("const", "var") or t.text == "let" and (self.peek().type == "word" or after in ("{", "[")):
                return self.variables()
            if t.text in ("if", "while", "with"):
                self.next()
                kids = [self.parenthesized(field="condition" if t.text != "with" else "object") if self.at("(") else None]
                kids.append(self.tag(self.statement(), "consequence" if t.text == "if" else "body"))
                if t.text == "if" and self.at("else"):
                    at = self.next().start
                    kids.append(self.node("else_clause", at, [self.statement()], "alternative"))
                return self.node(t.text + "_statement", start, kids)
            if t.text == "do":
                self.next()
                kids = [self.tag(self.statement(), "body")]
                if self.eat("while") and self.at("("):
                    kids.append(self.parenthesized(field="condition"))
                self.semicolon()
                return self.node("do_statement", start, kids)
            if t.text == "for":
                return self.for_()
            if t.text == "switch":
                self.next()
                value = self.parenthesized(field="value") if self.at("(") else None
                body = None
                if self.at("{"):
                    at = self.next().start
                    body = self.node("switch_body", at, self.many("}", self.case, ()), "body")
                return self.node("switch_statement", start, [value, body])
            if t.text in ("return", "throw"):
                self.next()
                x = None
                if not self.t.after_line and not self.at(";", "}"):
                    x = self.sequence()
                self.semicolon()
                return self.node(t.text + "_statement", start, [x])
            if t.text in ("break", "continue", "debugger"):
                self.next()
                label = self.leaf("statement_identifier", "label") if self.t.type == "word" and not self.t.after_line and self.t.text not in KEYWORDS else None
                self.semicolon()
                return self.node(t.text + "_statement", start, [label])
            if t.text == "try":
                self.next()
                kids = [self.block("body") if self.at("{") else None]
                if self.at("catch"):
                    at = self.next().start
                    p = None
                    if self.eat("("):
                        p = self.pattern("parameter")
                        while not self.end() and not self.eat(")"):
                            self.next()
                    kids.append(self.node("catch_clause", at, [p, self.block("body") if self.at("{") else None], "handler"))
                if self.at("finally"):
                    at = self.next().start
                    kids.append(self.node("finally_clause", at, [self.block("body") if self.at("{") else None], "finalizer"))
                return self.node("try_statement", start, kids)
            if t.text == "import" and after not in ("(", "."):
                return self.import_()
            if t.text == "export":
                return self.export()
            if after == ":" and t.text not in KEYWORDS:
                label = self.leaf("statement_identifier", "label")
                self.next()
                return self.node("labeled_statement", start, [label, self.tag(self.statement(), "body")])
        elif self.at("@"):
            decorators = self.decorators()
            x = self.statement()
            if x is not None and x.kind in ("class_declaration", "export_statement"):
                x.kids[:0] = decorators
                x.start = start
            return x
        x = self.sequence()
        if x is None:
            return None
        self.semicolon()
        return self.node("expression_statement", start, [x])

    def decorators(self) -> list[Node]:
        out = []
        while self.at("@"):
            start = self.next().start
            out.append(self.node("decorator", start, [self.expression(13)], "decorator"))
        return out

    def case(self) -> Node | None:
        start = self.t.start
        if self.eat("case"):
            kids, kind = [self.tag(self.sequence(), "value")], "switch_case"
        elif self.eat("default"):
            kids, kind = [], "switch_default"
        else:
            return None
        self.eat(":")
        while not self.end() and not self.at("case", "default", "}"):
            before = self.i
            kids.append(self.tag(self.statement(), "body"))
            if self.i == before:
                kids.append(self.error())
        return self.node(kind, start, kids)

    def variables(self) -> Node:
        start = self.t.start
        kind = "variable_declaration" if self.next().text == "var" else "lexical_declaration"
        kids = self.declarators()
        self.semicolon()
        return self.node(kind, start, kids)

    def declarators(self) -> list[Node]:
        kids = []
        while True:
            at = self.t.start
            name = self.pattern("name")
            if name is None:
                break
            value = self.expression(1, "value") if self.eat("=") else None
            kids.append(self.node("variable_declarator", at, [name, value]))
            if not self.eat(","):
                break
        return kids

    def pattern(self, field: str | None = None) -> Node | None:
        start = self.t.start
        if self.at("["):
            self.next()
            return self.node("array_pattern", start, self.many("]", self.element_pattern), field)
        if self.at("{"):
            self.next()
            return self.node("object_pattern", start, self.many("}", self.pair_pattern), field)
        if self.at("..."):
            self.next()
            return self.node("rest_pattern", start, [self.pattern()], field)
        if self.t.type == "word":
            return self.leaf("identifier", field)
        return None

    def element_pattern(self) -> Node | None:
        start = self.t.start
        x = self.pattern()
        if x is None:
            x = self.expression(1)
        if x is not None and self.eat("="):
            return self.node("assignment_pattern", start, [self.tag(x, "left"), self.expression(1, "right")])
        return x

    def pair_pattern(self) -> Node | None:
        start = self.t.start
        if self.at("..."):
            return self.pattern()
        if self.t.type == "word" and self.peek().text not in (":",):
            x = self.leaf("shorthand_property_identifier_pattern")
            if self.eat("="):
                return self.node("object_assignment_pattern", start, [self.tag(x, "left"), self.expression(1, "right")])
            return x
        key = self.property_name()
        if key is None:
            return None
        value = self.element_pattern() if self.eat(":") else None
        return self.node("pair_pattern", start, [self.tag(key, "key"), self.tag(value, "value")])

    def for_(self) -> Node:
        start = self.next().start
        self.eat("await")
        kids: list[Node | None] = []
        kind = "for_statement"
        if self.at("("):
            close = self.closing(self.i)
            self.next()
            at = self.t.start
            first: Node | None = None
            if self.at("const", "let", "var"):
                word = self.next().text
                name_at = self.t.start
                name = self.pattern()
                if self.at("of", "in"):
                    kind = "for_in_statement"
                    first = name
                    del name_at
                else:
                    decl = []
                    if name is not None:
                        value = self.expression(1, "value") if self.eat("=") else None
                        decl.append(self.node("variable_declarator", name.start, [self.tag(name, "name"), value]))
                        if self.eat(","):
                            decl += self.declarators()
                    self.eat(";")
                    first = self.node("variable_declaration" if word == "var" else "lexical_declaration", at, decl)
            elif not self.at(";"):
                self.no_in = True
                first = self.sequence()
                self.no_in = False
                if self.at("of", "in"):
                    kind = "for_in_statement"
                else:
                    first = self.node("expression_statement", at, [first])
                    self.eat(";")
            else:
                first = self.leaf("empty_statement")
            if kind == "for_in_statement":
                self.next()
                kids = [self.tag(first, "left"), self.tag(self.sequence(), "right")]
            else:
                kids = [self.tag(first, "initializer")]
                kids.append(self.tag(self.sequence(), "condition") if not self.at(";") else None)
                self.eat(";")
                kids.append(self.tag(self.sequence(), "increment") if not self.at(")") else None)
            self.i = max(self.i, close)
            self.eat(")")
        kids.append(self.tag(self.statement(), "body"))
        return self.node(kind, start, kids)

    def import_(self) -> Node:
        start = self.next().start
        kids: list[Node | None] = []
        if self.t.type != "string":
            at, parts = self.t.start, []
            while not self.end() and not self.at("from", ";") and self.t.type != "string":
                s = self.t.start
                if self.at("{"):
                    self.next()
                    parts.append(self.node("named_imports", s, self.many("}", self.specifier("import_specifier"))))
                elif self.eat("*"):
                    self.eat("as")
                    parts.append(self.node("namespace_import", s, [self.leaf("identifier") if self.t.type == "word" else None]))
                elif self.t.type == "word":
                    parts.append(self.leaf("identifier"))
                else:
                    self.next()
            kids.append(self.node("import_clause", at, parts))
            self.eat("from")
        if self.t.type == "string":
            kids.append(self.tag(self.primary(), "source"))
        self.semicolon()
        return self.node("import_statement", start, kids)

    def specifier(self, kind: str):
        def one() -> Node | None:
            start = self.t.start
            if self.t.type not in ("word", "string"):
                return None
            name = self.leaf("identifier" if self.t.type == "word" else "string", "name")
            alias = self.leaf("identifier", "alias") if self.eat("as") and self.t.type == "word" else None
            return self.node(kind, start, [name, alias])

        return one

    def export(self) -> Node:
        start = self.next().start
        kids: list[Node | None] = []
        if self.eat("default"):
            if self.at("function", "class") or self.at("async") and self.peek().text == "function":
                kids.append(self.tag(self.statement(), "declaration"))
            else:
                kids.append(self.expression(1, "value"))
                self.semicolon()
        elif self.at("{"):
            at = self.next().start
            kids.append(self.node("export_clause", at, self.many("}", self.specifier("export_specifier"))))
            if self.eat("from") and self.t.type == "string":
                kids.append(self.tag(self.primary(), "source"))
            self.semicolon()
        elif self.eat("*"):
            if self.eat("as"):
                self.next()
            if self.eat("from") and self.t.type == "string":
                kids.append(self.tag(self.primary(), "source"))
            self.semicolon()
        else:
            kids.append(self.tag(self.statement(), "declaration"))
        return self.node("export_statement", start, kids)

    # ---- functions and classes

    def function(self, kind: str, generator: str) -> Node:
        start = self.t.start
        self.eat("async")
        self.eat("function")
        if self.eat("*"):
            kind = generator
        name = self.leaf("identifier", "name") if self.t.type == "word" else None
        params = self.parameters() if self.at("(") else None
        body = self.block("body") if self.at("{") else None
        if name is None and kind == "function_declaration":
            kind = "function_expression"
        return self.node(kind, start, [name, params, body])

    def parameters(self) -> Node:
        start = self.next().start
        return self.node("formal_parameters", start, self.many(")", self.element_pattern), "parameters")

    def class_(self, kind: str) -> Node:
        start = self.next().start
        kids = [self.leaf("identifier", "name") if self.t.type == "word" and self.t.text != "extends" else None]
        if self.at("extends"):
            at = self.next().start
            kids.append(self.node("class_heritage", at, [self.expression(13)]))
        if self.at("{"):
            at = self.next().start
            kids.append(self.node("class_body", at, self.many("}", self.member, (";",)), "body"))
        return self.node(kind, start, kids)

    def member(self) -> Node | None:
        start = self.t.start
        decorators = self.decorators()
        if self.at("static") and self.peek().text == "{":
            self.next()
            return self.node("class_static_block", start, [self.block("body")])
        while self.t.text in ("static", "async", "get", "set") and self.peek().text not in ("(", "=", ";", "}"):
            self.next()
        self.eat("*")
        name = self.property_name()
        if name is None:
            return None
        if self.at("("):
            params = self.parameters()
            body = self.block("body") if self.at("{") else None
            return self.node("method_definition", start, [*decorators, self.tag(name, "name"), params, body])
        value = self.expression(1, "value") if self.eat("=") else None
        return self.node("field_definition", start, [*decorators, self.tag(name, "property"), value])

    def property_name(self) -> Node | None:
        t = self.t
        if t.type == "word":
            return self.leaf("private_property_identifier" if t.text.startswith("#") else "property_identifier")
        if t.type in ("string", "number"):
            return self.primary()
        if self.at("["):
            start = self.next().start
            return self.node("computed_property_name", start, self.many("]", self.expression))
        return None

    # ---- expressions

    no_in = False

    def operator(self) -> str:
        op = super().operator()
        if op == "in" and self.no_in or op == "of":
            return ""
        return op

    def sequence(self) -> Node | None:
        x = self.expression()
        if x is not None and self.at(","):
            start, kids = x.start, [x]
            while self.eat(","):
                kids.append(self.expression(1))
            return self.node("sequence_expression", start, kids)
        return x

    def argument(self) -> Node | None:
        return self.spread()

    def spread(self) -> Node | None:
        if self.at("..."):
            start = self.next().start
            return self.node("spread_element", start, [self.expression(1)])
        return self.expression(1)

    def tail(self, left: Node, start: int, power: int) -> Node:
        if power > 1:
            return left
        if self.at("?"):
            self.next()
            yes = self.expression(1, "consequence")
            self.eat(":")
            return self.node("ternary_expression", start, [self.tag(left, "condition"), yes, self.expression(1, "alternative")])
        if self.t.type == "op" and self.t.text in ASSIGN:
            kind = "assignment_expression" if self.next().text == "=" else "augmented_assignment_expression"
            if kind == "assignment_expression" and left.kind in ("object", "array"):
                left.kind += "_pattern"
            return self.node(kind, start, [self.tag(left, "left"), self.expression(1, "right")])
        return left

    def arrow_here(self) -> bool:
        t = self.t
        if t.type == "word" and t.text not in KEYWORDS:
            return self.peek().text == "=>" or t.text == "async" and not self.peek().after_line and (self.peek().type == "word" and self.peek(2).text == "=>" or self.peek().text == "(" and self.toks[min(self.closing(self.i + 1) + 1, len(self.toks) - 1)].text == "=>")
        return self.at("(") and self.toks[min(self.closing(self.i) + 1, len(self.toks) - 1)].text == "=>"

    def arrow(self) -> Node:
        start = self.t.start
        if self.at("async") and self.peek().text != "=>":
            self.next()
        head = self.parameters() if self.at("(") else self.leaf("identifier", "parameter")
        self.eat("=>")
        body = self.block("body") if self.at("{") else self.expression(1, "body")
        return self.node("arrow_function", start, [head, body])

    def prefix(self) -> Node | None:
        t, start = self.t, self.t.start
        if t.type == "word":
            if t.text in ("typeof", "void", "delete"):
                self.next()
                return self.node("unary_expression", start, [self.expression(13, "argument")])
            if t.text == "await" and self.peek().text not in (")", ";", ",", "=", "=>", "."):
                self.next()
                return self.node("await_expression", start, [self.expression(13)])
            if t.text == "yield":
                self.next()
                self.eat("*")
                x = None if self.t.after_line or self.at(")", ";", ",", "]", "}") else self.expression(1)
                return self.node("yield_expression", start, [x])
        return super().prefix()

    def primary(self) -> Node | None:
        t, start = self.t, self.t.start
        if self.arrow_here():
            return self.arrow()
        if t.type == "number":
            return self.leaf("number")
        if t.type == "regex":
            return self.leaf("regex")
        if t.type == "string":
            self.next()
            return Node("string", t.start, t.end, [Node("string_fragment", t.start + 1, t.end - 1)] if t.end - t.start > 2 else [])
        if t.type == "template":
            return self.template()
        if t.type == "word":
            if t.text in ("function",) or t.text == "async" and self.peek().text == "function":
                return self.function("function_expression", "generator_function")
            if t.text == "class":
                return self.class_("class")
            if t.text == "new":
                return self.new()
            if t.text in ("this", "super", "true", "false", "null", "undefined"):
                return self.leaf(t.text)
            if t.text == "import":
                return self.leaf("import")
            if t.text in KEYWORDS and t.text != "of":
                return None
            return self.leaf("identifier")
        if self.at("("):
            self.next()
            x = self.sequence()
            return self.node("parenthesized_expression", start, [x, *self.many(")", self.expression)])
        if self.at("["):
            self.next()
            return self.node("array", start, self.many("]", self.spread))
        if self.at("{"):
            self.next()
            return self.node("object", start, self.many("}", self.pair))
        if self.at("<") and (self.peek().type == "word" or self.peek().text == ">"):
            return self.jsx()
        return None

    def new(self) -> Node:
        start = self.next().start
        if self.at("."):
            self.next()
            self.next()
            return self.node("meta_property", start, [])
        at = self.t.start
        made = self.primary()
        while made is not None and self.at(".", "["):
            made = self.postfix(made, at)
        args = self.arguments("arguments") if self.at("(") else None
        return self.node("new_expression", start, [self.tag(made, "constructor"), args])

    def template(self) -> Node:
        t = self.next()
        kids, s, at, last = [], self.source, t.start + 1, t.start + 1
        while at < t.end - 1:
            if s[at] == "\\":
                at += 2
            elif s.startswith("${", at):
                if at > last:
                    kids.append(Node("string_fragment", last, at))
                depth, i = 1, at + 2
                while i < t.end and depth:
                    if s[i] == "`":
                        i = self.template_end(i)
                        continue
                    depth += (s[i] == "{") - (s[i] == "}")
                    i += 1
                x = type(self)(s[at + 2 : i - 1]).sequence()
                kids.append(Node("template_substitution", at, i, [shifted(x, at + 2)] if x else []))
                at = last = i
            else:
                at += 1
        if last < t.end - 1:
            kids.append(Node("string_fragment", last, t.end - 1))
        return Node("template_string", t.start, t.end, kids)

    def pair(self) -> Node | None:
        start = self.t.start
        if self.at("..."):
            return self.spread()
        t, after = self.t, self.peek()
        if t.type == "word" and after.text in (",", "}"):
            return self.leaf("shorthand_property_identifier")
        if t.type == "word" and after.text == "=":
            return self.pair_pattern()
        if t.text in ("async", "get", "set") and t.type == "word" and (after.type in ("word", "string", "number") or after.text in ("[", "*")) or self.at("*"):
            return self.member()
        key = self.property_name()
        if key is None:
            return None
        if self.at("("):
            params = self.parameters()
            return self.node("method_definition", start, [self.tag(key, "name"), params, self.block("body") if self.at("{") else None])
        value = self.expression(1, "value") if self.eat(":") else None
        return self.node("pair", start, [self.tag(key, "key"), value])

    def postfix(self, left: Node, start: int) -> Node | None:
        if self.at("("):
            args = self.arguments("arguments")
            return self.node("call_expression", start, [self.tag(left, "function"), args])
        if self.at(".", "?."):
            optional = self.next().text == "?."
            if optional and self.at("("):
                return self.node("call_expression", start, [self.tag(left, "function"), self.arguments("arguments")])
            if optional and self.at("["):
                self.next()
                return self.node("subscript_expression", start, [self.tag(left, "object"), *[self.tag(x, "index") for x in self.many("]", self.expression)[:1]]])
            name = None
            if self.t.type == "word":
                name = self.leaf("private_property_identifier" if self.t.text.startswith("#") else "property_identifier", "property")
            chain = [Node("optional_chain", left.end, left.end + 2)] if optional else []
            return self.node("member_expression", start, [self.tag(left, "object"), *chain, name])
        if self.at("["):
            self.next()
            return self.node("subscript_expression", start, [self.tag(left, "object"), *[self.tag(x, "index") for x in self.many("]", self.expression)[:1]]])
        if self.t.type == "template":
            return self.node("call_expression", start, [self.tag(left, "function"), self.tag(self.template(), "arguments")])
        if self.at("++", "--") and not self.t.after_line:
            self.next()
            return self.node("update_expression", start, [self.tag(left, "argument")])
        return None

    # ---- JSX

    def jsx(self) -> Node:
        start = self.next().start
        kids: list[Node | None] = []
        name_start = self.t.start
        if self.t.type == "word":
            self.next()
            while self.at(".", "-", ":") and self.peek().type == "word":
                self.next()
                self.next()
            kids.append(Node("identifier", name_start, self.back(), None, "name"))
        while not self.end() and not self.at(">", "/"):
            at, before = self.t.start, self.i
            if self.at("{"):
                kids.append(self.jsx_expression())
            elif self.t.type == "word":
                self.next()
                while self.at("-", ":") and self.peek().type == "word":
                    self.next()
                    self.next()
                attribute = Node("property_identifier", at, self.back())
                value = None
                if self.eat("="):
                    value = self.jsx_expression() if self.at("{") else self.primary()
                kids.append(self.node("jsx_attribute", at, [attribute, value], "attribute"))
            if self.i == before:
                self.next()
        if self.eat("/"):
            self.eat(">")
            return self.node("jsx_self_closing_element", start, kids)
        self.eat(">")
        opening = self.node("jsx_opening_element", start, kids, "open_tag")
        inside: list[Node | None] = [opening]
        while not self.end():
            before = self.i
            if self.at("<") and self.peek().text == "/":
                at = self.t.start
                while not self.end() and not self.eat(">"):
                    self.next()
                inside.append(self.node("jsx_closing_element", at, [], "close_tag"))
                break
            if self.at("<"):
                inside.append(self.jsx())
            elif self.at("{"):
                inside.append(self.jsx_expression())
            else:
                self.next()
            if self.i == before:
                self.next()
        return self.node("jsx_element", start, inside)

    def jsx_expression(self) -> Node:
        start = self.next().start
        return self.node("jsx_expression", start, self.many("}", self.spread))
