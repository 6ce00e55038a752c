"""Python."""

from __future__ import annotations

import re

from sylvan.sources.cst.base import Token
from sylvan.sources.cst.expressions import Expressions
from sylvan.sources.cst.tree import Node

_OPS = r"\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\*\*|//|<<|>>|[-+*/%&|^@=!<>]=|[-+*/%&|^~@=<>:;,.(){}\[\]!]"
_STRING = r"""(?:[rRbBuUfFtT]{1,2})?(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*(?:\"\"\"|\Z)|'''(?:[^'\\]|\\.|'(?!''))*(?:'''|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)"""
_TOKENS = rf"""(?P<skip>[ \t\f\r﻿]+|\\\r?\n)|(?P<comment>\#[^\n]*)|(?P<line>\n)|(?P<string>{_STRING})
|(?P<number>0[xXbBoO][0-9a-fA-F_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[jJlL]?)|(?P<word>[^\W\d]\w*)|(?P<op>{_OPS})"""
KEYWORDS = frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
ASSIGN = frozenset("+= -= *= /= //= %= **= >>= <<= &= ^= |= @=".split())


class Python(Expressions):
    TOKENS = re.compile(_TOKENS.replace("\n|(?P<number", "|(?P<number"), re.DOTALL)
    ROOT = "module"
    UNARY = {"-": "unary_operator", "+": "unary_operator", "~": "unary_operator"}
    POWERS = {"or": 2, "and": 3, "in": 5, "not in": 5, "is": 5, "is not": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "==": 5, "!=": 5, "|": 6, "^": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "//": 11, "%": 11, "@": 11, "**": 13}

    def scan(self) -> None:
        """Tokens with NEWLINE, INDENT and DEDENT where no bracket is open."""
        at, n, match = 0, len(self.source), self.TOKENS.match
        indents, brackets, fresh, column = [0], 0, True, 0
        while at < n:
            m = match(self.source, at)
            if m is None or m.end() == at:
                at += 1
                continue
            kind, text, start, at = m.lastgroup, m.group(), at, m.end()
            if kind == "skip":
                if fresh:
                    column += len(text.expandtabs()) if "\n" not in text else 0
                continue
            if kind == "comment":
                self.comments.append(Node("comment", start, at))
                continue
            if kind == "line":
                if not brackets and not fresh:
                    self.toks.append(Token("newline", "\n", start, at, False))
                if not brackets:
                    fresh, column = True, 0
                continue
            if fresh:
                fresh = False
                if column > indents[-1]:
                    indents.append(column)
                    self.toks.append(Token("indent", "", start, start, True))
                while column < indents[-1]:
                    indents.pop()
                    self.toks.append(Token("dedent", "", start, start, True))
            if kind == "op":
                if text in "([{":
                    brackets += 1
                elif text in ")]}":
                    brackets = max(0, brackets - 1)
            self.toks.append(Token(kind, text, start, at, False))
        if not fresh:
            self.toks.append(Token("newline", "\n", n, n, False))
        for _ in indents[1:]:
            self.toks.append(Token("dedent", "", n, n, True))

    def back(self) -> int:
        i = self.i - 1
        while i >= 0 and self.toks[i].type in ("newline", "indent", "dedent"):
            i -= 1
        return self.toks[i].end if i >= 0 else 0

    def line_over(self) -> bool:
        return self.t.type in ("newline", "end", "dedent") or self.at(";")

    def end_line(self) -> None:
        while not self.line_over():
            self.skip_brackets() if self.at("(", "[", "{") else self.next()
        if self.t.type == "newline" or self.at(";"):
            self.next()

    # ---- statements

    def file(self) -> list[Node]:
        kids = []
        while not self.end():
            before = self.i
            x = self.statement()
            if x is not None:
                kids.append(x)
            if self.i == before:
                if self.t.type in ("newline", "indent", "dedent"):
                    self.next()
                else:
                    kids.append(self.error())
        return kids

    def block(self, field: str = "body") -> Node | None:
        """What follows a colon: an indented block, or statements on the same line."""
        self.eat(":")
        start, kids = self.t.start, []
        if self.t.type == "newline":
            self.next()
            if self.t.type != "indent":
                return None
            self.next()
            start = self.t.start
            while not self.end() and self.t.type != "dedent":
                before = self.i
                x = self.statement()
                if x is not None:
                    kids.append(x)
                if self.i == before:
                    if self.t.type in ("newline", "indent"):
                        if self.t.type == "indent":
                            self.next()
                            inner = self.rest_of_block()
                            kids += inner
                        else:
                            self.next()
                    else:
                        kids.append(self.error())
            if self.t.type == "dedent":
                self.next()
            return self.node("block", start, kids, field)
        while not self.end() and self.t.type not in ("newline", "dedent"):
            before = self.i
            x = self.statement()
            if x is not None:
                kids.append(x)
            if self.i == before:
                kids.append(self.error())
            if self.toks[self.i - 1].type == "newline":
                break
        return self.node("block", start, kids, field)

    def rest_of_block(self) -> list[Node]:
        kids = []
        while not self.end() and self.t.type != "dedent":
            before = self.i
            x = self.statement()
            if x is not None:
                kids.append(x)
            if self.i == before:
                self.next()
        if self.t.type == "dedent":
            self.next()
        return kids

    def statement(self) -> Node | None:
        t, start = self.t, self.t.start
        if t.type == "newline":
            self.next()
            return None
        if self.at("@"):
            decorators = []
            while self.at("@"):
                s = self.next().start
                decorators.append(self.node("decorator", s, [self.expression()]))
                self.end_line()
            inner = self.statement()
            return self.node("decorated_definition", start, [*decorators, self.tag(inner, "definition")])
        if t.type == "word":
            word = t.text
            if word == "async" and self.peek().text in ("def", "for", "with"):
                self.next()
                word = self.t.text
            method = {
                "def": self.def_, "class": self.class_, "if": self.if_, "for": self.for_, "while": self.while_, "try": self.try_, "with": self.with_, "import": self.import_, "from": self.from_,
            }.get(word)
            if method is not None:
                return method(start)
            if word in ("return", "raise", "del", "assert", "global", "nonlocal"):
                self.next()
                kids = []
                while not self.line_over():
                    before = self.i
                    x = self.tuple_()
                    if x is not None:
                        kids.append(x)
                    self.eat(",", "from")
                    if self.i == before:
                        self.next()
                out = self.node({"del": "delete"}.get(word, word) + "_statement", start, kids)
                self.end_line()
                return out
            if word in ("pass", "break", "continue"):
                out = self.leaf(word + "_statement")
                self.end_line()
                return out
            if word == "match" and self.match_here():
                return self.match_(start)
            if word == "type" and self.peek().type == "word" and self.peek(2).text in ("=", "["):
                self.end_line()
                return self.node("type_alias_statement", start, [])
        x = self.simple()
        if x is None:
            return None
        out = self.node("expression_statement", start, [x])
        self.end_line()
        return out

    def simple(self) -> Node | None:
        """An expression, an assignment or an annotated name."""
        start = self.t.start
        left = self.tuple_("expression_list")
        if left is None:
            return None
        if self.at(":") and self.t.type == "op":
            self.next()
            kind = self.node("type", self.t.start, [self.expression()], "type")
            right = self.right_side() if self.eat("=") else None
            return self.node("assignment", start, [self.tag(left, "left"), kind, self.tag(right, "right")])
        if self.at("="):
            self.next()
            if left.kind in ("expression_list", "tuple", "list"):
                left.kind = {"expression_list": "pattern_list", "tuple": "tuple_pattern", "list": "list_pattern"}[left.kind]
            return self.node("assignment", start, [self.tag(left, "left"), self.tag(self.right_side(), "right")])
        if self.t.type == "op" and self.t.text in ASSIGN:
            self.next()
            return self.node("augmented_assignment", start, [self.tag(left, "left"), self.tag(self.right_side(), "right")])
        return left

    def right_side(self) -> Node | None:
        start = self.t.start
        x = self.tuple_("expression_list")
        if x is not None and self.at("="):
            self.next()
            return self.node("assignment", start, [self.tag(x, "left"), self.tag(self.right_side(), "right")])
        return x

    def tuple_(self, kind: str = "expression_list") -> Node | None:
        """Expressions with commas between, one alone as itself."""
        start = self.t.start
        x = self.starred()
        if x is None or not self.at(","):
            return x
        kids = [x]
        while self.eat(","):
            x = self.starred()
            if x is None:
                break
            kids.append(x)
        return self.node(kind, start, kids)

    def starred(self) -> Node | None:
        if self.at("*"):
            start = self.next().start
            return self.node("list_splat", start, [self.expression(5)])
        return self.expression()

    def def_(self, start: int) -> Node:
        self.next()
        name = self.leaf("identifier", "name") if self.t.type == "word" else None
        if self.at("["):
            self.skip_brackets()
        params = None
        if self.at("("):
            at = self.next().start
            params = self.node("parameters", at, self.many(")", self.parameter), "parameters")
        kind = None
        if self.eat("->"):
            at = self.t.start
            kind = self.node("type", at, [self.expression()], "return_type")
        body = self.block() if self.at(":") else self.end_line()
        return self.node("function_definition", start, [name, params, kind, body])

    def parameter(self) -> Node | None:
        start = self.t.start
        if self.at("/"):
            return self.leaf("positional_separator")
        if self.at("*", "**"):
            double = self.next().text == "**"
            if self.t.type != "word":
                return Node("keyword_separator", start, start + 1)
            x = self.node("dictionary_splat_pattern" if double else "list_splat_pattern", start, [self.leaf("identifier")])
        elif self.t.type == "word":
            x = self.leaf("identifier")
        elif self.at("("):
            self.skip_brackets()
            return Node("tuple_pattern", start, self.back())
        else:
            return None
        if self.eat(":"):
            at = self.t.start
            kind = self.node("type", at, [self.expression(1)], "type")
            if self.eat("="):
                return self.node("typed_default_parameter", start, [self.tag(x, "name"), kind, self.expression(1, "value")])
            return self.node("typed_parameter", start, [x, kind])
        if self.eat("="):
            return self.node("default_parameter", start, [self.tag(x, "name"), self.expression(1, "value")])
        return x

    def class_(self, start: int) -> Node:
        self.next()
        name = self.leaf("identifier", "name") if self.t.type == "word" else None
        if self.at("["):
            self.skip_brackets()
        bases = None
        if self.at("("):
            bases = self.arguments("argument_list", "superclasses")
        body = self.block() if self.at(":") else self.end_line()
        return self.node("class_definition", start, [name, bases, body])

    def if_(self, start: int) -> Node:
        self.next()
        kids = [self.tag(self.expression(), "condition"), self.block("consequence")]
        while self.at("elif"):
            at = self.next().start
            cond = self.tag(self.expression(), "condition")
            kids.append(self.node("elif_clause", at, [cond, self.block("consequence")], "alternative"))
        kids.append(self.else_("alternative"))
        return self.node("if_statement", start, kids)

    def else_(self, field: str = "alternative") -> Node | None:
        if not self.at("else"):
            return None
        at = self.next().start
        return self.node("else_clause", at, [self.block()], field)

    def for_(self, start: int) -> Node:
        self.next()
        left = self.targets()
        self.eat("in")
        right = self.tag(self.tuple_(), "right")
        body = self.block()
        return self.node("for_statement", start, [left, right, body, self.else_()])

    def targets(self) -> Node | None:
        start, kids = self.t.start, []
        while not self.line_over() and not self.at("in", ":"):
            before = self.i
            x = self.expression(5) if not self.at("*") else self.starred()
            if x is not None:
                kids.append(x)
            self.eat(",")
            if self.i == before:
                break
        if len(kids) == 1 and self.toks[self.i - 1].text != ",":
            return self.tag(kids[0], "left")
        return self.node("pattern_list", start, kids, "left") if kids else None

    def while_(self, start: int) -> Node:
        self.next()
        return self.node("while_statement", start, [self.tag(self.expression(), "condition"), self.block(), self.else_()])

    def try_(self, start: int) -> Node:
        self.next()
        kids = [self.block()]
        while self.at("except", "finally", "else"):
            at, word = self.t.start, self.next().text
            if word == "else":
                kids.append(self.node("else_clause", at, [self.block()]))
                continue
            if word == "finally":
                kids.append(self.node("finally_clause", at, [self.block(None)]))
                continue
            self.eat("*")
            inner = []
            if not self.at(":"):
                s = self.t.start
                x = self.tuple_()
                if self.eat("as"):
                    target = self.node("as_pattern_target", self.t.start, [self.leaf("identifier")], "alias")
                    x = self.node("as_pattern", s, [x, target])
                inner.append(x)
            kids.append(self.node("except_clause", at, [*inner, self.block(None)]))
        return self.node("try_statement", start, kids)

    def with_(self, start: int) -> Node:
        self.next()
        at = self.t.start
        grouped = self.at("(") and self.toks[min(self.closing(self.i) + 1, len(self.toks) - 1)].text == ":"
        if grouped:
            self.next()
        items = []
        while not self.at(":") and not self.line_over() and not self.at(")"):
            before, s = self.i, self.t.start
            x = self.expression()
            if self.eat("as"):
                target = self.node("as_pattern_target", self.t.start, [self.expression(6)], "alias")
                x = self.node("as_pattern", s, [x, target])
            items.append(self.node("with_item", s, [self.tag(x, "value")]))
            self.eat(",")
            if self.i == before:
                self.next()
        if grouped:
            self.eat(")")
        clause = self.node("with_clause", at, items)
        return self.node("with_statement", start, [clause, self.block()])

    def match_here(self) -> bool:
        """A match statement: the line ends in a colon and a case follows."""
        i = self.i + 1
        if self.toks[i].text in ("=", ".", ",", ")", ":") or self.toks[i].type == "newline":
            return False
        while self.toks[i].type not in ("newline", "end"):
            i += 1
        return self.toks[i - 1].text == ":" and self.toks[min(i + 1, len(self.toks) - 1)].type == "indent" and self.toks[min(i + 2, len(self.toks) - 1)].text == "case"

    def match_(self, start: int) -> Node:
        self.next()
        subject = self.tag(self.tuple_(), "subject")
        self.eat(":")
        kids, at = [], self.t.start
        if self.t.type == "newline":
            self.next()
            if self.t.type == "indent":
                self.next()
                at = self.t.start
                while self.at("case"):
                    s = self.next().start
                    p = self.t.start
                    pattern = self.node("case_pattern", p, [self.tuple_()])
                    while not self.line_over() and not self.at(":", "if"):
                        self.next()
                    guard = self.node("if_clause", self.next().start, [self.expression()], "guard") if self.at("if") else None
                    kids.append(self.node("case_clause", s, [pattern, guard, self.block("consequence")], "alternative"))
                if self.t.type == "dedent":
                    self.next()
        return self.node("match_statement", start, [subject, self.node("block", at, kids, "body")])

    def dotted(self, field: str | None = None) -> Node:
        start, kids = self.t.start, []
        while self.t.type == "word" and self.t.text not in KEYWORDS:
            kids.append(self.leaf("identifier"))
            if not self.eat("."):
                break
        return self.node("dotted_name", start, kids, field)

    def import_names(self) -> list[Node]:
        out = []
        while self.t.type == "word" and self.t.text not in KEYWORDS:
            s = self.t.start
            name = self.dotted("name")
            if self.eat("as"):
                alias = self.leaf("identifier", "alias") if self.t.type == "word" else None
                name = self.node("aliased_import", s, [name, alias], "name")
            out.append(name)
            if not self.eat(","):
                break
        return out

    def import_(self, start: int) -> Node:
        self.next()
        out = self.node("import_statement", start, self.import_names())
        out.end = self.back()
        self.end_line()
        return out

    def from_(self, start: int) -> Node:
        self.next()
        at = self.t.start
        dots = 0
        while self.at(".", "..."):
            dots += len(self.next().text)
        if dots:
            prefix = Node("import_prefix", at, self.back())
            module = self.node("relative_import", at, [prefix, self.dotted() if self.t.type == "word" and not self.at("import") else None], "module_name")
        else:
            module = self.dotted("module_name")
        kids = [module]
        self.eat("import")
        if self.at("*"):
            kids.append(self.leaf("wildcard_import"))
        else:
            open_ = self.eat("(")
            kids += self.import_names()
            if open_:
                self.eat(")")
        kind = "future_import_statement" if module.text(self.source) == "__future__" else "import_from_statement"
        out = self.node(kind, start, kids)
        self.end_line()
        return out

    # ---- expressions

    def operator(self) -> str:
        t = self.t
        if t.type == "word":
            if t.text == "not" and self.peek().text == "in":
                return "not in"
            if t.text == "is" and self.peek().text == "not":
                return "is not"
            return t.text if t.text in ("and", "or", "in", "is") else ""
        return t.text if t.type == "op" else ""

    def take_operator(self, op: str) -> None:
        for _ in op.split(" "):
            self.next()

    def binary_kind(self, op: str) -> str:
        if op in ("and", "or"):
            return "boolean_operator"
        return "comparison_operator" if self.POWERS[op] == 5 else "binary_operator"

    def tail(self, left: Node, start: int, power: int) -> Node:
        if left.kind == "comparison_operator":
            # a chain of comparisons is one node; its operands have no fields
            flat: list[Node] = []
            for k in left.kids:
                flat += k.kids if k.kind == "comparison_operator" and k.start == left.start and k.field == "left" else [k]
            for k in flat:
                k.field = None
            left.kids = flat
        if power > 1:
            return left
        if self.at("if"):
            self.next()
            cond = self.expression(1)
            other = self.expression() if self.eat("else") else None
            return self.node("conditional_expression", start, [left, cond, other])
        if self.at(":="):
            self.next()
            return self.node("named_expression", start, [self.tag(left, "name"), self.expression(1, "value")])
        return left

    def prefix(self) -> Node | None:
        t, start = self.t, self.t.start
        if t.type == "word":
            if t.text == "not":
                self.next()
                return self.node("not_operator", start, [self.expression(4, "argument")])
            if t.text == "await":
                self.next()
                return self.node("await", start, [self.expression(13)])
            if t.text == "lambda":
                self.next()
                at, params = self.t.start, []
                while not self.at(":") and not self.line_over():
                    before = self.i
                    x = self.lambda_parameter()
                    if x is not None:
                        params.append(x)
                    self.eat(",")
                    if self.i == before:
                        self.next()
                head = self.node("lambda_parameters", at, params, "parameters") if params else None
                self.eat(":")
                return self.node("lambda", start, [head, self.expression(1, "body")])
            if t.text == "yield":
                self.next()
                self.eat("from")
                x = None if self.line_over() or self.at(")", "]", "}", "=", ",") else self.tuple_()
                return self.node("yield", start, [x])
        return super().prefix()

    def lambda_parameter(self) -> Node | None:
        start = self.t.start
        if self.at("*", "**"):
            double = self.next().text == "**"
            return self.node("dictionary_splat_pattern" if double else "list_splat_pattern", start, [self.leaf("identifier") if self.t.type == "word" else None])
        if self.t.type != "word":
            return None
        x = self.leaf("identifier")
        if self.eat("="):
            return self.node("default_parameter", start, [self.tag(x, "name"), self.expression(1, "value")])
        return x

    def primary(self) -> Node | None:
        t, start = self.t, self.t.start
        if t.type == "number":
            text = t.text.lower()
            real = not text.startswith(("0x", "0b", "0o")) and any(c in text for c in ".ej")
            return self.leaf("float" if real else "integer")
        if t.type == "string":
            first = self.string()
            if self.t.type != "string":
                return first
            parts = [first]
            while self.t.type == "string":
                parts.append(self.string())
            return self.node("concatenated_string", start, parts)
        if t.type == "word":
            if t.text in ("True", "False", "None"):
                return self.leaf(t.text.lower())
            if t.text in KEYWORDS:
                return None
            return self.leaf("identifier")
        if self.at("..."):
            return self.leaf("ellipsis")
        if self.at("("):
            return self.round(start)
        if self.at("["):
            return self.bracketed(start, "]", "list", "list_comprehension")
        if self.at("{"):
            return self.braces(start)
        return None

    def string(self) -> Node:
        t = self.next()
        text = t.text
        head = next(i for i, c in enumerate(text) if c in "'\"")
        q = 3 if text[head : head + 3] in ('"""', "'''") else 1
        a, b = t.start + head + q, t.end - (q if text.endswith(text[head : head + q]) and len(text) >= head + 2 * q else 0)
        kids = [Node("string_start", t.start, a)]
        if "f" in text[:head].lower() and "{" in text:
            kids += self.interpolations(a, b)
        elif b > a:
            kids.append(Node("string_content", a, b))
        kids.append(Node("string_end", b, t.end))
        return Node("string", t.start, t.end, kids)

    def interpolations(self, a: int, b: int) -> list[Node]:
        from sylvan.sources.cst.javascript import shifted

        kids, s, at, last = [], self.source, a, a
        while at < b:
            if s.startswith(("{{", "}}"), at):
                at += 2
            elif s[at] == "{":
                if at > last:
                    kids.append(Node("string_content", last, at))
                depth, i = 1, at + 1
                while i < b and depth:
                    depth += (s[i] in "{[(") - (s[i] in "}])")
                    i += 1
                x = type(self)(s[at + 1 : i - 1]).tuple_() if self.depth < 40 else None
                kids.append(Node("interpolation", at, i, [self.tag(shifted(x, at + 1), "expression")] if x else []))
                at = last = i
            else:
                at += 1
        if last < b:
            kids.append(Node("string_content", last, b))
        return kids

    def round(self, start: int) -> Node:
        self.next()
        if self.at(")"):
            self.next()
            return self.node("tuple", start, [])
        comma = False
        kids: list[Node] = []
        while not self.end() and not self.at(")"):
            before = self.i
            x = self.starred()
            if x is not None:
                kids.append(x)
            if self.at("for", "async") and kids:
                clauses = self.comprehension()
                self.eat(")")
                return self.node("generator_expression", start, [self.tag(kids[0], "body"), *clauses])
            if self.eat(","):
                comma = True
            if self.i == before:
                if self.t.type in ("newline", "indent", "dedent"):
                    self.next()
                else:
                    kids.append(self.error())
        self.eat(")")
        return self.node("tuple" if comma or not kids else "parenthesized_expression", start, kids)

    def bracketed(self, start: int, stop: str, kind: str, comprehension: str) -> Node:
        self.next()
        kids: list[Node] = []
        while not self.end() and not self.at(stop):
            before = self.i
            x = self.starred()
            if x is not None:
                kids.append(x)
            if self.at("for", "async") and len(kids) == 1:
                clauses = self.comprehension()
                self.eat(stop)
                return self.node(comprehension, start, [self.tag(kids[0], "body"), *clauses])
            self.eat(",")
            if self.i == before:
                kids.append(self.error())
        self.eat(stop)
        return self.node(kind, start, kids)

    def comprehension(self) -> list[Node]:
        out = []
        while self.at("for", "async", "if"):
            start = self.t.start
            if self.eat("if"):
                out.append(self.node("if_clause", start, [self.expression(1.5)]))
                continue
            self.eat("async")
            self.next()
            left = self.targets()
            self.eat("in")
            out.append(self.node("for_in_clause", start, [left, self.expression(1.5, "right")]))
        return out

    def braces(self, start: int) -> Node:
        self.next()
        kids: list[Node] = []
        dictionary = True
        while not self.end() and not self.at("}"):
            before, s = self.i, self.t.start
            if self.at("**"):
                self.next()
                kids.append(self.node("dictionary_splat", s, [self.expression(6)]))
            else:
                x = self.starred()
                if x is not None and self.eat(":"):
                    x = self.node("pair", s, [self.tag(x, "key"), self.expression(0, "value")])
                elif x is not None:
                    dictionary = False
                if x is not None:
                    kids.append(x)
                if self.at("for", "async") and len(kids) == 1:
                    clauses = self.comprehension()
                    self.eat("}")
                    return self.node("dictionary_comprehension" if dictionary else "set_comprehension", start, [self.tag(kids[0], "body"), *clauses])
            self.eat(",")
            if self.i == before:
                kids.append(self.error())
        self.eat("}")
        return self.node("dictionary" if dictionary else "set", start, kids)

    def argument(self) -> Node | None:
        start = self.t.start
        if self.at("*", "**"):
            double = self.next().text == "**"
            return self.node("dictionary_splat" if double else "list_splat", start, [self.expression()])
        if self.t.type == "word" and self.peek().text == "=" and self.t.text not in KEYWORDS:
            name = self.leaf("identifier", "name")
            self.next()
            return self.node("keyword_argument", start, [name, self.expression(0, "value")])
        x = self.expression()
        if x is not None and self.at("for", "async"):
            return self.node("generator_expression", start, [self.tag(x, "body"), *self.comprehension()])
        return x

    def postfix(self, left: Node, start: int) -> Node | None:
        if self.at("("):
            args = self.arguments("argument_list")
            if len(args.kids) == 1 and args.kids[0].kind == "generator_expression":
                inner = args.kids[0]
                inner.start, inner.end, inner.field = args.start, args.end, "arguments"
                args = inner
            return self.node("call", start, [self.tag(left, "function"), args])
        if self.at("."):
            self.next()
            name = self.leaf("identifier", "attribute") if self.t.type == "word" else None
            return self.node("attribute", start, [self.tag(left, "object"), name])
        if self.at("["):
            self.next()
            kids = [self.tag(k, "subscript") for k in self.many("]", self.subscript)]
            return self.node("subscript", start, [self.tag(left, "value"), *kids])
        return None

    def subscript(self) -> Node | None:
        start = self.t.start
        first = None if self.at(":") else self.starred()
        if not self.at(":"):
            return first
        kids = [first]
        while self.eat(":"):
            if not self.at(":", "]", ","):
                kids.append(self.expression())
        return self.node("slice", start, kids)
