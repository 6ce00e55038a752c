"""C and C++."""

from __future__ import annotations

import re

from sylvan.sources.cst.base import Token
from sylvan.sources.cst.expressions import ASSIGN, Expressions
from sylvan.sources.cst.tree import Node

_OPS = r"<=>|<<=|>>=|\.\.\.|->\*|->|\+\+|--|&&|\|\||::|\.\*|##|[-+*/%&|^=!<>]=|<<|>>|[-+*/%&|^~!=<>?:;,.(){}\[\]#@\\]"
_TOKENS = rf"""(?P<skip>\s+|\\\r?\n)|(?P<comment>//(?:[^\n\\]|\\.|\\\n)*|/\*.*?(?:\*/|\Z))|(?P<raw>(?:u8|[uUL])?R"[^(\s"\\]{{0,16}}\()
|(?P<string>(?:u8|[uUL])?"(?:[^"\\\n]|\\.|\\\n)*"?)|(?P<char>(?:u8|[uUL])?'(?:[^'\\\n]|\\.)*'?)
|(?P<number>(?:\.?[0-9])(?:[eEpP][+-]|[0-9a-zA-Z_.]|'(?=[0-9a-fA-F]))*)|(?P<word>[^\W\d]\w*)|(?P<op>{_OPS})"""
PRIMITIVE = frozenset("void char short int long float double signed unsigned bool size_t ssize_t ptrdiff_t intptr_t uintptr_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t char8_t char16_t char32_t wchar_t _Bool".split())
QUALIFIER = frozenset("const volatile restrict static extern inline register auto typedef constexpr virtual explicit friend mutable thread_local consteval constinit _Atomic __inline__ __inline __extension__ noexcept".split())
STATEMENT = frozenset("if for while do switch return break continue goto case default try throw else".split())
ACCESS = frozenset(("public", "private", "protected"))
NOT_TYPE = STATEMENT | {"sizeof", "new", "delete", "this", "true", "false", "nullptr", "operator", "using", "namespace", "template", "co_return", "co_await", "co_yield", "static_cast", "dynamic_cast", "reinterpret_cast", "const_cast"}


class C(Expressions):
    TOKENS = re.compile(_TOKENS.replace("\n|", "|"), re.DOTALL)
    ROOT = "translation_unit"
    CPP = False
    UNARY = {"!": "unary_expression", "~": "unary_expression", "-": "unary_expression", "+": "unary_expression", "*": "pointer_expression", "&": "pointer_expression", "++": "update_expression", "--": "update_expression"}

    def raw_end(self, text: str, start: int, at: int) -> int:
        close = ")" + text[text.index('"') + 1 : -1] + '"'
        found = self.source.find(close, at)
        return len(self.source) if found < 0 else found + len(close)

    # ---- preprocessor

    def line_end(self) -> int:
        """Number of the first token that stands on another line than the current one."""
        i = self.i + 1
        while not self.toks[i].after_line:
            i += 1
        return i

    def directive(self) -> Node:
        start, stop = self.t.start, self.line_end()
        self.next()
        name = self.t.text if self.i < stop else ""
        kids: list[Node] = []
        kind = "preproc_call"
        if name in ("include", "import", "include_next"):
            kind = "preproc_include"
            self.next()
            if self.i < stop:
                if self.t.type == "string":
                    kids.append(self.string("path"))
                else:
                    kids.append(Node("system_lib_string", self.t.start, self.toks[stop - 1].end, None, "path"))
        elif name == "define":
            self.next()
            if self.i < stop:
                kind = "preproc_def"
                word = self.leaf("identifier", "name")
                kids.append(word)
                if self.i < stop and self.at("(") and self.t.start == word.end:
                    kind = "preproc_function_def"
                    close = min(self.closing(self.i), stop - 1)
                    params = [Node("identifier", t.start, t.end) for t in self.toks[self.i + 1 : close] if t.type == "word"]
                    kids.append(Node("preproc_params", self.t.start, self.toks[close].end, params, "parameters"))
                    self.i = close + 1
                if self.i < stop:
                    kids.append(Node("preproc_arg", self.t.start, self.toks[stop - 1].end, None, "value"))
        elif name in ("if", "ifdef", "ifndef", "elif", "else"):
            return self.conditional(start, stop, name)
        self.i = stop
        return Node(kind, start, self.toks[stop - 1].end, kids)

    def conditional(self, start: int, stop: int, name: str) -> Node:
        kind = {"ifdef": "preproc_ifdef", "ifndef": "preproc_ifdef", "elif": "preproc_elif", "else": "preproc_else"}.get(name, "preproc_if")
        kids = []
        self.next()
        if self.i < stop:
            if name in ("ifdef", "ifndef"):
                kids.append(Node("identifier", self.t.start, self.t.end, None, "name"))
            else:
                kids += [Node("identifier", t.start, t.end, None, "condition") for t in self.toks[self.i : stop] if t.type == "word" and t.text != "defined"][:1]
        self.i = stop
        while not self.end():
            if self.at("#") and self.t.after_line:
                word = self.peek().text
                if word == "endif":
                    if name not in ("elif", "else"):
                        self.i = self.line_end()
                    break
                if word in ("elif", "else", "elifdef"):
                    if name == "else":
                        break
                    inner = self.conditional_branch()
                    kids.append(inner)
                    continue
            if self.at("}"):
                break
            before = self.i
            x = self.external()
            if x:
                kids.append(x)
            if self.i == before:
                kids.append(self.error())
        return self.node(kind, start, kids)

    def conditional_branch(self) -> Node:
        start, stop = self.t.start, self.line_end()
        self.next()
        return self.tag(self.conditional(start, stop, "else" if self.t.text == "else" else "elif"), "alternative")

    # ---- declarations

    def file(self) -> list[Node]:
        kids = []
        while not self.end():
            before = self.i
            x = self.external()
            if x is not None:
                kids.append(x)
            if self.i == before:
                kids.append(self.error())
        return kids

    def external(self) -> Node | None:
        if self.at("#") and self.t.after_line:
            return self.directive()
        if self.eat(";"):
            return None
        if self.CPP:
            x = self.cpp_external()
            if x is not None:
                return x
        if self.at("extern") and self.peek().type == "string":
            start = self.next().start
            value = self.string("value")
            body = self.block("declaration_list", self.external, "body") if self.at("{") else self.tag(self.external(), "body")
            return self.node("linkage_specification", start, [value, body])
        return self.declaration()

    def cpp_external(self) -> Node | None:
        return None

    def block(self, kind: str, item, field: str | None = None) -> Node:
        start = self.next().start
        return self.node(kind, start, self.many("}", item, ()), field)

    def outer_closes(self, text: str) -> bool:
        return False

    def specifiers(self) -> list[Node] | None:
        """Type and qualifiers in front of a declarator; None if no type is there."""
        kids: list[Node] = []
        typed = False
        while not self.end():
            t = self.t
            if t.type == "word" and t.text in QUALIFIER and not (t.text == "auto" and self.CPP and not typed):
                kind = "storage_class_specifier" if t.text in ("static", "extern", "inline", "register", "typedef", "thread_local") else "type_qualifier"
                kids.append(self.leaf(kind))
            elif t.text in ("__attribute__", "alignas", "__declspec", "_Alignas") and self.peek().text == "(":
                start = self.next().start
                self.skip_brackets()
                kids.append(Node("attribute_specifier", start, self.back()))
            elif self.at("[") and self.peek().text == "[" and self.CPP:
                start = t.start
                self.skip_brackets()
                kids.append(Node("attribute_declaration", start, self.back()))
            elif t.type != "word" or t.text in NOT_TYPE and not (t.text == "template"):
                if self.at("::") and self.CPP and not typed:
                    kids.append(self.type_name("type"))
                    typed = True
                    continue
                if t.text == "operator" and self.CPP:
                    return kids
                break
            elif t.text in ("struct", "union", "enum", "class") and not typed:
                kids.append(self.tag(self.record(), "type"))
                typed = True
            elif t.text in PRIMITIVE:
                if typed and kids[-1].kind not in ("primitive_type", "sized_type_specifier"):
                    if not any(k.kind in ("primitive_type", "sized_type_specifier") for k in kids):
                        break
                start = t.start
                first = self.next().text
                kind = "primitive_type"
                while self.t.text in PRIMITIVE or self.t.text in ("unsigned", "signed", "long", "short"):
                    self.next()
                    kind = "sized_type_specifier"
                if first in ("unsigned", "signed", "long", "short"):
                    kind = "sized_type_specifier"
                kids.append(Node(kind, start, self.back(), None, "type"))
                typed = True
            elif t.text in ("decltype", "typeof", "__typeof__") and self.peek().text == "(":
                start = self.next().start
                self.skip_brackets()
                kids.append(Node("decltype", start, self.back(), None, "type"))
                typed = True
            elif not typed and self.is_type_here():
                kids.append(self.type_name("type"))
                typed = True
            elif not typed and not self.CPP and t.type == "word" and self.peek().type == "word" and self.peek(2).type == "word":
                kids.append(self.leaf("ERROR"))  # a macro in front
            else:
                break
        return kids if typed else (kids or None)

    def is_type_here(self) -> bool:
        """Whether the word in front of us is a type, by what follows it: a declarator."""
        save = self.i
        try:
            self.type_name()
            t = self.t
            if t.type == "word":
                return t.text not in ("and", "or", "not") or True
            if t.text in ("*", "&", "&&"):
                i = self.i
                while self.toks[i].text in ("*", "&", "&&", "const", "volatile", "restrict"):
                    i += 1
                return self.toks[i].type == "word" and (self.toks[i + 1].text in (";", "=", ",", ")", "[", "(", "{", ":", "::") or self.toks[i + 1].type == "word") or self.toks[i].text in (")", ",", ">", "(")
            return self.in_parameters and t.text in (",", ")", "=", "[", "...", ">") or t.text == "(" and self.peek().text in ("*", "&", "^") and self.peek(2).type == "word"
        finally:
            self.i = save

    in_parameters = False

    def type_name(self, field: str | None = None) -> Node:
        return self.leaf("type_identifier", field)

    def record(self) -> Node:
        start = self.t.start
        word = self.next().text
        kids: list[Node] = []
        while self.at("__attribute__", "alignas", "__declspec"):
            self.next()
            if self.at("("):
                self.skip_brackets()
        if self.CPP and word == "enum":
            self.eat("class", "struct")
        if self.t.type == "word" and self.t.text not in ("final",):
            kids.append(self.type_name("name"))
        self.eat("final")
        if self.at(":") and self.CPP:
            at = self.next().start
            bases = []
            while not self.end() and not self.at("{", ";"):
                if self.t.type == "word" and self.t.text not in ACCESS and self.t.text != "virtual" or self.at("::"):
                    bases.append(self.type_name())
                else:
                    self.next()
            if word != "enum":
                kids.append(self.node("base_class_clause", at, bases))
            else:
                kids += [self.tag(b, "base") for b in bases]
        if self.at("{"):
            if word == "enum":
                kids.append(self.block_of("enumerator_list", self.enumerator, "body"))
            else:
                kids.append(self.block("field_declaration_list", self.member, "body"))
        return self.node({"struct": "struct_specifier", "union": "union_specifier", "enum": "enum_specifier", "class": "class_specifier"}[word], start, kids)

    def block_of(self, kind: str, item, field: str | None = None) -> Node:
        start = self.next().start
        return self.node(kind, start, self.many("}", item), field)

    def enumerator(self) -> Node:
        start = self.t.start
        kids = [self.leaf("identifier", "name")]
        if self.eat("="):
            kids.append(self.expression(1, "value"))
        return self.node("enumerator", start, kids)

    def member(self) -> Node | None:
        if self.at("#") and self.t.after_line:
            return self.directive()
        if self.eat(";"):
            return None
        if self.CPP and self.t.text in ACCESS and self.peek().text == ":":
            start = self.next().start
            self.next()
            return Node("access_specifier", start, self.back() - 1)
        if self.CPP:
            x = self.cpp_external()
            if x is not None:
                return x
        return self.declaration(member=True)

    def declaration(self, member: bool = False, local: bool = False) -> Node | None:
        start = self.t.start
        kids = self.specifiers()
        bare = kids is None or not any(k.field == "type" for k in kids)
        if kids is None:
            kids = []
        if bare and not self.constructor_here(member):
            if kids:
                pass
            else:
                return self.statement() if not member else None
        record = any(k.kind in ("struct_specifier", "class_specifier", "union_specifier", "enum_specifier") for k in kids)
        if self.at(";") and record:
            self.next()
            only = [k for k in kids if k.kind.endswith("_specifier") and k.kind not in ("storage_class_specifier", "attribute_specifier", "sized_type_specifier")]
            if len(kids) == 1 and only and not member:
                only[0].field = None
                return only[0]
            if member and len(kids) == 1:
                return Node("field_declaration", start, self.back(), kids)
            return Node("declaration", start, self.back(), kids)
        typedef = any(k.kind == "storage_class_specifier" and k.text(self.source) == "typedef" for k in kids)
        while not self.end():
            before = self.i
            d = self.declarator(member, typedef)
            if d is None:
                break
            if self.function_here(d):
                return self.definition(start, kids, d)
            if self.at(":") and member:  # a bit field
                self.next()
                kids.append(self.tag(d, "declarator"))
                kids.append(Node("bitfield_clause", self.t.start, self.t.end, [x] if (x := self.expression(1)) else []))
            elif self.at("=") or self.at("{") and self.CPP or self.at("(") and self.CPP and not member:
                at = d.start
                if self.eat("="):
                    if self.at("default", "delete") and self.peek().text == ";":
                        kids.append(self.tag(d, "declarator"))
                        self.next()
                        continue
                    value = self.initializer()
                elif self.at("{"):
                    value = self.initializer()
                else:
                    value = self.arguments("argument_list", "value")
                if member:
                    kids += [self.tag(d, "declarator"), self.tag(value, "default_value")]
                else:
                    kids.append(self.node("init_declarator", at, [self.tag(d, "declarator"), self.tag(value, "value")], "declarator"))
            else:
                kids.append(self.tag(d, "declarator"))
            if not self.eat(",") or self.i == before:
                break
        if not self.eat(";") and not local:
            self.recover()
        kind = "type_definition" if typedef else "field_declaration" if member and not bare else "declaration"
        return self.node(kind, start, kids)

    def recover(self) -> None:
        """To the end of a declaration that could not be read."""
        while not self.end() and not self.at(";", "}", "{") and not (self.at("#") and self.t.after_line):
            if self.at("(", "["):
                self.skip_brackets()
            else:
                self.next()
        if self.at("{"):
            return
        self.eat(";")

    def constructor_here(self, member: bool) -> bool:
        """A declarator without a type: ``main() {``, ``Buffer(int) {``, ``~Buffer();``, ``A::A() {``."""
        i = self.i
        if self.CPP and self.toks[i].text == "operator":
            return True
        if self.CPP and self.toks[i].text == "~":
            i += 1
        if self.toks[i].type != "word" or self.toks[i].text in NOT_TYPE:
            return False
        i += 1
        while self.CPP and self.toks[i].text == "::":
            i += 1 + (self.toks[i + 1].text == "~")
            if self.toks[i].text == "operator":
                return True
            i += 1
        if self.toks[i].text != "(":
            return False
        close = self.closing(i)
        after = self.toks[min(close + 1, len(self.toks) - 1)]
        if after.text in ("{", ":") or after.text in ("const", "noexcept", "override", "final", "try"):
            return after.text != ":" or self.CPP
        return member and after.text in (";", "=")

    def function_here(self, d: Node) -> bool:
        if not self.is_function(d):
            return False
        if self.at("{"):
            return True
        if self.CPP:
            return self.at(":", "try") or self.at("=") and self.peek().text in ("default", "delete") and self.peek(2).text == ";"
        # an old definition declares its parameters in front of its body
        return False

    def is_function(self, d: Node | None) -> bool:
        while d is not None:
            if d.kind == "function_declarator":
                return True
            d = d.get("declarator") or (d.kids[-1] if d.kind == "reference_declarator" and d.kids else None)
        return False

    def definition(self, start: int, kids: list[Node], d: Node) -> Node:
        kids = [*kids, self.tag(d, "declarator")]
        if self.at("="):
            at = self.next().start
            word = self.next().text
            self.eat(";")
            return self.node("function_definition", start, [*kids, Node("default_method_clause" if word == "default" else "delete_method_clause", at, self.back())])
        self.eat("try")
        if self.at(":"):
            at = self.next().start
            inits = []
            while not self.end() and not self.at("{", ";"):
                s = self.t.start
                name = self.leaf("field_identifier")
                while self.at("::", "<"):
                    self.skip_angles() if self.at("<") else (self.next(), self.next())
                values = self.arguments("argument_list") if self.at("(") else self.initializer() if self.at("{") else None
                if values is not None:
                    values.field = None
                inits.append(self.node("field_initializer", s, [name, values]))
                if not self.eat(","):
                    break
            kids.append(self.node("field_initializer_list", at, inits))
        if self.at("{"):
            kids.append(self.tag(self.compound(), "body"))
        return self.node("function_definition", start, kids)

    def skip_angles(self) -> None:
        depth = 0
        while not self.end():
            t = self.next().text
            depth += (t == "<") - (t == ">") - 2 * (t == ">>")
            if depth <= 0 or self.at(";", "{"):
                return

    def declarator(self, member: bool = False, typedef: bool = False) -> Node | None:
        start = self.t.start
        if self.at("*", "^"):
            self.next()
            kids = []
            while self.t.text in ("const", "volatile", "restrict", "__restrict", "_Nonnull", "_Nullable"):
                kids.append(self.leaf("type_qualifier"))
            inner = self.declarator(member, typedef)
            return self.node("pointer_declarator", start, [*kids, self.tag(inner, "declarator")])
        if self.CPP and self.at("&", "&&"):
            self.next()
            inner = self.declarator(member, typedef)
            return self.node("reference_declarator", start, [inner])
        if self.at("("):
            self.next()
            inner = self.declarator(member, typedef)
            self.eat(")")
            d = self.node("parenthesized_declarator", start, [inner])
        elif self.at("...") and self.CPP:
            self.next()
            inner = self.declarator(member, typedef)
            return self.node("variadic_declarator", start, [inner])
        else:
            d = self.declared_name("type_identifier" if typedef else "field_identifier" if member else "identifier")
            if d is None:
                if self.in_parameters and self.at("[", "("):
                    d = None
                else:
                    return None
        while True:
            if self.at("("):
                if not self.parameters_here():
                    return d
                params = self.parameters()
                kids = [self.tag(d, "declarator"), params]
                while self.t.text in ("const", "volatile", "noexcept", "override", "final", "__attribute__", "throw") or self.at("->") or self.at("&", "&&") and self.peek().text in ("{", ";"):
                    at = self.t.start
                    if self.eat("->"):
                        self.type_name()
                        while self.at("*", "&", "const"):
                            self.next()
                        kids.append(Node("trailing_return_type", at, self.back()))
                        continue
                    word = self.next().text
                    if self.at("(") and word in ("noexcept", "__attribute__", "throw"):
                        self.skip_brackets()
                    kids.append(Node({"const": "type_qualifier", "volatile": "type_qualifier", "noexcept": "noexcept", "override": "virtual_specifier", "final": "virtual_specifier"}.get(word, "attribute_specifier"), at, self.back()))
                d = self.node("function_declarator", start, kids)
            elif self.at("["):
                self.next()
                size = self.many("]", self.expression)
                d = self.node("array_declarator", start, [self.tag(d, "declarator"), *[self.tag(s, "size") for s in size[:1]]])
            else:
                return d

    def declared_name(self, kind: str) -> Node | None:
        t = self.t
        if t.type == "word" and t.text not in NOT_TYPE:
            return self.leaf(kind)
        return None

    def parameters_here(self) -> bool:
        """Whether the bracket after a declared name holds parameters, and not a constructor's arguments."""
        if not self.CPP:
            return True
        first, second = self.peek(), self.peek(2)
        if first.text in (")", "...", "const", "struct", "class", "enum", "unsigned") or first.text in PRIMITIVE or first.text in QUALIFIER or first.text == "::":
            return True
        if first.type != "word" or first.text in ("this", "true", "false", "nullptr", "new"):
            return False
        close = self.toks[min(self.closing(self.i) + 1, len(self.toks) - 1)]
        if close.text in ("{", ":", "const", "noexcept", "override", "final", "->"):
            return True
        return second.type == "word" or second.text in ("*", "&", "&&") and (self.peek(3).type == "word" and self.peek(4).text in (",", ")", "=") or self.peek(3).text in (")", ",")) or second.text in ("::", "<") and self.peek(4).type == "word" or self.in_member and second.text in (",", ")")

    in_member = False

    def parameters(self) -> Node:
        start = self.next().start
        save, self.in_parameters = self.in_parameters, True
        kids = self.many(")", self.parameter)
        self.in_parameters = save
        return self.node("parameter_list", start, kids, "parameters")

    def parameter(self) -> Node | None:
        start = self.t.start
        if self.at("..."):
            return self.leaf("variadic_parameter")
        kids = self.specifiers()
        if kids is None:
            # an old parameter without a type, or something else
            x = self.leaf("identifier") if self.t.type == "word" else None
            if x is None:
                self.next()
            return x
        d = self.declarator() if not self.at(",", ")", "=") else None
        kind = "parameter_declaration"
        if self.eat("="):
            value = self.expression(1, "default_value")
            return self.node("optional_parameter_declaration", start, [*kids, self.tag(d, "declarator"), value])
        return self.node(kind, start, [*kids, self.tag(d, "declarator")])

    def initializer(self) -> Node | None:
        if self.at("{"):
            start = self.next().start
            return self.node("initializer_list", start, self.many("}", self.initial))
        return self.expression(1)

    def initial(self) -> Node | None:
        start = self.t.start
        if self.at(".") and self.peek().type == "word":
            self.next()
            at = self.back() - 1
            field = Node("field_designator", at, self.t.end, [Node("field_identifier", self.t.start, self.t.end)], "designator")
            self.next()
            self.eat("=")
            return self.node("initializer_pair", start, [field, self.tag(self.initializer(), "value")])
        if self.at("["):
            self.skip_brackets()
            self.eat("=")
        return self.initializer()

    # ---- statements

    def compound(self) -> Node:
        return self.block("compound_statement", self.statement)

    def condition(self) -> Node | None:
        if not self.at("("):
            return None
        start = self.next().start
        if not self.CPP:
            return self.node("parenthesized_expression", start, self.many(")", self.expression, (",", ";")), "condition")

        def part() -> Node | None:
            if self.declaration_here():
                return self.declaration(local=True)
            return self.expression(0, "value")

        return self.node("condition_clause", start, self.many(")", part, (",", ";")), "condition")

    def statement(self) -> Node | None:
        t, start = self.t, self.t.start
        if self.at("#") and t.after_line:
            return self.directive()
        if self.at("{"):
            return self.compound()
        if self.eat(";"):
            return Node("expression_statement", start, self.back())
        if t.type == "word":
            if t.text in ("if", "while", "switch"):
                self.next()
                self.eat("constexpr")
                kids = [self.condition()]
                if t.text == "if":
                    kids.append(self.tag(self.statement(), "consequence"))
                    if self.at("else"):
                        at = self.next().start
                        kids.append(self.node("else_clause", at, [self.statement()], "alternative"))
                else:
                    kids.append(self.tag(self.statement(), "body"))
                return self.node(t.text + "_statement", start, kids)
            if t.text == "do":
                self.next()
                kids = [self.tag(self.statement(), "body")]
                if self.eat("while"):
                    kids.append(self.parenthesized(field="condition") if self.at("(") else None)
                self.eat(";")
                return self.node("do_statement", start, kids)
            if t.text == "for":
                return self.for_statement(start)
            if t.text in ("return", "co_return"):
                self.next()
                x = self.initializer() if not self.at(";") else None
                x = self.comma(x)
                self.eat(";")
                return self.node("return_statement", start, [x])
            if t.text in ("break", "continue"):
                self.next()
                self.eat(";")
                return self.node(t.text + "_statement", start, [])
            if t.text == "goto":
                self.next()
                label = self.leaf("statement_identifier", "label") if self.t.type == "word" else None
                self.eat(";")
                return self.node("goto_statement", start, [label])
            if t.text in ("case", "default") and not (t.text == "default" and self.peek().text != ":"):
                self.next()
                kids = [self.expression(1, "value")] if t.text == "case" else []
                self.eat(":")
                while not self.end() and not self.at("case", "default", "}"):
                    before = self.i
                    kids.append(self.statement())
                    if self.i == before:
                        kids.append(self.error())
                return self.node("case_statement", start, kids)
            if t.text == "else":
                self.next()
                return self.statement()
            if self.CPP:
                x = self.cpp_statement(start)
                if x is not None:
                    return x
            if self.peek().text == ":" and self.peek(2).text != ":" and t.text not in ACCESS:
                label = self.leaf("statement_identifier", "label")
                self.next()
                return self.node("labeled_statement", start, [label, self.statement() if not self.at("}") else None])
            if self.declaration_here():
                return self.declaration()
        elif self.CPP and self.at("[") and self.peek().text == "[":
            self.skip_brackets()
            return self.statement()
        return self.expression_statement(start)

    def expression_statement(self, start: int) -> Node | None:
        x = self.comma(self.expression())
        if x is None and not self.at(";"):
            return None
        if not self.eat(";"):
            self.recover_statement()
        return self.node("expression_statement", start, [x])

    def recover_statement(self) -> None:
        while not self.end() and not self.at(";", "}", "{") and not self.t.after_line:
            self.skip_brackets() if self.at("(", "[") else self.next()
        self.eat(";")

    def comma(self, x: Node | None) -> Node | None:
        while x is not None and self.at(","):
            self.next()
            x = self.node("comma_expression", x.start, [self.tag(x, "left"), self.expression(1, "right")])
        return x

    def for_statement(self, start: int) -> Node:
        self.next()
        kids: list[Node | None] = []
        kind = "for_statement"
        if self.eat("("):
            if self.declaration_here():
                at = self.t.start
                if self.CPP and (x := self.range_loop()) is not None:
                    kind, kids = "for_range_loop", x
                else:
                    del at
                    kids.append(self.tag(self.declaration(local=True), "initializer"))
                    if self.toks[self.i - 1].text != ";":
                        self.eat(";")
            elif not self.at(";"):
                kids.append(self.tag(self.comma(self.expression()), "initializer"))
                self.eat(";")
            else:
                self.next()
            if kind == "for_statement":
                if not self.at(";"):
                    kids.append(self.tag(self.comma(self.expression()), "condition"))
                self.eat(";")
                if not self.at(")"):
                    kids.append(self.tag(self.comma(self.expression()), "update"))
            while not self.end() and not self.at(")", "{", ";"):
                self.next()
            self.eat(")")
        kids.append(self.tag(self.statement(), "body"))
        return self.node(kind, start, kids)

    def range_loop(self) -> list[Node | None] | None:
        return None

    def declaration_here(self) -> bool:
        t = self.t
        if t.type != "word" or t.text in NOT_TYPE:
            return self.CPP and self.at("::") and self.is_type_here()
        if t.text in PRIMITIVE or t.text in QUALIFIER or t.text in ("struct", "union", "enum", "class", "typename", "decltype", "__attribute__"):
            return not (t.text in PRIMITIVE and self.peek().text in ("(", "{", "::"))
        return self.is_type_here()

    def cpp_statement(self, start: int) -> Node | None:
        return None

    # ---- expressions

    def string(self, field: str | None = None) -> Node:
        t = self.next()
        kind = "raw_string_literal" if self.CPP and 'R"' in t.text[:4] else "string_literal"
        q = t.text.find('"') + 1
        inner = [Node("string_content", t.start + q, t.end - 1)] if len(t.text) - q > 1 else []
        return Node(kind, t.start, t.end, inner, field)

    def cast_here(self) -> bool:
        """``(type)`` in front of an operand."""
        close = self.closing(self.i)
        inside = self.toks[self.i + 1 : close]
        if not inside or any(x.type not in ("word", "op") or x.type == "op" and x.text not in ("*", "&", "::", "<", ">", ",", "[", "]") for x in inside):
            return False
        first = inside[0].text
        sure = first in PRIMITIVE or first in ("const", "struct", "enum", "union", "unsigned", "volatile") or inside[-1].text == "*" and inside[0].type == "word"
        after = self.toks[min(close + 1, len(self.toks) - 1)]
        operand = after.type in ("word", "number", "string", "char") or after.text in ("(", "~", "!", "{") or sure and after.text in ("*", "&", "-", "+", "++", "--")
        if not operand or after.text in ("and", "or", "else"):
            return False
        if sure:
            return True
        return all(x.type == "word" or x.text in ("::", "<", ">") for x in inside) and after.type in ("word", "number", "string", "char") and inside[-1].type == "word" and len([x for x in inside if x.type == "word"]) == 1

    def type_descriptor(self, close: int, field: str) -> Node:
        start = self.t.start
        save, self.in_parameters = self.in_parameters, True
        kids = self.specifiers() or []
        at = self.t.start
        d = None
        if self.i < close and self.at("*", "&", "&&"):
            self.i = close
            d = Node("abstract_pointer_declarator", at, self.back(), None, "declarator")
        self.in_parameters = save
        self.i = max(self.i, close)
        return Node("type_descriptor", start, max(start, self.toks[close].start), [k for k in [*kids, d] if k is not None], field)

    def prefix(self) -> Node | None:
        start = self.t.start
        if self.at("(") and self.cast_here():
            close = self.closing(self.i)
            self.next()
            kind = self.type_descriptor(close, "type")
            self.i = close + 1
            if self.at("{"):
                return self.suffixes(self.node("compound_literal_expression", start, [kind, self.tag(self.initializer(), "value")]), start)
            return self.node("cast_expression", start, [kind, self.expression(13, "value")])
        return super().prefix()

    def primary(self) -> Node | None:
        t, start = self.t, self.t.start
        if t.type == "number":
            return self.leaf("number_literal")
        if t.type == "char":
            t = self.next()
            q = t.text.find("'") + 1
            return Node("char_literal", t.start, t.end, [Node("character", t.start + q, t.end - 1)] if t.end - 1 > t.start + q else [])
        if t.type == "string":
            first = self.string()
            if self.t.type != "string":
                return first
            parts = [first]
            while self.t.type == "string":
                parts.append(self.string())
            return self.node("concatenated_string", start, parts)
        if t.type == "word":
            if t.text in ("true", "false"):
                return self.leaf(t.text)
            if t.text in ("NULL", "nullptr"):
                return self.leaf("null")
            if t.text in ("sizeof", "alignof", "_Alignof", "offsetof"):
                self.next()
                if self.at("("):
                    close = self.closing(self.i)
                    after = self.peek()
                    if after.text in PRIMITIVE or after.text in ("struct", "const", "unsigned", "enum", "union") or self.toks[close - 1].text == "*":
                        self.next()
                        kind = self.type_descriptor(close, "type")
                        self.i = close + 1
                        return self.node("sizeof_expression", start, [kind])
                return self.node("sizeof_expression", start, [self.expression(13, "value")])
            if self.CPP:
                x = self.cpp_primary(start)
                if x is not None:
                    return x
            if t.text in STATEMENT or t.text in QUALIFIER or t.text in ("struct", "union", "enum"):
                return None
            if t.text in PRIMITIVE and not self.CPP:
                return self.leaf("identifier")
            return self.leaf("identifier")
        if self.at("("):
            self.next()
            if self.at("{"):
                body = self.compound()
                self.eat(")")
                return self.node("parenthesized_expression", start, [body])
            x = self.comma(self.expression())
            kids = [x, *self.many(")", self.expression, (",", ";"))]
            return self.node("parenthesized_expression", start, kids)
        if self.CPP:
            return self.cpp_primary(start)
        return None

    def cpp_primary(self, start: int) -> Node | None:
        return None

    def postfix(self, left: Node, start: int) -> Node | None:
        if self.at("("):
            args = self.arguments("argument_list")
            return self.node("call_expression", start, [self.tag(left, "function"), args])
        if self.at("["):
            self.next()
            kids = self.many("]", self.expression)
            if self.CPP:
                index = [Node("subscript_argument_list", kids[0].start - 1, self.back(), kids, "indices")] if kids else []
            else:
                index = [self.tag(k, "index") for k in kids]
            return self.node("subscript_expression", start, [self.tag(left, "argument"), *index])
        if self.at(".", "->"):
            self.next()
            self.eat("template")
            if self.at("~"):
                self.next()
            field = self.leaf("field_identifier", "field") if self.t.type == "word" else None
            if self.CPP and field is not None and self.at("<") and (args := self.template_arguments()) is not None:
                field.field = "name"
                field = self.node("template_method", field.start, [field, args], "field")
            return self.node("field_expression", start, [self.tag(left, "argument"), field])
        if self.at("++", "--"):
            self.next()
            return self.node("update_expression", start, [self.tag(left, "argument")])
        if self.CPP and self.at("{") and left.kind in ("qualified_identifier", "template_function", "identifier") and self.brace_value_here(left):
            value = self.tag(self.initializer(), "value")
            return self.node("compound_literal_expression", start, [self.tag(left, "type"), value])
        return None

    def brace_value_here(self, left: Node) -> bool:
        return False

    def template_arguments(self) -> Node | None:
        return None

    def tail(self, left: Node, start: int, power: int) -> Node:
        if power > 1:
            return left
        if self.at("?"):
            self.next()
            yes = self.expression(0, "consequence") if not self.at(":") else None
            self.eat(":")
            return self.node("conditional_expression", start, [self.tag(left, "condition"), yes, self.expression(1, "alternative")])
        if self.t.type == "op" and self.t.text in ASSIGN:
            self.next()
            right = self.tag(self.initializer(), "right") if self.at("{") else self.expression(1, "right")
            return self.node("assignment_expression", start, [self.tag(left, "left"), right])
        return left


class Cpp(C):
    CPP = True

    # ---- names

    def angles_end(self, i: int) -> int | None:
        """Number of the token after template arguments that open at token i, if they look like such."""
        depth, n = 0, len(self.toks)
        for j in range(i, min(i + 200, n)):
            t = self.toks[j]
            if t.type == "op":
                if t.text == "<":
                    depth += 1
                elif t.text in (">", ">>"):
                    depth -= len(t.text)
                    if depth <= 0:
                        return j + 1
                elif t.text in (";", "{", "}", "&&", "||", "==", "!=", "=", "+=", "?"):
                    return None
        return None

    def template_arguments(self) -> Node | None:
        end = self.angles_end(self.i)
        if end is None:
            return None
        start = self.next().start
        kids = []
        save, self.in_parameters = self.in_parameters, True
        while self.i < end - 1:
            before = self.i
            at = self.t.start
            if self.t.type == "word" and self.t.text not in ("true", "false"):
                inner = self.specifiers() or []
                while self.i < end - 1 and not self.at(","):
                    self.skip_brackets() if self.at("(", "[") else self.next()
                kids.append(self.node("type_descriptor", at, inner))
            elif not self.at(","):
                x = self.primary()
                if x:
                    kids.append(x)
            self.eat(",")
            if self.i == before:
                self.next()
        self.in_parameters = save
        self.i = end
        return self.node("template_argument_list", start, kids, "arguments")

    def type_name(self, field: str | None = None) -> Node:
        start = self.t.start
        self.eat("typename")
        parts: list[Node] = []
        first = self.eat("::")
        if self.t.text == "auto":
            return self.node("placeholder_type_specifier", start, [self.leaf("auto")], field)
        while self.t.type == "word":
            x = self.leaf("type_identifier")
            if self.at("<") and (args := self.template_arguments()) is not None:
                x.field = "name"
                x = self.node("template_type", x.start, [x, args])
            parts.append(x)
            if self.at("::") and self.peek().type == "word" and self.peek().text != "operator":
                self.next()
            else:
                break
        if not parts:
            return self.node("type_identifier", start, [], field)
        return self.tag(self.qualified(parts, start, first), field) if field else self.qualified(parts, start, first)

    def qualified(self, parts: list[Node], start: int, rooted: bool = False) -> Node:
        """``a::b::c`` nests to the right, scopes being namespace names."""
        if len(parts) == 1 and not rooted:
            return parts[0]
        out = self.tag(parts[-1], "name")
        for i in range(len(parts) - 2, -1, -1):
            scope = parts[i]
            if scope.kind in ("type_identifier", "identifier"):
                scope.kind = "namespace_identifier"
            out = Node("qualified_identifier", start if i == 0 else scope.start, out.end, [self.tag(scope, "scope"), out], "name")
        if rooted:
            out = Node("qualified_identifier", start, out.end, [self.tag(out, "name")])
        out.field = None
        return out

    def declared_name(self, kind: str) -> Node | None:
        start = self.t.start
        if self.at("[") and self.peek().text != "[" and not self.in_parameters:
            self.skip_brackets()
            return Node("structured_binding_declarator", start, self.back())
        parts: list[Node] = []
        rooted = self.eat("::")
        while True:
            at = self.t.start
            if self.at("operator"):
                self.next()
                if self.at("(") and self.peek().text == ")":
                    self.next()
                    self.next()
                else:
                    while not self.end() and not self.at("(", ";"):
                        self.skip_brackets() if self.at("[") else self.next()
                parts.append(Node("operator_name", at, self.back()))
                break
            if self.at("~"):
                self.next()
                inner = self.leaf("identifier")
                parts.append(self.node("destructor_name", at, [inner]))
                break
            if self.t.type != "word" or self.t.text in NOT_TYPE:
                break
            x = self.leaf("identifier")
            if self.at("<") and (args := self.template_arguments()) is not None:
                x.field = "name"
                x = self.node("template_function", at, [x, args])
            parts.append(x)
            if self.at("::"):
                self.next()
            else:
                break
        if not parts:
            return None
        if len(parts) == 1 and not rooted:
            x = parts[0]
            # a constructor has an identifier, other members a field_identifier
            if x.kind == "identifier" and kind == "field_identifier" and not (self.at("(") and self.untyped):
                x.kind = kind
            elif x.kind == "identifier" and kind == "type_identifier":
                x.kind = kind
            return x
        return self.qualified(parts, start, rooted)

    untyped = False

    def declaration(self, member: bool = False, local: bool = False) -> Node | None:
        save, kept = self.untyped, self.in_member
        self.untyped, self.in_member = self.constructor_here(member), member
        try:
            return super().declaration(member, local)
        finally:
            self.untyped, self.in_member = save, kept

    def specifiers(self) -> list[Node] | None:
        if self.untyped and not self.in_parameters:
            self.untyped_specifiers = True
            kids = []
            while self.t.text in QUALIFIER:
                kids.append(self.leaf("type_qualifier"))
            return kids or None
        kids = super().specifiers()
        return kids

    def constructor_here(self, member: bool) -> bool:
        save = self.i
        while self.t.text in ("explicit", "inline", "constexpr", "virtual", "friend", "static"):
            self.next()
        out = super().constructor_here(member)
        self.i = save
        return out

    # ---- declarations

    def cpp_external(self) -> Node | None:
        t, start = self.t, self.t.start
        if t.text == "inline" and self.peek().text == "namespace":
            self.next()
        if self.at("namespace"):
            self.next()
            if self.t.type == "word" and self.peek().text == "=":
                self.recover()
                return self.node("namespace_alias_definition", start, [])
            parts = []
            while self.t.type == "word":
                parts.append(self.leaf("namespace_identifier"))
                if not self.eat("::"):
                    break
            name = parts[0] if len(parts) == 1 else Node("nested_namespace_specifier", parts[0].start, parts[-1].end, parts) if parts else None
            body = self.block("declaration_list", self.external, "body") if self.at("{") else None
            return self.node("namespace_definition", start, [self.tag(name, "name"), body])
        if self.at("using"):
            self.next()
            kind = "using_declaration"
            kids: list[Node | None] = []
            if self.t.type == "word" and self.peek().text == "=":
                kind = "alias_declaration"
                kids = [self.leaf("type_identifier", "name")]
                self.next()
                at = self.t.start
                kids.append(self.node("type_descriptor", at, self.specifiers() or [], "type"))
            else:
                self.eat("namespace")
                x = self.type_name()
                if x.kind == "type_identifier":
                    x.kind = "identifier"
                kids = [x]
            while not self.end() and not self.eat(";"):
                self.next()
            return self.node(kind, start, kids)
        if self.at("template"):
            self.next()
            params = None
            if self.at("<"):
                at, i = self.t.start, self.i
                self.skip_angles()
                names = [Node("type_parameter_declaration", a.start, b.end, [Node("type_identifier", b.start, b.end)]) for a, b in zip(self.toks[i : self.i], self.toks[i + 1 : self.i]) if a.text in ("typename", "class") and b.type == "word"]
                params = self.node("template_parameter_list", at, names, "parameters")
            if self.at("requires"):
                self.next()
                self.expression(1)
            return self.node("template_declaration", start, [params, self.external()])
        if self.at("static_assert"):
            self.next()
            if self.at("("):
                self.skip_brackets()
            self.eat(";")
            return self.node("static_assert_declaration", start, [])
        if self.at("friend"):
            self.next()
            return self.node("friend_declaration", start, [self.external()])
        if self.at("concept"):
            self.recover()
            return self.node("concept_definition", start, [])
        return None

    def range_loop(self) -> list[Node | None] | None:
        save = self.i
        kids = self.specifiers() or []
        d = self.declarator()
        if d is not None and self.at(":"):
            self.next()
            return [*kids, self.tag(d, "declarator"), self.tag(self.initializer(), "right")]
        self.i = save
        return None

    def cpp_statement(self, start: int) -> Node | None:
        t = self.t
        if t.text == "try":
            self.next()
            kids = [self.tag(self.compound(), "body")] if self.at("{") else []
            while self.at("catch"):
                at = self.next().start
                params = self.parameters() if self.at("(") else None
                kids.append(self.node("catch_clause", at, [params, self.tag(self.compound(), "body") if self.at("{") else None]))
            return self.node("try_statement", start, kids)
        if t.text == "throw":
            self.next()
            x = self.expression() if not self.at(";") else None
            self.eat(";")
            return self.node("throw_statement", start, [x])
        if t.text in ("using", "template", "static_assert", "namespace"):
            return self.cpp_external()
        return None

    # ---- expressions

    def cpp_primary(self, start: int) -> Node | None:
        t = self.t
        if t.text == "this":
            return self.leaf("this")
        if t.text == "new":
            self.next()
            if self.at("("):
                self.skip_brackets()
            kind = self.type_name("type") if self.t.type == "word" and self.t.text not in PRIMITIVE else self.leaf("primitive_type", "type") if self.t.type == "word" else None
            while self.at("*"):
                self.next()
            size = None
            if self.at("["):
                at = self.next().start
                size = self.node("new_declarator", at, self.many("]", self.expression), "declarator")
            args = self.arguments("argument_list") if self.at("(") else self.tag(self.initializer(), "arguments") if self.at("{") else None
            return self.node("new_expression", start, [kind, size, args])
        if t.text == "delete":
            self.next()
            if self.at("["):
                self.skip_brackets()
            return self.node("delete_expression", start, [self.expression(13)])
        if t.text == "throw":
            self.next()
            return self.node("throw_expression", start, [self.expression(1)])
        if t.text in ("co_await", "co_yield"):
            self.next()
            return self.node("co_await_expression", start, [self.expression(13, "argument")])
        if self.at("["):
            return self.lambda_()
        if t.type == "word" and t.text not in STATEMENT and t.text not in ("struct", "class", "union", "enum") and (t.text not in QUALIFIER) or self.at("::") and self.peek().type == "word":
            if t.text in PRIMITIVE and self.peek().text not in ("(", "{", "::"):
                return None
            parts = []
            rooted = self.eat("::")
            while self.t.type == "word" or self.at("~"):
                if self.at("operator"):
                    at = self.next().start
                    while not self.end() and not self.at("(", ";", ")"):
                        self.next()
                    parts.append(Node("operator_name", at, self.back()))
                    break
                self.eat("template")
                if self.at("~"):
                    self.next()
                x = self.leaf("primitive_type" if self.t.text in PRIMITIVE else "identifier")
                if self.at("<") and (end := self.angles_end(self.i)) is not None and (self.toks[end].text in ("(", "::", "{", ")", ",", ";") or x.text(self.source).endswith("_cast")):
                    args = self.template_arguments()
                    x.field = "name"
                    x = self.node("template_function", x.start, [x, args])
                parts.append(x)
                if self.at("::") and (self.peek().type == "word" or self.peek().text == "~"):
                    self.next()
                else:
                    break
            return self.qualified(parts, start, rooted) if parts else None
        return None

    def brace_value_here(self, left: Node) -> bool:
        name = left.text(self.source)
        return not self.no_braces and (left.kind != "identifier" or name[:1].isupper()) and self.toks[self.i - 1].end == self.t.start

    no_braces = False

    def lambda_(self) -> Node:
        start = self.t.start
        self.skip_brackets()
        captures = Node("lambda_capture_specifier", start, self.back(), None, "captures")
        d = None
        if self.at("("):
            at = self.t.start
            d = self.node("abstract_function_declarator", at, [self.parameters()], "declarator")
        while not self.end() and not self.at("{", ";", ")", ","):
            self.next()
        body = self.tag(self.compound(), "body") if self.at("{") else None
        return self.node("lambda_expression", start, [captures, d, body])
