"""Languages, their file extensions, and the concrete nodes that abstract types stand for."""

from __future__ import annotations

from dataclasses import dataclass

LANGUAGES = ("c", "cpp", "javascript", "python", "rust", "go")
# Names, extensions and node kinds of the six grammars.
ALIASES = {"c": "c", "cpp": "cpp", "c++": "cpp", "javascript": "javascript", "js": "javascript", "python": "python", "py": "python", "rust": "rust", "rs": "rust", "go": "go"}
EXTENSIONS = {
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "py": "python", "rs": "rust", "go": "go",
}


def canonical(lang: str) -> str:
    """The language's name; ValueError for an unknown one."""
    try:
        return ALIASES[lang]
    except KeyError:
        raise ValueError(f"unknown language {lang!r}; known: {', '.join(sorted(ALIASES))}") from None


def extensions(lang: str | None = None) -> frozenset[str]:
    """Extensions of files to look for: all known ones, or a language's. Headers (.h) are C unless C++ is asked for."""
    if lang is None:
        return frozenset(EXTENSIONS)
    lang = canonical(lang)
    own = {e for e, x in EXTENSIONS.items() if x == lang}
    return frozenset(own | {"h"} if lang == "cpp" else own)


def detect(path: str) -> str | None:
    """Language by the file's extension."""
    name = path.rpartition("/")[2]
    return EXTENSIONS.get(name.rpartition(".")[2]) if "." in name.lstrip(".") or name.count(".") else None


@dataclass(frozen=True)
class Variant:
    """A concrete node that an abstract type stands for in a language.

    ``name``: steps (field, kind) from the node to the one that holds its name; () if the node is its
    own name; None if it has no name that can be reached. ``params`` and ``body``: field and kind of
    the container; ``bridge``: the parameters hang on some child of the node. ``needs``: a child
    (field, kind) that it must have where no name is asked for.
    """

    kind: str
    name: tuple[tuple[str, str], ...] | None = ()
    params: tuple[str, str] | None = None
    bridge: bool = False
    body: tuple[str, str] | None = None
    needs: tuple[str, str] | None = None


def _own(*kinds: str) -> list[Variant]:
    return [Variant(k) for k in kinds]


def _named(kind: str, field: str, name: str, **more) -> Variant:
    return Variant(kind, ((field, name),), **more)


_C_ARGS, _JS_ARGS = ("arguments", "argument_list"), ("arguments", "arguments")
_C_BODY = ("body", "compound_statement")
_C_DEF = Variant("function_definition", (("declarator", "function_declarator"), ("declarator", "identifier")), params=("parameters", "parameter_list"), bridge=True, body=_C_BODY)
_CPP_SCOPED = Variant("function_definition", (("declarator", "function_declarator"), ("declarator", "qualified_identifier"), ("name", "identifier")), params=("parameters", "parameter_list"), bridge=True, body=_C_BODY)
_CPP_PROTOTYPE = Variant("field_declaration", (("declarator", "function_declarator"), ("declarator", "identifier")), needs=("declarator", "function_declarator"))
_C_CALL = _named("call_expression", "function", "identifier", params=_C_ARGS)
_CPP_METHOD_CALL = Variant("call_expression", (("function", "field_expression"), ("field", "field_identifier")), params=_C_ARGS)
_JS = {"params": ("parameters", "formal_parameters"), "body": ("body", "statement_block")}
_GO = {"params": ("parameters", "parameter_list"), "body": ("body", "block")}
_PARAM = _named("parameter_declaration", "declarator", "identifier")

#: Definitions and calls, by language.
FUNCTIONS: dict[str, tuple[list[Variant], list[Variant]]] = {
    "c": ([_C_DEF], [_C_CALL]),
    "cpp": ([_C_DEF, _CPP_SCOPED, _CPP_PROTOTYPE], [_C_CALL, _CPP_METHOD_CALL]),
    "javascript": (
        [_named("function_declaration", "name", "identifier", **_JS), _named("function_expression", "name", "identifier", **_JS), Variant("arrow_function", None, **_JS), _named("method_definition", "name", "property_identifier", **_JS)],
        [_named("call_expression", "function", "identifier", params=_JS_ARGS), Variant("call_expression", (("function", "member_expression"), ("property", "property_identifier")), params=_JS_ARGS)],
    ),
    "python": ([_named("function_definition", "name", "identifier", params=("parameters", "parameters"), body=("body", "block"))], [_named("call", "function", "identifier", params=_C_ARGS)]),
    "rust": ([_named("function_item", "name", "identifier", params=("parameters", "parameters"), body=("body", "block"))], [_named("call_expression", "function", "identifier", params=_JS_ARGS)]),
    "go": (
        [_named("function_declaration", "name", "identifier", **_GO), _named("method_declaration", "name", "field_identifier", **_GO)],
        [_named("call_expression", "function", "identifier", params=_C_ARGS), Variant("call_expression", (("function", "selector_expression"), ("field", "field_identifier")), params=_C_ARGS)],
    ),
}

_FIELDS, _DECLS = ("body", "field_declaration_list"), ("body", "declaration_list")
#: Types other than function. A type that is known but empty here gives no rows.
TYPES: dict[str, dict[str, list[Variant]]] = {
    "c": {
        "id": _own("identifier", "field_identifier"), "var": _own("identifier", "field_identifier"), "param": [_PARAM], "type": _own("type_identifier"), "import": _own("preproc_include"),
        "literal": _own("number_literal", "string_literal", "char_literal"), "block": _own("compound_statement"), "if": _own("if_statement"), "for": _own("for_statement"), "while": _own("while_statement"), "switch": _own("switch_statement"),
    },
    "cpp": {
        "class": [_named("class_specifier", "name", "type_identifier", body=_FIELDS), _named("struct_specifier", "name", "type_identifier", body=_FIELDS)],
        "module": [_named("namespace_definition", "name", "namespace_identifier", body=_DECLS)],
        "id": _own("identifier", "field_identifier"), "var": _own("identifier", "field_identifier"), "param": [_PARAM], "type": _own("type_identifier"), "import": _own("preproc_include"),
        "literal": _own("number_literal", "string_literal", "char_literal", "true", "false"), "block": _own("compound_statement"), "if": _own("if_statement"), "for": _own("for_statement"), "while": _own("while_statement"),
        "switch": _own("switch_statement"), "op": _own("binary_expression"),
    },
    "javascript": {
        "class": [_named("class_declaration", "name", "identifier", body=("body", "class_body"))],
        "id": _own("identifier"), "var": _own("identifier"), "param": _own("identifier"), "type": _own("type_identifier"), "import": _own("import_statement"), "literal": _own("number", "string", "template_string"),
        "block": _own("statement_block"), "if": _own("if_statement"), "for": _own("for_statement"), "while": _own("while_statement"), "switch": _own("switch_statement"), "op": _own("binary_expression"),
    },
    "python": {
        "class": [_named("class_definition", "name", "identifier", body=("body", "block"))],
        "id": _own("identifier"), "var": _own("identifier"), "param": _own("identifier"), "import": _own("import_statement"), "literal": _own("integer", "float", "string"), "block": _own("block"), "if": _own("if_statement"),
        "for": _own("for_statement"), "while": _own("while_statement"),
    },
    "rust": {
        "class": [_named("struct_item", "name", "type_identifier", body=_FIELDS), _named("enum_item", "name", "type_identifier", body=("body", "enum_variant_list")), _named("trait_item", "name", "type_identifier", body=_DECLS)],
        "module": [_named("mod_item", "name", "identifier", body=_DECLS)],
        "id": _own("identifier"), "var": [_named("let_declaration", "pattern", "identifier")], "param": [_named("parameter", "pattern", "identifier")], "type": _own("type_identifier"), "import": _own("use_declaration"),
        "literal": _own("integer_literal", "float_literal", "string_literal", "boolean_literal", "char_literal"), "block": _own("block"), "if": _own("if_expression"), "for": _own("for_expression"), "while": _own("while_expression"),
        "switch": _own("match_expression"),
    },
    "go": {
        "class": [_named("type_spec", "name", "type_identifier", body=("type", "field_declaration_list"))],
        "id": _own("identifier", "field_identifier"), "var": [_named("var_spec", "name", "identifier")], "param": [_named("parameter_declaration", "name", "identifier")], "type": _own("type_identifier"), "import": _own("import_declaration"),
        "literal": _own("interpreted_string_literal", "raw_string_literal", "int_literal", "float_literal", "rune_literal"), "block": _own("block"), "if": _own("if_statement"), "for": _own("for_statement"),
        "switch": _own("expression_switch_statement", "type_switch_statement"),
    },
}
#: Every abstract type; all else is taken for a concrete kind.
ABSTRACT = frozenset(("function", "class", "module", "id", "var", "param", "type", "import", "literal", "block", "if", "for", "while", "switch", "op", "call"))


def variants(lang: str, type_: str, sigil: str | None) -> list[Variant] | None:
    """Variants of a type; [] if the language has none; None if the type is a concrete kind.

    ``*`` means definitions and ``&`` references; only functions tell them apart.
    """
    if type_ == "function":
        define, call = FUNCTIONS[lang]
        return list(define) if sigil == "*" else list(call) if sigil == "&" else [*define, *call]
    if type_ in ABSTRACT:
        return list(TYPES[lang].get(type_, ()))
    return None
