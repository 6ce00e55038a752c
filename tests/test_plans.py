import pytest

from sylvan.functions.languages import ABSTRACT, LANGUAGES, canonical, detect, extensions, variants
from sylvan.plans.pattern import Planner, Scoped, describe
from sylvan.plans.query import Access, Atom, Group, Name, Query, QueryError, Selector, parse
from sylvan.sources.files import AccessError, jobs


def head(source):
    return parse(source).head


def test_atoms():
    assert head("function").node == Atom(None, "function")
    assert head("*function#foo").node == Atom("*", "function", Name("foo"))
    assert head('&x#"a b"').node == Atom("&", "x", Name("a b")) and head("id#/a|b/").node == Atom(None, "id", Name("a|b", True))
    assert head("#x").node == Atom(name=Name("x")) and head("").node == Atom() == head("  ").node
    assert head("some_kind").node.type == "some_kind" and head("é1").node.type == "é1"


def test_groups_fields_and_combinators():
    q = parse("(*function @f).body((&function#x @c)).params()")
    assert q.head.node == Group(Query(Selector(Atom("*", "function"))), "f")
    assert [f.field for f in q.head.fields] == ["body", "params"] and q.head.fields[1] == Access("params", None)
    for text in ("a>b", "a > b", "a >b", "a> b"):
        assert parse(text).tail == ((">", Selector(Atom(None, "b"))),)
    assert [c for c, _ in parse("a b + c ~ d").tail] == [" ", "+", "~"]
    assert parse(" a  ").tail == ()
    assert parse('id#"open').head.node.name == Name("open") and parse("id#/open").head.node.name == Name("open", True)


@pytest.mark.parametrize("bad", ["(a", "a)", "a.b", "a.", "(a @)", "a#", "a.b(c", "a b)", "@x", "a @x"])
def test_what_cant_be_read(bad):
    with pytest.raises(QueryError):
        parse(bad)


def plan(source, lang, **kw):
    return Planner(lang, **kw).plan(parse(source))


def test_types_by_language():
    for lang in LANGUAGES:
        assert plan("call", lang) == () and plan("*function", lang) and plan("odd_kind", lang)[0].kind == "odd_kind"
        assert all(variants(lang, t, None) is not None for t in ABSTRACT)
    assert plan("class", "c") == () == plan("switch", "python") and plan("op", "cpp")[0].kind == "binary_expression"
    assert len(plan("function#x", "cpp")) == 5 and len(plan("function", "cpp")) == 3 and len(plan("&function#x", "javascript")) == 2
    arrow = next(p for p in plan("*function#x", "javascript") if p.kind == "arrow_function")
    assert arrow.links == () and arrow.text is None


def test_fields():
    p = plan("(*function @f).body((&function#x @c))", "cpp")
    assert isinstance(p, Scoped) and p.field == "body" and len(p.inner) == 2
    assert not isinstance(plan("*function.params(id#x)", "c"), Scoped)
    assert plan("class.params(id)", "python") == ()  # a class has no parameters
    assert plan("*function.body(class)", "c") == plan("*function", "c")  # what the language lacks is no condition
    both = plan("(*function @f).body((id#x @c)).params(id#y)", "python")
    assert both.outer[0].links and plan("(*function @f).body((id#x @c)).params(id#y)", "python", compat=True).outer[0].links == ()
    assert plan("(id#x)", "c") == plan("id#x", "c")


def test_compat_combinators():
    assert plan("if id", "python")[0].links[0].how == "inside"
    assert plan("if id", "python", compat=True)[0].links[0].targets[0].kind is None
    assert [p.kind for p in plan("if + while", "go", compat=True)] == ["if_statement"] and len(plan("if + for", "go", compat=True)) == 2
    assert plan("if + for", "go")[0].links[0].how == "next" and plan("if ~ for", "go")[0].links[0].how == "later"
    assert "if_statement" in describe(plan("if > block", "c"))


def test_languages():
    assert canonical("c++") == "cpp" and detect("a/b.hpp") == "cpp" and detect("x.h") == "c" and detect("Makefile") is None
    assert "h" in extensions("cpp") and "h" in extensions("c") and extensions("js") == {"js", "mjs", "cjs", "jsx"}
    with pytest.raises(ValueError):
        canonical("cobol")


def test_discovery(tmp_path):
    (tmp_path / ".git" / "info").mkdir(parents=True)
    (tmp_path / ".git" / "info" / "exclude").write_text("excluded.py\n")
    for name in ("a.py", "b.go", "skip.py", "keep.py", ".hidden.py", "build/x.py", "sub/build/y.py", "sub/z.py", "sub/only.rs", "excluded.py", "t.txt", ".h/in.py", "lib/deep/q.py", ".git/no.py"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("# comment\nskip.*\n/build/\nk*.py\n!keep.py\nlib/**/q.py\n")
    (tmp_path / "sub" / ".ignore").write_text("*.rs\n")
    found = [p[len(str(tmp_path)) + 1 :] for p, _ in jobs(str(tmp_path))]
    assert found == [".h/in.py", ".hidden.py", "a.py", "b.go", "keep.py", "sub/build/y.py", "sub/z.py"]
    every = [p[len(str(tmp_path)) + 1 :] for p, _ in jobs(str(tmp_path), no_ignore=True)]
    assert set(every) == {*found, "skip.py", "build/x.py", "sub/only.rs", "excluded.py", "lib/deep/q.py"} and every == sorted(every)
    assert [p[-4:] for p, _ in jobs(str(tmp_path), "go")] == ["b.go"]
    assert jobs(str(tmp_path / "t.txt"), "python") == [(str(tmp_path / "t.txt"), "python")]
    for bad in (lambda: jobs(str(tmp_path / "none")), lambda: jobs(str(tmp_path / "t.txt")), lambda: jobs(str(tmp_path), "cobol")):
        with pytest.raises((AccessError, ValueError)):
            bad()
