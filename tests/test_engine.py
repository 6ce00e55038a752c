"""The engine on small corpora: one graph for all cases, whose names don't meet."""

import pytest
from pyspark.sql import functions as F

from sylvan.__main__ import arguments, run
from sylvan.engine import Engine
from sylvan.functions import render
from sylvan.functions.languages import detect
from sylvan.operators.search import quoted

GO = {
    "m/a/one.go": "package a\nimport (\n\t\"fmt\"\n\t\"x.y/m/b\"\n\tal \"x.y/m/c\"\n\t. \"x.y/m/d\"\n\t\"x.y/q/util\"\n)\nfunc sameFile() {}\nfunc A1() {\n\tsameFile()\n\tsamePkg()\n\tb.InB()\n\tal.InC()\n\tInD()\n\tfmt.Println()\n\tb.Missing()\n\tutil.Deep()\n\tnowhere()\n}\n"
    "func A2() {\n\tf := target1\n\tf()\n\tg := target1\n\tg = target2\n\tg()\n\th := target1\n\th := target2\n\th()\n}\nfunc target1() {}\nfunc target2() {}\n",
    "m/a/two.go": "package a\nfunc samePkg() {}\ntype Srv struct{}\nfunc (s *Srv) Go1() { s.Go2() }\nfunc (s *Srv) Go2() {}\nfunc NewSrv() *Srv { return nil }\nfunc mk() (*Srv, error) { return nil, nil }\n"
    "func B1(p Srv, q *Srv) {\n\tvar v Srv\n\tv.Go1()\n\tw := &Srv{}\n\tw.Go2()\n\tx := NewSrv()\n\tx.Go1()\n\ty, err := mk()\n\ty.Go2()\n}\nfunc B2(p Srv) { p.Go1() }\nfunc B3() { m := v.Go2\n\tm()\n\tz := NewOther()\n\tz.Only() }\n"
    "func (o Other) Only() {}\nfunc (o Third) Only() {}\nfunc B4() {\n\tgo inGo()\n\tdefer func() { inGo() }()\n\tgen[int](1)\n\tSrv.Go1(s)\n}\nfunc inGo() {}\nfunc gen[T any](t T) {}\n",
    "m/b/b.go": "package b\nfunc InB() {}\n", "m/c/c.go": "package c\nfunc InC() {}\n", "m/d/d.go": "package d\nfunc InD() {}\n",
    "q/util/u.go": "package util\nfunc Deep() {}\n", "z/util/u.go": "package util\nfunc Deep() {}\n",
    "m/e/e.go": "package e\ntype Wk interface {\n\tDo()\n\tEnd()\n}\ntype Lone interface {\n\tAlone()\n}\nfunc (x T1) Do() {}\nfunc (x T1) End() {}\nfunc (x T2) Do() {}\nfunc (x T2) End() {}\nfunc (x T3) Do() {}\nfunc E1(w Wk) { w.Do() }\nfunc E2(l Lone) { l.Alone() }\n"
    "type Sg interface { Sing() }\nfunc (b Bird) Sing() {}\nfunc E3(s Sg) { s.Sing() }\nfunc E4() {\n\tb := local()\n\tb.InB()\n}\nfunc (c Cage) InB() {}\nfunc local() Cage { return 0 }\n",
    "m/f/f.go": "package f\nfunc Amb() {}\nfunc loopA() { loopB() }\nfunc loopB() { loopC() }\nfunc loopC() { loopA() }\n", "m/g/g.go": "package g\nfunc Amb() {}\n", "m/h/h.go": "package h\nimport \"x.y/m/g\"\nfunc H1() { Amb() }\nfunc H2() { outside.Amb() }\n",
}
RUST = {
    "app/src/main.rs": "use crate::geo::area as ar;\nuse crate::geo::{vol, deep::*};\nuse std::collections::HashMap;\nfn r_same() {}\nfn r1() {\n    r_same();\n    ar();\n    vol();\n    r_glob();\n    geo::area();\n    HashMap::new();\n    Thing::make();\n    unknown_fn();\n}\n"
    "fn r2() {\n    let f = r_same;\n    f();\n    let f = r_other;\n    f();\n    let g = Thing::make;\n    g();\n}\nfn r_other() {}\n",
    "app/src/geo/mod.rs": "pub fn area() {}\npub fn vol() {}\npub mod deep { pub fn r_glob() {} }\n",
    "app/src/thing.rs": "pub struct Thing;\nimpl Thing {\n    pub fn make() -> Self { Thing }\n    fn act(&self) { self.helper1(); }\n    fn helper1(&self) {}\n}\nfn other_new() -> Thing { Thing }\n"
    "fn s1(p: &Thing) {\n    let a = Thing { };\n    a.act();\n    let b = Thing::make();\n    b.act();\n    let c: Thing = x();\n    c.act();\n    let d = other_new();\n    d.act();\n    p.helper1();\n    let e = Gone::new();\n    e.only_gone();\n    a.act().helper1();\n}\n"
    "impl Gone { fn only_gone(&self) {} }\nimpl Else { fn only_gone(&self) {} }\n",
    "app/src/tr.rs": "pub trait Draw {\n    fn paint(&self);\n    fn frame(&self) { self.paint(); }\n}\nimpl Draw for Sq { fn paint(&self) {} }\nimpl Draw for Ci {\n    fn paint(&self) {}\n    fn frame(&self) {}\n}\npub trait Solo { fn one(&self); }\nimpl Solo for Sq { fn one(&self) {} }\npub trait None_ { fn no_impl(&self); }\n"
    "fn t1(a: &dyn Draw, b: Box<dyn Draw>) {\n    a.paint();\n    b.frame();\n}\nfn t2<T: Draw>(x: T) { x.paint(); }\nfn t3<T>(x: T) where T: Draw { x.paint(); }\nfn t4(x: impl Solo) { x.one(); }\nfn t5(x: &dyn None_) { x.no_impl(); }\n",
    "app/src/am1.rs": "pub fn r_amb() {}\n", "lib/src/am2.rs": "pub fn r_amb() {}\n", "lib/src/am3.rs": "fn u1() { r_amb(); }\n",
}
PLAIN = {
    "p/a.py": "def py_one():\n    py_two()\n    obj.py_meth()\n    py_amb()\n\nclass K:\n    def py_meth(self):\n        pass\n\ndef py_amb(): pass\n", "p/b.py": "def py_amb(): pass\ndef py_two():\n    print(len(\"a, b\"))\n",
    "p/c.js": "function js_f() { js_g(1, 2); o.js_m(); }\nfunction js_g() {}\nclass Q { js_m() { js_g() } }\n", "p/d.c": "void c_f(void) { c_g(); if (c_h()) c_g(); }\nvoid c_g(void) {}\n",
}


@pytest.fixture(scope="module")
def engine(spark):
    files = [(p, detect(p), s) for p, s in {**GO, **RUST, **PLAIN}.items()] + [("gone.py", "python", None)]
    return Engine(spark, spark.createDataFrame(files, "path string, lang string, source string"))


@pytest.fixture(scope="module")
def edges(engine):
    out = {}
    for r in engine.graph.named().collect():
        out.setdefault((r["src_name"], r["display"]), set()).add((r["dst_path"] and r["dst_path"].split("/", 1)[1], r["dst_line"], r["is_guess"]))
    return out


OUT = {(None, None, False)}
CASES = {
    ("A1", "sameFile"): {("a/one.go", 9, False)}, ("A1", "samePkg"): {("a/two.go", 2, False)}, ("A1", "InB"): {("b/b.go", 2, False)}, ("A1", "InC"): {("c/c.go", 2, False)}, ("A1", "InD"): {("d/d.go", 2, False)},
    ("A1", "Println"): OUT, ("A1", "Missing"): OUT, ("A1", "Deep"): {("util/u.go", 2, False)}, ("A1", "nowhere"): OUT,
    ("A2", "f"): {("a/one.go", 31, False)}, ("A2", "g"): {("a/one.go", 31, False)}, ("A2", "h"): {("a/one.go", 32, False)},
    ("Go1", "Go2"): {("a/two.go", 5, False)}, ("B1", "Go1"): {("a/two.go", 4, False)}, ("B1", "Go2"): {("a/two.go", 5, False)}, ("B2", "Go1"): {("a/two.go", 4, False)}, ("B3", "m"): {("a/two.go", 5, False)},
    ("B3", "Only"): {("a/two.go", 23, False)}, ("B4", "inGo"): {("a/two.go", 31, False)}, ("B4", "gen"): {("a/two.go", 32, False)}, ("B4", "Go1"): {("a/two.go", 4, False)},
    ("E1", "Do"): {("e/e.go", 9, True), ("e/e.go", 11, True)}, ("E2", "Alone"): {("e/e.go", 7, False)}, ("E3", "Sing"): {("e/e.go", 17, False)}, ("E4", "InB"): {("e/e.go", 23, False)},
    ("H1", "Amb"): {("g/g.go", 2, True)}, ("H2", "Amb"): {("g/g.go", 2, True)},
    ("r1", "r_same"): {("src/main.rs", 4, False)}, ("r1", "ar"): {("src/geo/mod.rs", 1, False)}, ("r1", "vol"): {("src/geo/mod.rs", 2, False)}, ("r1", "r_glob"): {("src/geo/mod.rs", 3, False)}, ("r1", "area"): {("src/geo/mod.rs", 1, False)},
    ("r1", "new"): OUT, ("r1", "make"): {("src/thing.rs", 3, False)}, ("r1", "unknown_fn"): OUT, ("r2", "f"): {("src/main.rs", 4, False), ("src/main.rs", 23, False)}, ("r2", "g"): {("src/thing.rs", 3, False)},
    ("act", "helper1"): {("src/thing.rs", 5, False)}, ("s1", "act"): {("src/thing.rs", 4, False)}, ("s1", "helper1"): {("src/thing.rs", 5, False)}, ("s1", "only_gone"): {("src/thing.rs", 22, False)},
    ("t1", "paint"): {("src/tr.rs", 5, True), ("src/tr.rs", 7, True)}, ("t1", "frame"): {("src/tr.rs", 3, True), ("src/tr.rs", 8, True)}, ("t2", "paint"): {("src/tr.rs", 5, True), ("src/tr.rs", 7, True)},
    ("t3", "paint"): {("src/tr.rs", 5, True), ("src/tr.rs", 7, True)}, ("t4", "one"): {("src/tr.rs", 11, False)}, ("t5", "no_impl"): {("src/tr.rs", 12, False)}, ("u1", "r_amb"): {("src/am2.rs", 1, True)},
    ("py_one", "py_two"): {("b.py", 2, False)}, ("py_one", "py_meth"): {("a.py", 7, False)}, ("py_one", "py_amb"): OUT, ("py_two", "print"): OUT, ("py_two", "len"): OUT,
    ("js_f", "js_g"): {("c.js", 2, False)}, ("js_f", "js_m"): {("c.js", 3, False)}, ("js_m", "js_g"): {("c.js", 2, False)}, ("c_f", "c_g"): {("d.c", 2, False)}, ("c_f", "c_h"): OUT,
}


def test_calls_resolve(edges):
    wrong = {k: (edges.get(k), v) for k, v in CASES.items() if edges.get(k) != v}
    assert not wrong


def test_edges_and_their_texts(engine):
    edges = {(r["src_id"], r["dst_id"], r["is_guess"]) for r in engine.edges().collect()}
    assert ("h.go:3", "g.go:2", True) in edges and ("d.c:1", "c_h", False) in edges
    text = engine.edges_text("edges")
    assert "h.go:3 -> g.go:2 ?\n" in text and text.splitlines() == sorted(text.splitlines(), key=lambda x: x.split(" -> "))
    dot = engine.edges_text()
    assert dot.startswith("digraph callgraph {\n") and '"h.go:3" -> "g.go:2" [style=dashed];' in dot and '"d.c:2" [label="c_g\\nd.c:2"];' in dot


def test_traversals(engine):
    assert engine.callees_text("loopA", 9) == "loopA()\n└── loopB()  [f.go:4]\n    └── loopC()  [f.go:5]\n        └── loopA()  [f.go:3] (cycle)\n"
    assert engine.callers_text("loopA", 2) == "loopA()\n└── loopC()  [f.go:5]\n    └── loopB()  [f.go:4]\n"
    assert engine.callees_text("no_such_name") == "no_such_name()\n" and engine.callees("loopA", 0).count() == 0
    assert engine.callers_text("c_h") == "c_h()\n└── c_f()  [d.c:1]\n"
    two = engine.callees_text("Amb")
    assert two == "Amb()  [f.go:2]\n\nAmb()  [g.go:2]\n"
    assert engine.callees_text("E1") == "E1()\n├── Do() [x]\n".replace(" [x]", "  [e.go:9] ?") + "└── Do()  [e.go:11] ?\n"


def test_definitions(engine):
    def found(expression):
        return [(r["path"], r["line"], r["is_guess"]) for r in engine.definition(expression).collect()]

    assert found("geo::area") == [("app/src/geo/mod.rs", 1, False)] and found("crate::geo::area") == found("geo::area")
    assert found("Thing::make") == [("app/src/thing.rs", 3, False)] and found("Srv.Go1") == [("m/a/two.go", 4, False)]
    assert found("b.InB") == [("m/b/b.go", 2, True), ("m/e/e.go", 23, True)] and found("Amb") == [("m/f/f.go", 2, True), ("m/g/g.go", 2, True)]
    assert found("nothing") == [] == found("::")
    assert engine.definition_text("samePkg") == "m/a/two.go:2: func samePkg() {}\n"


def lines(engine, query, **options):
    return render.matches(engine.search(query, **options), True).splitlines()


def test_search(engine):
    assert lines(engine, "id#js_g") == ['p/c.js: <match>:1: "js_g"', 'p/c.js: <match>:2: "js_g"', 'p/c.js: <match>:3: "js_g"']
    assert lines(engine, "(*function#c_f @f).body((&function#c_g @c))") == ['p/d.c: @f:1: "void c_f(void) { c_g(); if (c_h()) c_g(); }", @c:1: "c_g()"']
    assert lines(engine, "(if @s).condition((&function#c_h @c))") == ['p/d.c: @s:1: "if (c_h()) c_g();", @c:1: "c_h()"'] and lines(engine, "(if @s).condition((&function#c_g @c))") == []
    assert lines(engine, "class#K") == ['p/a.py: <match>:6: "class K:"'] and lines(engine, "(class#K @k)", body=True) == ["p/a.py: @k:6-8: class K:", "    def py_meth(self):", "        pass"]
    assert lines(engine, "literal#/a, b/") == ['p/b.py: <match>:3: "\\"a, b\\""']
    assert lines(engine, "*function#py_two + *function") == [] and lines(engine, "(*function#js_f + (*function#js_g @g))") == ['p/c.js: @g:2: "function js_g() {}"']
    assert lines(engine, "odd_kind") == [] == lines(engine, "call") and len(lines(engine, "#py_two")) == 2
    assert lines(engine, "preproc_include") == [] and lines(engine, "class *function#js_m") == ['p/c.js: <match>:3: "class Q { js_m() { js_g() } }"']
    assert lines(engine, "class *function#js_m", compat=True) == lines(engine, "class *function#js_m") and lines(engine, "if + for#x", compat=True)
    assert lines(engine, "*function#c_f.body()") == ['p/d.c: <match>:1: "{ c_g(); if (c_h()) c_g(); }"']


def test_regular_expressions_are_javas(engine):
    assert lines(engine, r"id#/^\p{Lu}$/") == lines(engine, "id#/^[A-Z]$/") != []
    with pytest.raises(ValueError):
        engine.search("id#/(/")


def test_quoting(spark):
    text = "a\"b\\c\td\0e\x01f\x7fg\u00a0h\u200bi\u0301j é 語"
    got = spark.createDataFrame([(text,)], "t string").select(quoted(F.col("t"))).first()[0]
    assert got == '"a\\"b\\\\c\\td\\0e\\u{1}f\\u{7f}g\\u{a0}h\\u{200b}i\\u{301}j é 語"'


def test_intervals_over_many_ranges(spark):
    body = "".join(f"  if (a{i}) {{ g{i}(); }}\n" for i in range(400))
    files = spark.createDataFrame([("a.c", "c", f"void f() {{\n{body}}}\nvoid h() {{ g7(); }}\n"), ("b.c", "c", "void f2() { g7(); }")], "path string, lang string, source string")
    engine = Engine(spark, files)
    assert engine.search("(*function @f).body((&function @c))").count() == 402
    assert lines(engine, "*function &function#g399") == ['a.c: <match>:1: "void f() {"']
    assert len(lines(engine, "*function (&function#g7 @c)")) == 3 and lines(engine, "*function#f ~ *function#h") == ['a.c: <match>:1: "void f() {"']


def test_files_that_cannot_be_read(spark):
    engine = Engine(spark, spark.createDataFrame([("x.go", "go", None), ("a.go", "go", "package a")], "path string, lang string, source string"))
    assert engine.unreadable() == ["x.go"] and engine.search("id").count() >= 0


def test_command_line(spark, tmp_path):
    (tmp_path / "a.go").write_text("package a\nfunc F() { G() }\nfunc G() {}\n")
    path = str(tmp_path / "a.go")
    assert run(["-q", "id#G", path], spark) == '<match>:2: "G"\n<match>:3: "G"\n'
    assert run(["tree", path], spark) == "├── fn F  :2\n└── fn G  :3\n"
    assert run(["callgraph", path, "--format", "edges"], spark) == "a.go:2 -> a.go:3\n"
    assert run(["def", "G", str(tmp_path)], spark) == f"{path}:3: func G() {{}}\n"
    assert "call_expression" in run(["-q", "&function", "--show-query"]) and arguments(["callers", "F", "x", "--depth", "5"]).depth == 5
    with pytest.raises(ValueError):
        run(["def", "nope", path], spark)
    bad = tmp_path / "bad.py"
    bad.write_bytes(b"x = '\xff\xfe'\n")
    assert run(["-q", "literal", str(bad)], spark) == '<match>:1: "<invalid utf8>"\n'
