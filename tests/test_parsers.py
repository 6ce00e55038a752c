import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvan.functions.languages import LANGUAGES
from sylvan.sources.cst import parse, rows
from sylvan.sources.facts import facts


def kinds(node):
    out = [node.kind]
    for k in node.kids:
        out += kinds(k)
    return out


def check(node, lo, hi):
    assert lo <= node.start <= node.end <= hi
    at = node.start
    for k in node.kids:
        assert k.start >= at or k.kind.endswith("comment"), (node, k)
        check(k, node.start, node.end)
        at = max(at, k.start)


SAMPLES = {
    "c": ["int f(struct s *p, char **q) { for (int i = 0; i < n; i++) a[i] = (int)g(p->x, &y); switch (x) { case 1: h(); break; default: k(); } do { x--; } while (x > 0); return sizeof(int) * 2; }", "#define M(a) (a+1)\n#ifdef X\nint z;\n#else\nint w;\n#endif\ntypedef struct { int a : 3; } T; enum E { A, B = 2 };", "static const char *names[] = { \"a\", \"b\" \"c\" }; int (*fp)(int, char); union U u = { .x = 1 }; void g(void); goto_end: ;"],
    "cpp": ["class A : public B { int x; void f(int a) const; A(); ~A(); template <class T> T g(T t) { return h<T>(t)->k(); } };", "namespace n { int a = 3, *b; Foo bar(Baz q) { if (auto x = f(1)) g(); for (auto& y : z) y.h(); std::vector<int> v{1, 2}; return a ? b(c) : d; } }", "void A::b() { [](int x) { return q(x); }(); Foo f(1); Foo* p = new Foo(2); try { throw E(); } catch (const E& e) { delete p; } }"],
    "javascript": ["import a, { b as c } from 'x'; const f = async (x, { y }) => x.map(z => z + 1), g = function h() {};", "class A extends B { static async m(a = 1) { return super.m(...a) } #p = 3; get x() { return `a${f(`b`)}c` } }", "for (const k of ks) if (k) { k?.z(/re[/]g/g) } else while (1) break\nswitch (a) { case 1: b(); default: c() }\nlet o = { a, b: 1, [c]: 2, m() {}, ...r }; x = a ? b : c"],
    "python": ["@d(1)\ndef f(a, b=1, *c, k: int = 2, **d) -> int:\n    '''doc'''\n    x, y = 1, 2\n    if a and not b or c == d < e:\n        return [i for i in q if h(i)]\n    elif w: pass\n    else:\n        with open(p) as fh: fh.read()\n", "class A(B, metaclass=M):\n    v = 1\n    def run(self): pass\nx = y = 3\nmatch x:\n    case [1, 2]:\n        k()\n", "try:\n    raise E from e\nexcept (A, B) as e:\n\tpass\nfinally:\n\tpass\nfrom . import a as b, c\nprint(*a, sep='', **b)\nf = lambda x, y=1: x if x else {1: 2}\nasync def m(): await t()"],
    "rust": ["use a::{b as c, self, d::*, e}; mod m { pub fn f<T: W + X>(x: &mut T, (a, b): (i32, u8)) -> Result<Box<dyn W>, E> where T: Z { x.go()?; Ok(a) } }", "impl<T> W for S<T> { fn go(&self) { let v = Foo::new(1); if let Some(x) = y.get(1) && z { q() } else if x < 3 { } match v { A::B(x) if x > 1 => h(x), C { y, .. } => { k() } _ => (), } for i in 0..n { g(|x: i32| x + 1, move || { c() }); } println!(\"{}\", x.foo()); } }", "struct S<'a> { x: i32, pub y: Vec<&'a str> } enum E { A, B(i32), C { x: u8 } } trait W: Sized { fn go(&self); const K: u8 = 1; } const N: usize = 3; static T: &str = r#\"a\"b\"#;"],
    "go": ["package p\nimport ( . \"a/b\"; _ \"c\"; d \"e/f\" )\ntype I interface { M(a int) (*T, error); io.Reader }\ntype ( A struct { x, y int `t`; *B }; C = map[string][]int )", "package p\nfunc (s *S[T]) Do(a, b T, c ...int) (x int, err error) { if v, ok := m[k]; ok && v > 1 { go f(func() { g() }) } else { defer h(1) }; for _, x := range xs { z[int](x) }; return a[1:2], nil }", "package p\nfunc F[K comparable, V any](m map[K]V) V { switch y := e.(type) { case int, *T: u(y); default: }; select { case <-c: l() }; p := &T{a: 1, b: []int{1}}; return m[K(1)] }"],
}


@pytest.mark.parametrize("lang", LANGUAGES)
def test_samples_are_read_whole(lang):
    for source in SAMPLES[lang]:
        root = parse(source, lang)
        assert "ERROR" not in kinds(root), root
        check(root, 0, len(source))


@pytest.mark.parametrize("lang", LANGUAGES)
@settings(max_examples=150, deadline=None)
@given(data=st.data())
def test_nothing_breaks_a_parser(lang, data):
    base = data.draw(st.sampled_from(SAMPLES[lang]))
    cut = data.draw(st.lists(st.tuples(st.integers(0, len(base)), st.integers(0, 12), st.sampled_from(["", "{", "}", "(", ")", "\"", "'", "<", ">", "\n", "if", ":", "`", "#", "=>", "é", "/*", "[", "::", ","])), max_size=6))
    source = base
    for at, n, put in cut:
        source = source[:at] + put + source[at + n :]
    root = parse(source, lang)
    for node_id, last, parent, depth, *_ in rows(root, source):
        assert parent < node_id <= last and depth >= 0
    facts(root, source, "a/b.x", lang)


@pytest.mark.parametrize("lang", LANGUAGES)
@pytest.mark.parametrize("source", ["", "\n", "(" * 5000, "{" * 3000 + "x", "a" * 100_000, "\x00\x01", "f(" * 2000 + ")" * 2000, "\ufffd"])
def test_extreme_files(lang, source):
    root = parse(source, lang)
    assert list(rows(root, source))


def test_intervals_tell_containment():
    table = list(rows(parse(SAMPLES["c"][0], "c"), SAMPLES["c"][0]))
    by = {r[0]: r for r in table}
    for r in table:
        at, inside = r[2], set()
        while at >= 0:
            inside.add(at)
            at = by[at][2]
        assert inside == {a[0] for a in table if a[0] < r[0] <= a[1]}


def outline(source, lang):
    return [(r["depth"], r["kind"], r["name"], r["line"]) for r in facts(parse(source, lang), source, "x", lang) if r["rel"] == "outline"]


def test_outlines():
    assert outline("int a = 1, b;\nint c;\nchar *d;\nvoid f(void);\nint *g(int x) { return 0; }\nstruct S { int x; };", "c") == [(0, "var", "a", 1), (0, "var", "c", 2), (0, "fn", "g", 5)]
    cpp = "namespace n {\nclass A {\n public:\n  void p(int);\n  int q() { return 1; }\n  struct B { void r() {} };\n};\n}\nnamespace { void z() {} }\nint A::w() { return 2; }\n#ifdef X\nvoid hidden() {}\n#endif\ntemplate <class T> void t() {}"
    assert outline(cpp, "cpp") == [(0, "namespace", "n", 1), (1, "class", "A", 2), (2, "fn", "p", 4), (2, "fn", "q", 5), (0, "namespace", "(anonymous)", 9), (1, "fn", "z", 9), (0, "fn", "w", 10)]
    py = "X = 1\nY: int = 2\na.b = 3\nclass A:\n    Z = 4\n    def f(self): pass\n    class B:\n        def g(self): pass\n@dec\ndef hidden(): pass\nasync def h(): pass\nif x:\n    def no(): pass"
    assert outline(py, "python") == [(0, "var", "X", 1), (0, "var", "Y", 2), (0, "class", "A", 4), (1, "fn", "f", 6), (1, "class", "B", 7), (2, "fn", "g", 8), (0, "fn", "h", 11)]
    js = "function f() {}\nconst a = () => 1, b = 2;\nlet c = 3;\nvar d = function () {};\nclass A { m() {} get n() { return 1 } x = 1 }\nexport function hidden() {}"
    assert outline(js, "javascript") == [(0, "fn", "f", 1), (0, "fn", "a", 2), (0, "var", "c", 3), (0, "var", "d", 4), (0, "class", "A", 5), (1, "fn", "m", 5), (1, "fn", "n", 5)]
    rs = "fn f() {}\nmod m { fn g() {} const H: u8 = 1; }\nstruct S { x: u8 }\nenum E { A }\ntrait T { fn s(&self); fn d(&self) {} }\nimpl<X> T for S<X> { fn s(&self) {} }\nconst C: u8 = 1;\nstatic D: u8 = 2;"
    assert outline(rs, "rust") == [(0, "fn", "f", 1), (0, "mod", "m", 2), (1, "fn", "g", 2), (0, "struct", "S", 3), (0, "enum", "E", 4), (0, "trait", "T", 5), (1, "fn", "d", 5), (0, "impl", "S<X>", 6), (1, "fn", "s", 6), (0, "var", "C", 7), (0, "var", "D", 8)]
    go = "package p\nimport \"x\"\ntype A struct{}\ntype (\n  B int\n  C int\n)\nfunc (a A) M() {}\nfunc F() {}\nvar x = 1"
    assert outline(go, "go") == [(0, "type", "A", 3), (0, "type", "B", 4), (0, "fn", "M", 8), (0, "fn", "F", 9)]


def rel(source, lang, name, path="app/src/a/b.rs"):
    return [r for r in facts(parse(source, lang), source, path, lang) if r["rel"] == name]


def test_rust_facts():
    src = "use crate::a::{b as c, self, d::*, e::f}; use super::*; use g;\nfn k<T: W>(x: &mut Foo<T>, y: Box<dyn Bar>, (p, q): (u8, u8)) -> Self where T: V + Z { let a: Rc<Q> = 1; let b = h; let c = S { x: 1 }; let d = m::S::new(1); let e = x.go::<u8>(2); u(|z| inner(z)); }"
    assert {r["name"]: r["segs"] for r in rel(src, "rust", "import")} == {"c": ["a", "b"], "a": ["a"], "f": ["a", "e", "f"], "g": ["g"]}
    assert [r["segs"] for r in rel(src, "rust", "glob")] == [["a", "d"], []]
    assert [(r["var"], r["type"]) for r in rel(src, "rust", "param")] == [("x", "Foo"), ("y", "Bar")]
    assert [(r["var"], r["type"]) for r in rel(src, "rust", "bound")] == [("T", "W"), ("T", "V"), ("T", "Z")]
    assert [(r["var"], r["bkind"], r.get("type"), r.get("name")) for r in rel(src, "rust", "binding")] == [("a", "typed", "Q", None), ("b", "value", None, "h"), ("c", "typed", "S", None), ("d", "call", None, "new"), ("e", "call", None, "go")]
    assert [(r["ckind"], r["name"]) for r in rel(src, "rust", "call")] == [("path", "new"), ("method", "go"), ("bare", "u"), ("bare", "inner")]
    src = "mod m { impl T for S { fn a(&self) -> Self { fn inner() {} } } trait T { fn s(&self) -> Box<X>; fn d() {} } }"
    assert [("::".join(r["segs"]), r["kind"], r.get("receiver"), r.get("via_trait"), r.get("ret")) for r in rel(src, "rust", "def")] == [("a::b::m::S::a", "method", "S", "T", "S"), ("a::b::m::inner", "function", None, None, None), ("a::b::m::T::s", "signature", "T", None, "X"), ("a::b::m::T::d", "method", "T", None, None)]
    assert rel(src, "rust", "impl")[0]["name"] == "S" and [r["segs"] for r in rel("fn f() {}", "rust", "def", "x/src/lib.rs")] == [["f"]]


def test_go_facts():
    src = "package p\nimport (\n x \"a/b\"\n \"a/c\"\n . \"a/d\"\n _ \"a/e\"\n)\ntype I interface { M() (*R, error) }\nfunc (s *S[T]) Do(a, b q.T, c ...int) (r *U, e error) { x, err := f(); y := &V{}; z := g; var v W; w := s.m[0].n(); u[int](1); (h)(2); go func() { k() }(); i, j := 1, 2 }"
    assert {r["name"]: r["segs"] for r in rel(src, "go", "import", "d/f.go")} == {"x": ["a", "b"], "c": ["a", "c"]} and rel(src, "go", "glob")[0]["segs"] == ["a", "d"]
    assert [(r["name"], r["segs"], r["kind"], r["receiver"], r["ret"]) for r in rel(src, "go", "def", "d/f.go")] == [("M", ["d", "I", "M"], "signature", "I", "R"), ("Do", ["d", "S", "Do"], "method", "S", "U")]
    assert [(r["var"], r["type"]) for r in rel(src, "go", "param")] == [("s", "S"), ("a", "T"), ("b", "T")]
    assert [(r["var"], r["bkind"], r.get("type"), r.get("name")) for r in rel(src, "go", "binding")] == [("x", "call", None, "f"), ("y", "typed", "V", None), ("z", "value", None, "g"), ("v", "typed", "W", None), ("w", "call", None, "n")]
    assert [(r["ckind"], r["name"]) for r in rel(src, "go", "call")] == [("bare", "f"), ("method", "n"), ("bare", "u"), ("bare", "h"), ("bare", "k")]


NESTED = {
    "c": ("int f() {", "if (a) {", "g();", "}", "}"), "cpp": ("int f() {", "if (a) {", "g();", "}", "}"), "go": ("package p\nfunc f() {", "if a {", "g()", "}", "}"),
    "rust": ("fn f() {", "if a {", "g();", "}", "}"), "javascript": ("function f() {", "if (a) {", "g();", "}", "}"), "python": ("def f():\n  return ", "[", "g()", "]", "\n"),
}


@pytest.mark.parametrize("lang", NESTED)
def test_deep_nesting_keeps_its_structure(lang):
    head, left, inner, right, tail = NESTED[lang]
    source = head + left * 3000 + inner + right * 3000 + tail
    found = list(rows(parse(source, lang), source))
    assert sum("call" in r[4] for r in found) == 1 and not any(r[4] == "ERROR" for r in found)
    assert [r["name"] for r in facts(parse(source, lang), source, "x", lang) if r["rel"] == "call"] == ["g"]
