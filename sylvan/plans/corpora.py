"""Source files that are written from the rows of the given tables, with Spark's own functions.

The tables hold no source code. A corpus gives every row its place in files of some
language (path, lang, source), so that what the engine finds by parsing and resolving can
be checked against the rows themselves, by SQL that never sees a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.runtime import table

#: Orders, and parts, of a file.
ORDERS, PARTS = 50, 500


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def _lines(rows: DataFrame, path: Column, order: str | Column, text: Column, head: str = "", tail: str = "") -> DataFrame:
    """(path, source): the texts of a path's rows in order, a line break after each."""
    key = order if isinstance(order, Column) else F.col(order)
    grouped = rows.select(path.alias("path"), F.struct(key.alias("k"), text.alias("t")).alias("x")).groupBy("path").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return grouped.select("path", _text(head, F.array_join(F.transform("x", lambda x: F.concat(x["t"], F.lit("\n"))), ""), tail).alias("source"))


def _lang(files: DataFrame, lang: str) -> DataFrame:
    return files.select("path", F.lit(lang).alias("lang"), "source")


def c_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A C function for each order, ``order_<key>_<status>``, that calls ``part_<key>(<quantity>)`` for each of its
    lines, ordered by part and quantity; and one for each part. Functions of an order take a parameter
    named after its priority's number."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_partkey", F.col("l_quantity").cast("int").alias("q")).alias("x"))
    calls = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    orders = table(spark, sf_dir, "orders").join(calls, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    call = lambda x: _text("    part_", x["l_partkey"].cast("string"), "(", x["q"].cast("string"), ");\n")
    body = F.coalesce(F.array_join(F.transform("x", call), ""), F.lit(""))
    text = _text("void order_", _s("o_orderkey"), "_", F.col("o_orderstatus"), "(int p", F.substring("o_orderpriority", 1, 1), ") {\n", body, "}")
    path = _text("orders/b", F.floor(F.col("o_orderkey") / ORDERS).cast("string"), ".c")
    parts = table(spark, sf_dir, "part")
    part_path = _text("parts/b", F.floor(F.col("p_partkey") / PARTS).cast("string"), ".c")
    files = _lines(orders, path, "o_orderkey", text).unionByName(_lines(parts, part_path, "p_partkey", _text("void part_", _s("p_partkey"), "(int q) {}")))
    return _lang(files, "c")


def go_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Go package for each region and a file for each nation. A customer's function calls the one of the
    customer of half its number, a function of its file, one that several files of some packages have, and
    one of the next region's package, by import."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    at = lambda: _text("world/r", _s("n_regionkey"), "/n", F.lpad(_s("n_nationkey"), 2, "0"), ".go")
    following = ((F.col("n_regionkey") + 1) % 5).cast("string")
    rows = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations at every scale
    cust = _text("func Cust", _s("c_custkey"), "() { Cust", F.floor(F.col("c_custkey") / 2).cast("string"), "(); Local(); Shared(); r", following, ".Region", following, "(); fmt.Println() }")
    custs = rows.select(at().alias("path"), (F.col("c_custkey") + 10).alias("k"), cust.alias("t"))
    head = nation.select(at().alias("path"), F.lit(0).cast("long").alias("k"), _text("package r", _s("n_regionkey"), "\nimport (\n\t\"fmt\"\n\t\"example.com/world/r", following, "\"\n)\nfunc Local() {}").alias("t"))
    shared = nation.where("n_nationkey % 3 = 0").select(at().alias("path"), F.lit(1).cast("long").alias("k"), F.lit("func Shared() {}").alias("t"))
    regions = nation.select("n_regionkey").distinct().select(_text("world/r", _s("n_regionkey"), "/region.go").alias("path"), F.lit(0).cast("long").alias("k"), _text("package r", _s("n_regionkey"), "\nfunc Region", _s("n_regionkey"), "() {}").alias("t"))
    every = custs.unionByName(head).unionByName(shared).unionByName(regions)
    return _lang(_lines(every, F.col("path"), "k", F.col("t")), "go")


def go_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Go type for each supplier, with methods Run and, if its balance isn't negative, Stop; an interface of
    both; and for each nation a function that runs what it is given and a variable of its first supplier's type."""
    supplier = table(spark, sf_dir, "supplier")
    t = _text("Sup", _s("s_suppkey"))
    stop = F.when(F.col("s_acctbal") >= 0, _text("\nfunc (s *", t, ") Stop() {}")).otherwise("")
    text = _text("type ", t, " struct{}\nfunc (s *", t, ") Run() {}", stop, "\nfunc New", t, "() *", t, " { return nil }\nfunc Use", t, "(w Worker) {\n\tw.Run()\n\tx := New", t, "()\n\tx.Run()\n\tx.Stop()\n}")
    path = _text("work/n", F.lpad(_s("s_nationkey"), 2, "0"), "/sup.go")
    files = _lines(supplier, path, "s_suppkey", text, head="package work\n")
    worker = spark.range(1).select(F.lit("work/worker.go").alias("path"), F.lit("package work\ntype Worker interface {\n\tRun()\n\tStop()\n}\n").alias("source"))
    return _lang(files.unionByName(worker), "go")


def rust_mods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Rust module for each nation with a function for each customer, which is called by its path, by an
    alias, through a glob import and by an unknown path from the module of the next nation."""
    customer = table(spark, sf_dir, "customer")
    n = F.col("c_nationkey")
    text = _text("pub fn cust_", _s("c_custkey"), "() {}")
    files = _lines(customer, _text("app/src/geo/n", n.cast("string"), ".rs"), "c_custkey", text)
    use = _text("    a", _s("c_custkey"), "();\n    geo::n", n.cast("string"), "::cust_", _s("c_custkey"), "();\n    cust_", _s("c_custkey"), "();\n    other::cust_", _s("c_custkey"), "();")
    alias = _text("use crate::geo::n", n.cast("string"), "::cust_", _s("c_custkey"), " as a", _s("c_custkey"), ";")
    both = customer.select(n.alias("n"), (F.col("c_custkey") * 2).alias("k"), alias.alias("t"))
    both = both.unionByName(customer.select(n.alias("n"), (F.col("c_custkey") * 2 + (1 << 60)).alias("k"), _text("pub fn call_", _s("c_custkey"), "() {\n", use, "\n}").alias("t")))
    calls = _lines(both, _text("app/src/use/n", _s("n"), ".rs"), "k", F.col("t"), head="use crate::geo;\n")
    return _lang(files.unionByName(calls), "rust")


def rust_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Rust type for each supplier that implements a trait, with its own ``stop`` if its balance isn't negative;
    and for each a function that works through the trait, a bound, its own type and a constructor."""
    supplier = table(spark, sf_dir, "supplier")
    t = _text("Sup", _s("s_suppkey"))
    stop = F.when(F.col("s_acctbal") >= 0, F.lit("\n    fn stop(&self) {}")).otherwise("")
    text = _text(
        "pub struct ", t, ";\nimpl ", t, " {\n    pub fn make() -> Self { todo!() }\n}\nimpl Work for ", t, " {\n    fn run(&self) { self.stop(); }", stop, "\n}\nfn use_", _s("s_suppkey"),
        "<T: Work>(a: &dyn Work, b: T) {\n    a.stop();\n    b.run();\n    let x = ", t, "::make();\n    x.run();\n}",
    )
    files = _lines(supplier, _text("work/src/n", F.lpad(_s("s_nationkey"), 2, "0"), ".rs"), "s_suppkey", text)
    trait = spark.range(1).select(F.lit("work/src/lib.rs").alias("path"), F.lit("pub trait Work {\n    fn run(&self);\n    fn stop(&self) {}\n}\n").alias("source"))
    return _lang(files.unionByName(trait), "rust")


#: For each language: extension, head of a file, a class with a method, a function, and where the method's line is.
MIXED = {
    "c": ("c", "", "struct K{k};", "int fn{k}(int a) { return fn{k}(a); }"),
    "cpp": ("cpp", "", "class K{k} {{\npublic:\n  int run{k}() {{ return fn{k}(1); }}\n}};", "int fn{k}(int a) {{ return 0; }}"),
    "javascript": ("js", "", "class K{k} {{\n  run{k}() {{ fn{k}(1); }}\n}}", "function fn{k}(a) {{ return 0; }}"),
    "python": ("py", "", "class K{k}:\n    def run{k}(self):\n        fn{k}(1)", "def fn{k}(a): return 0"),
    "rust": ("rs", "", "trait K{k} {{\n  fn run{k}(&self) {{ fn{k}(1); }}\n}}", "fn fn{k}(a: u8) {{}}"),
    "go": ("go", "package p\n", "type K{k} struct {{ a int }}", "func fn{k}(a int) {{ fn{k}(1) }}"),
}


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each of the six languages a file for each nation, with a class and a function for each supplier."""
    supplier = table(spark, sf_dir, "supplier")
    out = None
    for lang, (ext, head, cls, fn) in MIXED.items():
        template = f"{cls}\n{fn}".replace("{{", "{").replace("}}", "}")
        text = F.replace(F.lit(template), F.lit("{k}"), _s("s_suppkey"))
        files = _lang(_lines(supplier, _text(f"mixed/{lang}/n", _s("s_nationkey"), f".{ext}"), "s_suppkey", text, head=head), lang)
        out = files if out is None else out.unionByName(files)
    return out


#: Suppliers of a file of :func:`shapes`.
SUPPLIERS = 25
#: For each file of a bucket of suppliers: language, path, head, and the lines of a supplier. ``{b}`` is the bucket, ``{k}`` the supplier.
SHAPES = (
    ("go", "shape/app/b{b}.go", 'package app\nimport "x.y/a/util"\n',
     "func One{k}() {}\nfunc Two{k}() {}\nfunc Re{k}() {\n\tf := One{k}\n\tf()\n\tf := Two{k}\n\tf()\n}\nfunc Cl{k}() {\n\tgo func() { One{k}() }()\n}\n"
     "func Ch{k}() {\n\ta := One{k}\n\tb := a\n\tc := b\n\td := c\n\te := d\n\td()\n\te()\n}\nfunc Odd{k}() {\n\tx := NewEven{k}()\n\tx.Go{k}()\n}\nfunc Pk{k}() { util.Help{k}() }"),
    ("go", "shape/kind/b{b}.go", "package kind\n", "func (e *Even{k}) Go{k}() {}\nfunc (u *Uneven{k}) Go{k}() {}"),
    ("go", "shape/a/util/b{b}.go", "package util\n", "func Help{k}() {}"),
    ("go", "shape/b/util/b{b}.go", "package util\n", "func Help{k}() {}"),
    ("go", "shape/clash/b{b}.go", 'package clash\nimport (\n\t"x.y/b/util"\n\t"x.y/a/util"\n)\n', "func Im{k}() { util.Help{k}() }"),
    ("rust", "shape/src/r{b}.rs", "", "fn r_one{k}() {}\nfn r_two{k}() {}\nfn r_re{k}() {\n    let f = r_one{k};\n    f();\n    let f = r_two{k};\n    f();\n}\nfn r_cl{k}() { run(|x| r_one{k}()); }\nfn r_odd{k}() {\n    let x = Even{k}::odd();\n    x.r_go{k}();\n}"),
    ("rust", "shape/src/kind{b}.rs", "", "impl Even{k} { fn r_go{k}(&self) {} }\nimpl Uneven{k} { fn r_go{k}(&self) {} }"),
    ("javascript", "shape/js/b{b}.js", "", "const arrow{k} = (a) => a;\nfunction plain{k}(a) { return a; }"),
    ("cpp", "shape/cpp/b{b}.cpp", "", "class P{k} {\npublic:\n  int proto{k}(int a);\n  int field{k};\n};\nint var{k} = 1;"),
)


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files for each bucket of suppliers, with cases that the other corpora lack: variables bound anew, closures,
    chains of bindings, constructors without a definition, packages of one name, arrow functions, prototypes."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor(F.col("s_suppkey") / SUPPLIERS).cast("string").alias("b"))
    out = None
    for lang, path, head, text in SHAPES:
        written = F.replace(F.lit(text), F.lit("{k}"), _s("s_suppkey"))
        files = _lang(_lines(rows, F.replace(F.lit(path), F.lit("{b}"), F.col("b")), "s_suppkey", written, head=head), lang)
        out = files if out is None else out.unionByName(files)
    return out
