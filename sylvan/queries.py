"""Queries of the engine over corpora written from the tables, with SQL that computes the same from the rows.

Queries over one corpus share its parsed tables and its graph within an application.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.engine import Engine
from sylvan.functions import languages, render
from sylvan.operators.outline import basename
from sylvan.plans import corpora

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


_ENGINES: dict[tuple[str, str, str], Engine] = {}


def over(corpus: Callable[[SparkSession, str], DataFrame], spark: SparkSession, sf_dir: str) -> Engine:
    """The engine of a corpus: parsed once in an application, as its tables are in the shared folder."""
    key = (spark.sparkContext.applicationId, corpus.__name__, sf_dir)
    if key not in _ENGINES:
        _ENGINES[key] = Engine(spark, corpus(spark, sf_dir))
    return _ENGINES[key]


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return put


def searched(corpus: Callable[[SparkSession, str], DataFrame], query: str, *columns, **options) -> Query:
    """Matches of a query in a corpus, as columns of their captures."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = over(corpus, spark, sf_dir).search(query, **options)
        shown = [F.col("path")]
        for i, names in enumerate(columns):
            capture = F.col("captures")[i]
            for field, alias in names.items():
                shown.append(capture[field].alias(alias))
        return found.select(*shown)

    return run


# ---- C: structural search

#: Orders with the line of their function, and their calls with their lines.
_ORDERS = f"""
with n as (select l_orderkey, count(*) as n from lineitem group by 1),
fns as (
  select o_orderkey as o, 'orders/b' || cast(o_orderkey // {corpora.ORDERS} as varchar) || '.c' as path, o_orderstatus as status, substr(o_orderpriority, 1, 1) as priority, coalesce(n, 0) as n,
    1 + coalesce(sum(coalesce(n, 0) + 2) over (partition by o_orderkey // {corpora.ORDERS} order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as line,
    lead(o_orderstatus) over (partition by o_orderkey // {corpora.ORDERS} order by o_orderkey) as following
  from orders left join n on o_orderkey = l_orderkey),
calls as (
  select path, o, f.line as f_line, l_partkey as p, cast(trunc(l_quantity) as int) as q,
    f.line + row_number() over (partition by o order by l_partkey, cast(trunc(l_quantity) as int)) as line
  from fns f join lineitem on o = l_orderkey),
named as (select *, 'order_' || cast(o as varchar) || '_' || status as name from fns)
"""
_HEAD = "'void ' || name || '(int p' || priority || ') {'"

register("search_name", _ORDERS + "select path, cast(line as int) as line, 'part_' || cast(p as varchar) as text from calls where regexp_matches('part_' || cast(p as varchar), '^part_.*7$')"
         " union all select 'parts/b' || cast(p_partkey // 500 as varchar) || '.c', cast(row_number() over (partition by p_partkey // 500 order by p_partkey) as int), 'part_' || cast(p_partkey as varchar) from part qualify p_partkey % 10 = 7")(
    searched(corpora.c_orders, "id#/^part_.*7$/", {"start_line": "line", "text": "text"})
)
register("search_call", _ORDERS + "select path, cast(line as int) as line, 'part_' || cast(p as varchar) || '(' || cast(q as varchar) || ')' as text from calls")(
    searched(corpora.c_orders, "&function", {"start_line": "line", "text": "text"})
)
register("search_definition", _ORDERS + f"select path, cast(line as int) as line, {_HEAD} as text from named where status = 'F'")(
    searched(corpora.c_orders, "*function#/_F$/", {"start_line": "line", "text": "text"})
)
register("search_scoped", _ORDERS + f"select calls.path, cast(f_line as int) as f_line, {_HEAD} as f_text, cast(calls.line as int) as c_line, 'part_' || cast(p as varchar) || '(' || cast(q as varchar) || ')' as c_text from calls join named using (o)")(
    searched(corpora.c_orders, "(*function @f).body((&function @c))", {"start_line": "f_line", "text": "f_text"}, {"start_line": "c_line", "text": "c_text"})
)
register("search_params", _ORDERS + f"select path, cast(line as int) as line, {_HEAD} as text from named where priority = '1'")(
    searched(corpora.c_orders, "*function.params(param#p1)", {"start_line": "line", "text": "text"})
)
register("search_child", _ORDERS + "select path, cast(line as int) as line from fns where n > 0")(
    searched(corpora.c_orders, "block>expression_statement", {"start_line": "line"})
)
register("search_descendant", _ORDERS + "select distinct path, cast(f_line as int) as line from calls where p % 10 = 3")(
    searched(corpora.c_orders, "*function &function#/3$/", {"start_line": "line"})
)
register("search_next_sibling", _ORDERS + "select path, cast(line as int) as line, name from named where status = 'F' and following = 'O'")(
    lambda spark, sf_dir: searched(corpora.c_orders, "*function#/_F$/ + *function#/_O$/", {"start_line": "line", "text": "text"})(spark, sf_dir).select("path", "line", F.regexp_extract("text", r"(order_\w+)", 1).alias("name"))
)
register("search_later_sibling", _ORDERS + "select path, cast(line as int) as line from named x where status = 'F' and exists (select 1 from named y where y.path = x.path and y.o > x.o and y.status = 'P')")(
    searched(corpora.c_orders, "*function#/_F$/ ~ *function#/_P$/", {"start_line": "line"})
)
register("search_literal", _ORDERS + "select path, cast(line as int) as line, cast(q as varchar) as text from calls where q >= 40 and q < 50")(
    searched(corpora.c_orders, "literal#/^4[0-9]$/", {"start_line": "line", "text": "text"})
)
register("search_arguments", _ORDERS + "select path, cast(line as int) as line, 'part_' || cast(p as varchar) || '(' || cast(q as varchar) || ')' as text from calls where q = 7")(
    searched(corpora.c_orders, "&function.params(literal#7)", {"start_line": "line", "text": "text"})
)
register("search_field", _ORDERS + "select path, cast(line as int) as line, cast(q as varchar) as text from calls")(
    lambda spark, sf_dir: over(corpora.c_orders, spark, sf_dir).search("(&function @c).arguments((literal @v))").select("path", F.col("captures")[1]["start_line"].alias("line"), F.col("captures")[1]["text"].alias("text"))
)
register("search_empty_field", _ORDERS + "select path, cast(line as int) as line, '(int p' || priority || ')' as text from fns union all"
         " select 'parts/b' || cast(p_partkey // 500 as varchar) || '.c', cast(row_number() over (partition by p_partkey // 500 order by p_partkey) as int), '(int q)' from part")(
    searched(corpora.c_orders, "*function.params()", {"start_line": "line", "text": "text"})
)
register("search_rendered", _ORDERS + f"select n.path, '@f:' || cast(f_line as varchar) || ': \"' || {_HEAD} || '\", @c:' || cast(calls.line as varchar) || ': \"part_' || cast(p as varchar) || '(' || cast(q as varchar) || ')\"' as rendered from calls join named n using (o)")(
    lambda spark, sf_dir: over(corpora.c_orders, spark, sf_dir).search("(*function @f).body((&function @c))").select("path", "rendered")
)
register("search_body", _ORDERS + f"""select path, '@f:' || cast(line as varchar) || '-' || cast(line + n + 1 as varchar) || ': ' || {_HEAD} || chr(10) || coalesce(texts, '') || '}}' as rendered from named
  left join (select o, string_agg('    part_' || cast(p as varchar) || '(' || cast(q as varchar) || ');' || chr(10), '' order by line) as texts from calls group by o) using (o)""")(
    lambda spark, sf_dir: over(corpora.c_orders, spark, sf_dir).search("(*function#/^order_/ @f)", body=True).select("path", "rendered")
)


# ---- six languages: parsing, types and outlines

_SUP = "with s as (select s_suppkey as k, s_nationkey as n, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as i from supplier)"
_LINES = {lang: (cls.count("\n") + 2, head.count("\n") + 1) for lang, (_, head, cls, _) in corpora.MIXED.items()}


def _outline_sql() -> str:
    parts = []
    # lang -> (kind of the class, name is listed, offset of the method's line, kind of the method)
    shapes = {"c": None, "cpp": ("class", 2), "javascript": ("class", 1), "python": ("class", 1), "rust": ("trait", 1), "go": ("type", None)}
    for lang, shape in shapes.items():
        size, first = _LINES[lang]
        base = f"select 'mixed/{lang}/n' || cast(n as varchar) || '.{corpora.MIXED[lang][0]}' as path"
        at = f"cast({first} + i * {size} as int)"
        if shape:
            parts.append(f"{base}, 0 as depth, '{shape[0]}' as kind, 'K' || cast(k as varchar) as name, {at} as line from s")
            if shape[1]:
                parts.append(f"{base}, 1 as depth, 'fn' as kind, 'run' || cast(k as varchar) as name, {at} + {shape[1]} as line from s")
        parts.append(f"{base}, 0 as depth, 'fn' as kind, 'fn' || cast(k as varchar) as name, {at} + {size - 1} as line from s")
    return _SUP + " " + " union all ".join(parts)


@register("outline", _outline_sql())
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(corpora.mixed, spark, sf_dir).outline().select("path", "depth", "kind", "name", "line")


def _types_sql() -> str:
    """Matches of each abstract type in each language, by the shapes of the corpus."""
    counts = {
        # lang: class, function definitions, calls
        "c": (0, 1, 1), "cpp": (1, 2, 1), "javascript": (1, 2, 1), "python": (1, 2, 1), "rust": (1, 2, 1), "go": (1, 1, 1),
    }
    rows = ", ".join(f"('{lang}', '{t}', {n})" for lang, ns in counts.items() for t, n in zip(("class", "*function", "&function"), ns, strict=True) if n)
    return f"select lang, query, cast(m * (select count(*) from supplier) as bigint) as n from (values {rows}) t(lang, query, m)"


@register("types_by_language", _types_sql())
def types_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes each type matches in each language (in one line of a file each)."""
    engine = over(corpora.mixed, spark, sf_dir)
    out = None
    for query in ("class", "*function", "&function"):
        found = engine.search(query).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", F.lit(query).alias("query"), "n")
        out = found if out is None else out.unionByName(found)
    return out


@register("outline_c", _ORDERS + "select path, 'fn' as kind, name, cast(line as int) as line from named union all"
          " select 'parts/b' || cast(p_partkey // 500 as varchar) || '.c', 'fn', 'part_' || cast(p_partkey as varchar), cast(row_number() over (partition by p_partkey // 500 order by p_partkey) as int) from part")  # fmt: skip
def outline_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(corpora.c_orders, spark, sf_dir).outline().select("path", "kind", "name", "line")



@register("languages_of_files", "select ext, lang, cast((select count(distinct s_nationkey) from supplier) as bigint) as files from (values ('c', 'c'), ('cpp', 'cpp'), ('js', 'javascript'), ('py', 'python'), ('rs', 'rust'), ('go', 'go')) t(ext, lang)")
def languages_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by extension, and the language that the extension tells."""
    files = corpora.mixed(spark, sf_dir).select(F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ext"))
    table = F.create_map(*[F.lit(x) for pair in languages.EXTENSIONS.items() for x in pair])
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("files")).select("ext", F.element_at(table, F.col("ext")).alias("lang"), "files")


# ---- graphs


def edges_of(corpus: Callable[[SparkSession, str], DataFrame]) -> Query:
    """Edges by names: caller, callee, the file of the callee (null: outside), whether it is a guess."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        named = over(corpus, spark, sf_dir).graph.named()
        return named.select("src_path", "src_name", F.col("display").alias("callee"), "dst_path", F.col("dst_line").cast("int").alias("dst_line"), "is_guess")

    return run


_PART_LINES = "(select p_partkey, 'parts/b' || cast(p_partkey // 500 as varchar) || '.c' as path, cast(row_number() over (partition by p_partkey // 500 order by p_partkey) as int) as line from part)"
register("edges_c", _ORDERS + f"select distinct n.path as src_path, name as src_name, 'part_' || cast(p as varchar) as callee, x.path as dst_path, x.line as dst_line, false as is_guess from calls join named n using (o) left join {_PART_LINES} x on p = p_partkey")(edges_of(corpora.c_orders))


@register("edge_ids", _ORDERS + f"select distinct regexp_extract(n.path, '[^/]*$') || ':' || cast(n.line as bigint) as src_id, coalesce(regexp_extract(x.path, '[^/]*$') || ':' || cast(x.line as varchar), 'part_' || cast(p as varchar)) as dst_id, false as is_guess from calls join named n using (o) left join {_PART_LINES} x on p = p_partkey")
def edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(corpora.c_orders, spark, sf_dir).edges().select("src_id", "dst_id", "is_guess").distinct()


_GO = """
with w as (select n_nationkey as n, n_regionkey as r, 'world/r' || cast(n_regionkey as varchar) || '/n' || lpad(cast(n_nationkey as varchar), 2, '0') || '.go' as path from nation),
c as (select c_custkey as k, w.*, cast(row_number() over (partition by n order by c_custkey) + 6 + case when n % 3 = 0 then 1 else 0 end as int) as line from customer join w on c_nationkey = n),
shared as (select *, 8 - 1 as line from w where n % 3 = 0),
"""
#: A call of Shared: own file, else the package, else a package that is imported, else anywhere.
_SHARED = """
own as (select k, c.path as src_path, s.path as dst_path, false as is_guess from c join shared s using (path)),
pack as (select k, c.path as src_path, min(s.path) as dst_path, count(*) > 1 as is_guess from c join shared s on c.r = s.r where k not in (select k from own) group by all),
every as (select k, c.path as src_path, coalesce((select min(path) from shared s where s.r = (c.r + 1) % 5), (select min(path) from shared)) as dst_path, (select count(*) from shared) > 1 as is_guess
  from c where k not in (select k from own) and k not in (select k from pack))
"""
register("edges_go", _GO + _SHARED + """
select src_path, 'Cust' || cast(k as varchar) as src_name, callee, dst_path, cast(dst_line as int) as dst_line, is_guess from (
  select c.path as src_path, c.k, 'Cust' || cast(c.k // 2 as varchar) as callee, d.path as dst_path, d.line as dst_line, false as is_guess from c left join c d on d.k = c.k // 2
  union all select path, k, 'Local', path, 6, false from c
  union all select src_path, k, 'Shared', dst_path, 7, is_guess from (select * from own union all select * from pack union all select * from every)
  union all select path, k, 'Region' || cast((r + 1) % 5 as varchar), case when (r + 1) % 5 in (select n_regionkey from nation) then 'world/r' || cast((r + 1) % 5 as varchar) || '/region.go' end, 2, false from c
  union all select path, k, 'Println', null, null, false from c)
""")(edges_of(corpora.go_world))  # fmt: skip


@register("edges_go_dispatch", """
with s as (select s_suppkey as k, s_acctbal >= 0 as stops, 'work/n' || lpad(cast(s_nationkey as varchar), 2, '0') || '/sup.go' as path from supplier),
both_ as (select * from s where stops)
select 'UseSup' || cast(u.k as varchar) as src_name, callee, dst, is_guess from s u, lateral (
  select 'Run' as callee, b.k as dst, (select count(*) from both_) > 1 as is_guess from both_ b
  union all select 'NewSup' || cast(u.k as varchar), u.k, false
  union all select 'Run', u.k, false where not u.stops
  union all select 'Stop', u.k, false where u.stops
  union all select 'Stop', x.k, (select count(*) from both_) + 1 > 1 from (select k from both_ where not u.stops order by path <> u.path, path, k limit 1) x) t
""")  # fmt: skip
def edges_go_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls through an interface, by a constructor's result, and of a method that a type lacks: callee and the
    number of the supplier whose method it is."""
    return _dispatched(over(corpora.go_dispatch, spark, sf_dir))


def _dispatched(engine: Engine) -> DataFrame:
    named = engine.graph.named(dst=F.nullif(F.regexp_extract(F.concat_ws("/", "qualified"), r"Sup(\d+)", 1), F.lit("")).cast("long"))
    return named.select("src_name", F.col("display").alias("callee"), "dst", "is_guess")


register("edges_rust_paths", """
with c as (select c_custkey as k, 'app/src/geo/n' || cast(c_nationkey as varchar) || '.rs' as path, 'app/src/use/n' || cast(c_nationkey as varchar) || '.rs' as use_path,
  cast(row_number() over (partition by c_nationkey order by c_custkey) as int) as line from customer)
select use_path as src_path, 'call_' || cast(k as varchar) as src_name, callee, case when found then path end as dst_path, case when found then line end as dst_line, false as is_guess from c, lateral (
  select 'a' || cast(k as varchar) as callee, true as found union all select 'cust_' || cast(k as varchar), true union all select 'cust_' || cast(k as varchar), false) t
""")(edges_of(corpora.rust_mods))  # fmt: skip


@register("edges_rust_traits", """
with s as (select s_suppkey as k, s_acctbal >= 0 as stops from supplier),
own as (select * from s where stops), n as (select count(*) as n from s),
targets as (select k as dst from own union all select null where exists (select 1 from s where not stops))
select 'use_' || cast(u.k as varchar) as src_name, callee, dst, is_guess from s u, lateral (
  select 'stop' as callee, dst, (select count(*) from targets) > 1 as is_guess from targets
  union all select 'run', r.k, (select n from n) > 1 from s r
  union all select 'make', u.k, false) t
union all
select 'run', 'stop', k, false from s where stops
union all select 'run', 'stop', null, false from s where not stops
""")  # fmt: skip
def edges_rust_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls through a trait, a bound, a constructor's result and self: callee and the number of the supplier whose
    method it is (null: the trait's default)."""
    return _dispatched(over(corpora.rust_traits, spark, sf_dir))


_CHAIN = """
with recursive up(depth, k, seen) as (
  select 0, cast(1 as bigint), [cast(1 as bigint)]
  union all
  select depth + 1, c_custkey, list_append(seen, c_custkey) from up join customer on c_custkey // 2 = k where depth < 5 and not list_contains(seen, c_custkey))
"""


@register("callers", _CHAIN + "select cast(depth as int) as depth, 'Cust' || cast(k as varchar) as name, false as cycle from up where depth > 0")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls Cust1, down to five calls."""
    found = over(corpora.go_world, spark, sf_dir).callers("Cust1", 5)
    return found.select("depth", F.col("display").alias("name"), "cycle")


@register("callees", """
with recursive down(depth, k, cycle) as (
  select 0, (select max(c_custkey) from customer), false
  union all select depth + 1, k // 2, k = 0 from down where depth < 20 and not cycle)
select cast(depth as int) as depth, 'Cust' || cast(k as varchar) as name, cycle from down where depth > 0
""")  # fmt: skip
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of calls from the last customer to Cust0, which calls itself."""
    last = spark.read.parquet(f"{sf_dir}/customer.parquet").agg(F.max("c_custkey")).first()[0]
    found = over(corpora.go_world, spark, sf_dir).callees(f"Cust{last}", 20)
    return found.where(F.col("display").startswith("Cust")).select("depth", F.col("display").alias("name"), "cycle")


@register("definition_by_name", "select 'world/r' || cast(n_regionkey as varchar) || '/n' || lpad(cast(n_nationkey as varchar), 2, '0') || '.go' as path, 6 as line, 'Local' as name, (select count(*) from nation) > 1 as is_guess from nation")
def definition_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(corpora.go_world, spark, sf_dir).definition("Local")


@register("definition_by_package", "select 'world/r3/region.go' as path, 2 as line, 'Region3' as name, false as is_guess from (select distinct n_regionkey from nation where n_regionkey = 3)")
def definition_by_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(corpora.go_world, spark, sf_dir).definition("r3.Region3")


@register("definition_by_path", "select 'work/src/n' || lpad(cast(s_nationkey as varchar), 2, '0') || '.rs' as path, cast(3 + o + 0 as int) as line, 'make' as name, false as is_guess from"
          " (select *, coalesce(sum(case when s_acctbal >= 0 then 14 else 13 end) over (partition by s_nationkey order by s_suppkey rows between unbounded preceding and 1 preceding), 0) as o from supplier) where s_suppkey = 7")  # fmt: skip
def definition_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(corpora.rust_traits, spark, sf_dir).definition("Sup7::make")


@register("definitions_indexed", """
select 'work/n' || lpad(cast(s_nationkey as varchar), 2, '0') || '/sup.go' as path, name, kind, receiver, ret from supplier, lateral (
  select 'Run' as name, 'method' as kind, 'Sup' || cast(s_suppkey as varchar) as receiver, cast(null as varchar) as ret
  union all select 'Stop', 'method', 'Sup' || cast(s_suppkey as varchar), null where s_acctbal >= 0
  union all select 'NewSup' || cast(s_suppkey as varchar), 'function', null, 'Sup' || cast(s_suppkey as varchar)
  union all select 'UseSup' || cast(s_suppkey as varchar), 'function', null, null) t
union all select 'work/worker.go', name, 'signature', 'Worker', null from (values ('Run'), ('Stop')) t(name)
""")  # fmt: skip
def definitions_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(corpora.go_dispatch, spark, sf_dir).definitions.select("path", "name", "kind", "receiver", "ret")


@register("edges_mixed")
def edges_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are the same in all languages: ambiguous for those that match by name only."""
    named = over(corpora.mixed, spark, sf_dir).graph.named()
    return named.select(basename(F.col("src_path")).alias("src"), "src_name", "display", "dst_path", "is_guess")


# methods in a class of C++ are in the outline, but no function pattern reaches their names: their calls have no edge
ORACLES["edges_mixed"] = """
select regexp_extract(path, '[^/]*$') as src, src_name, 'fn' || k as display, case when own then path end as dst_path, false as is_guess
from (select cast(s_suppkey as varchar) as k, cast(s_nationkey as varchar) as n from supplier), lateral (
  select 'mixed/' || lang || '/n' || n || '.' || ext as path, caller || k as src_name, own
  from (values ('c', 'c', 'fn', false), ('javascript', 'js', 'run', false), ('python', 'py', 'run', false), ('rust', 'rs', 'run', true), ('go', 'go', 'fn', true)) t(lang, ext, caller, own)) t
"""


# ---- what structure alone tells: embedded fields, any node, variants without a name

register("search_embedded_body", _ORDERS + "select distinct path, cast(f_line as int) as line from calls where p % 10 = 3")(
    searched(corpora.c_orders, "(*function.body(&function#/3$/) @f)", {"start_line": "line"})
)
register("search_embedded_field", _ORDERS + "select path, cast(line as int) as line, 'part_' || cast(p as varchar) || '(' || cast(q as varchar) || ')' as text from calls where p % 10 = 7")(
    searched(corpora.c_orders, "(&function.function(id#/7$/) @c)", {"start_line": "line", "text": "text"})
)
register("search_any_node", _ORDERS + "select path, cast(line as int) as line, 'part_' || cast(p as varchar) as text from calls where p = 7"
         " union all select 'parts/b' || cast(p_partkey // 500 as varchar) || '.c', cast(row_number() over (partition by p_partkey // 500 order by p_partkey) as int), 'part_7' from part qualify p_partkey = 7")(
    searched(corpora.c_orders, "#part_7", {"start_line": "line", "text": "text"})
)

#: Suppliers with their bucket, and the place in it.
_SHAPE = f"with s as (select cast(s_suppkey as varchar) as k, s_suppkey // {corpora.SUPPLIERS} as bucket, cast(s_suppkey // {corpora.SUPPLIERS} as varchar) as b, row_number() over (partition by s_suppkey // {corpora.SUPPLIERS} order by s_suppkey) - 1 as i from supplier)"

register("search_arrow", _SHAPE + " select 'shape/js/b' || b || '.js' as path, cast(1 + 2 * i as int) as line, '(a) => a' as text from s")(
    searched(corpora.shapes, "*function#no_such_name", {"start_line": "line", "text": "text"})
)
register("search_prototype", _SHAPE + " select 'shape/cpp/b' || b || '.cpp' as path, cast(3 + 6 * i as int) as line, 'int proto' || k || '(int a);' as text from s")(
    searched(corpora.shapes, "class (*function @p)", {"start_line": "line", "text": "text"})
)
register("outline_shapes", _SHAPE + """
select 'shape/cpp/b' || b || '.cpp' as path, depth, kind, name || k as name, cast(place + 6 * i as int) as line from s,
  (values (0, 'class', 'P', 1), (1, 'fn', 'proto', 3), (0, 'var', 'var', 6)) t(depth, kind, name, place)
union all
select 'shape/js/b' || b || '.js', 0, 'fn', name || k, cast(place + 2 * i as int) from s, (values ('arrow', 1), ('plain', 2)) t(name, place)
""")(lambda spark, sf_dir: over(corpora.shapes, spark, sf_dir).outline().where("path like '%.cpp' or path like '%.js'").select("path", "depth", "kind", "name", "line"))  # fmt: skip

_SHAPE_EDGES = """
select 'shape/{app}/b' || b || '.{ext}' as src_path, src || k as src_name, display || case when named then k else '' end as callee, case when dst is not null then 'shape/' || folder || b || '.{ext}' end as dst_path,
  dst || k as dst_name, false as is_guess from s, (values {rows}) t(src, display, named, folder, dst)
"""


def _shape_edges(rows: str, app: str, ext: str) -> str:
    return _SHAPE_EDGES.format(rows=rows, app=app, ext=ext)


register("edges_shapes_go", _SHAPE + _shape_edges(
    "('Re', 'f', false, 'app/b', 'One'), ('Re', 'f', false, 'app/b', 'Two'), ('Cl', 'One', true, 'app/b', 'One'), ('Ch', 'd', false, 'app/b', 'One'), ('Ch', 'e', false, null, null),"
    " ('Odd', 'NewEven', true, null, null), ('Odd', 'Go', true, 'kind/b', 'Go'), ('Pk', 'Help', true, 'a/util/b', 'Help')", "app", "go")
    + " union all " + _shape_edges("('Im', 'Help', true, 'b/util/b', 'Help')", "clash", "go"))(
    lambda spark, sf_dir: _named_edges(spark, sf_dir, ".go")
)
register("edges_shapes_rust", _SHAPE + """
select 'shape/src/r' || b || '.rs' as src_path, src || k as src_name, display || case when named then k else '' end as callee, case when dst is not null then 'shape/src/' || folder || b || '.rs' end as dst_path,
  dst || k as dst_name, false as is_guess from s, (values ('r_re', 'f', false, 'r', 'r_one'), ('r_re', 'f', false, 'r', 'r_two'), ('r_cl', 'run', false, null, null), ('r_cl', 'r_one', true, 'r', 'r_one'),
  ('r_odd', 'odd', false, null, null), ('r_odd', 'r_go', true, 'kind', 'r_go')) t(src, display, named, folder, dst)
""")(lambda spark, sf_dir: _named_edges(spark, sf_dir, ".rs"))  # fmt: skip


def _named_edges(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    """Edges of one language of the shapes, with the names of both ends."""
    named = over(corpora.shapes, spark, sf_dir).graph.named().where(F.col("src_path").endswith(ext))
    return named.select("src_path", "src_name", F.col("display").alias("callee"), "dst_path", "dst_name", "is_guess")


# ---- texts

_LAST = "case when i = max(i) over (partition by bucket) then '└── ' else '├── ' end"
register("outline_text", _SHAPE + f"""
select 'shape/cpp/b' || b || '.cpp' as path, string_agg('├── class P' || k || '  :' || cast(1 + 6 * i as varchar) || chr(10) || '│   └── fn proto' || k || '  :' || cast(3 + 6 * i as varchar) || chr(10)
  || last || 'var var' || k || '  :' || cast(6 + 6 * i as varchar) || chr(10), '' order by i) as text from (select *, {_LAST} as last from s) group by b
union all
select 'shape/js/b' || b || '.js', string_agg('├── fn arrow' || k || '  :' || cast(1 + 2 * i as varchar) || chr(10) || last || 'fn plain' || k || '  :' || cast(2 + 2 * i as varchar) || chr(10), '' order by i)
from (select *, {_LAST} as last from s) group by b
""")(lambda spark, sf_dir: render.outline_texts(over(corpora.shapes, spark, sf_dir).outline().where("path like '%.cpp' or path like '%.js'")))

#: Edges of the Rust files: caller's line and name, callee's file, line and name (or the bare name of what is outside).
_RUST_EDGES = _SHAPE + """, e as (select 'r' || b || '.rs:' || cast(13 * i + f_line as varchar) as src_id, src || k as src_name, case when to_line is null then dst else folder || b || '.rs:' || cast(width * i + to_line as varchar) end as dst_id, dst || case when to_line is null then '' else k end as dst_name, to_line
  from s, (values (3, 'r_re', 'r', 13, 1, 'r_one'), (3, 'r_re', 'r', 13, 2, 'r_two'), (9, 'r_cl', null, null, null, 'run'), (9, 'r_cl', 'r', 13, 1, 'r_one'), (10, 'r_odd', null, null, null, 'odd'), (10, 'r_odd', 'kind', 2, 1, 'r_go')) t(f_line, src, folder, width, to_line, dst))
"""


def _rust(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("src_id").rlike(r"^r\d+\.rs:"))


register("edge_list_text", _RUST_EDGES + "select src_id || ' -> ' || dst_id as text from e")(
    lambda spark, sf_dir: _rust(render.edge_lines(over(corpora.shapes, spark, sf_dir).edges())).select("text")
)
register("dot_text", _RUST_EDGES + """
select distinct '    "' || id || '" [label="' || name || '\\n' || id || '"];' as text from (select src_id as id, src_name as name from e union all select dst_id, dst_name from e where to_line is not null)
union all select '    "' || src_id || '" -> "' || dst_id || '";' from e
""")(lambda spark, sf_dir: _dot_text(spark, sf_dir))
register("definition_text", _SHAPE + " select 'shape/src/r' || b || '.rs:' || cast(13 * i + 1 as varchar) || ': fn r_one7() {}' as text from s where k = '7'")(
    lambda spark, sf_dir: _definition_text(spark, sf_dir)
)
register("call_tree_text", _SHAPE + """
select cast(n as bigint) as n, text from (select 'r' || b || '.rs:' || cast(13 * i + 1 as varchar) as one from s where k = '7'),
  lateral (select 0 as n, 'r_cl7()' as text union all select 1, '├── r_one7()  [' || one || ']' union all select 2, '└── run()') t
""")(lambda spark, sf_dir: _call_tree_text(spark, sf_dir))  # fmt: skip


def _dot_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = render.dot_lines(over(corpora.shapes, spark, sf_dir).edges())
    return nodes.where(F.col("id").rlike(r"^(r|kind)\d+\.rs:")).select("text").unionByName(_rust(edges).select("text"))


def _definition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = over(corpora.shapes, spark, sf_dir)
    return render.definition_lines(engine.definition("r_one7"), engine.files).select("text")


def _call_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one function calls, drawn on the driver: a tree of one name and a bounded depth."""
    lines = over(corpora.shapes, spark, sf_dir).callees_text("r_cl7").splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "n long, text string")
