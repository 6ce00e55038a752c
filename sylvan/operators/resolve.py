"""From call sites to definitions, as a cascade of joins.

A call site asks a series of *requests*, by step; the first step that has an answer
decides. A request names a key of the index of definitions (a name, a name with its
receiver, the end of a qualified path, ...). The answer is the key's only definition
(exact), or of several the best by locality (guess): in the same file, in the same
folder, imported, anywhere, and then by file and line. The index is aggregated first:
number and best of a key, of a key in a file, of a key in a folder, of a key under an
import. So a request meets one row each, however many definitions share a name.

Receivers' types come from the last binding of a variable at or before the call (an as-of
join), which may ask about another call: up to ``LEVELS`` nested lookups are expanded, and
answered from the innermost out.

Calls through an interface or trait go to all types that implement it. These targets are a *group*, and
a site keeps the group's key: what is written grows with the sites and with the members, and the pairs
of both (:func:`met`) are made where a result asks for them, in a stage that writes no shuffle after it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylvan.operators.outline import definitions, folder
from sylvan.runtime import discard, materialise, together

LEVELS = 5
SEP = "\x01"
ITEM = ("path", "ord", "level")
CALLEE = ("ckind", "name", "segs", "rkind", "recv")
#: Sites, and members, of a group that meet in one key; pairs of a task.
BLOCK, PAIRS = 2048, 1 << 23


def _key(kind: str, *parts) -> Column:
    return F.concat_ws(SEP, F.lit(kind), *parts)


def _ends(array: Column, least: int) -> Column:
    """The ends of an array, from ``least`` elements on."""
    lengths = F.filter(F.sequence(F.lit(0), F.size(array)), lambda n: n >= least)
    return F.transform(lengths, lambda n: F.slice(array, F.size(array) - n + 1, n))


def _upper(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\p{Lu}"), F.lit(False))


class Index:
    """Definitions by key."""

    def __init__(self, defs: DataFrame):
        self.defs = defs
        name, q, pkg = F.col("name"), F.col("qualified"), F.col("pkg")
        module = F.slice(q, F.lit(1), F.greatest(F.size(q) - 1, F.lit(0)))
        method, function = F.col("kind") == "method", F.col("kind") == "function"
        keys = F.concat(
            F.array(_key("n", name), F.when(method, _key("nm", name)).otherwise(_key("no", name))),
            F.when(function, F.array(_key("f", name))).otherwise(F.array()),
            F.when(method, F.array(_key("m", F.col("receiver"), name))).otherwise(F.array()),
            F.transform(_ends(q, 1), lambda e: _key("q", F.concat_ws("::", e))),
            F.transform(_ends(module, 0), lambda e: _key("g", F.concat_ws("::", e), name)),
            F.when(function, F.transform(_ends(pkg, 1), lambda e: _key("p", F.concat_ws("/", e), name))).otherwise(F.array()),
            F.when(function & (F.size(pkg) > 0), F.array(_key("d", F.element_at(pkg, -1), name))).otherwise(F.array()),
        )
        imported = F.concat(
            F.when(F.size(pkg) > 0, F.array(_key("G", F.element_at(pkg, -1)))).otherwise(F.array()),
            F.transform(_ends(q, 1), lambda e: _key("Q", F.concat_ws("::", e))),
            F.transform(_ends(module, 0), lambda e: _key("M", F.concat_ws("::", e))),
        )
        best = F.struct("path", "line", "ord", "def_id")
        self.rows = defs.select("path", "dir", best.alias("best"), F.explode(F.array_distinct(keys)).alias("key"), imported.alias("imported"))
        number = lambda n, of, *by: materialise(self.rows.groupBy("key", *by).agg(F.count(F.lit(1)).alias(n), F.min("best").alias(of)), f"index-{of}")
        self.all, self.file, self.dir = together(lambda: number("n", "best"), lambda: number("n_file", "best_file", "path"), lambda: number("n_dir", "best_dir", "dir"))

    def answer(self, requests: DataFrame, imports: DataFrame | None) -> DataFrame:
        """path, ord, level, step, best, guess from requests (path, ord, level, step, how, key, total):
        how: file, dir, any; total: the key whose number tells a guess. ``imports``: (path, ikey);
        None: no file has any."""
        r = requests.withColumn("dir", folder(F.col("path")))
        r = r.join(self.all, "key").join(self.all.select(F.col("key").alias("total"), F.col("n").alias("n_total")), "total")
        r = r.join(self.file, ["key", "path"], "left").join(self.dir, ["key", "dir"], "left")
        r = r.where((F.col("how") == "any") | (F.col("how") == "file") & F.col("best_file").isNotNull() | (F.col("how") == "dir") & F.col("best_dir").isNotNull())
        number = F.when(F.col("how") == "file", F.col("n_file")).when(F.col("how") == "dir", F.col("n_dir")).otherwise(F.col("n_total"))
        near = F.when((F.col("how") == "dir") | (F.col("best_file").isNull()), F.struct(F.lit(1).alias("loc"), F.col("best_dir").alias("best"))).otherwise(F.struct(F.lit(0).alias("loc"), F.col("best_file").alias("best")))
        r = r.select(*ITEM, "step", "key", number.alias("number"), F.col("best").alias("any"), F.when(near["best"].isNotNull(), near).alias("near"))
        r = materialise(r, "requests")
        r = r.withColumn("imported", F.lit(None).cast(r.schema["any"].dataType)) if imports is None else self.under_imports(r, imports)
        chosen = F.when((F.col("number") > 1) & F.col("near").isNotNull(), F.col("near"))
        chosen = F.coalesce(chosen, F.when((F.col("number") > 1) & F.col("imported").isNotNull(), F.struct(F.lit(2).alias("loc"), F.col("imported").alias("best"))), F.struct(F.lit(3).alias("loc"), F.col("any").alias("best")))
        one = r.withColumn("chosen", F.when(F.col("number") == 1, F.struct(F.coalesce(F.col("near.loc"), F.when(F.col("imported").isNotNull(), 2), F.lit(3)).alias("loc"), F.coalesce("near.best", "any").alias("best"))).otherwise(chosen))
        # a step may ask for several keys (imports of a file); the same definition may answer twice
        out = one.groupBy(*ITEM, "step").agg(F.min("chosen").alias("c"), F.max("number").alias("most"), F.min("any").alias("a"), F.max("any").alias("b"))
        return out.select(*ITEM, "step", F.col("c.best").alias("best"), ((F.col("most") > 1) | (F.col("a") != F.col("b"))).alias("guess"))

    def under_imports(self, r: DataFrame, imports: DataFrame) -> DataFrame:
        """With the best definition of a key under an import of the file."""
        # only where several are far off do imports matter
        far = r.where("number > 1 and near is null")
        wanted = far.select("key").distinct()
        under = self.rows.join(wanted, "key", "left_semi").select("key", "best", F.explode("imported").alias("ikey")).groupBy("key", "ikey").agg(F.min("best").alias("best"))
        met = far.select("path", "key").distinct().join(imports, "path").join(under, ["key", "ikey"]).groupBy("path", "key").agg(F.min("best").alias("imported"))
        return r.join(met, ["path", "key"], "left")


def dispatch_go(defs: DataFrame) -> DataFrame:
    """owner, name, best, guess: methods that a call of an interface's method goes to. A type implements
    an interface if it has methods of all its names; candidates come from the interface's rarest one."""
    sigs = defs.where("kind = 'signature'").select(F.col("receiver").alias("owner"), "name").distinct()
    methods = defs.where("kind = 'method'").select(F.col("receiver").alias("type"), "name").distinct()
    rarity = methods.groupBy("name").agg(F.count(F.lit(1)).alias("types"))
    counted = sigs.join(rarity, "name", "left").withColumn("types", F.coalesce("types", F.lit(0)))
    rarest = counted.groupBy("owner").agg(F.min(F.struct("types", "name")).alias("r"), F.count(F.lit(1)).alias("need"))
    maybe = rarest.select("owner", "need", F.col("r.name").alias("name")).join(methods, "name").select("owner", "need", "type")
    held = maybe.join(sigs, "owner").join(methods, ["type", "name"]).groupBy("owner", "type").agg(F.count(F.lit(1)).alias("held"), F.first("need").alias("need"))
    types = held.where("held = need").select("owner", "type")
    best = F.struct("path", "line", "ord", "def_id")
    targets = types.join(sigs, "owner").join(defs.where("kind = 'method'").select(F.col("receiver").alias("type"), "name", best.alias("best")), ["type", "name"]).select("owner", "name", "best").distinct()
    return _or_signature(targets, defs)


def dispatch_rust(defs: DataFrame, impls: DataFrame) -> DataFrame:
    """The same for traits: of each type that implements the trait its own method, else the default."""
    best = F.struct("path", "line", "ord", "def_id")
    first = lambda d, *by: d.groupBy(*by).agg(F.min(F.struct("path", "ord", best.alias("best"))).alias("f"))
    default = first(defs.where("kind = 'method' and via_trait is null").withColumnRenamed("receiver", "owner"), "owner", "name").select("owner", "name", F.col("f.best").alias("default"))
    names = defs.where("kind = 'signature'").select(F.col("receiver").alias("owner"), "name").union(default.select("owner", "name")).distinct()
    traits = impls.select(F.col("receiver").alias("owner"), F.col("name").alias("type")).distinct()
    own = first(defs.where("kind = 'method'").withColumnRenamed("receiver", "type"), "type", "name").select("type", "name", F.col("f.best").alias("own"))
    met = names.join(traits, "owner").join(own, ["type", "name"], "left").join(default, ["owner", "name"], "left")
    targets = met.select("owner", "name", F.coalesce("own", "default").alias("best")).where("best is not null").distinct()
    # a default is found as a method where no type implements the trait
    return _or_signature(targets, defs, traits)


def _or_signature(targets: DataFrame, defs: DataFrame, implemented: DataFrame | None = None) -> DataFrame:
    """With the signature itself where nothing implements it; several targets are guesses."""
    number = targets.groupBy("owner", "name").agg(F.count(F.lit(1)).alias("n"))
    known = targets.join(number, ["owner", "name"]).select("owner", "name", "best", (F.col("n") > 1).alias("guess"))
    sigs = defs.where("kind = 'signature'").groupBy(F.col("receiver").alias("owner"), "name").agg(F.min(F.struct("path", "ord", F.struct("path", "line", "ord", "def_id").alias("best"))).alias("f"))
    lone = sigs.join(number, ["owner", "name"], "left_anti")
    if implemented is not None:
        lone = lone.join(implemented.select("owner").distinct(), "owner", "left_anti")
    return known.unionByName(lone.select("owner", "name", F.col("f.best").alias("best"), F.lit(False).alias("guess")))


@dataclass
class Groups:
    """Calls that go to all members of a group. ``sites``: caller, display, first, grp, the targets that an earlier site
    of the same caller and display has (``but``) and the groups (``earlier``); ``members``: grp, target, and
    the groups that have it, too, where sites need that (``also``); ``deal``: tasks that the pairs are dealt to."""

    sites: DataFrame
    members: DataFrame
    deal: int


def placed(calls: DataFrame) -> DataFrame:
    """``first`` as columns."""
    more = ("line", "path", "ord")
    return calls.select(*[c for c in calls.columns if c != "first"], *[F.col("first")[c].alias(c) for c in more], F.col("first.guess").alias("is_guess"))


def met(sites: DataFrame, members: DataFrame, deal: int) -> DataFrame:
    """The pairs of sites and members of a group, but those of which an earlier site has the target. Both come in blocks,
    so that a group is many keys."""
    block = lambda by, n: F.pmod(F.xxhash64(*by), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["grp", "s_block", "m_block"]
    left = sites.withColumn("s_block", block(("caller", "display"), "s_blocks")).withColumn("m_block", every("m_blocks"))
    here = F.filter("but", lambda t: block((t,), "m_blocks") == F.col("m_block"))  # most blocks have none of them
    left = left.withColumn("but", F.when(F.size(here) > 0, here)).drop("s_blocks", "m_blocks")
    right = members.withColumn("m_block", block(("target",), "m_blocks")).withColumn("s_block", every("s_blocks")).drop("s_blocks", "m_blocks")
    out = left.repartition(deal, *keys).join(right.repartition(deal, *keys), keys)
    out = out.where(F.col("but").isNull() | ~F.array_contains("but", F.col("target")))
    return out.where(F.col("earlier").isNull() | F.col("also").isNull() | ~F.arrays_overlap("earlier", "also")).drop(*keys, "but", "earlier", "also")


class Resolver:
    """Calls of a whole table of relations."""

    def __init__(self, rel: DataFrame):
        self.rel = rel
        self.defs = materialise(definitions(rel), "defs")
        self.languages = {r["lang"] for r in rel.select("lang").distinct().collect()} & {"go", "rust"}  # as many rows as languages
        if self.languages:
            self.scopes(rel)

    def scopes(self, rel: DataFrame) -> None:
        """What calls in Rust and Go resolve by."""
        last = F.max(F.struct("ord", "segs")).alias("m")
        imports = rel.where("rel = 'import'").groupBy("path", "lang", "name").agg(last).select("path", "lang", F.col("name").alias("local"), F.col("m.segs").alias("route"))
        globs = rel.where("rel = 'glob'").select("path", "lang", F.col("segs").alias("route")).distinct()
        made = {"go": lambda: materialise(dispatch_go(self.defs), "dispatch-go"), "rust": lambda: materialise(dispatch_rust(self.defs, rel.where("rel = 'impl'")), "dispatch-rust")}
        langs = sorted(self.languages)
        self.index, self.imports, self.globs, *targets = together(lambda: Index(self.defs), lambda: materialise(imports, "imports"), lambda: materialise(globs, "globs"), *(made[x] for x in langs))
        # owners of both languages may share a name
        members = reduce(DataFrame.unionByName, [t.select(F.lit(x).alias("lang"), _key(x, "owner", "name").alias("grp"), "owner", "name", "best", "guess") for x, t in zip(langs, targets, strict=True)])
        number = members.groupBy("grp", "lang", "owner", "name").agg(F.count(F.lit(1)).alias("n"), F.min("best").alias("best"), F.max("guess").alias("guess"))
        self.members = members.select("grp", F.col("best.def_id").alias("target"))
        self.groups = materialise(number, "groups")
        go, q, m = F.col("lang") == "go", _key("Q", F.concat_ws("::", "route")), _key("M", F.concat_ws("::", "route"))
        g = F.when(F.size("route") > 0, _key("G", F.element_at("route", -1)))
        ikeys = self.imports.select("path", F.explode(F.when(go, F.array(g)).otherwise(F.array(q, m))).alias("ikey"))
        self.ikeys = materialise(ikeys.union(self.globs.select("path", F.when(go, g).otherwise(m))).where("ikey is not null").distinct(), "import-keys")
        self.ikeys = None if self.ikeys.isEmpty() else self.ikeys
        self.bindings = rel.where("rel = 'binding'").select("path", "fn_line", F.col("line").alias("b_line"), "var", F.struct("ord", "bkind", "type", *CALLEE).alias("b"))
        self.params = rel.where("rel = 'param'").groupBy("path", "fn_line", "var").agg(F.min(F.struct("ord", "type")).alias("p")).select("path", "fn_line", "var", F.col("p.type").alias("param_type"))
        self.bounds = rel.where("rel = 'bound'").select("path", "fn_line", F.col("var").alias("type_param"), F.struct("ord", F.col("type").alias("trait")).alias("bound"))
        self.fns = rel.where("rel = 'fn'").groupBy("path", F.col("line").alias("fn_line")).agg(F.max(F.struct("ord", "receiver", "via_trait")).alias("f")).select("path", "fn_line", F.col("f.receiver").alias("impl_type"), F.col("f.via_trait").alias("trait_name"))

    # ---- call sites

    def sites(self) -> DataFrame:
        """Call sites with the definition that they are in."""
        calls = self.rel.where("rel = 'call'")
        at = self.defs.groupBy("path", F.col("line").alias("fn_line")).agg(F.max(F.struct("ord", "def_id")).alias("d")).select("path", "fn_line", F.col("d.def_id").alias("caller"))
        scoped = calls.where("ckind <> 'name'").join(at, ["path", "fn_line"])
        own = self.defs.select("path", F.col("line").alias("fn_line"), F.col("name").alias("kind"), F.col("def_id").alias("caller"))
        named = calls.where("ckind = 'name'").join(own, ["path", "fn_line", "kind"])
        columns = ["path", "lang", "ord", "fn_line", "line", "caller", *CALLEE]
        return scoped.select(*columns).unionByName(named.select(*columns))

    def expand(self, items: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Items with the last binding of their variable, and the items of the next level."""
        var = F.when(F.col("ckind") == "bare", F.col("name")).when((F.col("ckind") == "method") & (F.col("rkind") == "var"), F.col("recv"))
        items = items.withColumn("var", var)
        bound = items.where("var is not null").select(*ITEM, "fn_line", "line", "var").join(self.bindings, ["path", "fn_line", "var"]).where("b_line <= line")
        last = bound.groupBy(*ITEM).agg(F.max("b").alias("b"))  # the greatest number in the document
        items = materialise(items.join(last, list(ITEM), "left"), "items")
        asks = ((F.col("ckind") == "bare") & (F.col("b.bkind") == "value")) | ((F.col("ckind") == "method") & (F.col("b.bkind") == "call"))
        deeper = items.where(asks).select("path", "lang", "ord", (F.col("level") + 1).alias("level"), "fn_line", "line", *[F.col(f"b.{c}").alias(c) for c in CALLEE])
        return items, deeper

    def calls(self) -> tuple[DataFrame, Groups | None]:
        """caller, display, line, target (null: outside), is_guess, path, ord of every resolved site, and the calls
        that go to groups; of equal (caller, display, target) the first site."""
        sites = materialise(self.sites(), "sites")
        # other languages: a name that one definition in the whole project has
        best = F.struct("path", "line", "ord", "def_id")
        lone = self.defs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best")).where("n = 1")
        none = F.lit(None).cast("string").alias("grp")
        hits = sites.where("ckind = 'name'").select("path", "ord", "name").distinct().join(lone, "name").select("path", "ord", "best", F.lit(False).alias("guess"), none)
        if self.languages:
            hits = hits.unionByName(self.cascade(sites.where("ckind <> 'name'")).select("path", "ord", "best", "guess", "grp"))
        found = sites.join(hits, ["path", "ord"], "left")
        target = F.when(F.col("grp").isNull(), F.col("best.def_id")).alias("target")
        rows = found.select("caller", F.col("name").alias("display"), target, "grp", F.struct("path", "ord", "line", F.coalesce("guess", F.lit(False)).alias("guess")).alias("first"))
        rows = materialise(rows.groupBy("caller", "display", "target", "grp").agg(F.min("first").alias("first")), "found")
        direct, groups = rows.where("grp is null").drop("grp"), None
        if self.languages:
            direct, groups = self.grouped(direct, rows.where("grp is not null").drop("target"))
        return materialise(placed(direct), "calls"), groups

    def grouped(self, direct: DataFrame, via: DataFrame) -> tuple[DataFrame, Groups | None]:
        """The calls of one target, and those of groups, so that of equal (caller, display, target) the first is left."""
        number = self.groups.select("grp", "n").join(via.groupBy("grp").agg(F.count(F.lit(1)).alias("sites")), "grp")
        blocks = materialise(number.select("grp", "n", "sites", F.ceil(F.col("n") / BLOCK).alias("m_blocks"), F.ceil(F.col("sites") / BLOCK).alias("s_blocks")), "blocks")
        pairs = blocks.agg(F.sum(F.col("n").cast("double") * F.col("sites"))).first()[0]
        if pairs is None:  # no call goes to a group
            return direct, None
        sizes = blocks.select("grp", "m_blocks", "s_blocks")
        members = materialise(self.members.join(sizes, "grp"), "members")
        # a target that is called by itself, too
        both = direct.withColumnRenamed("first", "d_first").join(via, ["caller", "display"]).join(members.select("grp", "target"), ["grp", "target"])
        both = materialise(both.select("caller", "display", "target", "grp", (F.col("first") < F.col("d_first")).alias("later")), "both")
        direct = direct.join(both.where("later").select("caller", "display", "target").distinct(), ["caller", "display", "target"], "left_anti")
        but = both.where("not later").groupBy("caller", "display", "grp").agg(F.collect_set("target").alias("but"))
        # groups of one caller and display may share members
        before = F.collect_list("grp").over(Window.partitionBy("caller", "display").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
        sites = via.withColumn("earlier", before).withColumn("earlier", F.when(F.size("earlier") > 0, F.col("earlier")))
        sites = materialise(sites.join(but, ["caller", "display", "grp"], "left").join(sizes, "grp"), "group-sites")
        shared = sites.where("earlier is not null").select("grp", F.explode("earlier").alias("other")).distinct()
        mine = members.select("grp", "target")
        also = shared.join(mine, "grp").join(mine.withColumnRenamed("grp", "other"), ["other", "target"]).groupBy("grp", "target").agg(F.collect_set("other").alias("also"))
        return direct, Groups(sites, materialise(members.join(also, ["grp", "target"], "left"), "group-members"), min(max(int(pairs / PAIRS), 1), 10_000))

    def cascade(self, sites: DataFrame) -> DataFrame:
        """path, ord, level, step, best, guess, grp of call sites in Rust and Go."""
        levels: list[DataFrame] = []
        items = sites.select("path", "lang", "ord", F.lit(0).alias("level"), "fn_line", "line", *CALLEE).distinct()
        for level in range(LEVELS):
            if level and items.isEmpty():  # a look at the written items of the level above
                break
            items, deeper = self.expand(items)
            levels.append(items)
            items = deeper
        hits: DataFrame | None = None
        for items in reversed(levels):
            after = materialise(self.resolve(items, hits), "hits")
            discard(hits, items)
            hits = after
        return hits

    # ---- one level

    def resolve(self, items: DataFrame, below: DataFrame | None) -> DataFrame:
        """path, ord, level, step, best, guess, grp: the targets of each item that has any; a group is one row with the
        best of its members."""
        if below is not None:
            first = below.groupBy("path", "ord", (F.col("level") - 1).alias("level")).agg(F.min(F.struct("best", "guess")).alias("h"))
            returns = self.defs.select("def_id", F.col("ret").alias("ret"))
            first = first.select(*ITEM, F.col("h.best").alias("inner"), F.col("h.guess").alias("inner_guess"), F.col("h.best.def_id").alias("def_id")).join(returns, "def_id", "left").drop("def_id")
            items = items.join(first, list(ITEM), "left")
        else:
            items = items.withColumns({"inner": F.lit(None).cast("struct<path:string,line:int,ord:int,def_id:string>"), "inner_guess": F.lit(None).cast("boolean"), "ret": F.lit(None).cast("string")})
        items = items.join(self.params, ["path", "fn_line", "var"], "left").join(self.fns, ["path", "fn_line"], "left")
        b, go = F.col("b"), F.col("lang") == "go"
        made = F.when(go, F.nullif(F.regexp_extract(b["name"], r"^New(\p{Lu}.*)$", 1), F.lit("")))
        owner = F.try_element_at(b["segs"], F.lit(-2))
        made = made.when((b["ckind"] == "path") & _upper(owner), owner)
        type_ = F.when(b["bkind"] == "typed", b["type"]).when(b["bkind"] == "call", F.coalesce(F.col("ret"), made)).otherwise(F.col("param_type"))
        items = items.withColumn("vtype", F.when((F.col("ckind") == "method") & (F.col("rkind") == "var"), type_))
        # an import of the name called, of a path's head, or of a receiver
        local = F.when(F.col("ckind") == "bare", F.col("name")).when(F.col("ckind") == "path", F.element_at("segs", 1)).when(F.col("rkind") == "var", F.col("recv"))
        items = items.withColumn("local", local).join(self.imports.select("path", "local", "route"), ["path", "local"], "left")
        items = materialise(items.select("path", "lang", *ITEM[1:], "fn_line", *CALLEE, "inner", "inner_guess", "vtype", "impl_type", "trait_name", "route"), "typed")
        asked = self.requests(items)
        answers = self.index.answer(asked, self.ikeys)
        inner = items.where("ckind = 'bare' and inner is not null").select(*ITEM, F.lit(0).alias("step"), F.col("inner").alias("best"), F.col("inner_guess").alias("guess"))
        alone = answers.unionByName(inner).withColumn("grp", F.lit(None).cast("string"))
        every = materialise(alone.unionByName(self.dispatched(items)), "answers")
        least = every.groupBy(*ITEM).agg(F.min("step").alias("least"))
        return every.join(least, list(ITEM)).where("step = least").select(*ITEM, "step", "best", "guess", "grp").distinct()

    def asked_types(self, items: DataFrame) -> DataFrame:
        """path, ord, level, name, step, type: types whose methods an item asks for, a step each."""
        go, rust = F.col("lang") == "go", F.col("lang") == "rust"
        var = items.where("ckind = 'method' and rkind = 'var'")
        typed = var.where("vtype is not null").select(*ITEM, "name", "lang", F.lit(10).alias("step"), F.col("vtype").alias("type"))
        expression = var.where(go & F.col("vtype").isNull() & F.col("route").isNull() & _upper(F.col("recv"))).select(*ITEM, "name", "lang", F.lit(10).alias("step"), F.col("recv").alias("type"))
        generic = var.where(rust & F.col("vtype").isNotNull()).join(self.bounds, (F.col("vtype") == F.col("type_param")) & (items["path"] == self.bounds["path"]) & (items["fn_line"] == self.bounds["fn_line"]))
        generic = generic.select(items["path"], *ITEM[1:], "name", "lang", (F.col("bound.ord") * 4 + 20).alias("step"), F.col("bound.trait").alias("type"))
        return reduce(DataFrame.unionByName, [typed, expression, generic])

    def dispatched(self, items: DataFrame) -> DataFrame:
        t = self.asked_types(items)
        # methods come before interfaces in Go, traits before methods in Rust
        step = F.col("step") + F.when(F.col("lang") == "go", 2).otherwise(0)
        return t.withColumnRenamed("type", "owner").join(self.groups, ["lang", "owner", "name"]).select(*ITEM, step.cast("int").alias("step"), "best", "guess", F.when(F.col("n") > 1, F.col("grp")).alias("grp"))

    def requests(self, items: DataFrame) -> DataFrame:
        go, rust, name = F.col("lang") == "go", F.col("lang") == "rust", F.col("name")
        bare, method = F.col("ckind") == "bare", F.col("ckind") == "method"
        far = 1 << 30

        def ask(rows: DataFrame, step, how: str, key: Column, total: Column | None = None) -> DataFrame:
            return rows.select(*ITEM, F.lit(step).cast("int").alias("step") if isinstance(step, int) else step.cast("int").alias("step"), F.lit(how).alias("how"), key.alias("key"), (key if total is None else total).alias("total"))

        plain = items.where(bare)
        imported = F.when(F.size("route") > 0, _key("q", F.concat_ws("::", "route"))).otherwise(_key("n", name))
        globs = plain.select(*ITEM, "name", "lang").join(self.globs.drop("lang"), "path")
        glob = F.when(go, _key("d", F.try_element_at("route", F.lit(-1)), name)).otherwise(_key("g", F.concat_ws("::", "route"), name))
        expanded = F.when(F.col("route").isNotNull(), F.concat("route", F.slice("segs", 2, 1 << 20))).otherwise(F.col("segs"))
        paths = items.where("ckind = 'path'")
        package = items.where(go & method & (F.col("rkind") == "var") & F.col("vtype").isNull() & F.col("route").isNotNull())
        ends = package.select(*ITEM, "name", F.explode(_ends(F.col("route"), 1)).alias("end"))
        own = items.where(rust & (F.col("rkind") == "self"))
        fallback = items.where(method & ~(go & (F.col("rkind") == "var") & F.col("vtype").isNull() & F.col("route").isNotNull()))
        types = self.asked_types(items)
        out = [
            ask(plain, 10, "file", _key("f", name)),
            ask(plain.where(go), 20, "dir", _key("f", name)),
            ask(plain.where(rust & F.col("route").isNotNull()), 20, "any", imported),
            ask(globs, 30, "any", glob),
            ask(plain, 40, "any", _key("n", name)),
            ask(paths, 10, "any", _key("q", F.concat_ws("::", expanded))),
            ask(ends, F.lit(1000) - F.size("end"), "any", _key("p", F.concat_ws("/", "end"), name)),  # the longest end first
            ask(own.where("impl_type is not null"), 10, "any", _key("m", F.col("impl_type"), name)),
            ask(own.where("trait_name is not null"), 20, "any", _key("m", F.col("trait_name"), name)),
            ask(types, F.col("step") + 1, "any", _key("m", F.col("type"), name)),
            ask(fallback, far, "any", _key("nm", name), _key("n", name)),
            ask(fallback, far + 1, "any", _key("no", name), _key("n", name)),
        ]
        return reduce(DataFrame.unionByName, out)
