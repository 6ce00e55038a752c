"""Structural search: patterns over the table of nodes, as joins.

Every relation of a pattern is a join on the file first: child and parent on the parent's
number, siblings on the common parent, ``inside`` on the preorder interval of a node. Preorder numbers
fall in ranges of ``RANGE``: an interval has a row for each range that it touches, a node lies in one, and
both meet on (file, range), so a large file is dealt to many tasks and few pairs are tried in vain. A
relation whose other side reports nothing is a semi join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylvan.functions.languages import LANGUAGES, canonical
from sylvan.plans.pattern import Link, Pattern, Planner, Scoped, describe
from sylvan.plans.query import Name, parse

UNSHOWN = r"[\p{C}\p{Z}\p{Mn}\p{Me}&&[^ ]]"
CAPTURE = "array<struct<name:string,node_id:int,start_pos:int,end_pos:int,start_line:int,end_line:int,text:string,first_line:string>>"
KEPT = ("path", "node_id", "last_desc", "parent_id", "field", "named_idx", "root", "caps")
#: Preorder numbers of a range, as a power of two.
RANGE = 8
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0"))


def _node(name: str | None) -> Column:
    fields = ("node_id", "start_pos", "end_pos", "start_line", "end_line", "text", "first_line")
    return F.struct(F.lit(name).alias("name"), *fields)


def _text_is(name: Name, text: Column) -> Column:
    return text.rlike(name.text) if name.regex else text == F.lit(name.text)


class Search:
    """Matches of patterns in a table of nodes. ``files`` (path, source) serves texts that the table
    of nodes leaves out because of their length."""

    def __init__(self, nodes: DataFrame, files: DataFrame | None = None):
        self.nodes, self.files = nodes, files

    def any_of(self, patterns: tuple[Pattern, ...]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.one(p) for p in patterns])

    def one(self, p: Pattern) -> DataFrame:
        """(path, node_id, last_desc, parent_id, field, named_idx, root, caps) of the pattern's matches."""
        df = self.nodes
        if p.kind is not None:
            df = df.where(F.col("kind") == p.kind)
        if p.text is not None:
            if self.files is not None and (p.kind is None or not p.kind.endswith("identifier")):
                short = df.where(F.col("text").isNotNull() & _text_is(p.text, F.col("text")))
                long = df.where(F.col("text").isNull()).join(self.files.select("path", "source"), "path")
                df = short.unionByName(long.where(_text_is(p.text, self.cut("source"))).drop("source"))
            else:
                df = df.where(_text_is(p.text, F.col("text")))
        caps = F.array(_node(p.capture)) if p.capture is not None and not p.capture.startswith("_") else F.array()
        df = df.select("path", "node_id", "last_desc", "parent_id", "field", "named_idx", _node("").alias("root"), caps.cast(CAPTURE).alias("caps"))
        for link in p.links:
            df = self.linked(df, link)
        return df

    @staticmethod
    def cut(source: str) -> Column:
        return F.substring(F.col(source), F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))

    def linked(self, df: DataFrame, link: Link) -> DataFrame:
        other = self.any_of(link.targets)
        capturing = any(p.captures() for p in link.targets)
        keep = ["path", "node_id", "last_desc", "parent_id", "field", "named_idx", *(["caps"] if capturing else [])]
        other = other.select(*[F.col(c).alias(f"o_{c}") for c in keep])
        on = F.col("path") == F.col("o_path")
        if link.how == "child":
            on &= F.col("o_parent_id") == F.col("node_id")
        elif link.how == "parent":
            on &= F.col("o_node_id") == F.col("parent_id")
        elif link.how == "inside":
            on &= (F.col("o_node_id") > F.col("node_id")) & (F.col("o_node_id") <= F.col("last_desc")) & (F.col("o_range") == F.col("range"))
            if link.field is not None:
                on &= F.col("o_field") == link.field
            other = other.withColumn("o_range", F.shiftright("o_node_id", RANGE))
            if capturing:
                met = spread(df, F.col("node_id") + 1, F.col("last_desc")).join(other, on)
                return met.select(*[c for c in KEPT if c != "caps"], F.concat("caps", "o_caps").alias("caps"))
            held = spread(df.select("path", "node_id", "last_desc"), F.col("node_id") + 1, F.col("last_desc"))
            held = held.join(other.select("o_path", "o_node_id", "o_field", "o_range"), on, "left_semi").select("path", "node_id").distinct()
            return df.join(held, ["path", "node_id"], "left_semi")
        elif link.how == "later" and not capturing:
            if link.field is not None:
                other = other.where(F.col("o_field") == link.field)
            last = other.groupBy("o_path", "o_parent_id").agg(F.max("o_named_idx").alias("o_last"))
            return df.join(last, on & (F.col("o_parent_id") == F.col("parent_id")) & (F.col("o_last") > F.col("named_idx")), "left_semi")
        else:
            on &= F.col("o_parent_id") == F.col("parent_id")
            on &= F.col("o_named_idx") == F.col("named_idx") + 1 if link.how == "next" else F.col("o_named_idx") > F.col("named_idx")
        if link.field is not None:
            on &= F.col("field" if link.how == "parent" else "o_field") == link.field
        if not capturing:
            return df.join(other, on, "left_semi")
        return df.join(other, on).select(*[c for c in KEPT if c != "caps"], F.concat("caps", "o_caps").alias("caps"))

    def scoped(self, plan: Scoped) -> DataFrame:
        """Outer matches with the inner matches in their field: the captures of both."""
        outer = self.any_of(plan.outer)
        field = self.nodes.where(F.col("field") == plan.field).select(F.col("path").alias("f_path"), F.col("parent_id").alias("f_parent"), F.col("named_idx").alias("f_idx"), "node_id", "last_desc")
        # a field may hold several nodes: the first is meant
        first = field.groupBy("f_path", "f_parent").agg(F.min(F.struct("f_idx", "node_id", "last_desc")).alias("f")).select("f_path", "f_parent", F.col("f.node_id").alias("f_node"), F.col("f.last_desc").alias("f_last"))
        outer = outer.join(first, (F.col("path") == F.col("f_path")) & (F.col("node_id") == F.col("f_parent")), "left")
        outer = outer.select("path", F.col("node_id").alias("outer_id"), F.coalesce("f_node", "node_id").alias("low"), F.coalesce("f_last", "last_desc").alias("high"), F.col("caps").alias("outer_caps"))
        outer = spread(outer, F.col("low"), F.col("high"))
        inner = self.any_of(plan.inner).select(F.col("path").alias("i_path"), F.col("node_id").alias("i_node"), F.shiftright("node_id", RANGE).alias("i_range"), "root", F.col("caps").alias("inner_caps"))
        on = (F.col("path") == F.col("i_path")) & (F.col("range") == F.col("i_range")) & (F.col("i_node") >= F.col("low")) & (F.col("i_node") <= F.col("high"))
        met = outer.join(inner, on)
        return met.select("path", F.col("outer_id").alias("node_id"), F.col("i_node").alias("inner_id"), "root", F.concat("outer_caps", "inner_caps").alias("caps"))

    def run(self, plan: Scoped | tuple[Pattern, ...]) -> DataFrame | None:
        """path, node_id, inner_id, root, caps; None for an empty plan."""
        if isinstance(plan, Scoped):
            return self.scoped(plan)
        if not plan:
            return None
        return self.any_of(plan).select("path", "node_id", F.lit(-1).alias("inner_id"), "root", "caps")


def spread(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """The rows of an interval of preorder numbers that isn't empty, once for each ``range`` that it touches."""
    return df.where(low <= high).withColumn("range", F.explode(F.sequence(F.shiftright(low, RANGE), F.shiftright(high, RANGE))))


def quoted(text: Column) -> Column:
    """The text in double quotes, as a literal with escapes: what no font shows, or joins to the letter before, as its
    code point."""
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    point = lambda c: F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))
    shown = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(UNSHOWN), point(c)).otherwise(c))
    text = F.when(text.rlike(UNSHOWN), F.array_join(shown, "")).otherwise(text)
    return F.concat(F.lit('"'), text, F.lit('"'))


def rendered(matches: DataFrame, files: DataFrame | None, body: bool = False) -> DataFrame:
    """path, ord, captures (name, start_line, end_line, text) and the match as a line of text."""
    shown = F.when(F.size("caps") > 0, F.col("caps")).otherwise(F.array("root"))
    df = matches.select("path", "node_id", "inner_id", shown.alias("shown"))
    if files is not None:
        long = F.exists("shown", lambda c: c["text" if body else "first_line"].isNull())
        whole = df.where(~long).withColumn("source", F.lit(None).cast("string"))
        df = whole.unionByName(df.where(long).join(files.select("path", "source"), "path").select("path", "node_id", "inner_id", "shown", "source"))
    else:
        df = df.withColumn("source", F.lit(None).cast("string"))

    def text(c: Column) -> Column:
        cut = F.substring(F.col("source"), c["start_pos"] + 1, c["end_pos"] - c["start_pos"])
        if body:
            return F.coalesce(c["text"], cut)
        return F.coalesce(c["first_line"], F.regexp_replace(F.substring_index(cut, "\n", 1), "\r$", ""))

    captures = F.transform("shown", lambda c: F.struct(c["name"].alias("name"), c["start_line"].alias("start_line"), c["end_line"].alias("end_line"), text(c).alias("text")))
    df = df.select("path", "node_id", "inner_id", captures.alias("captures"))

    def line(c: Column) -> Column:
        head = F.when(c["name"] == "", "<match>").otherwise(F.concat(F.lit("@"), c["name"]))
        where = c["start_line"].cast("string")
        if body:
            where = F.when(c["end_line"] != c["start_line"], F.concat(where, F.lit("-"), c["end_line"].cast("string"))).otherwise(where)
        return F.concat(head, F.lit(":"), where, F.lit(": "), c["text"] if body else quoted(c["text"]))

    return df.select("path", "node_id", "inner_id", "captures", F.array_join(F.transform("captures", line), ", ").alias("rendered"))


def search(nodes: DataFrame, query: str, files: DataFrame | None = None, langs: tuple[str, ...] = LANGUAGES, body: bool = False, compat: bool = False) -> DataFrame:
    """path, lang, ord, captures, rendered of the matches of a query in files of these languages.

    Matches that a file's lines would show alike are one, in the order of the first. ``ord`` numbers
    a file's matches from 0. Regular expressions are Java's."""
    tree = parse(query)
    jvm = nodes.sparkSession._jvm  # noqa: SLF001
    found = []
    for lang in map(canonical, langs):
        mine = Search(nodes.where(F.col("lang") == lang), files)
        plan = Planner(lang, compat).plan(tree)
        for expression in expressions(plan):
            try:  # one that can't be right fails here and not in an executor
                jvm.java.util.regex.Pattern.compile(expression)
            except Exception as e:
                raise ValueError(f"not a regular expression: /{expression}/") from e
        matches = mine.run(plan)
        if matches is not None:
            found.append(rendered(matches, files, body).withColumn("lang", F.lit(lang)))
    if not found:
        return nodes.sparkSession.createDataFrame([], "path string, lang string, ord int, captures array<struct<name:string,start_line:int,end_line:int,text:string>>, rendered string")
    rows = reduce(DataFrame.unionByName, found)
    first = rows.groupBy("path", "lang", "rendered").agg(F.min(F.struct("node_id", "inner_id", "captures")).alias("m"))
    ord_ = F.row_number().over(Window.partitionBy("path", "lang").orderBy("m.node_id", "m.inner_id", "rendered")) - 1
    return first.select("path", "lang", ord_.alias("ord"), F.col("m.captures").alias("captures"), "rendered")


def expressions(plan: Scoped | tuple[Pattern, ...]) -> list[str]:
    """The regular expressions of a plan."""
    patterns = [*plan.outer, *plan.inner] if isinstance(plan, Scoped) else list(plan)
    out = []
    while patterns:
        p = patterns.pop()
        if p.text is not None and p.text.regex:
            out.append(p.text.text)
        patterns += [t for link in p.links for t in link.targets]
    return out


def explain(query: str, langs: tuple[str, ...] = LANGUAGES, compat: bool = False) -> str:
    """The plan of a query for each language."""
    tree = parse(query)
    return "\n".join(f"{lang}:\n{describe(Planner(lang, compat).plan(tree), '  ')}" for lang in map(canonical, langs))


__all__ = ["Search", "explain", "quoted", "rendered", "search"]
