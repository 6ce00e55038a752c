"""One object for all questions about a set of source files.

    engine = Engine.of(spark, "src/")                       # files that the driver lists
    engine = Engine(spark, table)                           # any table of path, lang, source
    engine.search("(*function @f).body((&function#malloc @c))")
    engine.outline(); engine.callers("main"); engine.callees("main"); engine.edges(); engine.definition("a::b::f")

Files are parsed once for structural search and once for outlines, definitions and
calls; both tables are written to the shared folder and read by every question after.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from sylvan.functions import render
from sylvan.functions.languages import LANGUAGES
from sylvan.operators import graph as graphs
from sylvan.operators import outline as outlines
from sylvan.operators import search as searches
from sylvan.runtime import materialise, ship
from sylvan.sources import files as sources


class Engine:
    def __init__(self, spark: SparkSession, files: DataFrame, several: bool = True, written: bool = False):
        """``written``: whether ``files`` is read from a table as it is. If not, it is written to one first."""
        self.spark, self.given, self.several, self.written = ship(spark), files.select("path", "lang", "source"), several, written

    @classmethod
    def of(cls, spark: SparkSession, paths: str | list[str], lang: str | None = None, no_ignore: bool = False) -> Engine:
        found = sources.jobs(paths, lang, no_ignore)
        return cls(spark, sources.read(spark, found), len(found) > 1)

    @cached_property
    def files(self) -> DataFrame:
        if self.written:
            return self.given
        # parsing takes far longer than its input is large: dealt to all cores, however few bytes there are
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 3 * self.spark.sparkContext.defaultParallelism)
        return materialise(self.given.repartition(tasks), "files")

    @cached_property
    def languages(self) -> tuple[str, ...]:
        """Languages that the files are in: a plan is made for these only."""
        present = {r["lang"] for r in self.nodes.select("lang").distinct().collect()}  # as many rows as languages
        return tuple(x for x in LANGUAGES if x in present)

    @cached_property
    def nodes(self) -> DataFrame:
        # a search reads one language and few kinds: sorted so, the table's row groups tell where they are
        return materialise(sources.nodes(self.files).sortWithinPartitions("lang", "kind"), "nodes")

    def unreadable(self) -> list[str]:
        """Paths of the files that could not be read (of a command line's files)."""
        return sorted(r["path"] for r in self.files.where("source is null").select("path").collect())

    @cached_property
    def relations(self) -> DataFrame:
        return materialise(sources.relations(self.files), "relations")

    @cached_property
    def graph(self) -> graphs.Graph:
        return graphs.build(self.relations)

    @cached_property
    def definitions(self) -> DataFrame:
        return outlines.definitions(self.relations)

    def search(self, query: str, body: bool = False, compat: bool = False) -> DataFrame:
        return searches.search(self.nodes, query, self.files, self.languages, body, compat)

    def outline(self) -> DataFrame:
        return outlines.outline(self.relations)

    def edges(self) -> DataFrame:
        return self.graph.edges()

    def callers(self, name: str, depth: int = graphs.DEPTH) -> DataFrame:
        return self.graph.callers(name, depth)

    def callees(self, name: str, depth: int = graphs.DEPTH) -> DataFrame:
        return self.graph.callees(name, depth)

    def definition(self, expression: str) -> DataFrame:
        return outlines.lookup(self.definitions, expression)

    # ---- the same as text

    def search_text(self, query: str, body: bool = False, compat: bool = False) -> str:
        return render.matches(self.search(query, body, compat), self.several)

    def outline_text(self) -> str:
        return render.outline(self.outline())

    def callers_text(self, name: str, depth: int = graphs.DEPTH) -> str:
        return render.calltree(name, self.graph.roots(name), self.callers(name, depth))

    def callees_text(self, name: str, depth: int = graphs.DEPTH) -> str:
        return render.calltree(name, self.graph.roots(name), self.callees(name, depth))

    def edges_text(self, form: str = "dot") -> str:
        return render.edge_list(self.edges()) if form == "edges" else render.dot(self.edges())

    def definition_text(self, expression: str) -> str:
        return render.definitions(self.definition(expression), self.files)
