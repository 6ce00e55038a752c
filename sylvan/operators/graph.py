"""The call graph: edges, and bounded traversals of callers and callees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.operators.outline import basename
from sylvan.operators.resolve import Groups, Resolver, met, placed
from sylvan.runtime import materialise

DEPTH = 3


@dataclass
class Graph:
    """``defs``: the definitions; ``calls``: one row for each (caller, display, target), but those that go to
    ``groups`` of targets."""

    defs: DataFrame
    calls: DataFrame
    groups: Groups | None = None

    def named(self, **more: Column) -> DataFrame:
        """Calls with both ends: definitions have path, line and name; targets outside have a display only.
        ``more``: further columns of a target, of the table of definitions. Ends join before the pairs of a group are made."""
        src = self.defs.select("def_id", "path", "line", "name").toDF("caller", "src_path", "src_line", "src_name")
        dst = self.defs.select("def_id", "path", "line", "name", *more.values()).toDF("target", "dst_path", "dst_line", "dst_name", *more)
        out = self.calls.withColumnRenamed("path", "site_path").join(src, "caller").join(dst, "target", "left")
        if self.groups is None:
            return out
        sites = placed(self.groups.sites).withColumnRenamed("path", "site_path").join(src, "caller")
        return out.unionByName(met(sites, self.groups.members.join(dst, "target"), self.groups.deal))

    def edges(self) -> DataFrame:
        """src_id, dst_id, src_label, dst_label, is_guess: ids are ``file:line`` by the file's base name,
        or the bare name of what is not defined here."""
        src = F.concat_ws(":", basename(F.col("src_path")), "src_line")
        dst = F.concat_ws(":", basename(F.col("dst_path")), "dst_line")
        known = F.col("target").isNotNull()
        label = lambda name, where: F.concat(name, F.lit("\n"), where)
        out = self.named().select(
            src.alias("src_id"), F.when(known, dst).otherwise(F.col("display")).alias("dst_id"), label(F.col("src_name"), src).alias("src_label"),
            F.when(known, label(F.col("dst_name"), dst)).otherwise(F.col("display")).alias("dst_label"), "is_guess",
        )
        return out.distinct()

    def roots(self, name: str) -> DataFrame:
        """Definitions of a bare name, in the order of the index."""
        return self.defs.where(F.col("name") == name).select(F.struct("path", "ord").alias("root"), F.col("def_id").alias("key"), "path", "line")

    def callees(self, name: str, depth: int = DEPTH) -> DataFrame:
        """What definitions of a name call, and so on: root, trail (the order of rows), depth from 1, display,
        path, line, is_guess, cycle. A row that is on its own path already is shown once and not followed."""
        steps = self.named().select(F.col("caller").alias("key"), F.col("target").alias("next"), "display", F.col("dst_path").alias("path"), F.col("dst_line").alias("line"), "is_guess", F.struct(F.col("line").alias("at"), "display", "site_path", "ord", "dst_path", "dst_line").alias("place"))
        return self.walk(self.roots(name).select("root", "key"), steps, depth)

    def callers(self, name: str, depth: int = DEPTH) -> DataFrame:
        """The same for what calls a name; a name that isn't defined here has callers, too."""
        n = self.named()
        steps = n.select(
            F.coalesce("target", F.concat(F.lit("\x01"), "display")).alias("key"), F.col("caller").alias("next"), F.col("src_name").alias("display"), F.col("src_path").alias("path"), F.col("src_line").alias("line"), "is_guess",
            F.struct(F.col("line").alias("at"), F.col("display").alias("display"), "site_path", "ord", "dst_path", "dst_line").alias("place"),
        )
        defined = self.roots(name)
        outside = n.sparkSession.createDataFrame([(None, "\x01" + name)], "root struct<path:string,ord:int>, key string")
        starts = defined.select("root", "key").unionByName(outside.join(defined.limit(1).select(F.lit(1).alias("some")), F.lit(True), "left_anti"))
        return self.walk(starts, steps, depth)

    def walk(self, starts: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
        steps = materialise(steps, "steps")
        place = "struct<at:int,display:string,site_path:string,ord:int,dst_path:string,dst_line:int>"
        front = starts.select("root", "key", F.array("key").alias("seen"), F.array().cast(f"array<{place}>").alias("trail"))
        out: DataFrame | None = None
        columns = ["root", "trail", "depth", "display", "path", "line", "is_guess", "cycle"]
        for d in range(1, depth + 1):
            met = front.join(steps, "key").select(
                "root", F.concat("trail", F.array("place")).alias("trail"), F.lit(d).alias("depth"), "display", "path", "line", "is_guess", F.coalesce(F.array_contains("seen", F.col("next")), F.lit(False)).alias("cycle"), "next", "seen",
            )
            rows = materialise(met, "walk")
            out = rows.select(*columns) if out is None else out.unionByName(rows.select(*columns))
            follow = rows.where("next is not null and not cycle")
            if follow.isEmpty():
                break
            front = follow.select("root", F.col("next").alias("key"), F.concat("seen", F.array("next")).alias("seen"), "trail")
        if out is None:  # a depth of 0
            out = front.join(steps, "key").limit(0).select("root", "trail", F.lit(1).alias("depth"), "display", "path", "line", "is_guess", F.lit(False).alias("cycle"))
        return out


def build(rel: DataFrame) -> Graph:
    """The graph of a written table of relations."""
    resolver = Resolver(rel)
    return Graph(resolver.defs, *resolver.calls())


__all__ = ["Graph", "build"]
