"""Outlines of files, and the relations of definitions and calls, from one pass over the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outline(rel: DataFrame) -> DataFrame:
    """path, item_id, parent_id (-1: none), depth, kind, name, line: classes, functions and variables."""
    return rel.where("rel = 'outline'").select("path", F.col("ord").alias("item_id"), F.col("parent").alias("parent_id"), "depth", "kind", "name", "line")


def functions(rel: DataFrame) -> DataFrame:
    """path, name, line, ord of the functions of an outline, in its order."""
    return outline(rel).where("kind = 'fn'").select("path", "name", "line", F.col("item_id").alias("ord"))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def definitions(rel: DataFrame) -> DataFrame:
    """def_id, path, dir, lang, line, ord, name, qualified, kind, receiver, via_trait, ret, and pkg: the
    qualified path without receiver and name. (path, ord) is the order of the index."""
    d = rel.where("rel = 'def'")
    tail = F.when(F.col("kind") == "function", 1).otherwise(2)
    return d.select(
        F.concat_ws("#", "path", F.col("ord").cast("string")).alias("def_id"), "path", folder(F.col("path")).alias("dir"), "lang", "line", "ord", "name", F.col("segs").alias("qualified"), "kind", "receiver",
        "via_trait", "ret", F.slice("segs", F.lit(1), F.greatest(F.size("segs") - tail, F.lit(0))).alias("pkg"),
    )


def lookup(defs: DataFrame, expression: str) -> DataFrame:
    """path, line, name, is_guess of the definitions that an expression may mean: ``a::b::f`` by the end
    of the qualified path, ``x.f`` by receiver (if x looks like a type) or package, ``f`` by name."""
    if "::" in expression:
        segs = [s for s in expression.split("::") if s not in ("", "crate", "self", "super")]
        if not segs:
            return defs.limit(0).select("path", "line", "name", F.lit(False).alias("is_guess"))
        fits = (F.col("name") == segs[-1]) & (F.size("qualified") >= len(segs))
        fits &= F.slice("qualified", -len(segs), len(segs)) == F.array(*map(F.lit, segs))
    elif "." in expression:
        receiver, _, name = expression.rpartition(".")
        fits = F.col("name") == name
        if receiver != "self" and receiver[:1].isupper():
            fits &= (F.col("kind") != "function") & (F.col("receiver") == receiver)
        else:
            fits &= (F.col("kind") != "function") | ((F.size("qualified") >= 2) & (F.try_element_at("qualified", F.lit(-2)) == receiver))
    else:
        fits = F.col("name") == expression
    found = defs.where(fits)
    many = found.agg((F.count(F.lit(1)) > 1).alias("is_guess"))
    return found.crossJoin(F.broadcast(many)).select("path", "line", "name", "is_guess").orderBy("path", "line")
