"""URL filters (operator 7), in DataFrame functions only.

Pattern rules (regular expressions over the URL) are indexed by their rarest
literal token: of the letter-digit runs that every match of the rule must hold as
whole tokens, the one that the fewest URLs of the table hold. A URL's tokens
fetch candidate rules, and only these run their regular expressions.

*Site rules* (``host/path`` with a verdict) are patterns too: a host or any
subdomain of it, then a path prefix. The longest site rule that fits decides;
where none fits, a block pattern that matches decides ``block``, else ``allow``.

Null URLs, and those without ``://``, have an empty host and path, fit no site
rule and meet block patterns with the empty string. Repeated rows are judged each
by itself, ties in length cannot both fit unless they are the same rule (the
first given wins). URLs of any length are judged whole. An empty table gives an empty one. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.llm.mixing import literal

#: Rules up to this number are looked up in a literal index inside the projection;
#: more are joined as a table, which Spark broadcasts only below its own size threshold.
INLINE_RULES = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict, the text that is reported, a Java regular expression over host + path,
    the tokens every match holds whole, and whether it is a site rule."""

    verdict: str
    text: str
    regex: str
    tokens: tuple[str, ...]
    site: bool


def site_rule(verdict: str, text: str) -> Rule:
    """``host/path``: fits the host, its subdomains, and URLs whose path starts with ``/path``."""
    host, slash, path = text.partition("/")
    if not host or not slash:
        raise ValueError(f"a site rule is host/path: {text!r}")
    # a path prefix may end inside a token of the URL, so its last run is no whole token
    whole = re.findall(r"[0-9A-Za-z]+", host) + re.findall(r"(?<=/)[0-9A-Za-z]+(?=[^0-9A-Za-z])", "/" + path)
    return Rule(verdict, text, rf"\A(?:[^/]*\.)?{java_quote(host)}{java_quote('/' + path)}", tuple(dict.fromkeys(whole)), True)


def block_pattern(pattern: str) -> Rule:
    """``*`` stands for anything, ``^`` for a separator or the end; all else is literal.

    The pattern's letter-digit runs that have a separator on both sides are whole tokens.
    """
    regex = "".join(".*" if c == "*" else r"(?:[^0-9A-Za-z]|\z)" if c == "^" else java_quote(c) for c in pattern)
    regex = r"(?:\A|(?<=[^0-9A-Za-z]))" + regex if pattern[:1].isalnum() else regex
    whole = re.findall(r"(?:^|(?<=[^0-9A-Za-z*]))[0-9A-Za-z]+(?=[^0-9A-Za-z*])", pattern)
    if not whole:
        raise ValueError(f"no whole token in {pattern!r}: it would run on every URL")
    return Rule("block", pattern, "(?s)" + regex, tuple(dict.fromkeys(whole)), False)


def java_quote(s: str) -> str:
    return re.sub(r"([^0-9A-Za-z])", r"\\\1", s)


#: The rules of the contract.
SITE_RULES = (
    site_rule("allow", "org/"),
    site_rule("block", "example.org/es/"),
    site_rule("block", "example.org/en/1"),
    site_rule("allow", "com/fr/"),
    site_rule("block", "com/de/"),
)
#: Patterns of unwanted sites; lower-case, since hosts are.
BLOCK_PATTERNS = tuple(
    block_pattern(p)
    for p in (
        "cheap-pills.", "pills-online.", "casino-win.", "online-casino.", "casino.", "spam-farm.", "free-bets.", "bets.",
        "adult-x.", "xxx.", "porn.", "ads-track.", "adserver.", "doubleclick.", "payday-loan", "viagra^", "torrent^",
    )
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rarest(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Index: each rule under the token of it that the fewest URLs hold (ties: the longer, then by name)."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        if not r.tokens:
            raise ValueError(f"no whole token in {r.text!r}")
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(r)
    return index


def token_counts(site: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many URLs hold each token of the rules: one pass, at most one row per token."""
    wanted = sorted({t for r in rules for t in r.tokens})
    held = F.explode(F.array_intersect(F.col("__tokens"), F.array(*map(F.lit, wanted)))).alias("token") if len(wanted) <= 1000 else F.explode("__tokens").alias("token")
    rows = site.select(held).where(F.col("token").isin(wanted) if len(wanted) <= 1000 else F.lit(True)).groupBy("token").count()
    if len(wanted) > 1000:
        names = literal(site.sparkSession, [(t,) for t in wanted], "token string")
        rows = rows.join(names, "token", "left_semi")
    return {r["token"]: r["count"] for r in rows.toLocalIterator()}


def judge(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + BLOCK_PATTERNS, inline: int = INLINE_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and ``pattern`` (the first block pattern given that matches, or null)."""
    host, path = split_url(F.col("__url"))
    site = pages.select(F.col("page_id"), F.col("url").cast("string").alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    site = site.withColumn("__site", F.concat("host", "path"))
    site = site.withColumn("__tokens", F.array_distinct(F.filter(F.split("__site", "[^0-9A-Za-z]+"), lambda t: t != "")))
    if not rules:
        return site.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("pattern"))
    # one order for either way: site rules by length (the longest decides), then block patterns; as given among equals
    ranked = tuple(sorted(dict.fromkeys(rules), key=lambda r: (not r.site, -len(r.text) if r.site else 0)))
    index = rarest(ranked, token_counts(site, ranked))
    number = {r: i for i, r in enumerate(ranked)}
    keyed = {t: sorted(number[r] for r in rs) for t, rs in index.items()}
    found = _inline(site, ranked, keyed) if len(ranked) <= inline else _joined(site, ranked, keyed)
    sites = sum(r.site for r in ranked)
    best, pattern = (F.array_min(F.filter("__fits", f)) for f in (lambda n: n < sites, lambda n: n >= sites))

    def of(number_: Column, values: list[str]) -> Column:  # element_at takes the last for a null place
        return F.when(number_.isNotNull(), F.element_at(F.array(*map(F.lit, values)), F.coalesce(number_, F.lit(0)) + 1))

    texts, verdicts = [r.text for r in ranked], [r.verdict for r in ranked]
    out = found.select("page_id", "host", "path", best.alias("__best"), pattern.alias("__pattern"))
    return out.select("page_id", "host", "path", of(F.col("__best"), texts).alias("rule"), F.coalesce(of(F.col("__best"), verdicts), F.when(F.col("__pattern").isNotNull(), "block").otherwise("allow")).alias("verdict"), of(F.col("__pattern"), texts).alias("pattern"))


def _inline(site: DataFrame, rules: tuple[Rule, ...], keyed: dict[str, list[int]]) -> DataFrame:
    """``__fits``, the numbers of the rules that fit: the URL's tokens that the index has (a hashed set of literals)
    fetch candidates, and only these run their expressions."""
    lookup = F.create_map(*[x for t, ns in sorted(keyed.items()) for x in (F.lit(t), F.array(*[F.lit(n) for n in ns]))])
    known = sorted(keyed)
    regexes = F.array(*[F.lit(r.regex) for r in rules])
    candidates = F.flatten(F.transform(F.filter("__tokens", lambda t: t.isin(known)), lambda t: F.element_at(lookup, t)))
    return site.withColumn("__fits", F.filter(candidates, lambda n: F.rlike(F.col("__site"), F.element_at(regexes, n + 1))))


def _joined(site: DataFrame, rules: tuple[Rule, ...], keyed: dict[str, list[int]]) -> DataFrame:
    """The same for long rule lists: distinct sites meet the index on the token."""
    rows = [(t, n, rules[n].regex) for t, ns in sorted(keyed.items()) for n in ns]
    table = literal(site.sparkSession, rows, "token string, __n int, __regex string")
    distinct = site.select("__site", "__tokens").distinct()
    met = distinct.select("__site", F.explode("__tokens").alias("token")).join(table, "token").where(F.expr("__site rlike __regex"))
    return site.join(met.groupBy("__site").agg(F.collect_set("__n").alias("__fits")), "__site", "left")
