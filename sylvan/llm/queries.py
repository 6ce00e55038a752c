"""One query for each operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sylvan.llm import ann, bpe, html_extract, license_scan, maxscore, mixing, simhash, token_count, toxicity, url_filter
from sylvan.runtime import ship, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(ship(spark), sf_dir, "documents"))


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(ship(spark), sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(ship(spark), sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(ship(spark), sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(ship(spark), sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_maxscore": op2_maxscore,
    "op3_token_counts": op3_token_counts,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_html_extract": op6_html_extract,
    "op7_url_filter": op7_url_filter,
    "op8_mixing": op8_mixing,
    "op9_ann": op9_ann,
    "op10_byte_bpe": op10_byte_bpe,
}


def _url_sql() -> str:
    def literal(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def fits(host: str, path: str) -> str:
        return f"(host = {literal(host)} or ends_with(host, {literal('.' + host)})) and starts_with(path, {literal(path)})"

    best, verdict = "null", "case when pattern is not null then 'block' else 'allow' end"
    for r in sorted((r for r in url_filter.SITE_RULES), key=lambda r: len(r.text)):
        host, _, path = r.text.partition("/")
        best = f"case when {fits(host, '/' + path)} then {literal(r.text)} else {best} end"
        verdict = f"case when {fits(host, '/' + path)} then {literal(r.verdict)} else {verdict} end"
    pattern = "null"
    for r in reversed(url_filter.BLOCK_PATTERNS):
        regex = "(^|[^0-9A-Za-z])" + "".join("([^0-9A-Za-z]|$)" if c == "^" else c if c.isalnum() else "\\" + c for c in r.text)
        pattern = f"case when regexp_matches(host || path, {literal(regex)}) then {literal(r.text)} else {pattern} end"
    return f"""
select page_id, host, path, {best} as rule, {verdict} as verdict, pattern from (
  select *, cast({pattern} as varchar) as pattern from (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages)))
"""


_TOP_SQL = """
with rows as (
  select vec_id, embedding as e, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from (select distinct vec_id, e, v from rows where vec_id % 20 = 0) q join rows c on q.vec_id <> c.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 20
"""

ORACLES: dict[str, str] = {
    "op2_maxscore": _TOP_SQL,
    "op7_url_filter": _url_sql(),
    "op8_mixing": mixing.oracle(),
}
