import duckdb
import pytest

from sylvan.llm import queries, url_filter

URLS = [
    "http://example.org/en/12", "https://a.example.org/es/3?x#y", "https://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/1", "http://X.COM/de/1",
    "http://x.com/De/1", "http://com/fr/", "http://com", "http://notorg/", "http://notexample.org/es/", "no scheme", "", None, "://", "http://?q", "a://b://c/d",
    "https://www.cheap-pills.example.com/en/1", "https://cheap-pills.example.org/fr", "http://ok.net/casino.html", "http://ok.net/xcasino.html", "http://ok.net/a\nb/viagra",
    "http://é.net/ü", "http://ORG/", "http://user@org:80/", "http://x.org", "http://x.org?/", "http://" + "a" * 50_000 + ".org/" + "b/" * 20_000,
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(0, URLS[0], None, None), (None, URLS[1], None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string")


def found(df):
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict", "pattern").collect()), key=str)


def test_against_sql(spark, pages):
    con = duckdb.connect()
    rows = pages.toArrow()  # noqa: F841
    con.execute("create view pages as select page_id, url from rows")
    want = sorted(con.execute(f"select page_id, host, path, rule, verdict, pattern from ({queries.ORACLES['op7_url_filter']})").fetchall(), key=str)
    assert found(url_filter.judge(pages)) == want


def test_the_joined_way_judges_alike(pages):
    one, two = found(url_filter.judge(pages)), found(url_filter.judge(pages, inline=0))
    assert one == two


def test_both_ways_report_the_first_pattern_given(spark):
    rules = tuple(url_filter.block_pattern(p) for p in ("viagra^", "casino.", "viagra^", "bets."))
    pages = spark.createDataFrame([(1, "http://bets.casino.net/viagra"), (2, "http://bets.casino.net/")], "page_id long, url string")
    for inline in (0, 200):
        assert [r[5] for r in found(url_filter.judge(pages, rules, inline))] == ["viagra^", "casino."]


def test_no_rules_and_no_rows(spark, pages):
    assert {r[4] for r in found(url_filter.judge(pages, ()))} == {"allow"}
    assert found(url_filter.judge(pages.limit(0))) == []


def test_tokens_are_whole_in_every_match():
    for r in url_filter.SITE_RULES + url_filter.BLOCK_PATTERNS:
        assert r.tokens
    assert "1" not in url_filter.site_rule("block", "example.org/en/1").tokens
    with pytest.raises(ValueError):
        url_filter.block_pattern("*abc*")
