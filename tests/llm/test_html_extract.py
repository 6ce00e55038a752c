import random

import pytest

from sylvan.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><article>";</script></head><body class="page-{n}">
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home {n}</a><li><a>About</a></ul></nav><div class="cookie-notice"><p>We use cookies {n}</div>
<div class="sidebar"><p>Hot {n}</p></div><!-- <article>no</article> --><div class="ad">Buy {n}</div>
<article><header><h1>Title&nbsp;{n} &amp; more</h1><p>by line</p></header><p>First   <b>bold{n}</b>,
text.<br>next<p>Second &lt;b&gt; {n}<aside>also</aside><ul><li>one<li>two {n}</ul><form>Mail <input></form><div id="comments"><p>Nice {n}!</p></div></article>
<footer>&copy; {n}</footer></body></html>"""
TEXT = "Title {n} & more\n\nFirst bold{n}, text. next\n\nSecond <b> {n}\n\none\n\ntwo {n}"
SOUP = """<body><div class="top">Welcome to the site</div><div class="x1">{links}</div><div class="story"><div>{title}</div><div>{a}</div><div>{b}</div><div>Follow us for more</div></div><div class="end">All rights reserved</div>"""


def soup(i):
    return SOUP.format(links=f"link{i}", title=f"A title number {i} of all", a=f"The first paragraph of story {i} is rather long. " * 3, b=f"The second one of {i} is long, too. " * 4)


def test_marked_pages():
    for n in (1, 2):
        assert H.extract(PAGE.replace("{n}", str(n))) == TEXT.replace("{n}", str(n))


def extracted(spark, pages, **options):
    rows = [(i, f"http://a.org/{i}", x) for i, x in enumerate(pages)]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def story(i):
    return f"A title number {i} of all\n\n{(f'The first paragraph of story {i} is rather long. ' * 3).strip()}\n\n{(f'The second one of {i} is long, too. ' * 4).strip()}"


def test_the_wrapper_decides_on_plain_containers(spark):
    pages = [soup(i) for i in range(8)]
    assert extracted(spark, pages) == [story(i) for i in range(8)]
    assert all("Welcome" in H.extract(p) and "rights" in H.extract(p) for p in pages)  # alone, the page's own tree decides


def test_the_wrapper_decides_without_any_name(spark):
    # hand-labelled pages of one template: menu and advert come from small pools, no name or element tells them apart
    menus = ["<span>Home</span> <span>News</span>", "<span>Start</span> <span>About</span>"]
    page = "<div><div>{menu}</div><div>{ad}</div><div><div>{title}</div>{body}</div><div>All rights reserved</div></div>"
    pages, want = [], []
    for i in range(12):
        texts = [f"Paragraph {k} of page {i} says what no other says, at some length." for k in range(1 + i % 3)]
        pages.append(page.format(menu=menus[i % 2], ad=f"Buy offer {i % 3} now", title=f"On the matter of {i}", body="".join(f"<p>{t}</p>" for t in texts)))
        want.append("\n\n".join([f"On the matter of {i}", *texts]))
    assert extracted(spark, pages, names=False) == want == extracted(spark, pages)
    assert all(H.extract(p) != w for p, w in zip(pages, want, strict=True))


def test_an_article_is_never_cut_by_copies(spark):
    pages = [PAGE.replace("{n}", "7")] * 5 + [PAGE.replace("{n}", "7").replace("Home", "House"), PAGE.replace("{n}", "8")]
    assert extracted(spark, pages) == [TEXT.replace("{n}", "7")] * 6 + [TEXT.replace("{n}", "8")]


def test_a_container_in_an_article_that_never_varies_is_template(spark):
    pages = [f"<article><h1>Story {i}</h1><p>What happened on day {i}.</p><p>As ever.</p><div><p>Tell your friends</p><div>about us</div></div></article>" for i in range(6)]
    got = extracted(spark, pages)
    assert all(t.startswith(f"Story {i}\n\nWhat happened on day {i}.\n\nAs ever.") and "about us" not in t for i, t in enumerate(got))


def test_several_articles_of_a_wrapper_all_stay(spark):
    pages = [f"<div><div class=a><article><p>The first half of number {i}.</article></div><div class=b><article><p>And the other half of {i}.</article></div></div><div>Same</div>" for i in range(5)]
    assert extracted(spark, pages) == [f"The first half of number {i}.\n\nAnd the other half of {i}." for i in range(5)]


def brute_match(a, b, x=0, y=0):
    """Simple tree matching by its definition, without short cuts: the number of nodes matched."""
    if a.keys[x] != b.keys[y]:
        return 0
    xs, ys = a.below[x], b.below[y]
    m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, c in enumerate(xs, 1):
        for j, d in enumerate(ys, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + brute_match(a, b, c, d))
    return m[-1][-1] + 1


def test_simple_tree_matching_against_its_definition():
    rng = random.Random(3)

    def some():
        depth, out = 0, ["0 html."]
        for _ in range(rng.randint(0, 12)):
            depth = rng.randint(1, depth + 1)
            out.append(f"{depth} {rng.choice('ab')}.")
        return "\n".join(out)

    for _ in range(300):
        s, t, shapes = some(), some(), {}
        a, b = H.tree(s, shapes), H.tree(t, shapes)
        to = H.match(a, b)
        pairs = [(x, y) for x, y in enumerate(to) if y >= 0]
        assert len(pairs) == brute_match(a, b) and len({y for _, y in pairs}) == len(pairs)
        assert all(a.keys[x] == b.keys[y] for x, y in pairs) and [y for _, y in pairs] == sorted(y for _, y in pairs)
        both = H.tree(H.merge(t, s), shapes)
        assert len(both.keys) == len(b.keys) + to.count(-1)
        assert H.match(b, both).count(-1) == 0 and H.merge(H.merge(t, s), t) == H.merge(t, s)


def test_any_depth():
    for n in (160, 50_000):
        page = "<article>" + "<div>" * n + "<nav>menu</nav>text" + "</div>" * n + "</article>"
        assert H.extract(page) == "text"
    deep = H.fold(H.parse("<div>" * 20_000 + "a<p>b")).skeleton()
    other = H.fold(H.parse("<div>" * 20_000 + "<ul><li>a</ul>")).skeleton()
    assert H.merge(deep, other).count("\n") == deep.count("\n") + 2
    assert H.extract("<p><b>" * 100_000 + "x") == "x"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp text &lt", "plain & text <"), ("<p>a<p>b", "a\n\nb"), ("<p>cut <b", "cut"), ("<p>cut </", "cut"), ("<p>1 < 2", "1 < 2"), ("<p>x <!-- open", "x"),
    ("<article><p>a</article><article><p>longer one</article>", "a\n\nlonger one"), ("<article><p>a</article><hr><div><article><p>longer one</article></div>", "longer one"), ("<div>a<div>b</div>c</div>", "a\n\nb\n\nc"), ("<P CLASS='ad box'>no</P><P class=advice>yes", "yes"),
    ("<div class='page with-sidebar'><div class=sidebar>s</div><article><div class=post-header><h1>t</h1></div>x</article></div>", "t\n\nx"), ("<article>x</article><section class=comments><article>no</article></section>", "x"),
    ("<main><article><p>in</article><p>out</main>", "in"), ("<p hidden>h</p><p style='display:none'>h</p><p aria-hidden=true>h<p>s", "s"), ("<script>a<b", ""), ("<td>a<td>b", "a\n\nb"), ("<p>&#x41;&#66;&unknown;&am", "AB&unknown;&am"),
])
def test_odd_pages(page, text):
    assert H.extract(page) == text


def test_rows(spark):
    rows = [(i, f"http://a.org/{i}", PAGE.replace("{n}", str(i)), "t") for i in range(12)] + [(i, f"http://b.org/{i}", soup(i), None) for i in range(20, 30)]
    rows += [(0, "http://a.org/0", rows[0][2], "t"), (50, None, "<p>x", "t"), (51, "nohost", None, "t"), (None, "http://a.org/", rows[1][2], "t"), (52, "http://c.org/", "<div>" * 3000 + "deep" + "<p>w " * 20_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract_pages(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[3]["text"] == TEXT.replace("{n}", "3") and by[None]["text"] == TEXT.replace("{n}", "1")
    assert by[25]["text"].startswith("A title number 25") and "rights" not in by[25]["text"] and "Welcome" not in by[25]["text"]
    assert by[50]["text"] == "x" and by[51]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got)
    assert H.extract_pages(pages.limit(0)).collect() == []


def test_constant_texts_are_counted_over_all_pages(spark):
    def page(i, story):
        notice = "<div>Closed on Mondays</div>" if i % 10 == 0 else ""
        return soup(story).replace("<div>Follow", f"{notice}<div>Follow").replace("A title number", f"Edition {i}: a title number")

    # a notice on a tenth of the pages, and a story that stands on twelve of 212 under twelve titles
    rows = [(i, f"http://d.org/{i}", page(i, i)) for i in range(200)] + [(1000 + i, f"http://d.org/c{i}", page(1000 + i, 500)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 212 and not any("Mondays" in t or "Follow us" in t for t in got.values())
    assert all("first paragraph of story 500" in got[1000 + i] and "second one of 500" in got[1000 + i] for i in range(12))
    assert all(f"Edition {i}: a title" in got[i] and f"second one of {i} " in got[i] for i in range(200))
