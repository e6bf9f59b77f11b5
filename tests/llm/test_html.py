import html
import re

from riskloom.llm import queries, site_style

from ..conftest import SF_SMALL

SCHEMA = "page_id bigint, url string, html string, text string"


def texts(spark, pages):
    df = spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(pages)], SCHEMA)
    return [r.text for r in site_style.extract(df).orderBy("page_id").collect()]


def test_parts_that_are_named(spark):
    page = ("<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>"
            "<div class='ad'>Buy</div><div id=cookie-notice>Cookies</div><article><h1>Head &amp; line</h1><p><b>One&nbsp;two</b>\n three<br>four"
            "<p>Five <script>var t='</p>';</script>six<aside>Note</aside><form><label>Mail</label><input></form><section class='comments'><p>First!</section>"
            "<blockquote>Said &lt;b&gt; &eacute;</blockquote></article><aside>Side</aside><footer>&copy; me</footer></body></html>")
    assert texts(spark, [("http://a.b/c", page)]) == ["Head & line\nOne two three four\nFive six\nSaid <b> é"]


def test_repeated_branches_go_and_varied_ones_stay(spark):
    pages = [(f"http://h.example/{i}", f"<body><div class=x1>Always the same words here</div><div class=x2><p>Story {i} tells of {i * 7}</p></div></body>") for i in range(60)]
    assert texts(spark, pages) == [f"Story {i} tells of {i * 7}" for i in range(60)]


def test_hosts_are_apart(spark):
    pages = [(f"http://one.example/{i}", f"<div class=t><p>Same</p></div><div class=u><p>n {i}</p></div>") for i in range(80)]
    pages += [(f"http://two.example/{i}", f"<div class=t><p>Told {i}</p></div>") for i in range(80)]
    got = texts(spark, pages)
    assert got[:80] == [f"n {i}" for i in range(80)] and got[80:] == [f"Told {i}" for i in range(80)]


def test_odd_pages(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 20000 + "</article>"
    pages = [(None, None), ("", ""), ("http://x.y", "plain text"), (None, "<article><p>unclosed <b>bold"), ("http://x.y", long), ("x", "<<>> < & &am &copy"),
             ("http://x.y", "<!-- never closed <p>gone"), ("http://x.y", "<article><p>twice</p></article>"), ("http://x.y", "<article><p>twice</p></article>")]
    got = texts(spark, pages)
    assert got[0] == got[1] == "" and got[2] == "plain text" and got[3] == "unclosed bold" and got[4].count("\n") == 19999
    assert got[5] == "<<>> < & &am ©" and got[6] == "" and got[7] == got[8] == "twice"
    assert texts(spark, []) == []


def test_query(spark):
    want = {}
    for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want[r.page_id] = (r.url, "\n".join(p for p in parts if p))
    rows = queries.op9_html(spark, SF_SMALL).collect()
    assert {r.page_id: (r.url, r.text) for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_empty_icons_hide_nothing(spark):
    page = "<body><svg class='i'/><math/><svg class=j><path d='m'/></svg><article><p>Story <svg viewBox='0 0 1 1' />goes on</p><svg><text>gone</text></svg></article></body>"
    assert texts(spark, [("http://a.b/c", page)]) == ["Story goes on"]


def test_names_that_hide_no_article(spark):
    story = "<h1>Head</h1><p>Story</p>"
    pages = [f"<body class='single right-sidebar'><article>{story}</article></body>", f"<div class='no-sidebar'><article>{story}</article></div>",
             f"<main class='has-header'>{story}</main>", f"<form id='aspnetForm'><div>{story}</div></form>", f"<body class=search><div class=widget><main>{story}</main></div></body>",
             "<article><h2 id='search'>Head</h2><section id='related-work'><p>Story</p></section></article>",
             "<article><h2 id='how-to-share' title='The hidden cost'>Head</h2><p data-id='footer' data-title='hidden gems'>Story</p></article>"]
    assert texts(spark, [(f"http://h{i}.x/", p) for i, p in enumerate(pages)]) == ["Head\nStory"] * len(pages)
    plain = "<body><nav>Menu</nav><form id=aspnetForm><div><p>A longer story</p></div></form><form><p>Find</p></form></body>"
    assert texts(spark, [("http://a.b/", plain)]) == ["A longer story"]
    page = "<article><p>Story</p><form><p>Mail</p></form></article><div class='related'><article>Other</article></div><p hidden>no</p><div role=search>Find</div>"
    assert texts(spark, [("http://a.b/", page)]) == ["Story"]
