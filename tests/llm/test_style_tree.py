import random

import pytest

from quarrymill.llm import queries
from quarrymill.llm.style_tree import DEPTH, LEAST_PAGES, extract_main_text, parse_page

SCHEMA = "page_id long, url string, html string"


def alone(html):
    """What one page keeps by the prior alone."""
    return "\n".join(block["text"] for block in parse_page(html)[2] if block["text"] is not None)


@pytest.mark.parametrize("html, text", [
    ("", ""),
    ("plain words", "plain words"),
    ("<p>one<p>two <b>bold<p>three", "one\ntwo bold\nthree"),
    ("<p>a&amp;b &lt;i&gt; &eacute;&#233;&#xe9; &am &amp</p>", "a&b <i> ééé &am &"),
    ("<p>  white \n\t space&nbsp; here  </p>\n\n<p>line<br>break<br/>x</p>", "white space here\nline break x"),
    ("<title>no</title><style>p{}</style><script>if (a<b) '</p>'</script><p>yes</p><noscript>no</noscript>", "yes"),
    ("<nav><ul><li><a href=x>Home</a></ul></nav><header><h1>Site</h1></header><p>Text.</p><footer>(c)</footer>", "Text."),
    ("<article><header><h1>Title</h1><p>By A</p></header><p>Body.</p><footer>Filed</footer><aside>More</aside></article><p>Out</p>", "Title\nBy A\nBody."),
    ("<main><h2>T</h2><p>Body one.</p><form>Mail <input> <button>Go</button></form></main><div>outside</div>", "T\nBody one."),
    ('<div class="cookie-notice">We use cookies</div><div class="post-content"><p>Body.</p></div><div id="comments"><p>Nice!</p></div>', "Body."),
    ('<article class="post has-sidebar"><p>Kept words.</p><div class="share-buttons">Share</div><p>More <span class="ad">Buy</span> words.</p></article>', "Kept words.\nMore words."),
    ('<div class="siteFooter">x</div><div class="leftSidebar">y</div><div role="banner">z</div><div hidden>h</div><div style="display: none">d</div><p>t</p>', "t"),
    ("<article><table><tr><th>a<th>b<tr><td>1<td>2</table><ul><li>x<li>y<ul><li>z</ul></ul><dl><dt>t<dd>d</dl></article>", "a b\n1 2\nx\ny\nz\nt\nd"),
    ('<div><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a> x</li></ul><p><a href="/c">A linked paragraph.</a></p></div>', "Two x\nA linked paragraph."),
    ("<article><p>first</p></div></b></section><p>second</article></p>", "first\nsecond"),
    ('<section class="comments"><article class="comment"><p>Long reader comment here.</p></article></section><article><p>The text.</p></article>', "The text."),
    ("<article><p>cut in a tag <b", "cut in a tag"),
    ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
])
def test_one_page(html, text):
    assert alone(html) == text


def site(rng, host, count, page_of):
    return [(f"https://{host}/p{n}?x#y", page_of(rng, n)) for n in range(count)]


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(1000)) for _ in range(n)) + "."


def table_of(spark, rows):
    return spark.createDataFrame([(n, url, html) for n, (url, html) in enumerate(rows)], SCHEMA)


def texts(df):
    return {row.page_id: row.text for row in extract_main_text(df).collect()}


def test_what_a_site_repeats_goes_without_any_name_for_it(spark):
    rng, want = random.Random(1), []

    def page_of(rng, n):
        text = [words(rng, 12) for _ in range(3)]
        want.append("\n".join(text))
        lines = "".join(f"<p>{t}</p>" for t in text)
        return f'<body><div class="x1">Welcome to us<div>Our offers</div></div><div class="x2">{lines}</div><div class="x3">Call 123 now. Slogan {n % 2}.</div></body>'

    rows = site(rng, "a.example", 40, page_of)
    got = texts(table_of(spark, rows))
    assert [got[n] for n in range(40)] == want


def test_repeated_branch_inside_an_article_goes_and_plain_text_stays(spark):
    rng, want = random.Random(2), []

    def page_of(rng, n):
        text = words(rng, 15)
        want.append(f"License text.\n{text}\nYes")
        return f'<article><p>License text.</p><p>{text}</p><div class="b7"><p>Become a member today.</p></div><ul><li>Yes</ul></article>'

    got = texts(table_of(spark, site(rng, "b.example", 30, page_of)))
    assert [got[n] for n in range(30)] == want


def test_copies_of_an_article_do_not_make_it_noise(spark):
    rng = random.Random(3)
    copy = "".join(f"<p>{words(rng, 10)}</p>" for _ in range(4))
    page = lambda body: f'<body><div class="q">Same on each page</div><div class="w">{body}</div></body>'
    mixed = [(f"http://c.example/{n}", page(copy if n % 3 else f"<p>{words(rng, 30)}</p>")) for n in range(60)]
    only = [(f"http://d.example/{n}", page(copy)) for n in range(20)]
    got = texts(table_of(spark, mixed + only))
    text = copy[3:-4].replace("</p><p>", "\n")
    assert all(got[n] == text for n in range(60) if n % 3)
    assert all("Same" not in got[n] for n in range(60))
    assert all(got[n].endswith(text) for n in range(60, 80)), "a host of copies alone shows nothing of what is noise"


def test_rare_variant_is_judged_by_what_it_lies_in(spark):
    rng = random.Random(4)
    menu = lambda n: "".join(f'<div class="{"on" if i == n else "off"}{"abcdefgh"[i]}">Item {i}</div>' for i in range(8))
    rows = [(f"http://e.example/{n}", f'<div class="m">{menu(n % 8)}</div><div class="t"><p>{words(rng, 20)}</p></div>') for n in range(24)]
    assert LEAST_PAGES > 3 and all("Item" not in text for text in texts(table_of(spark, rows)).values())


def test_odd_rows(spark):
    deep = "<div>" * (3 * DEPTH) + "deep text" + "<p>p</p>" * 3
    rows = [
        ("http://h.example/a", None), (None, "<p>no url</p>"), ("not a url", "<p>odd url</p>"), ("http://[bad", "<p>bad host</p>"), ("http://h.example/b", ""),
        ("http://h.example/c", deep), ("http://h.example/d", "<p>" + "long text " * 200_000 + "</p>"), ("http://h.example/d", "<p>same</p>"), ("http://h.example/d", "<p>same</p>"),
    ]
    table = spark.createDataFrame([(n // 8 * 7 + n % 8, url, html, 1, [2]) for n, (url, html) in enumerate(rows)], SCHEMA + ", text int, host array<int>")
    got = extract_main_text(table)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(got.collect(), key=lambda r: (r.page_id, r.text))
    assert [r.text for r in found] == ["", "no url", "odd url", "bad host", "", "deep text\np\np\np", ("long text " * 200_000).strip(), "same", "same"]
    assert all(r.n_chars == len(r.text) for r in found)
    assert extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.page_id for r in extract_main_text(spark.createDataFrame([("x", None, "<p>t")], "page_id string, url string, html string")).collect()] == ["x"]


def test_query_finds_every_article_whole(spark, small_dir):
    """Against the articles of the given pages, cut out by their tags."""
    import html as html_lib
    import re

    got = {row.page_id: row for row in queries.queries()["op12_site_style_tree"](spark, small_dir).collect()}
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").collect()
    assert len(got) == len(pages) > 0
    for page in pages:
        inner = re.search(r"<article>(.*)</article>", page.html, re.S).group(1)
        blocks = [" ".join(html_lib.unescape(re.sub("<[^>]*>", "", part)).split()) for part in re.split(r"</?p>|</?h1>", inner)]
        assert got[page.page_id].text == "\n".join(filter(None, blocks)) and got[page.page_id].url == page.url
