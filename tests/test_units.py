"""Small literal cases of expressions and helpers, with the results that they must give."""

import json
import random
from urllib.parse import urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.functions import outcomes, pages, text, urls
from quarrymill.operators import chunks, discovery, extract, facts, health, html, links, relational, sections, telemetry, text_lines
from quarrymill.sources import files
from quarrymill.staging import in_buckets, with_position


def values(spark, inputs, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}").coalesce(1)
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_challenge_and_soft_404(spark):
    assert values(spark, ["Just a moment... Cloudflare", "We use Cloudflare", None], pages.is_challenge) == [True, False, False]
    cases = ["Page not found", "Page not found" + " " * 1000, "not found", "not found" + "x" * 291, None]
    assert values(spark, cases, pages.is_soft_404) == [True, False, True, False, False]
    assert values(spark, ["x" * 100, "x" * 99, None], lambda x: pages.page_ok(x, F.lit(None))) == [True, False, False]


def test_blacklist(spark):
    urls_in = ["https://www.facebook.com/x", "https://m.br.linkedin.com", "https://notfacebook.com", "facebook.com", ""]
    rows = spark.createDataFrame(list(enumerate(urls_in)), "i int, url string")
    domains = spark.createDataFrame([(d,) for d in discovery.BLACKLIST], "domain string")
    assert {r.i for r in discovery.without_blacklisted(rows, "url", domains).collect()} == {2, 4}


def test_extract_links(spark):
    hrefs = ["/a,", "#x", "JavaScript:void(0)", "/f.PDF", "/i.png", "//other.com/a", "mailto:a@b.c", "b/c?q=1", "/x?i=y.jpg"]
    html_text = "".join(f'<a class="k" href="{h}">t</a>' for h in hrefs)
    rows = spark.createDataFrame([(1, "https://e.com/d/p", html_text), (2, "https://e.com/", None)], "page_id long, url string, html string")
    got = {(r.link, r.kind) for r in links.extract_links(rows).collect()}
    assert got == {("https://e.com/a", "internal"), ("https://e.com/f.PDF", "document"), ("https://e.com/d/b/c?q=1", "internal")}


def by_parser(base, markup):
    """Links of a page by the library's parser and urljoin alone."""
    hrefs = html.parse_page(markup)[1]
    whole = lambda x: x.split("#")[0]
    found = html.resolved(base, [h.replace("&", "&amp;") for h in hrefs])
    return sorted({x for x in found if urlsplit(x).netloc == urlsplit(base).netloc and not ("#" in x and whole(x) == whole(base))})


def extracted(spark, base, pages):
    got = {n: [] for n in range(len(pages))}
    rows = spark.createDataFrame([(n, base, markup) for n, markup in enumerate(pages)], "page_id long, url string, html string")
    for r in links.extract_links(rows).collect():
        got[r.page_id].append(r.link)
    return [sorted(found) for found in got.values()]


def test_links_in_any_markup(spark):
    base = "https://h.com/a/b?x=1"
    cases = {
        "<a href='/single'>": ["https://h.com/single"],
        "<a class=x href=/bare>": ["https://h.com/bare"],
        '<A HREF="/q?a=1&amp;b=2">': ["https://h.com/q?a=1&b=2"],
        '<a data-href="/wrong" href="/right">': ["https://h.com/right"],
        '<a title="a>b" href="/gt"><a title=\'<a href="/in">\' href=/out>': ["https://h.com/gt", "https://h.com/out"],
        '<img alt="<a href=/not>"><a\nhref = "/line"\n>': ["https://h.com/line"],
        '<a href="/one" href="/two"><area href="/area"><abbr href=/abbr>': ["https://h.com/two"],
        "<a href><a href=''>x": [base],
        '<a name="n"><b href="/not"></b><a>': [],
        '<a href="../up/./x"><a href="./"><a href="..">': ["https://h.com/", "https://h.com/a/", "https://h.com/up/x"],
        '<a href="https://h.com/c/../d"><a href="//h.com/e"><a href="c//d">': ["https://h.com/a/c/d", "https://h.com/c/../d", "https://h.com/e"],
        '<a href="/p&eacute;"><a href="/r?a=1&copy=2&region=3">': ["https://h.com/p\u00e9", "https://h.com/r?a=1&copy=2&region=3"],
        '<!-- <a href="/gone"> --><a href="/here">': ["https://h.com/here"],
        '<script>x = "<a href=\\"/no\\">"; y = "<a href=/no2>"</script><a href="/yes">': ["https://h.com/yes"],
        '<a href="http://[bad">x<a href=/ok>': ["https://h.com/ok"],
        "<a href='#top'><a href='javascript:go()'><a href=' /space '>": ["https://h.com/space"],
        '<a href="HTTPS://h.com/case"><a href="/empty?">': ["https://h.com/case", "https://h.com/empty"],
        '<a href="/whole"><a href="/cut': ["https://h.com/whole"],
        "<a href=/slash/><a/href=/after>": ["https://h.com/after", "https://h.com/slash/"],
        "text > <a href=/x>y</a > 'quote": ["https://h.com/x"],
    }
    assert extracted(spark, base, list(cases)) == list(cases.values())
    assert extracted(spark, base, [None]) == [[]]
    rows = spark.createDataFrame([(1, base, "<a href=/a><a href='/&eacute;'>"), (2, base, "<a href=/a>"), (3, base, None)], "page_id long, url string, html string")
    assert tuple(links.link_routes(rows).first()) == (2, 1, 3, 1)


def test_links_equal_the_parsers_on_generated_pages(spark):
    rng = random.Random(8)
    values = ["/a", "b/c.html", "../d", "./e/../f?q=1&amp;r=2", "?page=2", "//h.com/g", "https://h.com/h", "https://o.com/i", "/j?k=%20l", "/&#109;", "/caf&eacute;", "/a//b", "x;y/../z", "/m,", "mailto:n@h.com", "http:o", "", "/p?q#r", "../../../s"]
    bases = ["https://h.com/a/b/c?x=1", "https://h.com", "https://h.com/d/", "https://h.com/e;f/g"]

    def quoted(value):
        style = rng.choice(["double", "single", "bare"]) if value else "double"
        return {"double": f'"{value}"', "single": f"'{value}'", "bare": value}[style]

    def tag():
        name = rng.choice(["a", "A", "a", "area", "p", "img"])
        attrs = [rng.choice(["href", "HREF", "Href"]) + rng.choice(["=", " = ", "=\n"]) + quoted(rng.choice(values)) for _ in range(rng.choice([0, 1, 1, 1, 2]))]
        attrs += rng.sample(['data-href="/wrong"', 'title="x > y"', "title='<a href=/w>'", "disabled", 'alt="it\'s"', "class=k", "href2=/v", 'x="a = b"', "hreflang=en"], rng.randrange(3))
        rng.shuffle(attrs)
        return f"<{name}{rng.choice([' ', chr(10), '  '])}{' '.join(attrs)}{rng.choice(['', ' ', ''])}>" + rng.choice(["text ", "</a>", "<!-- <a href=/c> -->", "<script>if (a<b) '<a href=/s>'</script>", "1 > 0 "])

    for base in bases:
        pages = ["".join(tag() for _ in range(rng.randrange(1, 12))) for _ in range(250)]
        want = [sorted(set(by_parser(base, page))) for page in pages]
        assert extracted(spark, base, pages) == want


def test_link_scores(spark):
    rows = spark.createDataFrame([(1, "https://e.com/", f"https://e.com{p}") for p in ("/blog/produtos", "/blog", "/sobre", "/x?p=2", "/")], "page_id long, url string, link string")
    got = {r.link[13:]: r.score for r in links.score_links(rows).collect()}
    assert got == {"/blog/produtos": -53, "/sobre": 48, "/x?p=2": 28}


def test_url_variations_and_resolution(spark):
    expected = ["https://www.e.com", "https://e.com", "http://www.e.com", "http://e.com"]
    assert values(spark, ["e.com/"], discovery.url_variations) == [expected]
    base = F.lit("http://h.com:8080/a/b?c#d")
    assert values(spark, ["x", "/x", "?y", "#z", "//o.com/p", "ftp://q", ""], lambda x: urls.resolve(base, x)) == [
        "http://h.com:8080/a/x", "http://h.com:8080/x", "http://h.com:8080/a/b?y", "http://h.com:8080/a/b?c#z", "http://o.com/p", "ftp://q", "http://h.com:8080/a/b?c#d",
    ]


def test_rank_percentiles(spark):
    rows = spark.createDataFrame([("a", float(n)) for n in range(1, 11)] + [("b", 7.0), (None, 3.0), ("b", None)], "k string, v double")
    got = {r.k: (r.p50, r.p99) for r in telemetry.rank_percentiles(rows, ["k"], "v", [50, 99]).collect()}
    assert got == {"a": (6.0, 10.0), "b": (7.0, 7.0), None: (3.0, 3.0)}
    assert telemetry.rank_percentiles(rows, [], "v", [50], "median").first().p50 == 5.5
    assert telemetry.rank_percentiles(rows.where("v < 0"), ["k"], "v", [50]).count() == 0


def test_position_spans_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id"))
    got = with_position(rows, ["k"], [F.col("id").desc()]).collect()
    assert all(r.position == sum(1 for _ in range(r.id + 3, 5000, 3)) for r in got) and len(got) == 5000


def test_tokens_and_whitespace(spark):
    assert values(spark, ["12345678"], text.token_estimate) == [2]
    assert spark.range(1).select(text.message_tokens(F.lit(60), F.lit(2)).alias("t")).first().t == 220
    cases = ["a  \n\n\n\nb", "", "\n\n\n\na", "x\t\n", "a\n\n\n\n\nb\n\n\n\n"]
    assert values(spark, cases, text_lines.normal_whitespace) == ["a\n\n\nb\n", "", "\n\na\n", "x\n", "a\n\n\nb\n\n\n"]


def test_line_removal(spark):
    cases = ["abcde\nab\nabcde  \nab\nabcdef", "abcde\nabcde\nx\nabcde", ""]
    split = lambda x: F.split(x, "\n", -1)
    assert values(spark, cases[:2], lambda x: F.array_join(text_lines.keep_first_lines(split(x)), "|")) == ["abcde|ab|ab|abcdef", "abcde|x"]
    assert values(spark, cases[:2], lambda x: F.array_join(text_lines.drop_consecutive_lines(split(x)), "|")) == ["abcde|ab|abcde  |ab|abcdef", "abcde|x|abcde"]


def test_loop_detector(spark):
    rows = spark.createDataFrame([(1, "one two three four " * 21), (2, "one two three four " * 2), (3, "w" + "x y z " * 1500 + "}"), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.looping for r in text_lines.loop_flags(rows).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_products(spark):
    assert values(spark, ["X100", "5000X", "AB-123", "10 mm", "consultoria", ""], facts.is_likely_product) == [True, True, True, True, False, False]


def test_contact_routing(spark):
    rows = ["A@B.com ", "1133334444", "(11) 3333-4444", "https://e.com/x/?u=1", "Rua", "  "]
    table = spark.createDataFrame([("c", 0, i, "contact", v, None) for i, v in enumerate(rows)], "company string, chunk int, pos int, section string, value string, quote string")
    got = {(r.pos, r.field, r.value) for r in facts.routed(table).collect()}
    assert got == {(0, "emails", "a@b.com"), (1, "phones", "1133334444"), (2, "locations", "(11) 3333-4444"), (3, "website_url", "https://e.com/x")}


def test_company_names_and_ranges(spark):
    name = ["METALURGICA MEDEIROS LTDA"]
    assert values(spark, name, text.company_base_name) == ["METALURGICADEIROS"]
    assert values(spark, name, lambda x: text.company_base_name(x, True)) == ["METALURGICA MEDEIROS"]
    assert values(spark, ["10-50", "100+", None], lambda x: text.employee_range(x)[0]) == [10, None, None]


def test_reason_buckets(spark):
    cases = ["probe_too_many_redirects", "proxy_fail:http_503", "scrape_error(Soft 404)", None, "probe_timeout_concurrency", "strange", "x blocked"]
    assert values(spark, cases, outcomes.reason_bucket) == [
        "probe:redirect_loop", "proxy:http_5xx", "scrape:soft_404", "unknown", "probe:other", "other:strange", "scrape:blocked_waf",
    ]


def test_health_without_events_is_full(spark):
    score = health.health_score(F.lit(1.0), F.lit(0.0), F.lit(0), F.lit(0), F.lit(None).cast("long"))
    assert spark.range(1).select(score.alias("s")).first().s == 100


def test_site_decision_and_choice(spark):
    answers = ['{"site": "https://a.b", "site_oficial": "SIM"}', '```json\n{"site": "https://a.b", "site_oficial": "sim"}\n```', '{"site": "nao_encontrado", "site_oficial": "sim"}', "no", None]
    assert values(spark, answers, discovery.site_decision) == ["https://a.b", "https://a.b", None, None, None]
    chosen = values(spark, ["[2, 9, 1]", '{"indices": [1]}', "?", None], lambda x: discovery.chosen_links(F.array(F.lit("b"), F.lit("a")), x))
    assert chosen == [["b", "a"], ["a"], [], []]


def test_parse_page_keeps_visible_text():
    page = "<p>A &amp; B<script>x<b></script><br>c</p><style>p{}</style><a href='/l'> d </a><noscript>no</noscript>"
    assert html.parse_page(page) == ("A & B\nc\nd", ["/l"]) and html.parse_page(None) == ("", [])


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(2, 40))
def test_split_text_keeps_all_and_fits(content, limit):
    pieces = chunks.split_text(content, limit)
    assert "".join(pieces) == content and all(len(p) <= limit for p in pieces)


def test_chunks_never_pass_the_limit(spark):
    rows = [("s", 1, "u1", "word " * 500), ("s", 2, "u2", "x" * 900), ("s", 3, "u3", "tail"), ("t", 1, "v", None), ("t", 2, "v2", "")]
    got = chunks.chunk_pages(spark.createDataFrame(rows, "site string, pos int, url string, text string"), "site", 100).collect()
    assert all(r.tokens <= 100 for r in got)
    for site, want in (("s", "word " * 500 + "x" * 900 + "tail"), ("t", "")):
        own = sorted((r.chunk_index, r.content) for r in got if r.site == site)
        assert "".join(c for _, c in own).replace("\n\n", "") == want and {r.total_chunks for r in got if r.site == site} == {len(own)}


def test_marked_documents_split_back(spark):
    rows = spark.createDataFrame([("s", 2, "https://e.com", "b"), ("s", 1, "https://d.com", "a\n\nx")], "site string, pos int, url string, text string")
    back = chunks.split_marked(chunks.marked_documents(rows, "site"), "site").orderBy("pos").collect()
    assert [r.url for r in back] == ["https://d.com", "https://e.com"] and "a\n\nx" in back[0].page


def test_token_bucket_is_the_plain_fold(spark):
    rows = [(k, i, float(t)) for k in range(3) for i, t in enumerate([0, 0, 0, 1, 1.5, 9, 9, 9, 9])]
    got = health.bucket_admissions(spark.createDataFrame(rows, "k long, event_id long, seconds double"), "k", 0.5, 2.0).collect()
    assert {(r.k, r.event_id): r.admitted for r in got} == {(k, i): a for k in range(3) for i, a in enumerate([True, True, False, False, False, True, True, False, False])}


def test_result_rows_and_children(spark):
    rows = spark.createDataFrame([("a", ["x", "y"], None), ("b", None, "bad"), ("c", [], "none")], "key string, chunks array<string>, error string")
    got = {tuple(r) for r in relational.result_rows(rows).collect()}
    assert got == {("a", 1, 2, "x", None), ("a", 2, 2, "y", None), ("b", 0, 0, None, "bad"), ("c", 0, 0, None, "none")}
    old = spark.createDataFrame([(1, "o"), (2, "o")], "company_id int, name string")
    new = spark.createDataFrame([(1, " n "), (2, "  ")], "company_id int, name string")
    assert {tuple(r) for r in relational.refresh_children(old, new, "company_id", "name").collect()} == {(1, "n"), (2, "o")}


@pytest.mark.parametrize("times", [[(0, 10), (5, 15), (10, 20)], [(0, 1)]])
def test_peak_concurrency(spark, times):
    at = lambda s: F.timestamp_seconds(F.col(s) * 40000).cast("timestamp_ntz").alias(s)
    spans = spark.createDataFrame(times, "a long, b long").select(at("a"), at("b"))
    assert telemetry.peak_concurrency(spans, "a", "b").first().peak == min(2, len(times))


def test_balanced_object():
    assert extract.balanced_object('x {"a": "}", "b": {"c": "\\"{"}} tail {') == '{"a": "}", "b": {"c": "\\"{"}}'
    assert extract.balanced_object("{ never") is None and extract.balanced_object(None) is None


def test_json_object(spark):
    cases = {
        '{"k": 1}': '{"k": 1}', '```json\n{"k": {"l": 2}}\n```': '{"k": {"l": 2}}', 'say {"k": 3} then {': '{"k": 3}', "none": None, None: None,
        "{'k': 'v', 'l': [1, 2,],}": '{"k": "v", "l": [1, 2]}', '{"a": [{"b": 1}, {"c": "d': '{"a": [{"b": 1}, {"c": "d"}]}', '{"a": [1, ': '{"a": [1]}', "{]": None,
        '{"it\'s": "he said \'x\'"}': '{"it\'s": "he said \'x\'"}',
    }
    rows = spark.createDataFrame([(n, c) for n, c in enumerate(cases)], "id long, answer string")
    got = {r.id: r.json for r in extract.with_json_object(rows, "answer").collect()}
    plain = lambda text: text and json.loads(text)
    assert [plain(got[n]) for n in range(len(cases))] == [plain(want) for want in cases.values()]


def test_repaired_urls(spark):
    cases = ['"http://h.com/a b,"', "http://h.com/é?q=a b&r=ü", "http://h.com/x%20%22y?z=1%22", "http://h.com/ok/p?a=1&b=2", "http://h.com/p?a=b=c&d", None]
    expected = ["http://h.com/a%20b", "http://h.com/%C3%A9?q=a%20b&r=%C3%BC", "http://h.com/x?z=1", "http://h.com/ok/p?a=1&b=2", "http://h.com/p?a=b%3Dc&d", None]
    assert [extract.repaired_url(u) for u in cases] == expected
    rows = spark.createDataFrame([(n, u) for n, u in enumerate(cases)], "id long, u string")
    assert [r.u for r in sorted(extract.with_repaired(rows, "u").collect())] == expected


def test_loose_lists(spark):
    cases = ['{"x": ["a", " ", "b"]}', '{"x": "a"}', '{"x": null}', "[]", None]
    assert values(spark, cases, lambda x: extract.as_list(x, "x")) == [["a", "b"], ["a"], [], [], []]
    assert values(spark, ['[{"x": 1}, {}]', '{"x": 2}'], extract.first_object) == ['{"x":1}', '{"x": 2}']


def test_sections_merge_by_name(spark):
    rows = [
        (1, 1, "a", ["x", " ", " y "], "short", "first words here"), (1, 3, "a", ["z", "x"], "longer text", "something else entirely new"), (1, 2, "a", None, "equal leng1", "first words"),
        (1, 4, " ", ["q"], "no name", "no name"), (1, 5, None, ["q"], None, None), (2, 1, "a", [], None, None), (1, 6, "b", ["y"], None, "only"),
    ]
    entries = spark.createDataFrame(rows, "company long, place long, name string, items array<string>, told string, said string")
    got = {(r.company, r.name): (r["items"], r.told, r.said) for r in sections.merged_entries(entries, "name", "place", ["items"], ["told"], ["said"]).collect()}
    assert got == {
        (1, "a"): (["x", "y", "z"], "equal leng1", "first words here. something else entirely new"), (2, "a"): ([], None, None), (1, "b"): (["y"], None, "only"),
    }


def test_bytes_are_decoded(spark):
    cases = [
        ("é€".encode(), None, "é€"), ("é".encode("latin-1"), None, "é"), ("é".encode("latin-1"), "text/html; charset=Latin1", "é"), ("€".encode("cp1252"), "text/html; charset=cp1252", "€"),
        (b'<meta charset="nosuch">' + "é".encode(), None, '<meta charset="nosuch">é'), (b"%PDF-1.4 x", None, ""), (b"x", "application/pdf", ""), (b"", None, ""),
    ]
    rows = spark.createDataFrame([(n, body, header) for n, (body, header, _) in enumerate(cases)], "id long, body binary, header string")
    got = {r.id: r.html for r in files.decoded(rows, "body", "header", "html").collect()}
    assert got == {n: want for n, (_, _, want) in enumerate(cases)}



def test_loop_flags(spark):
    assert text_lines.most_repeats("") == (0, 0) and text_lines.most_repeats("a b c") == (0, 0)
    assert text_lines.most_repeats("a b c d " * 5) == (5, 1) and text_lines.most_repeats("x" * 101) == (0, 8)
    texts = ["", "go on and on, " * 30, "word " * 19 + "end of it", "z" * 99, "plain text " * 900, "{" + "".join(f"{n} " for n in range(3000)) + "}  ", "".join(f"{n} " for n in range(3000))]
    rows = spark.createDataFrame([(f"d{n}", t) for n, t in enumerate(texts)], "doc_id string, text string")
    got = {r.doc_id: r for r in text_lines.loop_flags(rows).collect()}
    assert [got[f"d{n}"].looping for n in range(7)] == [False, True, False, False, True, False, True]
    assert all((got[f"d{n}"].max_ngram, got[f"d{n}"].max_piece) == text_lines.most_repeats(t) for n, t in enumerate(texts))


def test_validated_chunks_lose_nothing_and_number_on(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word ", "\n", "\n\n", "longer_word_without_end"]) for _ in range(rng.choice([3, 40, 400]))) for _ in range(30)] + ["x" * 1000, ""]
    rows = spark.createDataFrame([(n % 3, n, 0, t, f"u{n}") for n, t in enumerate(texts)], "site int, chunk_index int, total_chunks int, content string, page_source string")
    got = chunks.validated_chunks(rows, "site", 100).orderBy("site", "chunk_index").collect()
    for site in range(3):
        own = [r for r in got if r.site == site]
        assert [r.chunk_index for r in own] == list(range(1, len(own) + 1)) and {r.total_chunks for r in own} == {len(own)}
        assert all(r.tokens <= 100 and r.tokens == len(r.content) // 3 for r in own)
        for n, text in enumerate(texts):
            if n % 3 == site:
                assert "".join(r.content for r in own if r.page_source == f"u{n}").split() == text.split() or "longer" in text
                assert "".join(r.content for r in own if r.page_source == f"u{n}").replace(" ", "") == text.replace(" ", "") or not text.strip()
    assert chunks.validated_chunks(rows.where("site > 5"), "site", 100).count() == 0


def test_row_ids_have_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert sorted((r.row_id, r.k) for r in files.with_row_ids(rows, ["k"]).collect()) == [(n, n) for n in range(1000)]


def test_pages_with_other_entities_go_to_the_parser(spark):
    rows = spark.createDataFrame([(1, "u", "<p>caf&eacute; &amp; p&#227;o</p>"), (2, "u", "<p>a &amp; b</p>"), (3, "u", None)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.page_texts(rows).collect()} == {1: "café & pão", 2: "a & b", 3: None}


def test_equal_buckets_join_without_a_shuffle(spark):
    rows = spark.range(5000).select("id", F.col("id").cast("string").alias("key"), F.lit("new").alias("status"), F.lit("u").alias("url"))
    work, done = in_buckets(rows, "work", "key", 8), in_buckets(rows.where("id % 3 = 0").select("key"), "done", "key", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = relational.open_work(work, done, "key", ["new"])
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 5000 - 1667
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_percentiles_from_merged_states(spark):
    rows = spark.range(200_000).select((F.col("id") % 37).alias("instance"), F.pow(F.lit(1.0001), F.col("id")).alias("v"), F.lit("k").alias("key"))  # skewed by far
    states = telemetry.value_states(rows, ["key", "instance"], "v")
    assert states.agg(F.max(F.octet_length("summary"))).first()[0] < 60_000
    steps = telemetry.merged_states(states.withColumn("half", F.col("instance") % 2), ["key", "half"])
    for merged in (telemetry.merged_states(states, ["key"]), telemetry.merged_states(steps.orderBy(F.desc("half")), ["key"])):
        row = telemetry.state_percentiles(merged, ["key"], [1, 50, 95, 99.9]).first()
        assert row.n == 200_000 and row.mean == pytest.approx(rows.agg(F.avg("v")).first()[0])
        for p, name in ((1, "p1"), (50, "p50"), (95, "p95"), (99.9, "p99.9")):
            assert abs(rows.where(F.col("v") <= row[name]).count() / 200_000 - p / 100) < 2 * telemetry.RANK_ERROR
    assert telemetry.value_states(rows.where("v < 0"), ["key"], "v").count() == 0
