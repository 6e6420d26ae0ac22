"""Queries against their SQL on small tables that hold what the given ones hold only when large."""

from quarrymill.plans import registry
from tests.compare import assert_same


def check(spark, directory, name, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{directory}/{name}.parquet")


def same(spark, directory, query):
    return assert_same(registry.queries()[query](spark, str(directory)), str(directory), registry.oracle_sql()[query])


def test_all_work_has_no_least_id(spark, tmp_path):
    rows = [(n, "BUILDING", "u") for n in (-3, 0, 1, 2)]
    check(spark, tmp_path, "customer", "c_custkey long, c_mktsegment string, c_name string", rows)
    check(spark, tmp_path, "orders", "o_custkey long, o_orderstatus string, o_orderpriority string", [(2, "P", "1-URGENT"), (1, "P", "2-HIGH")])
    assert same(spark, tmp_path, "all_pending_work") == 3


def test_pages_over_the_limit_are_cut_in_the_sql_too(spark, tmp_path):
    texts = ["word " * 20000, "x" * 44115, "x" * 44116, "", None, "line\n" * 9000 + "\n\n" + "y" * 50000, "short"]
    check(spark, tmp_path, "documents", "doc_id long, source string, text string", [(n, "s", text) for n, text in enumerate(texts)])
    assert same(spark, tmp_path, "chunked_sites") > 6


def test_references_without_a_semicolon(spark, tmp_path):
    html = ["<title>a &amp;&amp</title><p>b&ampc &copy2 &quot&#39</p>&#39;x &am &a &", "<p>&amp;lt; &lt;b&gt; &middot;</p>", "<p>&amplt; x&nbsp</p>", ""]
    check(spark, tmp_path, "pages", "page_id long, url string, html string", [(n, "http://e.com/", h) for n, h in enumerate(html)])
    assert same(spark, tmp_path, "page_text") == same(spark, tmp_path, "parsed_pages") == len(html)
