"""Operators on small tables made by hand."""

import datetime as dt

from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.functions import urls as U
from loomspark.operators import crawl, evaluation, graph, ranking, retrieval, snippets, tables, vectors
from loomspark.session import cut, hash_sample
from loomspark.sources import config, pages


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_admission(spark):
    urls = ["HTTPS://Example.com/docs?id=1&utm_source=x&fbclid=y", "https://example.com/photo.jpg", "https://example.com/login/reset", "http://2001:4860:a003::68/", "mailto:a@b.example", None, "", "https://user:pw@Example.com:443/a?b=2&a=1#f", "https://e.example/x?replytocom=3", "https://e.example/ample"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: (r.reason, r.normalized_url) for r in crawl.admission(df).collect()}
    assert got[urls[0]] == (None, "https://example.com/docs?id=1")
    assert got[urls[1]][0] == "filtered_extension"
    assert got[urls[2]][0] == "filtered_path_prefix"
    assert [got[u][0] for u in urls[3:7]] == ["invalid_url"] * 4
    assert got[urls[7]] == (None, "https://example.com/a?a=1&b=2")
    assert got[urls[8]][0] == "filtered_query_param"
    assert got[urls[9]][0] == "filtered_path_contains"
    rules = ({"domains": ["shop.example"], "reject_path_prefixes": ["/my"]},)
    one = crawl.admission(spark.createDataFrame([("http://a.shop.example/my/x",)], "url string"), domain_rules=rules).head()
    assert (one.reason, one.scope) == ("domain_path_prefix_denied", "shop.example")


def test_links(spark):
    df = spark.createDataFrame([("https://Example.com/page", x) for x in ("https://example.com/a?utm_source=test", "https://example.com/a", "https://example.com/page", "mailto:t@example.com", "/b#c", "d", None)], "src string, dst string")
    assert values(graph.edges(df)) == [("https://example.com/page", f"https://example.com/{x}") for x in "abd"]


def test_domains(spark):
    df = spark.createDataFrame([(f"https://{h}/x",) for h in ("b.hatena.ne.jp", "docs.site.com", "www.bbc.co.uk")], "url string")
    assert [r[0] for r in df.select(U.registered_domain("url")).collect()] == ["hatena.ne.jp", "site.com", "bbc.co.uk"]
    assert df.select(U.suffixes(F.lit("a.b.c"))).head()[0] == ["a.b.c", "b.c", "c"]


def test_private(spark):
    df = spark.createDataFrame([(x,) for x in ("10.0.0.1", "8.8.8.8", "192.168.1.1", "172.20.0.1", "host", None)], "h string")
    assert [bool(r[0]) for r in df.select(U.private_ipv4("h")).collect()] == [True, False, True, True, False, False]


def test_pagerank(spark):
    url = "https://{}.example/page".format
    nodes = spark.createDataFrame([(url(x),) for x in "abc"], "url string")
    edge = spark.createDataFrame([(url("a"), url("b")), (url("b"), url("c")), (url("a"), url("c"))], "src string, dst string")
    got = {r.url[8]: r.score for r in graph.pagerank(nodes, edge, 5, tolerance=0.0).collect()}
    assert abs(got["a"] - 0.3812847315) < 1e-9 and abs(got["b"] - 0.5420869175) < 1e-9 and got["c"] == 1.0
    got = {r.url[8]: r.score for r in graph.pagerank(nodes, edge).collect()}
    assert abs(got["a"] - 0.3793266270) < 1e-9 and abs(got["b"] - 0.5405408038) < 1e-9
    assert graph.pagerank(nodes.limit(0), edge).count() == 0


def test_parse_query():
    q = X.parse_query('site:github.com Python "open source" -java -"machine learning"')
    assert (q.text, q.site_filter, q.exact_phrases, q.exclude_terms, q.exclude_phrases) == ("Python", "github.com", ("open source",), ("java",), ("machine learning",))
    assert q.positive == "Python open source"
    assert X.parse_query("Python SITE:GitHub.COM").site_filter == "github.com"
    assert X.parse_query("site:example.com").text == ""
    assert [X.minimum_should_match(n) for n in (1, 2, 3, 5, 6)] == [1, 2, 1, 3, 3]
    assert X.strip_question("What is rain") == "rain"


def test_search(spark):
    index = spark.createDataFrame([("https://a.example/1", "a.example", "/1", "Red fox", "red fox", "the red fox runs"), ("https://b.example/", "b.example", "/", "Dog", "dog", "red dog"), ("https://c.example/x", "c.example", "/x", None, None, None)], "url string, host string, path string, title string, title_terms string, content_terms string")
    assert [r.url[8] for r in retrieval.search(index, "red fox").collect()] == ["a"]
    assert [r.url[8] for r in retrieval.search(index, "red -fox").collect()] == ["b"]
    assert [r.url[8] for r in retrieval.search(index, '"red dog"').collect()] == ["b"]
    assert retrieval.search(index, "site:a.example").count() == 0
    assert [r.url[8] for r in retrieval.search(index, "red", hosts=("b.example",), paths=("/",)).collect()] == ["b", "a"]
    assert retrieval.search(index.limit(0), "red").count() == 0


def test_diversify(spark):
    hits = spark.createDataFrame([(f"https://{h}/", i) for i, h in enumerate(["a.hatena.ne.jp", "b.hatena.ne.jp", "c.hatena.ne.jp", "d.hatena.ne.jp", "x.site.com"], 1)], "url string, rank int")
    assert [r.rank for r in ranking.diversify(hits, 10).orderBy("position").collect()] == [1, 2, 3, 5]
    assert ranking.page_of(41, 2, 10) == {"offset": 10, "last_page": 5}


def test_rerank(spark):
    hits = spark.createDataFrame([("https://x.example/actions", "Actions", 1, 0.2, 0.4), ("https://x.example/copilot", "Copilot", 2, 0.6, 0.1), ("https://y.example/", "Docs", 3, None, None)], "url string, title string, rank int, page_rank double, domain_rank double")
    assert [r.rank for r in ranking.rerank(hits, []).orderBy("new_rank").collect()] == [2, 1, 3]
    assert [r.rank for r in ranking.rerank(hits, ["doc"]).orderBy("new_rank").collect()] == [3, 2, 1]


def test_snippets():
    assert "<mark>Python</mark>" in snippets.snippet("Python is a programming language. Python is popular.", ["Python"])[0]
    assert "<mark>A&amp;B</mark>" in snippets.snippet("Search for A&B in the document", ["A&B"])[0]
    assert snippets.snippet("Some text content here", [], 10)[0] == "Some text ..."
    assert snippets.snippet(None, ["x"]) == ("", "")
    text, plain = snippets.snippet("<script>python</script>", ["python"])
    assert "<script>" not in text and "<script>" in plain


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, -1), (2, 2, 0)], "query_id int, rank int, relevance int")
    got = {r.query_id: r for r in evaluation.query_metrics(df).collect()}
    assert got[1].hit_at_1 == 1.0 and got[1].mrr == 1.0 and round(got[1].ndcg_at_3, 3) == 0.834
    assert got[2].bad_at_3 == 1.0 and got[2].mrr == 0.0 and got[2].first_rank is None


def test_tables(spark):
    a = spark.createDataFrame([("x", 1, "old"), ("y", 5, "keep")], "k string, at int, v string")
    b = spark.createDataFrame([("x", 2, "new"), ("y", 3, "late"), ("z", 1, "add")], "k string, at int, v string")
    assert values(tables.upsert(a, b, ["k"], ["at"])) == [("x", 2, "new"), ("y", 5, "keep"), ("z", 1, "add")]
    assert values(tables.insert_if_absent(a, b, ["k"])[1]) == [("z", 1, "add")]
    assert values(tables.replace_by_key(a, b.where("k = 'x'"), "k")) == [("x", 2, "new"), ("y", 5, "keep")]
    assert values(tables.delete_by_key(a, b.where("k = 'y'"), "k")) == [("x", 1, "old")]
    taken, left = tables.take(a, b.where("k = 'y'"), "k")
    assert (taken.count(), left.count()) == (1, 1)
    assert len(hash_sample(spark.range(1000), "id", 50)) <= 50
    assert values(cut(a)) == values(a)


def test_domain_states(spark):
    rows = [("d", i, 100 + i, False) for i in range(1, 4)] + [("e", 1, 5, False), ("e", 2, 6, True), ("f", 1, 7, True), ("f", 2, 8, False)]
    got = {r.domain: r for r in crawl.domain_states(spark.createDataFrame(rows, "domain string, id int, at long, ok boolean")).collect()}
    assert (got["d"].fail_streak, got["d"].backoff_until) == (3, 103 + 8)
    assert (got["e"].fail_streak, got["e"].next_request_at, got["e"].backoff_until) == (0, 7, None)
    assert (got["f"].fail_streak, got["f"].backoff_until) == (1, 10)


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<float>")
    got = vectors.nearest(df, df.where("vec_id = 0"), 1).collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1)]
    assert df.select(vectors.vector_text(F.col("embedding"))).head()[0] == "[1,0]"


def test_pages():
    html = "<html><head><title> A title </title><link rel=alternate type='application/rss+xml' href='/feed'></head><body><nav><a href='/n'>Nav</a></nav><p>" + "word " * 50 + "</p><a href='x?utm_source=1'>x</a><a href='mailto:a'>m</a><script>no()</script></body></html>"
    title, text, links, feeds = pages.parse_page(html, "https://e.example/d/")
    assert title == "A title" and "word word" in text and "no()" not in text and "Nav" not in text
    assert links == ["https://e.example/n", "https://e.example/d/x"] and feeds == ["https://e.example/feed"]
    assert pages.parse_page("", "https://e.example/") == ("", "", [], [])
    rss = "<rss><channel><item><title>T</title><link>https://e.example/1</link><description>&lt;p&gt;Body&lt;/p&gt;</description></item><item><title>No link</title></item></channel></rss>"
    assert pages.parse_feed(rss) == [("https://e.example/1", "T", "Body")]
    assert pages.parse_feed("<broken") == []


def test_page_columns(spark):
    df = spark.createDataFrame([("https://e.example/", "<title>T</title><p>text <a href='/a'>a</a>"), (None, None)], "url string, html string")
    got = df.select(pages.parsed("html", "url").alias("p")).collect()
    assert got[0].p.title == "T" and got[0].p.outlinks == ["https://e.example/a"] and got[1].p.title == ""


def test_config(tmp_path, spark):
    path = tmp_path / "cases.json"
    path.write_text('{"cases": [{"query": "a", "judgments": [{"relevance": 3, "url": "https://e.example/"}]}, {"query": "A"}]}')
    assert config.cases(spark, str(path)).count() == 1
    assert config.problems([{"query": ""}, {"query": "b", "judgments": [{"relevance": "x"}]}]) == ["case 0: no query", "case 1, judgment 0: no relevance", "case 1, judgment 0: matches everything"]


def test_text(spark):
    df = spark.createDataFrame([("A  b\tC",), ("日本 Go",), ("  ",), (None,)], "t string")
    assert [r[0] for r in df.select(X.analyzed("t")).collect()] == ["a  b\tc", "日 本 go", "", ""]
    assert df.select(X.error_text(F.lit("x" * 300))).head()[0] == "x" * 237 + "..."
    assert dt.date.today()


def test_alias(spark):
    from loomspark.operators import matching

    q = spark.createDataFrame([(1, "git docs api"), (2, "github"), (3, "gitlab x")], "query_id int, query string")
    a = spark.createDataFrame([(1, "git"), (2, "git docs"), (3, "github")], "source int, alias string")
    assert values(matching.match_alias(q, a)) == [(1, "git docs api", 2, "git docs", "api"), (2, "github", 3, "github", "")]
    df = spark.createDataFrame([("a vs b",), ("a vs a",), ("a",), (None,)], "q string")
    assert [r[0] for r in df.select(matching.comparison(F.col("q"))).collect()] == [["a", "b"], None, None, None]


def test_judge(spark):
    from loomspark.operators import matching

    hits = spark.createDataFrame([(1, "https://docs.example.com/guide/x", "A guide"), (1, "https://docs.example.com/", None), (1, "https://bad.test/", "t")], "query_id int, url string, title string")
    j = spark.createDataFrame([(1, 3, "https://docs.example.com/", None, None, None), (1, 2, None, "example.com", "/guide", None), (1, -1, None, "bad.test", None, None), (1, 1, None, None, None, ["t"])], "query_id int, relevance int, url string, domain string, path_prefix string, title_terms array<string>")
    assert {r.url: r.relevance for r in matching.judge(hits, j).collect()} == {"https://docs.example.com/guide/x": 2, "https://docs.example.com/": 3, "https://bad.test/": -1}


def test_robots(spark):
    from loomspark.sources import robots

    u = spark.createDataFrame([("https://a.example/x",), ("https://a.example/p/1",), ("https://b.example/",)], "url string")
    r = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /p\nCrawl-delay: 3")], "host string, body string")
    assert values(robots.allowed(u, r)) == [("https://a.example/p/1", False, 3.0), ("https://a.example/x", True, 3.0), ("https://b.example/", True, None)]


def test_engine(spark):
    from loomspark.engine import Engine
    from loomspark.sources import dummy

    docs = dummy.documents(spark, 30)
    links = docs.select(F.col("url").alias("src"), F.lit("https://site-1.example/page/1").alias("dst"))
    e = Engine(spark, docs, links)
    assert e.index_count() == 30 and e.document("https://site-1.example/page/1").count() == 1
    top = e.search("river lamp", 3).collect()
    assert len(top) == 3 and top[0].rank == 1 and "<mark>" in top[0].snippet
    assert e.search("river", 3, page=2).count() == 3
    more = e.upsert(dummy.documents(spark, 31))
    assert more.documents.count() == 31 and more.delete(docs.limit(1)).documents.count() == 30
    q = spark.createDataFrame([(1, "page 1")], "query_id int, query string")
    assert e.search_many(q).count() > 0
