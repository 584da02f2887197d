"""Expressions of the crawl pipeline, query policy, stored postings and sinks on small tables, nulls among them."""

import pytest
from pyspark.sql import functions as F

from loomspark import session
from loomspark.functions.text import parse_query
from loomspark.operators import graph, pipeline, policy, retrieval, tables, vectors
from loomspark.operators.postings import Postings
from loomspark.sources.pages import parse_page, resolve


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_private_hosts(spark):
    rows = [("10.0.0.1", True), ("[::1]", True), ("fe80::1%eth0", True), ("2001:4860:4860::8888", False), ("a.example", False), (None, True), ("", True), ("1.2.3", False)]
    df = spark.createDataFrame(rows, "h string, want boolean")
    assert df.where(pipeline.private_host(F.col("h")) != F.col("want")).count() == 0


def test_byte_chunks(spark):
    texts = ["", None, "plain", "é" * 20_000, "日本" * 30_000, "x" * 32_001]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", pipeline.byte_chunks(F.col("t")).alias("c")).collect()
    for r in got:
        t = texts[r.i]
        assert r.c is None if t is None else "".join(r.c) == t and all(0 < len(x.encode()) <= 32_000 for x in r.c)


def test_outcomes(spark):
    rows = [("html", True, None, 1, "text", None), ("html", True, None, 0, "text", None), ("html", True, None, 1, "  ", None), ("feed", False, None, 0, None, None), ("feed", True, 0, 0, None, None), ("feed", True, 2, 1, None, None), ("feed", True, 2, 0, None, None), ("html", None, None, None, None, "network"), (None, None, None, None, None, "other"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "kind string, parsed boolean, entries int, indexed int, content string, failure string")
    got = [r.s for r in df.coalesce(1).select(pipeline.fetched(*map(F.col, df.columns))["status"].alias("s")).collect()]
    assert got == ["indexed", "indexer_error", "skipped", "unknown_error", "skipped", "indexed", "indexer_error", "http_error", "unknown_error", "skipped"]


def test_empty_tables(spark):
    cases = spark.createDataFrame([], "case_id long, query_type string, expected_domain string")
    hits = spark.createDataFrame([], "case_id long, url string, rank int, relevance int, fits boolean")
    assert pipeline.case_outcomes(cases, hits).count() == 0
    one = spark.createDataFrame([(1, "news", None)], cases.schema)
    assert pipeline.case_outcomes(one, hits).head().reason == "no hits"
    text = spark.createDataFrame([(1, "see `Docs.Example` there"), (2, "at www.a.example.org/x"), (3, None)], "case_id long, text string")
    got = {r.case_id: r.expected_domain for r in pipeline.expected_domain(text, spark.createDataFrame([("example.org",), ("a.example.org",)], "domain string")).collect()}
    assert got == {1: "docs.example", 2: "a.example.org", 3: None}
    assert graph.pagerank(spark.createDataFrame([], "url string"), spark.createDataFrame([], "src string, dst string")).count() == 0


def test_policy(spark):
    sources = spark.createDataFrame([(1, ["velo", "velo docs"], ["velo.example"], ["/docs"], ["/news"], "navigational", 40, None)], policy.SOURCE)
    words = {"news": ["latest"], "other": ["vs"], "suffix": ["home"], "stop": ["the"], "recruiting": ["jobs"]}
    asked = ["velo", "velo latest", "velo home", "velo install the pump", "velo vs tandem", "a vs b", "tandem", "", None, "velo jobs"]
    q = spark.createDataFrame([(i, t, None) for i, t in enumerate(asked)] + [(99, "velo", "x.example")], "query_id int, query string, site string")
    got = {r.query_id: r for r in policy.classify(q, sources, words).collect()}
    assert [got[i].query_class for i in range(10)] == ["navigational", "news", "navigational", "reference", "comparison", "comparison", "other", "other", "other", "reference"]
    assert got[99].query_class == "other" and got[3].intent_terms == ["install", "pump"] and got[4].subjects == ["velo", "tandem"] and not got[9].demote and got[0].demote


def test_postings_read_only_the_terms(spark, data, tmp_path):
    index = spark.read.parquet(f"{data}/search_index.parquet")
    p = Postings.build(index.unionByName(index), str(tmp_path / "p"), 16)  # repeated rows count once
    want = [(r.url, r.score) for r in retrieval.search(index, "reliable sensor log", 20).collect()]
    assert [(r.url, r.score) for r in p.search("reliable sensor log", 20).collect()] == want != []
    plan = p.read(["sensor"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: ")[1][:80] and "term" in plan.split("PushedFilters: ")[1][:120]
    assert p.search("").count() == 0


def test_rebuild_goes_on(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("string").alias("url"))
    assert tables.rebuild(rows, "url", str(tmp_path / "r"), 4, until=3) == 3 and tables.rebuild(rows, "url", str(tmp_path / "r"), 4) == 1
    assert spark.read.parquet(str(tmp_path / "r")).select("url").distinct().count() == 100


def test_nearest_in_blocks(spark, monkeypatch, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet")
    q = v.where("vec_id % 100 = 0")
    whole = sorted(map(tuple, vectors.nearest(v, q, 5).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 2)
    assert sorted(map(tuple, vectors.nearest(v, q, 5).collect())) == whole != []


@pytest.mark.parametrize("raw,text,site,phrases,terms,gone", [
    ('a "b c" -d site:X.example', "a", "x.example", ("b c",), ("d",), ()), ('-"x y" z', "z", None, (), (), ("x y",)), ('foo"bar baz"', "foo", None, ("bar baz",), (), ()), ('say "" and "open', 'say " open', None, ("and",), (), ()),
    ("well-known -x", "well-known", None, (), ("x",), ()), ("site:a site:b", "", "b", (), (), ()), ("", "", None, (), (), ()), ("- a", "- a", None, (), (), ()),
])
def test_parse_query(raw, text, site, phrases, terms, gone):
    q = parse_query(raw)
    assert (q.text, q.site_filter, q.exact_phrases, q.exclude_terms, q.exclude_phrases) == (text, site, phrases, terms, gone)


def test_links_and_homepages():
    assert resolve("https://a.example/x/", "../y?utm_source=1&b=2#f") == "https://a.example/y?b=2"
    assert resolve("https://a.example/", "http://192.168.1.1/") is None and resolve("https://a.example/", "mailto:x@a.example") is None and resolve("https://a.example/", None) is None
    page = "<html><head><title>Velo</title><meta property='og:description' content='Bicycles for all'></head><body><h1>Shop</h1><p>Short.</p></body></html>"
    assert "Bicycles" in parse_page(page, "https://a.example/")[1] and "Bicycles" not in parse_page(page, "https://a.example/about")[1]


def test_long_aliases(spark):
    from loomspark.operators.matching import match_alias

    long = "one two three four five six seven eight nine ten"
    got = match_alias(spark.createDataFrame([(1, long + " more")], "query_id int, query string"), spark.createDataFrame([(7, long)], "source int, alias string")).head()
    assert (got.source, got.rest) == (7, "more")
