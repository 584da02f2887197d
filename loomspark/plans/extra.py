"""Sinks, outcomes, parsing, rules and rendering as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import urls as U
from ..operators import crawl as C
from ..operators import pipeline as O
from ..operators import retrieval as R
from ..operators import tables as T
from ..operators import vectors as V
from ..session import new_path
from ..sources import pages as S
from .policy import PATH, ROWS, _rules
from .search import MANY, _found
from .tables import HOST, _sql_list, query, table


@query("select 'documents' as name, count(*) as n from documents union all select 'crawl_logs', count(*) from crawl_logs")
def footer_counts(spark, d):
    """Row counts from the footers of the files, without a scan."""
    out = None
    for name in ("documents", "crawl_logs"):
        one = T.footer_rows(spark, f"{d}/{name}.parquet").select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("with a as (select distinct src, dst from links where src <> dst), n as (select dst as url, count(*) as n from a group by dst) select url, round(n / (select max(n) from n), 6) as page_rank from n")
def replaced_ranks(spark, d):
    """The rank table replaced as a whole by new scores, divided by their maximum."""
    n = table(spark, d, "links").where("src <> dst").select("src", "dst").distinct().groupBy(F.col("dst").alias("url")).agg(F.count("*").cast("double").alias("page_rank"))
    path = new_path(spark, "ranks")
    spark.range(1).selectExpr("'old' as url", "0D as page_rank").write.parquet(path)
    T.replace_table(T.max_normalized(n, "page_rank"), path)
    return spark.read.parquet(path).select("url", F.round("page_rank", 6).alias("page_rank"))


@query("""with b as (select distinct url from documents), i as (select distinct url from search_index), gone as (select distinct url from crawl_logs where http_code = 404)
select (select count(*) from b) as written, (select count(*) from i where url in (select url from gone) and url not in (select url from b)) + (select count(*) from b where url in (select url from gone)) as deleted, (select count(*) from gone where url not in (select url from i union select url from b)) as ignored, (select count(*) from (select url from i union select url from b) where url not in (select url from gone)) as total""")
def index_writes(spark, d):
    """A bulk write of documents into the index and deletions, with their counts; deletions of what isn't there are ignored."""
    docs = T.last_per_key(R.index_documents(table(spark, d, "documents"), "doc_id"), ["url"], ["doc_id"])
    written, n = T.bulk_write(table(spark, d, "search_index").select("url", "title"), docs.select("url", "title"), "url")
    left, deleted, ignored = T.bulk_delete(written, table(spark, d, "crawl_logs").where("http_code = 404").select("url"), "url")
    return n.crossJoin(deleted).crossJoin(ignored).crossJoin(left.agg(F.count("*").alias("total"))).select("written", "deleted", "ignored", "total")


@query(f"""with newest as (select * from documents qualify row_number() over (partition by url order by doc_id desc) = 1), p as (select url, max(page_rank)::double as p from search_index group by url), h as (select host, max(domain_rank)::double as r from search_index group by host)
select newest.url, {HOST.format("newest.url")} as host, length(substr(coalesce(content, ''), 1, 20000)) as chars, round(coalesce(p, 0), 5) as page_rank, round(coalesce(r, 0), 5) as domain_rank from newest left join p on p.url = newest.url left join h on h.host = {HOST.format("newest.url")}""")
def rebuilt_index(spark, d):
    """Documents and ranks joined into the index, in parts; a rebuild that was broken off goes on with the parts that are missing."""
    index = table(spark, d, "search_index")
    pages = index.groupBy("url").agg(F.max("page_rank").cast("double").alias("page_rank"))
    hosts = index.groupBy("host").agg(F.max("domain_rank").cast("double").alias("domain_rank"))
    docs = T.last_per_key(R.index_documents(table(spark, d, "documents"), "doc_id").drop("title_terms", "content_terms"), ["url"], ["doc_id"])
    rows = docs.join(pages, "url", "left").join(hosts, "host", "left").select("url", "host", F.length("content").cast("long").alias("chars"), *(F.round(F.coalesce(c, F.lit(0.0)), 5).alias(c) for c in ("page_rank", "domain_rank")))
    path = new_path(spark, "rebuild")
    T.rebuild(rows, "url", path, 4, until=2)
    T.rebuild(rows, "url", path, 4)
    return spark.read.parquet(path).select("url", "host", "chars", "page_rank", "domain_rank")


@query("select status, count(*) as n, count(distinct id) as ids from crawl_logs group by status")
def appended_logs(spark, d):
    """Two appends to a log table; the second is tried twice and counts once."""
    logs = table(spark, d, "crawl_logs")
    middle = logs.agg(F.avg("created_at")).head()[0] or 0
    path = new_path(spark, "logs")
    T.append(logs.where(F.col("created_at") < middle), path, "first")
    for _ in range(2):
        T.append(logs.where((F.col("created_at") >= middle) | F.col("created_at").isNull()), path, "second")
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query(f"with i as (select event_id as impression_id, user_id // 2 as request_id from events where event_type = 'view'), c as (select event_id as click_id, event_id - 1 as impression_id from events where event_type = 'click') select click_id, impression_id, request_id from c join i using (impression_id)")
def recorded_clicks(spark, d):
    """Clicks with the request of their impression, which a click has to have."""
    e = table(spark, d, "events")
    shown = e.where("event_type = 'view'").select(F.col("event_id").alias("impression_id"), F.expr("user_id div 2").alias("request_id"))
    return e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), (F.col("event_id") - 1).alias("impression_id")).join(shown, "impression_id").select("click_id", "impression_id", "request_id")


OUT_HOSTS, OUT_PATHS = ("daily.harbourlight.example",), ("/wiki", "/docs")


@query(f"select distinct url from search_index where host in ({_sql_list(OUT_HOSTS)}) or " + " or ".join(f"path = '{p}' or starts_with(path, '{p}/')" for p in OUT_PATHS))
def index_exclusions(spark, d):
    return table(spark, d, "search_index").where(O.excluded(F.col("host"), F.col("path"), OUT_HOSTS, OUT_PATHS)).select("url").distinct()


DOMAIN_RULES = ({"domains": ["harbourlight.example"], "allow_path_prefixes": ["/docs", "/news", "/wiki"], "reject_path_contains": ["-sel"]}, {"domains": ["lorux-2.test"], "reject_path_prefixes": ["/wiki"], "reject_query_params": ["page"]})


@query(f"""with u as (select distinct url, {HOST.format("url")} as h, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) as p from documents)
select url, case when h = 'harbourlight.example' or ends_with(h, '.harbourlight.example') then case when not (p in ('/docs', '/news', '/wiki') or starts_with(p, '/docs/') or starts_with(p, '/news/') or starts_with(p, '/wiki/')) then 'domain_scope_denied' when contains(p, '-sel') then 'domain_path_contains_denied' else 'allow' end
 when h = 'lorux-2.test' or ends_with(h, '.lorux-2.test') then case when p = '/wiki' or starts_with(p, '/wiki/') then 'domain_path_prefix_denied' else 'allow' end else 'allow' end as reason from u""")
def domain_admission(spark, d):
    """Rules of single domains; the common rules are tested in url_admission, so they are empty here."""
    u = C.admission(table(spark, d, "documents").select("url").distinct(), extensions=(), paths=(), parts=(), parameters=(), domain_rules=DOMAIN_RULES)
    return u.select("url", F.coalesce("reason", F.lit("allow")).alias("reason"))


ADDRESSES = [("10.1.2.3", True), ("8.8.8.8", False), ("::1", True), ("fe80::1", True), ("2001:4860:4860::8888", False), ("fd00::5", True), ("169.254.169.254", True), ("a.example", False), ("", True), ("127.0.0.1", True), ("240.0.0.1", True), ("999.1.1.1", False)]


@query(f"select host, private from (values {', '.join(f'({h!r}, {str(p).lower()})' for h, p in ADDRESSES)}) t(host, private) union all select distinct host, host = '' from search_index")
def private_hosts(spark, d):
    hosts = spark.createDataFrame([(h,) for h, _ in ADDRESSES], "host string").unionByName(table(spark, d, "search_index").select("host").distinct())
    return hosts.select("host", O.private_host(F.col("host")).alias("private"))


@query(r"select doc_id, coalesce(replace(title, chr(1), ' '), '') as title, regexp_replace(lower(coalesce(title, '')), '^what\s+(is|are)\s+', '') as asked from documents")
def sanitized_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(X.without_nul("title"), F.lit("")).alias("title"), F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"^what\s+(?:is|are)\s+", "").alias("asked"))


@query("""with t as (select distinct url, title, content from search_index), x as (select url, lower(coalesce(title, '')) as t, lower(coalesce(title, '') || ' ' || url || ' ' || coalesce(content, '')) as c, """ + f"regexp_replace({HOST.format('url')}, '^www\\.', '') as h, lower({PATH.format('url')}) as p from t)" + """
select distinct url, (h = 'harbourlight.example' or ends_with(h, '.harbourlight.example')) and not (h = 'blog.harbourlight.example' or ends_with(h, '.blog.harbourlight.example')) and (contains(p, '/docs') or contains(p, '/news')) as first, contains(t, 'guide') and contains(c, 'archive') and (contains(c, 'market') or contains(c, 'garden')) as second from x""")
def rules_met(spark, d):
    rule = lambda **k: F.struct(*[(F.array(*map(F.lit, k[n])) if n in k else F.lit(None).cast("array<string>")).alias(n) for n in ("required_domains", "excluded_domains", "required_paths", "path_terms", "title_terms", "terms", "any_terms")])
    hits = table(spark, d, "search_index").select("url", "title", "content").withColumn("a", rule(required_domains=["harbourlight.example"], excluded_domains=["blog.harbourlight.example"], path_terms=["/docs", "/news"])).withColumn("b", rule(title_terms=["guide"], terms=["archive"], any_terms=["market", "garden"]))
    return hits.select("url", O.rule_fits("a").alias("first"), O.rule_fits("b").alias("second")).distinct()


CASES = f"""known as (select distinct host as domain from search_index where host <> ''), c as (select distinct item_id as case_id, suite, 'see ' || h.host || '/x or ask' as text from eval_items join (select host, row_number() over (order by host) - 1 as k from (select distinct host from search_index)) h on h.k = item_id % 7),
cases as materialized (select case_id, case when case_id % 3 = 0 then 'navigational' when case_id % 3 = 1 then 'overview' else 'news' end as query_type, (select domain from known where contains(text, domain) order by length(domain) desc, domain desc limit 1) as expected_domain from c)"""


def _cases(spark, d):
    hosts = table(spark, d, "search_index").select("host").distinct()
    numbered = hosts.withColumn("k", F.row_number().over(Window.orderBy("host")) - 1).where("k < 7")
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("case_id"), "suite").distinct()
    c = items.join(F.broadcast(numbered), items["case_id"] % 7 == numbered["k"]).select("case_id", F.concat(F.lit("see "), "host", F.lit("/x or ask")).alias("text"))
    c = O.expected_domain(c, hosts.where("host <> ''").withColumnRenamed("host", "domain"))
    return c.select("case_id", F.when(F.col("case_id") % 3 == 0, "navigational").when(F.col("case_id") % 3 == 1, "overview").otherwise("news").alias("query_type"), "expected_domain")


@query(f"""with {MANY}, {CASES}, h as (select query_id as case_id, url, rank, case when rank = 2 and length(url) % 5 = 0 then -1 else 0 end as relevance, case when query_id % 11 = 0 then length(url) % 2 = 0 end as fits from found where rank <= 3),
f as (select case_id, count(*) as n, bool_or(relevance < 0) as bad, bool_or(fits) as fits, bool_or({HOST.format("url")} = expected_domain or ends_with({HOST.format("url")}, '.' || expected_domain)) as own from h join cases using (case_id) group by case_id)
select case_id, query_type, case when n is null then 'no hits' when bad then 'bad hit on top' when fits then 'rule met' when not fits then 'rule not met' when query_type = 'overview' then 'no rule' when own then 'expected domain on top' else 'expected domain missing' end as reason, case when n is not null and not bad and (fits or (fits is null and query_type <> 'overview' and own)) then 'pass' else 'fail' end as outcome from cases left join f using (case_id)""")
def case_outcomes(spark, d):
    cases = _cases(spark, d)
    hits = _found(spark, d).select(F.col("query_id").alias("case_id"), "url", "rank", F.when((F.col("rank") == 2) & (F.length("url") % 5 == 0), -1).otherwise(0).alias("relevance"), F.when(F.col("query_id") % 11 == 0, F.length("url") % 2 == 0).alias("fits"))
    return O.case_outcomes(cases, hits).join(cases.select("case_id", "query_type"), "case_id").select("case_id", "query_type", "reason", "outcome")


@query(f"with r as (select * from (values {', '.join(f'({s}, {c!r}, {d!r}, {p!r}::varchar[], {n!r}::varchar[])' for s, _, d, p, n, c, _, _ in ROWS)}) t(source, query_type, domains, paths, news_paths)), x as (select source, unnest(domains) as domain, case when contains(query_type, 'news') and len(news_paths) > 0 then news_paths else paths end as p from r) select source, 3 as relevance, domain, unnest(p) as path_prefix from x union all select source, case when len(p) > 0 then 2 else 3 end, domain, '' from x")
def derived_judgments(spark, d):
    s = _rules(spark).select("source", F.col("default_class").alias("query_type"), "domains", "paths", "news_paths")
    return O.derived_judgments(s).withColumn("path_prefix", F.coalesce("path_prefix", F.lit("")))


@query(f"""with l as (select id, url, status, http_code, error_message from crawl_logs)
select id, case when http_code is null and error_message = 'connection reset' then 'http_error' when http_code >= 400 then 'unknown_error' when length(url) % 4 = 0 then case when length(url) % 8 = 0 then 'skipped' when status = 'indexed' then 'indexed' else 'indexer_error' end when url not in (select url from documents where coalesce(trim(content), '') <> '') then 'skipped' when status = 'indexed' then 'indexed' else 'indexer_error' end as status from l""")
def crawl_outcomes(spark, d):
    """What becomes of fetched pages and feeds, by what was fetched, parsed and taken by the index."""
    text = table(spark, d, "documents").where("trim(content) <> ''").groupBy("url").agg(F.first("title").alias("t"), F.lit("x").alias("content"))
    logs = table(spark, d, "crawl_logs").join(text, "url", "left")
    feed = F.length("url") % 4 == 0
    failure = F.when(F.col("http_code").isNull() & (F.col("error_message") == "connection reset"), "network").when(F.col("http_code") >= 400, "other")
    out = O.fetched(F.when(feed, "feed").otherwise("html"), F.lit(True), F.when(F.length("url") % 8 == 0, 0).otherwise(2), (F.col("status") == "indexed").cast("int"), F.col("content"), failure)
    return logs.select("id", out["status"].alias("status"))


@query(f"select {HOST.format('url')} as domain, greatest(max(coalesce(crawl_delay_ms, 0)), 5) as delay from crawl_logs where {HOST.format('url')} <> '' group by 1")
def crawl_delays(spark, d):
    logs = table(spark, d, "crawl_logs").select(U.host("url").alias("domain"), F.col("crawl_delay_ms").alias("delay")).where("domain <> ''")
    return O.crawl_delays(logs, logs.select("domain").distinct().withColumn("delay", F.lit(5)))


@query("select vec_id, len(embedding) as size, '[' || array_to_string(list_transform(embedding[1:2], lambda x: (round(x::double, 3) + 0.0)::varchar), ',') || ']' as head from embeddings")
def vector_texts(spark, d):
    """The text of each vector, parsed again: its size and its first numbers."""
    t = table(spark, d, "embeddings").select("vec_id", F.from_json(V.vector_text("embedding"), "array<double>").alias("v"))
    return t.select("vec_id", F.size("v").cast("long").alias("size"), F.concat(F.lit("["), F.array_join(F.transform(F.slice("v", 1, 2), lambda x: (F.round(x, 3) + F.lit(0.0)).cast("string")), ","), F.lit("]")).alias("head"))


@query("select doc_id, case when coalesce(trim(content), '') = '' then 0 else 1 end as filled, case when coalesce(trim(content), '') = '' then 8 else 0 end as zeros from documents")
def embedding_inputs(spark, d):
    """What is sent for an embedding; an empty text gets a vector of zeros instead."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.trim(F.coalesce("content", F.lit(""))) == "", F.array_repeat(F.lit(0.0).cast("float"), 8)).alias("zero"), X.embedding_text("content").alias("t"))
    return docs.select("doc_id", F.when(F.col("zero").isNull(), 1).otherwise(0).alias("filled"), F.coalesce(F.size("zero"), F.lit(0)).alias("zeros"))


HTML = ("<html><head><title>", "</title><link rel='alternate' type='application/rss+xml' href='/feed.xml'></head><body><nav><a href='/home'>Home</a></nav><main><p>", "</p></main>", "<footer><a href='http://10.0.0.1/x'>intern</a><a href='mailto:a@b.example'>mail</a></footer></body></html>")


@query(f"""select page_id, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) as title, (1 + len(list_filter(coalesce(outlinks, []), lambda x: starts_with(x, 'http'))))::integer as links, 1 as feeds from parse_results where regexp_matches(url, '^https?://[^/]+')""")
def parsed_pages(spark, d):
    """Pages written as HTML with a menu, a footer, a feed and their links, and parsed again."""
    p = table(spark, d, "parse_results").where(F.col("url").rlike("^https?://[^/]+"))
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    anchors = F.array_join(F.transform(F.coalesce("outlinks", F.array().cast("array<string>")), lambda x: F.concat(F.lit("<a href=\""), F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("\">x</a>"))), " ")
    html = F.concat(F.lit(HTML[0]), esc(F.col("title")), F.lit(HTML[1]), esc(F.col("content")), F.lit(HTML[2]), anchors, F.lit(HTML[3]))
    got = p.select("page_id", S.parsed(html, F.col("url"), 100_000).alias("g"))
    return got.select("page_id", F.trim(F.regexp_replace("g.title", r"\s+", " ")).alias("title"), F.size("g.outlinks").alias("links"), F.size("g.feed_links").alias("feeds"))


@query("select distinct page_id, url, regexp_replace(trim(title), '\\s+', ' ', 'g') as title from parse_results where trim(coalesce(title, '')) <> '' and trim(content) <> ''")
def feed_entries(spark, d):
    """Each page as the one complete entry of a feed, beside one without a title and a repeated one."""
    p = table(spark, d, "parse_results")
    esc = lambda c: F.replace(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit("<item><title>"), esc(F.col("title")), F.lit("</title><link>"), esc(F.col("url")), F.lit("</link><description>"), esc(F.substring("content", 1, 200)), F.lit("</description></item>"))
    xml = F.concat(F.lit("<rss><channel><item><link>https://a.example/</link></item>"), item, item, F.lit("</channel></rss>"))
    got = p.select("page_id", F.explode(S.feed_entries(xml)).alias("e"))
    return got.select("page_id", "e.url", "e.title").distinct()


@query("with s as (select doc_id, lower(coalesce(title, '')) as t, coalesce(title, '') as o from documents) select doc_id, case when trim(o) = '' then '' when regexp_matches(t, '[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}]') then trim(regexp_replace(regexp_replace(t, '([\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}])', ' \\1 ', 'g'), '\\s+', ' ', 'g')) else t end as terms from s")
def analyzed_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", X.analyzed(F.coalesce("title", F.lit(""))).alias("terms"))


@query("select doc_id, ceil(octet_length(encode(content)) / 32000.0)::integer as least, octet_length(encode(content)) as bytes from documents where content is not null")
def text_chunks(spark, d):
    """Pieces of at most 32,000 bytes; how many there are at least, and that nothing is lost."""
    c = table(spark, d, "documents").where("content is not null").select("doc_id", F.octet_length("content").alias("n"), O.byte_chunks(F.col("content")).alias("c"))
    fine = F.forall("c", lambda x: F.octet_length(x) <= 32_000) & (F.size("c") <= F.ceil(F.col("n") / 31_990))
    return c.select("doc_id", F.when(fine, F.ceil(F.col("n") / 32_000)).otherwise(-1).cast("int").alias("least"), F.aggregate(F.transform("c", lambda x: F.octet_length(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes"))


@query(f"""with t as (select distinct url, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title_terms, '')), '\\s+'), lambda x: x <> '')) as a, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(content_terms, '')), '\\s+'), lambda x: x <> '')) as b from search_index)
select url, len(a)::integer as different, len(list_intersect(a, b))::integer as shared, (len(a) - len(list_intersect(a, b)))::integer as alone from t""")
def term_sets(spark, d):
    """Ordered distinct terms of a title, those its content has too, and those it has not."""
    i = table(spark, d, "search_index").select("url", F.array_distinct(X.terms(F.coalesce("title_terms", F.lit("")))).alias("a"), F.array_distinct(X.terms(F.coalesce("content_terms", F.lit("")))).alias("b"))
    return i.select("url", F.size("a").alias("different"), F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_except("a", "b")).alias("alone")).distinct()


@query("(select url from documents intersect select url from crawl_logs) except select url from parse_results")
def crawled_only(spark, d):
    return table(spark, d, "documents").select("url").intersect(table(spark, d, "crawl_logs").select("url")).exceptAll(table(spark, d, "parse_results").select("url").distinct())


@query("select coalesce(status, 'all') as status, coalesce(http_code, -1) as http_code, count(*) as n, count(distinct url) as urls, round(quantile_cont(total_ms, 0.5), 3) as median from crawl_logs where http_code is not null and total_ms is not null group by cube (status, http_code)")
def log_cube(spark, d):
    logs = table(spark, d, "crawl_logs").where("http_code is not null and total_ms is not null")
    n = logs.cube("status", "http_code").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"), F.round(F.percentile("total_ms", 0.5), 3).alias("median"))
    return n.select(F.coalesce("status", F.lit("all")).alias("status"), F.coalesce("http_code", F.lit(-1)).alias("http_code"), "n", "urls", "median")


@query("""select id, coalesce(lag(status) over w, '') as before, coalesce(lead(status) over w, '') as after, first_value(status) over w as first, count(*) over (partition by url order by created_at, id rows between 2 preceding and current row) as last_three, (sum(1) over (partition by url order by created_at range between 3600 preceding and current row))::bigint as within_hour, ntile(2) over w as half
from crawl_logs window w as (partition by url order by created_at, id)""")
def attempt_frames(spark, d):
    """Frames by rows and by range over the attempts of a URL, which are few."""
    w = Window.partitionBy("url").orderBy("created_at", "id")
    near = Window.partitionBy("url").orderBy("created_at").rangeBetween(-3600, 0)
    return table(spark, d, "crawl_logs").select(
        "id", F.coalesce(F.lag("status").over(w), F.lit("")).alias("before"), F.coalesce(F.lead("status").over(w), F.lit("")).alias("after"), F.first("status").over(w).alias("first"),
        F.count("*").over(w.rowsBetween(-2, 0)).alias("last_three"), F.sum(F.lit(1)).over(near).alias("within_hour"), F.ntile(2).over(w).alias("half"),
    )


@query(f"with {MANY} select query_id, count(*) as total, greatest(ceil(count(*) / 3.0), 1)::integer as last_page, count(*) filter (rank > 3 and rank <= 6) as on_second from found group by query_id")
def result_pages(spark, d):
    n = _found(spark, d).groupBy("query_id").agg(F.count("*").alias("total"), F.count_if((F.col("rank") > 3) & (F.col("rank") <= 6)).alias("on_second"))
    return n.select("query_id", "total", F.greatest(F.ceil(F.col("total") / 3), F.lit(1)).cast("int").alias("last_page"), "on_second")


@query("select url, coalesce(min(title), '') as title, max(page_rank) is not null as ranked from search_index group by url")
def hit_responses(spark, d):
    """Hits as JSON and back: a rank that is null has no key."""
    one = table(spark, d, "search_index").groupBy("url").agg(F.min("title").alias("title"), F.max("page_rank").alias("page_rank"), F.max("domain_rank").alias("domain_rank")).withColumn("score", F.lit(1.0))
    json = one.select("url", O.hit_json().alias("j"))
    return json.select("url", F.coalesce(F.get_json_object("j", "$.title"), F.lit("")).alias("title"), F.array_contains(F.json_object_keys("j"), "page_rank").alias("ranked"))


@query(f"with {MANY}, t as (select url, min(coalesce(title, '')) as title from search_index group by url) select query_id, '## Search: q' || query_id || chr(10) || '**' || count(*) || ' results**' || chr(10) || chr(10) || string_agg('### ' || rank || '. [' || coalesce(nullif(title, ''), 'Untitled') || '](' || url || ')' || chr(10), chr(10) order by rank) as markdown from found join t using (url) group by query_id")
def hit_markdown(spark, d):
    titles = table(spark, d, "search_index").groupBy("url").agg(F.min(F.coalesce("title", F.lit(""))).alias("title"))
    hits = _found(spark, d).join(titles, "url").withColumn("query", F.concat(F.lit("q"), "query_id")).withColumn("snippet", F.lit(None).cast("string"))
    total = hits.groupBy("query_id").agg(F.count("*").alias("total"))
    return O.hits_markdown(hits.join(total, "query_id"), "query_id", "query", "total")


@query(f"with {MANY} select item_id, suite from (select distinct item_id, suite from eval_items) where item_id not in (select query_id from found where rank <= 3)")
def missed_cases(spark, d):
    hit = _found(spark, d).where("rank <= 3").select(F.col("query_id").alias("item_id"))
    return table(spark, d, "eval_items").select("item_id", "suite").distinct().join(hit, "item_id", "left_anti")


@query(f"select suite, count(*) filter (lang = 'en') as en, count(*) filter (lang = 'ja') as ja, count(*) as n from eval_items group by suite")
def suite_languages(spark, d):
    """Counts by suite and language, languages as columns."""
    return table(spark, d, "eval_items").groupBy("suite").pivot("lang", ["en", "ja"]).count().join(table(spark, d, "eval_items").groupBy("suite").agg(F.count("*").alias("n")), "suite").select("suite", F.coalesce("en", F.lit(0)).alias("en"), F.coalesce("ja", F.lit(0)).alias("ja"), "n")
