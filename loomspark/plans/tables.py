"""Scans, sinks, joins and joins' sinks over the crawl tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import crawl as C
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import tables as T


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("select distinct url from documents")
def document_urls(spark, d):
    return table(spark, d, "documents").select("url").distinct()


@query("select doc_id, url, title, n_chars from documents where url = (select min(url) from documents)")
def document_lookup(spark, d):
    docs = table(spark, d, "documents")
    first = docs.agg(F.min("url")).head()[0]
    return docs.where(F.col("url") == F.lit(first)).select("doc_id", "url", "title", "n_chars")


@query("select doc_id, url from documents order by url, doc_id limit 100 offset 200")
def documents_by_offset(spark, d):
    return T.page_by_offset(table(spark, d, "documents").select("doc_id", "url"), ["url", "doc_id"], 200, 100)


@query("select doc_id, url from documents where doc_id > 500 order by doc_id limit 100")
def documents_after_key(spark, d):
    return T.page_after(table(spark, d, "documents").select("doc_id", "url"), "doc_id", 500, 100)


@query("select doc_id, url from documents order by sha256(cast(doc_id as varchar)), doc_id limit 100")
def sampled_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "url").withColumn("k", F.col("doc_id").cast("string"))
    return T.sample_rows(docs, "k", 100).select("doc_id", "url")


@query("select distinct src, dst from links where substr(sha256(dst), 1, 2) < '20'")
def sampled_links(spark, d):
    return T.sample_blocks(table(spark, d, "links"), "dst", "20").select("src", "dst").distinct()


@query("select 'documents' as name, count(*) as n from documents union all select 'links', count(*) from links union all select 'search_index', count(*) from search_index union all select 'crawl_logs', count(*) from crawl_logs")
def table_counts(spark, d):
    out = None
    for name in ("documents", "links", "search_index", "crawl_logs"):
        one = table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("select doc_id from documents where url in (select url from crawl_logs where status = 'indexed')")
def indexed_documents(spark, d):
    keys = table(spark, d, "crawl_logs").where("status = 'indexed'").select("url").distinct()
    return table(spark, d, "documents").join(keys, "url", "left_semi").select("doc_id")


@query(
    """select url, title, chars, seen_at from (
  select url, title, coalesce(length(content), 0) as chars, coalesce(indexed_at, timestamp '1970-01-01') as seen_at, 0 as b, doc_id as k from documents
  union all select url, title, coalesce(length(content), 0), coalesce(parsed_at, timestamp '1970-01-01'), 1, page_id from parse_results)
qualify row_number() over (partition by url order by seen_at desc, b desc, k desc) = 1"""
)
def upserted_pages(spark, d):
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    old = table(spark, d, "documents").select("url", "title", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("chars"), F.coalesce("indexed_at", epoch).alias("seen_at"), F.lit(0).alias("b"), F.col("doc_id").alias("k"))
    new = table(spark, d, "parse_results").select("url", "title", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("chars"), F.coalesce("parsed_at", epoch).alias("seen_at"), F.lit(1).alias("b"), F.col("page_id").alias("k"))
    return T.last_per_key(old.unionByName(new), ["url"], ["seen_at", "b", "k"]).select("url", "title", "chars", "seen_at")


@query("select distinct url from parse_results where url not in (select url from documents)")
def inserted_urls(spark, d):
    return T.insert_if_absent(table(spark, d, "documents").select("url"), table(spark, d, "parse_results").select("url"), ["url"])[1]


HOST = "lower(regexp_replace(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':[0-9]*$', ''))"


@query(
    f"""select dst as dst_url, {HOST.format("src")} as referring_host, min(indexed_at) as first_observed_at, max(indexed_at) as last_observed_at
from links join documents on src = url where indexed_at is not null and src <> dst group by all"""
)
def observed_referrers(spark, d):
    at = table(spark, d, "documents").where("indexed_at is not null").groupBy(F.col("url").alias("src")).agg(F.min("indexed_at").alias("a"), F.max("indexed_at").alias("b"))
    seen = table(spark, d, "links").where("src <> dst").join(at, "src").select(F.col("dst").alias("dst_url"), U.host("src").alias("referring_host"), "a", "b")
    return seen.groupBy("dst_url", "referring_host").agg(F.min("a").alias("first_observed_at"), F.max("b").alias("last_observed_at"))


@query(
    """with batch as (select distinct url as src, unnest(outlinks) as dst from parse_results where outlinks is not null)
select src, dst from links where src not in (select distinct url from parse_results) union all select src, dst from batch where src <> dst"""
)
def replaced_links(spark, d):
    pages = table(spark, d, "parse_results")
    batch = pages.select(F.col("url").alias("src"), F.explode("outlinks").alias("dst")).where("src <> dst").distinct()
    return T.replace_by_key(table(spark, d, "links").select("src", "dst"), batch, "src", pages.select(F.col("url").alias("src")))


@query("select doc_id, url from documents where url not in (select url from crawl_logs where http_code = 404)")
def kept_documents(spark, d):
    return T.delete_by_key(table(spark, d, "documents").select("doc_id", "url"), table(spark, d, "crawl_logs").where("http_code = 404"), "url")


@query(
    f"""with newest as (select * from documents qualify row_number() over (partition by url order by doc_id desc) = 1)
select case when octet_length(encode(url)) <= 512 then url else sha256(url) end as id, {HOST.format("url")} as host,
coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') as path, coalesce(title, '') as title, length(substr(coalesce(content, ''), 1, 20000)) as chars from newest"""
)
def index_projection(spark, d):
    # bounded before the shuffle
    rows = R.index_documents(table(spark, d, "documents"), "doc_id").drop("title_terms", "content_terms")
    return T.last_per_key(rows, ["url"], ["doc_id"]).select("id", "host", "path", "title", F.length("content").cast("long").alias("chars"))


@query("select (select count(distinct url) from documents) as documents, (select count(distinct url) from search_index) as indexed, (select count(distinct url) from documents where url not in (select url from search_index)) as missing, (select count(distinct url) from search_index where url not in (select url from documents)) as orphans")
def index_consistency(spark, d):
    docs, index = table(spark, d, "documents").select("url").distinct().withColumn("a", F.lit(1)), table(spark, d, "search_index").select("url").distinct().withColumn("b", F.lit(1))
    both = docs.join(index, "url", "full")
    return both.agg(F.count("a").alias("documents"), F.count("b").alias("indexed"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("orphans"))


@query(
    """select url, length(substr(url, 1, position(':' in url) - 1)) as scheme_chars, {h} as host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path,
regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) as query, regexp_extract(url, '#(.*)$', 1) as fragment from (select distinct dst as url from links)""".replace("{h}", HOST.format("url"))
)
def url_parts(spark, d):
    u = table(spark, d, "links").select(F.col("dst").alias("url")).distinct()
    return u.select("url", F.length(U.scheme("url")).cast("long").alias("scheme_chars"), U.host("url").alias("host"), U.path("url").alias("path"), U.query("url").alias("query"), U.fragment("url").alias("fragment"))


@query("select distinct substr(sha256(dst), 1, 16) as url_hash, dst as url from links")
def url_hashes(spark, d):
    return table(spark, d, "links").select(U.url_hash("dst").alias("url_hash"), F.col("dst").alias("url")).distinct()


_TWO = ", ".join(f"'{x}'" for x in U.TWO_LEVEL)


@query(
    f"""with h as (select distinct {HOST.format("dst")} as host from links), p as (select host, string_split(host, '.') as s from h)
select host, case when len(s) <= 2 then host when array_to_string(s[-2:], '.') in ({_TWO}) then array_to_string(s[-3:], '.') else array_to_string(s[-2:], '.') end as domain from p"""
)
def registered_domains(spark, d):
    hosts = table(spark, d, "links").select(U.host("dst").alias("host")).distinct()
    return hosts.select("host", U.registered_domain(F.concat(F.lit("http://"), F.col("host"), F.lit("/"))).alias("domain"))


def _sql_list(xs):
    return ", ".join(f"'{x}'" for x in xs)


ADMISSION = f"""with u as (select distinct dst as url from links),
p as (select url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, {HOST.format("url")} as host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) as q from u),
k as (select *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' and lower(string_split(x, '=')[1]) not in ({_sql_list(U.ADMISSION_DROPPED)}))) as ps from p),
n as (select *, case when scheme in ('http', 'https') and host <> '' then scheme || '://' || host || path || case when len(ps) = 0 then '' else '?' || array_to_string(ps, '&') end end as normalized_url from k)
select url, normalized_url, case when normalized_url is null then 'invalid_url'
  when regexp_extract(lower(path), '(\\.[^.]*)$', 1) in ({_sql_list(C.EXTENSIONS)}) then 'filtered_extension'
  when {" or ".join(f"lower(path) = '{x}' or starts_with(lower(path), '{x}/')" for x in C.PATHS)} then 'filtered_path_prefix'
  when {" or ".join(f"contains(lower(path), '{x}')" for x in C.PARTS)} then 'filtered_path_contains'
  when list_has_any(list_transform(ps, lambda x: lower(string_split(x, '=')[1])), ['replytocom']) then 'filtered_query_param' end as reason from n"""


@query(ADMISSION)
def url_admission(spark, d):
    return C.admission(table(spark, d, "links").select(F.col("dst").alias("url")).distinct()).select("url", "normalized_url", "reason")


@query(f"select coalesce(reason, 'allow') as reason, count(*) as urls from ({ADMISSION}) group by all")
def admission_counts(spark, d):
    return url_admission(spark, d).groupBy(F.coalesce("reason", F.lit("allow")).alias("reason")).agg(F.count("*").alias("urls"))


EDGES = f"""(with p as (select src, dst, lower(regexp_extract(dst, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, {HOST.format("dst")} as host,
  regexp_extract(dst, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path, regexp_extract(dst, '^[^?#]*\\?([^#]*)', 1) as q from links),
k as (select *, list_filter(string_split(q, '&'), lambda x: x <> '' and string_split(x, '=')[1] not in ({_sql_list(U.LINK_DROPPED)})) as ps from p where scheme in ('http', 'https')),
n as (select src, scheme || '://' || host || path || case when len(ps) = 0 then '' else '?' || array_to_string(ps, '&') end as dst from k)
select distinct src, dst from n where src <> dst)"""


@query(f"select src, dst from {EDGES}")
def link_edges(spark, d):
    return G.edges(table(spark, d, "links"))


@query(f"select url, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from (select src as url, 1 as o, 0 as i from {EDGES} union all select dst, 0, 1 from {EDGES}) group by url")
def link_degrees(spark, d):
    return G.degrees(G.edges(table(spark, d, "links")))


@query(f"select u.url, count(h) as referring_hosts from (select distinct url from documents) u left join (select distinct dst, {HOST.format('src')} as h from {EDGES}) e on u.url = e.dst and h <> '' group by u.url")
def referring_host_counts(spark, d):
    return G.referring_counts(table(spark, d, "documents").select("url").distinct(), G.referring_hosts(G.edges(table(spark, d, "links"))))


DENIED = ("lorux-2.test", "deals.example", "invalid")


@query(f"select distinct src, dst from links where {' and '.join(f'''not ({HOST.format('dst')} = '{x}' or ends_with({HOST.format('dst')}, '.{x}'))''' for x in DENIED)}")
def allowed_links(spark, d):
    deny = spark.createDataFrame([(x,) for x in DENIED], "domain string")
    return C.denied(table(spark, d, "links").select("src", "dst").distinct(), deny, U.host("dst"))


@query(
    f"""with c as (select distinct dst from links where regexp_matches(dst, '^(?i:https?)://') and not regexp_matches(dst, '[?#*]')
  and dst not in (select url from documents) and dst not in (select url from crawl_logs))
select {HOST.format("dst")} as host, arg_min(dst, sha256(dst) || dst) as url from c group by 1 having {HOST.format("dst")} <> ''"""
)
def frontier_refill(spark, d):
    return G.refill_candidates(table(spark, d, "links"), table(spark, d, "documents"), table(spark, d, "crawl_logs"))


@query(
    f"""with l as (select distinct url as source, unnest(outlinks) as url, 'html' as kind from parse_results union all select distinct url, unnest(feed_links), 'feed' from parse_results)
select source, arg_min(url, sha256(url)) as url, kind from l where kind = 'html' and not regexp_matches(url, '[?#*]') and {HOST.format("url")} = {HOST.format("source")} group by source, kind
union all select distinct source, url, kind from l where kind = 'feed'"""
)
def discovered_links(spark, d):
    p = table(spark, d, "parse_results")
    links = p.select(F.col("url").alias("source"), F.explode("outlinks").alias("url"), F.lit("html").alias("kind")).unionByName(p.select(F.col("url").alias("source"), F.explode("feed_links").alias("url"), F.lit("feed").alias("kind")))
    return C.discovered(links)


@query("select p.url, count(distinct o) as outlinks, count(distinct f) as feeds from parse_results p left join (select url, unnest(outlinks) as o, null as f from parse_results union all select url, null, unnest(feed_links) from parse_results) x on p.url = x.url group by p.url")
def outlink_counts(spark, d):
    p = table(spark, d, "parse_results")
    n = p.select("url", F.explode_outer(F.concat(F.transform(F.coalesce("outlinks", F.array().cast("array<string>")), lambda x: F.struct(x.alias("o"), F.lit(None).cast("string").alias("f"))), F.transform("feed_links", lambda x: F.struct(F.lit(None).cast("string").alias("o"), x.alias("f"))))).alias("x"))
    return n.groupBy("url").agg(F.count_distinct("x.o").alias("outlinks"), F.count_distinct("x.f").alias("feeds"))


PRIVATE = "a in (0, 10, 127) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 169 and b = 254) or a >= 240"


@query(f"with x as (select event_id, cast(event_id % 256 as integer) as a, cast(user_id % 256 as integer) as b from events) select event_id, a || '.' || b || '.3.4' as ip, {PRIVATE} as private from x")
def private_addresses(spark, d):
    ip = F.concat_ws(".", (F.col("event_id") % 256).cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("3.4"))
    return table(spark, d, "events").select("event_id", ip.alias("ip"), U.private_ipv4(ip).alias("private"))


@query("select distinct url, title from search_index where url like '%forum.%/news/%'")
def site_filter(spark, d):
    return table(spark, d, "search_index").where(U.wildcard("url", "forum.*/news/")).select("url", "title").distinct()


@query("select distinct url from search_index where host in ('lorux-2.test', 'www.lorux-2.test', 'forum.lorux-2.test', 'www.forum.lorux-2.test') or starts_with(url, 'https://lorux-2.test/') or starts_with(url, 'https://forum.lorux-2.test/')")
def required_domains(spark, d):
    return table(spark, d, "search_index").where(R.domain_filter(("lorux-2.test", "forum.lorux-2.test"))).select("url").distinct()
