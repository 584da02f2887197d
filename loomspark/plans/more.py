"""Matching, planning and merging queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import crawl as C
from ..operators import matching as M
from ..operators import tables as T
from . import logs as L
from .tables import HOST, _sql_list, query, table

ALIASES = [(1, "what"), (1, "what is known"), (2, "what is known about"), (3, "how"), (3, "how to"), (4, "where"), (5, "compare")]
Q = "array_to_string(regexp_extract_all(lower(query), '[a-z0-9]+'), ' ')"


@query(
    f"""with q as (select distinct item_id as query_id, {Q} as query from eval_items), a(source, alias) as (values {", ".join(f"({s}, '{x}')" for s, x in ALIASES)})
select query_id, query, source, alias, trim(substr(query, length(alias) + 1)) as rest from q join a on query = alias or starts_with(query, alias || ' ')
qualify row_number() over (partition by query_id order by length(alias) desc, source) = 1"""
)
def alias_matches(spark, d):
    q = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), M.query_key("query").alias("query")).distinct()
    return M.match_alias(q, spark.createDataFrame(ALIASES, "source int, alias string"))


@query(
    r"""with q as (select distinct item_id as query_id, regexp_split_to_array(lower(query), '\s+(?:vs|versus)\s+') as p from eval_items)
select query_id, trim(p[1]) as a, trim(array_to_string(p[2:], ' vs ')) as b from q where len(p) = 2 and trim(p[1]) <> '' and trim(p[2]) <> '' and trim(p[1]) <> trim(p[2])"""
)
def comparison_subjects(spark, d):
    pair = M.comparison(F.lower("query"))
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), pair.alias("p")).where("p is not null").select("query_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b")).distinct()


JUDGMENTS = [(1, 3, None, "harbourlight.example", "/docs", None), (1, 2, None, None, None, ["guide"]), (1, -1, None, "quatam-0.invalid", None, None), (2, 1, None, None, "/news", None), (2, 3, None, None, None, ["browser", "useful"])]


def _v(x):
    return "null" if x is None else f"[{_sql_list(x)}]" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else str(x)


@query(
    f"""with j(q, relevance, jurl, domain, prefix, terms) as (values {", ".join("(" + ", ".join(map(_v, r)) + ")" for r in JUDGMENTS)}),
h as (select distinct on (url) url, title from search_index), hits as (select url, title, 1 + length(url) % 2 as query_id from h)
select query_id::integer as query_id, url, coalesce(min(relevance) filter (relevance < 0), max(relevance) filter (relevance > 0), 0) as relevance from hits left join j on q = query_id
  and (domain is null or regexp_replace({HOST.format("url")}, '^www\\.', '') = domain or ends_with({HOST.format("url")}, '.' || domain))
  and (prefix is null or starts_with(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), prefix))
  and (terms is null or len(list_filter(terms, lambda t: not contains(lower(coalesce(title, '')), t))) = 0) group by all"""
)
def judged_by_rules(spark, d):
    pages = table(spark, d, "search_index").groupBy("url").agg(F.first("title").alias("title"))
    hits = pages.select((1 + F.length("url") % 2).alias("query_id"), "url", "title")
    j = spark.createDataFrame(JUDGMENTS, "query_id int, relevance int, url string, domain string, path_prefix string, title_terms array<string>")
    return M.judge(hits, j).select("query_id", "url", "relevance")


@query(f"select item_id, suite, query from (select distinct item_id, suite, query from eval_items) qualify row_number() over (partition by {Q} order by item_id) = 1 and {Q} is not null")
def merged_cases(spark, d):
    cases = table(spark, d, "eval_items").select("item_id", "suite", "query").distinct()
    return M.first_wins(cases, M.query_key("query"), ["item_id"])


@query("select user_id, sha256('salt:' || user_id) as session_hash from (select distinct user_id from events)")
def session_hashes(spark, d):
    return table(spark, d, "events").select("user_id").distinct().select("user_id", F.sha2(F.concat_ws(":", F.lit("salt"), F.col("user_id").cast("string")), 256).alias("session_hash"))


@query("with v as (select event_id as impression_id, event_id % 10 + 1 as rank from events where event_type = 'view'), c as (select event_id as click_id, event_id - 1 as impression_id from events where event_type = 'click') select rank, count(*) as clicks from c join v using (impression_id) group by rank")
def click_ranks(spark, d):
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select(F.col("event_id").alias("impression_id"), (F.col("event_id") % 10 + 1).alias("rank"))
    clicks = e.where("event_type = 'click'").select((F.col("event_id") - 1).alias("impression_id"))
    return clicks.join(views, "impression_id").groupBy("rank").agg(F.count("*").alias("clicks"))


POP = f"pop as (select url_hash, url, domain, created_at from queue left join states using (domain) where coalesce(next_request_at, 0) <= {L.LATE} - {L.DAY} and coalesce(backoff_until, 0) <= {L.LATE} - {L.DAY} qualify row_number() over (partition by domain order by created_at, url_hash) <= 3 order by created_at, url_hash limit 100)"


@query(f"with {L.QUEUE}, {L.STATES}, {POP} select domain, count(*) as waiting from queue where url_hash not in (select url_hash from pop) group by domain")
def queue_rest(spark, d):
    queue = L._queue(spark, d)
    chosen = L.queue_pop(spark, d)
    return T.take(queue, chosen, "url_hash")[1].groupBy("domain").agg(F.count("*").alias("waiting"))


@query(f"with {L.QUEUE}, {L.STATES}, {POP} select url from pop where domain not in (select {HOST.format('url')} from crawl_logs where created_at >= {L.LATE} - 200 * {L.DAY} and status = 'blocked' and error_message = 'robots' group by 1 having count(*) >= 3) and not ends_with(domain, '.invalid')")
def planned_urls(spark, d):
    """The popped tasks without those of hosts that are denied or block often."""
    logs = table(spark, d, "crawl_logs")
    blocked = C.blocked_domains(logs, L._now(logs) - 200 * L.DAY).select("domain").unionByName(spark.createDataFrame([("invalid",)], "domain string")).distinct()
    return C.denied(L.queue_pop(spark, d), blocked, F.col("domain")).select("url")


@query(f"select {HOST.format('url')} as domain from crawl_logs where created_at >= {L.LATE} - 200 * {L.DAY} and status = 'blocked' and error_message = 'robots' group by 1 having count(*) >= 3 union select 'invalid'")
def blocked_hosts(spark, d):
    logs = table(spark, d, "crawl_logs")
    return C.blocked_domains(logs, L._now(logs) - 200 * L.DAY).select("domain").unionByName(spark.createDataFrame([("invalid",)], "domain string")).distinct()


ADMIT = "regexp_matches(dst, '^https?://') and not regexp_matches(dst, '[?#*]')"


@query(f"select distinct substr(sha256(dst), 1, 16) as url_hash, dst as url, {HOST.format('dst')} as domain from links where {ADMIT} and not regexp_matches(dst, '/(login|signup|register|signin|cart|wishlist|checkout|account|search)(/|$)') and dst not in (select url from crawl_logs) and not contains(dst, '/amp') and not contains(dst, '/comments')")
def enqueued_urls(spark, d):
    """Discovered addresses that admission allows and that aren't in the queue yet."""
    found = table(spark, d, "links").select(F.col("dst").alias("url")).where(F.col("url").rlike("^https?://") & ~F.col("url").rlike(r"[?#*]")).distinct()
    allowed = C.admission(found).where("reason is null").select(F.col("normalized_url").alias("url")).distinct()
    fresh = T.insert_if_absent(table(spark, d, "crawl_logs").select("url"), allowed, ["url"])[1]
    return fresh.select(U.url_hash("url").alias("url_hash"), "url", U.host("url").alias("domain"))


@query("select url, page_rank is null as unranked from (select url, max(page_rank) as page_rank from search_index group by url) where url not in (select url from documents) or page_rank is null")
def orphan_ranks(spark, d):
    ranks = table(spark, d, "search_index").groupBy("url").agg(F.max("page_rank").alias("p"))
    orphans = ranks.join(table(spark, d, "documents").select("url"), "url", "left_anti")
    return orphans.unionByName(ranks.where("p is null")).distinct().select("url", F.col("p").isNull().alias("unranked"))


@query("select distinct dst as url from links where contains(lower(dst), '/archive') or contains(lower(dst), 'deals.') or regexp_extract(lower(regexp_extract(dst, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '(\\.[^.]*)$', 1) in ('.pdf', '.zip')")
def filtered_urls(spark, d):
    low = F.lower("url")
    extension = F.regexp_extract(F.lower(U.path("url")), r"(\.[^.]*)$", 1)
    u = table(spark, d, "links").select(F.col("dst").alias("url")).distinct()
    return u.where(low.contains("/archive") | low.contains("deals.") | extension.isin(".pdf", ".zip"))


@query("select event_id, greatest(coalesce(try_cast(json_extract_string(props, '$.k') as integer), 10), 1) as page from events")
def clamped_pages(spark, d):
    return table(spark, d, "events").select("event_id", F.greatest(F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(10)), F.lit(1)).alias("page"))


@query("select page_id, len(outlinks) as links, list_contains(outlinks, url) as own from parse_results where outlinks is not null")
def link_arrays(spark, d):
    return table(spark, d, "parse_results").where("outlinks is not null").select("page_id", F.size("outlinks").cast("long").alias("links"), F.array_contains("outlinks", F.col("url")).alias("own"))


@query("select doc_id, url, title from documents where doc_id in (select max(doc_id) from documents group by url)")
def newest_versions(spark, d):
    return T.last_per_key(table(spark, d, "documents").select("url", "doc_id", "title"), ["url"], ["doc_id"]).select("doc_id", "url", "title")


@query("select date_trunc('hour', make_timestamp(created_at * 1000000)) as start, status, count(*) as attempts from crawl_logs group by all")
def stream_status_windows(spark, d):
    """The same windows as a stream over the log files, run to their end."""
    import os
    import uuid

    from ..session import shared_folder
    from ..streaming import crawl as S

    logs = spark.read.parquet(f"{d}/crawl_logs.parquet")
    stream = S.timed(spark.readStream.schema(logs.schema).parquet(f"{d}/crawl_logs.parquet*"))
    folder = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")

    def keep(batch, batch_id):  # a batch that runs again replaces itself
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    # changed windows only; those behind the watermark leave the state
    q = S.status_windows(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("start", "status").agg(F.max_by("attempts", "batch").alias("attempts"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "status", "attempts")
