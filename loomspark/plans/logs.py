"""Queries over crawl logs and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import urls as U
from ..operators import crawl as C
from .tables import HOST, _sql_list, query, table

DAY = 86_400
LATE = "(select max(created_at) from crawl_logs)"


def _now(logs) -> int:
    return logs.agg(F.max("created_at")).head()[0] or 0


@query("select status, count(*) as n from crawl_logs group by status")
def status_counts(spark, d):
    return table(spark, d, "crawl_logs").groupBy("status").agg(F.count("*").alias("n"))


@query(f"select status, count(*) as n from crawl_logs where created_at >= {LATE} - 30 * {DAY} group by status")
def status_counts_recent(spark, d):
    logs = table(spark, d, "crawl_logs")
    return logs.where(F.col("created_at") >= _now(logs) - 30 * DAY).groupBy("status").agg(F.count("*").alias("n"))


@query("select case status " + " ".join(f"when '{k}' then '{v}'" for k, v in C.SUMMARY.items()) + " else status end as summary, count(*) as n from crawl_logs group by 1")
def status_rollup(spark, d):
    return table(spark, d, "crawl_logs").groupBy(C.summary_status().alias("summary")).agg(F.count("*").alias("n"))


@query(f"select count(*) as attempts, count(*) filter (status in ({_sql_list(C.ERRORS)})) as errors from crawl_logs where created_at >= {LATE} - 7 * {DAY}")
def recent_rates(spark, d):
    logs = table(spark, d, "crawl_logs")
    return logs.where(F.col("created_at") >= _now(logs) - 7 * DAY).agg(F.count("*").alias("attempts"), F.count_if(F.col("status").isin(*C.ERRORS)).alias("errors"))


@query(f"select {HOST.format('url')} as domain, count(*) as n from crawl_logs where created_at >= {LATE} - 200 * {DAY} and status = 'blocked' and error_message = 'robots' group by 1 having count(*) >= 3 and {HOST.format('url')} <> '' order by n desc, domain")
def robots_blocked_domains(spark, d):
    logs = table(spark, d, "crawl_logs")
    return C.blocked_domains(logs, _now(logs) - 200 * DAY).orderBy(F.desc("n"), "domain")


@query(f"select {HOST.format('url')} as domain, count(*) as total, count(*) filter (status in ({_sql_list(C.ERRORS)}, 'blocked')) as errors, round(count(*) filter (status in ({_sql_list(C.ERRORS)}, 'blocked')) * 100 / count(*), 1) as error_rate from crawl_logs where created_at >= {LATE} - 60 * {DAY} group by 1 having total >= 5 and errors > 0 and domain <> '' order by error_rate desc, errors desc, domain limit 20")
def failing_domains(spark, d):
    logs = table(spark, d, "crawl_logs")
    return C.failing_domains(logs, _now(logs) - 60 * DAY)


@query(f"select id, url, status, coalesce(error_message, 'Unknown') as error_message, created_at from crawl_logs where status in ({_sql_list(C.ERRORS)}) order by created_at desc, id desc limit 50")
def latest_errors(spark, d):
    logs = table(spark, d, "crawl_logs").where(F.col("status").isin(*C.ERRORS))
    return logs.select("id", "url", "status", F.coalesce("error_message", F.lit("Unknown")).alias("error_message"), "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(50)


@query("select id, url, status, created_at from crawl_logs qualify row_number() over (partition by url order by created_at desc, id desc) <= 3")
def url_histories(spark, d):
    logs = table(spark, d, "crawl_logs").withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("created_at"), F.desc("id"))))
    return logs.where("n <= 3").select("id", "url", "status", "created_at")


@query("select min(id) as id, url, status, created_at, count(*) as copies from crawl_logs group by url, status, created_at")
def distinct_attempts(spark, d):
    return table(spark, d, "crawl_logs").groupBy("url", "status", "created_at").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "url", "status", "created_at", "copies")


@query("select status, count(total_ms) as timed, round(avg(fetch_ms), 3) as fetch_ms, round(avg(parse_ms), 3) as parse_ms, round(avg(submit_ms), 3) as submit_ms, max(total_ms) as slowest_ms from crawl_logs group by status")
def phase_times(spark, d):
    mean = lambda c: F.round(F.avg(c), 3).alias(c)
    return table(spark, d, "crawl_logs").groupBy("status").agg(F.count("total_ms").alias("timed"), mean("fetch_ms"), mean("parse_ms"), mean("submit_ms"), F.max("total_ms").alias("slowest_ms"))


@query("select case when total_ms <= 250 then '250' when total_ms <= 500 then '500' when total_ms <= 1000 then '1000' else 'more' end as up_to_ms, count(*) as n from crawl_logs where total_ms is not null group by 1")
def time_histogram(spark, d):
    ms = F.col("total_ms")
    return table(spark, d, "crawl_logs").where(ms.isNotNull()).groupBy(F.when(ms <= 250, "250").when(ms <= 500, "500").when(ms <= 1000, "1000").otherwise("more").alias("up_to_ms")).agg(F.count("*").alias("n"))


QUEUE = f"queue as (select substr(sha256(url), 1, 16) as url_hash, url, {HOST.format('url')} as domain, min(created_at) as created_at from crawl_logs where status <> 'indexed' group by url)"
STATES = f"""r as (select {HOST.format("url")} as domain, id, created_at as t, status not in ({_sql_list(C.ERRORS)}) as ok from crawl_logs),
good as (select domain, max(row(t, id)) filter (ok) as g from r group by domain),
top as (select domain, count(*) as attempts, arg_max(t, row(t, id)) as t, arg_max(ok, row(t, id)) as ok from r group by domain),
streaks as (select r.domain, count(*) filter (not r.ok and (g is null or row(r.t, r.id) > g)) as fail_streak from r join good using (domain) group by r.domain),
states as materialized (select domain, attempts, fail_streak, case when ok then t + 1 end as next_request_at, case when not ok then t + cast(least(pow(2, least(fail_streak, 10)), 3600) as bigint) end as backoff_until from top join streaks using (domain))"""


def _states(spark, d):
    logs = table(spark, d, "crawl_logs")
    return C.domain_states(logs.select(U.host("url").alias("domain"), "id", F.col("created_at").alias("at"), (~F.col("status").isin(*C.ERRORS)).alias("ok")))


@query(f"with {STATES} select domain, attempts, fail_streak, coalesce(next_request_at, 0) as next_request_at, coalesce(backoff_until, 0) as backoff_until from states")
def domain_states(spark, d):
    return _states(spark, d).fillna(0, ["next_request_at", "backoff_until"])


def _queue(spark, d):
    return table(spark, d, "crawl_logs").where("status <> 'indexed'").groupBy("url").agg(F.min("created_at").alias("created_at")).select(U.url_hash("url").alias("url_hash"), "url", U.host("url").alias("domain"), "created_at")


@query(f"with {QUEUE}, {STATES} select url_hash, url, domain, created_at from queue left join states using (domain) where coalesce(next_request_at, 0) <= {LATE} - {DAY} and coalesce(backoff_until, 0) <= {LATE} - {DAY} qualify row_number() over (partition by domain order by created_at, url_hash) <= 3 order by created_at, url_hash limit 100")
def queue_pop(spark, d):
    now = _now(table(spark, d, "crawl_logs")) - DAY
    return C.queue_pop(_queue(spark, d), _states(spark, d), now, 100)


@query("select id, case when length(m) > 12 then substr(m, 1, 9) || '...' else m end as error from (select id, trim(regexp_replace(error_message, '\\s+', ' ', 'g')) as m from crawl_logs where error_message is not null)")
def error_texts(spark, d):
    return table(spark, d, "crawl_logs").where("error_message is not null").select("id", X.error_text("error_message", 12).alias("error"))


@query("select id, least(pow(2.0, id % 14), 3600.0) as wait from crawl_logs where status = 'retry_later'")
def retry_delays(spark, d):
    return table(spark, d, "crawl_logs").where("status = 'retry_later'").select("id", X.retry_delay(F.col("id") % 14).alias("wait"))


@query(f"select u.url, case when ends_with({HOST.format('u.url')}, '.invalid') then 'denied' when length(u.url) > 2083 then 'too_long' when not coalesce(r.allowed, true) then 'robots' end as failed from (select distinct url from crawl_logs) u left join (select {HOST.format('url')} as host, bool_and(error_message is distinct from 'robots') as allowed from crawl_logs group by 1) r on r.host = {HOST.format('u.url')}")
def prechecked(spark, d):
    logs = table(spark, d, "crawl_logs")
    robots = logs.groupBy(U.host("url").alias("host")).agg(F.bool_and(~F.col("error_message").eqNullSafe("robots")).alias("allowed"))
    deny = spark.createDataFrame([("invalid",)], "domain string")
    return C.precheck(logs.select("url").distinct(), deny, U.private_ipv4(U.host("url")), robots).select("url", "failed")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def hourly_events(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"))


@query(
    """with w as (select date_trunc('hour', ts) - interval 1 hour * k as start, event_type from events, range(0, 6) t(k))
select start, count(*) as attempts, count(*) filter (event_type = 'error') as errors from w group by start having count(*) > 20 and errors > 0.05 * attempts"""
)
def sliding_error_share(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    n = e.groupBy(F.window("t", "6 hours", "1 hour")).agg(F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("errors")).where((F.col("attempts") > 20) & (F.col("errors") > 0.05 * F.col("attempts")))
    return n.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "attempts", "errors")


@query(
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, k"""
)
def sessions(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.session_window("t", "30 minutes"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("select event_id % 200 as impression_id, user_id, min(ts) as clicked_at, count(*) as clicks from events where event_type = 'click' group by all")
def distinct_clicks(spark, d):
    return table(spark, d, "events").where("event_type = 'click'").groupBy((F.col("event_id") % 200).alias("impression_id"), "user_id").agg(F.min("ts").alias("clicked_at"), F.count("*").alias("clicks"))


@query("select c.event_id as click_id, v.event_id as view_id, date_diff('second', v.ts, c.ts) as after_s from events c join events v on c.user_id = v.user_id and v.event_type = 'view' and c.event_type = 'click' and v.ts <= c.ts and v.ts > c.ts - interval 1 hour")
def clicks_after_views(spark, d):
    e = table(spark, d, "events")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    # the hour is a second key: a view lies in the hour of its click or in the one before
    c = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("c"), F.explode(F.array(hour, hour - 1)).alias("hour"))
    v = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("v"), hour.alias("hour"))
    near = c.join(v, ["user_id", "hour"]).where("v <= c and v > c - interval 1 hour")
    second = lambda x: F.unix_seconds(F.date_trunc("second", F.col(x).cast("timestamp")))
    return near.select("click_id", "view_id", (second("c") - second("v")).alias("after_s"))


@query("select date_trunc('minute', ts) as minute, user_id, count(*) as n from events group by all having count(*) >= 2")
def busy_minutes(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("minute"), "user_id").agg(F.count("*").alias("n")).where("n >= 2")


@query("select cast(json_extract(props, '$.k') as integer) as k, count(*) as n, round(sum(value), 2) as value from events group by 1")
def event_properties(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("select array_to_string(regexp_extract_all(lower(query), '[a-z0-9]+'), ' ') as q, string_agg(distinct suite, ',' order by suite) as suites, count(*) as n from eval_items group by 1 order by n desc, count(distinct suite) desc, q limit 100")
def query_candidates(spark, d):
    q = F.array_join(X.query_tokens("query"), " ").alias("q")
    return table(spark, d, "eval_items").groupBy(q).agg(F.array_join(F.array_sort(F.collect_set("suite")), ",").alias("suites"), F.count("*").alias("n")).orderBy(F.desc("n"), F.desc(F.size(F.split("suites", ","))), "q").limit(100)


@query("(select event_type as kind, user_id, count(*) as n from events where event_type = 'click' group by all order by n desc, user_id limit 10) union all (select event_type, user_id, count(*) as n from events where event_type = 'error' group by all order by n desc, user_id limit 10)")
def top_clicks_and_errors(spark, d):
    e = table(spark, d, "events")
    top = lambda kind: e.where(F.col("event_type") == kind).groupBy(F.col("event_type").alias("kind"), "user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)
    return top("click").unionByName(top("error"))
