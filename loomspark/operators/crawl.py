"""Crawling: admission of URLs, queue, state of domains and logs of attempts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as U

# What is never crawled.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".pdf", ".zip", ".gz", ".tar", ".exe", ".dmg", ".deb", ".rpm", ".msi", ".iso", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".css", ".js", ".woff", ".woff2")
PATHS = ("/login", "/signup", "/register", "/signin", "/cart", "/wishlist", "/checkout", "/account", "/search")
PARTS = ("/wp-content/", "/comments", "/comment-page-", "/amp")
PARAMETERS = ("replytocom",)
# Outcomes of attempts.
ERRORS = ("indexer_error", "http_error", "unknown_error", "dead_letter")
SUMMARY = {"indexed": "submitted", "blocked": "blocked", "skipped": "skipped", "retry_later": "retrying", "indexer_error": "failed", "http_error": "failed", "unknown_error": "failed", "dead_letter": "failed"}


def under(path: Column, prefixes) -> Column:
    """Is a path one of the prefixes or below it, by whole segments?"""
    tests = [(path == p) | path.startswith(p.rstrip("/") + "/") for p in prefixes]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def admission(df: DataFrame, url: str = "url", extensions=EXTENSIONS, paths=PATHS, parts=PARTS, parameters=PARAMETERS, domain_rules: tuple[dict, ...] = ()) -> DataFrame:
    """Adds normalized_url, reason (null where allowed) and scope; the first rule that matches decides.

    domain_rules: dicts of domains and reject_path_prefixes, reject_path_contains, reject_query_params, allow_path_prefixes."""
    df = df.withColumn("normalized_url", U.normalize_for_admission(url))
    path, host = F.lower(U.path("normalized_url")), U.host("normalized_url")
    names = F.transform(F.filter(F.split(U.query("normalized_url"), "&"), lambda p: p != ""), lambda p: F.lower(F.substring_index(p, "=", 1)))
    has = lambda keys: F.arrays_overlap(names, F.array(*map(F.lit, keys))) if keys else F.lit(False)
    holds = lambda tokens: reduce(lambda a, b: a | b, [path.contains(t) for t in tokens], F.lit(False))
    rules = [
        (F.col("normalized_url").isNull(), "invalid_url", None), (F.regexp_extract(path, r"(\.[^.]*)$", 1).isin(*extensions), "filtered_extension", None),
        (under(path, paths), "filtered_path_prefix", None), (holds(parts), "filtered_path_contains", None), (has(parameters), "filtered_query_param", None),
    ]
    for r in domain_rules:
        mine = reduce(lambda a, b: a | b, [(host == d) | host.endswith("." + d) for d in r["domains"]])
        scope = r["domains"][0]
        if r.get("allow_path_prefixes"):
            rules.append((mine & ~under(path, r["allow_path_prefixes"]), "domain_scope_denied", scope))
        rules += [(mine & under(path, r.get("reject_path_prefixes", ())), "domain_path_prefix_denied", scope), (mine & holds(r.get("reject_path_contains", ())), "domain_path_contains_denied", scope), (mine & has(r.get("reject_query_params", ())), "domain_query_param_denied", scope)]
    reason = reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1]))
    scope = reduce(lambda c, r: c.when(r[0], F.lit(r[2])), rules[1:], F.when(rules[0][0], F.lit(rules[0][2])))
    return df.withColumn("reason", reason).withColumn("scope", scope.cast("string"))


def denied(df: DataFrame, denylist: DataFrame, host: Column, how: str = "left_anti") -> DataFrame:
    """Without (or, left_semi, only) the rows whose host or a parent of it is listed (column domain).

    A host's parents are few, so the suffix test is an equi join on them."""
    named = df.withColumn("_host", host)
    bad = named.select("_host").distinct().select("_host", F.explode(U.suffixes("_host")).alias("domain")).join(denylist.select("domain").distinct(), "domain", "left_semi").select("_host").distinct()
    return named.join(bad, "_host", how).drop("_host")


def discovered(links: DataFrame) -> DataFrame:
    """Of each page's links those to enqueue: feeds always; one HTML link of the page's own host without query, fragment or asterisk.

    links: source, url, kind ('html' or 'feed')."""
    plain = ~F.col("url").rlike(r"[?#*]") & (U.host("url") == U.host("source"))
    html = links.where((F.col("kind") == "html") & plain).groupBy("source").agg(F.min_by("url", F.sha2("url", 256)).alias("url")).select("source", "url", F.lit("html").alias("kind"))
    return links.where(F.col("kind") == "feed").select("source", "url", "kind").distinct().unionByName(html)


def queue_pop(queue: DataFrame, state: DataFrame, now: int, count: int, per_domain: int = 3) -> DataFrame:
    """The ready rows to crawl next: oldest first, at most per_domain of a domain and count in all.

    queue: url_hash, url, domain, created_at; state: domain, next_request_at, backoff_until."""
    ready = queue.join(state.select("domain", "next_request_at", "backoff_until"), "domain", "left").where((F.coalesce("next_request_at", F.lit(0)) <= now) & (F.coalesce("backoff_until", F.lit(0)) <= now))
    capped = ready.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy("created_at", "url_hash"))).where(F.col("_n") <= per_domain)
    return capped.select(*queue.columns).orderBy("created_at", "url_hash").limit(count)


def domain_states(results: DataFrame, delay: float = 1.0) -> DataFrame:
    """State of each domain after all its results, without ordering them in one task.

    A success resets the streak, so the streak is the number of failures after the last success, and only the last
    result sets the times.  results: domain, id, at (epoch seconds), ok.  Ties in time go by id."""
    when = F.struct("at", "id")
    last = results.groupBy("domain").agg(F.max(F.when(F.col("ok"), when)).alias("good"), F.max(F.struct("at", "id", "ok")).alias("top"), F.count("*").alias("attempts"))
    streaks = results.join(last.select("domain", "good"), "domain").groupBy("domain").agg(F.count_if(~F.col("ok") & (F.col("good").isNull() | (when > F.col("good")))).alias("fail_streak"))
    wait = max(1, -(-int(delay * 1000) // 1000))
    return last.join(streaks, "domain").select(
        "domain", "attempts", F.col("fail_streak"), F.when(F.col("top.ok"), F.col("top.at") + wait).alias("next_request_at"),
        F.when(~F.col("top.ok"), F.col("top.at") + F.least(F.lit(wait) * F.pow(F.lit(2.0), F.least("fail_streak", F.lit(10))), F.lit(3600.0)).cast("long")).alias("backoff_until"),
    )


def summary_status(status: str = "status") -> Column:
    table = F.create_map(*[F.lit(x) for kv in SUMMARY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(status)), F.col(status))


def failing_domains(logs: DataFrame, since: int, least: int = 5, top: int = 20) -> DataFrame:
    bad = F.col("status").isin(*ERRORS, "blocked")
    n = logs.where(F.col("created_at") >= since).groupBy(U.host("url").alias("domain")).agg(F.count("*").alias("total"), F.count_if(bad).alias("errors")).where((F.col("domain") != "") & (F.col("total") >= least) & (F.col("errors") > 0))
    return n.withColumn("error_rate", F.round(F.col("errors") * 100 / F.col("total"), 1)).orderBy(F.desc("error_rate"), F.desc("errors"), "domain").limit(top)


def blocked_domains(logs: DataFrame, since: int, least: int = 3, message: str = "robots") -> DataFrame:
    return logs.where((F.col("created_at") >= since) & (F.col("status") == "blocked") & (F.col("error_message") == message)).groupBy(U.host("url").alias("domain")).agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("domain") != ""))


def precheck(df: DataFrame, denylist: DataFrame, private: Column, robots: DataFrame) -> DataFrame:
    """First test that a URL fails: denied, too_long, robots, private; null where it passes.  robots: host, allowed."""
    marked = denied(df, denylist, U.host("url"), "left_semi").select("url").withColumn("_denied", F.lit(True)).distinct()
    joined = df.join(marked, "url", "left").withColumn("_host", U.host("url")).join(robots.select(F.col("host").alias("_host"), "allowed"), "_host", "left")
    return joined.withColumn("failed", F.when(F.col("_denied"), "denied").when(F.length("url") > U.MAX_LENGTH, "too_long").when(~F.coalesce("allowed", F.lit(True)), "robots").when(private, "private")).drop("_denied", "_host", "allowed")
