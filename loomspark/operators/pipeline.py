"""Crawl outcomes, case outcomes, hit rules and rendering: what a service computes row by row, as expressions over tables."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# Addresses of cloud metadata services.
METADATA = ("169.254.169.254", "metadata.google.internal", "100.100.100.200")


def _some(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def fetched(kind: Column, parsed: Column, entries: Column, indexed: Column, content: Column, failure: Column) -> Column:
    """struct(status, message) of a crawl task.

    failure: null, 'network' or another error of fetching; kind: 'html' or 'feed'; parsed: could the body be parsed; entries: entries of a feed,
    or null; indexed: how many of them, or of pages, the index took; content: main text of a page.  Nulls count as nothing found."""
    say = lambda status, message: F.struct(F.lit(status).alias("status"), F.lit(message).alias("message"))
    took = F.coalesce(indexed, F.lit(0)) > 0
    page = F.when(F.coalesce(F.trim(content), F.lit("")) == "", say("skipped", "No main content found")).when(took, say("indexed", "Indexed")).otherwise(say("indexer_error", "Index refused the page"))
    feed = (
        F.when(~F.coalesce(parsed, F.lit(False)), say("unknown_error", "Feed parse failed")).when(F.coalesce(entries, F.lit(0)) == 0, say("skipped", "No feed entries found"))
        .when(took, say("indexed", "Feed entries indexed")).otherwise(say("indexer_error", "Feed entries failed to index"))
    )
    return F.when(failure == "network", say("http_error", "Network error")).when(failure.isNotNull(), say("unknown_error", "Fetch failed")).when(kind == "feed", feed).otherwise(page)


def crawl_delays(observed: DataFrame, known: DataFrame) -> DataFrame:
    """(domain, delay): delays only ever rise; null ones don't count."""
    return known.select("domain", "delay").unionByName(observed.select("domain", "delay")).where("delay is not null").groupBy("domain").agg(F.max("delay").alias("delay"))


def private_host(host: Column) -> Column:
    """Is a host empty, a metadata service, or an IPv4 or IPv6 literal that is private, loopback, link-local or reserved?  Names aren't resolved."""

    @F.pandas_udf("boolean")
    def literal(hosts: pd.Series) -> pd.Series:
        def test(h):
            try:
                a = ipaddress.ip_address((h or "").strip("[]").split("%")[0])
            except ValueError:
                return False
            return a.is_private or a.is_loopback or a.is_link_local or a.is_reserved

        return hosts.map({h: test(h) for h in hosts.unique()}).fillna(False).astype(bool)

    shaped = host.rlike(r"^[\d.]+$|:")  # names never reach Python
    return F.when(F.coalesce(host, F.lit("")) == "", True).when(host.isin(*METADATA), True).otherwise(literal(F.when(shaped, host)))


def excluded(host: Column, path: Column, hosts=(), prefixes=()) -> Column:
    """Pages that stay out of the index: of some hosts, or on or below some paths."""
    from functools import reduce

    below = reduce(lambda a, b: a | b, [(path == p) | path.startswith(p + "/") for p in prefixes], F.lit(False))
    return host.isin(*hosts) | below


def rule_fits(rule: str = "rule") -> Column:
    """Does a hit (url, title, content) meet a rule, its parts tested in a fixed order?  A part that is null or empty demands nothing.

    rule: struct of arrays required_domains, excluded_domains, required_paths, path_terms, title_terms, terms, any_terms."""
    r = lambda name: F.col(f"{rule}.{name}")
    host, path = F.regexp_replace(U.host("url"), r"^www\.", ""), F.lower(F.when(U.path("url") == "", "/").otherwise(U.path("url")))
    title = F.lower(F.coalesce("title", F.lit("")))
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), "url", F.coalesce("content", F.lit(""))))
    of = lambda names: F.exists(names, lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))
    part = lambda name, test: ~_some(r(name)) | test(r(name))
    return (
        part("required_domains", of) & part("excluded_domains", lambda x: ~of(x)) & part("required_paths", lambda x: F.array_contains(x, path)) & part("path_terms", lambda x: F.exists(x, lambda t: F.contains(path, t)))
        & part("title_terms", lambda x: F.forall(x, lambda t: F.contains(title, t))) & part("terms", lambda x: F.forall(x, lambda t: F.contains(text, t))) & part("any_terms", lambda x: F.exists(x, lambda t: F.contains(text, t)))
    )


def expected_domain(cases: DataFrame, known: DataFrame) -> DataFrame:
    """Adds expected_domain: what stands between backticks, else the longest known domain (column domain) that the text holds.

    Domains are cut out of the text and looked up, so that no text meets every domain."""
    quoted = F.lower(F.regexp_extract("text", "`([^`]+)`", 1))
    words = cases.select("case_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+"), F.lit(0)))).alias("_w"))
    inner = words.select("case_id", F.explode(U.suffixes("_w")).alias("domain")).join(known.select(F.lower("domain").alias("domain")).distinct(), "domain", "left_semi")
    best = inner.groupBy("case_id").agg(F.max_by("domain", F.struct(F.length("domain"), "domain")).alias("_d"))
    return cases.join(best, "case_id", "left").withColumn("expected_domain", F.when(quoted != "", quoted).otherwise(F.col("_d"))).drop("_d")


def case_outcomes(cases: DataFrame, hits: DataFrame, top: int = 3) -> DataFrame:
    """(case_id, outcome, reason).  cases: case_id, query_type, expected_domain; hits: case_id, url, rank, relevance, fits (a rule of the case, or null).

    One aggregation per case over its best hits: no hits, a bad hit on top, the case's rule, the expected host, else no rule."""
    host = F.regexp_replace(U.host("url"), r"^www\.", "")
    best = hits.where(F.col("rank") <= top).join(cases.select("case_id", "expected_domain"), "case_id")
    own = (host == F.col("expected_domain")) | host.endswith(F.concat(F.lit("."), F.col("expected_domain")))
    facts = best.groupBy("case_id").agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("relevance") < 0), F.lit(False)).alias("bad"), F.bool_or("fits").alias("fits"), F.coalesce(F.bool_or(own), F.lit(False)).alias("own"))
    j = cases.join(facts, "case_id", "left")
    say = lambda ok, why: F.struct(F.lit("pass" if ok else "fail").alias("outcome"), F.lit(why).alias("reason"))
    hosted = F.col("query_type").isin("navigational", "reference", "news")
    verdict = (
        F.when(F.coalesce("n", F.lit(0)) == 0, say(False, "no hits")).when(F.col("bad"), say(False, "bad hit on top")).when(F.col("fits"), say(True, "rule met")).when(~F.col("fits"), say(False, "rule not met"))
        .when(hosted & F.col("expected_domain").isNull(), say(False, "no expected domain")).when(hosted & F.col("own"), say(True, "expected domain on top")).when(hosted, say(False, "expected domain missing")).otherwise(say(False, "no rule"))
    )
    return j.select("case_id", verdict.alias("v")).select("case_id", "v.outcome", "v.reason")


def derived_judgments(sources: DataFrame) -> DataFrame:
    """(source, relevance, domain, path_prefix): pages below preferred paths 3, other pages of the source 2, or 3 if it prefers none.

    sources: source, query_type, domains, paths, news_paths."""
    news = F.col("query_type").contains("news") & _some(F.col("news_paths"))
    s = sources.select("source", F.explode("domains").alias("domain"), F.when(news, F.col("news_paths")).otherwise(F.coalesce("paths", F.array().cast("array<string>"))).alias("_p"))
    paths = s.select("source", F.lit(3).alias("relevance"), "domain", F.explode("_p").alias("path_prefix"))
    return paths.unionByName(s.select("source", F.when(_some(F.col("_p")), 2).otherwise(3).alias("relevance"), "domain", F.lit(None).cast("string").alias("path_prefix")))


def hit_json(content: bool = False) -> Column:
    """A hit as JSON; ranks and contents that are null are left out."""
    names = ["url", "title", "score", "page_rank", "domain_rank", *(["content"] if content else [])]
    return F.to_json(F.struct(*names), {"ignoreNullFields": "true"})


def hits_markdown(hits: DataFrame, key: str, query: str, total: str) -> DataFrame:
    """(key, markdown): the hits of each query as a numbered list under its heading, whole pages of hits only, so a query's hits are few.

    hits: key, query, total, rank, url, title, snippet; a query without hits has one row with a null url."""
    entry = F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". ["), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")), F.lit("]("), F.col("url"), F.lit(")\n"), F.coalesce(F.concat("snippet", F.lit("\n")), F.lit("")))
    g = hits.groupBy(key).agg(F.first(query).alias("_q"), F.first(total).alias("_t"), F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("rank", entry.alias("e"))))).alias("_h"))
    body = F.when(F.size("_h") == 0, "No results found.").otherwise(F.array_join(F.transform("_h", lambda h: h["e"]), "\n"))
    return g.select(key, F.concat(F.lit("## Search: "), "_q", F.lit("\n**"), F.col("_t").cast("string"), F.lit(" results**\n\n"), body).alias("markdown"))


def byte_chunks(text: Column, most: int = 32_000) -> Column:
    """A text in pieces of at most so many UTF-8 bytes that never split a character; null stays null, empty gives none."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def cut(t):
            raw, out, at = t.encode("utf-8", "surrogatepass"), [], 0
            while at < len(raw):
                end = min(at + most, len(raw))
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end -= 1
                out.append(raw[at:end].decode("utf-8", "surrogatepass"))
                at = end
            return out

        return texts.map(lambda t: None if t is None else cut(t))

    long = F.octet_length(text) > most  # short texts, which are nearly all, stay in the JVM
    return F.when(F.octet_length(text) == 0, F.array().cast("array<string>")).when(long, run(F.when(long, text))).when(text.isNotNull(), F.array(text))
