"""How a table of queries is understood and its hits are ranked, by rules that are tables or lists.

A query belongs to a source if it equals or starts with one of its aliases; what follows the alias decides its class.  Rules: rows of
sources (source, aliases, domains, paths, news_paths, default_class, candidate_window, retrieval_query) and word lists by name
(news, other, suffix, stop, recruiting).  Rule tables are configuration, so they are broadcast only below Spark's own bound.

Empty queries and queries with a site filter are of class `other`; null queries too."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U
from . import matching as M

SOURCE = "source int, aliases array<string>, domains array<string>, paths array<string>, news_paths array<string>, default_class string, candidate_window int, retrieval_query string"
#: Candidates at most, for comparisons, for sources and news, and else.
CANDIDATES, WIDE, NARROW = 200, 100, 20
# What speaks of a comparison, and paths that are like a root.
CUE = r"\b(?:vs|versus|compare|compared|comparison|comparing|difference|differences)\b"
ROOTS = ("", "/", "/index.html", "/home")


def _list(words) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _any(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts], F.lit(False))


def classify(queries: DataFrame, sources: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """Adds query_class, source, rest, intent_terms, subjects, demote and rewritten (what is searched for).

    queries: query_id, query (normalised), site (null without a site filter)."""
    list_of = lambda name: _list(words.get(name, ()))
    alias = sources.select("source", F.explode("aliases").alias("alias"))
    met = M.match_alias(queries.where("query <> '' and site is null").select("query_id", "query"), alias).select("query_id", "source", "alias", "rest")
    firsts = F.array_distinct(F.transform(F.filter("aliases", lambda a: a != ""), lambda a: F.split(a, " ")[0]))
    known = sources.withColumn("identity", F.when(F.size(firsts) == 1, firsts).otherwise(F.array().cast("array<string>"))).drop("aliases")
    q = queries.join(met, "query_id", "left").join(known, "source", "left")
    terms, rest = T.query_tokens("query"), F.filter(F.split(F.coalesce("rest", F.lit("")), " "), lambda t: t != "")
    subjects = M.comparison(F.col("query"))
    ours = F.filter(terms, lambda t: ~F.array_contains(F.coalesce("identity", list_of("")), t) & ~F.array_contains(list_of("stop"), t))
    theirs = F.flatten(F.transform(F.coalesce("_subjects", list_of("")), lambda s: T.query_tokens(s)))
    every = lambda name: F.forall("_rest", lambda t: F.array_contains(list_of(name), t))
    loose = F.when(F.col("_subjects").isNotNull(), "comparison").otherwise("other")
    q = q.withColumn("_subjects", F.when(F.coalesce("query", F.lit("")) != "", F.when(F.col("site").isNull(), subjects))).withColumn("_rest", rest)
    kind = (
        F.when((F.coalesce("query", F.lit("")) == "") | F.col("site").isNotNull(), "other").when(F.col("source").isNull(), loose).when(F.size("_rest") == 0, F.col("default_class"))
        .when(every("news") & (F.size("news_paths") > 0), "news").when(F.arrays_overlap("_rest", list_of("other")), loose).when(every("suffix"), F.col("default_class")).otherwise("reference")
    )
    q = q.withColumn("query_class", kind)
    own = F.col("source").isNotNull() & ~F.col("query_class").isin("comparison", "other")
    return q.select(
        "query_id", "query", "query_class", F.when(own, F.col("source")).alias("source"), "rest",
        F.when(F.col("query_class") == "comparison", theirs).when(F.col("source").isNotNull(), ours).otherwise(list_of("")).alias("intent_terms"),
        F.when(F.col("query_class") == "comparison", F.col("_subjects")).alias("subjects"),
        (~F.arrays_overlap(F.split(F.coalesce("query", F.lit("")), " "), list_of("recruiting"))).alias("demote"),
        F.when(F.col("query_class") == "comparison", F.array_join("_subjects", " ")).when(own, F.coalesce("retrieval_query", "query")).otherwise(F.col("query")).alias("rewritten"),
        F.when(own, F.col("candidate_window")).alias("candidate_window"),
    )


def window(limit: Column, page: Column) -> Column:
    """How many candidates are fetched for a page, by the columns of `classify`; later pages are taken as they are."""
    least = (
        F.when(F.col("query_class") == "comparison", WIDE).when(F.col("source").isNull(), F.when(F.col("demote"), NARROW).otherwise(0))
        .when(F.col("query_class").isin("navigational", "news"), F.greatest(F.coalesce("candidate_window", F.lit(0)), F.lit(WIDE))).otherwise(F.greatest(F.coalesce("candidate_window", F.lit(0)), F.lit(NARROW)))
    )
    plain = F.col("source").isNull() & ~F.col("demote") & (F.col("query_class") != "comparison")
    return F.when((page != 1) | plain, limit).otherwise(F.least(F.lit(CANDIDATES), F.greatest(limit, least)))


def matches(terms: Column, text: Column) -> Column:
    """How many terms equal a token of the text or one is the other's prefix."""
    tokens = T.query_tokens(text)
    return F.size(F.filter(terms, lambda t: F.exists(tokens, lambda k: k.startswith(t) | t.startswith(k))))


def recruiting(hosts=(), paths=(), titles=()) -> Column:
    """Is a hit a page for applicants, by suffix of its host or part of its path or title?"""
    host = reduce(lambda a, b: a | b, [(U.host("url") == h) | U.host("url").endswith(f".{h}") for h in hosts], F.lit(False))
    return host | _any(F.lower(U.path("url")), paths) | _any(F.lower(F.coalesce("title", F.lit(""))), titles)


def comparison_match(low_titles=(), low_paths=()) -> Column:
    """How well a hit compares the two `subjects`: where both stand, whether it speaks of a comparison, less what speaks against it."""
    title, path = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.when(U.path("url") == "", "/").otherwise(U.path("url")))
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), "url", F.coalesce("content", F.lit(""))))
    both = lambda x: F.forall("subjects", lambda s: F.contains(x, s))
    cue = lambda x: x.rlike(CUE)
    low, cued = _any(title, low_titles) | _any(path, low_paths), cue(title) | cue(path)
    rootish = path.isin(*ROOTS) | (F.size(F.filter(F.split(path, "/"), lambda p: p != "")) <= 1)
    one = F.size(F.filter("subjects", lambda s: F.contains(text, s))) == 1
    score = (
        F.when(both(title), 6).when(both(path), 5).when(both(text), 4).otherwise(0) + F.when(cued, 4).when(cue(text), 3).otherwise(0)
        - F.when(one & rootish, 4).otherwise(0) - F.when(~both(title) & ~both(path) & cue(text), 2).otherwise(0) - F.when(low, 3).otherwise(0) - F.when(low & ~cued, 2).otherwise(0)
    )
    return F.when(F.col("subjects").isNotNull(), score).otherwise(0)


def source_match() -> Column:
    """0 for another host, 1 for one of the source's `domains`, 2 for below one of its paths, 3 for one of them; news have paths of their own."""
    host, path = F.regexp_replace(U.host("url"), r"^www\.", ""), F.when(U.path("url") == "", "/").otherwise(U.path("url"))
    paths = F.coalesce(F.when(F.col("query_class") == "news", F.col("news_paths")).otherwise(F.col("paths")), F.array().cast("array<string>"))
    below = F.exists(paths, lambda p: F.when(p == "/", path == "/").otherwise(path.startswith(p)))
    return F.when(F.col("domains").isNull() | ~F.array_contains("domains", host), 0).when(F.array_contains(paths, path), 3).when(below, 2).otherwise(1)


def signals(hits: DataFrame, policies: DataFrame, sources: DataFrame, recruiting_page: Column, low_titles=(), low_paths=()) -> DataFrame:
    """Hits (query_id, url, title, content, rank, page_rank, domain_rank) with all signals of their query's policy."""
    named = hits.join(policies.select("query_id", "query_class", "source", "intent_terms", "subjects", "demote"), "query_id").join(sources.select("source", "domains", "paths", "news_paths"), "source", "left")
    return named.select(
        *hits.columns, "query_class", source_match().alias("source_match"), matches(F.col("intent_terms"), F.coalesce("title", F.lit(""))).alias("title_match"),
        matches(F.col("intent_terms"), U.path("url")).alias("path_match"), comparison_match(low_titles, low_paths).alias("comparison_match"), (F.col("demote") & recruiting_page).alias("recruiting"),
    )


def rerank(signalled: DataFrame, limit: int) -> DataFrame:
    """New ranks by the class of the query: comparisons by how well a hit compares, sources by how near it is to them, others
    as retrieved; pages for applicants last.  A comparison shows each host once before it repeats one."""
    main = F.when(F.col("query_class") == "comparison", F.col("comparison_match")).when(F.col("query_class") != "other", F.col("source_match")).otherwise(0)
    known = F.col("query_class") != "other"
    by = [F.col("recruiting").cast("int"), main.desc(), *[F.when(known, F.coalesce(c, F.lit(0.0))).desc() for c in ("title_match", "path_match", "page_rank", "domain_rank")], F.col("rank")]
    placed = signalled.withColumn("_place", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).withColumn("_host", F.regexp_replace(U.host("url"), r"^www\.", ""))
    again = F.when(F.col("query_class") == "comparison", F.row_number().over(Window.partitionBy("query_id", "_host").orderBy("_place")) > 1).otherwise(F.lit(False))
    ranked = placed.withColumn("_again", again).withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("_again").cast("int"), "_place")))
    return ranked.where(F.col("new_rank") <= limit).drop("_place", "_host", "_again")


def comparison_boosts(left: str, right: str) -> list[tuple[str, list[str], float]]:
    """Optional clauses of a comparison as (kind, words, boost): both subjects in the title, cues in the title, both subjects anywhere, and the phrases."""
    a, b = left.strip().lower(), right.strip().lower()
    if not a or not b:
        return []
    phrases = [f"{x} {v} {y}" for v in ("vs", "versus") for x, y in ((a, b), (b, a))]
    return [("title", f"{a} {b}".split(), 6.0), ("cue", f"{a} {b} vs versus compare comparison".split(), 3.0), ("both", f"{a} {b}".split(), 4.0), *[("phrase", p.split(), 7.0) for p in phrases]]


def boost_score(clauses, title: Column, content: Column) -> Column:
    """Sum of the boosts of the clauses that fit; title and content are arrays of terms.  Of the cues half must stand in the title."""
    held = lambda words: F.size(F.array_intersect(_list(dict.fromkeys(words)), title))
    total = F.lit(0.0)
    for kind, words, boost in clauses:
        n = len(dict.fromkeys(words))
        spaced = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
        fits = {
            "title": held(words) == n, "cue": held(words) >= max(1, n // 2), "both": F.size(F.array_intersect(_list(dict.fromkeys(words)), F.array_union(title, content))) == n,
            "phrase": spaced(title).contains(" " + " ".join(words) + " ") | spaced(content).contains(" " + " ".join(words) + " "),
        }[kind]
        total = total + F.when(fits, boost).otherwise(0.0)
    return total
