"""Queries that classify queries and rank their hits by rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import matching as M
from ..operators import policy as P
from .search import MANY, _found
from .tables import HOST, _sql_list, query, table

ROWS = [
    (1, ["what is", "what is known"], ["forum.lorux-2.test", "harbourlight.example"], ["/docs", "/wiki"], ["/news"], "navigational", 40, None),
    (2, ["der f", "das ortsarchiv"], ["blog.shaquafen-4.invalid"], [], [], "reference", 10, "ortsarchiv"),
    (3, ["what is known about short", "what is known about big"], ["daily.harbourlight.example"], ["/"], ["/news", "/post"], "news", 150, "short game"),
]
WORDS = {"news": ["game", "in", "torhelfen", "door"], "other": ["vs", "red"], "suffix": ["about", "known"], "stop": ["is", "about", "in"], "recruiting": ["warm", "link"]}
PATH = "coalesce(nullif(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"

# the queries as they are, and each compared with its suite
ASKED = """asked as (select item_id * 2 as query_id, array_to_string(regexp_extract_all(lower(query), '[a-z0-9]+'), ' ') as query from (select distinct item_id, query from eval_items)
  union all select item_id * 2 + 1, trim(array_to_string(regexp_extract_all(lower(query), '[a-z0-9]+'), ' ') || ' vs ' || suite) from (select distinct item_id, query, suite from eval_items))"""


def _l(xs):
    return f"[{_sql_list(xs)}]" if xs else "[]::varchar[]"


RULES = ", ".join(f"({s}, {_l(a)}, {_l(d)}, {_l(p)}, {_l(n)}, '{c}', {w}, {'null' if r is None else repr(r)})" for s, a, d, p, n, c, w, r in ROWS)
POLICY = f"""{ASKED},
rules(source, aliases, domains, paths, news_paths, default_class, candidate_window, retrieval_query) as (values {RULES}),
met as (select query_id, source, alias, trim(substr(query, length(alias) + 1)) as rest from asked join (select source, unnest(aliases) as alias from rules) on query = alias or starts_with(query, alias || ' ') where query <> '' qualify row_number() over (partition by query_id order by length(alias) desc, source) = 1),
sides as (select query_id, regexp_split_to_array(query, '\\s+(?:vs|versus)\\s+') as s from asked),
seen as (select a.query_id, a.query, m.source as src, rest, case when query <> '' and len(s) = 2 and trim(s[1]) <> '' and trim(s[2]) <> '' and trim(s[1]) <> trim(s[2]) then [trim(s[1]), trim(s[2])] end as subj,
  list_filter(string_split(coalesce(rest, ''), ' '), lambda t: t <> '') as r, rules.* exclude (source), case when len(list_distinct(list_transform(aliases, lambda a: string_split(a, ' ')[1]))) = 1 then [string_split(aliases[1], ' ')[1]] else []::varchar[] end as identity
  from asked a left join met m using (query_id) left join rules on m.source = rules.source join sides using (query_id)),
classed as (select *, case when query = '' then 'other' when src is null then case when subj is null then 'other' else 'comparison' end when len(r) = 0 then default_class
  when len(list_filter(r, lambda t: not list_contains({_l(WORDS["news"])}, t))) = 0 and len(news_paths) > 0 then 'news' when list_has_any(r, {_l(WORDS["other"])}) then case when subj is null then 'other' else 'comparison' end
  when len(list_filter(r, lambda t: not list_contains({_l(WORDS["suffix"])}, t))) = 0 then default_class else 'reference' end as query_class from seen),
policy as materialized (select query_id, query, query_class, case when query_class not in ('comparison', 'other') then src end as source,
  case when query_class = 'comparison' then list_concat(regexp_extract_all(subj[1], '[a-z0-9]+'), regexp_extract_all(subj[2], '[a-z0-9]+')) when src is not null then list_filter(regexp_extract_all(query, '[a-z0-9]+'), lambda t: not list_contains(identity, t) and not list_contains({_l(WORDS["stop"])}, t)) else []::varchar[] end as intent,
  case when query_class = 'comparison' then subj end as subjects, not list_has_any(string_split(query, ' '), {_l(WORDS["recruiting"])}) as demote,
  case when query_class = 'comparison' then subj[1] || ' ' || subj[2] when query_class <> 'other' and src is not null then coalesce(retrieval_query, query) else query end as rewritten, case when query_class not in ('comparison', 'other') then candidate_window end as cw from classed)"""


def _rules(spark):
    return spark.createDataFrame(ROWS, P.SOURCE)


def _policies(spark, d):
    items = table(spark, d, "eval_items")
    plain = items.select("item_id", "query").distinct().select((F.col("item_id") * 2).alias("query_id"), M.query_key("query").alias("query"))
    versus = items.select("item_id", "query", "suite").distinct().select((F.col("item_id") * 2 + 1).alias("query_id"), F.trim(F.concat(M.query_key("query"), F.lit(" vs "), "suite")).alias("query"))
    return P.classify(plain.unionByName(versus).withColumn("site", F.lit(None).cast("string")), _rules(spark), WORDS)


@query(f"with {POLICY} select query_id, query, query_class, coalesce(source, 0) as source, array_to_string(intent, ' ') as intent, array_to_string(subjects, '|') as subjects, demote, rewritten from policy")
def query_policies(spark, d):
    return _policies(spark, d).select("query_id", "query", "query_class", F.coalesce("source", F.lit(0)).alias("source"), F.array_join("intent_terms", " ").alias("intent"), F.array_join("subjects", "|").alias("subjects"), "demote", "rewritten")


@query(
    f"""with {POLICY}, w as (select *, case when query_class = 'comparison' then 100 when source is null then case when demote then 20 else 0 end when query_class in ('navigational', 'news') then greatest(coalesce(cw, 0), 100) else greatest(coalesce(cw, 0), 20) end as least from policy)
select query_id, page, case when page <> 1 or (source is null and not demote and query_class <> 'comparison') then 10 else least(200, greatest(10, least)) end as candidates, (page - 1) * 10 as first from w, (values (1), (2)) t(page)"""
)
def candidate_windows(spark, d):
    pages = _policies(spark, d).withColumn("page", F.explode(F.array(F.lit(1), F.lit(2))))
    return pages.select("query_id", "page", P.window(F.lit(10), F.col("page")).alias("candidates"), ((F.col("page") - 1) * 10).alias("first"))


HIRING = {"hosts": ("quatam-0.invalid",), "paths": ("/wiki/", "/jobs"), "titles": ("guide", "hiring")}
LOW = {"low_titles": ("notes",), "low_paths": ("/post/",)}
CUE = "'\\b(?:vs|versus|compare|compared|comparison|comparing|difference|differences)\\b'"


def _holds(text, parts):
    return "(" + " or ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def _both(text):
    return f"(contains({text}, subjects[1]) and contains({text}, subjects[2]))"


def _matching(text):
    return f"len(list_filter(intent, lambda w: len(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda k: starts_with(k, w) or starts_with(w, k))) > 0))"


# hits of each query belong to its two policies
SIGNALS = f"""{MANY}, {POLICY},
texts as (select url, min(coalesce(title, '')) as title, min(coalesce(content, '')) as content, max(page_rank)::double as page_rank, max(domain_rank)::double as domain_rank from search_index group by url),
mine as (select f.query_id * 2 + k as query_id, f.url, rank, texts.* exclude (url), {HOST.format("f.url")} as host, {PATH.format("f.url")} as path from found f join texts using (url), (values (0), (1)) t(k)),
known as (select h.*, p.query_class, p.intent, p.subjects, p.demote, regexp_replace(host, '^www\\.', '') as bare, domains, case when p.query_class = 'news' then news_paths else paths end as ps, lower(h.title) as lt, lower(path) as lp, lower(h.title || ' ' || h.url || ' ' || h.content) as tx
  from mine h join policy p using (query_id) left join rules using (source)),
cued as (select *, {_holds("lt", LOW["low_titles"])} or {_holds("lp", LOW["low_paths"])} as low, regexp_matches(lt, {CUE}) or regexp_matches(lp, {CUE}) as cued, regexp_matches(tx, {CUE}) as ct from known),
signals as materialized (select query_id, url, rank, bare, page_rank, domain_rank, query_class,
  case when domains is null or not list_contains(domains, bare) then 0 when list_contains(ps, path) then 3 when len(list_filter(ps, lambda p: (p = '/' and path = '/') or (p <> '/' and starts_with(path, p)))) > 0 then 2 else 1 end as source_match,
  {_matching("title")} as title_match, {_matching("path")} as path_match,
  case when subjects is null then 0 else case when {_both("lt")} then 6 when {_both("lp")} then 5 when {_both("tx")} then 4 else 0 end + case when cued then 4 when ct then 3 else 0 end
   - case when contains(tx, subjects[1]) <> contains(tx, subjects[2]) and (lp in ('', '/', '/index.html', '/home') or len(list_filter(string_split(lp, '/'), lambda s: s <> '')) <= 1) then 4 else 0 end
   - case when not {_both("lt")} and not {_both("lp")} and ct then 2 else 0 end - case when low then 3 else 0 end - case when low and not cued then 2 else 0 end end as comparison_match,
  demote and ({" or ".join(f"host = '{h}' or ends_with(host, '.{h}')" for h in HIRING["hosts"])} or {_holds("lp", HIRING["paths"])} or {_holds("lt", HIRING["titles"])}) as recruiting from cued)"""


def _signals(spark, d):
    texts = table(spark, d, "search_index").groupBy("url").agg(F.min(F.coalesce("title", F.lit(""))).alias("title"), F.min(F.coalesce("content", F.lit(""))).alias("content"), F.max("page_rank").cast("double").alias("page_rank"), F.max("domain_rank").cast("double").alias("domain_rank"))
    hits = _found(spark, d).select(F.explode(F.array(F.col("query_id") * 2, F.col("query_id") * 2 + 1)).alias("query_id"), "url", "rank").join(texts, "url")
    return P.signals(hits, _policies(spark, d), _rules(spark), P.recruiting(**HIRING), **LOW)


@query(f"with {SIGNALS} select query_id, url, source_match, title_match::integer as title_match, path_match::integer as path_match, comparison_match, recruiting from signals")
def hit_signals(spark, d):
    return _signals(spark, d).select("query_id", "url", "source_match", "title_match", "path_match", "comparison_match", "recruiting")


@query(
    f"""with {SIGNALS}, placed as (select *, row_number() over (partition by query_id order by recruiting::int, case query_class when 'comparison' then comparison_match when 'other' then 0 else source_match end desc,
  case when query_class <> 'other' then title_match end desc, case when query_class <> 'other' then path_match end desc, case when query_class <> 'other' then coalesce(page_rank, 0) end desc, case when query_class <> 'other' then coalesce(domain_rank, 0) end desc, rank) as place from signals),
again as (select *, case when query_class = 'comparison' then row_number() over (partition by query_id, bare order by place) > 1 else false end as a from placed)
select query_id, url, query_class, row_number() over (partition by query_id order by a::int, place)::integer as new_rank from again qualify new_rank <= 5"""
)
def hits_by_class(spark, d):
    return P.rerank(_signals(spark, d), 5).select("query_id", "url", "query_class", "new_rank")


BOOSTS = P.comparison_boosts("sensor log", "garden planner")


def _boost_sql(kind, words, boost):
    one = list(dict.fromkeys(words))
    test = {
        "title": f"len(list_intersect({_l(one)}, t)) = {len(one)}", "cue": f"len(list_intersect({_l(one)}, t)) >= {max(1, len(one) // 2)}", "both": f"len(list_intersect({_l(one)}, list_concat(t, c))) = {len(one)}",
        "phrase": f"(contains(' ' || array_to_string(t, ' ') || ' ', ' {' '.join(words)} ') or contains(' ' || array_to_string(c, ' ') || ' ', ' {' '.join(words)} '))",
    }[kind]
    return f"case when {test} then {boost} else 0 end"


@query(f"with t as (select distinct url, list_filter(regexp_split_to_array(lower(coalesce(title_terms, '')), '\\s+'), lambda x: x <> '') as t, list_filter(regexp_split_to_array(lower(coalesce(content_terms, '')), '\\s+'), lambda x: x <> '') as c from search_index) select url, max(({' + '.join(_boost_sql(*b) for b in BOOSTS)})::double) as boost from t group by url having boost > 0")
def comparison_boosted(spark, d):
    index = table(spark, d, "search_index")
    score = P.boost_score(BOOSTS, X.terms(F.coalesce("title_terms", F.lit(""))), X.terms(F.coalesce("content_terms", F.lit(""))))
    return index.select("url", score.alias("boost")).groupBy("url").agg(F.max("boost").alias("boost")).where("boost > 0")
