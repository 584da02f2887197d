"""Graph ranks, retrieval, ranking and evaluation queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import ranking as K
from ..operators import retrieval as R
from ..operators import snippets as S
from ..operators import vectors as V
from ..operators.postings import Postings
from ..session import new_path
from .tables import HOST, query, table

#: Iterations at most.
STEPS = 20


def _rank_sql(nodes: str, edges: str, steps: int = STEPS) -> str:
    """The iterations, unrolled; once the change is below the tolerance scores stay."""
    parts = [
        f"nodes as materialized ({nodes})", f"edges as materialized ({edges})",
        "outs as materialized (select src, count(*) as d from edges group by src)",
        "n as materialized (select count(*) as n from nodes)", "r0 as materialized (select url, 1.0::double / n as score from nodes, n)", "d0 as (select false as done)",
    ]
    for k in range(steps):
        parts.append(f"g{k} as (select e.dst as url, sum(r.score / o.d) as gain from edges e join outs o on e.src = o.src join r{k} r on r.url = e.src group by e.dst)")
        parts.append(f"l{k} as (select coalesce(sum(score), 0) as lost from r{k} where url not in (select src from outs))")
        parts.append(f"r{k + 1} as materialized (select r.url, case when done then r.score else 0.15 / n + 0.85 * (coalesce(g.gain, 0) + lost / n) end as score from r{k} r left join g{k} g on r.url = g.url, n, l{k}, d{k})")
        parts.append(f"d{k + 1} as materialized (select (select done from d{k}) or sum(abs(a.score - b.score)) < 1e-6 as done from r{k + 1} a join r{k} b using (url))")
    return "with " + ",\n".join(parts) + f"\nselect url, round(score / (select max(score) from r{steps}), 6) as score from r{steps}"


@query(_rank_sql("select distinct url from documents", "select distinct src, dst from links where src <> dst and src in (select url from documents) and dst in (select url from documents)"))
def pagerank_pages(spark, d):
    nodes = table(spark, d, "documents").select("url").distinct()
    return G.pagerank(nodes, G.page_edges(table(spark, d, "links"), nodes)).select("url", F.round("score", 6).alias("score"))


_PAIRS = f"select distinct {HOST.format('src')} as src, {HOST.format('dst')} as dst from links"


@query(_rank_sql(f"select distinct url from (select src as url, dst from ({_PAIRS}) where src <> '' and dst <> '' union all select dst, src from ({_PAIRS}) where src <> '' and dst <> '')", f"select src, dst from ({_PAIRS}) where src <> dst and src <> '' and dst <> ''"))
def pagerank_domains(spark, d):
    nodes, edges = G.domain_edges(table(spark, d, "links"))
    return G.pagerank(nodes, edges).select("url", F.round("score", 6).alias("score"))


@query("select url, round(coalesce(max(page_rank), 0), 5)::double as page_rank, round(coalesce(max(domain_rank), 0), 5)::double as domain_rank from search_index group by url")
def rank_enrichment(spark, d):
    ranks = table(spark, d, "search_index").groupBy("url").agg(F.max("page_rank").alias("p"), F.max("domain_rank").alias("r"))
    return ranks.select("url", F.round(F.coalesce("p", F.lit(0.0)).cast("double"), 5).alias("page_rank"), F.round(F.coalesce("r", F.lit(0.0)).cast("double"), 5).alias("domain_rank"))


DOCS = """docs as materialized (select distinct on (url) url, host, path, title, list_filter(regexp_split_to_array(lower(coalesce(title_terms, '')), '\\s+'), lambda x: x <> '') as t,
  list_filter(regexp_split_to_array(lower(coalesce(content_terms, '')), '\\s+'), lambda x: x <> '') as c from search_index),
stats as (select count(*) as n, avg(len(t)) as mt, avg(len(c)) as mc from docs)"""


def _bm25_sql(words, phrases=(), without=(), where="true", extra="0", limit=10):
    """BM25 of the words and the words of the phrases over two fields."""
    every = list(dict.fromkeys([*words, *[w for p in phrases for w in p.split()]]))
    tf = lambda a, w: f"len(list_filter({a}, lambda x: x = '{w}'))"
    has = lambda p: f"(contains(' ' || array_to_string(t, ' ') || ' ', ' {p} ') or contains(' ' || array_to_string(c, ' ') || ' ', ' {p} '))"
    df = ", ".join(f"greatest(count(*) filter ({tf('t', w)} > 0), count(*) filter ({tf('c', w)} > 0)) as d{i}" for i, w in enumerate(every))
    gain = lambda f, a, m: f"({f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * len({a}) / {m})))"
    one = lambda w: f"case when {tf('t', w)} > 0 or {tf('c', w)} > 0 then greatest(3 * {gain(tf('t', w), 't', 'mt')}, {gain(tf('c', w), 'c', 'mc')}) * ln(1 + (n - d{every.index(w)} + 0.5) / (d{every.index(w)} + 0.5)) else 0 end"
    score = " + ".join([*map(one, words), *[one(w) for p in phrases for w in p.split()], extra])
    need = X.minimum_should_match(len(words))
    match = " + ".join(f"({tf('t', w)} > 0 or {tf('c', w)} > 0)::int" for w in words) or "0"
    tests = [f"{match} >= {need}", *map(has, phrases), *[f"not {has(p)}" for p in without], where]
    return f"with {DOCS}, df as (select {df} from docs)\nselect url, title, round({score}, 6) as score from docs, stats, df where {' and '.join(tests)} order by score desc, url limit {limit}"


@query(_bm25_sql(["reliable", "sensor", "log"], limit=50))
def bm25_search(spark, d):
    return R.search(table(spark, d, "search_index"), "reliable sensor log", 50)


@query("select url, score from (" + _bm25_sql(["reliable", "sensor", "log"], limit=50) + ")")
def bm25_postings(spark, d):
    """The same from a stored inverted index, of which only the query's terms are read."""
    return Postings.build(table(spark, d, "search_index"), new_path(spark, "postings")).search("reliable sensor log", 50)


@query(_bm25_sql(["bakery", "order", "form", "garden", "planner", "visitor"], limit=50))
def bm25_many_words(spark, d):
    return R.search(table(spark, d, "search_index"), "Bakery order form garden planner visitor", 50)


@query(_bm25_sql(["useful"], ["sensor log"], limit=50))
def bm25_phrase(spark, d):
    return R.search(table(spark, d, "search_index"), 'useful "sensor log"', 50)


@query(_bm25_sql(["browser"], (), ["hidden", "sensor log"], limit=50))
def bm25_excluded(spark, d):
    return R.search(table(spark, d, "search_index"), 'browser -hidden -"sensor log"', 50)


@query(_bm25_sql(["guide"], where="url like '%harbourlight%'", limit=50))
def bm25_site(spark, d):
    return R.search(table(spark, d, "search_index"), "guide site:harbourlight", 50)


@query(_bm25_sql(["garden", "planner"], extra="(case when host in ('daily.harbourlight.example', 'www.daily.harbourlight.example') then 3 else 0 end) + (case when starts_with(path, '/docs') then 4 else 0 end) + (case when path = '/docs' then 5 else 0 end)", limit=50))
def bm25_boosted(spark, d):
    return R.search(table(spark, d, "search_index"), "garden planner", 50, hosts=("daily.harbourlight.example",), paths=("/docs",))


@query(f"with {DOCS}, p as (select 'title' as field, url, unnest(t) as term from docs union all select 'content', url, unnest(c) from docs) select field, term, count(distinct url) as documents, count(*) as occurrences from p group by all")
def term_statistics(spark, d):
    return R.term_statistics(table(spark, d, "search_index")).select("field", "term", "documents", "occurrences")


MANY = f"""{DOCS},
wanted as materialized (select distinct item_id as query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> ''))) as term from eval_items),
needs as (select query_id, count(*) as needed from wanted group by 1),
tt as (select url, unnest(t) as term, len(t) as n from docs), cc as (select url, unnest(c) as term, len(c) as n from docs),
ft as materialized (select term, url, count(*) as tf from tt where term in (select term from wanted) group by all), fc as materialized (select term, url, count(*) as tf from cc where term in (select term from wanted) group by all),
hits as (select coalesce(ft.term, fc.term) as term, coalesce(ft.url, fc.url) as url, coalesce(ft.tf, 0) as a, coalesce(fc.tf, 0) as b from ft full join fc on ft.term = fc.term and ft.url = fc.url),
df as (select term, greatest(count(*) filter (a > 0), count(*) filter (b > 0)) as df from hits group by term),
parts as materialized (select h.term, h.url, ln(1 + (n - df + 0.5) / (df + 0.5)) * greatest(3 * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len(t) / mt)), b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len(c) / mc))) as part from hits h join df using (term) join docs on docs.url = h.url, stats),
totals as (select w.query_id, p.url, round(sum(part), 6) as score, count(*) as m from parts p join wanted w using (term) group by all),
found as materialized (select query_id, url, score, row_number() over (partition by query_id order by score desc, url) as rank from totals join needs using (query_id)
  where m >= case when needed <= 2 then needed when needed <= 5 then needed * 60 // 100 else needed * 50 // 100 end qualify rank <= 10)"""


def _found(spark, d):
    queries = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query")
    return R.search_many(table(spark, d, "search_index"), queries, 10)


@query(f"with {MANY} select query_id, url, score, rank::integer as rank from found")
def bm25_batch(spark, d):
    return _found(spark, d)


JUDGED = f"""{MANY}, titles as (select distinct on (url) url, title from search_index),
shared as (select f.query_id, f.url, f.rank, len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')))) as s, coalesce(title, '') as title
  from found f join titles using (url) join (select distinct item_id, query from eval_items) on item_id = query_id),
judged as materialized (select query_id, url, rank, case when title = '' then -1 when s >= 4 then 3 when s = 3 then 2 when s = 2 then 1 else 0 end as relevance from shared)"""


def _judged(spark, d):
    """Hits of the evaluation queries, judged by how many words of the query their title holds; an empty title is a bad hit."""
    titles = table(spark, d, "search_index").groupBy("url").agg(F.first("title").alias("title"))
    queries = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query", "suite").distinct()
    shared = F.size(F.array_intersect(F.array_distinct(X.query_tokens(F.coalesce("title", F.lit("")))), F.array_distinct(X.query_tokens("query"))))
    grade = F.when(F.coalesce("title", F.lit("")) == "", -1).when(shared >= 4, 3).when(shared == 3, 2).when(shared == 2, 1).otherwise(0)
    hits = _found(spark, d).join(titles, "url").join(queries, "query_id")
    return E.relevance(hits, hits.select("query_id", "url", grade.alias("relevance")), ["query_id", "url"])


METRICS = f"""{JUDGED}, ordered as (select *, row_number() over (partition by query_id order by relevance desc, rank) as best from judged),
g as (select *, case when relevance > 0 then (pow(2, relevance) - 1) / log2(rank + 1) else 0 end as d, case when relevance > 0 then (pow(2, relevance) - 1) / log2(best + 1) else 0 end as i from ordered),
sums as (select query_id, max(case when rank <= 1 and relevance > 0 then 1.0::double else 0 end) as hit_at_1, max(case when rank <= 3 and relevance > 0 then 1.0::double else 0 end) as hit_at_3, max(case when rank <= 3 and relevance < 0 then 1.0::double else 0 end) as bad_at_3,
  min(case when relevance > 0 then rank end)::integer as first_rank, sum(case when rank <= 3 then d else 0 end) as d3, sum(case when best <= 3 then i else 0 end) as i3, sum(d) as d10, sum(i) as i10 from g group by query_id),
metrics as materialized (select query_id, hit_at_1, hit_at_3, bad_at_3, round(coalesce(1.0::double / first_rank, 0), 6) as mrr, round(case when i3 > 0 then d3 / i3 else 0 end, 6) as ndcg_at_3, round(case when i10 > 0 then d10 / i10 else 0 end, 6) as ndcg_at_10, first_rank from sums)"""


@query(f"with {METRICS} select * replace (coalesce(first_rank, 0)::integer as first_rank) from metrics")
def eval_metrics(spark, d):
    return E.query_metrics(_judged(spark, d)).withColumn("first_rank", F.coalesce("first_rank", F.lit(0)))


@query(f"with {METRICS} select case when grouping(suite) = 1 then 'all' else suite end as suite, count(*) as queries, round(avg(hit_at_1), 6) as hit_at_1, round(avg(hit_at_3), 6) as hit_at_3, round(avg(bad_at_3), 6) as bad_at_3, round(avg(mrr), 6) as mrr, round(avg(ndcg_at_3), 6) as ndcg_at_3, round(avg(ndcg_at_10), 6) as ndcg_at_10 from metrics join (select distinct item_id, suite from eval_items) on item_id = query_id group by rollup (suite)")
def eval_rollup(spark, d):
    suites = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "suite").distinct()
    return E.rollup(E.query_metrics(_judged(spark, d)).join(suites, "query_id"), "suite")


@query(f"with {METRICS} select suite, count(*) filter (first_rank is not null) as matched, count(*) filter (first_rank is null) as missed, count(*) as queries from metrics join (select distinct item_id, suite from eval_items) on item_id = query_id group by suite")
def eval_outcomes(spark, d):
    suites = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "suite").distinct()
    return E.outcomes(E.query_metrics(_judged(spark, d)).join(suites, "query_id"), "suite")


INTENT = ["guide", "browser"]


def _ranked(spark, d):
    ranks = table(spark, d, "search_index").groupBy("url").agg(F.first("title").alias("title"), F.max("page_rank").cast("double").alias("page_rank"), F.max("domain_rank").cast("double").alias("domain_rank"))
    return _found(spark, d).join(ranks, "url")


@query(
    f"""with {MANY}, ranks as (select url, any_value(title) as title, max(page_rank)::double as p, max(domain_rank)::double as r from search_index group by url),
s as (select query_id, url, rank, coalesce(p, 0) as p, coalesce(r, 0) as r, case when not ({HOST.format("url")} in ('daily.harbourlight.example', 'www.daily.harbourlight.example')) then 0 when starts_with(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/docs') then 2 else 1 end as m,
  (select count(*) from (select unnest(['guide', 'browser']) as w) where len(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda k: starts_with(k, w) or starts_with(w, k))) > 0) as tm,
  (select count(*) from (select unnest(['guide', 'browser']) as w) where len(list_filter(regexp_extract_all(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '[a-z0-9]+'), lambda k: starts_with(k, w) or starts_with(w, k))) > 0) as pm
  from found join ranks using (url))
select query_id, url, m as source_match, tm::integer as title_match, row_number() over (partition by query_id order by m desc, tm desc, pm desc, p desc, r desc, rank)::integer as new_rank from s"""
)
def reranked_hits(spark, d):
    hits = K.rerank(_ranked(spark, d), INTENT, ("daily.harbourlight.example",), ("/docs",), ["query_id"])
    return hits.select("query_id", "url", "source_match", "title_match", "new_rank")


@query(
    f"""with {MANY}, h as (select query_id, url, rank, array_to_string(string_split({HOST.format("url")}, '.')[-2:], '.') as domain from found),
c as (select * from h qualify row_number() over (partition by query_id, domain order by rank) <= 2)
select query_id, url, domain, row_number() over (partition by query_id order by rank)::integer as position from c qualify position <= 5"""
)
def diversified_hits(spark, d):
    return K.diversify(_found(spark, d), 5, 2, ["query_id"]).select("query_id", "url", "domain", "position")


@query(
    f"""with {MANY}, h as (select query_id, url, rank, row_number() over (partition by query_id, {HOST.format("url")} order by rank) as n from found)
select query_id, url, row_number() over (partition by query_id order by n > 1, rank)::integer as position from h"""
)
def domains_first(spark, d):
    return K.domains_first(_found(spark, d), ["query_id"]).select("query_id", "url", "position")


@query(f"with {MANY} select query_id, url, (10 + rank)::integer as position from found")
def second_page_impressions(spark, d):
    return K.impressions(_found(spark, d), 2, 10).select("query_id", "url", "position")


@query(None)
def search_snippets(spark, d):
    index = table(spark, d, "search_index")
    best = R.search(index, "reliable sensor log", 20)
    texts = index.groupBy("url").agg(F.first("content").alias("content"))
    return best.join(texts, "url").select("url", S.snippets("content", ["reliable", "sensor", "log"]).alias("s")).select("url", "s.text", "s.plain_text")


@query("select doc_id, url from documents where content is not null and doc_id not in (select vec_id from embeddings)")
def pending_embeddings(spark, d):
    done = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").where("content is not null").join(done, "doc_id", "left_anti").select("doc_id", "url")


@query("select doc_id, length(substr(replace(content, chr(10), ' '), 1, 30000)) as chars, sha256(substr(replace(content, chr(10), ' '), 1, 30000)) as sha from documents where content is not null")
def embedding_texts(spark, d):
    return table(spark, d, "documents").where("content is not null").select("doc_id", F.length(X.embedding_text("content")).cast("long").alias("chars"), F.sha2(X.embedding_text("content"), 256).alias("sha"))


@query(
    """with q as (select vec_id, embedding::double[] as e from embeddings where vec_id % 100 = 0), v as (select vec_id, embedding::double[] as e from embeddings),
s as (select q.vec_id as query_id, v.vec_id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)), 6) as similarity from q, v where q.vec_id <> v.vec_id)
select query_id, vec_id, similarity, row_number() over (partition by query_id order by similarity desc, vec_id)::integer as rank from s qualify rank <= 10"""
)
def cosine_nearest(spark, d):
    v = table(spark, d, "embeddings")
    return V.nearest(v, v.where("vec_id % 100 = 0"), 10)
