"""Queries of the training-data operators.  Only repeated lines have an SQL form; tests/llm holds the others against brute force, round trips or held-out labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import leaks, packing, pages, reading, repeats


def p1_kinds(spark, sf_dir):
    """Words of each document by kind of line, with the flag."""
    return pages.spam_pages(spark, sf_dir).select("doc_id", "prose", "listed", "tagged", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), "spam")


def p3_languages(spark, sf_dir):
    """Main language of each document with its confidence, and the number of lines in another one."""
    return pages.languages(spark, sf_dir).select("doc_id", "label", "lang", F.round("confidence", 4).alias("confidence"), F.size("lines").alias("other_lines"))


def p4_restored(spark, sf_dir):
    """Damaged fields with their restored text."""
    return pages.garbled(spark, sf_dir)


def p6_clean(spark, sf_dir):
    """Pages of the search index without the lines that their host repeats."""
    return repeats.cleaned(spark.read.parquet(f"{sf_dir}/search_index.parquet")).select("url", F.length("content").alias("chars"), F.length("clean").alias("clean_chars"), F.sha2("clean", 256).alias("clean_sha"))


def p9_covered(spark, sf_dir):
    """Leaked items with the part of the passage that stands in the document."""
    return leaks.leaked(spark, sf_dir).select("doc_id", "item_id", F.round("covered", 4).alias("covered"))


def p10_levels(spark, sf_dir):
    """Calibrated reading level of each English page of enough words."""
    return reading.levels(spark, sf_dir).select("doc_id", F.round("level", 4).alias("level"))


def queries():
    return {
        "p1_found": pages.p1_found, "p1_kinds": p1_kinds,
        "p2_found": pages.p2_found,
        "p3_found": pages.p3_found, "p3_languages": p3_languages,
        "p4_found": pages.p4_found, "p4_restored": p4_restored,
        "p5_found": pages.p5_found,
        "p6_found": repeats.p6_found, "p6_clean": p6_clean,
        "p7_found": pages.p7_found,
        "p8_pack": packing.p8_pack, "p8_use": packing.p8_use,
        "p9_found": leaks.p9_found, "p9_covered": p9_covered,
        "p10_found": reading.p10_found, "p10_levels": p10_levels,
    }


def oracle_sql():
    return {"p6_found": P6_SQL, "p6_clean": P6_CLEAN}


# The exact definition of problem 6 in SQL.
P6_SQL = r"""
with pages as (select distinct url, host, content from search_index where host is not null and url is not null),
lines as (
    select host, url, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line_no, unnest(string_split(content, chr(10))) as line from pages where content is not null and content <> ''
),
keyed as (
    select host, url, line_no, regexp_replace(trim(regexp_replace(lower(line), '[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '\p{Nd}+', '0', 'g') as k from lines
),
kept as (select * from keyed where k <> ''),
counts as (select host, k, count(distinct url) as n from kept group by host, k),
hosts as (select host, count(distinct url) as urls from pages group by host)
select distinct kept.url, cast(kept.line_no as integer) as line_no
from kept join counts using (host, k) join hosts using (host)
where n >= 3 and n >= 0.05 * urls
"""

# The contents without these lines.
P6_CLEAN = f"""with f as ({P6_SQL.strip()}), gone as (select url, list(line_no) as no from f group by url), p as (select distinct host, url, content from search_index),
c as (select p.url, content, array_to_string(list_filter(string_split(content, chr(10)), lambda x, i: not list_contains(coalesce(no, []), i)), chr(10)) as clean from p left join gone using (url))
select url, length(content) as chars, length(clean) as clean_chars, sha256(clean) as clean_sha from c"""
