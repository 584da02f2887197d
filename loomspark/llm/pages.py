"""The pass over page texts that problems 1 to 5, 7 and 10 share, and its Spark operators.

Each operator reads the columns it needs, runs one `mapInArrow` over them, and lets
only small rows (ids, counts, line numbers) into shuffles; texts are never shuffled.
The models travel to the workers in a broadcast of fixed size: the labelled samples
(a table of fixed length, checked against SAMPLES), hashed weights and trees.

Nulls: a null title or content counts as empty; a row with a null id keeps its null id
in intermediate rows and is left out of the found rows.  Empty tables give empty
results.  Repeated rows give one row (results are distinct).  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.urls import normalize_for_admission
from ..session import cut, hash_sample, ship
from .bodies import Bodies
from .encodings import Encodings
from .langid import LanguageModel, code
from .lines import Line, Lines, Spam, observations
from .lookalikes import Lookalikes, letters, shapes_of

#: At most so many labelled samples are read to the driver; a longer table is refused.
SAMPLES = 20_000
#: At most so many pages, each of less than LENGTH characters, are read to the driver by `fit_pages`.
SAMPLE, LENGTH = 1_500, 20_000
#: Confidence at which a line of running text (a sentence, or two words and more) is in another language than its page.
SURE = 0.9
#: Rows that a worker handles at a time.
CHUNK = 256

_built: dict[str, "Analyzer"] = {}


class Analyzer:
    """All models of a pass; parts that a pass doesn't use are never built."""

    def __init__(self, samples: list[tuple[str, str]], bodies: Bodies | None = None, language: LanguageModel | None = None, counts: dict | None = None, shapes: dict | None = None):
        self.encodings, self.lookalikes, self.lines = Encodings(samples), Lookalikes(counts or letters(samples), shapes), Lines()
        self.bodies, self.language, self.spam = bodies, language, Spam()

    def field(self, text: str | None) -> tuple[str, bool, bool]:
        """(in normal form, garbled, look-alikes)."""
        if not text:
            return "", False, False
        if text.isascii():
            return text, self.encodings.text(text)[1], False
        restored, garbled = self.encodings.text(text)
        plain = self.lookalikes.rewrite(restored)
        return plain, garbled, plain is not restored and plain != restored

    def page(self, title: str | None, content: str | None) -> tuple[str, list[Line]]:
        t = self.field(title)[0]
        return t, [self.lines.line(x) for x in self.field(content)[0].split("\n")] if content else []

    def languages(self, titles: list[str], pages: list[list[Line]]) -> tuple[list[str], list[float], list[list[tuple[int, str, float]]]]:
        """For each page its main language, with confidence, and the lines of running text in another one."""
        texts, owner, line_no, words = [], [], [], []
        for i, (t, lines) in enumerate(zip(titles, pages)):
            mine = [(k + 1, x) for k, x in enumerate(lines) if x.text and not x.kind and x.symbol in (0, 1, 2, 3)]
            if t:
                mine.append((0, self.lines.line(t)))
            if not mine:
                mine = [(0, x) for x in lines if x.text]
            for k, x in mine:
                texts.append(x.text)
                owner.append(i)
                line_no.append(k)
                words.append(x.words + 0.01)
        scores = self.language.scores(texts)
        langs = self.language.langs
        total = np.zeros((len(pages), len(langs)))
        weight = np.zeros(len(pages))
        if len(texts):  # words make languages with few and with many letters alike
            np.add.at(total, np.array(owner), scores * np.array(words)[:, None])
            np.add.at(weight, np.array(owner), np.array(words))
        main = self.language.probabilities(total / np.maximum(weight, 1e-9)[:, None])
        names = [langs[k] if w > 0 else "" for k, w in zip(main.argmax(1), weight)]
        each = self.language.probabilities(scores) if len(texts) else scores
        other: list[list[tuple[int, str, float]]] = [[] for _ in pages]
        for j in range(len(texts)):
            i, k = owner[j], line_no[j]
            if k and (lang := langs[each[j].argmax()]) != names[i] and each[j].max() >= SURE and (x := pages[i][k - 1]).symbol in (0, 1, 3) and x.words >= 2:
                other[i].append((k, lang, float(each[j].max())))
        return names, [float(p) for p in main.max(1)], other


def samples_of(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    rows = spark.read.parquet(f"{folder}/lang_samples.parquet").select("lang", "text").where("lang is not null and text is not null").orderBy("sample_id").limit(SAMPLES + 1).collect()
    if len(rows) > SAMPLES:
        raise ValueError(f"more than {SAMPLES} labelled samples; take a part of them that holds every language")
    return [(r.lang, r.text) for r in rows]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            yield [c.to_pylist() for c in batch.slice(at, CHUNK).columns]


def over(df: DataFrame, analyzer_of, rows: Callable, schema: str) -> DataFrame:
    """mapInArrow with the analyzer that is built once per worker.  rows: (analyzer, columns of a chunk) to columns of the result."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast({**analyzer_of, "shapes": shapes_of(spark)})
    key = uuid.uuid4().hex
    target = pa.schema([(f.name, _arrow(f.dataType)) for f in spark.createDataFrame([], schema).schema])

    def run(batches):
        got = _built.get(key)
        if got is None:
            _built.clear()
            got = _built[key] = Analyzer(**shared.value)
        for columns in chunks(batches):
            out = rows(got, columns)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, target)], schema=target)

    return df.mapInArrow(run, schema)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def link_counts(links: DataFrame) -> DataFrame:
    """(url, outgoing): distinct pages of other hosts that a page links to; repeated rows count once, and so do
    links that differ in fragment or tracking parameters only."""
    host = lambda c: F.substring_index(F.substring_index(c, "/", 3), "/", -1)
    # what a plain link would be normalized to is itself but for an empty path
    page = F.when(F.col("dst").rlike("[^a-z0-9:/.-]|:[^/]|[^:]//|:///|//[^/]*$"), F.coalesce(normalize_for_admission("dst"), "dst")).otherwise(F.col("dst"))
    return links.where("src is not null and dst like 'http%'").where(host(F.col("src")) != host(F.col("dst"))).groupBy(F.col("src").alias("link_src")).agg(F.size(F.collect_set(F.xxhash64(page))).alias("outgoing"))


def spam_column(share: float = 0.5, least: int = 6):
    """Flag by non-prose word share.  Outgoing links to other hosts speak for a list where the words are about even."""
    words = F.col("listed") + F.col("tagged")
    part = words / F.greatest(F.lit(1), words + F.col("prose"))
    return (words >= least) & ((part >= share) | ((part >= share - 0.1) & (F.coalesce(F.col("outgoing"), F.lit(0)) >= 10) & (F.col("listed") >= 10)))


def with_links(counted: DataFrame, links: DataFrame) -> DataFrame:
    return counted.join(link_counts(links), F.col("url") == F.col("link_src"), "left").drop("link_src")


def _documents(spark, folder, *columns) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(*columns)


_SEEN = "seen binary, words array<int>"


def _seen(a: Analyzer, title: str, lines: list[Line]) -> tuple[bytes, list[int]]:
    """What problem 1 needs of a page once its text is read: what its model sees, and the words of each line."""
    return bytes(observations(lines, a.lines.line(title) if title else None)), [x.words + x.links for x in lines]


def fit_spam(seen: DataFrame) -> Spam:
    """The model of problem 1, fitted on every page of a written table with _SEEN: each task adds up its pages, and only these sums reach the driver."""
    ship(seen.sparkSession)
    m = Spam()
    for _ in range(m.ROUNDS):

        def run(batches, m=m):
            parts = [m.expected(Counter(batch.column(0).to_pylist())) for batch in batches]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([sum(x).ravel() for x in zip(*parts)]).tolist()])], names=["n"])

        got = np.array([r.n for r in seen.select("seen").where("length(seen) > 0").mapInArrow(run, "n array<double>").collect()])
        if not len(got):
            break
        # exact sums: the order of tasks doesn't count
        emit, move, start = np.split(np.array([math.fsum(x) for x in got.T]), np.cumsum([m.p[0].size, m.p[1].size]))
        m.update(emit.reshape(m.p[0].shape), move.reshape(m.p[1].shape), start)
    return m


def decoded(seen: DataFrame, m: Spam) -> DataFrame:
    """The words by kind of line in place of _SEEN."""
    others = [c for c in seen.columns if c not in ("seen", "words")]
    schema = StructType([seen.schema[c] for c in others] + [StructField(c, IntegerType()) for c in ("prose", "listed", "tagged")])

    def run(batches):
        for batch in batches:
            counts = [m.sums(o, w)[:3] for o, w in zip(batch.column("seen").to_pylist(), batch.column("words").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array([n[k] for n in counts], pa.int32()) for k in range(3)], names=schema.names)

    return seen.mapInArrow(run, schema)


def spam_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 1: every document with its words by kind of line, its outgoing links and whether it is spam.

    What a template or a server left (problem 2) is no list of keywords.  Texts are read once; the model is
    fitted on what it sees of all pages, and decodes that."""

    def rows(a, c):
        got = [_seen(a, *a.page(t, x)) for t, x in zip(c[2], c[3])]
        return c[0], c[1], [g[0] for g in got], [g[1] for g in got]

    seen = cut(over(_documents(spark, folder, "doc_id", "url", "title", "content"), {"samples": samples_of(spark, folder)}, rows, f"doc_id long, url string, {_SEEN}"))
    return with_links(decoded(seen, fit_spam(seen)), spark.read.parquet(f"{folder}/links.parquet")).withColumn("spam", spam_column())


def p1_found(spark, folder):
    return spam_pages(spark, folder).where("spam and doc_id is not null").select("doc_id").distinct()


def residue(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 2: (doc_id) of the documents that hold what a template, an editor or a server left."""

    def rows(a, c):
        return ([i for i, t, x in zip(*c) if a.lines.residue_in(*a.page(t, x))],)

    return over(_documents(spark, folder, "doc_id", "title", "content"), {"samples": samples_of(spark, folder)}, rows, "doc_id long")


def p2_found(spark, folder):
    return residue(spark, folder).where("doc_id is not null").distinct()


def languages(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 3: (doc_id, url, label, lang, confidence, lines) with what problem 1 sees and problem 2 finds; lines holds those in another language."""
    samples = samples_of(spark, folder)
    schema = f"doc_id long, url string, {_SEEN}, residue boolean, label string, lang string, confidence double, lines array<struct<line_no:int, lang:string, confidence:double>>"

    def rows(a, c):
        pages = [a.page(t, x) for t, x in zip(c[2], c[3])]
        seen = [_seen(a, *p) for p in pages]
        lang, sure, other = a.languages([p[0] for p in pages], [p[1] for p in pages])
        return c[0], c[1], [s[0] for s in seen], [s[1] for s in seen], [a.lines.residue_in(*p) for p in pages], [code(x) for x in c[4]], lang, sure, [[{"line_no": k, "lang": g, "confidence": p} for k, g, p in o] for o in other]

    return over(_documents(spark, folder, "doc_id", "url", "title", "content", "lang"), {"samples": samples, "language": LanguageModel(samples)}, rows, schema)


def sound(df: DataFrame, spark, folder) -> DataFrame:
    """Without the documents of problems 1 and 2."""
    return with_links(df, spark.read.parquet(f"{folder}/links.parquet")).where(~spam_column() & ~F.col("residue"))


def p3_found(spark, folder):
    seen = cut(languages(spark, folder))
    found = seen.where("doc_id is not null and lang <> '' and (label <> lang or size(lines) > 0)")
    each = sound(decoded(found, fit_spam(seen)), spark, folder).select("doc_id", F.explode(F.concat(F.when(F.col("label") != F.col("lang"), F.array(F.struct(F.lit(0).alias("line_no"), F.col("lang").alias("lang")))).otherwise(F.expr("array()")), F.transform("lines", lambda x: F.struct(x["line_no"].alias("line_no"), x["lang"].alias("lang"))))).alias("x"))
    return each.select("doc_id", "x.line_no", "x.lang").distinct()


def garbled(spark: SparkSession, folder: str, restored: bool = True) -> DataFrame:
    """Problem 4: (doc_id, field_name, restored) of every damaged field; restored holds the replacement character where text is lost."""

    def rows(a, c):
        out = []
        for i, t, x in zip(*c):
            for name, text in (("title", t), ("content", x)):
                new, hit = a.encodings.text(text)
                if hit:
                    out.append((i, name, new if restored else None))
        return [list(x) for x in zip(*out)] if out else [[], [], []]

    return over(_documents(spark, folder, "doc_id", "title", "content"), {"samples": samples_of(spark, folder)}, rows, "doc_id long, field_name string, restored string")


def p4_found(spark, folder):
    return garbled(spark, folder, False).where("doc_id is not null").select("doc_id", "field_name").distinct()


def character_counts(df: DataFrame, *columns: str) -> dict[str, int]:
    """Occurrences of each code point over all rows: partial counts per task, then one sum.  Bounded by the number of code points."""

    def run(batches):
        n = np.zeros(0x110000, dtype=np.int64)
        for columns in chunks(batches):
            for c in columns:
                text = "".join(filter(None, c)).encode("utf-32-le", "surrogatepass")
                got = np.bincount(np.frombuffer(text, dtype=np.uint32))
                n[: len(got)] += got
        items = [(chr(k), int(n[k])) for k in np.flatnonzero(n) if not 0xD800 <= k < 0xE000]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in items], pa.string()), pa.array([v for _, v in items], pa.int64())], names=["c", "n"])

    got = df.select(*columns).mapInArrow(run, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return {r.c: r.n for r in got}


def lookalike_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Problem 5: (table_name, row_key, field_name) of every field that its one form changes.

    Garbled fields are left out, and so are the terms of a page whose newest version (the
    highest doc_id) has a garbled title."""
    samples = samples_of(spark, folder)
    docs = _documents(spark, folder, "doc_id", "url", "title", "content")
    index = spark.read.parquet(f"{folder}/search_index.parquet").select("url", "title_terms").where("url is not null")
    parts = {"samples": samples, "counts": character_counts(docs, "title", "content")}

    def in_documents(a, c):
        out = []
        for i, u, t, x in zip(*c):
            a_t, a_x = a.field(t), a.field(x)
            out.append((i, u, a_t[1], [n for n, f in (("title", a_t), ("content", a_x)) if f[2] and not f[1]]))
        return [list(x) for x in zip(*out)] if out else [[], [], [], []]

    def in_terms(a, c):
        return ([u for u, t in zip(*c) if t and a.lookalikes.rewrite(t) != t],)

    done = cut(over(docs, parts, in_documents, "doc_id long, url string, bad_title boolean, fields array<string>"))
    bad = done.where("doc_id is not null and url is not null").groupBy("url").agg(F.max_by("bad_title", "doc_id").alias("bad")).where("bad").select("url")
    terms = over(index, parts, in_terms, "url string").distinct().join(bad, "url", "left_anti")
    return (
        done.where("doc_id is not null and size(fields) > 0")
        .select(F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("row_key"), F.explode("fields").alias("field_name"))
        .unionByName(terms.select(F.lit("search_index").alias("table_name"), F.col("url").alias("row_key"), F.lit("title_terms").alias("field_name")))
    )


def p5_found(spark, folder):
    return lookalike_fields(spark, folder).distinct()


def fit_pages(spark: SparkSession, folder: str, samples: list[tuple[str, str]], limit: int = SAMPLE, length: int = LENGTH) -> dict:
    """Problem 7's trees, fitted on at most `limit` pages of less than `length` characters whose hashes lie in one range.

    Training leaves out what looks like spam by a model of these pages; which documents problems 7 and 10 leave out is decided by `fit_spam`."""
    docs = _documents(spark, folder, "doc_id", "source", "title", "content").where(F.col("content").isNotNull() & (F.length("content") < length))
    a = Analyzer(samples, shapes=shapes_of(spark))
    read = [(r.source, *a.page(r.title, r.content)) for r in hash_sample(docs, "doc_id", limit)]
    seen = [_seen(a, t, lines) for _, t, lines in read]
    a.spam.fit([o for o, _ in seen])
    kept = [(host, lines) for (host, t, lines), s in zip(read, seen) if not a.lines.residue_in(t, lines) and sum((n := a.spam.sums(*s))[1:3]) <= n[0]]
    return {"samples": samples, "bodies": Bodies([p for _, p in kept], [h for h, _ in kept])}


def outside(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Problem 7: for documents and for parse_results, (doc_id, ..., other): the numbers of the lines that aren't body."""
    samples = samples_of(spark, folder)
    parts = fit_pages(spark, folder, samples)

    def rows(a, c):
        pages = [a.page(t, x) for t, x in zip(c[2], c[3])]
        seen = [_seen(a, *p) for p in pages]
        labels = a.bodies.label([p[1] for p in pages])
        return c[0], c[1], [s[0] for s in seen], [s[1] for s in seen], [a.lines.residue_in(*p) for p in pages], [[k + 1 for k, (b, x) in enumerate(zip(label, p[1])) if not b and x.text] for label, p in zip(labels, pages)]

    def parsed(a, c):
        labels = a.bodies.label(pages := [a.page(None, x)[1] for x in c[1]])
        return c[0], [[k + 1 for k, (b, x) in enumerate(zip(label, p)) if not b and x.text] for label, p in zip(labels, pages)]

    pages = spark.read.parquet(f"{folder}/parse_results.parquet").select("page_id", "content")
    return (
        over(_documents(spark, folder, "doc_id", "url", "title", "content"), parts, rows, f"doc_id long, url string, {_SEEN}, residue boolean, other array<int>"),
        over(pages, parts, parsed, "page_id long, other array<int>"),
    )


def p7_found(spark, folder):
    docs, parsed = outside(spark, folder)
    seen = cut(docs)
    docs = sound(decoded(seen.where("size(other) > 0"), fit_spam(seen)), spark, folder).select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("row_id"), F.explode("other").alias("line_no"))
    parsed = parsed.select(F.lit("parse_results").alias("table_name"), F.col("page_id").alias("row_id"), F.explode("other").alias("line_no"))
    return docs.unionByName(parsed).where("row_id is not null").distinct()
