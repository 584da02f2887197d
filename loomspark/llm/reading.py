"""Problem 10: the reading level of English pages.

A linear ranker is learned from pairs of graded documents (logistic loss on differences
of standardised features of syntax and vocabulary of the body); isotonic regression turns its scores
into levels.  Grades are the means over distinct (rater, band) rows per document, so
that repeated rows don't count twice; null grades don't count.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, hash_sample
from .langid import LanguageModel
from .lines import FUNCTION, Line
from .pages import _SEEN, _documents, _seen, decoded, fit_pages, fit_spam, over, samples_of, sound
from .trees import isotonic

#: At most so many graded documents are used to fit the ranker, and so many pairs of them.
GRADED, PAIRS = 4_000, 40_000
LEAST_WORDS = 60
_WORD = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’-][A-Za-z]+)*")
_SENTENCE = re.compile(r"[.!?]+(?:\s|$)")
# Words that subordinate or connect clauses.
CLAUSES = {"although", "whereas", "insofar", "which", "notwithstanding", "because", "when", "whether", "while", "unless", "that", "consequently", "nevertheless", "irrespective", "but", "only", "not", "if", "since"}
FEATURES = 10


def features(lines: list[Line], body: list[bool]) -> list[float]:
    """Length of sentences and words, long words, clauses, commas, variety; all are means, so that long pages are like short ones."""
    words: list[str] = []
    sentences = commas = 0
    for x, b in zip(lines, body):
        if b and x.symbol in (0, 1, 3):
            w = _WORD.findall(x.text)
            words += w
            sentences += max(1, len(_SENTENCE.findall(x.text)))
            commas += x.text.count(",") + x.text.count(";")
    if not words:
        for x in lines:
            words += _WORD.findall(x.text)
        sentences = max(1, len(lines))
    n = max(1, len(words))
    sizes = [len(w) for w in words]
    low = [w.lower() for w in words]
    content = [w for w in low if w not in FUNCTION]
    c = max(1, len(content))
    return [
        n / max(1, sentences), float(np.log1p(n / max(1, sentences))), sum(sizes) / n, sum(s >= 7 for s in sizes) / n, sum(s >= 11 for s in sizes) / n,
        sum(w in CLAUSES for w in low) / n, commas / max(1, sentences), len(content) / n, sum(map(len, content)) / c, sum(s <= 4 for s in sizes) / n,
    ]


class Ranker:
    def __init__(self, x: np.ndarray, grade: np.ndarray, steps: int = 300, rate: float = 0.5, penalty: float = 1e-3):
        self.mean, self.scale = x.mean(0) if len(x) else np.zeros(FEATURES), x.std(0) + 1e-9 if len(x) else np.ones(FEATURES)
        z = (x - self.mean) / self.scale
        rng = np.random.default_rng(11)
        i, j = rng.integers(0, max(1, len(z)), PAIRS), rng.integers(0, max(1, len(z)), PAIRS)
        self.weights = np.zeros(FEATURES)
        self.ends, self.levels = np.array([0.0]), np.array([2.0])
        if len(z) < 2:
            return
        ok = grade[i] > grade[j]
        d, gap = z[i[ok]] - z[j[ok]], (grade[i] - grade[j])[ok]
        for _ in range(steps if len(d) else 0):
            p = 1 / (1 + np.exp(np.clip(d @ self.weights, -30, 30)))
            self.weights += rate * ((d * (p * gap)[:, None]).mean(0) - penalty * self.weights)
        self.ends, self.levels = isotonic(self.score(x), grade)

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((np.asarray(x) - self.mean) / self.scale) @ self.weights

    def level(self, score: np.ndarray) -> np.ndarray:
        return self.levels[np.minimum(np.searchsorted(self.ends, score, side="left"), len(self.levels) - 1)]


def grades(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, grade): the mean of the distinct grades of a document."""
    return spark.read.parquet(f"{folder}/reading_labels.parquet").where("doc_id is not null and band is not null").select("doc_id", "rater", "band").distinct().groupBy("doc_id").agg(F.avg("band").alias("grade"))


def _body(a, columns):
    pages = [a.page(t, x) for t, x in zip(*columns)]
    return pages, a.bodies.label([p[1] for p in pages])


def fit(spark: SparkSession, folder: str, parts: dict) -> Ranker:
    graded = {r.doc_id: r.grade for r in hash_sample(grades(spark, folder), "doc_id", GRADED)}
    ids = spark.createDataFrame([(int(k),) for k in graded], "doc_id long")
    mine = _documents(spark, folder, "doc_id", "title", "content").join(F.broadcast(ids), "doc_id", "left_semi")

    def rows(a, c):
        pages, labels = _body(a, c[1:])
        return c[0], [features(p[1], b) for p, b in zip(pages, labels)]

    got = [r for r in over(mine, {k: v for k, v in parts.items() if k != "language"}, rows, "doc_id long, x array<double>").collect() if r.doc_id in graded]
    got.sort(key=lambda r: r.doc_id)
    return Ranker(np.array([r.x for r in got]).reshape(-1, FEATURES), np.array([graded[r.doc_id] for r in got]))


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, url, what problem 1 sees, residue, score, level) of all documents; score and level only where the language is English and the content has at least 60 words."""
    samples = samples_of(spark, folder)
    parts = {**fit_pages(spark, folder, samples), "language": LanguageModel(samples)}
    ranker = fit(spark, folder, parts)

    def rows(a, c):
        every = [a.page(t, x) for t, x in zip(c[2], c[3])]
        seen = [_seen(a, *p) for p in every]
        keep = [i for i, x in enumerate(c[3]) if x and len([w for w in x.replace("\n", " ").split(" ") if w]) >= LEAST_WORDS]
        lang, _, other = a.languages([every[i][0] for i in keep], [every[i][1] for i in keep])
        other = [o for o, g in zip(other, lang) if g == "en"]
        keep = [i for i, g in zip(keep, lang) if g == "en"]
        pages = [every[i] for i in keep]
        labels = a.bodies.label([p[1] for p in pages])
        for lines, body in zip(other, labels):  # the English body is graded
            for k, _, _ in lines:
                body[k - 1] = False
        found = ranker.score(np.array([features(p[1], b) for p, b in zip(pages, labels)]).reshape(-1, FEATURES))
        residue, score, level = ([None] * len(every) for _ in range(3))
        for i, p, x, y in zip(keep, pages, found.tolist(), ranker.level(found).tolist()):
            residue[i], score[i], level[i] = a.lines.residue_in(*p), x, y
        return c[0], c[1], [s[0] for s in seen], [s[1] for s in seen], residue, score, level

    return over(_documents(spark, folder, "doc_id", "url", "title", "content"), parts, rows, f"doc_id long, url string, {_SEEN}, residue boolean, score double, level double")


def levels(spark: SparkSession, folder: str) -> DataFrame:
    """Those of `judged` that have a level."""
    return judged(spark, folder).where("level is not null")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    seen = cut(judged(spark, folder))
    found = sound(decoded(seen.where("doc_id is not null and level is not null"), fit_spam(seen)), spark, folder)
    return found.select("doc_id", F.greatest(F.lit(1), F.least(F.lit(3), F.round("level").cast("int"))).alias("band")).distinct()
