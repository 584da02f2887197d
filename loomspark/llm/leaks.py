"""Problem 9: evaluation passages in corpus documents.

A prefix-filtered set join: the shingles (five words; in Japanese ten characters, about as
long) of each item are ordered by how rare they are in the whole corpus; a document is a candidate
of an item only if it holds one of the item's rarest shingles, as many as any document with the
necessary overlap must hold one of (prefix), has words enough (length bound), and one of these shingles stands
where enough of the item can lie before and behind it (positional bound).  No bound loses a pair.
Only candidates are counted and verified, exactly: the longest chain of
matching runs that keep the item's order within an item-sized window has to cover half of the
item's words; a few changed words between two runs on one diagonal count as matched, and words that
are replaced by others between two runs count half against the chain, so that stock phrases which
stand in a look-alike with other words between them don't add up.  Words that only the text or only
the item has between two runs cost nothing.

The items go to the workers in blocks of about ITEMS, whose size is bounded by it; a longer table takes
more passes over the documents, which are never shuffled.  Nulls and empty texts or passages match
nothing; an item shorter than a shingle is compared as one run of its words.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .lookalikes import Lookalikes, shapes_of

#: Items of a block.
ITEMS = 5_000
WORDS, CHARACTERS = 5, 10
#: Part of an item's words that must stand together.
CONTAINED = 0.5
#: Changed words between two runs that still count.
CHANGED = 3
#: What a word replaced between two runs of a chain costs, in words.
REPLACED = 0.5
_TOKEN = re.compile(r"[぀-ヿ一-鿿々〆]|[^\W_぀-ヿ一-鿿々〆]+")
_MIX = np.int64(1_000_003)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Items:
    """items: (item_id, passage) in normal form."""

    def __init__(self, items: list[tuple[int, str]], contained: float = CONTAINED):
        self.contained = contained
        self.ids, self.words, self.size, self.vocabulary = [], [], [], {}
        for i, text in items:
            w = tokens(text)
            if w:
                self.ids.append(i)
                self.words.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], dtype=np.int64))
                self.size.append(min(len(w), CHARACTERS if sum(len(x) == 1 and x >= "぀" for x in w) > len(w) // 2 else WORDS))
        hashes = [self.hashes(w, k) for w, k in zip(self.words, self.size)]
        self.keys = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, dtype=np.int64)
        self.shingles = [np.searchsorted(self.keys, h) for h in hashes]
        self.rank(np.zeros(len(self.keys), dtype=np.int64))

    @staticmethod
    def hashes(w: np.ndarray, k: int) -> np.ndarray:
        h = np.zeros(len(w) - k + 1, dtype=np.int64)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = h * _MIX + w[j : len(w) - k + 1 + j] * np.int64(0x9E3779B97F4A7C1 % (1 << 60)) + np.int64(j + k * 31)
        return h

    def least(self, i: int) -> int:
        """How many distinct shingles a chain that covers `contained` of the item holds at least.

        In a run each shingle stands for its own words and CHANGED others; a shingle that the item repeats counts in all its places."""
        rest = self.contained * len(self.words[i]) / (self.size[i] + CHANGED)
        for need, n in enumerate(np.sort(np.unique(self.shingles[i], return_counts=True)[1])[::-1].tolist(), 1):
            rest -= n
            if rest <= 1e-9:
                return need
        return 1

    def rank(self, counts: np.ndarray) -> None:
        """Sets the prefixes: for each shingle the items it is a necessary one of."""
        self.prefix, self.need = defaultdict(set), []
        for i, s in enumerate(self.shingles):
            own = np.unique(s)
            need = self.least(i)
            order = sorted(own.tolist(), key=lambda x: (counts[x], x))
            for x in order[: len(own) - need + 1]:
                self.prefix[x].add(i)
            self.need.append(need)

    def match(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, text, place and shingle of every shingle of an item in them)."""
        get = self.vocabulary.get
        words = [np.array([get(x, 0) for x in tokens(t)], dtype=np.int64) for t in texts]
        if not len(self.keys):
            z = np.zeros(0, dtype=np.int64)
            return words, z, z, z
        gap = np.zeros(CHARACTERS, dtype=np.int64)
        flat = np.concatenate([x for w in words for x in (w, gap)] or [gap])
        starts = np.cumsum([0] + [len(w) + CHARACTERS for w in words])[:-1]
        found_at, found_key = [], []
        for k in sorted(set(self.size)):
            if len(flat) < k:
                continue
            with np.errstate(over="ignore"):
                h = np.zeros(len(flat) - k + 1, dtype=np.int64)
                whole = np.ones(len(h), dtype=bool)
                for j in range(k):
                    part = flat[j : len(h) + j]
                    h = h * _MIX + part * np.int64(0x9E3779B97F4A7C1 % (1 << 60)) + np.int64(j + k * 31)
                    whole &= part > 0
            where = np.flatnonzero(whole)
            spot = np.searchsorted(self.keys, h[where])
            spot[spot == len(self.keys)] = 0
            hit = self.keys[spot] == h[where]
            found_at.append(where[hit])
            found_key.append(spot[hit])
        at, key = np.concatenate(found_at), np.concatenate(found_key)
        order = np.argsort(at, kind="stable")
        at, key = at[order], key[order]
        text = np.searchsorted(starts, at, side="right") - 1
        return words, text, at - starts[text], key

    def covered(self, item: int, pairs: list[tuple[int, int]]) -> float:
        """Largest part of the item's words that a chain of matches within an item-sized window covers, less what is replaced in it.

        pairs: (place in the text, place in the item) of matching shingles."""
        n = len(self.words[item])
        k = self.size[item]
        # runs: maximal diagonals, joined over a few changed words
        by: dict[int, list[int]] = defaultdict(list)
        for t, p in set(pairs):
            by[t - p].append(p)
        runs = []  # (text start, item start, length)
        for d, ps in by.items():
            ps.sort()
            start = end = ps[0]
            for p in ps[1:] + [10**9]:
                if p - (end + k - 1) <= CHANGED + 1:
                    end = p
                else:
                    runs.append((start + d, start, end - start + k))
                    start = end = p
        runs.sort()
        slack = n // 2 + 40
        best, score, first = 0.0, [], []
        for i, (t, p, length) in enumerate(runs):
            top, begun = length, t
            for j in range(i - 1, -1, -1):
                u, q, size = runs[j]
                if t - u > n + slack:
                    break  # no earlier run lies in one window with this one
                if q + size - 1 < p + length - 1 and q < p and u < t and t - (u + size) <= slack and t + length - first[j] <= n + slack:
                    over = max(0, q + size - p, u + size - t)
                    gain = length - over - REPLACED * max(0, min(p - q, t - u) - size)
                    if over < length and score[j] + gain > top:
                        top, begun = score[j] + gain, first[j]
            score.append(top)
            first.append(begun)
            best = max(best, top)
        return min(best, n) / n

    def candidates(self, keys: list[int], places: list[int], size: int) -> set[int]:
        """Items of which a text of `size` words can hold `contained`, by prefix, length and position.

        keys, places: the shingles of items in the text, and where they stand."""
        out: set[int] = set()
        for x, t in zip(keys, places):
            for i in self.prefix.get(x, ()):
                if i in out:
                    continue
                n, k = len(self.words[i]), self.size[i]
                least = self.contained * n - 1e-9
                if size < least:
                    continue
                for p in np.flatnonzero(self.shingles[i] == x).tolist():
                    if min(p, t) + k + min(n - p - k, size - t - k) >= least:
                        out.add(i)
                        break
        return out

    def leaks(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """For each text the (index of item, covered part) of its candidates that share enough shingles."""
        words, text, at, key = self.match(texts)
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        for t in range(len(texts)):
            a, b = bounds[t], bounds[t + 1]
            if a == b:
                continue
            keys, places = key[a:b].tolist(), at[a:b].tolist()
            held = set(keys)
            for i in sorted(self.candidates(keys, places, len(words[t]))):
                own: dict[int, list[int]] = defaultdict(list)
                for p, x in enumerate(self.shingles[i].tolist()):
                    if x in held:
                        own[x].append(p)
                if len(own) >= self.need[i]:
                    out[t].append((i, self.covered(i, [(place, p) for x, place in zip(keys, places) for p in own.get(x, ())])))
        return out


_made: dict[str, tuple] = {}


def _tools(key: str, shared):
    if key not in _made:
        _made.clear()
        items, shapes = shared.value
        _made[key] = (items, Lookalikes(None, shapes))
    return _made[key]


def items_of(spark: SparkSession, folder: str) -> list[list[tuple[int, str]]]:
    """The evaluation items in normal form, in blocks of about ITEMS."""
    rows = spark.read.parquet(f"{folder}/eval_items.parquet").where("item_id is not null and passage is not null").select("item_id", "passage").distinct()
    blocks = -(-rows.count() // ITEMS)
    plain = Lookalikes(None, shapes_of(spark))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "passage"), F.lit(max(1, blocks))))
    return [[(r.item_id, plain.rewrite(r.passage)) for r in rows.where(F.col("block") == b).orderBy("item_id", "passage").collect()] for b in range(blocks)]


def shingle_counts(texts: DataFrame, items: Items) -> np.ndarray:
    """In how many places of the corpus each shingle of the items stands: one sparse row per task, then one sum."""
    spark = texts.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((items, shapes_of(spark)))
    key = uuid.uuid4().hex

    def run(batches):
        got, plain = _tools(key, shared)
        n = np.zeros(len(got.keys), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = [plain.rewrite(x) or "" for x in batch.column(0).slice(at, 256).to_pylist()]
                n += np.bincount(got.match(part)[3], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], names=["shingle", "n"])

    out = np.zeros(len(items.keys), dtype=np.int64)
    for r in texts.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect():
        out[r.shingle] = r.n
    return out


def leaked(spark: SparkSession, folder: str, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, covered): each document with each item of which at least `contained` stands in it."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").where("text is not null")
    schema = "doc_id long, item_id long, covered double"
    out = None
    for block in items_of(spark, folder):
        part = _leaked(docs, Items(block, contained)) if block else None
        out = part if out is None else out.unionByName(part) if part else out
    return spark.createDataFrame([], schema) if out is None else out


def _leaked(docs: DataFrame, items: Items) -> DataFrame:
    spark = docs.sparkSession
    items.rank(shingle_counts(docs.select("text"), items))
    shared = spark.sparkContext.broadcast((items, shapes_of(spark)))
    key = uuid.uuid4().hex

    def run(batches):
        got, plain = _tools(key, shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                rows = [(i, got.ids[k], v) for i, leaks in zip(ids, got.leaks([plain.rewrite(x) for x in texts])) for k, v in leaks if v >= got.contained]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "covered"])

    return docs.mapInArrow(run, "doc_id long, item_id long, covered double")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(spark, folder).where("doc_id is not null").select("doc_id", "item_id").distinct()
