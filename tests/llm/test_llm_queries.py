"""The queries over small tables made by hand: nulls, empty and long texts, repeats, empty tables, further columns; and brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import leaks, packing, pages, queries, repeats
from loomspark.llm.lines import Spam, observations
from loomspark.llm.pages import link_counts

DOCS = "doc_id long, url string, title string, content string, text string, lang string, source string, n_chars long, indexed_at timestamp_ntz"
EMPTY = {
    "documents": DOCS, "links": "src string, dst string",
    "search_index": "url string, host string, path string, title string, content string, title_terms string, content_terms string, page_rank float, domain_rank float",
    "parse_results": "page_id long, url string, title string, content string, outlinks array<string>, feed_links array<string>, parsed_at timestamp_ntz",
    "eval_items": "item_id long, suite string, lang string, query string, passage string, answer string", "lang_samples": "sample_id long, lang string, text string",
    "pack_limits": "limit_name string, capacity_tokens int", "reading_labels": "doc_id long, rater string, band int",
}
NAMES = sorted(queries.queries())


def write(spark, folder, tables, extra=False):
    for name, schema in EMPTY.items():
        df = spark.createDataFrame(tables.get(name, []), schema)
        if extra:
            for c in ("spam", "n", "key", "lines", "size", "rank", "count"):
                df = df.withColumn(c, F.lit("x"))
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def samples(spark, data):
    return [tuple(r) for r in spark.read.parquet(f"{data}/lang_samples.parquet").collect()]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tmp_path, name):
    assert queries.queries()[name](spark, write(spark, tmp_path, {})).count() in (0, 2)


def dirty(samples):
    prose = "The library opens at nine and closes at six. Readers may borrow ten books at a time. " * 6
    rows = [
        (1, "https://a.example/1", None, None, None, None, "a.example", 0, None), (2, "https://a.example/2", "", "", "", "", "a.example", 0, None),
        (3, "https://a.example/3", "A title", prose, "A title\n\n" + prose, "en", "a.example", 9, None), (3, "https://a.example/3", "A title", prose, "A title\n\n" + prose, "en", "a.example", 9, None),
        (4, None, "cafÃ©", "Der GÃ¤rtner Ã¶ffnet.", "cafÃ©\n\nDer GÃ¤rtner Ã¶ffnet.", "de", None, 9, None), (None, "https://a.example/5", "x", prose, prose, "en", "a.example", 9, None),
        (6, "https://a.example/6", "Ｗide", "word " * 200_000, "word " * 200_000, "fr", "a.example", 9, None), (7, "https://a.example/7", "{{ title }}", "\n\n\n", "{{ title }}", "en", "a.example", 9, None),
        (8, "https://a.example/8", "t", "buy cheap shoes best shoes sale shoes " * 30, "t", "en", "a.example", 9, None),
    ]
    index = [("https://a.example/3", "a.example", "/3", "A title", prose, "a tit​le", "x", None, None), (None, None, None, None, None, None, None, None, None), ("https://a.example/2", "a.example", "/2", None, None, None, None, None, None)]
    return {
        "documents": rows, "search_index": index, "lang_samples": samples, "links": [("https://a.example/3", None), (None, "https://b.example/"), ("https://a.example/3", "https://b.example/"), ("https://a.example/3", "https://b.example/")],
        "parse_results": [(1, None, None, None, None, [], None), (None, "u", "t", prose, None, [], None), (2, "u", "t", "Skip to content\n" + prose, [], [], None)],
        "eval_items": [(1, "s", "en", "q", prose[:80], "a"), (2, "s", "en", None, None, None), (3, "s", "en", "q", "", "a")], "pack_limits": [("small", 16), ("none", None), ("zero", 0)],
        "reading_labels": [(3, "a", 1), (3, "a", 1), (3, "b", None), (None, "a", 2), (99, "a", 3)],
    }


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, samples):
    return write(spark, tmp_path_factory.mktemp("dirty"), dirty(samples), True)


@pytest.mark.parametrize("name", NAMES)
def test_dirty_tables(spark, folder, name):
    got = queries.queries()[name](spark, folder)
    rows = [tuple(r) for r in got.collect()]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows)) and not any(None in r for r in rows)


def found(spark, folder, name):
    return {tuple(r) for r in queries.queries()[name](spark, folder).collect()}


def test_found(spark, folder):
    assert found(spark, folder, "p1_found") == {(6,), (8,)}  # one word over and over is a keyword too
    assert found(spark, folder, "p2_found") == {(7,)}
    assert found(spark, folder, "p4_found") == {(4, "title"), (4, "content")}
    assert found(spark, folder, "p5_found") == {("documents", "6", "title"), ("search_index", "https://a.example/3", "title_terms")}
    assert ("parse_results", 2, 1) in found(spark, folder, "p7_found")
    assert found(spark, folder, "p9_found") == {(3, 1)}
    assert {i for i, _ in found(spark, folder, "p10_found")} <= {3, 6}


def like(line):
    return re.sub(r"\d+", "0", re.sub(r"\s+", " ", line.strip()).lower())


def brute(pages, least=3, share=0.05):
    urls, where = defaultdict(set), defaultdict(set)
    for host, url, content in pages:
        urls[host].add(url)
        for x in content.split("\n") if content else []:
            if like(x):
                where[host, like(x)].add(url)
    return {(url, i) for host, url, content in pages for i, x in enumerate(content.split("\n") if content else [], 1) if like(x) and len(where[host, like(x)]) >= max(least, share * len(urls[host]))}


def test_repeated_lines(spark, data):
    pages = spark.read.parquet(f"{data}/search_index.parquet").select("host", "url", "content")
    got = {(r.url, r.line_no) for r in repeats.repeated(pages).collect()}
    assert got == brute([tuple(r) for r in pages.collect()])


def test_repeated_lines_hot_host(spark, monkeypatch):
    monkeypatch.setattr(repeats, "ARRAY", 8)  # the larger half of the containers are bitmaps
    monkeypatch.setattr(repeats, "CONTAINER", 6)
    rows = [("h", f"u{i}", "\n".join(["Share  it", "share it " if i % 2 else "SHARE IT", f"Page {i}", f"only {chr(97 + i % 26)}", "" if i % 3 else "three"])) for i in range(300)] + [("g", "x", "Share it"), ("g", "x", "Share it\nnew")]
    pages = spark.createDataFrame(rows, "host string, url string, content string")
    assert {(r.url, r.line_no) for r in repeats.repeated(pages).collect()} == {k for k in brute(rows)}
    clean = {r.url: r.clean for r in repeats.cleaned(pages).collect()}
    assert "Share" not in clean["u0"] and clean["x"].startswith("Share it")


@pytest.mark.parametrize("refined", [True, False])
def test_packing(spark, refined):
    sizes = spark.createDataFrame([(i, 1 + (i * 37) % 90) for i in range(400)] + [(1000 + i, 30) for i in range(300)], "doc_id long, tokens int")
    rows = packing.pack(sizes, [("a", 64), ("b", 500)], refined=refined).collect()
    want = {r.doc_id: r.tokens for r in sizes.collect()}
    for name, capacity in (("a", 64), ("b", 500)):
        own = [r for r in rows if r.limit_name == name]
        full, parts = defaultdict(int), defaultdict(list)
        for r in own:
            full[r.container] += r.tokens
            parts[r.doc_id].append((r.piece, r.tokens))
        assert max(full.values()) <= capacity
        assert {d: sum(t for _, t in p) for d, p in parts.items()} == want
        for d, p in parts.items():
            assert sorted(k for k, _ in p) == list(range(-(-want[d] // capacity))) and all(t == capacity for k, t in p if k < len(p) - 1)
        if refined:
            assert len(full) <= 1.02 * sum(want.values()) / capacity + 2


def test_outgoing_links_are_distinct_pages(spark):
    a, b = "https://a.example/", "https://b.test/"
    links = [(a, b + "x"), (a, b + "x"), (a, b + "x#top"), (a, b + "x?utm_source=letter"), (a, b + "y?page=2"), (a, b + "y?page=3"), (a, a + "z"), (a, "mailto:x@b.test"), (None, b), (b, a)]
    got = link_counts(spark.createDataFrame(links, "src string, dst string"))
    assert sorted((r.link_src, r.outgoing) for r in got.collect()) == [(a, 3), (b, 1)]


def test_longer_sample_tables_are_refused(spark, tmp_path, monkeypatch):
    folder = write(spark, tmp_path, {"lang_samples": [(i, "en", f"text {i}") for i in range(4)]})
    monkeypatch.setattr(pages, "SAMPLES", 4)
    assert len(pages.samples_of(spark, folder)) == 4
    monkeypatch.setattr(pages, "SAMPLES", 3)
    with pytest.raises(ValueError):
        pages.samples_of(spark, folder)


def test_more_limits_and_coarse_capacities(spark, tmp_path, monkeypatch):
    folder = write(spark, tmp_path, {"pack_limits": [(f"l{i}", 40 + i) for i in range(5)] + [("l0", 7), (None, 3)]})
    limits = packing.limits_of(spark, folder)
    assert limits == [(f"l{i}", 40 + i) for i in range(5)]
    monkeypatch.setattr(packing, "LIMITS", 2)
    monkeypatch.setattr(packing, "CAPACITIES", 30)  # steps of three tokens
    sizes = spark.createDataFrame([(i, 1 + (i * 37) % 90) for i in range(200)], "doc_id long, tokens int")
    rows = packing.pack(sizes, limits).collect()
    for name, capacity in limits:
        full, whole = defaultdict(int), defaultdict(int)
        for r in (r for r in rows if r.limit_name == name):
            full[r.container] += r.tokens
            whole[r.doc_id] += r.tokens
        assert max(full.values()) <= capacity and dict(whole) == {r.doc_id: r.tokens for r in sizes.collect()}


def test_item_blocks_find_the_same(spark, folder, monkeypatch, data):
    whole = {tuple(r) for r in queries.queries()["p9_found"](spark, data).collect()}
    monkeypatch.setattr(leaks, "ITEMS", 150)
    assert len(leaks.items_of(spark, data)) == 3
    assert {tuple(r) for r in queries.queries()["p9_found"](spark, data).collect()} == whole != set()


def test_another_language(spark, tmp_path, samples):
    """A seventh language is one of the samples' languages, not left out; a line of two words is judged too."""
    words = ["la biblioteca apre alle nove", "i lettori prendono dieci libri", "gli orari della città sono questi", "ogni giorno il sindaco scrive una lettera", "perché la strada è chiusa"]
    more = [(9000 + i, "it", f"{words[i % 5]}, {words[(i * 2 + 1) % 5]} e {words[(i * 3 + 2) % 5]}.") for i in range(60)]
    text = "La biblioteca apre alle nove e i lettori prendono dieci libri. Ogni giorno il sindaco scrive una lettera perché la strada è chiusa."
    docs = [(1, "https://a.example/1", "Orari della biblioteca", text, text, "en", "a.example", 9, None)]
    folder = write(spark, tmp_path, {"documents": docs, "lang_samples": samples + more})
    assert found(spark, folder, "p3_found") == {(1, 0, "it")}


PROSE, LINK = "The library opens at nine and closes at six today.", "https://a.example/x"


def near_even(samples):
    """Documents of which one is decoded otherwise when the model learns from the long ones too, and the words of each kind by a model fitted on all of them."""
    long = "\n".join(([PROSE] * 3 + ["Velo"] * 2) * 150 + [LINK])
    texts = [long] * 30 + ["\n".join([PROSE, LINK] + ["Velo"] * 6), None]
    assert len(long) > 20_000
    a = pages.Analyzer([r[1:] for r in samples])
    lines = [a.page("", x)[1] for x in texts]
    whole, short = (Spam().fit([observations(x) for x in part]) for part in (lines, lines[30:]))
    want = {i: whole.counts(x)[:3] for i, x in enumerate(lines)}
    assert short.counts(lines[30])[:3] == (10, 7, 0) != want[30]
    return [(i, f"https://a.example/{i}", "", x, x, "en", "a.example", 9, None) for i, x in enumerate(texts)], want


def test_p1_learns_from_every_page(spark, tmp_path, samples):
    docs, want = near_even(samples)
    folder = write(spark, tmp_path, {"documents": docs, "lang_samples": samples})
    assert {r.doc_id: (r.prose, r.listed, r.tagged) for r in queries.queries()["p1_kinds"](spark, folder).collect()} == want


def test_p1_sums_of_parts(spark, samples):
    """However the pages lie in partitions, and however many lines are handled at a time, the model is the same."""
    seen = [bytes([i % 7, i % 5, 5, 0][: i % 5]) for i in range(3000)]
    whole = Spam().fit(seen)
    for n in (1, 7):
        m = pages.fit_spam(spark.createDataFrame([(bytearray(x),) for x in seen], "seen binary").repartition(n))
        assert all(np.allclose(x, y, rtol=1e-9) for x, y in zip(m.p, whole.p))
    part = Spam()
    part.LINES = 10
    assert all(np.allclose(x, y, rtol=1e-9) for x, y in zip(part.fit(seen).p, whole.p))


def test_p3_leaves_out_what_p1_finds(spark, tmp_path, samples):
    """A page that is spam by the model of all pages, and wasn't by that of the short ones, gives no rows."""
    docs, _ = near_even(samples)
    docs = [(*d[:5], "de", *d[6:]) for d in docs]
    folder = write(spark, tmp_path, {"documents": docs, "lang_samples": samples})
    assert found(spark, folder, "p1_found") == {(30,)}
    assert found(spark, folder, "p3_found") == {(i, 0, "en") for i in range(30)}


def test_p7_and_p10_keep_what_p1_does_not_find(spark, tmp_path, samples):
    """By the same model as p1_found, that of all pages; a model of the short ones alone took this one for a list."""
    docs, _ = near_even(samples)
    page = "\n".join(["Skip to content", PROSE, LINK] + ["one two three four five six seven eight nine ten"] * 8)
    docs.append((99, "https://a.example/99", "", page, page, "en", "a.example", 9, None))
    folder = write(spark, tmp_path, {"documents": docs, "lang_samples": samples, "reading_labels": [(0, "a", 1), (1, "b", 3)]})
    assert (99,) not in found(spark, folder, "p1_found")
    assert ("documents", 99, 1) in found(spark, folder, "p7_found")
    assert 99 in {i for i, _ in found(spark, folder, "p10_found")}
