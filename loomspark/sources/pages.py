"""HTML pages and feeds as rows: title, main text, links; standard library only, Arrow-batched."""

from __future__ import annotations

import ipaddress
import re
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlencode, urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import LINK_DROPPED, MAX_LENGTH

_SKIP = {"script", "style", "noscript", "template", "svg"}
_FRAME = {"nav", "footer", "aside", "header", "form", "menu"}
_BLOCK = {"p", "div", "section", "article", "main", "li", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "br", "td", "th", "body"} | _FRAME
_FEEDS = {"application/rss+xml", "application/atom+xml"}


_ADDRESS = re.compile(r"(?i)(https?)://(?:[^/?#@]*@)?(\[[^\]/?#]+\]|[^/?#:@]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?")


def private(host: str) -> bool:
    """An address literal that no page of the public web has."""
    try:
        a = ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return False
    return a.is_private or a.is_loopback or a.is_link_local or a.is_reserved


def resolve(base: str, link: str | None) -> str | None:
    """The link as it is stored; null for what isn't http(s), has a private address or is too long."""
    try:
        m = _ADDRESS.match(urljoin(base, link.strip())) if link else None
    except ValueError:  # brackets that don't close
        m = None
    if not m or private(m[2]):
        return None
    pairs = [p for p in parse_qsl(m[5] or "", keep_blank_values=True) if p[0] not in LINK_DROPPED]
    port, asked = f":{m[3]}" if m[3] else "", f"?{urlencode(pairs)}" if pairs else ""
    url = f"{m[1].lower()}://{m[2].lower()}{port}{m[4]}{asked}"
    return url if len(url) <= MAX_LENGTH else None


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.feeds, self.meta = None, [], [], ""
        self.skip = self.frame = self.anchor = 0
        self.in_title = False
        self.blocks: list[tuple[str, bool, int, str]] = []  # text, inside a frame, characters of links, tag
        self.text, self.linked, self.tag = [], 0, "body"

    def _flush(self, tag: str) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((text, self.frame > 0, self.linked, self.tag))
        self.text, self.linked, self.tag = [], 0, tag

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        elif tag == "title" and self.title is None:
            self.in_title, self.title = True, ""
        elif tag == "a":
            self.anchor += 1
            if a.get("href"):
                self.links.append(a["href"])
        elif tag == "link" and "alternate" in (a.get("rel") or "").lower() and (a.get("type") or "").lower() in _FEEDS:
            self.feeds.append(a.get("href"))
        elif tag == "meta" and (a.get("name") or a.get("property") or "").lower() in ("description", "og:description", "twitter:description"):
            self.meta = self.meta or a.get("content") or ""
        if tag in _BLOCK:
            self._flush(tag)
            self.frame += tag in _FRAME

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a":
            self.anchor = max(0, self.anchor - 1)
        if tag in _BLOCK:
            self._flush("body")
            self.frame = max(0, self.frame - (tag in _FRAME))

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.text.append(data)
            if self.anchor:
                self.linked += len(data.strip())


def parse_page(html: str | None, base: str | None, most: int = 100) -> tuple[str, str, list[str], list[str]]:
    """(title, main text, outlinks, feed links).  Blocks that are mostly links or stand in frames aren't main text;
    a homepage with too few words left is filled up with its title, description and headings."""
    page = _Page()
    page.feed((html or "").replace("\x00", " "))
    page.close()
    page._flush("body")
    title = (page.title or "").strip()
    main = [t for t, framed, linked, tag in page.blocks if not framed and linked < 0.6 * len(t)]
    text = "\n".join(main or [t for t, _, _, _ in page.blocks])
    if len(text.split()) < 40 and re.fullmatch(r"(?i)https?://[^/?#]+/?(?:[?#].*)?", base or ""):
        heads = [t for t, _, _, tag in page.blocks if tag == "h1"][:2] + [t for t, _, _, tag in page.blocks if tag in ("h2", "h3")][:6]
        text = "\n".join(dict.fromkeys(x for x in [title, page.meta.strip(), *heads, *text.split("\n")] if x))
    links = [u for u in (resolve(base or "", x) for x in page.links) if u][:most]
    return title, text, links, list(dict.fromkeys(u for u in (resolve(base or "", x) for x in page.feeds) if u))


def parse_feed(xml: str | None, base: str = "") -> list[tuple[str, str, str]]:
    """(url, title, content) of the entries of an RSS or Atom feed that have all three; one per url."""
    try:
        root = ElementTree.fromstring((xml or "").strip())
    except ElementTree.ParseError:
        return []
    name = lambda e: e.tag.rpartition("}")[2].lower()
    out: dict[str, tuple[str, str, str]] = {}
    for entry in (e for e in root.iter() if name(e) in ("item", "entry")):
        got: dict[str, str] = {}
        for e in entry:
            text = re.sub(r"<[^>]+>", " ", "".join(e.itertext()))
            if name(e) == "link":
                got.setdefault("url", e.get("href") or text.strip()) if e.get("rel", "alternate") == "alternate" else None
            elif name(e) in ("title", "encoded", "content", "description", "summary") and text.strip():
                got.setdefault("title" if name(e) == "title" else "content", " ".join(text.split()))
        url = resolve(base, got.get("url"))
        if url and got.get("title") and got.get("content"):
            out.setdefault(url, (url, got["title"], got["content"]))
    return list(out.values())


def parsed(html: str, url: str, most: int = 100) -> Column:
    @F.pandas_udf("title string, content string, outlinks array<string>, feed_links array<string>")
    def run(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(h, b, most) for h, b in zip(pages, bases)], columns=["title", "content", "outlinks", "feed_links"])

    return run(html, url)


def feed_entries(xml: str) -> Column:
    @F.pandas_udf("array<struct<url:string,title:string,content:string>>")
    def run(feeds: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("url", "title", "content"), e)) for e in parse_feed(x)] for x in feeds])

    return run(xml)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of stored pages: one file per page, named by its escaped URL; files over 10 MiB are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length <= 10485760")
    return files.select(F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.html?$", "")).alias("url"), F.decode("content", F.lit("UTF-8")).alias("html"))
