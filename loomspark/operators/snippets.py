"""Keyword-in-context snippets; run on the few rows that are shown."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STOP = re.compile(r"[。！？\n]")


def _plain(text: str, size: int) -> str:
    return text[:size] + "..." if len(text) > size else text


def snippet(text: str | None, terms: list[str], size: int = 200, mark: bool = True) -> tuple[str, str]:
    """(with marks, plain): the window with the most different terms, cut at sentence or word ends."""
    terms = [t for t in terms if t and t.strip()]
    if not text:
        return "", ""
    low = text.lower()
    finder = re.compile("|".join(re.escape(t) for t in terms), re.I) if terms else None
    spots = [m.start() for m in finder.finditer(text)] if finder else []
    if not spots:
        return (_plain(text, size),) * 2
    half, lowered = size // 2, [t.lower() for t in terms]
    windows = {at: sum(t in low[max(0, at - half) : at + half] for t in lowered) for at in spots}
    start = max(0, max(spots, key=lambda at: (windows[at], -at)) - half)
    end = min(len(text), start + size)
    if start:
        near = slice(max(0, start - 30), min(len(text), start + 30))
        stop = _STOP.search(text, near.start, near.stop)
        space = text.rfind(" ", near.start, near.stop)
        start = stop.end() if stop else space + 1 if space >= 0 else start
    if end < len(text):
        stop = _STOP.search(text, max(start, end - 30), min(len(text), end + 30))
        space = text.find(" ", max(start, end - 20), end + 20)
        end = stop.end() if stop else space if space >= 0 else end
    cut = ("..." if start else "") + text[start:end].strip() + ("..." if end < len(text) else "")
    if not mark:
        return cut, cut
    out, at = [], 0
    for m in finder.finditer(cut):
        out += html.escape(cut[at : m.start()]), f"<mark>{html.escape(m.group())}</mark>"
        at = m.end()
    return "".join(out) + html.escape(cut[at:]), cut


def snippets(content: str, terms: list[str], size: int = 200) -> Column:
    """struct<text, plain_text> by an Arrow-batched function."""

    @F.pandas_udf("text string, plain_text string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([snippet(t, terms, size) for t in texts], columns=["text", "plain_text"])

    return run(content)
