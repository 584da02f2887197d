"""Text and number expressions of search: analysis, query parsing, gains and delays."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

JAPANESE = "[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def terms(text) -> Column:
    """Index terms: white-space separated, lower case, no empty ones."""
    return F.filter(F.split(F.lower(_c(text)), r"\s+"), lambda t: t != "")


def analyzed(text) -> Column:
    """Text as it is indexed: lower case; Japanese letters stand apart, for want of a dictionary each is a term."""
    low = F.lower(_c(text))
    apart = F.trim(F.regexp_replace(F.regexp_replace(low, f"({JAPANESE})", " $1 "), r"\s+", " "))
    return F.when(F.coalesce(F.trim(_c(text)), F.lit("")) == "", "").when(low.rlike(JAPANESE), apart).otherwise(low)


def query_tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), F.lit(0))


def squeezed(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def without_nul(text) -> Column:
    return F.translate(_c(text), "\x00", " ")


def error_text(text, most: int = 240) -> Column:
    flat = squeezed(text)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def embedding_text(text) -> Column:
    return F.substring(F.replace(_c(text), F.lit("\n"), F.lit(" ")), 1, 30000)


def gain(relevance, rank) -> Column:
    """A term of the discounted cumulative gain; 0 for what isn't relevant."""
    return F.when(_c(relevance) > 0, (F.pow(F.lit(2.0), _c(relevance)) - 1) / F.log2(_c(rank) + 1)).otherwise(F.lit(0.0))


def retry_delay(attempt, base: float = 1.0, most: float = 3600.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), _c(attempt)), F.lit(most))


def minimum_should_match(count: int) -> int:
    """How many of so many terms a document must hold.  Fixed values: all of two, 60 % of five, else 50 %."""
    return count if count <= 2 else count * 60 // 100 if count <= 5 else count * 50 // 100


@dataclass(frozen=True)
class ParsedQuery:
    text: str = ""
    site_filter: str | None = None
    exact_phrases: tuple[str, ...] = ()
    exclude_terms: tuple[str, ...] = ()
    exclude_phrases: tuple[str, ...] = ()

    @property
    def positive(self) -> str:
        return " ".join(x for x in (self.text, *self.exact_phrases) if x)


def parse_query(raw: str) -> ParsedQuery:
    """One pass over the query: `site:` words (the last counts), phrases in quotation marks and, after a minus that opens a word, what to leave out."""
    site, plain, at = None, [], 0
    found: dict[tuple[bool, bool], list[str]] = {}  # (left out, a phrase)
    fresh = True  # does a word begin here?
    while at < len(raw):
        c, minus = raw[at], fresh and raw[at] == "-"
        start = at + minus
        end = raw.find('"', start + 1) if raw[start : start + 1] == '"' else -1
        if end > start + 1:
            found.setdefault((minus, True), []).append(raw[start + 1 : end].strip())
            plain.append(" ")
            at, fresh = end + 1, True
            continue
        word = re.match(r'[^\s"]+', raw[start:]) if fresh else None
        if word and minus:
            found.setdefault((True, False), []).append(word.group())
            at, fresh = start + word.end(), False
        elif word and word.group().lower().startswith("site:") and (whole := re.match(r"\S+", raw[at + 5 :])):
            site = whole.group().lower()
            at, fresh = at + 5 + whole.end(), False
        else:
            plain.append(c)
            at, fresh = at + 1, c.isspace()
    get = lambda *k: tuple(filter(None, found.get(k, [])))
    return ParsedQuery(" ".join("".join(plain).split()), site, get(False, True), get(True, False), get(True, True))


def strip_question(text: str) -> str:
    return re.sub(r"(?i)^what\s+(?:is|are)\s+", "", text)
