"""Problem 7: the body of a page, by boosted trees over the nodes of a page's tree.

The tables hold a page's text without its mark-up, so its tree is rebuilt from the lines:
the page, its blocks (runs of lines of one look) and the lines.  A node's features are
its own counts, the cue tokens that stand for attributes, its depth, its place, and the
density of its block and of its neighbours.

The labels of the bounded training sample come from two sources that know nothing of each other: lines that
repeat on the pages of one host, whatever they say, and the cues, which name what differs from page
to page (author lines, tags, trails, lists of pages under their heading).  So that the trees don't
just repeat the cues, every page is learned twice: as it is, and with the cues of a part of all
lines hidden, as on a site whose phrases no list holds.  Hidden lines must be told by shape, place and
neighbours.  Decoding is hierarchical: a line is body only in a block that is body, and a
block is body only if a line of it is.  Null and empty contents have no lines.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from .lines import KINDS, SYMBOLS, Line
from .trees import Boosted

RELATED = KINDS.index("related")
#: A line repeats if it stands on so many pages of its host in the sample, and on such a share of them.
PAGES, SHARE = 3, 0.1
#: Share of the different lines whose cues are hidden in the second copy of a page.
HIDDEN = 0.3
_DIGITS = re.compile(r"\d+")


def listed(x: Line) -> bool:
    """Could it be an entry of a list of pages?"""
    return bool(x.text) and not x.kind and not x.ends and not x.links and not x.code and x.words <= 30 and SYMBOLS[x.symbol] in "SPKW"


def blocks(lines: list[Line]) -> list[tuple[int, int]]:
    """Runs of lines of one look: cues, prose and its kin, short lines, or empty."""
    out, start, last = [], 0, None
    for i, x in enumerate(lines):
        look = 3 if not x.text else 0 if x.kind == RELATED else 1 if x.kind else 4 if listed(x) else 2
        under = i and lines[i - 1].kind == RELATED and look == 4
        if i and (look != last or x.kind == RELATED) and not under:
            out.append((start, i))
            start = i
        last = look
    if lines:
        out.append((start, len(lines)))
    return out


def key(x: Line) -> str:
    return _DIGITS.sub("0", x.text.lower())


def repeats(pages: list[list[Line]], hosts: list) -> set[tuple]:
    """(host, line) of the lines that repeat on the pages of one host."""
    seen, size = defaultdict(set), Counter(hosts)
    for i, (lines, host) in enumerate(zip(pages, hosts)):
        for x in lines:
            if x.text:
                seen[host, key(x)].add(i)
    return {k for k, v in seen.items() if len(v) >= PAGES and len(v) >= SHARE * size[k[0]]}


def teach(lines: list[Line], host=None, repeated: set | frozenset = frozenset()) -> list[int]:
    """1 for body, 0 for what repeats on the host, for what cues name, and for lists that a heading of related pages opens."""
    out, within = [], False
    for x in lines:
        if x.kind:
            within = x.kind == RELATED
            out.append(0)
        elif within and listed(x):
            out.append(0)
        else:
            within = within and not x.text
            out.append(0 if repeated and x.text and (host, key(x)) in repeated else 1)
    return out


def hidden(x: Line, salt: int) -> Line:
    """The line as it would be if no list held its phrase, for HIDDEN of all lines."""
    if not x.kind or zlib.crc32(f"{salt} {key(x)}".encode()) % 1000 >= 1000 * HIDDEN:
        return x
    return x._replace(kind=0, cue_hits=0, symbol=0 if x.ends and x.words > 2 else 5)


def features(lines: list[Line], runs: list[tuple[int, int]]) -> list[list[float]]:
    """Of every line, then of every block."""
    n = len(lines)
    prose = [i for i, x in enumerate(lines) if x.symbol in (0, 1, 3) and not x.kind]
    first, last = (prose[0], prose[-1]) if prose else (n, -1)
    own = [(x.kind, x.symbol + 10 * listed(x), min(x.words, 60), x.ends, x.function, x.links, min(x.cells, 12), x.digits, x.title, x.cue_hits, min(len(x.text), 300)) for x in lines]
    none = (-1, -1, 0, 0, 0.0, 0, 0, 0.0, 0.0, 0, 0)
    rows, heads = [], []
    since = 99
    for a, b in runs:
        part = own[a:b]
        size = b - a
        words, ends, cues = sum(p[2] for p in part), sum(p[3] for p in part), sum(p[0] > 0 for p in part)
        block = (size, words / size, ends / size, cues / size, a / n, (n - b) / n)
        under = lines[a].kind == RELATED
        for i in range(a, b):
            x = own[i]
            since = 0 if x[0] == RELATED else since + 1
            p, q = own[i - 1] if i else none, own[i + 1] if i + 1 < n else none
            rows.append([0, 2 + under, *x, min(i, 30), min(n - 1 - i, 30), i < first, i > last, p[0], p[1], q[0], q[1], q[2], under and i > a, min(since, 20), *block])
        heads.append([1, 1 + under, max(p[0] for p in part), part[0][1], words / size, ends, sum(p[4] for p in part) / size, sum(p[5] for p in part), part[0][6], part[0][7], part[0][8], sum(p[9] for p in part), sum(p[10] for p in part) / size, min(a, 30), min(n - b, 30), b <= first, a > last, *((own[a - 1] if a else none)[:2]), *((own[b] if b < n else none)[:3]), under, 20, *block])
    return rows + heads


class Bodies:
    """pages: lines of the sample's pages; hosts: their hosts, for what repeats there."""

    def __init__(self, pages: list[list[Line]], hosts: list | None = None, copies: int = 1):
        x, y = [], []
        hosts = hosts or [None] * len(pages)
        again = repeats(pages, hosts) if any(hosts) else frozenset()
        for lines, host in zip(pages, hosts):
            truth = teach(lines, host, again)
            for salt in range(copies + 1):
                seen = [hidden(v, salt) for v in lines] if salt else lines
                runs = blocks(seen)
                x += features(seen, runs)
                y += truth + [int(any(truth[a:b])) for a, b in runs]
        self.model = Boosted(trees=40, depth=5).fit(np.array(x, dtype=np.float32), np.array(y, dtype=float)) if len(set(y)) == 2 else None

    def label(self, pages: list[list[Line]]) -> list[list[bool]]:
        """For each page, which of its lines are body."""
        if not self.model:
            return [[not x.kind for x in lines] for lines in pages]
        runs = [blocks(p) for p in pages]
        rows, sizes = [], []
        for p, r in zip(pages, runs):
            rows += features(p, r)
            sizes.append((len(p), len(r)))
        if not rows:
            return [[] for _ in pages]
        odds = self.model.predict(np.array(rows, dtype=np.float32))
        gain = odds  # log p - log (1 - p)
        out, at = [], 0
        for p, r, (n, b) in zip(pages, runs, sizes):
            line, head = gain[at : at + n].tolist(), gain[at + n : at + n + b].tolist()
            at += n + b
            body = [False] * n
            for (s, e), g in zip(r, head):
                # the best labelling with the block as body, at least one line of it too, against the block as boilerplate
                pos = sum(v for v in line[s:e] if v > 0)
                best = pos if pos > 0 else max(line[s:e])
                if g + best > 0:
                    top = max(range(s, e), key=line.__getitem__)
                    for i in range(s, e):
                        body[i] = line[i] > 0 or i == top
            out.append(body)
        return out
