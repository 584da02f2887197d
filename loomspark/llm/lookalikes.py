"""Problem 5: text that looks the same but is written with other characters.

Classes of look-alikes are the transitive closure (union-find) of three relations over
strings: a compatibility form and what it stands for, a decomposed sequence and its
composed letter, and letters of different scripts with one shape.  The shapes are those of the
public confusables table that comes with Spark's ICU library (`shapes_of`), united with the list SHAPES.
In each script a class has one representative, its member seen most often in the corpus.

Texts are rewritten greedily, longest pattern first, by an Aho-Corasick automaton.  Shapes of
another script are rewritten only inside a word of mixed scripts, by a second automaton over the
members of the classes: the word takes the script that costs least, where a letter costs more if its
representative there is rare in the corpus, and most if it has none.  So `pay` with one
Cyrillic letter is Latin again, whichever letters are in the majority, and equal-looking words
come out equal.  Words wholly in one script stay as they are.

Null and empty texts come back unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import ahocorasick

# Letters of Greek and Cyrillic that are drawn like a Latin letter.
SHAPES = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹ", "E": "ΕЕ", "H": "ΗН", "I": "ΙІ", "J": "Ј", "K": "ΚК", "M": "ΜМ", "N": "Ν",
    "O": "ΟО", "P": "ΡР", "S": "Ѕ", "T": "ΤТ", "X": "ΧХ", "Y": "ΥУҮ", "Z": "Ζ",
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "іι", "j": "ј", "k": "κк", "o": "оο", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "u": "υ", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уγү", "g": "ɡ", "l": "ӏ",
}
# Characters without a shape of their own, and spaces other than U+0020.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
SPACES = "               　"
# Blocks of compatibility forms (first and last code point).
COMPAT = [(0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0x2100, 0x214F), (0x2150, 0x218B), (0x2460, 0x24FF), (0x2F00, 0x2FD5), (0x3131, 0x318E), (0x3200, 0x33FF), (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0xFE30, 0xFE4F), (0xFF01, 0xFFEE), (0x1D400, 0x1D7FF)]
# Signs that are ordinary typography although they have a compatibility form.
ORDINARY = "№™℃℉℗℠℮Ω℧℥ℹ½¼¾⅓⅔⅛⅜⅝⅞㎡"
# Wide punctuation that is ordinary beside Japanese writing.
WIDE_PUNCTUATION = "！？（）：；，．～［］｛｝＆／＋－＝％＃＊＠｜"

LATIN, CYRILLIC, GREEK = "A-Za-zÀ-ÖØ-öø-ɏɡ", "Ѐ-ԯ", "Ͱ-Ͽ"
# Blocks of further scripts with letters that are drawn like Latin ones (first and last code point).
SCRIPTS = {"armenian": (0x531, 0x587), "cherokee": (0x13A0, 0x13FD), "coptic": (0x2C80, 0x2CEE), "lisu": (0xA4D0, 0xA4F7), "small cherokee": (0xAB70, 0xABBF)}
OTHER = "".join(f"{chr(a)}-{chr(b)}" for a, b in SCRIPTS.values())
# Units that the sign for a millionth stands before.
UNITS = ("m", "g", "s", "l", "L", "A", "V", "W", "F", "H", "J", "N", "Pa", "Hz", "mol", "Sv", "Gy")
#: What a letter costs that the script of its word has: none, a rare one, one that is like it by the public table only, a common one.
NONE, SELDOM, WEAK, COMMON = 10, 8, 4, 1
#: A representative is rare if it is so much less frequent than its script's mean letter.
RARE = 0.02
_WORD = re.compile(f"[{LATIN}{CYRILLIC}{GREEK}{OTHER}]+")
_MIXED = f"[{LATIN}][{CYRILLIC}{GREEK}{OTHER}]|[{CYRILLIC}{GREEK}{OTHER}][{LATIN}]|[{CYRILLIC}][{GREEK}{OTHER}]|[{GREEK}{OTHER}][{CYRILLIC}]"
_EMOJI = re.compile("[←-⯿\U0001f000-\U0001faff️]")
_JAPANESE = re.compile("[、-ヿ一-鿿]")


def _class(chars: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in chars)


#: What makes a text worth a closer look; also valid as a Java regular expression but for the astral range.
SUSPECT = f"[{_class(INVISIBLE)}{_class(SPACES)}̀-゙゚ͯ" + "".join(f"{chr(a)}-{chr(b)}" for a, b in COMPAT if b < 0x10000) + f"]|{_MIXED}"
_SUSPECT = re.compile(SUSPECT[:-len(_MIXED) - 2] + "\U0001d400-\U0001d7ff]|" + _MIXED)


def script(c: str) -> str:
    o = ord(c)
    if 0x400 <= o <= 0x52F:
        return "cyrillic"
    if 0x370 <= o <= 0x3FF:
        return "greek"
    if o < 0x250 or o == 0x261:
        return "latin" if c.isalpha() and o not in (0xAA, 0xB5, 0xBA) else ""
    return next((k.split()[-1] for k, (a, b) in SCRIPTS.items() if a <= o <= b), "")


def letters(samples: list[tuple[str, str]]) -> Counter:
    """Occurrences of letters in labelled samples, where no counts of a corpus are at hand."""
    return Counter(c for _, t in samples for c in t if c.isalpha())


def shapes_of(spark) -> dict[str, str]:
    """Skeletons of the letters of all scripts here by the public confusables table of the JVM's ICU; {} where there is none."""
    blocks = [(0x41, 0x5A), (0x61, 0x7A), (0x370, 0x3FF), (0x400, 0x52F), *SCRIPTS.values()]
    chars = [c for a, b in blocks for c in map(chr, range(a, b + 1)) if c.isalpha() and len(unicodedata.normalize("NFD", c)) == 1]
    try:
        found = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton(0, "\n".join(chars)).split("\n")
    except Exception:  # another JVM without it
        return {}
    return {c: s for c, s in zip(chars, found) if len(s) == 1} if len(found) == len(chars) else {}


class Lookalikes:
    """Classes, representatives and the automata.  counts: occurrences of code points in the corpus; shapes: skeletons of letters."""

    def __init__(self, counts: dict[str, int] | None = None, shapes: dict[str, str] | None = None):
        self.counts = Counter(counts or {})
        if not self.counts:  # the letters that modern texts are written with
            self.counts.update([chr(o) for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0x410, 0x44F), (0x391, 0x3A9), (0x3B1, 0x3C9)) for o in range(a, b + 1)])
        self.parent: dict[str, str] = {}
        alike: set[str] = set()
        for latin, others in SHAPES.items():
            for c in others:
                self.join(latin, c)
                alike |= {latin, c}
        by: dict[tuple[str, bool], str] = {}
        for c, skeleton in (shapes or {}).items():
            if script(c):
                first = by.setdefault((skeleton, c.isupper() or not c.islower() and skeleton.isupper()), c)
                self.join(c, first)
        drawn = {self.root(c): c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B)]) if c in self.parent}
        for c in sorted(self.parent):  # in lower case a look-alike capital still stands for the letter it was taken for
            if script(c) in ("cyrillic", "greek") and c != (low := c.lower()) and self.root(c) in drawn and self.root(low) not in drawn:
                self.join(low, drawn[self.root(c)].lower())
                alike.add(drawn[self.root(c)].lower())
        known = {c for c in self.parent if script(c)}
        for a, b in COMPAT:
            for o in range(a, b + 1):
                c = chr(o)
                n = unicodedata.normalize("NFKC", c)
                if n != c and c not in ORDINARY:
                    self.join(c, n)
        for c in {*map(chr, range(0xC0, 0x530)), *map(chr, range(0x3041, 0x30FF)), *map(chr, range(0x1E00, 0x1F00))}:
            d = unicodedata.normalize("NFD", c)
            if len(d) > 1 and unicodedata.normalize("NFC", d) == c:
                self.join(c, d)
        for c in "".join(chr(o) for o in range(0xFF66, 0xFF9E)):
            for mark in "ﾞﾟ":
                n = unicodedata.normalize("NFKC", c + mark)
                if len(n) == 1:
                    self.join(c + mark, n)
        classes: dict[str, list[str]] = {}
        for x in self.parent:
            classes.setdefault(self.root(x), []).append(x)
        total, kinds = Counter(), Counter()
        for c, n in self.counts.items():
            if n and len(c) == 1 and (k := script(c)):
                total[k] += n
                kinds[k] += 1
        common = lambda c, s: self.counts[c] >= RARE * total[s] / max(1, kinds[s]) and self.counts[c] > 0
        self.machine, self.shapes, self.by_shape = ahocorasick.Automaton(), ahocorasick.Automaton(), {}
        for members in classes.values():
            plain = [m for m in members if m in known]
            for s in {script(m) for m in plain}:
                mine = [m for m in plain if script(m) == s]
                best = max(mine, key=lambda m: (self.counts[m], m in alike, -ord(m)))
                for m in plain:
                    if script(m) != s:
                        close = {m, best} <= alike
                        self.by_shape[m, s] = best, COMMON if close and common(best, s) else WEAK if common(best, s) else SELDOM
            for m in plain:
                self.shapes.add_word(m, m)
            for m in members:
                to = unicodedata.normalize("NFKC", m)
                if to != m and m not in known:
                    self.machine.add_word(m, (m, to))
        for c in INVISIBLE:
            self.machine.add_word(c, (c, ""))
        for c in SPACES:
            self.machine.add_word(c, (c, " "))
        self.machine.make_automaton()
        self.shapes.make_automaton()

    def root(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: str, b: str) -> None:
        self.parent[self.root(a)] = self.root(b)

    def _word(self, m: re.Match) -> str:
        w = m.group()
        kinds = Counter(map(script, w))
        if len(kinds) < 2 or w[0] == "μ" and w[1:] in UNITS:
            return w
        cost = {s: sum(0 if script(c) == s else self.by_shape.get((c, s), ("", NONE))[1] for c in w) for s in kinds}
        main = min(kinds, key=lambda s: (cost[s], -kinds[s], s != "latin"))
        out, at = [], 0
        for end, c in self.shapes.iter(w):
            if script(c) != main and (to := self.by_shape.get((c, main))):
                out += w[at:end], to[0]
                at = end + 1
        return "".join(out) + w[at:]

    def rewrite(self, text: str | None) -> str | None:
        """The text in its one form; the same object if nothing had to change."""
        if not text or text.isascii() or not _SUSPECT.search(text):
            return text
        if len(text) > 400 and "\n" in text:
            old = text.split("\n")
            new = [self._rewrite(x) for x in old]
            return text if new == old else "\n".join(new)
        return self._rewrite(text)

    def _rewrite(self, text: str) -> str:
        if text.isascii() or not _SUSPECT.search(text):
            return text
        out, at, changed = [], 0, False
        for end, (found, to) in self.machine.iter_long(text):
            start = end - len(found) + 1
            if found == "‍" and (_EMOJI.match(text[start - 1 : start]) or _EMOJI.match(text[end + 1 : end + 2])):
                continue
            if found in WIDE_PUNCTUATION and (_JAPANESE.search(text[max(0, start - 4) : start].rstrip(WIDE_PUNCTUATION)[-1:]) or _JAPANESE.match(text[end + 1 : end + 2])):
                continue
            if start < at:
                continue
            out += text[at:start], to
            at, changed = end + 1, True
        if changed:
            text = "".join(out) + text[at:]
        composed = unicodedata.normalize("NFC", text)
        text = text if composed == text else composed
        fixed = _WORD.sub(self._word, text) if re.search(_MIXED, text) else text
        return text if fixed == text else fixed
