"""Problem 4: text that was decoded with the wrong character encoding.

A hidden Markov model labels the characters of a text: one clean state and one state
per encoding pair (right encoding, wrong encoding).  The emissions are counted on the
labelled language samples, as they are and after passing through each pair; the
transitions are sticky.  Each span of a pair's state gets the inverse transform, and
counts as damage only if that yields likelier text.  The replacement character is
damage that can't be undone, and so are question marks in the place of letters (see `lost`);
they stay as they are.  A short sample between quotation marks is no damage.

Only lines with a strong sign are decoded: a character that a pair makes much likelier,
two suspicious ones side by side, a capital inside a word, or Cyrillic in odd case.  Decoding
every line finds sound text instead (Russian by way of another Cyrillic encoding, `Únase`);
what one character gives away in a Latin line that the model finds clean is looked for by
its place (`_alone`).  A line whose every sign is weaker stays as it is.  Within a line, long
runs of ASCII are left out; that doesn't change the best path, since leaving a state and
entering it again costs less than such a run.  Null and empty texts are clean.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter

# Right encoding, wrong encoding, times, and the languages in which the pair occurs.
PAIRS = [
    ("utf-8", "w1252", 1, "en de fr es ru ja"), ("utf-8", "w1252", 2, "en de fr es ru ja"), ("utf-8", "latin-1", 1, "en de fr es ru ja"), ("utf-8", "latin-1", 2, "en de fr es ru ja"),
    ("utf-8", "cp437", 1, "en de fr es"), ("utf-8", "cp850", 1, "en de fr es"), ("utf-8", "mac_roman", 1, "en de fr es"), ("utf-8", "cp1250", 1, "en de fr es"),
    ("utf-8", "cp1251", 1, "en de fr es ru"), ("utf-8", "koi8_r", 1, "ru"), ("utf-8", "cp866", 1, "ru"), ("utf-8", "gbk", 1, "ja ru"), ("utf-8", "cp932", 1, "ja"), ("utf-8", "big5", 1, "ja"), ("utf-8", "euc_jp", 1, "ja"),
    ("euc_jp", "cp932", 1, "ja"), ("euc_jp", "w1252", 1, "ja"), ("euc_jp", "latin-1", 1, "ja"), ("euc_jp", "gbk", 1, "ja"), ("cp932", "w1252", 1, "ja"), ("cp932", "latin-1", 1, "ja"), ("cp932", "gbk", 1, "ja"), ("cp932", "euc_jp", 1, "ja"),
    ("koi8_r", "cp1251", 1, "ru"), ("cp1251", "koi8_r", 1, "ru"), ("cp1251", "w1252", 1, "ru"), ("koi8_r", "w1252", 1, "ru"), ("cp866", "cp1251", 1, "ru"), ("cp1251", "cp866", 1, "ru"), ("koi8_r", "cp866", 1, "ru"), ("cp1251", "mac_cyrillic", 1, "ru"),
    ("w1252", "cp437", 1, "de fr es"), ("w1252", "mac_roman", 1, "de fr es"), ("mac_roman", "w1252", 1, "de fr es"), ("w1252", "cp1251", 1, "de fr es"), ("w1252", "cp850", 1, "de fr es"),
]
CYRILLIC, WIDE = {"koi8_r", "cp1251", "cp866", "mac_cyrillic"}, {"gbk", "big5", "cp932", "euc_jp"}
LATIN = {"w1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250"}
ENTER, MOST, LEAST, STRONG = 6.0, 7.0, -5.0, 2.5
LOST = "�"
# Signs that stand in clean text beside the letters of the samples.
SIGNS = "“”„‚‘’«»‹›–—…•·©®™°§¿¡€£№²³½×、。「」『』・ー〜？！：（）/→←↑↓★☆●○■□◆◇※✓"
MARKS = "“”’–…«»" + "".join(map(chr, range(0xC0, 0x100)))
_QUOTED = re.compile("[“„«‹「『\"‘]([^\x00-\x7f]{1,6})[”“»›」』\"’]")
_OPEN, _CLOSE = "“„«‹「『\"‘'`(（", "”“»›」』\"’'`)）"
_ALIKE = "аеорсухіјѕкАВЕКМНОРСТХУІЈЅҮү"
_FOREIGN = re.compile("(?<=[A-Za-z])[Ѐ-ӿ]|[Ѐ-ӿ](?=[A-Za-z])")
_CAPS = re.compile(f"[а-яё][А-ЯЁ]|[А-ЯЁ]{{3}}|[a-z](?![{_ALIKE}])[Ѐ-ӿ]|(?![{_ALIKE}])[Ѐ-ӿ][a-z]")
_ODD = re.compile("[a-zß-öø-ÿ][À-ÖØ-Þ‚ƒ„†‡ˆ‰Š‹Œ•˜™š›žŸ¡-¿]")
_TRAIL = "[\\]^_`{|}~@"
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_PLAIN = re.compile("[\x00-Z_-z]{26,}")
_HIDDEN = re.compile("[\u200b-\u200f\u2060\ufeff]|(?<=[Ѐ-ӿ])\xad(?=[Ѐ-ӿ])")
_SIGN = re.compile("(?<=[a-zà-ÿ])[À-ÖØ-Þ]|(?<!\\w)[¿¡¬√‡†∆ƒ≈](?=\\s|[a-z])|(?<=[a-z])[‡†√∆ƒ≈](?=[a-z\\s])")
_CONTEXT = 0xF0000
# Signs of Latin text in another Latin encoding that one character gives: a capital after a small letter, a symbol in a
# letter's place, a pair of letters around words in the place of quotation marks, a letter as dash or as apostrophe.
_ALONE = re.compile("(?<=[a-zß-öø-ÿ])[À-ÖØ-Þ](?![A-ZÀ-ÖØ-Þ])|(?<![\\d\\s])[^\\w\\s\x00-\x7f](?=[a-zß-öø-ÿ])|(?<!\\S)[^\\w\\s\x00-\x7f](?=[a-zß-öø-ÿ]{2})|(?<=[A-Za-z])[ˆ˜](?=[a-z])|(?<!\\S)ˆ(?=[a-z]{2})")
_AROUND = re.compile("(?<!\\w)(?:(ì)[A-Za-z][^ìî]{0,80}(î)|(Ò)[A-Za-z][^ÒÓ]{0,80}(Ó))(?!\\w)|(?<=[.?!] )([ñÐ])(?= [A-Z])")
_SHORT = re.compile("(?<=[b-z])í(?=(?:s|t|ll|re|ve)(?![a-z]))|(?<![rRn] )(?<=[a-z,] )ñ(?= [a-z])")
_FEW = re.compile("[ìÒÐ]|í(?:s|t|ll|re|ve)\\b|[ .]ñ ")
_ENGLISH = re.compile("\\b(?:the|and|of|is|with|was|this)\\b")
_ALSO = re.compile("(?<!\\S)[ñÐ](?!\\S)|(?<=[a-z])[íÕ](?=(?:s|t|ll|re|ve)(?![a-z]))|(?<=\\b[cdjlmnst])[íÕ](?=[a-z])")
_LETTER = "A-Za-zÀ-ɏЀ-ӿ"
_SMALL = "a-zß-öø-ÿа-џ"
_MARK = re.compile(f"\\?\\?|[{_LETTER}]\\?[{_SMALL}]|(?:^|\\s)\\?[{_SMALL}]", re.M)
_CITED = re.compile("“[^“”\n]{1,80}”|„[^„“”\n]{1,80}[“”]|«[^«»\n]{1,80}»|‹[^‹›\n]{1,80}›|「[^「」\n]{1,80}」|『[^『』\n]{1,80}』|\"[^\"\n]{1,80}\"|`[^`\n]{1,80}`|‘[^‘’\n]{1,80}’|(?<!\\w)'[^'\n]{1,80}'(?!\\w)|[(（][^()（）\n]{1,80}[)）]")
_ROW = re.compile(r"(?<!\S)[-(\[]?(\?+)[.,:;!)\]]{0,2}\s+[-(\[]?(\?+)[.,:;!)\]]{0,2}(?!\S)")  # two words of question marks
_FIRST = re.compile(f"^\\s*(?:\\?{{4,}}[.,:;!]?\\s*$|\\?{{2,}}[,:;]?\\s+[{_LETTER}])")  # no sentence ends there
_AMID = re.compile(f"(?<=[{_LETTER}0-9,;:] )\\?{{3,}}(?:[.,;:]|(?= [{_SMALL}]))")
_INSIDE = re.compile(f"(?<!\\S)[-(\\[]?[{_LETTER}]+(?:\\?+[{_SMALL}]+)+[-.,:;!?)\\]]*(?!\\S)")
_BEFORE = re.compile(f"(?<!\\S)(?:\\?+[{_SMALL}]+)+[.,:;!]?(?!\\S)")


def lost(line: str) -> bool:
    """Do question marks stand in the place of letters?

    Several words of them in a row, one that opens a line or stands amid a sentence, or some inside a word; not the
    marks that end a sentence, and nothing quoted.  A mark that ends a word can't be told from a question."""
    if not _MARK.search(line):
        return False
    bare = _CITED.sub(" x ", line)
    if not re.search(f"[{_LETTER}?]", _CITED.sub("", line)):
        bare = line  # the whole line stands between the marks
    if any(max(map(len, m.groups())) > 1 for m in _ROW.finditer(bare)):
        return True
    if _FIRST.search(bare) or _AMID.search(bare):
        return True
    inside = _INSIDE.findall(bare)
    return any(len(re.findall(f"[{_LETTER}]", x)) > 2 for x in inside) or len(_BEFORE.findall(bare)) + len(inside) > 1


def _byte(e: UnicodeError):
    if isinstance(e, UnicodeDecodeError):
        return "".join(chr(b) for b in e.object[e.start : e.end]), e.end
    part = e.object[e.start : e.end]
    return b"".join(bytes([ord(c)]) if ord(c) < 256 else b"\x00" for c in part), e.end


codecs.register_error("loom_byte", _byte)


def _name(enc: str) -> str:
    return "cp1252" if enc == "w1252" else enc


def garble(text: str, right: str, wrong: str, times: int = 1) -> str:
    for _ in range(times):
        raw = text.encode(_name(right), "ignore")
        text = raw.decode(_name(wrong), "loom_byte" if wrong == "w1252" else "replace")
    return text


def restore(text: str, right: str, wrong: str, times: int = 1) -> tuple[str, float]:
    """The inverse transform and which part of its characters could be decoded."""
    for _ in range(times):
        raw = text.encode(_name(wrong), "loom_byte").replace(b"\x00", b"?") if wrong in ("w1252", "latin-1") else text.encode(_name(wrong), "replace")
        text = raw.decode(_name(right), "loom_byte" if right == "w1252" else "replace")
    high = [c for c in text if not c.isascii()]
    bad = sum(c == LOST or 0x80 <= ord(c) < 0xA0 for c in high)
    return text, (1 - bad / len(high)) if high else 0.0


class Encodings:
    """samples: (language, text) pairs of clean text; their number is bounded by the table of labelled samples."""

    def __init__(self, samples: list[tuple[str, str]]):
        by: dict[str, str] = {}
        for lang, text in samples:
            by[lang] = by.get(lang, "") + "\n" + text
        clean: Counter = Counter()
        for text in by.values():
            clean.update(c for c in text if not c.isascii())
        self.pair: Counter = Counter()  # bigrams of Cyrillic words in lower case
        for w in re.findall("[а-яё]+", by.get("ru", "").lower()):
            self.pair.update(zip(" " + w, w + " "))
        self.pairs_all = max(1, sum(self.pair.values()))
        upper = Counter()
        for c, n in clean.items():  # capitals of letters of the samples are as clean as they
            if c.upper() != c and len(c.upper()) == 1:
                upper[c.upper()] += n // 20 + 1
        clean += upper
        for c in SIGNS:
            clean[c] += 30
        for o in [*range(0x3041, 0x30FF), *range(0x410, 0x450)]:
            clean[chr(o)] += 5
        total, floor = sum(clean.values()), 0.5
        self.clean = {c: math.log((n + floor) / total) for c, n in clean.items()}
        self.unseen = math.log(floor / total)
        self.states, rows = [], {}
        for right, wrong, times, langs in PAIRS:
            made = Counter(c for lang in langs.split() if lang in by for c in garble(by[lang], right, wrong, times) if not c.isascii() and c != LOST)
            for lang in langs.split():  # marks that typing leaves in any language
                made.update(c for s in MARKS for c in garble(s, right, wrong, times) * 12 if not c.isascii() and c != LOST and right in ("utf-8", "w1252"))
            n = sum(made.values())
            if n:
                self.states.append((right, wrong, times))
                for c, k in made.items():
                    rows.setdefault(c, {})[len(self.states) - 1] = max(LEAST, min(MOST, math.log(k / n) - self.clean.get(c, self.unseen)))
        inside = self.states.index(("w1252", "cp1251", 1))
        for o in range(0x400, 0x500):  # a Cyrillic letter inside a Latin word
            rows[chr(_CONTEXT + o)] = {inside: 0.0 if chr(o) in _ALIKE else MOST}
        self.rows = {c: r for c, r in rows.items() if max(r.values()) > 0 or ord(c) >= _CONTEXT}
        peak = {c: max(r.values()) for c, r in self.rows.items() if ord(c) < _CONTEXT and not "Ѐ" <= c <= "ӿ"}
        wide = lambda c: "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿"
        escape = lambda least, cjk: "".join(f"\\U{ord(c):08x}" for c, v in peak.items() if v >= least and wide(c) == cjk)
        near = escape(3.0, False)
        self.suspect = re.compile(f"[\x80-\x9f{LOST}\ue000-\uf8ff" + escape(5.0, False) + f"]|[{near}][^\x00-\x7f]|[^\x00-\x7f][{near}]|[" + escape(5.0, True) + "]{2}|" + _ODD.pattern)
        self.memo: dict[str, tuple[str, bool]] = {}

    def _likely(self, text: str) -> float:
        return sum(self.clean.get(c, self.unseen) if not c.isascii() else -5.0 for c in text)

    def _cyrillic(self, text: str) -> float:
        words = re.findall("[а-яё]+", text.lower())
        if sum(map(len, words)) < 0.5 * sum(not c.isascii() for c in text):
            return -20.0
        return sum(math.log((self.pair[p] + 0.05) / self.pairs_all) for w in words for p in zip(" " + w, w + " ")) / max(1, sum(len(w) + 1 for w in words))

    def _spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, state) of the spans that aren't clean.  No span crosses so much ASCII that leaving it and entering again costs less."""
        text = _FOREIGN.sub(lambda m: chr(_CONTEXT + ord(m.group())), text)
        out, at = [], 0
        for m in [*_PLAIN.finditer(text), None]:
            end = m.start() if m else len(text)
            if end > at and not text[at:end].isascii():
                out += [(a + at, b + at, s) for a, b, s in self._viterbi(text[at:end])]
            at = m.end() if m else end
        return out

    def _viterbi(self, text: str) -> list[tuple[int, int, int]]:
        """States are left and entered through clean."""
        could: Counter = Counter()  # what a state's spans can gain at most; less than it costs to enter it is no use
        for c, n in Counter(text).items():
            for s, v in self.rows.get(c, {}).items():
                if v > 0:
                    could[s] += v * n
        active = sorted(s for s, v in could.items() if v > ENTER)
        if not active:
            return []
        k = len(active)
        clean, score, since = 0.0, [-1e9] * k, [0] * k
        back: list[tuple[int, int, int] | None] = [None]  # at i: the span that ends at i in the best path, if any
        best = [0.0]
        at = {s: i for i, s in enumerate(active)}
        empty = [LEAST] * k
        table: dict[str, list[float]] = {"x": [-0.01] * k}
        for c in set(text):
            if c.isascii():
                table[c] = [-0.01 if c in _TRAIL and self.states[s][1] in ("w1252", "latin-1", "gbk", "cp932") else -0.25 for s in active]
            elif c in self.rows:
                row = list(empty)
                for s, v in self.rows[c].items():
                    if s in at:
                        row[at[s]] = v
                table[c] = row
            else:
                table[c] = [3.0] * k if "\x80" <= c <= "\x9f" or "" <= c <= "" else [0.0] * k if c == LOST else [-2.0 if c not in self.clean else LEAST] * k
        for i, c in enumerate(_QUOTED.sub(lambda m: "x" * len(m.group()), text)):
            row, top, who = table[c], clean, -1
            for j in range(k):
                go, start = score[j], clean - ENTER
                if start >= go:
                    go, since[j] = start, i
                score[j] = go = go + row[j]
                if go > top:
                    top, who = go, j
            if who >= 0 and top > clean:
                back.append((since[who], i + 1, active[who]))
                clean = top
            else:
                back.append(None)
            best.append(clean)
        spans, i = [], len(text)
        while i > 0:
            if back[i]:
                spans.append(back[i])
                i = back[i][0]
            else:
                i -= 1
        return spans[::-1]

    def _japanese(self, span: str) -> bool:
        """Is it ordinary Japanese that holds a few characters the samples lack?"""
        high = [c for c in span if not c.isascii()]
        if re.fullmatch("[ｦ-ﾟ]+", "".join(high)):
            return True
        wide = sum("一" <= c <= "鿿" or "぀" <= c <= "ヿ" for c in high)
        return wide > 0.6 * len(high) and (len(high) < 4 or sum(c not in self.clean for c in high) < 0.4 * len(high))

    def _best(self, span: str, state: int) -> int:
        """Of the states that make the span about as likely, the one whose inverse gives the likeliest text."""
        seen = [self.rows[c] for c in span if c in self.rows]
        total = [sum(r.get(s, LEAST) for r in seen) for s in range(len(self.states))]
        near = [s for s, t in enumerate(total) if t >= 0.6 * total[state] and t > 0 and s != state]
        if not near:
            return state
        tried = [(*restore(span, *self.states[s]), s) for s in [state, *near]]
        return max(tried, key=lambda x: (x[1] >= 0.5, self._likely(x[0]) * (1 if x[1] >= 0.5 else 2), x[1]))[2]

    def _words(self, text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans between two Cyrillic encodings, which have letters on both sides, grow to whole words, and to the whole line
        if they hold most of its Cyrillic letters; of the pairs the one is taken whose inverse reads best."""
        own = [x for x in spans if {*self.states[x[2]][:2]} <= CYRILLIC]
        if not own:
            return spans
        letters = [m.start() for m in _CYRILLIC.finditer(text)]
        grown: list[list[int]] = []
        if sum(a <= i < b for a, b, _ in own for i in letters) > 0.6 * len(letters):
            grown = [[letters[0], letters[-1] + 1]]
        else:
            for a, b, _ in own:
                while a and _CYRILLIC.match(text[a - 1]):
                    a -= 1
                while b < len(text) and _CYRILLIC.match(text[b]):
                    b += 1
                if grown and a <= grown[-1][1] + 1:
                    grown[-1][1] = max(b, grown[-1][1])
                else:
                    grown.append([a, b])
        pairs = [k for k, x in enumerate(self.states) if {*x[:2]} <= CYRILLIC]
        best = lambda part: max(pairs, key=lambda k: self._cyrillic(restore(part, *self.states[k])[0]))
        rest = [x for x in spans if not {*self.states[x[2]][:2]} <= CYRILLIC and not any(x[0] < b and a < x[1] for a, b in grown)]
        return sorted(rest + [(a, b, best(text[a:b])) for a, b in grown])

    def _suspicious(self, text: str) -> bool:
        return bool(self.suspect.search(text) or (_CYRILLIC.search(text) and _CAPS.search(text)) or (_FEW.search(text) and (_AROUND.search(text) or _SHORT.search(text))))

    def _alone(self, text: str) -> tuple[str, bool]:
        """A Latin line that the model finds clean, by signs of one character; the pair that explains most of them is taken."""
        at = [m.start() for m in _ALONE.finditer(text) if m.group() != "´" and text[m.start()] not in self.clean or text[m.start()].isalpha()]
        at += [i for m in _AROUND.finditer(text) for k in range(1, 6) if (i := m.start(k)) >= 0]
        if _ENGLISH.search(text):
            at += [m.start() for m in _SHORT.finditer(text)]
        cited = [m.span() for m in _CITED.finditer(text) if len(m.group()) <= 14 and m.group()[0] not in "(（"]  # short samples
        at = [i for i in at if not any(a <= i < b for a, b in cited)]
        best, new = (0, False, 0.0), text
        for pair in self.states if at else []:
            if pair[0] in LATIN and pair[1] in LATIN:
                out, n, gain = list(text), 0, 0.0
                for i in at:
                    x = restore(text[i], *pair)[0]
                    more = self.clean.get(x, self.unseen + (x in "ïëœæ")) - self.clean.get(text[i], self.unseen)
                    if len(x) == 1 and (x.islower() or x in "“”«»–—’" and text[i].isalpha()) and more > (0.5 if text[i] not in "íñ" else -1):
                        out[i], n, gain = x, n + 1, gain + more
                if (key := (n, "mac_roman" in pair, gain)) > best and n:
                    swap = lambda m, p=pair: x if (x := restore(m.group(), *p)[0]) in "–’" or x.isalpha() and x.islower() else m.group()
                    best, new = key, _ALSO.sub(swap, _SIGN.sub(swap, "".join(out)))
        return new, best[0] > 0

    def line(self, text: str) -> tuple[str, bool]:
        """(restored text, damaged) of one line."""
        if text.isascii() or not self._suspicious(text):
            return text, lost(text)
        if text in self.memo:
            return self.memo[text]
        whole, text = text, _HIDDEN.sub("", text)
        out, at, hit, same = [], 0, False, None
        for a, b, s in self._words(text, self._spans(text)):
            while a < b and text[a].isascii():
                a += 1
            while b > a and text[b - 1].isascii() and text[b - 1] not in _TRAIL:
                b -= 1
            if self.states[s][0] in WIDE and b < len(text) and "@" <= text[b] <= "~" and restore(text[a:b], *self.states[s])[0].endswith((LOST, "?")):
                b += 1  # the second byte of the last character is a letter
            if a >= b or (b - a <= 6 and a and b < len(text) and text[a - 1] in _OPEN and text[b] in _CLOSE):
                continue
            span = text[a:b]
            if self.states[s] != ("w1252", "cp1251", 1) and not {*self.states[s][:2]} <= CYRILLIC:
                s = self._best(span, s)
            right, wrong, times = self.states[s]
            new, good = restore(span, right, wrong, times)
            cyrillic = {right, wrong} <= CYRILLIC
            if cyrillic:
                if len(re.findall("[Ѐ-ӿ]", span)) < 5 or self._cyrillic(new) < self._cyrillic(span) + 0.5 or sum(x != y for x, y in zip(new, span)) < 0.3 * len(span):
                    continue
            elif (right, wrong) == ("w1252", "cp1251"):
                if good < 0.9 or not _FOREIGN.search(text):
                    continue
            elif good < 0.5 or self._likely(new) <= self._likely(span) + 2:
                continue
            elif right in LATIN and wrong in LATIN and not _ODD.search(text[max(0, a - 1) : b]):
                continue
            elif right in CYRILLIC and not re.search(f"[^\x00-\x7f]{{3}}", span):
                continue
            elif wrong in WIDE and self._japanese(span):
                continue
            out += text[at:a], new
            at, hit = b, True
            if right in LATIN and wrong in LATIN:
                same = (right, wrong, times)
        new = "".join(out) + text[at:] if hit else text
        if same:  # what else of the line is no letter but would be one
            new = _SIGN.sub(lambda m: x if (x := restore(m.group(), *same)[0]).isalpha() and x.islower() | (m.group() in "¿¡¬√") else m.group(), new)
        if not hit and not _CYRILLIC.search(text):
            text, hit = self._alone(text)
            new = text
        if not hit:
            hit = lost(text)
            for m in re.finditer(f"{LOST}+", text):
                if not (m.start() and m.end() < len(text) and text[m.start() - 1] in _OPEN and text[m.end()] in _CLOSE):
                    hit = True
        got = (new, True) if hit else (whole, False)
        if len(self.memo) < 50_000:
            self.memo[whole] = got
        return got

    def text(self, text: str | None) -> tuple[str | None, bool]:
        """(restored text, damaged) of a field; the spans of one line never depend on another line."""
        if not text or not ("?" in text and _MARK.search(text)) and (text.isascii() or not self._suspicious(text)):
            return text, False
        done = [self.line(x) for x in text.split("\n")]
        hit = any(h for _, h in done)
        return ("\n".join(t for t, _ in done), True) if hit else (text, False)
