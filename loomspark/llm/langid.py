"""Problem 3: the language of a text, with a confidence.

Sparse multinomial logistic regression on TF-IDF weights of character n-grams (1 to 3,
hashed), trained on the labelled samples by follow-the-regularised-leader with
elastic-net penalties; a temperature fitted on held-out samples calibrates it.
The score of a text is the mean of its n-grams' weights, so a document's is the
length-weighted mean of its lines'.  Empty texts have no language.
"""

from __future__ import annotations

import re

import numpy as np

#: Languages of a model without samples; otherwise they are those of the labelled samples, however many.
LANGS = ["de", "en", "es", "fr", "ja", "ru"]
# Other spellings of language codes (ISO 639-2, both kinds) and names.
CODES = {"eng": "en", "jpn": "ja", "jap": "ja", "jp": "ja", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "ita": "it", "zho": "zh", "chi": "zh", "por": "pt", "nld": "nl", "dut": "nl", "kor": "ko", "pol": "pl", "ukr": "uk", "english": "en", "japanese": "ja", "german": "de", "deutsch": "de", "french": "fr", "français": "fr", "spanish": "es", "español": "es", "russian": "ru"}
BITS, ORDERS = 16, 3


def code(label: str | None) -> str:
    """The two-letter code that a label means, or ''."""
    low = re.split(r"[-_.@ ]", (label or "").strip().lower())[0]
    got = CODES.get(low, low)
    return got if len(got) == 2 and got.isalpha() and got not in ("xx", "zz") else ""


_LATIN = re.compile("[A-Za-zÀ-ɏ]+")
_OTHER = re.compile("[Ѐ-ӿ぀-ヿ一-鿿]")


def own_script(text: str) -> str:
    """Names in Latin letters say nothing about a text in another script; they are left out of it."""
    if text.isascii() or len(other := _OTHER.findall(text)) < 2:
        return text
    return _LATIN.sub("", text) if len(other) * 3 > sum(map(len, _LATIN.findall(text))) else text


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts in a row, the text that each belongs to, and where each order ends."""
    joined = "\n".join(re.sub(r"\s+", " ", own_script(t)).lower() if t else "" for t in texts)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cut = c == 10
    owner = np.cumsum(cut, dtype=np.int32)
    c = np.where((c >= 48) & (c <= 57), 48, c)
    ids, own = [], []
    h = np.zeros(len(c), dtype=np.uint32)
    for k in range(ORDERS):
        n = len(c) - k
        if n <= 0:
            break
        h = (h[:n] * np.uint32(0x9E3779B1) + c[k:]) * np.uint32(0x85EBCA6B) + np.uint32(k + 1)
        ok = ~cut[:n] & (owner[:n] == owner[k:]) & ~cut[k:]
        ids.append((h[ok] >> np.uint32(32 - BITS)).astype(np.int32))
        own.append(owner[:n][ok])
    return np.concatenate(ids), np.concatenate(own), np.array([len(x) for x in ids])


class LanguageModel:
    """FTRL-proximal: alpha, beta set the learning rate, l1 and l2 are the elastic net."""

    def __init__(self, samples: list[tuple[str, str]], alpha=1.0, beta=1.0, l1=0.003, l2=0.01, epochs=5, held_out=5):
        samples = [(code(lang), text) for lang, text in samples]
        self.langs = sorted({lang for lang, text in samples if lang and text}) or LANGS
        seen: dict[str, int] = {}
        rows = []
        for lang, text in samples:
            if lang and text:  # of each language one sample in held_out
                seen[lang] = seen.get(lang, -1) + 1
                rows += [(self.langs.index(lang), part, seen[lang] % held_out == 0) for part in self._parts(text)]
        self.temperature = 1.0
        d, k = 1 << BITS, len(self.langs)
        self.weights = np.zeros((d, k), dtype=np.float32)
        if not rows:
            return
        ids, own, _ = grams([t for _, t, _ in rows])
        order = np.argsort(own, kind="stable")
        ids, own = ids[order], own[order]
        bounds = np.searchsorted(own, np.arange(len(rows) + 1))
        df = np.zeros(d)
        sparse = []
        for i in range(len(rows)):
            u, n = np.unique(ids[bounds[i] : bounds[i + 1]], return_counts=True)
            df[u] += 1
            sparse.append((u, n / max(1, n.sum())))
        self.idf = np.log((1 + len(rows)) / (1 + df)) + 1
        z, n2 = np.zeros((d, k)), np.zeros((d, k))
        train = [i for i, r in enumerate(rows) if not r[2]] or list(range(len(rows)))
        rng = np.random.default_rng(7)
        for _ in range(epochs):
            for i in rng.permutation(train):
                u, tf = sparse[i]
                if not len(u):
                    continue
                x = (tf * self.idf[u] * 10)[:, None]
                zu, nu = z[u], n2[u]
                w = np.where(np.abs(zu) <= l1, 0, -(zu - np.sign(zu) * l1) / ((beta + np.sqrt(nu)) / alpha + l2))
                p = np.exp((s := (w * x).sum(0)) - s.max())
                p /= p.sum()
                p[rows[i][0]] -= 1
                g = x * p
                sigma = (np.sqrt(nu + g * g) - np.sqrt(nu)) / alpha
                z[u] = zu + g - sigma * w
                n2[u] = nu + g * g
        w = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n2)) / alpha + l2))
        self.weights = (w * self.idf[:, None] * 10).astype(np.float32)
        held = [i for i, r in enumerate(rows) if r[2]]
        if held:
            scores = self.scores([rows[i][1] for i in held])
            gold = np.array([rows[i][0] for i in held])
            best = []
            for t in np.geomspace(0.02, 20, 61):
                q = scores / t
                q = q - q.max(1, keepdims=True)
                q -= np.log(np.exp(q).sum(1, keepdims=True))
                right = q[np.arange(len(gold)), gold]
                # as if one sample more had been wrong, for a faultless set would make every confidence 1
                slip = 1 / (len(gold) + 1)
                best.append((-((1 - slip) * right + slip * (q.sum(1) - right) / max(1, len(self.langs) - 1)).mean(), t))
            self.temperature = float(min(best)[1])
            self.held_out_accuracy = float((scores.argmax(1) == gold).mean())

    @staticmethod
    def _parts(text: str) -> list[str]:
        """Whole samples and pieces of them, as short as a line may be."""
        words = text.split(" ")
        size = 40 if len(words) < 0.08 * len(text) else 8
        pieces = [text[i : i + size] for i in range(0, len(text), size)] if size == 40 else [" ".join(words[i : i + size]) for i in range(0, len(words), size)]
        return [text, *[p for p in pieces if len(p) > 12]]

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)), dtype=np.float64)
        if not texts:
            return out
        ids, own, sizes = grams(texts)
        count = np.bincount(own, minlength=len(texts))
        at = 0
        for n in sizes:
            if n:
                w = np.add.reduceat(self.weights[ids[at : at + n]], starts := np.flatnonzero(np.r_[True, own[at + 1 : at + n] != own[at : at + n - 1]]), axis=0)
                out[own[at : at + n][starts]] += w
            at += n
        return out / np.maximum(1, count)[:, None]

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        q = scores / self.temperature
        q = np.exp(q - q.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)
