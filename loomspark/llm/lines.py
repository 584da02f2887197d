"""What a line of a page looks like: counts, shape and cues, shared by problems 1, 2, 7, 9 and 10.

All lines are judged in the form that problems 4 and 5 give them.  Lines repeat very
often within a corpus, so their description is kept in a bounded memo.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import ahocorasick
import numpy as np

from .residue import PLACEHOLDER, SHARE, UNSET, VALUE, matched, residue_machine, unfilled

# Phrases of navigation, notices, prompts, legal text and the like, by kind and in six languages, separated by ";".
CUES = {
    "nav": "skip to content;skip to main;toggle navigation;back to top;all sections;sign in · register;search log in;| about | contact;menu ;zum inhalt springen;nach oben;suche anmelden;über uns | kontakt;startseite |;menü ;aller au contenu;haut de page;recherche connexion;à propos | contact;accueil |;saltar al contenido;volver arriba;buscar acceder;quiénes somos | contacto;inicio |;menú ;перейти к содержанию;наверх;поиск войти;о нас | контакты;главная |;меню ;本文へ移動;ページの先頭へ;検索 ログイン;| お問い合わせ;ホーム |;一覧を見る;メニュー ;すべての記事",
    "notice": "cookie;needs consent for statistics;store information on your device;need scripts to run;enable javascript to see;javascript aktivieren;aktivieren sie javascript;activez javascript;active javascript para ver;включите javascript, чтобы увидеть;соглашаетесь с нашими правилами;файлы cookie;クッキー;を有効にしてください",
    "prompt": "liked this? tell a friend;send this story to;share this page;share save;for free;letter and never miss;enter your e-mail;your e-mail address to join;gefällt ihnen;sagen sie es weiter;artikel teilen;teilen merken;den rundbrief von;lesern an;parlez-en autour de vous;partager cette page;partager enregistrer;abonnez-vous à la lettre;rejoignez;cuénteselo a un amigo;compartir esta página;compartir guardar;suscríbase al boletín;únase a;поделиться: почта;сохранить поделиться;подпишитесь на рассылку;с нами уже;расскажите друзьям;この記事を共有する;共有 保存;気に入ったら友だちに;お知らせメールに登録;今すぐ無料で登録",
    "legal": "imprint | privacy;terms of use;all rights reserved;is a registered name of;may be reproduced without;for general information only;not professional advice;opinions are those of the writers;may earn a commission;made with care by;impressum | datenschutz;alle rechte vorbehalten;erfolgen ohne gewähr;auch auszugsweise, nur mit;mentions légales;tous droits réservés;est interdite sans accord;sont données à titre indicatif;aviso legal | privacidad;todos los derechos reservados;prohibida la reproducción de;tiene carácter orientativo;реклама | конфиденциальность;все права защищены;без разрешения запрещена;носят справочный характер;運営会社 | 個人情報保護;無断転載を禁じ;を許可なく複製;一般的な情報であり;編集室 第",
    "related": "you may also like;related stories;most read this week;most read;more from ;das könnte sie auch interessieren;ähnliche beiträge;meistgelesen;mehr aus ;à lire aussi;sur le même sujet;les plus lus;plus de ;también le puede interesar;artículos relacionados;lo más leído;más de ;читайте также;похожие материалы;самое популярное;ещё из ;関連記事;こちらもおすすめ;今週よく読まれた記事;の他の記事",
    "tags": "tags:;tags :;schlagwörter:;mots-clés :;mots-clés:;etiquetas:;метки:;теги:;タグ ",
    "paging": "« previous;next »;zurück ;précédent ;anterior ;назад ;前へ ;page ",
}
# Short phrases of the same kinds that are common on the web; they count where they make up half of a line.
WHOLE = {
    "nav": ["skip to main content", "skip navigation", "sign in", "log in", "login", "log out", "sign up", "my account", "site map", "sitemap", "read more", "show more", "load more", "view all", "see all", "show all", "anmelden", "registrieren", "mein konto", "weiterlesen", "mehr anzeigen", "se connecter", "s'inscrire", "mon compte", "lire la suite", "voir plus", "tout afficher", "plan du site", "iniciar sesión", "registrarse", "mi cuenta", "leer más", "ver más", "ver todo", "mapa del sitio", "регистрация", "личный кабинет", "читать далее", "показать ещё", "карта сайта", "会員登録", "マイページ", "続きを読む", "もっと見る", "サイトマップ"],
    "notice": ["accept all", "reject all", "accept cookies", "cookie settings", "manage preferences", "cookie policy", "advertisement", "sponsored content", "alle akzeptieren", "alle ablehnen", "anzeige", "tout accepter", "tout refuser", "publicité", "aceptar todo", "rechazar todo", "publicidad", "принять все", "отклонить все", "すべて許可", "すべて拒否", "同意する", "広告"],
    "prompt": ["leave a reply", "leave a comment", "post a comment", "add a comment", "comments are closed", "follow us", "share on facebook", "share on twitter", "share this", "share on linkedin", "share via email", "subscribe to our newsletter", "sign up for our newsletter", "subscribe now", "print this page", "email this article", "download our app", "kommentar schreiben", "folgen sie uns", "newsletter abonnieren", "jetzt abonnieren", "seite drucken", "laisser un commentaire", "suivez-nous", "s'abonner à la newsletter", "imprimer cette page", "deja un comentario", "dejar un comentario", "síguenos", "suscríbete a nuestro boletín", "imprimir esta página", "оставить комментарий", "подписывайтесь на нас", "подписаться на рассылку", "コメントを残す", "フォローする", "メールマガジン登録"],
    "legal": ["privacy policy", "privacy statement", "terms and conditions", "terms of service", "legal notice", "do not sell my personal information", "accessibility statement", "powered by", "copyright", "datenschutzerklärung", "nutzungsbedingungen", "politique de confidentialité", "conditions d'utilisation", "política de privacidad", "términos y condiciones", "политика конфиденциальности", "пользовательское соглашение", "プライバシーポリシー", "利用規約", "特定商取引法に基づく表記"],
    "related": ["related articles", "related posts", "related content", "recommended for you", "more like this", "recent posts", "popular posts", "trending now", "ähnliche artikel", "verwandte artikel", "neueste beiträge", "articles similaires", "articles récents", "artículos recientes", "te puede interesar", "похожие статьи", "последние записи", "関連する記事", "最近の投稿", "人気の記事"],
    "tags": ["filed under", "posted in", "categories:", "category:", "tagged with", "kategorien:", "catégories :", "categorías:", "рубрики:", "カテゴリー"],
    "paging": ["previous post", "next post", "previous page", "next page", "older posts", "newer posts", "older entries", "vorherige seite", "nächste seite", "page précédente", "page suivante", "página anterior", "página siguiente", "предыдущая страница", "следующая страница", "前のページ", "次のページ"],
}
# Of these, those that open a line which names somebody.
OPENING = ("powered by", "copyright", "follow us", "filed under", "posted in", "tagged with", "share on", "folgen sie uns", "suivez-nous", "síguenos", "next post", "previous post")
# Names of sections as they stand alone in vertical menus.
SECTIONS = set("science|software|garden|forum|maps|music|events|travel|guides|kitchen|reviews|news|home|about|contact|search|wissenschaft|technik|garten|karten|musik|termine|reisen|ratgeber|küche|tests|aktuelles|sciences|logiciels|jardin|cartes|musique|agenda|voyages|cuisine|critiques|actualités|ciencia|programas|jardín|foro|mapas|música|viajes|guías|cocina|reseñas|noticias|наука|программы|техника|сад|форум|карты|музыка|афиша|поездки|советы|кухня|обзоры|новости|科学|ソフト|園芸|掲示板|地図|音楽|催し|旅行|手引き|料理|批評|ニュース".split("|"))
# Frequent words without content of each language.
FUNCTION = set("the a an of and in to is are was were it for on with as by at from that this each you we can do if when not only but whether which than us our your they their has have had der die das den dem des ein eine einen und in im zu ist sind von mit für auf nach am bei über denn als nicht wird werden zum zur gilt le la les l un une des du de d et à au aux en dans sur pour par est sont car que qui ne pas ce cette tandis avec sans el los las del una uno y al que por para con en es son se su sus porque mientras según lo в и на с по не за от до о об для из к а но что как это уже во или при потому".split())
# Words that sellers add to product names.
COMMERCE = set("buy cheap cheapest best top sale discount online wholesale official lowest price free delivery near me deals offer review reviews kaufen billig günstig angebot rabatt bester preis testsieger sofort lieferbar acheter pas cher promo soldes livraison gratuite meilleur prix avis comparatif comprar barato oferta descuento rebajas envío gratis mejor precio opiniones купить дёшево недорого скидки распродажа цена доставка отзывы оптом лучшие 激安 送料無料 通販 最安値 比較 人気 おすすめ 口コミ 新品 限定".split())

KINDS = ["", *CUES, "section", "byline", "crumb", "menu"]
NOTICE = KINDS.index("notice")
_WORD = re.compile(r"[^\W\d_]+")
_URL = re.compile(r"https?://\S+|www\.\S+")
_CJK = re.compile("[぀-ヿ一-鿿々〆]")
_RUN = re.compile("[一-鿿々ァ-ヺー]{1,}")
_END = re.compile(r"[.!?…][\"'”’»)]?(?:\s|$)|[。！？]")
_SKU = re.compile(r"\b(?:SKU|Art\.?|ref)\s?-?\d+|\b(?:XS|S|M|L|XL|XXL)\s+\d+\s?cm\b")
_NAME = r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}"
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})"
_BYLINE = re.compile(rf"(?:by|von|par|por|автор:?|written by|文・|執筆)\s*{_NAME}\b.{{0,40}}$|{_NAME}\s*(?:[|,·]|記者)\s*.{{0,24}}{_DATE}$|{_NAME} · .{{0,20}}\d+ .{{0,14}}$|{_NAME} 記者.*$|文・.{{2,30}}$|執筆 .*\d+分$", re.I)
_STRICT = re.compile(rf"(?:By|BY|Von|VON|Par|PAR|Por|POR|Автор:?|АВТОР:?|Written by|WRITTEN BY) +[A-Z]\w+ +[A-Z]\w+(?:,.{{0,40}}| · .{{0,40}}|)$|[A-Z]\w+ +[A-Z]\w+ *(?:\||,|·|記者).{{0,40}}\d[^.!?]*$|文・|執筆 ")
_TAGS = tuple(CUES["tags"].split(";"))
_BRACE = re.compile(r"[{%\[]|__")
_TAG = re.compile(r"(?<!\w)#\w")
_RIGHTS = re.compile(r"©\s*\d{4}|^\s*©|©\s*$")
_CELLS = re.compile(r"\s[|·;–-]\s|[\t、,；;・]|/ ")
_TABLE = re.compile(r"\|\s*-?\d[\d.,]*\s*(?:\||$)")
_CODE = re.compile(r"^(?: {2,}|\t)\S|^\s*(?:SELECT |curl |export |for \w+ in |def |import |fetch_\w+\(|\w+ = \w+\()")


class Line(NamedTuple):
    text: str
    kind: int  # of KINDS
    words: int
    ends: int  # sentence ends
    function: float  # share of function words or, in Japanese, of kana
    commerce: float
    links: int
    hashes: int
    cells: int  # parts between separators
    digits: float
    title: float  # share of words with a capital
    repeat: float  # share of the commonest word of content
    top: str
    code: bool
    sku: bool
    symbol: int
    cue_hits: int


SYMBOLS = "PDKWLSBCTE"  # prose, described link, keywords, stuffed sentence, link, short text, boilerplate, code, table, empty


def _machine(phrases) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, value in phrases:
        if phrase:
            a.add_word(phrase, value)
    a.make_automaton()
    return a


#: Part of a long line, beyond its first 220 characters, that cue phrases must match.
CUED = 0.1


class Lines:
    MEMO = 100_000

    def __init__(self):
        kinds = list(CUES)
        whole = {p: (kinds.index(k) + 1, len(p), True) for k, v in WHOLE.items() for p in v}
        self.cues = _machine({**whole, **{p: (k, len(p), False) for k, v in enumerate(CUES.values(), 1) for p in v.split(";")}}.items())
        self.residue = residue_machine()
        self.memo: dict[str, Line] = {}
        self.found: dict[str, tuple[int, bool]] = {}

    def line(self, raw: str) -> Line:
        got = self.memo.get(raw)
        if got is None:
            got = self._line(raw)
            if len(self.memo) < self.MEMO and len(raw) < 400:
                self.memo[raw] = got
        return got

    def _kind(self, flat: str, low: str) -> tuple[int, int]:
        best, size, hits, matched, part, short = 0, 0, 0, 0, 0, 0
        if low.startswith(_TAGS):
            return KINDS.index("tags"), 1
        for end, (k, n, whole) in self.cues.iter(low):
            name = KINDS[k]
            start = end - n + 1
            if whole:
                if not (low[start - 1 : start].isalpha() or low[end + 1 : end + 2].isalpha()) or low[end] > "\u3040":
                    part += n
                    short = short or (k if start == 0 or name != "tags" else 0)
                continue
            if name in ("tags", "paging", "related") and start > 0 and not (name == "paging" and "next »" == low[start : end + 1]):
                continue
            if name == "paging" and len(low) > 40:
                continue
            if name == "related" and len(low) > 48:
                continue
            if name == "nav" and low[start : end + 1] in ("menu ", "menú ", "menü ", "меню ", "メニュー ") and (start or not re.search("[|·]|log in|anmelden|connexion|acceder|войти|ログイン", low)):
                continue
            if name == "prompt" and low[start : end + 1] in ("for free", "rejoignez", "únase a") and (len(low) > 60 or low.endswith(".")):
                continue
            hits += 1
            matched += n
            if n > size:
                best, size = k, n
        if matched < CUED * (len(low) - 220):
            best, hits = 0, 0  # a paragraph that mentions such a phrase
        if best and KINDS[best] == "paging" and not re.search(r"\d", low):
            best = 0
        if not best and short and (part >= 0.5 * len(low) or len(low) < 80 and low.startswith(OPENING)) and not _END.search(flat[:-1]):
            best, hits = short, 1
        if not best:
            if low in SECTIONS:
                best = KINDS.index("section")
            elif len(flat) < 90 and (_STRICT.match(flat)) and not _END.search(flat):
                best = KINDS.index("byline")
            elif re.fullmatch(r"[^>.!?。]{1,40}(?: > [^>.!?。]{1,110}){1,4}", flat):
                best = KINDS.index("crumb")
            elif "©" in flat and len(flat) < 120 and _RIGHTS.search(flat):
                best = list(CUES).index("legal") + 1
            elif len(flat) < 120 and (parts := [p for p in re.split(r"\s*[|·]\s*", low) if p]) and len(parts) > 1 and sum(p in SECTIONS or any(w in SECTIONS for w in p.split()) for p in parts) >= 0.5 * len(parts):
                best = KINDS.index("menu")
            elif 1 < len(ws := low.split()) <= 6 and all(w in SECTIONS or w in "|·»-" for w in ws):
                best = KINDS.index("menu")
        return best, hits

    def _line(self, raw: str) -> Line:
        flat = " ".join(raw.split())
        if not flat:
            return Line("", 0, 0, 0, 0.0, 0.0, 0, 0, 0, 0.0, 0.0, 0.0, "", False, False, 9, 0)
        low = flat.lower()
        kind, hits = self._kind(flat, low)
        urls = len(_URL.findall(flat)) if "http" in flat or "www." in flat else 0
        bare = _URL.sub(" ", flat) if urls else flat
        words = _WORD.findall(bare)
        plain = flat.isascii()
        cjk = 0 if plain else len(_CJK.findall(bare))
        lows = [w.lower() for w in words]
        if cjk > 0.25 * max(1, len(bare)):
            kana = sum("ぁ" <= c <= "ゟ" for c in bare)
            n = max(1, cjk // 2 + sum(w.isascii() for w in words))
            function = kana / cjk
            runs = _RUN.findall(bare)
            commerce = min(1.0, sum(bare.count(w) * len(w) for w in COMMERCE if not w.isascii() and w in bare) / cjk)
        else:
            n = len(words) + cjk // 2
            function = sum(map(FUNCTION.__contains__, lows)) / max(1, n)
            commerce = sum(map(COMMERCE.__contains__, lows)) / max(1, n)
            runs = [w for w in lows if len(w) > 2 and w not in FUNCTION and w not in COMMERCE]
        top, repeat, count = "", 0.0, 0
        if runs:
            of = Counter(runs)
            top = max(of, key=of.__getitem__)
            count = of[top]
            repeat = count / max(1, len(runs) if cjk > 0.25 * len(bare) else n)
        ends = len(_END.findall(bare))
        hashes = len(_TAG.findall(bare)) if "#" in bare else 0
        cells = len(_CELLS.split(flat))
        digits = sum(map(flat.count, "0123456789")) / len(flat)
        title = sum(w[0].isupper() for w in words) / max(1, len(words)) if len(words) < 20 else 0.0
        code, sku = bool(_CODE.match(raw)), bool(_SKU.search(flat))
        table = "|" in flat and bool(_TABLE.search(flat))
        japanese = cjk > 0.25 * max(1, len(bare))
        if kind:
            symbol = "B"
        elif code:
            symbol = "C"
        elif table or low in UNSET or VALUE.fullmatch(low) or (_BRACE.search(flat) and PLACEHOLDER.search(flat) and not ends):
            symbol = "T"
        elif sku or hashes >= 2 or (hashes == 1 and flat[0] == "#" and n <= 4):
            symbol = "K"
        elif urls and n >= 6 and ends and commerce < 0.3:
            symbol = "D"
        elif urls or flat.endswith(">>") or re.fullmatch(r"\[[^\]]+\]\([^)]+\)", flat):
            symbol = "L"
        elif count >= 3 and repeat >= 0.13 and ends and n >= 8:
            symbol = "W"
        elif n >= 8 and not ends and (commerce >= 0.18 or repeat >= 0.2 and not (japanese and function > 0.3) and "\ufffd" not in flat) or (commerce >= 0.3 and n + japanese >= 2 and not ends) or (n >= 12 and commerce >= 0.3):
            symbol = "K"
        elif ends and n >= 3:
            symbol = "P"
        elif n >= 14 and (function > 0.15 or japanese and function > 0.3) and not (title > 0.6):
            symbol = "P"
        elif n >= 12 and cells >= 4 and function < 0.12:
            symbol = "K"
        else:
            symbol = "S"
        return Line(flat, kind, n, ends, function, commerce, urls, hashes, cells, digits, title, repeat, top, code, sku, SYMBOLS.index(symbol), hits)

    def residue_in(self, title: str | None, lines: list[Line]) -> bool:
        """Problem 2 for one document, in normal form."""
        if title:
            t = " ".join(title.split())
            if t.lower() in UNSET or unfilled(t):
                return True
        total = covered = 0
        for x in lines:
            if not x.text:
                continue
            size = len(x.text)
            known = self.found.get(x.text)
            if known is None:
                known = matched(self.residue, x.text.lower())
                if len(self.found) < self.MEMO and size < 400:
                    self.found[x.text] = known
            part, opened = known
            if opened and not x.code and unfilled(x.text):
                return True
            if not x.kind or x.kind == NOTICE:  # navigation around a message doesn't count
                total += size
                covered += part
        return covered >= SHARE * total > 0


# Problem 1: a hidden Markov model over the symbols of lines.
STATES = ["prose", "link list", "tag list", "menu"]
#: Two more observations: a short line of a page without links and keywords, and one of a page of nothing but short lines.
UNLINKED, NAKED = len(SYMBOLS), len(SYMBOLS) + 1
# Where the fit begins and what its prior counts; rows of states, columns of SYMBOLS.
EMIT = [
    [0.62, 0.10, 0.004, 0.010, 0.006, 0.10, 0.01, 0.05, 0.05, 0.05],
    [0.010, 0.02, 0.05, 0.002, 0.58, 0.31, 0.006, 0.001, 0.001, 0.02],
    [0.010, 0.002, 0.56, 0.30, 0.03, 0.075, 0.002, 0.001, 0.01, 0.01],
    [0.02, 0.002, 0.004, 0.002, 0.004, 0.30, 0.62, 0.001, 0.007, 0.04],
]
#: A short line where no list is likely in a list, and on a page of nothing else in prose or a menu.
UNLIKELY = 0.002
MOVE = [[0.86, 0.02, 0.02, 0.10], [0.05, 0.88, 0.04, 0.03], [0.05, 0.03, 0.89, 0.03], [0.16, 0.02, 0.02, 0.80]]
START = [0.4, 0.07, 0.08, 0.45]


def tied(emit: np.ndarray) -> np.ndarray:
    """Emissions from counts.  The three kinds of short lines are one sign on pages of different kinds, so its share of a state's
    lines holds for each kind that the state may have."""
    share = emit / emit.sum(1, keepdims=True)
    out = np.full((4, NAKED + 1), UNLIKELY)
    out[:, : len(SYMBOLS)] = share[:, : len(SYMBOLS)]
    short = share[:, 5] + share[:, UNLINKED:].sum(1)
    out[:, 5] = short
    out[[0, 3], UNLINKED] = short[[0, 3]]
    out[[1, 2], NAKED] = short[[1, 2]]
    return out


def observations(lines: list[Line], title: Line | None = None) -> list[int]:
    """What the model sees of a page: the title, if there is one, and the lines.

    A stuffed sentence counts as such only if its word rules the page."""
    symbols = [x.symbol for x in lines]
    if 3 in symbols:
        words = [w.lower() for x in lines if x.symbol in (0, 2, 3) for w in (_RUN.findall(x.text) if _CJK.search(x.text) else _WORD.findall(x.text))]
        one = Counter(w for w in words if w not in FUNCTION and w not in COMMERCE and (len(w) > 2 or not w.isascii()))
        two = Counter(p for p in zip(words, words[1:]) if p[0] in one)
        most, pair = max(one.values(), default=0) / max(1, len(words)), max(two.values(), default=0) / max(1, len(words))
        enough = max(one.values(), default=0) >= 6
        if not (enough and (most >= 0.3 if any(not w.isascii() and _CJK.match(w) for w in words) else most >= 0.19 or pair >= 0.12)):
            symbols = [0 if s == 3 else s for s in symbols]
    seen = set(symbols)
    if title and title.text:
        symbols.insert(0, 5 if title.symbol in (3, 6) else title.symbol)
    if not seen & {0, 1, 7, 8, 6} and symbols.count(5) >= 6:
        return [NAKED if s == 5 else s for s in symbols]
    if not seen & {2, 3, 4} and (seen & {0, 1, 7, 8} or symbols.count(5) < 6):
        return [UNLINKED if s == 5 else s for s in symbols]
    return symbols


class Spam:
    """Labels lines by Viterbi's algorithm; a page is spam if its link and tag words are at least half of those outside of menus."""

    SHARE, LEAST = 0.5, 6
    #: Lines that the prior of each state counts as; rounds of the fit; lines that it handles at a time.
    PRIOR, ROUNDS, LINES = 400, 5, 200_000

    def __init__(self, emit=EMIT, move=MOVE, start=START):
        self.set(tied(np.pad(np.array(emit), ((0, 0), (0, 2)))), np.array(move), np.array(start))

    def set(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> None:
        self.p = [emit, move / move.sum(-1, keepdims=True), start / start.sum()]
        e, m, self.start = (np.log(x).tolist() for x in self.p)
        self.columns = [tuple(row[o] for row in e) for o in range(len(e[0]))]
        self.move = [tuple(row[k] for row in m) for k in range(4)]

    def fit(self, pages: list[list[int]], rounds: int = ROUNDS) -> "Spam":
        """Baum-Welch over observed pages, with EMIT, MOVE and START as prior counts."""
        seen = Counter(bytes(p) for p in pages if p)
        for _ in range(rounds if seen else 0):
            self.update(*self.expected(seen))
        return self

    def update(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> None:
        """Takes what `expected` gives for all pages, or its sum over parts of them."""
        prior = np.pad(np.array(EMIT), ((0, 0), (0, 2))), np.array(MOVE), np.array(START)
        emit, move, start = (p * self.PRIOR + x for p, x in zip(prior, (emit, move, start)))
        self.set(tied(emit), move, start)

    def expected(self, seen: dict[bytes, int]) -> list[np.ndarray]:
        """Expected counts of emissions, moves and starts over observed pages and how often each occurs."""
        total = [np.zeros((4, NAKED + 1)), np.zeros((4, 4)), np.zeros(4)]
        part, lines = [], 0
        for page in filter(None, seen):
            if part and lines + len(page) > self.LINES:
                total, part, lines = [x + y for x, y in zip(total, self._expected(part, [seen[p] for p in part]))], [], 0
            part.append(page)
            lines += len(page)
        return [x + y for x, y in zip(total, self._expected(part, [seen[p] for p in part]))] if part else total

    def _expected(self, pages: list[bytes], times: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward over many pages at once: rows in order of line number, longest page first, so that the pages that have a next line come first."""
        b, a, pi = self.p
        n = len(pages)
        order = sorted(range(n), key=lambda i: -len(pages[i]))
        sizes = np.array([len(pages[i]) for i in order])
        ends = np.searchsorted(-sizes, -np.arange(sizes[0]))  # pages of more than t lines
        at = np.concatenate([[0], np.cumsum(ends)])
        owner = np.repeat(np.arange(n), sizes)
        place = at[np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] + owner
        o, w = np.empty(len(owner), dtype=np.int64), np.empty(len(owner))
        o[place] = np.frombuffer(b"".join(pages[i] for i in order), dtype=np.uint8)
        w[place] = np.array(times, dtype=float)[order][owner]
        e = b.T[o]
        f, back = np.empty(e.shape), np.ones(e.shape)
        for t in range(len(ends)):
            here = slice(at[t], at[t + 1])
            v = (f[at[t - 1] : at[t - 1] + ends[t]] @ a if t else pi) * e[here]
            c = v.sum(1, keepdims=True)
            f[here] = v / c
            e[here] /= c
        for t in range(len(ends) - 2, -1, -1):
            here = slice(at[t + 1], at[t + 2])
            back[at[t] : at[t] + ends[t + 1]] = (e[here] * back[here]) @ a.T
        gamma = f * back * w[:, None]
        before = np.arange(n, len(o)) - np.repeat(ends[:-1], ends[1:])
        move = a * (f[before].T @ (e[n:] * back[n:] * w[n:, None]))
        return np.array([np.bincount(o, g, NAKED + 1) for g in gamma.T]), move, gamma[:n].sum(0)

    def label(self, observed: list[int]) -> list[int]:
        if not observed:
            return []
        e = self.columns
        (a0, a1, a2, a3), (b0, b1, b2, b3), (c0, c1, c2, c3), (d0, d1, d2, d3) = self.move
        v0, v1, v2, v3 = (x + y for x, y in zip(self.start, e[observed[0]]))
        back = []
        for o in observed[1:]:
            x = (v0 + a0, v1 + a1, v2 + a2, v3 + a3)
            y = (v0 + b0, v1 + b1, v2 + b2, v3 + b3)
            z = (v0 + c0, v1 + c1, v2 + c2, v3 + c3)
            w = (v0 + d0, v1 + d1, v2 + d2, v3 + d3)
            v0, v1, v2, v3 = max(x), max(y), max(z), max(w)
            back.append((x.index(v0), y.index(v1), z.index(v2), w.index(v3)))
            f0, f1, f2, f3 = e[o]
            v0, v1, v2, v3 = v0 + f0, v1 + f1, v2 + f2, v3 + f3
        v = (v0, v1, v2, v3)
        s = v.index(max(v))
        out = [s]
        for b in reversed(back):
            s = b[s]
            out.append(s)
        return out[::-1]

    def counts(self, lines: list[Line], title: Line | None = None) -> tuple[int, int, int, int, list[int]]:
        """Words of prose, link lists, tag lists and menus, and the labels; every page is decoded."""
        return self.sums(observations(lines, title), [x.words + x.links for x in lines])

    def sums(self, observed, words: list[int]) -> tuple[int, int, int, int, list[int]]:
        """The same of what is observed of a page and the words of each of its lines."""
        states = self.label(observed)
        states = states[len(states) - len(words) :]
        n = [0, 0, 0, 0]
        for s, x in zip(states, words):
            n[s] += x
        return *n, states
