"""Problem 2: unfilled templates, filler, error pages and notices that scripts are required.

One Aho-Corasick automaton holds the phrases of all languages, the words of filler Latin, unset
values, and what opens a placeholder or a stack trace.  A record is left out when the matched
characters are at least SHARE of its text outside of navigation, whatever the length of its lines.
Placeholders are no running text, so that one is enough: where the automaton meets an opener, a
pattern tells whether a placeholder stands there, and a sentence that speaks about such marks
keeps it.  Null and empty texts hold no residue.
"""

from __future__ import annotations

import re
from itertools import product

import ahocorasick

#: Matched part of the text at which a record is left out.
SHARE = 0.5

# Filler, errors, maintenance, blocking and script messages of pages.
PHRASES = [
    "your text goes here", "insert description here", "this is placeholder copy, replace before launch", "placeholder copy", "todo write this section", "sample heading", "click here to edit", "welcome to wordpress. this is your first post", "hello world!", "just another wordpress site",
    "hier steht ihr text", "blindtext bitte ersetzen", "überschrift einfügen", "votre texte ici", "texte provisoire à remplacer", "insérer un titre", "su texto aquí", "texto de relleno, sustituir", "insertar título", "здесь будет ваш текст", "текст-заглушка, замените", "введите заголовок",
    "ダミーテキストです", "この文章は仮のものです", "見出しを入力してください", "ここに文章が入ります",
    "checking your browser before access. this takes about", "checking your browser before accessing", "this process is automatic. your browser will redirect to your requested content shortly", "verify that you are human", "checking if the site connection is secure", "verifying you are human. this may take a few seconds", "seconds", "you need to turn on javascript to start this app", "this site requires scripts and cookies",
    "loading... please wait", "javascript is disabled in your browser. turn it on and reload the page", "enable cookies", "attention required!", "ray id:", "performance & security by",
    "page not found", "the page you are looking for may have been moved or deleted", "the page you requested could not be found", "the requested url was not found on this server", "404 not found", "not found", "404 error", "error 404", "oops! we can't find that", "oops! something went wrong", "something went wrong", "oops", "we can't find the page you're looking for", "nothing was found at this location",
    "access denied", "your request was blocked by our firewall", "you don't have permission to access this resource", "you do not have access to this resource", "forbidden", "403 forbidden", "you have been blocked", "sorry, you have been blocked",
    "bad gateway", "502 bad gateway", "gateway timeout", "internal server error", "500 internal server error", "the server encountered an internal error or misconfiguration and was unable to complete your request", "the server met a problem and could not finish your request. reference", "please try again later", "try again later", "your session has expired. please log in again", "too many requests. slow down and retry later", "too many requests",
    "service temporarily unavailable. please try again in", "service temporarily unavailable", "service unavailable", "temporarily down for scheduled maintenance", "down for maintenance", "under maintenance", "scheduled maintenance", "we'll be back soon", "we will be back shortly", "minutes",
    "database connection failed: too many connections", "error establishing a database connection", "this domain is parked. contact the owner for an offer", "this domain is for sale", "this site is under construction", "coming soon", "this article is no longer available", "this account has been suspended",
    "ihr browser wird geprüft, bitte warten", "die angeforderte seite existiert nicht mehr", "zugriff verweigert", "seite nicht gefunden. fehler", "seite nicht gefunden", "wartungsarbeiten: wir sind in", "minuten zurück", "interner serverfehler. bitte versuchen sie es später erneut", "interner serverfehler", "wegen wartungsarbeiten nicht erreichbar", "diese domain steht zum verkauf",
    "vérification de votre navigateur en cours", "cette page n’existe plus ou a été déplacée", "page introuvable. erreur", "page introuvable", "page non trouvée", "erreur interne du serveur, code", "erreur interne du serveur", "accès refusé", "site en maintenance, retour dans", "site en maintenance", "une erreur est survenue",
    "comprobando su navegador, espere", "la página que busca ya no existe", "página no encontrada. error", "página no encontrada", "error interno del servidor, código", "error interno del servidor", "acceso denegado", "sitio en mantenimiento, volvemos en", "sitio en mantenimiento", "minutos", "se ha producido un error",
    "проверяем ваш браузер, подождите", "запрошенная страница больше не существует", "страница не найдена. ошибка", "страница не найдена", "внутренняя ошибка сервера, код", "внутренняя ошибка сервера", "доступ запрещён", "доступ запрещен", "ведутся технические работы", "идут технические работы, вернёмся через", "сайт временно недоступен", "минут",
    "読み込み中です。しばらくお待ちください", "スクリプトが無効になっています。設定を変更してください", "ブラウザを確認しています", "ページが見つかりません。住所を確認してください", "ページが見つかりません", "お探しのページは移動または削除された可能性があります", "お探しのページは見つかりませんでした", "アクセスが拒否されました", "サーバーエラーが発生しました。時間をおいて再度お試しください。番号", "サーバーエラーが発生しました", "ただいまメンテナンス中です", "メンテナンス中", "時に再開します",
    "pagina non trovata", "la pagina richiesta non esiste", "accesso negato", "errore interno del server", "página não encontrada", "acesso negado", "pagina niet gevonden", "toegang geweigerd", "strona nie została znaleziona", "sidan kunde inte hittas",
]
# How a notice that scripts are required is put together, by language; every choice of the parts is a phrase.
SCRIPTS = [
    [["", "please "], ["enable", "turn on", "activate", "allow"], [" "], ["javascript", "scripts", "cookies", "javascript and cookies"], ["", " to continue", " to go on", " to view this page", " in your browser", " in your browser settings"]],
    [["this app", "this site", "this page", "this website"], [" "], ["requires", "needs", "works best with"], [" "], ["javascript", "scripts", "javascript to run", "javascript enabled"]],
    [["you need to enable javascript to run this app", "javascript is required", "javascript is disabled", "javascript must be enabled", "your browser does not support javascript"]],
    [["bitte ", ""], ["aktivieren sie"], [" "], ["javascript", "cookies"], ["", " in ihrem browser", ", um fortzufahren"]],
    [["diese anwendung benötigt", "diese seite benötigt", "diese website benötigt"], [" javascript"]],
    [["veuillez activer", "merci d'activer", "activez"], [" javascript"], ["", " pour continuer", " dans votre navigateur"]],
    [["cette application nécessite", "ce site nécessite", "cette page nécessite"], [" javascript"]],
    [["active", "habilite", "por favor, active"], [" javascript"], ["", " para continuar", " en su navegador"]],
    [["esta aplicación necesita", "este sitio necesita", "esta página requiere", "este sitio requiere"], [" javascript"]],
    [["включите javascript"], ["", ", чтобы продолжить", " в вашем браузере", " в настройках браузера"]],
    [["для работы сайта нужен javascript", "для работы сайта необходим javascript", "javascript отключен в вашем браузере"]],
    [["このサイトを表示するには", "続けるには", ""], ["javascriptを有効に"], ["してください"]],
    [["abilita javascript", "ative o javascript", "schakel javascript in"], ["", " per continuare", " para continuar", " om door te gaan"]],
]
# Words of filler Latin.
LATIN = set("lorem ipsum nullam amectu adipra exeat velitas eiusma dolura incidu consel nisiut exerci ullamor pariatur laborem tempra quiset commora elitum aliquem irurem cillor minivra enimat sitra duisur sedor magnor nostrel fugiat dolen dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla excepteur sint occaecat cupidatat non proident sunt culpa officia deserunt mollit anim est laborum".split())
# What placeholders look like.
PLACEHOLDER = re.compile(r"\{\{\{?\s*[\w.]+\s*\}?\}\}|\$\{[\w.]+\}|#\{[\w.]+\}|<%=?\s*[\w.]+\s*%>|\{%\s*[\w ._]+\s*%\}|%%[\w.]+%%|\[\[\s*[\w.]+\s*\]\]|(?<!\w)__[A-Za-z][\w.]*?[A-Za-z]__(?!\w)|\[(?:INSERT|insert|Insert) [\w ]+ (?:HERE|here|Here)\]|(?<![\w$#{])\{[A-Za-z][\w.]*\}(?!\})")
# What opens them.
OPENERS = ["{", "<%", "%%", "[[", "__", "[insert "]
# Words of sentences that speak about such marks instead of leaving them.
ABOUT = re.compile(r"\btokens?\b|templates?\b|placeholder|\bshell\b|syntax|Platzhalter|Vorlage|balise|modèle|la marca \{|marcador|plantilla|\bМетка\b|шаблон|雛形|記号|export |load\(|[“„«「`]\s*[{$#<%_\[]", re.I)
# Defaults and unset values.
UNSET = {"undefined", "null", "none", "nan", "[object object]", "[title missing]", "untitled document", "untitled", "new page 1", "new page", "no title", "(no title)", "title", "n/a", "nil", "ohne titel", "sans titre", "sin título", "без названия", "無題", "無題ドキュメント"}
# What a stack trace or a value that isn't set holds.
ANCHORS = ["traceback", "file \"", "error", "exception", "warning", "notice", " on line ", "at ", "undefined", "null", "none", "nan", "[object object]"]
_FAULT = re.compile(r"traceback \(most recent call last\):|file \".*\", line \d+, in .+|\w*(?:error|exception): .{0,80}|(?:warning|notice|fatal error|parse error): .* on line \d+|at [\w.$]+\(.*:\d+\)")
VALUE = re.compile(r".{0,80}: (?:undefined|null|none|nan|\[object object\])")
_SENTENCE = re.compile(r"(?<=[.!?。])")
_GAP = re.compile(r"[\W\d_]*")


def residue_machine() -> ahocorasick.Automaton:
    """Patterns in lower case with (what, length); what is the phrase, latin, open, unset or anchor."""
    known: dict[str, str] = {}
    for what, words in (("anchor", ANCHORS), ("open", OPENERS), ("latin", LATIN), ("phrase", ["".join(x) for parts in SCRIPTS for x in product(*parts)]), ("phrase", PHRASES)):
        for w in words:
            known[w] = what
    a = ahocorasick.Automaton()
    for w, what in known.items():
        a.add_word(w, (what, len(w)))
    a.make_automaton()
    return a


def unfilled(text: str) -> bool:
    """Does a sentence of the text hold a placeholder without speaking about it?"""
    masked = PLACEHOLDER.sub("{x}", text)
    return masked != text and any("{x}" in part and not ABOUT.search(part) for part in _SENTENCE.split(masked))


def matched(machine: ahocorasick.Automaton, low: str) -> tuple[int, bool]:
    """(characters of a line that phrases cover, may it hold a placeholder).  Signs and digits between two matches count as matched."""
    size = len(low)
    if low in UNSET:
        return size, False
    spans, opened, anchored = [], False, False
    for end, (what, n) in machine.iter(low):
        a, b = end - n + 1, end + 1
        if what == "open":
            opened = True
        elif what == "anchor":
            anchored = True
        elif low[end] >= "぀" or not (low[a - 1 : a].isalpha() or low[b : b + 1].isalpha()):  # whole words
            spans.append((a, b))
    if anchored and (_FAULT.fullmatch(low) or VALUE.fullmatch(low)):
        return size, opened
    part = at = 0
    for a, b in sorted(spans):
        if b > at:
            if a > at and _GAP.fullmatch(low, at, a):
                a = at
            part += b - max(a, at)
            at = b
    if part and _GAP.fullmatch(low, at, size):
        part += size - at
    return part, opened
