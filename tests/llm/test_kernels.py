"""The models by themselves: round trips, held-out accuracy, brute force."""

import itertools
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomspark.llm.bodies import Bodies, blocks, teach
from loomspark.llm.encodings import LOST, Encodings, garble
from loomspark.llm.langid import LANGS, LanguageModel, code
from loomspark.llm.leaks import Items, tokens
from loomspark.llm.lines import CUES, KINDS, NAKED, UNLINKED, Lines, Spam, observations
from loomspark.llm.lookalikes import Lookalikes
from loomspark.llm.packing import plan
from loomspark.llm.pages import Analyzer
from loomspark.llm.reading import Ranker, features
from loomspark.llm.trees import Boosted, isotonic


@pytest.fixture(scope="module")
def samples(data):
    t = pq.read_table(f"{data}/lang_samples.parquet").to_pydict()
    return list(zip(t["lang"], t["text"]))


@pytest.fixture(scope="module")
def encodings(samples):
    return Encodings(samples)


@pytest.mark.parametrize("right,wrong,times,lang", [("utf-8", "w1252", 1, "fr"), ("utf-8", "w1252", 2, "de"), ("utf-8", "latin-1", 1, "es"), ("utf-8", "cp437", 1, "fr"), ("utf-8", "cp1251", 1, "ru"), ("koi8_r", "cp1251", 1, "ru"), ("cp1251", "koi8_r", 1, "ru"), ("cp932", "w1252", 1, "ja"), ("euc_jp", "w1252", 1, "ja"), ("w1252", "mac_roman", 1, "fr"), ("w1252", "cp1251", 1, "de")])
def test_encoding_round_trip(samples, encodings, right, wrong, times, lang):
    texts = [t for g, t in samples if g == lang and not t.isascii()][:20]
    back = [encodings.text(garble(t, right, wrong, times)) for t in texts]
    assert sum(hit for _, hit in back) >= 0.9 * len(texts)
    assert sum(a == b for a, (b, _) in zip(texts, back)) >= 0.8 * len(texts)


def test_encoding_clean(samples, encodings):
    assert not any(encodings.text(t)[1] for _, t in samples)
    for t in ("The log showed the pair “Ã©” where the source had “é”.", "SÃO VELTOR ES UNA GUÍA.", "EN MAJUSCULES, ON ÉCRIT « ÂGE » ET « FORÊT ».", "Únase a 111 lectores", "設定ﾌｧｲﾙを保存しました。", "", None, "НАЗАД 4 ВПЕРЁД"):
        assert encodings.text(t) == (t, False)
    assert encodings.text(f"caf{LOST} here")[1] and not encodings.text(f"the mark “{LOST}” here")[1]
    long = "naÃ¯ve " + "word " * 50_000
    assert encodings.text(long)[0].startswith("naïve word")


@pytest.mark.parametrize("text,damaged", [
    ("??? ????????: ?????? ????", True), ("Fanorfa: ?????? ??????????", True), ("?????????? ????????? ?????? ??????????.", True), ("The library opens.\n?????? ?????? ??????, ? ?????????? ?????.\nIt closes.", True),
    ("Notes from the na?ve reader", True), ("Z??rich in winter", True), ("??? Dolyor", True), ("He wrote ????? on the card.", True), ("Город ???? стоит здесь", True), ("une ?cole et un ?l?ve", True),
    ("The Russian word «?????» stands here.", False), ("It printed “?????? ????” once.", False), ("Vraiment ???", False), ("Are you sure??? Yes.", False), ("Vous aimez Castor ? Parlez-en autour de vous", False), ("Quoi ??? Non ???", False),
    ("https://a.example/x?id=3&y=4 and a.example/page?q", False), ("INSERT INTO t VALUES (?, ?, ?)", False), ("const x = a ?? b ?? c;", False), ("何ですか???はい", False), ("本当?はい", False), ("Price: ???", False), ("???", False), ("What? Why? How?", False),
])
def test_lost_to_question_marks(encodings, samples, text, damaged):
    assert encodings.text(text) == (text, damaged)
    assert Analyzer(samples).field(text)[1] is damaged


@pytest.mark.parametrize("text,restored", [
    ("Notizen ¸ber die Redaktion", "Notizen über die Redaktion"), ("Die Suchseite ˆffnet die Anmeldung der G‰ste", "Die Suchseite öffnet die Anmeldung der Gäste"), ("Popular naÔve website", "Popular naïve website"),
    ("Bazen: cafÈ short hill", "Bazen: café short hill"), ("ìDoî you know the dry list? ñ It is green.", "“Do” you know the dry list? – It is green."), ("Le petit musÈe, mode díemploi", "Le petit musée, mode d’emploi"), ("Thisís the repair guide", "This’s the repair guide"),
])
def test_one_character_gives_damage_away(encodings, text, restored):
    assert encodings.text(text) == (restored, True)


@pytest.mark.parametrize("text", ["Únase a 66 lectores", "SI CONTINÚA EN TAMLUN, ACEPTA NUESTRA POLÍTICA.", "Sign in · Register · Music", "El país está en la letra ñ del mapa", "The Spanish letter ñ is rare", "El País is a paper of the capital", "A pack of 5‰ and 20 °C", "Los días pasan", "The log showed “cafÈ” once", "it´s fine", "#чехлыотзывы", "отзывы удочки >>", "l’Île et l’Étoile"])
def test_no_damage(encodings, text):
    assert encodings.text(text) == (text, False)


def test_lookalikes():
    a = Lookalikes()
    for raw, plain in (("ｂｅｓｔ", "best"), ("cоst", "cost"), ("été", "été"), ("no​tes on", "notes on"), ("a b　c", "a b c"), ("ﾊﾞｯｸ", "バック"), ("ﬁrst", "first"), ("⽇本", "日本"), ("Тhe", "The"), ("фaйл", "файл")):
        assert a.rewrite(raw) == plain
        assert a.rewrite(plain) == plain
    for t in ("担当者👩‍💻が", "「はい」、どうぞ！？", "“quoted” – dash…", "Москва and London", "№ 5", None, ""):
        assert a.rewrite(t) == t
    assert a.root("Ａ") == a.root("А") == a.root("Α") == a.root("A")
    # the more frequent member of a class stands for it
    assert Lookalikes({"А": 10}).by_shape["A", "cyrillic"][0] == "А"
    assert Lookalikes({"у": 9, "ү": 1}).by_shape["y", "cyrillic"][0] == "у" and Lookalikes({"у": 1, "ү": 9}).by_shape["y", "cyrillic"][0] == "ү"
    for raw, plain in (("раураl.com", "paypal.com"), ("ϲat", "cat"), ("ТЕSТ", "TEST"), ("кoмпьютер", "компьютер"), ("5 µm", "5 μm"), ("in вavel", "in bavel")):
        assert a.rewrite(raw) == plain


def test_lookalikes_by_the_public_table(spark):
    from loomspark.llm.lookalikes import shapes_of

    shapes = shapes_of(spark)
    assert len(shapes) > 500
    a = Lookalikes(None, shapes)
    for raw, plain in (("Ꭺpple", "Apple"), ("ꓮpple", "Apple"), ("раураl.com", "paypal.com"), ("ТЕSТ", "TEST"), ("Москва", "Москва"), ("конференция", "конференция"), ("гoрод", "город")):
        assert a.rewrite(raw) == plain == a.rewrite(plain)


def test_spam_viterbi_is_the_best_path():
    m, rng = Spam(), random.Random(3)
    emit, move, start = m.p
    score = lambda p, s: start[p[0]] * emit[p[0]][s[0]] * np.prod([move[a][b] * emit[b][o] for a, b, o in zip(p, p[1:], s[1:])])
    for _ in range(40):
        s = [rng.randrange(12) for _ in range(rng.randrange(1, 6))]
        best = max(itertools.product(range(4), repeat=len(s)), key=lambda p: score(p, s))
        assert score(m.label(s), s) == pytest.approx(score(best, s))
    assert m.label([]) == []


def test_spam_fit_raises_the_likelihood():
    rng = random.Random(4)
    pages = [[rng.choice([0, 0, 0, 1, 5]) for _ in range(9)] + [rng.choice([2, 2, 4]) for _ in range(6)] for _ in range(60)]

    def likelihood(m):
        total = 0.0
        for o in pages:
            v = m.p[2] * m.p[0][:, o[0]]
            for x in o[1:]:
                total += np.log(v.sum())
                v = (v / v.sum()) @ m.p[1] * m.p[0][:, x]
            total += np.log(v.sum())
        return total

    new = Spam().fit(pages)
    assert likelihood(new) > likelihood(Spam()) and np.allclose(new.p[1].sum(1), 1)
    assert np.allclose(Spam().fit([]).p[0], Spam().p[0])


def test_observations():
    short = page("\n".join(f"Velo {i}" for i in range(7)))
    assert set(observations(short)) == {NAKED} and len(observations(short, short[0])) == 8
    assert UNLINKED in observations(page("The library opens at nine and closes at six.\nOpening hours"))
    assert observations([]) == []


def page(text):
    return [LINES.line(x) for x in text.split("\n")]


LINES = Lines()


@pytest.mark.parametrize("text,spam", [
    ("buy cheap shoes cheap shoes best shoes online shoes discount shoes buy shoes sale shoes\n" * 3, True),
    ("\n".join(f"cheap tents: https://a{i}.example/x{i}\nVelo {i}" for i in range(12)), True),
    ("#shoessale #tentsbuy #lampscheap #shoessale #tentsbuy #lampscheap", True),
    ("Our tents are the best tents if you need tents with cheap tents. Buy tents in Bern means tents, tents and more tents.\n" * 3, True),
    ("The library opens at nine and closes at six. Readers may borrow ten books.\nIn winter it closes early.", False),
    ("\n".join(f"Site {i}: The archive describes old maps and rare books in detail. https://b{i}.example/" for i in range(6)), False),
    ("The library opens at nine and closes at six. Readers may borrow ten books at a time.\nTags: books, library", False),
    ("", False),
])
def test_spam(text, spam):
    p, l, t, _, _ = Spam().counts(page(text))
    assert (l + t >= 6 and (l + t) / max(1, p + l + t) >= 0.5) is spam


@pytest.mark.parametrize("title,text,left", [
    ("A", "Dear {{ name }}, welcome.", True), ("%%title%%", "The library opens at nine.", True), ("Untitled Document", "The library opens at nine.", True), ("A", "undefined\nPrice: undefined", True),
    ("A", "Lorem ipsum dolor sit amet consectetur adipiscing elit", True), ("A", "Access denied.", True), ("A", "ページが見つかりません。住所を確認してください。", True),
    ("A", "In the template, the token {{ page_title }} is replaced before the page is sent.", False), ("A", "    export DIR=${HOME}/data\nThe library opens at nine and closes at six.", False),
    ("A", "Older screens printed “Lorem ipsum” to show a font.", False), ("A", "An error 404 means that the server could not find the address.", False), (None, "", False),
])
def test_residue(title, text, left):
    assert LINES.residue_in(title, page(text)) is left


def test_long_lines():
    filler = "This is placeholder copy, replace before launch. " * 16
    assert len(filler) > 600 and LINES.residue_in("A", page(filler + "It is for the page and it is of the site."))
    story = "The library opens at nine and closes at six, and it is for all of the readers. " * 12
    assert not LINES.residue_in("A", page(story + "This is placeholder copy, replace before launch."))
    legal = "All rights reserved. No part of this site may be reproduced without the consent of the owner. The texts are for general information only and not professional advice. Some opinions are those of the writers. We may earn a commission."
    assert len(legal) > 220 and page(legal)[0].kind == page(legal[:90])[0].kind == list(CUES).index("legal") + 1
    assert not page(story + "All rights reserved.")[0].kind


@pytest.mark.parametrize("text", ["Oops! Something went wrong. Please try again later.", "Please turn on JavaScript in your browser.", "Access denied. You don't have permission to access this resource.", "We are temporarily down for scheduled maintenance", "Checking your browser before accessing example.com", "Pagina non trovata"])
def test_common_messages(text):
    assert LINES.residue_in("A", page(text))
    assert not LINES.residue_in("A", page(f"The library opens at nine and closes at six. Readers may borrow ten books at a time, and in winter it closes an hour early.\nThe old server printed “{text}” when nobody was there to see it, and the readers of the library laughed about it for a whole year afterwards."))


@pytest.mark.parametrize("text,kind", [("Accept all", "notice"), ("Leave a reply", "prompt"), ("Powered by WordPress", "legal"), ("Subscribe to our newsletter", "prompt"), ("Copyright 2024 Harbour News Ltd", "legal"), ("Privacy Policy | Terms of Service", "legal"), ("Recent Posts", "related"), ("We accept all cards in the shop, and the staff will help you to pay.", "")])
def test_common_phrases(text, kind):
    assert KINDS[page(text)[0].kind] == kind


def test_language(samples):
    m = LanguageModel(samples)
    assert m.held_out_accuracy > 0.97
    other = LanguageModel(samples[::2])
    got = other.scores([t for _, t in samples[1::2]]).argmax(1)
    assert np.mean([LANGS[k] == g for k, (g, _) in zip(got, samples[1::2])]) > 0.97
    assert np.allclose(m.probabilities(m.scores(["ein Haus", ""])).sum(1), 1)
    # a text's score is the length-weighted mean of its lines'
    assert LanguageModel([]).scores(["x"]).shape == (1, 6)


@pytest.mark.parametrize("label,want", [("EN", "en"), ("eng", "en"), ("ja-JP", "ja"), ("fr_FR", "fr"), ("und", ""), ("unknown", ""), ("", ""), (None, ""), ("it", "it"), ("deu", "de"), ("xx", "")])
def test_codes(label, want):
    assert code(label) == want


PAGE = "Skip to content\nMenu Garden · Maps · News Search Log in\nJane Roe | Published 2024-01-01\nThe library opens at nine and closes at six.\nOpening hours\nReaders may borrow ten books.\nYou may also like\nHow old maps work\nNotes on rare books\nShare this page: Mail Print Copy link\n© 2024 Lib. All rights reserved."


def test_bodies():
    pages = [page(PAGE.replace("nine", f"{i} o'clock")) for i in range(40)]
    got = Bodies(pages).label(pages[:2] + [[]])
    assert [i for i, b in enumerate(got[0]) if b] == [3, 4, 5] and got[2] == []
    assert teach(pages[0]) == [int(b) for b in got[0]]
    runs = blocks(pages[0])
    assert runs[0][0] == 0 and runs[-1][1] == len(pages[0]) and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    for label in Bodies(pages).label(pages):  # no body line in a block without body, and the reverse
        assert all(any(label[a:b]) or not any(label[a:b]) for a, b in runs)


def test_bodies_without_listed_phrases():
    """Sites whose phrases no list holds: what repeats on a host teaches, and shape decides on other hosts."""
    frame = "Zum Blork\nZibber | Zabber | Zubber\n{}\nThe library opens at {} and closes at six on most days of the week.\nReaders of the town may borrow ten books, and they often do so.\nQuarn the blib\nZorp and zamp"
    pages, hosts = [], []
    for h in range(12):
        for i in range(8):
            day = f"{'abcdefghijkl'[h]}{'mnopqrst'[i]}"
            pages.append(page(frame.format(f"Story of {day}", f"nine in the house of {day}").replace("Readers", f"Readers of {day}").replace("blib", f"blib{day[0]}")))
            hosts.append(f"h{h}")
    b = Bodies(pages[:64], hosts[:64])
    label = b.label(pages[64:])
    assert all(x[3] and x[4] for x in label) and np.mean([not (x[0] or x[1] or x[5] or x[6]) for x in label]) > 0.95


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((Boosted(least=5).fit(x, y).predict(x) > 0) == y).mean() > 0.97


def test_isotonic():
    rng = np.random.default_rng(1)
    s, v = rng.random(60), rng.integers(1, 4, 60)
    ends, levels = isotonic(s, v)
    assert (np.diff(levels) > 0).all() or len(levels) == 1
    fit = levels[np.searchsorted(ends, s)]
    order = np.argsort(s)
    best = np.array([max(min(v[order][a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)])
    assert np.allclose(fit[order], best)


def test_ranker():
    easy, hard = page("The cat sat. The dog ran. We like the sun. " * 5), page("Notwithstanding considerable methodological disagreement, the epistemological framework, which necessitates interdisciplinary consolidation, remains computationally intractable. " * 3)
    x = np.array([features(easy, [True]), features(hard, [True])] * 20)
    r = Ranker(x, np.array([1.0, 3.0] * 20))
    assert r.level(r.score(x[:2])).tolist() == [1.0, 3.0]
    assert Ranker(np.zeros((0, 10)), np.zeros(0)).level(np.array([0.0])).tolist() == [2.0]
    assert len(features([], [])) == 10


PASSAGE = "In Selmor the river rises every spring and floods the lower meadows, so the farmers of the valley move their cattle to the hills before March ends, and the bridge keeper counts 418 carts on the last dry day of the season while the children of the village watch from the old mill."


def brute(passage, text):
    """Longest chain of equal words that stay within an item-sized window, without shingles."""
    a, b = tokens(passage), tokens(text)
    best = 0
    for start in range(len(b)):
        w = b[start : start + len(a)]
        prev = [0] * (len(w) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(w):
                row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
            prev = row
        best = max(best, prev[-1])
    return best / max(1, len(a))


@pytest.mark.parametrize("change,leaks", [
    (lambda p: f"Before that it rained. {p} After that it was dry.", True),
    (lambda p: p.upper().replace(",", ""), True),
    (lambda p: " ".join(p.split()[: int(0.6 * len(p.split()))]), True),
    (lambda p: p.replace("spring", "autumn").replace("cattle", "sheep"), True),
    (lambda p: p[: len(p) // 2] + "\nShare this page: Mail Print\n" + p[len(p) // 2 :], True),
    (lambda p: " ".join(p.split()[: int(0.3 * len(p.split()))]), False),
    (lambda p: " ".join(sorted(p.split())), False),
    (lambda p: "", False),
])
def test_leaks(change, leaks):
    items = Items([(7, PASSAGE), (8, "")])
    text = change(PASSAGE)
    got = items.leaks([text])[0]
    assert (bool(got) and got[0][1] >= 0.5) is leaks
    if leaks:
        assert got[0][1] <= 1 and brute(PASSAGE, text) >= 0.5


def test_leaks_prefix_loses_nothing():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    passages = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(8)]
    items = Items(passages)
    texts = [" ".join([rng.choice(words) for _ in range(30)] + p.split()[: rng.randrange(10, 40)] + [rng.choice(words) for _ in range(30)]) for _, p in passages]
    every = Items(passages)
    for s in range(len(every.keys)):
        every.prefix[s] = set(range(len(passages)))  # all shingles may open a candidate
    items.rank(np.array([rng.randrange(9) for _ in items.keys]))
    assert items.leaks(texts) == every.leaks(texts)


@pytest.mark.parametrize("leaked", [1, 500])
def test_leaks_whatever_the_corpus_holds(leaked):
    words = [f"w{i}" for i in range(100)]
    items = Items([(1, " ".join(words))])
    text = "Before that it rained. " + " ".join(words[:55]) + " After that it was dry."
    n = np.zeros(len(items.keys), dtype=np.int64)
    n[items.match([text])[3]] = leaked
    items.rank(n)
    assert items.leaks([text]) == [[(0, 0.55)]]


def test_leaks_with_changed_words():
    words = [f"w{i}" for i in range(60)]
    items = Items([(1, " ".join(words))])
    text = words[:30]
    text[10] = text[20] = "other"
    assert items.leaks(["It rained. " + " ".join(text) + " It was dry."]) == [[(0, 0.5)]]
    text[5] = text[15] = text[25] = "other"
    assert items.leaks(["It rained. " + " ".join(text) + " It was dry."]) == [[]]  # no five words on end
    rng = random.Random(9)
    passages = [(i, " ".join(rng.choice(words[:12]) if i % 2 else rng.choice(words) for _ in range(60))) for i in range(8)]
    items, every = Items(passages), Items(passages)
    texts = [" ".join(w if rng.random() > part else "other" for w in p.split()[: rng.randrange(28, 60)]) for _, p in passages for part in (0.05, 0.1, 0.15)]
    items.rank(np.array([rng.randrange(9) for _ in items.keys]))
    every.need = [1] * 8
    for s in range(len(every.keys)):
        every.prefix[s] = set(range(8))
    whole = lambda got: [[x for x in t if x[1] >= 0.5] for t in got]
    assert any(whole(items.leaks(texts))) and whole(items.leaks(texts)) == whole(every.leaks(texts))


def test_leaks_not_look_alikes():
    frame = "It has been argued that the {} with respect to the underlying normative presuppositions, an interpretation whose implications remain {} and, in certain respects, {}."
    item, other = (" ".join(frame.format(" ".join(f"{c}{i}{j}" for j in range(6)), f"{c}x{i} {c}y{i}", f"{c}z{i}") for i in range(4)) for c in "ab")
    items = Items([(1, item)])
    assert all(v < 0.5 for _, v in items.leaks([other])[0]) and items.leaks([item])[0] == [(0, 1.0)]


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 256])
    sizes = {rng.randrange(1, capacity + 1): rng.randrange(1, 40) for _ in range(12)}
    types = plan(capacity, sizes)
    used: dict = {}
    for many, uses in types:
        assert sum(s * n for s, n in uses) <= capacity
        for s, n in uses:
            used[s] = used.get(s, 0) + many * n
    assert used == sizes
    total = sum(s * n for s, n in sizes.items())
    assert sum(m for m, _ in types) <= 1.3 * -(-total // capacity) + 3
    assert plan(10, {}) == []
