"""Language, language model, HTML, personal data and mixing on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from memlattice.llm import class_lm, html_extract, language_id, mixing, pii


def test_cross_parsing():
    a = language_id.suffix_automaton("abcabd")
    assert language_id.phrases(a, "abcabd") == (1, 0) and language_id.phrases(a, "abdabc") == (2, 0)
    assert language_id.phrases(a, "xxab") == (1, 2) and language_id.phrases(a, "") == (0, 0)
    rng = random.Random(1)
    text = "".join(rng.choice("abc") for _ in range(400))
    auto = language_id.suffix_automaton(text)
    for _ in range(300):
        probe = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40)))
        assert language_id.phrases(auto, probe) == cut_greedily(probe, text)


def cut_greedily(probe, text):
    count, unseen, i = 0, 0, 0
    while i < len(probe):
        j = i + 1
        while j < len(probe) and probe[i : j + 1] in text:
            j += 1
        count, unseen, i = count + (probe[i] in text), unseen + (probe[i] not in text), j
    return count, unseen


def told(text, samples):
    """The language by plain substring search."""
    text = language_id.fold(text)
    rate = {}
    for k, sample in sorted(samples.items()):
        count, unseen = cut_greedily(text, sample)
        rate[k] = (count * math.log2(len(sample) + 2) + unseen * language_id.UNSEEN) / len(text)
    return min(rate, key=rate.get)


def labelled_rows(seed, n=40, kinds=("xx", "yy", "zz")):
    rng = random.Random(seed)
    syllables = {"xx": ["the", "ing", "er", "an"], "yy": ["eau", "que", "lle", "oi"], "zz": ["sch", "ung", "ein", "ver"]}
    say = lambda k: " ".join("".join(rng.choice(syllables[k]) for _ in range(3)) for _ in range(30))
    return [(i, say(k), k) for i, k in enumerate(list(kinds) * n)]


LABELLED = "doc_id long, text string, lang string"


def test_tiny_samples_do_not_win(spark):
    rows = labelled_rows(4)
    docs = spark.createDataFrame(rows, LABELLED)
    told_by = lambda train: {r.doc_id: r.lang_pred for r in language_id.identify_language(docs, labelled=train).collect()}
    before = told_by(docs)
    for tiny in ("ok", "the", "Der Hund ist da xyz.", "a b c d e f g h i j k l m n o p q r s t u v w x y z"):
        assert told_by(docs.union(spark.createDataFrame([(10**6, tiny, "tiny")], LABELLED))) == before == {i: k for i, _, k in rows}


def test_ids_do_not_matter_for_what_is_learned(spark):
    rows = labelled_rows(5)
    want = language_id.sample(spark.createDataFrame(rows, LABELLED), "text", "lang")
    assert language_id.sample(spark.createDataFrame([(None, t, k) for _, t, k in rows], LABELLED), "text", "lang") == want
    copies = [(i % 3, t, k) for i, t, k in rows] + [(7, rows[0][1], "xx")] * 3000  # more rows than are ranked, nearly all the same
    assert language_id.sample(spark.createDataFrame(copies, LABELLED), "text", "lang") == want


def test_predictions_against_substring_search(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CHARS_PER_LANGUAGE", 900)
    rows = labelled_rows(6, 12)
    rng = random.Random(6)
    mixed = [(1000 + k, "".join(rng.choice([w, w.upper(), f"{w}, 7!"]) + " " for w in " ".join(t for _, t, _ in rng.sample(rows, 2)).split()), None) for k in range(30)]
    samples = language_id.sample(spark.createDataFrame(rows, LABELLED), "text", "lang")
    assert all(0 < len(v) <= 900 for v in samples.values())
    got = language_id.identify_language(spark.createDataFrame(rows + mixed, LABELLED), labelled=spark.createDataFrame(rows, LABELLED)).collect()
    assert [r.lang_pred for r in got] == [told(r.text, samples) for r in got]


def test_room_is_filled_with_longer_texts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CHARS_PER_LANGUAGE", 6000)
    rows = [(0, "kurz", "de"), *[(i, f"lang{chr(96 + i)} " * (200 + 10 * i), "de") for i in range(1, 6)], (9, "only " * 4000, "en")]
    got = language_id.sample(spark.createDataFrame(rows, LABELLED), "text", "lang")
    assert got["de"].startswith("kurz") and 4000 < len(got["de"]) <= 6000 and "langa" in got["de"] and "lange" not in got["de"]
    assert got["en"] == language_id.fold("only " * 4000)  # its shortest text, whole


def test_language_id(spark):
    rng = random.Random(2)
    syllables = {"xx": ["the", "ing", "er", "an"], "yy": ["eau", "que", "lle", "oi"], "zz": ["sch", "ung", "ein", "ver"]}
    say = lambda k: " ".join("".join(rng.choice(syllables[k]) for _ in range(3)) for _ in range(40))
    rows = [(i, k, say(k)) for i, k in enumerate(list(syllables) * 40)]
    odd = [(900, "xx", None), (901, None, "12 34 !"), (902, None, ""), (None, None, say("yy")), (0, "xx", rows[0][2])]
    df = spark.createDataFrame([(i, t, k, "old", 1) for i, k, t in rows + odd], "doc_id long, text string, lang string, lang_pred string, score int")
    got = language_id.identify_language(df).collect()
    assert len(got) == len(rows) + len(odd)
    named = {(r.doc_id, r.text): r for r in got}
    held = [r for r in got if r.lang and r.text and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 15 and all(r.lang_pred == r.lang for r in held)
    assert all(0 <= r.score <= 1 for r in got) and named[(902, "")].lang_pred == "und" and named[(901, "12 34 !")].score == 0.0
    # a language of long texts only is learned from the shortest
    far = spark.createDataFrame([(2000 + i, "qua " * (900 + i), "qq") for i in range(3)] + [(i, t, k) for i, k, t in rows], "doc_id long, text string, lang string")
    assert language_id.sample(far, "text", "lang")["qq"].startswith("qua " * 900)
    assert {r.lang_pred for r in language_id.identify_language(df.filter("lang is null")).collect()} == {"und"}  # nothing to learn from
    assert language_id.identify_language(df.limit(0)).count() == 0


def test_class_lm(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "KEPT", 40)
    monkeypatch.setattr(class_lm, "CORE", 20)
    monkeypatch.setattr(class_lm, "HELD", 15)
    rng = random.Random(5)
    left, right = [f"a{k}" for k in range(25)], [f"B{k}" for k in range(25)]
    rows = [(i, " ".join(rng.choice(left if (j + i) % 2 else right) for j in range(rng.randrange(0, 60)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "unseen\tWORD a1"), (903, "y " * 20_000), (None, "a1 b2"), (5, "a1 unseen b2"), (5, "a3 alone1"), (906, "b1 " + "long" * 40 + " b2 zz " + "long" * 41)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    got = class_lm.score_documents(df, ~class_lm.held_out(), classes=4).collect()
    tok = lambda t: [*(w.lower() for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w), None]
    learnt = [(i, t) for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    c = collections.Counter()
    for _, t in learnt:
        c.update(tok(t))
    n, v = sum(c.values()), len(c)
    # the classes of the operator, and a model of plain dictionaries over them
    scratch = class_lm.Scratch(spark, "test")
    model = class_lm.fit_classes(df.filter(~class_lm.held_out()), scratch, "text", 4)
    name = lambda w: class_lm.tokens(w)[0]
    cls = dict(zip(model.listed, model.cls, strict=True)) | {bytes(r["word"]): r["class"] for r in model.others.collect()}
    assert set(cls) == {name(w) for w in c if w} and len(model.listed) == 40 and len(cls) > 45
    of = {w: int(cls[name(w)]) for w in c if w}
    k, moves, size = model.k, collections.Counter(), collections.Counter()
    for w, m in c.items():
        if w:
            size[of[w]] += m + 1
    for _, t in learnt:
        before = "start"
        for w in tok(t):
            now = of[w] if w else "end"
            moves[before, now] += 1
            before = now
    to, every = [*range(k), "end"], sum(moves.values())
    alone = {x: (sum(m for (_, b), m in moves.items() if b == x) + 1) / (every + k + 1) for x in to}
    chance = {(a, x): (moves[a, x] + class_lm.PRIOR * alone[x]) / (sum(moves[a, y] for y in to) + class_lm.PRIOR) for a in [*range(k), "start"] for x in to}
    for a in [*range(k), "start"]:  # all words, the unseen and the end
        assert math.isclose(sum(chance[a, of[w]] * (m + 1) / (size[of[w]] + 1) for w, m in c.items() if w) + sum(chance[a, x] / (size[x] + 1) for x in range(k)) + chance[a, "end"], 1)
    want = collections.Counter()
    for i, t in rows:
        s, before = 0.0, "start"
        for w in tok(t):
            if w and w not in of:
                s += math.log10(sum(chance[before, x] / (size[x] + 1) for x in range(k)))
                continue
            s += math.log10(chance[before, of[w]] * (c[w] + 1) / (size[of[w]] + 1) if w else chance[before, "end"])
            before = of[w] if w else before
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t))
        want[i if i is not None else -1, len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(base, 5), round(s, 5)] += 1
    assert collections.Counter((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want
    held = [r for r in got if r.doc_id is not None and r.doc_id < 200 and zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # words alternate, which the classes find
    of_left, of_right = {of[w] for w in left[:8] if w in of}, {of[w.lower()] for w in right[:8] if w.lower() in of}
    assert not of_left & of_right
    empty = class_lm.score_documents(df, F.lit(False)).collect()
    assert len(empty) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 for r in empty)
    assert class_lm.score_documents(df.limit(0), ~class_lm.held_out()).count() == 0


def test_exchange_reaches_a_local_optimum():
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.integers(0, 3, (13, 13)).astype(float)
    m[:6, 6:12] += rng.integers(5, 20, (6, 6))

    def likelihood(cls):
        k = max(cls) + 1
        one = np.zeros((13, k + 1))
        one[np.arange(13), [*cls, k]] = 1
        t = one.T @ m @ one
        f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    cls = list(class_lm.exchange(m, 3))
    best = likelihood(cls)
    assert best > likelihood([i % 3 for i in range(12)])
    for w in range(12):
        for c in range(3):
            assert likelihood([c if i == w else x for i, x in enumerate(cls)]) <= best + 1e-6


PAGE = "page_id long, url string, html string, host string"


def test_html(spark):
    page = (
        '<html><head><title>no</title><script>if (a < b) { "<p>no</p>" }</script><style>p{}</style></head><body><header>no</header><nav><a>no</a></nav>'
        '<div class="cookie-notice">no</div><article><header><h1>Head&amp;line</h1></header><p>One <b>bo</b>ld  &lt;x&gt;<p>Two<br>three&nbsp;four<div class="ad-slot">no</div><ul><li>i<li>j</ul>'
        '<section class="comments"><p>no</p></section><form>no <input value="x>y"></form></article><aside>no</aside><footer>no</footer>'
    )
    rows = [(1, "http://h.org/a", page), (2, None, None), (3, "odd", ""), (4, "http://h.org/b", "a <3 b <unclosed"), (4, "http://h.org/b", "<p>x</p>" * 9000)]
    got = html_extract.extract_main_text(spark.createDataFrame([(*r, "clash") for r in rows], PAGE)).collect()
    text = {(r.page_id, r.n_chars): r.text for r in got}
    first = next(r.text for r in got if r.page_id == 1)
    assert first == "Head&line One bold <x> Two three four i j"
    assert text[(2, 0)] == "" and text[(3, 0)] == "" and text[(4, 17999)].startswith("x x x")
    assert html_extract.extract_main_text(spark.createDataFrame([], PAGE)).count() == 0


def test_html_template(spark):
    body = '<body><div class="top-menu">Home</div><div id="wrap"><div id="story{0}"><h2>Story {0}</h2><p>Text number {0} {1}</p></div><div id="rail">Fixed rail</div></div><p>Fixed end</p></body>'
    rows = [(i, f"http://h.org/{i}", body.format(i, "word " * (20 + i))) for i in range(12)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame([(*r, "") for r in rows], PAGE)).collect()}
    assert all(got[i] == f"Story {i} Text number {i} " + " ".join(["word"] * (20 + i)) for i in got)


def test_html_template_decides_inside_articles(spark):
    note = "Notice of this host. " * 15
    body = '<body><article><h1>Story {0}</h1><p>Text {0} {1}</p><div class="box">Share this</div><p>%s</p></article></body>' % note
    rows = [(i, f"http://h.org/{i}", body.format(i, "word " * i)) for i in range(8)]
    # two pages are no template, and neither are copies of one page
    rows += [(20 + i, f"http://small.org/{i}", body.format(i, "")) for i in range(2)] + [(30 + i, f"http://copies.org/{i}", body.format(1, "")) for i in range(5)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame([(*r, "") for r in rows], PAGE)).collect()}
    assert all(got[i] == " ".join(f"Story {i} Text {i} {'word ' * i}".split()) for i in range(8))
    assert all(got[i] == f"Story {k} Text {k} Share this {note}".strip() for i, k in [(20, 0), (21, 1), *((30 + j, 1) for j in range(5))])


def test_html_words_drop_no_container(spark):
    story = "<h1>Head</h1><p>One two three four</p>"
    gone = '<div class="share">gone</div>'
    pages = [
        f'<body><article class="post has-comments">{story}{gone}</article></body>',
        f'<body><div id="content" class="with-sidebar"><article>{story}</article></div>{gone}</body>',
        f'<body><main class="search-result">{story}{gone}</main></body>',
        f'<body><div class="page sidebar-left"><div><article>{story}</article></div>{gone}</div></body>',
        '<body><article><div class="article-header"><h1>Head</h1></div><p>One two three four</p><div class="comments">gone</div></article></body>',
        f'<body><div class="content related-on">{story}</div>{gone}</body>',
        f'<body><article>{story}<section class="comments"><article class="comment">gone</article></section></article></body>',
    ]
    rows = [(i, f"http://h{i}.org/", p, "") for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == dict.fromkeys(range(len(pages)), "Head One two three four")


def test_html_odd_pages(spark):
    story = "<h1>Head</h1><p>One two <b>three</b> four"
    pages = [
        f'<article>{story} <span class="ad">BUY <span>NOW</span> it</span>five <i>six</i></p></article>',
        f'<div class="page-wrap has-sidebar"><article>{story} <a class="advert" href="#">BUY</a>five six</p></article></div>',
        f'<article class="banner-top">{story} five six</p><p><em class="promo">BUY</p></article>',
        f'<main class="content related-layout">{story} five six</p></main>',
    ]
    deep = "<div>" * 4_000 + "<article>" + story + " five six</p></article>"
    rows = [(i, f"http://h{i}.org/", p, "") for i, p in enumerate([*pages, deep, deep])]
    rows += [(10, "http://open.org/", "word " + "<a " * 60_000, ""), (11, "http://open.org/", "<p>a</p>" + "<a '" * 30_001, "")]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert [got[i] for i in range(6)] == ["Head One two three four five six"] * 6
    assert got[10].startswith("word <a") and got[11].startswith("a")


def brute_template(pages):
    """Texts that stand at the same place on at least 60 % of a host's different pages, and three; the rest of the articles."""
    paths = [re.findall(r"<(p|div|h1)( class=\"[a-z]+\")?>([^<]*)</", p) for p in pages]
    need = max(3, 0.6 * len(pages))
    seen = collections.Counter(x for p in paths for x in set(p))
    return [" ".join(t for x in p if seen[x] < need for t in x[2].split()) for p in paths]


def test_html_template_equals_brute_force(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for h in range(6):
        fixed = [f'<{rng.choice(["p", "div"])} class="c{"abcdef"[k]}">Fixed {h} {k}</' for k in range(3)]
        pages = []
        for i in range(rng.randrange(6, 14)):
            parts = [f"<h1>Story {h} {i}</h1>", *(f"<p>Text {rng.random()}</p>" for _ in range(rng.randrange(1, 5)))]
            for f in fixed:
                if rng.random() < 0.85:
                    parts.insert(rng.randrange(len(parts) + 1), f + f[1 : f.index(" ")] + ">")
            pages.append("".join(parts))
        for i, (p, t) in enumerate(zip(pages, brute_template(pages), strict=True)):
            rows.append((100 * h + i, f"http://host{h}.org/{i}", f"<body><article>{p}</article></body>", ""))
            want[100 * h + i] = t
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == want and any("Fixed" not in t for t in got.values())


def brute_base(t):
    luhn = lambda s: sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v, d: 12 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 9 <= len(d) <= 15),
    ]
    out = []
    for k, (name, p, ok) in enumerate(patterns):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(p, t or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]
    return ",".join(x[2] for x in sorted(out))


def test_base_spans(spark):
    rng = random.Random(9)
    bits = ["a.b@c.d", "x@y", "a@b.c_d@e.f.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "++49 30 123456", "é😀", " ", "-", ".", "@", "9", "\n", "word"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 14)))) for i in range(600)]
    rows += [(900, None), (901, ""), (902, "a" * 50_000), (903, "1 " * 20_000), (904, "1." * 20_000), (905, "a@" * 9_000), (906, "+1" * 9_000), (907, "x@y.z " * 3_000)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, base int")).select("doc_id", pii.span_list("base").alias("s")).collect()}
    assert {i: got[i].s for i, _ in rows} == {i: brute_base(t) for i, t in rows}


def test_disclosing_terms(spark):
    near = "{} Zaphod wrote from {} today about {}"
    rows = [(i, near.format(w, "z@heart.example.com", w)) for i, w in enumerate(["tea", "fish", "stars"])] + [(10 + i, f"common words today about wrote from {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [rows[r.doc_id][1][s.start : s.end] for s in r.terms] for r in pii.find_pii(df).collect() if r.terms}
    assert got == {0: ["Zaphod"], 1: ["Zaphod"], 2: ["Zaphod"]}
    clean = {r.doc_id: r.sanitised for r in pii.sanitise(df).collect()}
    assert clean[0] == "tea [TERM] wrote from [EMAIL] today about tea" and clean[10] == rows[3][1]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_disclosing_terms_of_every_entity_near(spark):
    # the telephone number changes, the address behind it repeats; two letters and two characters are names too
    rows = [(i, f"{w} Roe +1 (377) 555-02{70 + i} roe@x.example.com {w}") for i, w in enumerate(["tea", "fish", "stars"])]
    rows += [(10 + i, f"{w} Bo bo@x.example.com {w}") for i, w in enumerate(["moss", "fern"])] + [(20 + i, f"{w} 王明 wm@x.example.com {w}") for i, w in enumerate(["oak", "elm"])]
    # in one of three documents the name is far from the entity
    filler = " ".join(f"{chr(97 + k)}filler" for k in range(12))
    rows += [(30, "sun Ford ford@x.example.com sun"), (31, "moon Ford ford@x.example.com moon"), (32, f"Ford {filler} ford@x.example.com star")]
    rows += [(100 + i, f"common words of document {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)]
    text = dict(rows)
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.terms] for r in found if r.terms}
    assert got == {**dict.fromkeys((0, 1, 2), ["Roe"]), **dict.fromkeys((10, 11), ["Bo"]), **dict.fromkeys((20, 21), ["王明"]), **dict.fromkeys((30, 31, 32), ["Ford"])}


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s] + 1e-9}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)] + [(900, None, "e"), (901, "x y", "f"), (901, "x y", "f"), (None, "q", "b")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix_plan(df).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken, longest = collections.Counter(), max(r.size for r in got)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6) and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= longest for s in sizes) and math.isclose(sum(want.values()), sum(sizes.values()))
    key = lambda r: (r.doc_id is None, r.doc_id, r.text, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix_plan(df.repartition(7)).collect()))
    # all copies in one order, cut at the budget
    start, end = collections.Counter(), {}
    for i, r in sorted(enumerate(got), key=lambda x: (hashlib.md5((str(x[1].doc_id) if x[1].doc_id is not None else "t" + hashlib.md5((x[1].text or "").encode()).hexdigest()).encode()).hexdigest(), x[1].size)):
        start[r.source] += r.size
        end[i] = start[r.source]
    copies = sorted(((e * r.source_size + end[i]) / r.target, r.source is None, r.source or "", i) for i, r in enumerate(got) if r.size for e in range(3))
    want, so_far = collections.Counter(), 0
    for _, _, _, i in copies:
        if so_far + got[i].size / 2 <= sum(sizes.values()):
            want[i] += 1
        so_far += got[i].size
    assert [r.copies for r in got] == [want[i] for i in range(len(got))]
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_plan(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    say = lambda k: " ".join("".join(rng.choice({"x": ["the", "ing"], "y": ["eau", "que"]}[k]) for _ in range(4)) for _ in range(60))
    rows = [(i, say("xy"[i % 2]), "xy"[i % 2], f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[0][1] + "  ", "x", "s0", 0), (101, rows[1][1] + " more", "y", "s1", 0), (102, "1 2 3", "x", "s0", 0), (103, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()]
    assert 100 in got and not {0, 102, 103} & set(got) and len({1, 101} & set(got)) == 1
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0), str(tmp_path)).count() == 0
    assert sorted(r.doc_id for r in docs.collect()) == sorted(got)


def disclosed(rows, alpha=pii.ALPHA, support=pii.SUPPORT, reach=pii.REACH, wide=pii.WIDE):
    """doc_id: spans of the terms that disclose an entity, by plain loops; e-mail addresses are the only entities."""
    docs, contexts, near, holds = {}, {}, {}, {}
    for i, text in rows:
        spans = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        terms = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", text) if not any(a < m.end() and m.start() < b for a, b in spans)]
        docs[i] = terms
        for a, b in spans:
            e = text[a:b].lower()
            holds.setdefault(e, set()).add(i)
            place = sum(t[0] < a for t in terms)
            at = sum(t[0] < a and len(t[2]) >= 3 for t in terms)
            for m, t in enumerate(terms, 1):
                n = sum(len(u[2]) >= 3 for u in terms[:m])
                if -reach < n - at <= reach and -wide < m - place <= wide:
                    contexts.setdefault((i, e, at), set()).add((n - at, t[0], t[2]))
    seen = {}
    for (i, e, _), around in contexts.items():
        shape = tuple((o, t) for o, _, t in sorted(around))
        for _, _, t in around:
            seen.setdefault((e, t), set()).add(shape)
            near.setdefault((e, t), set()).add(i)
    total = len(rows)
    words = {i: {w.lower() for w in re.findall(r"[^\W\d_]+", text)} for i, text in rows}
    gone = {}
    for (e, t), shapes in seen.items():
        df_e, df_t = len(holds[e]), sum(t in w for w in words.values())
        both = sum(any(u[2] == t for u in docs[i]) for i in holds[e])
        if len(shapes) >= support and df_e < total and math.log2(both * total / (df_e * df_t)) >= alpha * math.log2(total / df_e):
            for i in holds[e]:
                gone.setdefault(i, set()).update((a, b) for a, b, u in docs[i] if u == t)
    return {i: sorted(g) for i, g in gone.items() if g}


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosing_terms_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    common, rows = ["the", "a", "of", "x", "in", "note", "mail", "and"], []
    for i in range(60):
        who = rng.randrange(5)
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += [rng.choice(common) for _ in range(rng.randrange(0, 45))]
            text += [f"Roe{chr(97 + who)}"] * rng.choice([0, 1]) + [f"p{who}@x.org"] + [f"Li{chr(97 + who)}"] * rng.choice([0, 1])
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(rng.choice(common) for _ in range(30))) for i in range(40)]
    want = disclosed(rows)
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert want and {r.doc_id: sorted((s.start, s.end) for s in r.terms) for r in got if r.terms} == want


def test_many_entities_between_short_terms_take_linear_time(spark):
    import time

    def took(n):
        text = " ".join(f"u{k}@x.org " + " ".join(rng.choice(["ab", "cd", "ef"]) for _ in range(10)) for k in range(n))
        begun = time.time()
        assert len(pii.find_pii(spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")).filter("doc_id = 1").first().base) == n
        return time.time() - begun

    rng = random.Random(3)
    took(20)
    assert took(3200) < 6 * took(400) + 10


def test_counts_of_kinds_are_those_of_the_spans(spark, tmp_path):
    from memlattice.llm import queries

    rows = [(1, "1.2.3.4"), (2, "4111 1111 1111 1111 and +1 (377) 555-0271"), (3, "a@b.c d@e.f 9.8.7.6 g@h.i"), (4, None), (4, "none"), (None, "+1 (377) 555-0271")]
    df = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_pii(spark, str(tmp_path)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "spans").collect()
    for r in got:
        kinds = [s.split(":")[0] for s in r.spans.split(",")]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in pii.KINDS[:4]]
    assert sorted((r.doc_id or 0, *r[1:5]) for r in got) == [(0, 0, 0, 0, 1), (1, 0, 1, 0, 0), (2, 0, 0, 1, 1), (3, 3, 1, 0, 0), (4, 0, 0, 0, 0), (4, 0, 0, 0, 0)]
