import math
import random
import time
from collections import Counter

import pytest

from codequarry.llm.language_id import BUCKETS, SMOOTH, STRENGTH, TEMPER, address, page_languages, read, trigrams

SOUNDS = {"en": ["the", "ing", "and", "wh", "er"], "de": ["sch", "ung", "ich", "tz", "ei"], "fr": ["eau", "oi", "ment", "é", "que"]}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_address():
    langs = ["de", "en", "fr"]
    assert address("https://de.news.example.com/a", langs) == ("de.news.example.com", "example.com", "com", "de")
    assert address("http://shop.example.com.br/", langs) == ("shop.example.com.br", "example.com.br", "com.br", "none")
    assert address("http://x.example.at/fr/9", langs)[1:] == ("example.at", "at", "fr") and address("http://x.example.at/fr-CA/9", langs)[3] == "fr"
    assert address("http://co.uk/", langs)[1:3] == ("co.uk", "uk") and address("http://x.example.at/frame", langs)[3] == "none"
    assert address(None, langs) == ("", "", "", "none") and address("http://[bad", langs)[0] == ""


def test_read():
    text, declared = read('<html class="x" lang=\'EN-us\'><p>a &amp; b</p><SCRIPT>var x="<p>"</script ><!-- c -->d<br>e')
    assert text.split() == ["a", "&", "b", "d", "e"] and declared == "en"
    assert read('<html lang="fil">')[1] == "fil" and read('<html lang="zh-Hant">')[1] == "zh"
    assert read('<meta content="pt" http-equiv="Content-Language">')[1] == "pt" and read('<meta name="x" content="de">')[1] == ""
    assert read('<!-- <html lang="fr"> --><html lang=de>')[1] == "de"
    assert read("1 < 2")[0].split() == ["1"] and read("a<script>b")[0].split() == ["a"] and read("a<!-- b")[0].split() == ["a"] and read("") == ("", "")


@pytest.mark.parametrize("part", ["<script>", "<!--", "<", "<html ", "<meta content-language ", "<meta content = ", "<html lang = >", "</style>", "<style></style>"])
def test_long_pages_take_linear_time(part):
    began = time.process_time()
    read(part * (2_000_000 // len(part)))
    assert time.process_time() - began < 8


def test_posterior_against_brute_force(spark):
    """All of the formula again, by dictionaries."""
    rng = random.Random(5)
    docs = [(words(rng, lang, 40), lang) for lang in SOUNDS for _ in range(20)]
    pages = []
    for i in range(120):
        lang = rng.choice(list(SOUNDS))
        host = rng.choice(["a.example.at", "b.example.at", "www.other.com.br", "third.com", ""])
        url = f"http://{host}/{rng.choice(['de', 'fr', 'x'])}/{i}" if host else None
        pages.append((i, url, f'<html lang="{rng.choice([lang, "en", "fil"])}">{words(rng, lang, rng.choice((0, 2, 9)))}' if i % 9 else ""))
    got = {r.page_id: r for r in page_languages(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), spark.createDataFrame(docs, "text string, lang string")).collect()}
    langs = sorted(SOUNDS)
    grams = {x: Counter(g for t, y in docs if y == x for g in trigrams(t.encode()).tolist()) for x in langs}
    total = {x: sum(c.values()) + SMOOTH * BUCKETS for x, c in grams.items()}
    seen = []
    for i, url, page in pages:
        text, declared = read(page)
        g = trigrams(text.encode()).tolist()
        ll = [TEMPER * sum(math.log((grams[x][k] + SMOOTH) / total[x]) for k in g) for x in langs]
        host, domain, suffix, code = address(url, langs)
        declared = declared if declared in langs else "other" if declared else "none"
        seen.append((i, ll, langs[max(range(3), key=lambda k: ll[k])] if g else None, declared, code, (suffix, domain, host)))
    for i, ll, _, declared, code, levels in seen:
        p = {x: 1.0 + sum(s[2] == x for s in seen) for x in langs}
        p = {x: v / sum(p.values()) for x, v in p.items()}
        for level in range(3):
            n = {x: sum(s[2] == x and s[5][level] == levels[level] for s in seen) + STRENGTH * p[x] for x in langs}
            p = {x: v / sum(n.values()) for x, v in n.items()}
        score = []
        for k, x in enumerate(langs):
            like = 0.0
            for at, value in ((3, declared), (4, code)):
                n = {v: 0.5 + 2.0 * (v == x) + sum(s[2] == x and s[at] == v for s in seen) for v in [*langs, "other", "none"]}
                like += math.log(n[value] / sum(n.values()))
            score.append(ll[k] + math.log(p[x]) + like)
        odds = [math.exp(v - max(score)) for v in score]
        best = max(range(3), key=lambda k: odds[k])
        assert got[i].lang == langs[best] and abs(got[i].confidence - odds[best] / sum(odds)) < 1e-4


def test_fusion_beats_wrong_declarations(spark):
    rng = random.Random(2)
    docs = [(words(rng, lang, 80), lang) for lang in SOUNDS for _ in range(60)] + [(None, "en"), ("x", None)]
    pages, truth = [], {}
    for i in range(300):
        lang = rng.choice(list(SOUNDS)) if i % 3 else "de"
        host = "zeitung.example.org" if i % 3 == 0 else f"h{i % 7}.example.com"
        declared = lang if rng.random() < 0.8 else "en"
        n = 0 if i % 30 == 0 else 1 if i % 10 == 0 else 30
        pages.append((i, f"http://{host}/{lang}/{i}", f'<html lang="{declared}"><p>{words(rng, lang, n)}</p></html>', 1))
        truth[i] = lang
    pages += [(900, None, None, 1), (901, "http://zeitung.example.org/", "", 1), (None, "", "<html>", 1), (0, *pages[0][1:])]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, host int").repartition(3)
    labelled = spark.createDataFrame(docs, "text string, lang string")
    got = page_languages(frame, labelled).collect()
    assert len(got) == len(pages)
    right = sum(r.lang == truth[r.page_id] for r in got if r.page_id in truth)
    assert right >= 0.99 * len(truth)
    by = {r.page_id: r for r in got}
    assert by[901].lang == "de" and by[901].text_lang is None and 0 < by[900].confidence <= 1
    assert page_languages(frame.limit(0), labelled).count() == 0
    assert {r.lang for r in page_languages(frame, labelled.limit(0)).collect()} == {None}


def test_white_space_in_a_declaration_takes_linear_time():
    page = '<html lang=' + " " * 1_000_000 + "x><meta content='" + " " * 1_000_000 + '><p lang = "  de-AT">text'
    began = time.time()
    assert read(page)[0].strip().startswith("text") and time.time() - began < 2
    assert read('<html lang=  "  fr">a')[1] == "fr" and read("<html lang=   es>a")[1] == "es"
