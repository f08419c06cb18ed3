import random
import re
from functools import lru_cache

import pytest

from codequarry.llm.license_rules import SURE, Rule, rules
from codequarry.llm.licenses import BASE, _BLOCK, _by_keyword, detected, placed

FIELDS = "doc_id long, text string, labels string, detections long"
ASCII_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


compiled = lru_cache(maxsize=None)(lambda pattern: re.compile(placed(pattern)))


def slow(text, all_rules):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    base = sorted((i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    line = "".join(f" {w}:{i}" for i, w in enumerate(words))
    found = []
    for n, r in enumerate(all_rules):
        if r.keyword not in words:
            continue
        for m in compiled(r.pattern).finditer(line):
            at = [int(x) for x in re.findall(r":(\d+)", m.group())]
            found.append((at[0], at[-1], r.priority, n, r.label))
    kept = [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and (e[:2] != d[:2] or (e[2], e[3]) < (d[2], d[3])) for e in found)]
    return len(words), base, sorted(kept), sorted({x for _, x in base}), sorted({x for _, x in base} | {d[4] for d in kept})


def got(spark, texts, all_rules=None):
    rows = detected(spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], FIELDS).repartition(3), all_rules=all_rules).collect()
    return {r.doc_id: (r.n_words, [tuple(b) for b in r.base], sorted(tuple(d) for d in r.detections), r.base_labels, r.labels) for r in rows}


def test_known_notices(spark):
    texts = {
        "Released under the GNU Lesser General Public License, version 2.1.": {"lgpl-2.1", "gpl"},
        "SPDX-License-Identifier: GPL-3.0-or-later": {"gpl-3.0-or-later"},
        "Licensed under the Apache License, Version 2.0 (the License)": {"apache-2.0", "apache"},
        "licensed under Apache-2.0 or the MIT license": {"apache-2.0", "mit"},
        "Redistribution and use in source and binary forms, with or without modification, are permitted": {"bsd"},
        "This work is under the Creative Commons Attribution-ShareAlike 4.0 licence": {"cc-by-sa-4.0"},
        "Boost Software License - Version 1.0": {"bsl-1.0"},
        "nothing of the kind, a mitten": set(),
        "All rights reserved.": {"proprietary"},
    }
    found = got(spark, list(texts))
    assert {t: set(found[i][4]) for i, t in enumerate(texts)} == texts


def test_every_rule_finds_its_own_words_and_holds_its_keyword(spark):
    rng, samples = random.Random(12), []

    def word(w):
        w = w.strip("()").split("|")[0] if w.startswith("(") and w.endswith(")") else w
        for a, b in (("(e|ed|es|ing)", "ed"), ("[cs]", "s"), ("[a-z0-9]+", "x"), ("[0-9]+", "7")):
            w = w.replace(a, b)
        return w.replace("(", "").replace(")", "")

    for r in rules():
        words = [(w.removesuffix("?"), w.endswith("?")) for w in r.pattern.replace("LIC", "license").split()]
        assert any(r.keyword in (w, word(w)) and not optional and not re.search(r"[|\[]", w) for w, optional in words), r
        samples.append(" ".join(word(w) for w, optional in words if not optional or rng.random() < 0.5))
        assert re.search(placed(r.pattern), "".join(f" {w}:{i}" for i, w in enumerate(samples[-1].split()))), r
    found = got(spark, samples)
    assert all(found[i] == slow(t, rules()) and found[i][2] for i, t in enumerate(samples))


def test_same_as_comparing_all_pairs(spark):
    rng = random.Random(3)
    words = "mit license apache general public gpl version 2 0 or later gnu lesser the é 日本 licensed under bsd 3 clause".split()
    texts = ["".join(rng.choice(words[: rng.choice([5, 18])]).title() + rng.choice([" ", "-", ". ", "\n", "_", "\x00"]) for _ in range(rng.randrange(0, 80))) for _ in range(60)]
    texts += [None, "", "   ", "license", "MIT LICENSE", "mit\tlicense mit license", "mit_license", "É mit license"]
    found = got(spark, texts)
    assert all(found[i] == slow(t, rules()) for i, t in enumerate(texts))
    assert found[texts.index("mit\tlicense mit license")][1] == [(0, "mit"), (2, "mit")]


def test_blocks_of_detections(spark):
    """More detections than a block holds, with a rule whose match spans several blocks."""
    own = [Rule("wide", "start", 1, "start" + " (a|b)" * 700 + " end"), Rule("a", "a", 2, "a"), Rule("b", "b", 0, "b"), Rule("ab", "a", 1, "a b")]
    texts = ["x " + "start " + "a b " * 350 + "end " + "a b b " * 300, "a b " * 40]
    found = got(spark, texts, own)
    assert len(found[0][2]) > _BLOCK and all(found[i] == slow(t, own) for i, t in enumerate(texts))


def test_very_long_text_and_empty_table(spark):
    text = "mit license and apache license version 2.0, " * 20_000
    (row,) = got(spark, [text]).values()
    assert row[0] == 160_000 and len(row[1]) == 40_000 and len(row[2]) == 40_000 and row[4] == ["apache", "apache-2.0", "mit"]
    assert detected(spark.createDataFrame([], FIELDS)).count() == 0


def test_priorities():
    assert len(rules()) > 300 and {r.priority for r in rules()} == set(range(len(SURE))) and all("," not in r.label for r in rules())
    assert str(_by_keyword(rules()[:3]))


@pytest.mark.parametrize("pattern", ["a b? c", "(a|b)? LIC"])
def test_optional_words(pattern):
    assert re.fullmatch(placed(pattern), " a:0 c:1" if "b? c" in pattern else " licence:5")
