import random
import re
from collections import Counter

import numpy as np
import pytest

from codequarry.llm import collocations as C

FIELDS = "doc_id long, text string, lang string, n long, phrase string"
ASCII_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def slow(docs, least, top):
    f, n = {}, Counter()
    for _, text, lang, *_ in docs:
        count = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            count.update(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        hidden = {}
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    hidden[p[i : i + k]] = max(hidden.get(p[i : i + k], 0), a)
        rows = []
        for p, a in candidates.items():
            if hidden.get(p, 0) < a:
                score, _, l, r = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return out


def corpus():
    rng = random.Random(11)
    words = ["a", "b", "C", "d", "É", "e f", "x\x00y", "日本"] + [f"w{i}" for i in range(30)]
    docs = []
    for i in range(400):
        text = "".join(rng.choice(words[: rng.choice([4, 12, 38])]) + rng.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\r\n", "\x0b"]) for _ in range(rng.randrange(0, 60)))
        docs.append((i, text, rng.choice(["en", "en", "en", "de", None]), i, "clash"))
    return docs + [docs[5]] * 40 + [(500, None, "en", 0, ""), (501, "", None, 0, ""), (None, "to be or not to be, to be or not", "und", 0, "")] * 3 + [(502, "one two " * 3_000, "fr", 0, ""), (503, "long", "xx", 0, None)]


@pytest.mark.parametrize(("least", "share", "top"), [(5, 2, 50), (9, 64, 2_000), (3, 1 << 40, 7)])
def test_same_as_counting_everything(spark, least, share, top):
    docs = corpus()
    got = C.collocations(spark.createDataFrame(docs, FIELDS).repartition(5), least, top, share)
    assert sorted(tuple(r) for r in got.collect()) == sorted(slow(docs, least, top))


def test_a_full_bitmap_and_small_slices_change_nothing(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(C, "_BITS", (64, 64))
    monkeypatch.setattr(C, "_HASHES", 500)
    monkeypatch.setattr(C, "_TEXT", 300)
    got = C.collocations(spark.createDataFrame(docs, FIELDS).repartition(2), 6, 100, 4)
    assert sorted(tuple(r) for r in got.collect()) == sorted(slow(docs, 6, 100))


def test_failures_of_the_sample_are_counted_in_a_further_pass(spark, monkeypatch):
    """An empty sample proposes nothing: all words are failures, and phrases of up to 5 words come from one expansion of the border."""
    passes = []
    counted = C._counted
    monkeypatch.setattr(C, "_counted", lambda *a: passes.append(len(a)) or counted(*a))
    docs = [(i, "one two three four five six", "en", 0, "") for i in range(10)]
    got = C.collocations(spark.createDataFrame(docs, FIELDS), 10, 9, 1 << 40).collect()
    assert sorted(tuple(r) for r in got) == sorted(slow(docs, 10, 9))
    assert len(passes) == 3  # the sample, the full pass, the expansion


def test_empty_table_and_products_beyond_64_bits(spark):
    assert C.collocations(spark.createDataFrame([], FIELDS)).count() == 0
    big = 10**12 + 7
    rows = [("en", 0, "", 5 * big), ("en", 1, "a", 3 * big), ("en", 1, "b", 2 * big), ("en", 2, "a b", big)]
    (r,) = C.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, n long")).collect()
    assert r.score == 1000 * big * 5 * big // (6 * big * big)


def test_pieces_keep_every_byte():
    text = b"ab, cd. " * 1_000 + b"z" * 5_000
    cut = C._pieces(text, 100)
    assert b"".join(cut) == text and max(map(len, cut[:-1])) <= 108 and len(cut) > 50
    p = C.Phrases([b"a b", b"c d. e"], np.zeros(2, np.uint64), 3)
    assert [len(h) for h in p.hash] == [5, 2, 0]
