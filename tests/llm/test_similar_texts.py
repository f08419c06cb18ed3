import random

import corpus_pipeline
from codequarry.llm.similar_texts import similar_texts
from tests.llm.test_simhash import slow_components


def _sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def _texts():
    """Edited copies on both sides of the threshold, chains of them, a common passage, short, empty and equal texts."""
    rng = random.Random(12)
    words = lambda n: [rng.choice("bdgklm") + rng.choice("aeiou") + rng.choice("nrst") + rng.choice("aeiou") for _ in range(n)]
    passage, out = words(30), []
    for g in range(40):
        base = words(rng.randrange(40, 160))
        if g % 3 == 0:
            base[9:9] = passage
        for _ in range(rng.randrange(1, 7)):
            out.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randrange(4)):
                base[rng.randrange(len(base))] = words(1)[0]
            if rng.random() < 0.3:
                base += words(rng.randrange(12))
    out += ["", None, "  ", "One two", "one  TWO", "one two three", out[5], out[5].upper()]
    rng.shuffle(out)
    return dict(enumerate(out, 100))


def test_components_against_brute_force(spark):
    texts = _texts()
    sets = {d: _sets(t) for d, t in texts.items()}
    want = slow_components(sets, lambda a, b: _near(sets[a], sets[b]))
    assert len(set(want.values())) < len(want) - 40
    frame = spark.createDataFrame(list(texts.items()) + [(None, "a b c"), (None, texts[100])], "doc_id long, text string").repartition(3)
    for sample, frequent in ((20_000, 50_000), (20_000, 5), (1, 0)):  # the order of shingles must not matter
        got = similar_texts(frame, sample=sample, frequent=frequent).collect()
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert [r.component_id for r in got if r.doc_id is None] == [None, None]
        assert all(r.first == (r.doc_id is None or r.component_id == r.doc_id) for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert similar_texts(empty).count() == 0


def test_stage_removes_all_near_duplicates(spark):
    texts = _texts()
    sets = {d: _sets(t) for d, t in texts.items()}
    top = slow_components(sets, lambda a, b: _near(sets[a], sets[b]))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()} == {d for d in top if top[d] == d}


def test_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (1, b), (2, a + " more"), (3, b + " end"), (3, "alone"), (None, a)]
    got = similar_texts(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, of int")).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got if not r.first) == [("2", "1"), ("3", "1")]


def test_rows_that_occur_often_are_compared_once(spark, monkeypatch):
    """300 copies of each of two near copies make one pair of texts, not 90,000."""
    from codequarry.llm import similar_texts as module

    made, similar = [], module._similar
    monkeypatch.setattr(module, "_similar", lambda pairs, texts, shingle: made.append((pairs.count(), texts.count())) or similar(pairs, texts, shingle))
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, a)] * 300 + [(2, a + " end")] * 300 + [(3, "alone")]
    got = module.similar_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 601 and {r.component_id for r in got if r.doc_id == 2} == {1} and sum(n for n, _ in made) == 1 and {n for _, n in made} == {3}


def test_a_family_of_less_similar_texts_brings_few_texts_together(spark, monkeypatch):
    """Of 40 texts that are half alike, pair by pair, and 30 others, only those of the pairs that sketches allow are written or compared."""
    from codequarry.llm import similar_texts as module

    rng = random.Random(5)
    words = lambda n: [rng.choice("bdgklm") + rng.choice("aeiou") + rng.choice("nrst") + rng.choice("aeiou") for _ in range(n)]
    base, texts = words(120), []
    for _ in range(40):
        text = list(base)
        for i in rng.sample(range(120), 5):
            text[i] = "".join(words(2))
        texts.append(" ".join(text))
    texts += [" ".join(words(100)) for _ in range(30)]
    texts.append(texts[3] + " end")
    made, held, similar, written = [], [], module._similar, module.written
    monkeypatch.setattr(module, "_similar", lambda pairs, texts, shingle: made.append(pairs.count()) or similar(pairs, texts, shingle))
    monkeypatch.setattr(module, "written", lambda df, *a: held.append(out.count() if "text" in (out := written(df, *a)).columns else 0) or out)
    got = module.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), frequent=0).collect()
    sets = {d: _sets(t) for d, t in enumerate(texts)}
    assert {r.doc_id: r.component_id for r in got} == slow_components(sets, lambda a, b: _near(sets[a], sets[b]))
    assert 1 <= sum(made) <= 40 and 2 <= max(held) <= 40


def test_sketches_differ_in_no_more_than_the_sets():
    import numpy as np

    from codequarry.llm import similar_texts as module

    rng = np.random.default_rng(3)
    for n in (1, 5, 30, 31, 33, 500, 4000, 40_000):
        one = np.unique(rng.integers(-(2**63), 2**63, n))
        for gone, new in ((0, 0), (1, 0), (n // 9, n // 9), (n // 5, 0), (0, n // 4)):
            other = np.unique(np.concatenate([one[gone:], rng.integers(-(2**63), 2**63, new)]))
            assert module._apart(module._sketch(one), module._sketch(other)) <= gone + new
            assert len(module._sketch(other)) <= module.WIDEST // 8
    far = module._apart(module._sketch(one[:300]), module._sketch(np.concatenate([one[100:300], one[400:500]])))
    assert 100 < far <= 200
