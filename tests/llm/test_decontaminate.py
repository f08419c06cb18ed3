import random

import numpy as np
import pytest

from codequarry.llm.decontaminate import ANSWER, PARAPHRASE, VERBATIM, Dimensions, _answer, common_subsequence, contaminated


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        masks = {x: sum(1 << i for i, y in enumerate(a) if y == x) for x in set(a)}
        assert common_subsequence(masks, len(a), b) == t[-1][-1]


def test_planted_items(spark):
    rng = random.Random(6)
    vocab = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in ("n", "r", "s", "lt", "mp", "nd")]
    common = ["the", "of", "and", "to", "in"]
    words = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n)]
    items = [(i, words(rng.randrange(15, 70))) for i in range(20)]
    docs, want = [], set()
    for d in range(150):
        text = words(rng.choice((0, 5, 60, 400)))
        if d % 5 == 0:
            i, item = rng.choice(items)
            item = list(item)
            if d % 10 == 0:  # a light paraphrase
                for _ in range(len(item) // 10):
                    item[rng.randrange(len(item))] = rng.choice(vocab)
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + "," for w in item]
            want.add((d, i))
        docs.append((d, " ".join(text), 1.0))
    docs += [(None, " ".join(items[0][1]), 1.0), (500, None, 1.0), (501, "", 1.0), (502, "x " * 60_000 + " ".join(items[1][1]), 1.0), (0, docs[0][1], 1.0)]
    want |= {(None, 0), (502, 1)}
    frame = spark.createDataFrame(docs, "doc_id long, text string, cosine double").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, None), (91, ""), (None, "!!!")], "item_id long, text string")
    rows = contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) + 1
    long = words(6_000)
    both = contaminated(spark.createDataFrame([(1, " ".join(words(50) + long))], "doc_id long, text string"), spark.createDataFrame([(5, " ".join(long)), (6, " ".join(words(30)))], "item_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in both.collect()] == [(1, 5)]
    assert contaminated(frame.limit(0), bench).count() == 0 and contaminated(frame, bench.limit(0)).count() == 0


def longest(a, b):
    masks = {x: sum(1 << i for i, y in enumerate(a) if y == x) for x in set(a)}
    return common_subsequence(masks, len(a), b)


def confirmed(item, words):
    """By the rule for confirmation, over every run of the document that is long enough to hold the item."""
    answer = [w.decode() for w in _answer(" ".join(item).encode(), None).split()]
    for a in range(0, max(1, len(words) - len(item) // 2), 4):
        part = words[a : a + 2 * len(item)]
        share = longest(item, part) / len(item)
        if share >= VERBATIM or share >= PARAPHRASE and longest(answer, part) / len(answer) >= ANSWER:
            return True
    return False


@pytest.mark.parametrize("block", [1_000, 7])
def test_recall_of_paraphrases(spark, block):
    """Edited copies against exhaustive comparison of all items and documents; blocks of items don't matter."""
    rng = random.Random(17)
    vocab = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in ("n", "r", "s", "lt", "mp", "nd", "k")]
    common = ["the", "of", "and", "to", "in"]
    words = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n)]
    items = [(i, words(rng.randrange(14, 60))) for i in range(25)]
    docs = []
    for d in range(360):
        text, rate = words(rng.randrange(20, 200)), (0, 0.1, 0.2, 0.3)[d % 4]
        if d % 6:
            copy = []
            for w in rng.choice(items)[1]:
                edit = rng.random()
                if edit >= rate:
                    copy.append(w)
                elif edit < rate / 3:  # a replaced word; a deleted one; an inserted one
                    copy.append(rng.choice(vocab))
                elif edit > 2 * rate / 3:
                    copy += [w, rng.choice(vocab)]
            at = rng.randrange(len(text) + 1)
            text[at:at] = copy
        docs.append((d, text))
    want = {(d, i) for d, t in docs for i, item in items if confirmed(item, t)}
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in contaminated(frame, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"), block=block).collect()}
    assert len(want) > 200 and len(got & want) >= 0.98 * len(want)
    assert all(longest(dict(items)[i], dict(docs)[d]) >= PARAPHRASE * len(dict(items)[i]) for d, i in got)


def test_dimensions():
    vocab = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5_000).astype(np.uint64))
    exact, hashed = Dimensions(vocab), Dimensions(vocab, most=512)
    assert (exact.of(vocab) == np.arange(len(vocab))).all() and (exact.of(vocab + np.uint64(1)) < 0).all()
    assert hashed.size == 512 and hashed.of(vocab).min() >= 0 and hashed.of(vocab).max() < 512


def test_items_are_read_by_few_jobs(spark):
    """A job for each of 40 parts of the sort was run before, four times over; order and blocks are as sorted."""
    from codequarry.llm.decontaminate import blocks, ordered

    items = spark.createDataFrame([(k % 97, f"item {k} has words") for k in range(200)] + [(5, None)], "item_id long, text string")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = ordered(items)
        spark.sparkContext.setJobGroup("items", "items")
        got = [b.ids for b in blocks(rows)], [b.ids for b in blocks(rows, 30)]
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("items"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted(k % 97 for k in range(200))
    assert [len(b) for b in got[1]] == [30] * 6 + [20] and len(got[0]) == 1
    assert got[0][0] == want and sum(got[1], []) == want and jobs < 40
