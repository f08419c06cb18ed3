import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from codequarry.llm.lm_score import LogBilinear, Vocabulary, counts, language_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


@pytest.mark.parametrize("known", [100_000, 40])
def test_base_counts_and_gain(spark, known):
    rng = random.Random(8)
    after = {w: rng.sample([f"w{i}" for i in range(60)], 3) for w in [f"w{i}" for i in range(60)]}
    rows = []
    for d in range(400):
        w, out = "w1", []
        for _ in range(rng.randrange(60)):
            out.append(w if rng.random() < 0.9 else f"rare{rng.randrange(900)}")
            w = rng.choice(after[w])
        rows.append((d, " ".join(out)))
    rows += [(None, "W1 w2"), (900, None), (901, ""), (902, "new words only"), (902, "new words only"), (next(d for d in range(903, 999) if held(d)), "w1 " * 30_000)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score int").repartition(3)
    got = language_scores(frame, short=50, known=known, width=8).collect()
    c = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in rows:
        ts = tokens(t)
        want.append((d, held(d), len(ts), sum(c[x] > 0 for x in ts), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts), 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
    test = [r for r in got if r.held_out and 5 < r.n_tokens < 100]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert language_scores(frame.limit(0)).count() == 0


def test_probabilities_sum_to_one(spark):
    frame = spark.createDataFrame([(i, f"a b c a b d{i % 7}") for i in range(40)], "doc_id long, text string")
    v = Vocabulary.of(counts(frame), 4, 1_000)
    model = LogBilinear(4, 6, shares=v.shares())
    near, far = model.tables()
    norm = model.normalisers()
    p = np.exp(near[:, None, :] + far[None, :, :] - norm[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)
