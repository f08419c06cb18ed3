import random
import zlib

import numpy as np

from codequarry.llm.toxicity import fitted, scored, segments


def slow_segments(x):
    """Maximal segments by their definition: take the best one, then split left and right."""
    best = max(((sum(x[i:j]), -(j - i), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return slow_segments(x[:i]) + [(i, j)] + [(a + j, b + j) for a, b in slow_segments(x[j:])]


def test_segments():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 12, 25):
        for _ in range(40):
            x = np.round(rng.normal(-0.2, 1, n), 3) + rng.random(n) * 1e-6
            got = segments(x)
            assert [(a, b) for a, b, _ in got] == slow_segments(list(x))
            assert np.allclose([s for _, _, s in got], [x[a:b].sum() for a, b, _ in got])


def test_learns_from_its_fold_and_finds_passages(spark):
    rng = random.Random(4)
    vocab = [f"{a}{b}" for a in ("ba", "de", "fi", "go", "lu", "ma") for b in ("n", "r", "st", "k", "le", "mo")]
    docs, labels = [], []
    for d in range(400):
        words = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        toxic = d % 4 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = ["awful", "GRUDGE!", rng.choice(vocab), "awful"]
        docs.append((d, " ".join(words), "x"))
        labels.append((d, int(toxic)))
    docs += [(900, None, "x"), (901, "", "x"), (None, "awful awful awful grudge", "x"), (902, "kra " * 50_000, "x"), (0, docs[0][1], "x")]
    labels += [(5, None), (None, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3)
    rows = scored(frame, *fitted(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 90 and all((r.predicted == 1) == (r.doc_id % 4 == 0) for r in held)
    by = {d: t for d, t, _ in docs}
    for r in held:
        assert all("awful" in by[r.doc_id].encode()[p.start : p.end].decode() for p in r.passages)
        assert bool(r.passages) == bool(r.predicted)
    assert all(0 <= r.score <= 1 for r in rows) and next(r.predicted for r in rows if r.doc_id is None) == 1
    assert not any(r.predicted for r in rows if r.doc_id in (900, 901, 902))
    none = frame.limit(0)
    assert scored(none, *fitted(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
