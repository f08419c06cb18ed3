import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa

from codequarry.llm.substring_dedup import _dealt, _entries, _Frequent, _settled, repeated_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, window=13):
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in texts:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in texts:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else None))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)] + ["Ä", "ß x", " "]
    shared = [[rng.choice(vocab) for _ in range(n)] for n in (12, 13, 14, 20, 61, 75)]
    rows = []
    for d in range(70):
        words = [rng.choice(vocab) for _ in range(rng.randrange(90))]
        for s in rng.sample(shared, rng.randrange(4)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = s
        rows.append((d * 3 % 71, rng.choice((" ", "\n", " \t ")).join(words)))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, "a " * 40), (203, "a " * 30), (204, None), (205, ""), (None, rows[0][1]), (200, rows[0][1])]
    rows.append((206, " ".join(rng.choice(vocab) for _ in range(20_000))))
    rows += [(207, " ".join(shared[4] + shared[5])), (207, " ".join(["one", *shared[5]])), (207, "short " + rows[3][1]), (3, " ".join(shared[5]))]  # one id, several texts
    rows += [(300 + d, " ".join([f"p{d}", *shared[4], f"q{d}"])) for d in range(120)]  # one passage in very many documents
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, key int")
    got = repeated_passages(frame).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got), key=str) == slow(rows)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert repeated_passages(frame.limit(0)).count() == 0


def test_settled_here_or_sent_on():
    """What pieces settle, and what they send to one bucket, gives the same anchors as all entries together."""
    rng = np.random.default_rng(5)
    h, doc, block = rng.integers(0, 40, 4_000).astype(np.uint64), rng.integers(0, 500, 4_000), rng.random(4_000) < 0.15
    want = _settled(h, doc, block)[0]
    for cut in ([0, 4_000], [0, 500, 1_000, 3_000, 4_000]):
        got, sent, frequent = np.zeros(4_000, bool), np.zeros(4_000, bool), _Frequent()
        for a, b in zip(cut, cut[1:], strict=False):
            got[a:b], sent[a:b] = frequent.settle(h[a:b], doc[a:b], block[a:b])
        assert sent.sum() < 1_200
        at = np.flatnonzero(sent)
        got[at] |= _settled(h[at], doc[at], block[at])[0]
        assert (got == want).all()


def test_dealing_is_linear():
    """A word costs about the same with 89 buckets and with 170,000, as for a terabyte of text; and all entries come out again."""
    rng = np.random.default_rng(5)
    n = 150_000
    h, doc, place = rng.integers(0, 1 << 63, n).astype(np.uint64), np.repeat(np.arange(400), n // 400), np.arange(n) % 70_000
    took = []
    for buckets in (89, 5_003, 170_003):
        best = 9e9
        for _ in range(3):
            began = time.process_time()
            rows = list(_dealt(h, doc, place, buckets))
            best = min(best, time.process_time() - began)
        took.append(best)
        d, _, p = _entries(pa.Table.from_batches(rows))
        assert sorted(zip(d.tolist(), p.tolist(), strict=True)) == sorted(zip(doc.tolist(), place.tolist(), strict=True))
    assert max(took) < 6 * took[0] + 0.05
