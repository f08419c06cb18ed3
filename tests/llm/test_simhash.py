import random

import xxhash

from codequarry.llm.components import connected_components
from codequarry.llm.simhash import fingerprint, links, near_duplicates


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    of = {n: n for n in nodes}

    def top(n):
        while of[n] != n:
            n = of[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                of[y] = x
    return {n: top(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint():
    for t in ("", None, "One", "one two", "ONE two\tthree", "Über a b c a b c " * 40, "x " * 40_000):
        assert fingerprint(t.encode() if t else t) == slow_fingerprint(t)


def test_links_and_hot_cells(spark):
    rng = random.Random(5)
    codes = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 8))):
            codes.add(base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) % (1 << 64))
    base = rng.getrandbits(64)
    codes |= {base ^ rng.getrandbits(9) for _ in range(200)}  # one block value holds very many
    codes = sorted(codes)
    slow = slow_components(range(len(codes)), lambda a, b: (codes[a] ^ codes[b]).bit_count() <= 3)
    frame = spark.createDataFrame([(signed(c), i) for i, c in enumerate(codes)], "fp long, node long")
    for hot in (100_000, 20):
        edges = links(frame, hot=hot)
        got = {n: n for n in range(len(codes))} | {r.node: r.component for r in connected_components(edges).collect()}
        assert got == slow
        assert edges.count() < 4 * len(codes)


def test_near_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(7, text, "x"), (3, text + " end", "x"), (9, "other words entirely here", "x"), (1, None, "x"), (4, "", None), (None, text, "x"), (9, "other words entirely here", "x")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((t for d, t, _ in rows if d == r.doc_id), None)
        assert r.fingerprint == f"{slow_fingerprint(text):016x}"
    ids = [d for d, _, _ in rows if d is not None]
    code = {d: slow_fingerprint(t) for d, t, _ in rows}
    slow = slow_components(set(ids), lambda a, b: (code[a] ^ code[b]).bit_count() <= 3)
    assert {r.doc_id: r.component_id for r in got} == slow | {None: None}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
