import random

from codequarry.llm import components as module


def _slow(edges):
    top = {n: n for e in edges for n in e if None not in e and e[0] != e[1]}
    while True:
        before = dict(top)
        for a, b in edges:
            if a in top and b in top:
                top[a] = top[b] = min(top[a], top[b])
        if top == before:
            return top


def test_chunks_of_any_size_give_the_same_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000 + k) for k in range(50)]
    edges += edges[:40] + [(7, 7), (9999, 9999), (None, 3)]
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for chunk in (7, 150, 10**6):
        got = module.connected_components(frame, chunk).collect()
        assert {r.node: r.component for r in got} == _slow(edges) and len(got) == len(_slow(edges))
    assert module.connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_a_small_table_takes_no_rounds(spark, monkeypatch):
    """A chain of 600 edges in nine partitions took a table written for each of many rounds before."""
    made, written = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: made.append(name) or written(df, name))
    got = module.connected_components(spark.createDataFrame([(k, k + 1) for k in range(600)], "a long, b long").repartition(9)).collect()
    assert len(got) == 601 and {r.component for r in got} == {0} and len(made) == 2
