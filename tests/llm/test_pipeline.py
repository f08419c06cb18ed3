import random

import pytest

import corpus_pipeline
from tests.llm.test_simhash import slow_components
from tests.llm.test_similar_texts import _near, _sets
from tests.llm.test_substring_dedup import slow


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    words = lambda n: [rng.choice("bdgklm") + rng.choice("aeiou") + rng.choice("nrst") + rng.choice("aeiou") for _ in range(n)]
    item, passage = words(40), words(70)
    docs, labels = {}, []
    for d in range(160):
        text = words(rng.randrange(60, 160))
        if d % 4 == 1:
            text[10:10] = ["grudge", "awful"]
        if d in (50, 90):
            text[20:20] = passage
        if d == 20:
            text += item
        if d == 70:
            text = docs[30].split()
        docs[d] = " ".join(text)
        labels.append((d, 1, int(d % 4 == 1)))
    rows = [(d, t, "en", "s", len(t)) for d, t in docs.items()]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "encoding":
            assert now.dtypes == [tuple(x.split()) for x in ("doc_id bigint", "text string", "lang string", "source string", "n_chars bigint")]
            now.write.parquet(f"{tmp_path}/{name}.parquet")
            now = spark.read.parquet(f"{tmp_path}/{name}.parquet")
            seen[name] = {r.doc_id: r.text for r in now.collect()}
    assert set(seen["toxicity"]) == {d for d in docs if d % 4 != 1}
    sets = {d: _sets(t) for d, t in seen["toxicity"].items()}
    top = slow_components(sets, lambda a, b: _near(sets[a], sets[b]))
    assert set(seen["simhash_dedup"]) == {d for d in sets if top[d] == d} and 70 not in seen["simhash_dedup"]
    want = {d: kept or seen["simhash_dedup"][d] for d, _, _, _, kept in slow(list(seen["simhash_dedup"].items()))}
    assert seen["substring_dedup"] == want and " ".join(passage) not in want[90]
    assert set(seen["decontamination"]) == set(want) - {20}
    assert {r.doc_id for r in now.collect()} == set(seen["decontamination"])


KINDS = "doc_id long, text string, lang string, kept string, n_chars long, text_hash int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Odd documents: null and repeated ids, one id with two texts, null, empty and very long texts, extra columns with clashing names."""
    folder = tmp_path_factory.mktemp("odd")
    rng = random.Random(10)
    words = lambda n: " ".join(rng.choice("bdgklm") + rng.choice("aeiou") + rng.choice("nrst") + rng.choice("aeiou") for _ in range(n))
    item, passage, clean = words(40), words(60), [words(70) for _ in range(30)]
    toxic = [" ".join([words(10), "grudge awful grudge awful", words(10)]) for _ in range(12)]
    texts = {"item": item, "passage": passage, "long": words(150_000), "clean": clean, "toxic": toxic[0]}
    docs = [(d, t, 1) for d, t in enumerate(clean + toxic)]
    docs += [(None, item, 2), (None, toxic[0], 2), (None, clean[1], 2), (None, None, 2), (100, None, 2), (101, "", 2), (102, texts["long"], 2), (3, clean[3], 2)]
    docs += [(110, words(50) + " " + item, 3), (110, clean[4] + " " + words(60), 3), (111, passage + " " + words(30), 3), (112, words(20) + " " + passage, 3), (112, words(85), 3), (113, clean[5], 3)]
    rows = [(d, t, None, "mine", len(t) if t else None, k) for d, t, k in docs]
    spark.createDataFrame(rows, KINDS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, int(d >= 30)) for d in range(42)] + [(None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, spark.read.parquet(f"{folder}/documents.parquet")


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def _gone(before, after):
    left = _rows(after)
    return sorted(((r[0], r[1]) for r in _rows(before) if not (r in left and (left.remove(r) or True))), key=str)


def test_toxicity_of_odd_rows(spark, odd):
    folder, texts, docs = odd
    gone = _gone(docs, corpus_pipeline.toxicity(spark, docs, folder))
    assert len(gone) == 13 and (None, texts["toxic"]) in gone


def test_near_duplicates_of_odd_rows(spark, odd):
    folder, texts, docs = odd
    gone = _gone(docs, corpus_pipeline.simhash_dedup(spark, docs, folder))
    assert gone == sorted([(101, ""), (113, texts["clean"][5])], key=str)


def test_repeats_of_odd_rows(spark, odd):
    folder, texts, docs = odd
    got, before = corpus_pipeline.substring_dedup(spark, docs, folder), _rows(docs)
    assert got.columns == docs.columns and got.count() == len(before)
    want = sorted(((r[0], kept if kept is not None else r[1], *r[2:4], len(kept) if kept is not None else r[4], r[5]) for r, kept in zip(before, [x for _, _, _, _, x in slow_rows(before)], strict=True)), key=str)
    assert _rows(got) == want


def slow_rows(rows):
    """The brute-force cut of each row, in the order of rows."""
    found = slow([(r[0], r[1]) for r in rows])
    return [next(x for x in found if (x[0], x[1]) == (r[0], len((r[1] or "").split()))) for r in rows]  # texts of one id differ in length


def test_contamination_of_odd_rows(spark, odd):
    folder, texts, docs = odd
    gone = _gone(docs, corpus_pipeline.decontamination(spark, docs, folder))
    assert len(gone) == 2 and {d for d, _ in gone} == {None, 110} and all(texts["item"] in t for _, t in gone)


def test_encoding_of_odd_rows_and_run(spark, odd):
    folder, texts, docs = odd
    got = corpus_pipeline.encoding(spark, docs, folder)
    assert got.count() == docs.count() and {r.n_tokens for r in got.where("doc_id IN (100, 101)").collect()} == {0}
    assert corpus_pipeline.run(spark, folder).count() == docs.count() - 13 - 3 - 2 + 1  # the empty text, two copies; 110 is one row of two


def test_empty_tables(spark, odd, tmp_path):
    folder, _, docs = odd
    for name, kinds in (("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        if name in ("toxicity", "decontamination"):
            assert _rows(stage(spark, docs, str(tmp_path))) == _rows(docs)


def test_passages_are_cut_before_all_texts_are_joined(spark):
    """The shuffles that find passages are no part of the job that joins the cut texts, so their files don't lie on disk with its own."""
    words = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    rows = [(1, words("a", 40)), (2, words("b", 20) + " " + words("a", 40)), (3, None)]
    out = corpus_pipeline.substring_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert "CoGroups" not in out._jdf.queryExecution().toString()
    assert _rows(out) == _rows(spark.createDataFrame([rows[0], (2, words("b", 20)), rows[2]], "doc_id long, text string"))
