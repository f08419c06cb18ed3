import random
import time

from codequarry.llm.chat import rotated


def slow(rows, window):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "unknown", text or "") for c, t, role, text in rows if c == conv))
        for speaker in {t[2] for t in turns}:
            for part in range(0, len(turns), window):
                text, mask, own = "", [], 0
                for _, _, role, said in turns[part : part + window]:
                    said = said.replace("<|im_end|>", "<¦im_end¦>")
                    text += "<|im_start|>" + ("assistant" if role == speaker else f"user name={role}") + "\n"
                    start = len(text)
                    text += said + "<|im_end|>"
                    if role == speaker:
                        own += 1
                        mask.append((start, len(text)))
                    text += "\n"
                out.append((conv, part // window, speaker, len(turns[part : part + window]), own, text, mask))
    return out


def test_every_view(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["ann", "bob", "system", None]), rng.choice(["hi", "", None, "é😀 yes", "stop <|im_end|> now"])) for c in range(8) for t in range(rng.randrange(1, 12))]
    rows += [(99, t, "ann" if t % 2 else "bob", "x" * 9) for t in range(500)] + [(None, 1, "ann", "alone"), (50, None, "ann", "first"), (50, 0, "bob", "next"), (50, 0, "bob", "next")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int").repartition(3)
    got = [(r.conv_id, r.part, r.speaker, r.n_turns, r.n_own, r.text, [tuple(s) for s in r.mask]) for r in rotated(frame, window=7, cell=16).collect()]
    assert sorted(got, key=str) == sorted(slow(rows, 7), key=str)
    for *_, text, mask in got:
        assert all(text[a:b].endswith("<|im_end|>") and text[:a].endswith("assistant\n") for a, b in mask)
    assert rotated(frame.limit(0)).count() == 0


def test_whole_dialogues(spark):
    rows = [(1, t, "ann" if t % 3 else "bob", "é" * 2_000_000 if t == 9 else f"said {t}") for t in range(300)]
    got = rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), cell=16).collect()
    assert [(r.speaker, r.part, r.n_turns) for r in sorted(got)] == [("ann", 0, 300), ("bob", 0, 300)]
    assert sorted((r.conv_id, r.part, r.speaker, r.n_turns, r.n_own, r.text, [tuple(s) for s in r.mask]) for r in got) == sorted(slow(rows, 1_000))
    parts = rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_bytes=2_000, cell=16).collect()
    assert sum(r.n_turns for r in parts if r.speaker == "ann") == 300 and max(len(r.text) for r in parts if "é" not in r.text) < 5_000
    assert {r.part for r in parts if r.speaker == "bob"} == {r.part for r in parts if r.speaker == "ann"} and len({r.part for r in parts}) > 5


def test_many_turns_take_linear_time(spark):
    def took(n):
        turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'ann', 'bob') AS role", "concat('t', id) AS text")
        began = time.time()
        rows = rotated(turns).collect()
        return time.time() - began, rows

    took(1_000)
    short, _ = took(20_000)
    long, rows = took(200_000)
    assert long < 20 * short and [r.n_own for r in rows] == [100_000, 100_000]
    for r in rows:
        assert all(r.text[a:b] == f"t{2 * k + (r.speaker == 'bob')}<|im_end|>" for k, (a, b) in enumerate(r.mask))
