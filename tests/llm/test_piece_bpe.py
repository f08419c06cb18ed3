import hashlib
import random
import time

import pytest
import sentencepiece

from codequarry.llm import piece_bpe
from codequarry.llm.piece_bpe import PieceModel, encoded, public_path


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_path())


@pytest.fixture(scope="module")
def own():
    return PieceModel(public_path())


def texts():
    rng = random.Random(11)
    alphabet = "etaoinsrhl   ▁\n\t\r.,'\"();{}<>0123ABCÄéß日本語𝄞\x00 "
    yield from ("", " ", "a", " a", "  a  b   ", "▁", "\n\n", "a" * 300, " " * 75, "<s> </s> <0x0A>", "ab" * 5000, "﻿x", "́e")
    for n in (3, 8, 30, 120):
        for _ in range(1500):
            yield "".join(rng.choice(alphabet) for _ in range(rng.randrange(n)))
    for _ in range(1500):
        yield " " * rng.randrange(40) + "".join(rng.choice("thernd onble") for _ in range(rng.randrange(60))) + " " * rng.randrange(40) + "x"


def test_against_the_library(own, library):
    for t in texts():
        ids = own.encode(t)
        want = library.encode(t)
        assert ids == ",".join(map(str, want)), repr(t)
        assert own.decode(ids) == library.decode(want), repr(t)


def test_query_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(list(texts())[:40])] + [(None, "null id"), (90, None), (91, "twice"), (91, "twice"), (92, "long " * 20_000)]
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, ids string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in rows:
        ids = library.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded(frame, public_path()).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert encoded(frame.limit(0), public_path()).count() == 0


def test_units_end_where_no_piece_reaches(library):
    own = PieceModel(public_path())
    text = " ".join(f"{a}thing{b}" for a in ("", "(", '"') for b in (".", ",", ";", ":", "!", "?", ")", "7", "\n", "語", "𝄞"))
    assert own.encode(text) == ",".join(map(str, library.encode(text)))
    assert len([u for u in own.known if "thing" in u]) <= 2  # at the start of a word and after another character: not once for each neighbour


def test_pieces_do_not_span_units(own):
    pieces = [p for p in own.id if len(p) > 1]
    assert len(pieces) > 25_000
    assert all(own.units.fullmatch(p) for p in pieces)


def test_what_is_in_use_stays_remembered(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 50)
    own, worked_out = PieceModel(public_path()), []
    encode_unit = own.unit_ids
    monkeypatch.setattr(own, "unit_ids", lambda u: worked_out.append(u) or encode_unit(u))
    if hasattr(own.known, "work_out"):
        own.known.work_out = own.unit_ids
    rng = random.Random(5)
    words = ["often " + "".join(rng.choice("thernd") for _ in range(7)) for _ in range(1000)]
    text = " ".join(words)
    assert own.encode(text) == ",".join(map(str, library.encode(text)))
    assert worked_out.count(" often") + worked_out.count("▁often") == 1
    assert len(own.known) <= 50 and len(own.pairs) <= 50


def test_long_units_are_linear_and_right(own, library):
    rng = random.Random(6)
    for chars in ("ab", "thernd", "ewhshnd", "=-_", "  x"):
        text = "".join(rng.choice(chars) for _ in range(60_000))
        assert own.encode(text) == ",".join(map(str, library.encode(text)))

    def seconds(n):
        text = "".join(rng.choice("thernd") for _ in range(n))
        began = time.thread_time()
        own.encode(text)
        return time.thread_time() - began

    seconds(20_000)
    assert seconds(400_000) < 60 * seconds(20_000) + 1
