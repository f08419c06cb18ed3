import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.llm.mpeg_audio import crc16, header, op9_mpeg_audio, parse, payload, read_media, stored, written_media


def test_known_headers_and_checksum():
    f = header(bytes((0xFF, 0xFB, 0x90, 0x00)), 0)  # 128 kbit/s, 44.1 kHz, layer III
    assert (f.size, f.bitrate, f.rate, f.samples, f.mono, f.protected) == (417, 128, 44100, 1152, False, False)
    f = header(bytes((0xFF, 0xF3, 0x82, 0xC0)), 0)  # MPEG-2, 64 kbit/s, 22.05 kHz, padded
    assert (f.version, f.size, f.samples, f.mono) == (2, 209, 576, True)
    assert header(b"\xff\xff\xff\xff", 0) is None and header(b"\xff\xfb", 0) is None
    assert crc16(b"123456789") == 0xAEE7


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4000))
def test_round_trip_of_any_bytes(data):
    media = stored(data)
    s = parse(media)
    assert payload(media, s) == data and not s.bad_checksums and not s.skipped
    assert s.table.get("frames", 0) == len(s.frames)
    assert s.duration[0] == 1152 * len(s.frames)


def test_resynchronises_and_counts_bad_checksums():
    media = stored(random.Random(1).randbytes(5000).replace(b"\xff", b"\xfe"))
    good = parse(media)
    at = good.frames[2].offset
    junk = media[:at] + b"\xff\xfbjunk\xff" + media[at:]
    s = parse(junk)
    assert len(s.frames) == len(good.frames) and s.skipped == 7
    assert [f.offset for f in s.frames[2:]] == [f.offset + 7 for f in good.frames[2:]]
    hurt = bytearray(media)
    hurt[at + 8] ^= 1
    assert parse(bytes(hurt)).bad_checksums == 1
    assert len(parse(media[:-1]).frames) == len(good.frames) - 1
    assert len(parse(media + b"TAG" + b"title".ljust(125)).frames) == len(good.frames)


def test_rows(spark):
    rows = [(1, "hello"), (2, ""), (3, None), (None, "x" * 192), (5, "é" * 100_000), (1, "hello")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, media int")
    got = read_media(written_media(frame)).collect()
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want.append((d, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(want, key=str)
    assert all(r.feature.endswith("table=ok crc=ok") for r in got), [r.feature for r in got]
    assert len({(r.media_sha256, r.feature) for r in got if r.n_bytes == 5}) == 1
    odd = spark.createDataFrame([(1, 0, None), (2, 0, b"not audio \xff\xfb")], "doc_id long, n_bytes long, media binary")
    assert [r.n_frames for r in read_media(odd).collect()] == [0, 0]
    assert read_media(written_media(frame.limit(0))).count() == 0


def test_offsets_in_the_query_and_other_tables(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 5_000), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op9_mpeg_audio(spark, str(tmp_path)).collect():
        media = stored(("a" * 5_000 if r.doc_id == 1 else "").encode().ljust(5_184 if r.doc_id == 1 else 192))
        assert [int(x) for x in r.seek.split(",")] == [f.offset for f in parse(media).frames] and len(r.seek.split(",")) == r.n_frames
    media = bytearray(stored(b"x" * 2_000))
    good = parse(bytes(media))
    at = media.index(b"Xing") - 23
    media[at + 23 : at + 27] = b"none"
    media[at + 36 : at + 54] = b"VBRI" + bytes(6) + (777).to_bytes(4, "big") + (3).to_bytes(4, "big")
    s = parse(bytes(media))
    assert s.table == {"bytes": 777, "frames": 3} and [f.offset for f in s.frames] == [f.offset for f in good.frames]
