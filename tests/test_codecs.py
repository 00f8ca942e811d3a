"""XPRESS chunks: round trips and damaged data."""

import random

import pytest

from lodestack.sources import archive, codecs


@pytest.mark.parametrize("data", [b"a", b"abc" * 3, b"x" * 70_000, bytes(range(256)) * 20, b"the cat sat on the mat and the cat sat again " * 50])
def test_round_trip(data):
    packed = codecs.compress(data)
    assert codecs.decompress(packed, len(data)) == data
    if len(data) > 2000:
        assert len(packed) < len(data)


def test_random_round_trips():
    rnd = random.Random(1)
    for _ in range(60):
        data = b"".join(rnd.choice([bytes([rnd.randrange(256)]) * rnd.randint(1, 400), rnd.randbytes(rnd.randint(1, 60)), b"frequent text "]) for _ in range(rnd.randint(1, 40)))
        assert codecs.decompress(codecs.compress(data), len(data)) == data


def test_damaged_chunks_never_give_more_than_asked():
    rnd = random.Random(2)
    good = bytearray(codecs.compress(b"some text that repeats, some text that repeats" * 30))
    for _ in range(200):
        bad = bytearray(good)
        for _ in range(3):
            bad[rnd.randrange(len(bad))] = rnd.randrange(256)
        try:
            assert len(codecs.decompress(bytes(bad), 1380)) == 1380
        except codecs.BadData:
            pass


def test_chunked_resources():
    data = random.Random(3).randbytes(5000) + b"z" * 20_000
    stored = codecs.write_chunked(data, 4096)
    assert len(stored) < len(data) and codecs.read_chunked(stored, len(data), 4096) == data


def test_compressed_archive(spark, tmp_path):
    from test_core import entry

    text = b"a line that is written again and again\n" * 400
    plain = [({"NAME": "one"}, [entry("/", 0x10), *(entry(f"/file{i}", content=text) for i in range(50))], [])]
    (tmp_path / "c.archive").write_bytes(archive.build_archive(plain, [text], compress_chunk=32768))
    assert (tmp_path / "c.archive").stat().st_size < len(text)
    got = archive.read_archives(spark, f"{tmp_path}/c.archive", "entries").collect()
    assert len(got) == 51
    blobs = archive.read_archives(spark, f"{tmp_path}/c.archive", "contents").collect()
    assert [bytes(r.content) for r in blobs] == [text] and blobs[0].is_intact
