"""Containers put together here byte by byte, broken ones and fragmented ones among them; none comes from the operator's own writer."""

import random
import struct

import pytest

from kakari.llm import media


def b(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def u(*values):
    return struct.pack(f">{len(values)}I", *values)


def trak(number, tables, mdhd=None, tkhd=None, handler=b"vide"):
    mdhd = b(b"mdhd", u(0, 0, 0, 1000, 5000), bytes(4)) if mdhd is None else mdhd
    tkhd = b(b"tkhd", u(0, 0, 0, number), bytes(68)) if tkhd is None else tkhd
    return b(b"trak", tkhd, b(b"mdia", mdhd, b(b"hdlr", u(0, 0), handler, bytes(13)), b(b"minf", b(b"stbl", *tables))))


def tables(sizes, offsets, runs, times, sync=None, codec=b"hvc1"):
    out = [b(b"stsd", u(0, 1), b(codec, bytes(20))), b(b"stts", u(0, len(times)), *(u(*t) for t in times)), b(b"stsc", u(0, len(runs)), *(u(*r) for r in runs)), b(b"stsz", u(0, 0, len(sizes)), u(*sizes)), b(b"stco", u(0, len(offsets)), u(*offsets))]
    return out + ([b(b"stss", u(0, len(sync)), u(*sync))] if sync else [])


def test_uneven_chunks_and_times():
    payload = bytes(range(200))
    at = 8 + 8
    data = b(b"ftyp", b"isom") + b""
    at = len(data) + 8
    sizes = [10, 20, 30, 5, 7]
    # chunks of 2, 2 and 1 samples, the second one lying before the first in the file
    moov = b(b"moov", trak(7, tables(sizes, [at + 50, at, at + 120], [(1, 2, 1), (3, 1, 1)], [(2, 100), (3, 40)], [1, 4, 5])))
    (row,) = media.tracks(data + b(b"mdat", payload) + moov)
    want = [(0, 0, at + 50, 10), (3, 240, at + 30, 5), (4, 280, at + 120, 7)]
    assert row["status"] == "ok" and row["codec"] == "hvc1" and row["track_id"] == 7 and row["n_samples"] == 5 and row["seconds"] == 5.0
    assert [tuple(k.values()) for k in row["keyframes"]] == want


def test_fragments():
    empty = tables([], [], [], [])
    head = b(b"ftyp", b"iso5") + b(b"moov", trak(1, empty), trak(2, empty, handler=b"soun"), b(b"mvex", b(b"trex", u(0, 1, 1, 50, 11, media.SYNC_OFF)), b(b"trex", u(0, 2, 1, 20, 4, 0))))

    def moof(offset):
        video = b(b"traf", b(b"tfhd", u(0x020000, 1)), b(b"tfdt", u(0, 1000)), b(b"trun", u(0x000205, 3), struct.pack(">i", offset), u(0), u(9, 8, 7)))
        sound = b(b"traf", b(b"tfhd", u(0x020000, 2)), b(b"trun", u(0x000001, 2), struct.pack(">i", offset + 24)))
        return b(b"moof", b(b"mfhd", u(0, 1)), video, sound)

    piece = moof(len(moof(0)) + 8) + b(b"mdat", bytes(32))
    blob = head + piece + piece
    video, sound = media.tracks(blob)
    first = len(head) + len(moof(0)) + 8
    assert video["n_samples"] == 6 and [tuple(k.values()) for k in video["keyframes"]] == [(0, 1000, first, 9), (3, 1000, first + len(piece), 9)]
    assert sound["n_samples"] == 4 and [tuple(k.values()) for k in sound["keyframes"]] == [(0, 0, first + 24, 4), (1, 20, first + 28, 4), (2, 40, first + len(piece) + 24, 4), (3, 60, first + len(piece) + 28, 4)]


def nested(n):
    out = b""
    for _ in range(n):
        out = b(b"stbl", out)
    return out


GOOD = tables([4], [0], [(1, 1, 1)], [(1, 1)])
FAULTY = {
    "empty mdhd": trak(1, GOOD, mdhd=b(b"mdhd")),
    "empty tkhd": trak(1, GOOD, tkhd=b(b"tkhd")),
    "nested": trak(1, [nested(1500)]),
    "many equal samples": trak(1, [*GOOD[:3], b(b"stsz", u(0, 9, 0xFFFFFFFF)), GOOD[4]]),
    "huge times": trak(1, [GOOD[0], b(b"stts", u(0, 1), u(0, 0)), *GOOD[2:]]),
    "huge table": trak(1, [*GOOD[:3], b(b"stsz", u(0, 0, 0xFFFFFFFF)), GOOD[4]]),
    "no chunks": trak(1, [*GOOD[:4], b(b"stco", u(0, 0))]),
    "beyond": trak(1, tables([40000], [0], [(1, 1, 1)], [(1, 1)])),
}


@pytest.mark.parametrize("name", FAULTY)
def test_a_faulty_track_stands_alone(name):
    rows = media.tracks(b(b"moov", FAULTY[name], trak(2, GOOD)))
    assert rows[0]["status"].startswith("broken: ") and rows[1]["status"] == "ok"
    assert [tuple(k.values()) for k in rows[1]["keyframes"]] == [(0, 0, 0, 4)]


def test_large_counts_cost_nothing():
    blob = b(b"moov", trak(1, [GOOD[0], b(b"stts", u(0, 1), u(0xFFFFFFFF, 1)), b(b"stsc", u(0, 1), u(1, 0xFFFFFFFF, 1)), *GOOD[3:]]))
    assert media.tracks(blob)[0]["status"] == "ok"


def test_damaged_bytes_never_raise():
    rng = random.Random(1)
    good = b(b"ftyp", b"isom") + b(b"mdat", bytes(64)) + b(b"moov", trak(1, tables([4, 5, 6], [16, 30], [(1, 2, 1), (2, 1, 1)], [(3, 10)], [1, 3])))
    for _ in range(3000):
        blob = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            blob[rng.randrange(len(blob))] = rng.choice((0, 1, 255, rng.randrange(256)))
        if rng.random() < 0.3:
            del blob[rng.randrange(len(blob)) :]
        assert all(r["status"] for r in media.tracks(bytes(blob)))
