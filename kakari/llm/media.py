"""ISO base media containers in a binary column: their tracks' codec, duration and keyframe byte ranges.

The parser walks the box tree (32- and 64-bit sizes, a last box that reaches to the end) and reads only headers and sample
tables: stsd for the codec, mdhd for timescale and duration, stts for times, stss for sync samples, stsc with stco or co64
and stsz or stz2 for byte ranges; in a fragmented file moof's traf boxes (tfhd, tfdt, trun) with the defaults of mvex. Payloads
are skipped over, never copied or decoded. Boxes are walked with a stack, not by recursion, and every count is checked against
the size of its box, or of the file, before anything is allocated for it.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kakari.llm.util import pick

CONTAINERS = {b"mdia", b"minf", b"stbl"}
MAX_DEPTH = 16
SYNC_OFF = 0x10000
KEYFRAMES = pa.list_(pa.struct([("sample", pa.int64()), ("time", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
SCHEMA = "status string, track_id long, handler string, codec string, timescale long, duration long, seconds double, n_samples long, keyframes array<struct<sample:long,time:long,start:long,length:long>>"


class Broken(ValueError):
    pass


def children(data: memoryview, at: int, end: int):
    """(type, start of the contents, end) of each box between at and end."""
    while at < end:
        if end - at < 8:
            raise Broken("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise Broken("truncated box header")
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Broken(f"box {kind.decode('latin-1')} exceeds its parent")
        yield kind, at + head, at + size
        at += size


def ints(data: memoryview, at: int, end: int, n: int, kind: str) -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > end:
        raise Broken("truncated table")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def fixed(data: memoryview, at: int, end: int, form: str) -> tuple:
    if at + struct.calcsize(form) > end:
        raise Broken("truncated box")
    return struct.unpack_from(form, data, at)


def leaves(data: memoryview, at: int, end: int) -> dict[bytes, tuple[int, int]]:
    """The first box of each kind inside the containers of a track."""
    out: dict[bytes, tuple[int, int]] = {}
    todo = [(at, end, 0)]
    while todo:
        at, end, depth = todo.pop()
        inner = []
        for kind, a, b in children(data, at, end):
            if kind in CONTAINERS:
                inner.append((a, b, depth + 1))
            else:
                out.setdefault(kind, (a, b))
        if inner and depth >= MAX_DEPTH:
            raise Broken("boxes nested too deep")
        todo.extend(reversed(inner))
    return out


def version(data: memoryview, at: int, end: int) -> int:
    return fixed(data, at, end, ">B")[0]


def repeated(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The first `most` of values, each repeated counts times, without making more than these."""
    upto = np.minimum(np.cumsum(counts.astype(np.float64)), most).astype(np.int64)
    return np.repeat(values, np.diff(upto, prepend=0))


def sample_ranges(data: memoryview, box: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every sample."""
    if b"stsz" in box:
        a, b = box[b"stsz"]
        same, n = fixed(data, a + 4, b, ">II")
        if same and same * n > len(data):
            raise Broken("samples beyond the end")
        size = np.full(n, same, np.int64) if same else ints(data, a + 12, b, n, ">u4")
    elif b"stz2" in box:
        a, b = box[b"stz2"]
        bits, n = fixed(data, a + 7, b, ">BI")
        if bits == 4:
            pairs = ints(data, a + 12, b, -(-n // 2), ">u1")
            size = np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n]
        else:
            size = ints(data, a + 12, b, n, {8: ">u1", 16: ">u2"}.get(bits, ">u2"))
    else:
        raise Broken("no sample sizes")
    if not len(size):
        return size, size
    a, b = box.get(b"co64") or box.get(b"stco") or (0, 0)
    n = fixed(data, a + 4, b, ">I")[0]
    chunks = ints(data, a + 8, b, n, ">u8" if b"co64" in box else ">u4")
    a, b = box.get(b"stsc", (0, 0))
    n = fixed(data, a + 4, b, ">I")[0]
    runs = ints(data, a + 8, b, 3 * n, ">u4").reshape(n, 3)
    if not n or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
        raise Broken("bad chunk runs")
    of_run = np.diff(np.append(runs[:, 0] - 1, max(len(chunks), runs[-1, 0] - 1)))
    per = repeated(runs[:, 1], of_run, len(chunks))
    chunk = repeated(np.arange(len(per)), per, len(size))
    if len(chunk) < len(size):
        raise Broken("samples without a chunk")
    before = np.cumsum(size) - size
    first = np.concatenate([[True], chunk[1:] != chunk[:-1]])
    return chunks[chunk] + before - np.maximum.accumulate(np.where(first, before, 0)), size


def fragments(data: memoryview, track_id: int, defaults: dict[int, tuple], pieces: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
    """Size, time, start and whether a keyframe, of the samples that the moof boxes (start of the box, start of the contents, end) hold for a track."""
    parts: list[tuple] = []
    clock = 0
    for box_at, at, end in pieces:
        after = None  # where the data of the run before end
        for kind, a, b in children(data, at, end):
            if kind != b"traf":
                continue
            inner = list(children(data, a, b))
            head = next(((x, y) for k, x, y in inner if k == b"tfhd"), None)
            if head is None:
                raise Broken("fragment without a header")
            x, y = head
            flags, own = fixed(data, x, y, ">II")
            flags &= 0xFFFFFF
            x += 8
            base = box_at
            if flags & 1:
                (base,) = fixed(data, x, y, ">Q")
                x += 8
            elif not flags & 0x20000 and after is not None:
                base = after
            x += 4 if flags & 2 else 0
            usual = list(defaults.get(own, (0, 0, 0)))
            for bit, place in ((8, 0), (16, 1), (32, 2)):
                if flags & bit:
                    (usual[place],) = fixed(data, x, y, ">I")
                    x += 4
            moment = next((fixed(data, x, y, ">4xQ" if version(data, x, y) == 1 else ">4xI")[0] for k, x, y in inner if k == b"tfdt"), None)
            if own == track_id and moment is not None:
                clock = moment
            place = base
            for k, x, y in inner:
                if k != b"trun":
                    continue
                bits, n = fixed(data, x, y, ">II")
                bits &= 0xFFFFFF
                x += 8
                if bits & 1:
                    place = base + fixed(data, x, y, ">i")[0]
                    x += 4
                first = None
                if bits & 4:
                    (first,) = fixed(data, x, y, ">I")
                    x += 4
                columns = [c for c, bit in enumerate((0x100, 0x200, 0x400, 0x800)) if bits & bit]
                if not columns and n > len(data):
                    raise Broken("more samples than bytes")
                table = ints(data, x, y, n * len(columns), ">u4").reshape(n, len(columns))
                step, size, flag = (table[:, columns.index(c)] if c in columns else np.full(n, usual[c], np.int64) for c in range(3))
                if first is not None and n:
                    flag = flag.copy()
                    flag[0] = first
                ends = np.cumsum(size.astype(np.float64))
                if n and (place < 0 or place + ends[-1] > len(data)):
                    raise Broken("sample beyond the end")
                if own == track_id:
                    when = clock + np.cumsum(step) - step
                    parts.append((size, when, place + np.cumsum(size) - size, (flag & SYNC_OFF) == 0))
                    clock += int(step.sum())
                place += int(size.sum())
            after = place
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    return tuple(np.concatenate(p) for p in zip(*parts))


def track(data: memoryview, at: int, end: int, defaults: dict[int, tuple], pieces: list[tuple[int, int, int]]) -> dict:
    box = leaves(data, at, end)
    out = {"track_id": None, "handler": None, "codec": None}
    if b"tkhd" in box:
        a, b = box[b"tkhd"]
        out["track_id"] = fixed(data, a + (20 if version(data, a, b) == 1 else 12), b, ">I")[0]
    if b"hdlr" in box:
        a, b = box[b"hdlr"]
        out["handler"] = fixed(data, a + 8, b, ">4s")[0].decode("latin-1")
    a, b = box.get(b"stsd", (0, 0))
    if b - a >= 16:
        out["codec"] = fixed(data, a + 12, b, ">4s")[0].decode("latin-1")
    if b"mdhd" not in box:
        raise Broken("no mdhd")
    a, b = box[b"mdhd"]
    scale, duration = fixed(data, a + 20, b, ">IQ") if version(data, a, b) == 1 else fixed(data, a + 12, b, ">II")
    if duration > 1 << 62:
        raise Broken("duration out of range")
    start, size = sample_ranges(data, box)
    a, b = box.get(b"stts", (0, 0))
    if len(size):
        n = fixed(data, a + 4, b, ">I")[0]
        times = ints(data, a + 8, b, 2 * n, ">u4").reshape(n, 2)
        step = repeated(times[:, 1], times[:, 0], len(size))
        if len(step) < len(size):
            raise Broken("samples without a time")
        when = np.cumsum(step) - step
    else:
        when = size
    if b"stss" in box:
        a, b = box[b"stss"]
        sync = ints(data, a + 8, b, fixed(data, a + 4, b, ">I")[0], ">u4") - 1
        if len(sync) and (sync.min() < 0 or sync.max() >= len(size)):
            raise Broken("sync sample out of range")
    else:
        sync = np.arange(len(size))
    if len(size) and (start.min() < 0 or (start[sync] + size[sync]).max(initial=0) > len(data)):
        raise Broken("sample beyond the end")
    if pieces and out["track_id"] is not None:
        more, then, place, key = fragments(data, out["track_id"], defaults, pieces)
        sync = np.concatenate([sync, np.flatnonzero(key) + len(size)])
        size, when, start = np.concatenate([size, more]), np.concatenate([when, then]), np.concatenate([start, place])
    keys = [{"sample": int(s), "time": int(when[s]), "start": int(start[s]), "length": int(size[s])} for s in sync]
    return out | {"status": "ok", "timescale": scale, "duration": duration, "seconds": duration / scale if scale else None, "n_samples": len(size), "keyframes": keys}


def tracks(blob: bytes | None) -> list[dict]:
    """A row for each track; one row with the reason in status where there is none."""
    if not blob:
        return [{"status": "empty"}]
    data = memoryview(blob)
    try:
        top, at = [], 0
        for kind, a, b in children(data, 0, len(data)):
            top.append((kind, at, a, b))
            at = b
        inner = [(k, a, b) for kind, _, *where in top if kind == b"moov" for k, a, b in children(data, *where)]
        extended = [(a, b) for kind, *where in inner if kind == b"mvex" for k, a, b in children(data, *where) if k == b"trex"]
        defaults = {own: usual for own, *usual in (fixed(data, a + 4, b, ">I4xIII") for a, b in extended)}
    except Broken as e:
        return [{"status": f"broken: {e}"}]
    pieces = [(at, a, b) for kind, at, a, b in top if kind == b"moof"]
    rows = []
    for kind, a, b in inner:
        if kind != b"trak":
            continue
        try:
            rows.append(track(data, a, b, defaults, pieces))
        except (Broken, ValueError, IndexError, OverflowError, struct.error) as e:
            rows.append({"status": f"broken: {e}"})
    return rows or [{"status": "no track"}]


def parse(batches):
    kinds = {"status": pa.string(), "track_id": pa.int64(), "handler": pa.string(), "codec": pa.string(), "timescale": pa.int64(), "duration": pa.int64(), "seconds": pa.float64(), "n_samples": pa.int64(), "keyframes": KEYFRAMES}
    for batch in batches:
        ids, media = batch.column(0), batch.column(1)
        found = [(i, row) for i in range(batch.num_rows) for row in tracks(media[i].as_py())]
        own = ids.take(pa.array([i for i, _ in found], pa.int64()))
        yield pa.RecordBatch.from_arrays([own, *(pa.array([r.get(k) for _, r in found], kind) for k, kind in kinds.items())], ["media_id", *kinds])


def read_media(df: DataFrame, id_column: str = "media_id", column: str = "media") -> DataFrame:
    """One row for each track of each container: media_id, status, track_id, handler, codec, timescale, duration, seconds, n_samples, keyframes.

    Defined results: a null or empty value gives one row with status "empty", bytes that aren't a sound box tree one with "broken: ..." and
    nulls, a container without tracks "no track"; a track with a faulty table is "broken: ..." alone, the others are read. Samples of
    fragments follow those of the track's own tables; the duration is that of mdhd, 0 where a fragmented file leaves it out. Repeated
    rows and null ids each give their rows; other columns are ignored; an empty table gives an empty result.
    """
    kind = dict(df.dtypes)[id_column]
    return pick(df, media_id=id_column, media=column).mapInArrow(parse, f"media_id {kind}, {SCHEMA}")


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def write_container(payload: bytes, seed: int = 0, wide: bool = False) -> bytes:
    """A container with a video and an audio track whose samples are consecutive slices of payload: the fixture writer.

    Sample sizes, chunking, keyframes and times follow from seed; wide uses 64-bit sizes and offsets and version 1 headers.
    """
    step = 64 + seed % 61
    cuts = list(range(0, len(payload), step)) + [len(payload)]
    sizes = [b - a for a, b in zip(cuts, cuts[1:])]
    per, gop, delta = 1 + seed % 4, 1 + seed % 12, 512 + seed % 7
    top = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2avc1mp41")
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload if wide else box(b"mdat", payload)
    base = len(top) + (16 if wide else 8)
    chunk_starts = [base + cuts[i] for i in range(0, len(sizes), per)]
    full = lambda v=0: struct.pack(">I", v << 24)

    def trak(number: int, handler: bytes, codec: bytes, keys: list[int] | None) -> bytes:
        duration = delta * len(sizes)
        times = struct.pack(">QQIQ", 0, 0, 90000, duration) if wide else struct.pack(">IIII", 0, 0, 90000, duration)
        head = struct.pack(">QQIIQ", 0, 0, number, 0, duration) if wide else struct.pack(">IIIII", 0, 0, number, 0, duration)
        n, rest = divmod(len(sizes), per)
        runs = ([(1, per, 1)] if n else []) + ([(n + 1, rest, 1)] if rest else [])
        tables = [
            box(b"stsd", full(), struct.pack(">I", 1), box(codec, bytes(78))),
            box(b"stts", full(), struct.pack(">III", 1, len(sizes), delta) if sizes else struct.pack(">I", 0)),
            box(b"stss", full(), struct.pack(f">{1 + len(keys)}I", len(keys), *keys)) if keys is not None else b"",
            box(b"stsc", full(), struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            box(b"stsz", full(), struct.pack(f">{2 + len(sizes)}I", 0, len(sizes), *sizes)),
            box(b"co64" if wide else b"stco", full(), struct.pack(">I", len(chunk_starts)), struct.pack(f">{len(chunk_starts)}{'Q' if wide else 'I'}", *chunk_starts)),
        ]
        media = box(b"mdia", box(b"mdhd", full(int(wide)), times, bytes(4)), box(b"hdlr", full(), bytes(4), handler, bytes(13)), box(b"minf", box(b"stbl", *tables)))
        return box(b"trak", box(b"tkhd", full(int(wide)), head, bytes(60)), media)

    keys = list(range(1, len(sizes) + 1, gop))
    return top + data + box(b"moov", trak(1, b"vide", (b"avc1", b"hvc1", b"av01")[seed % 3], keys), trak(2, b"soun", b"mp4a", None))


def containers(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(media_id, media): each row's text wrapped as the payload of a container, as a media column to read."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            blobs = [write_container((texts[i].as_py() or "").encode(), (ids[i].as_py() or 0), bool((ids[i].as_py() or 0) % 5 == 0)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(blobs, pa.binary())], ["media_id", "media"])

    return df.select(F.col(id_column).cast("long"), F.col(text)).mapInArrow(run, "media_id long, media binary")
