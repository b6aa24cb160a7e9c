"""Operator 3: payloads kept as ISO media containers, and their sample tables read back.

mux() stores a payload as samples of an 8-bit audio track: ftyp, mdat, moov with the
sample tables (sizes, chunks, offsets, sync samples). probe() walks the nested boxes
and decodes the tables: codec, duration and the byte ranges that start at key samples.
It reads no sample. payload() joins the samples' bytes by those tables.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import map_rows, texts

PAD, SAMPLE, PER_CHUNK, KEY_EVERY, RATE = 64, 1024, 16, 8, 8000
#: Boxes that only hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}
#: The format's unity matrix.
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes, unit: int = PAD) -> bytes:
    """data with bytes 0 up to a positive multiple of unit."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(data: bytes) -> bytes:
    """The container of a payload, whose length is a positive multiple of PAD."""
    n_samples = -(-len(data) // SAMPLE)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"mp42")
    first = len(head) + (16 if len(data) + 8 > 0xFFFFFFFF else 8)
    even = len(data) % SAMPLE == 0
    sizes = _full(b"stsz", struct.pack(">II", SAMPLE if even else 0, n_samples), b"" if even else np.array([SAMPLE] * (n_samples - 1) + [len(data) - SAMPLE * (n_samples - 1)], ">u4").tobytes())
    chunks = -(-n_samples // PER_CHUNK)
    rest = n_samples - PER_CHUNK * (chunks - 1)
    runs = [(1, PER_CHUNK, 1)] * (chunks > 1 or rest == PER_CHUNK) + [(chunks, rest, 1)] * (rest != PER_CHUNK)
    at = [first + i * PER_CHUNK * SAMPLE for i in range(chunks)]
    wide = at[-1] > 0xFFFFFFFF
    keys = range(1, n_samples + 1, KEY_EVERY)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), struct.pack(">HHI", 0, 0, 0), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    last = len(data) - SAMPLE * (n_samples - 1)
    spans = [(n_samples, SAMPLE)] if last == SAMPLE else [(n_samples - 1, SAMPLE)] * (n_samples > 1) + [(1, last)]
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">I", len(spans)), *(struct.pack(">II", *x) for x in spans)),
        _full(b"stss", struct.pack(">I", len(keys)), np.array(keys, ">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *x) for x in runs)),
        sizes,
        _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), np.array(at, ">u8" if wide else ">u4").tobytes()),
    )
    long = len(data) > 0xFFFFFFFF
    when = struct.pack(">QQIQ", 0, 0, RATE, len(data)) if long else struct.pack(">IIII", 0, 0, RATE, len(data))
    track = struct.pack(">QQIIQ", 0, 0, 1, 0, len(data)) if long else struct.pack(">IIIII", 0, 0, 1, 0, len(data))
    movie = _box(
        b"moov",
        _full(b"mvhd", when, struct.pack(">IHHII", 0x10000, 0x100, 0, 0, 0), MATRIX, bytes(24), struct.pack(">I", 2), version=long),
        _box(
            b"trak",
            _full(b"tkhd", track, bytes(8), struct.pack(">hhHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=long, flags=7),
            _box(
                b"mdia",
                _full(b"mdhd", when, struct.pack(">HH", 0x55C4, 0), version=long),
                _full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"),
                _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
            ),
        ),
    )
    return head + _box(b"mdat", data) + movie


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    sizes: np.ndarray
    offsets: np.ndarray
    keys: np.ndarray

    def key_ranges(self) -> list[tuple[int, int]]:
        """(start, end) in the file: each key sample with the samples up to the next one, split where chunks are apart."""
        ends = self.offsets + self.sizes
        new = np.zeros(len(self.sizes), bool)
        new[self.keys - 1] = True
        new[1:] |= self.offsets[1:] != ends[:-1]
        new[:1] = True
        starts = np.flatnonzero(new)
        return list(zip(self.offsets[starts].tolist(), ends[np.append(starts[1:], len(ends)) - 1].tolist(), strict=True))


def walk(media: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, start and end of the content) of each box, outer ones first. A size of 0 reaches to the end."""
    end = len(media) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", media, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", media, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} doesn't fit")
        yield (*path, kind), body, stop
        if kind in NESTED:
            yield from walk(media, body, stop, (*path, kind))
        start = stop


def _u4(media: bytes, at: int, n: int, width: int = 4) -> np.ndarray:
    return np.frombuffer(media, f">u{width}", n, at).astype(np.int64)


def probe(media: bytes) -> list[Track]:
    """The tracks, from boxes and sample tables alone."""
    tracks: list[dict] = []
    for path, at, stop in walk(media):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"keys": None})
        elif kind == b"mdhd":
            long = media[at] == 1
            tracks[-1]["time"] = struct.unpack_from(">IQ" if long else ">II", media, at + (20 if long else 12))
        elif kind == b"stsd":
            tracks[-1]["codec"] = media[at + 12 : at + 16].decode("latin-1").strip()
        elif kind == b"stsz":
            each, n = struct.unpack_from(">II", media, at + 4)
            tracks[-1]["sizes"] = np.full(n, each, np.int64) if each else _u4(media, at + 12, n)
        elif kind == b"stz2":
            bits, n = media[at + 7], struct.unpack_from(">I", media, at + 8)[0]
            tracks[-1]["sizes"] = _nibbles(media, at + 12, n) if bits == 4 else _u4(media, at + 12, n, bits // 8)
        elif kind == b"stss":
            tracks[-1]["keys"] = _u4(media, at + 8, struct.unpack_from(">I", media, at + 4)[0])
        elif kind == b"stsc":
            tracks[-1]["runs"] = _u4(media, at + 8, 3 * struct.unpack_from(">I", media, at + 4)[0]).reshape(-1, 3)
        elif kind in (b"stco", b"co64"):
            tracks[-1]["chunks"] = _u4(media, at + 8, struct.unpack_from(">I", media, at + 4)[0], 4 if kind == b"stco" else 8)
    return [_track(x, len(media)) for x in tracks]


def _nibbles(media: bytes, at: int, n: int) -> np.ndarray:
    both = np.frombuffer(media, np.uint8, -(-n // 2), at).astype(np.int64)
    return np.column_stack([both >> 4, both & 15]).ravel()[:n]


def _track(x: dict, end: int) -> Track:
    """A track from its tables; ValueError unless they agree with each other and with the file's length."""
    if missing := {"sizes", "chunks", "runs", "codec", "time"} - set(x):
        raise ValueError(f"a track has no {', '.join(sorted(missing))}")
    sizes, chunks, runs = x["sizes"], x["chunks"], x["runs"]
    if len(runs) and (runs[0, 0] != 1 or (np.diff(np.append(runs[:, 0], len(chunks) + 1)) < 0).any()):
        raise ValueError("the chunks' runs are out of order")
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    which = np.repeat(np.arange(len(chunks)), per)
    if len(which) != len(sizes):
        raise ValueError("the chunks don't hold the samples")
    before = np.cumsum(sizes) - sizes
    firsts = np.cumsum(per) - per
    offsets = chunks[which] + before - before[firsts][which]
    keys = np.arange(1, len(sizes) + 1) if x["keys"] is None else x["keys"]
    if len(sizes) and ((offsets + sizes).max() > end or (len(keys) and not 1 <= keys.min() <= keys.max() <= len(sizes))):
        raise ValueError("samples lie outside the file")
    return Track(x["codec"], *x["time"], sizes, offsets, keys)


def checked(media: bytes) -> tuple[Track | None, str | None]:
    """The first track, or what is wrong with the container."""
    try:
        tracks = probe(media)
    except (ValueError, IndexError, struct.error) as e:
        return None, str(e) or type(e).__name__
    return (tracks[0], None) if tracks else (None, "no track")


def payload(media: bytes, track: Track) -> bytes:
    ends = track.offsets + track.sizes
    new = np.flatnonzero(np.append(True, track.offsets[1:] != ends[:-1]))
    return b"".join(media[a:b] for a, b in zip(track.offsets[new], ends[np.append(new[1:], len(ends)) - 1], strict=True))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes long, media binary of each row's whole text as UTF-8 (null: empty), however long.

    Rows are independent, repeated and null ids too; equal texts give equal media. Other columns are left out.
    """

    def batch(b: pa.RecordBatch) -> dict:
        data = texts(b.column(1))
        return {"doc_id": b.column(0), "n_bytes": pa.array(map(len, data), pa.int64()), "media": pa.array([mux(padded(x)) for x in data], pa.binary())}

    return map_rows(df, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], "doc_id long, n_bytes long, media binary", batch)


def columns(df: DataFrame) -> DataFrame:
    """store()'s rows with codec, timescale, duration, n_samples, key_ranges and the payload read back, and broken.

    A null media gives nulls. So does one that is malformed, whose samples lie outside it or that has no track, and
    broken says why. Of several tracks the first counts. Edit lists and movie fragments are not read. Rows are
    independent; other columns are left out; an empty table stays empty.
    """
    schema = "doc_id long, n_bytes long, media binary, codec string, timescale long, duration long, n_samples long, key_ranges array<struct<start:long,stop:long>>, payload binary, broken string"
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def batch(b: pa.RecordBatch) -> dict:
        media = b.column(2).to_pylist()
        found = [checked(x) if x is not None else (None, None) for x in media]
        tracks = [t for t, _ in found]
        pick = lambda f, kind: pa.array([None if t is None else f(t) for t in tracks], kind)
        return {
            "doc_id": b.column(0),
            "n_bytes": b.column(1),
            "media": b.column(2),
            "codec": pick(lambda t: t.codec, pa.string()),
            "timescale": pick(lambda t: t.timescale, pa.int64()),
            "duration": pick(lambda t: t.duration, pa.int64()),
            "n_samples": pick(lambda t: len(t.sizes), pa.int64()),
            "key_ranges": pick(lambda t: [{"start": a, "stop": z} for a, z in t.key_ranges()], ranges),
            "payload": pa.array([None if t is None else payload(m, t) for m, t in zip(media, tracks, strict=True)], pa.binary()),
            "broken": pa.array([why for _, why in found], pa.string()),
        }

    return map_rows(df, ["doc_id", "n_bytes", "media"], schema, batch)
