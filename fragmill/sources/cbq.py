"""Blocked columnar read files (CBQ): a data source whose partitions are the blocks of the files' indexes.

`spark.read.format("cbq").option("first", a).option("count", n).load(paths)` reads a range of records of
each file; only blocks that hold some of it are opened. encode() writes such files, for tests and exports.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fragmill.sources.fastx import expand

SCHEMA = "file string, lane int, read_id long, mate int, name string, seq string, qual string"
#: Marks, version, sizes of headers, and what a file's flags say is there.
FILE, BLOCK, INDEX, VERSION = b"CBQFILE", b"BLK", b"CBQINDEX", 1
PAIRED, QUALITIES, HEADERS, FLAGS = 1, 2, 4, 8
#: The columns in a block's order.
COLUMNS = ("seq_len", "header_len", "npos", "seq", "flags", "headers", "qual")
_BASES = np.frombuffer(b"ACGT", np.uint8)


def file_header(data: bytes) -> int:
    """The presence flags."""
    if data[:7] != FILE or data[7] != VERSION:
        raise ValueError("not a CBQ file of version 1")
    return struct.unpack_from("<Q", data, 8)[0]


def read_index(path: str) -> list[tuple[int, int]]:
    """(offset, records up to its end) of each block."""
    with open(path, "rb") as f:
        file_header(f.read(64))
        end = f.seek(0, 2)
        f.seek(max(64, end - 16))
        foot = f.read(16)
        if foot[8:] != INDEX:
            raise ValueError(f"{path} has no index")
        (size,) = struct.unpack_from("<Q", foot)
        f.seek(end - 16 - size - 24)
        head = f.read(24)
        whole, packed = struct.unpack_from("<QQ", head, 8)
        if head[:8] != INDEX or packed != size or whole % 16:
            raise ValueError(f"{path}'s index is broken")
        table = np.frombuffer(zstandard.decompress(f.read(size), max_output_size=whole), "<u8").reshape(-1, 2)
    if (np.diff(table[:, 1].astype(np.int64)) < 0).any():
        raise ValueError(f"{path}'s index isn't in order")
    return [tuple(map(int, r)) for r in table]


class _Fields:
    """Reads little-endian numbers and counted vectors one after another."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def u64(self) -> int:
        self.at += 8
        return struct.unpack_from("<Q", self.data, self.at - 8)[0]

    def flag(self) -> bool:
        self.at += 1
        return self.data[self.at - 1] != 0

    def vector(self, width: int = 8) -> bytes:
        n = self.u64() * width
        if self.at + n > len(self.data):
            raise ValueError("a vector is cut")
        self.at += n
        return self.data[self.at - n : self.at]

    def bits(self) -> np.ndarray:
        words = self.vector()
        n = self.u64()
        return np.unpackbits(np.frombuffer(words, np.uint8), bitorder="little")[:n]

    def skip_dense(self) -> None:
        for width in (8, 2, 8):
            self.vector(width)
        self.u64()
        self.flag()


def elias_fano(data: bytes) -> np.ndarray:
    """The ascending numbers of an Elias-Fano sequence: high parts in unary, low parts as they are."""
    if not data:
        return np.zeros(0, np.int64)
    f = _Fields(data)
    high = f.bits()
    f.skip_dense()
    if f.flag():
        f.skip_dense()
    if f.flag():
        f.u64()
        f.vector()
        for _ in range(2):
            if f.flag():
                f.vector()
    low, width, universe = f.bits(), f.u64(), f.u64()
    if f.at != len(data) or width > 63:
        raise ValueError("not an Elias-Fano sequence")
    ones = np.flatnonzero(high)
    lows = low[: len(ones) * width].reshape(len(ones), width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)) if width else 0
    out = ((ones - np.arange(len(ones))) << width) | lows
    if (out >= universe).any():
        raise ValueError("a number beyond the sequence's universe")
    return out


def read_block(f, flags: int) -> Iterator[tuple[int, int, str, str, str | None]]:
    """(record in the block, mate, name, bases, qualities) from where the file stands."""
    head = f.read(96)
    if head[:3] != BLOCK or head[3] != VERSION:
        raise ValueError("not a CBQ block of version 1")
    *sizes, bases, n_len, records, sequences = struct.unpack_from("<11Q", head, 8)
    mates = 2 if flags & PAIRED else 1
    if sequences != records * mates:
        raise ValueError(f"{sequences} sequences in {records} records")
    raw = {c: f.read(n) for c, n in zip(COLUMNS, sizes, strict=True)}
    if any(len(raw[c]) != n for c, n in zip(COLUMNS, sizes, strict=True)):
        raise ValueError("a block is cut")
    get = lambda c, most: zstandard.decompress(raw[c], max_output_size=most) if raw[c] else b""
    lengths = np.frombuffer(get("seq_len", 8 * sequences), "<u8").astype(np.int64)
    ends = np.cumsum(lengths)
    if len(lengths) != sequences or (len(ends) and ends[-1] != bases):
        raise ValueError("lengths don't add up")
    packed = np.frombuffer(get("seq", 8 * -(-bases // 32)), np.uint8)
    text = _BASES[(packed[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()[:bases]].copy()
    text[elias_fano(get("npos", n_len))] = ord("N")
    text = text.tobytes().decode()
    quals = get("qual", bases).decode() if flags & QUALITIES else None
    names, name_ends = "", np.zeros(sequences, np.int64)
    if flags & HEADERS:
        name_ends = np.cumsum(np.frombuffer(get("header_len", 8 * sequences), "<u8").astype(np.int64))
        names = get("headers", int(name_ends[-1]) if sequences else 0).decode()
    for i in range(sequences):
        a, b = int(ends[i] - lengths[i]), int(ends[i])
        name = names[int(name_ends[i - 1]) if i else 0 : int(name_ends[i])]
        yield i // mates, i % mates, name, text[a:b], quals[a:b] if quals is not None else None


class _Block(InputPartition):
    def __init__(self, path: str, lane: int, offset: int, before: int, first: int, stop: int):
        self.path, self.lane, self.offset, self.before, self.first, self.stop = path, lane, offset, before, first, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.first, self.count = options["path"], int(options.get("first", 0)), int(options.get("count", -1))

    def partitions(self) -> list[_Block]:
        out = []
        for lane, path in enumerate(expand(self.paths)):
            before = 0
            for offset, upto in read_index(path):
                stop = upto if self.count < 0 else min(upto, self.first + self.count)
                if max(before, self.first) < stop:
                    out.append(_Block(path, lane, offset, before, self.first, stop))
                before = upto
        return out

    def read(self, p: _Block) -> Iterator[tuple]:
        with open(p.path, "rb") as f:
            flags = file_header(f.read(64))
            f.seek(p.offset)
            for i, mate, name, seq, qual in read_block(f, flags):
                if p.first <= p.before + i < p.stop:
                    yield p.path, p.lane, p.before + i, mate, name, seq, qual


class CbqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cbq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, paths: str, first: int = 0, count: int = -1) -> DataFrame:
    spark.dataSource.register(CbqSource)
    return spark.read.format("cbq").option("first", first).option("count", count).load(paths)


def _vector(data: bytes, width: int = 8) -> bytes:
    return struct.pack("<Q", len(data) // width) + data


def _bits(bits: np.ndarray) -> bytes:
    words = np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()
    return _vector(words + bytes(-len(words) % 8)) + struct.pack("<Q", len(bits))


def to_elias_fano(numbers: np.ndarray, universe: int) -> bytes:
    if not len(numbers):
        return b""
    width = max(0, (universe // len(numbers)).bit_length() - 1)
    high = np.zeros(int(numbers[-1] >> width) + len(numbers) + 1, np.uint8)
    high[(numbers >> width) + np.arange(len(numbers))] = 1
    low = ((numbers[:, None] >> np.arange(width)) & 1).ravel()
    dense = _vector(b"") + _vector(b"", 2) + _vector(b"") + struct.pack("<Q?", len(numbers), True)
    return _bits(high) + dense + b"\0\0" + _bits(low) + struct.pack("<QQ", width, universe)


def encode(records: list[list[tuple[str, str, str]]], per_block: int = 1000) -> bytes:
    """A file of records of one or two (name, bases, qualities)."""
    mates = max(map(len, records), default=1)
    out = bytearray(FILE + bytes([VERSION]) + struct.pack("<QQQ", (PAIRED if mates == 2 else 0) | QUALITIES | HEADERS, 3, per_block) + bytes(32))
    index = b""
    for at in range(0, len(records), per_block):
        reads = [r for rec in records[at : at + per_block] for r in rec]
        text = np.frombuffer("".join(s for _, s, _ in reads).encode(), np.uint8)
        codes = np.searchsorted(_BASES, text) % 4
        codes = np.append(codes, np.zeros(-len(codes) % 32, np.int64)).reshape(-1, 4)
        far = to_elias_fano(np.flatnonzero(text == ord("N")), len(text))
        columns = [np.array([len(s) for _, s, _ in reads], "<u8").tobytes(), np.array([len(n) for n, _, _ in reads], "<u8").tobytes(), far, (codes << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8).tobytes(), b"", "".join(n for n, _, _ in reads).encode(), "".join(q for _, _, q in reads).encode()]
        packed = [zstandard.compress(c) if c else b"" for c in columns]
        index += struct.pack("<QQ", len(out), min(at + per_block, len(records)))
        out += BLOCK + bytes([VERSION]) + bytes(4) + struct.pack("<11Q", *map(len, packed), len(text), len(far), len(reads) // mates, len(reads)) + b"".join(packed)
    z = zstandard.compress(index)
    return bytes(out + INDEX + struct.pack("<QQ", len(index), len(z)) + z + struct.pack("<Q", len(z)) + INDEX)
