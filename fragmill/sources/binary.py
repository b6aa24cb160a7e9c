"""Binary outputs, built by tasks as rows of bytes: fixed-width fragments and BAM.

A partition gives one block; the writer that joins blocks streams them to one file in partition order.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.plans.lineage import cut

#: The fragment file's mark, version, and row layout (chrom, start, stop, count, barcode).
AEV1, VERSION, ROW = b"AEV1", 1, struct.Struct("<IIIIQ")
#: BAM's operations and bases by code, and the empty block that ends a file.
CIGAR_OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _blocks(df: DataFrame, one, schema_in: list[str]) -> DataFrame:
    """block, data, n: the bytes of each partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        data, n = [], 0
        for pdf in parts:
            data += [one(*row) for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False)]
            n += len(pdf)
        yield pd.DataFrame({"block": [TaskContext.get().partitionId()], "data": [b"".join(data)], "n": [n]})

    return df.select(*schema_in).mapInPandas(run, "block int, data binary, n long")


def _aev1_row(*values: int) -> bytes:
    return ROW.pack(*values)


def aev1_blocks(frags: DataFrame) -> DataFrame:
    """frags(chrom_id, start, stop, count, barcode_key)."""
    return _blocks(frags, _aev1_row, ["chrom_id", "start", "stop", "count", "barcode_key"])


def write_aev1(frags: DataFrame, chroms: list[str], path: str) -> int:
    """The file and `.chroms.tsv`; blocks come one by one, and the file gets its name when it is whole."""
    part, n = f"{path}.part", 0
    with open(part, "wb") as f:
        f.write(bytes(32))
        for r in aev1_blocks(frags).orderBy("block").toLocalIterator():
            f.write(r["data"])
            n += r["n"]
        f.seek(0)
        f.write(struct.pack("<4sIIIQQ", AEV1, VERSION, ROW.size, len(chroms), n, 0))
    os.replace(part, path)
    with open(f"{path}.chroms.tsv", "w") as f:
        f.writelines(f"{i}\t{c}\n" for i, c in enumerate(chroms))
    return n


def read_aev1(data: bytes) -> list[tuple[int, ...]]:
    mark, version, size, _, n, _ = struct.unpack_from("<4sIIIQQ", data)
    if (mark, version, size) != (AEV1, VERSION, ROW.size) or len(data) != 32 + n * size:
        raise ValueError("not such a file, or a cut one")
    return list(ROW.iter_unpack(data[32:]))


def bgzf(data: bytes) -> bytes:
    """Blocks of at most 65,280 bytes, without the end."""
    out = []
    for at in range(0, len(data), 65280):
        part = data[at : at + 65280]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def _bin(start: int, stop: int) -> int:
    """The smallest bin of the usual six levels that holds a half-open interval."""
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == (stop - 1) >> shift:
            return first + (start >> shift)
    return 0


def bam_record(name: str, flag: int, rid: int, pos: int, mapq: int, cigar: str, mrid: int, mpos: int, tlen: int, seq: str, qual: str | None, nm: int, md: str, bc: str | None, rg: str | None) -> bytes:
    """One alignment; pos and mpos from 0, qualities clamped to 0..93, names cut at 254."""
    ops = [(int(n), CIGAR_OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    span = sum(n for n, o in ops if o in (0, 2, 3, 7, 8)) or 1
    codes = [BASES.find(c) if c in BASES else 15 for c in seq.upper()]
    packed = bytes((a << 4) | b for a, b in zip(codes[::2], [*codes[1::2], *([0] * (len(codes) % 2))], strict=True))
    quals = bytes(min(max(ord(c) - 33, 0), 93) for c in qual) if qual else b"\xff" * len(seq)
    tags = b"NMi" + struct.pack("<i", nm) + b"MDZ" + md.encode() + b"\0"
    for key, value in ((b"CBZ", bc), (b"RGZ", rg)):
        tags += key + value.encode() + b"\0" if value else b""
    qname = name.encode()[:254] + b"\0"
    head = struct.pack("<iiBBHHHiiii", rid, pos, len(qname), mapq, _bin(max(pos, 0), max(pos, 0) + span), len(ops), flag, len(seq), mrid, mpos, tlen)
    body = head + qname + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + quals + tags
    return struct.pack("<i", len(body)) + body


BAM_COLUMNS = ["qname", "flag", "rid", "pos", "mapq", "cigar", "mrid", "mpos", "tlen", "seq", "qual", "nm", "md", "bc", "rg"]


#: Bases of a linear index window (as a shift), and the index file's mark.
WINDOW, BAI = 14, b"BAI\1"


def _bam_blocks(df: DataFrame) -> DataFrame:
    """block, data, n, spots: a partition's records compressed, and where they lie for an index.

    spots are rows of 64-bit numbers: reference, bin (or -1 and the window, of the linear index), begin and end as
    virtual offsets counted from the block's start. A bin's neighbouring records are one row.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        records = [(bam_record(*row), row) for pdf in parts for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False)]
        data = b"".join(r for r, _ in records)
        sizes, body = [], []
        for at in range(0, len(data), 65280):
            body.append(bgzf(data[at : at + 65280]))
            sizes.append(len(body[-1]))
        starts = [0, *itertools.accumulate(sizes)]
        virtual = lambda u: starts[u // 65280] << 16 | u % 65280
        chunks: list[list[int]] = []
        windows: dict[tuple[int, int], int] = {}
        at = 0
        for record, row in records:
            rid, pos = row[2], row[3]
            begin, at = at, at + len(record)
            if rid < 0:
                continue
            stop = pos + (sum(int(n) for n, o in re.findall(r"(\d+)([MDN=X])", row[5])) or 1)
            where = _bin(max(pos, 0), max(stop, 1))
            if chunks and chunks[-1][:2] == [rid, where] and chunks[-1][3] == virtual(begin):
                chunks[-1][3] = virtual(at)
            else:
                chunks.append([rid, where, virtual(begin), virtual(at)])
            for w in range(max(pos, 0) >> WINDOW, (max(stop, 1) - 1 >> WINDOW) + 1):
                windows.setdefault((rid, w), virtual(begin))
        spots = [x for c in chunks for x in c] + [x for (rid, w), v in windows.items() for x in (rid, -1 - w, v, v)]
        yield pd.DataFrame({"block": [TaskContext.get().partitionId()], "data": [b"".join(body)], "n": [len(records)], "spots": [spots]})

    return df.select(*BAM_COLUMNS).mapInPandas(run, "block int, data binary, n long, spots array<long>")


def _write_bai(path: str, n_ref: int, bins: dict, linear: dict) -> None:
    out = [BAI, struct.pack("<i", n_ref)]
    for rid in range(n_ref):
        found = bins.get(rid, {})
        out.append(struct.pack("<i", len(found)))
        for b, chunks in sorted(found.items()):
            out.append(struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
        windows = linear.get(rid, {})
        size, last = max(windows, default=-1) + 1, 0
        out.append(struct.pack("<i", size))
        for w in range(size):
            last = windows.get(w, last)
            out.append(struct.pack("<Q", last))
    with open(path, "wb") as f:
        f.write(b"".join(out))


def write_bam(rows: DataFrame, ref: list[tuple[str, int]], path: str, group: str | None = None, ordered: bool = True, index: bool = False) -> int:
    """A BAM of rows(BAM_COLUMNS, read_id), by coordinates if ordered; tasks compress, the driver only joins blocks.

    index: a .bai file too, which needs the order. The driver holds a row for each bin of each partition.
    """
    if index and not ordered:
        raise ValueError("an index needs rows in order")
    text = f"@HD\tVN:1.6\tSO:{'coordinate' if ordered else 'unknown'}\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in ref) + "@PG\tID:fragmill\tPN:fragmill\n" + (f"@RG\tID:{group}\tSM:{group}\n" if group else "")
    head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(ref))
    for n, size in ref:
        head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    last = lambda c: F.when(F.col(c) == -1, 2147483647).otherwise(F.col(c))
    rows = rows.orderBy(last("rid"), last("pos"), "flag", last("mrid"), last("mpos"), "tlen", "read_id") if ordered else rows
    blocks = cut(_bam_blocks(rows))
    n, part = 0, f"{path}.part"
    bins: dict = defaultdict(lambda: defaultdict(list))
    linear: dict = defaultdict(dict)
    with open(part, "wb") as f:
        f.write(bgzf(head))
        for r in blocks.orderBy("block").toLocalIterator():
            base = f.tell() << 16
            for rid, b, begin, end in itertools.batched(r["spots"] if index else [], 4):
                if b < 0:
                    linear[rid].setdefault(-1 - b, base + begin)
                else:
                    bins[rid][b].append((base + begin, base + end))
            f.write(r["data"])
            n += r["n"]
        f.write(BGZF_END)
    os.replace(part, path)
    if index:
        _write_bai(f"{path}.bai", len(ref), bins, linear)
    return n
