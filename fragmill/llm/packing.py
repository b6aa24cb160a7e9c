"""Operator 6: token pieces packed into sequences, best fit and then local search.

Documents become tokens on the executors, which keep of each piece only its place,
length and checksum. Pieces are dealt into groups of bounded size. Each group is packed
by best fit, longest first; then exchanges between underfull sequences (a move, one for
one, two for one, one for two) raise the sum of squared fills until sequences empty or
nothing helps. What a group leaves underfull is dealt and packed again with others'.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import map_rows, resident, shared_folder, staged

CAPACITY = 2048
#: Pieces that one task packs at a time.
GROUP = 8192
#: Texts of these characters alone may be cut at spaces and encoded word by word: nothing in them composes.
PLAIN = re.compile("[\t\n\r -~\xa1-\xff]*")
#: Characters of plain texts that are split together.
AT_ONCE = 1 << 22
#: Where a tokenizer cuts by this pattern, after lower-casing, nothing goes across a letter and an ASCII sign but "'" after it.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SIGN, _LETTER, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER[65:91] += 32
#: Not in PLAIN: stands between words that are encoded together.
MARK = "\x01"


def _apart(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """PLAIN texts in lower case, with a space between a letter and a sign behind it: words with and without a comma
    are one to learn. Of letters beyond ASCII, which stay as they are, those of UTF-8's first byte 0xc3 count."""
    if not len(texts):
        return texts
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, np.int64, len(texts) + 1)
    if not ends[-1]:
        return texts
    raw = np.frombuffer(data, np.uint8, ends[-1])
    letter = _LETTER[raw]
    letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    cut = np.append(False, letter[:-1] & _SIGN[raw[1:]])
    cut[ends[:-1][ends[:-1] < len(raw)]] = False
    before = np.cumsum(cut)
    out = np.full(len(raw) + int(before[-1]), 32, np.uint8)
    out[np.arange(len(raw)) + before] = _LOWER[raw]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends + np.append(0, before)[ends]), pa.py_buffer(out))


class WordTokens:
    """A tokenizer that drops white space; the ids of the last words met are kept, up to about twice `most`."""

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = most
        state = lambda x: json.loads(x.__getstate__()) if x else {}
        first = state(self.tokenizer.pre_tokenizer).get("pretokenizers", [{}])[0]
        cut = first.get("behavior") in ("Removed", "Isolated") and first.get("pattern", {}).get("Regex") == CUTS
        self.composes = cut and state(self.tokenizer.normalizer).get("normalizers", [{}])[-1] == {"type": "Lowercase"}
        mark = self._ids(MARK)
        self.mark = mark[0] if len(mark) == 1 else None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids  # places in the text aren't needed

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            ids = np.array(self._ids(f" {MARK} ".join(some)), "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if self.mark is None or len(cuts) != len(some) - 1:
                self.known |= {w: np.array(self._ids(w), "<u4").tobytes() for w in some}
                continue
            data, cuts = ids.tobytes(), (4 * cuts).tolist()
            for w, a, b in zip(some, [0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True):
                self.known[w] = data[a:b]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        new = []
        for w in set(words).difference(self.known):
            if (old := self.older.get(w)) is not None:
                self.known[w] = old
            else:
                new.append(w)
        self._learn(new)
        found = [self.known[w] for w in words]
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        return found

    def _plain(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts of PLAIN characters. Arrow splits the texts and numbers their distinct words, of which each
        is looked up once; numpy strings the words' ids together."""
        array = pa.array(texts, pa.large_string())
        split = pc.ascii_split_whitespace(_apart(array) if self.composes else array)
        words = split.flatten().dictionary_encode()
        ids = self._ids_of(words.dictionary.to_pylist())
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        index = words.indices.to_numpy()
        each = length[index]
        upto = np.append(0, np.cumsum(each))  # ids before each word of the texts
        shift = (np.cumsum(length) - length)[index] - upto[:-1]
        data = np.frombuffer(b"".join(ids), "<u4")[np.repeat(shift, each) + np.arange(upto[-1])].tobytes()
        ends = (4 * upto[split.offsets.to_numpy()]).tolist()
        for start, end in pairwise(ends):
            yield data[start:end]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        some, n = [], 0
        for text in texts:
            plain = PLAIN.fullmatch(text)
            if plain:
                some.append(text)
                n += len(text)
            if not plain or n >= AT_ONCE:
                yield from self._plain(some)
                some, n = [], 0
            if not plain:
                yield np.array(self._ids(text), "<u4").tobytes()
        yield from self._plain(some)


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, id_col: str = "doc_id", text_col: str = "text", most: int = 700_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each row's tokens and the end id, cut at multiples of capacity.

    A null or empty text is the end id alone. Rows are independent: a repeated id gives its pieces again. A worker
    keeps the ids of about twice `most` words.
    """
    close = np.array([end], "<u4").tobytes()

    def batch(b: pa.RecordBatch) -> dict:
        out: tuple[list, ...] = ([], [], [], [], [])
        ids, found = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
        for i, data in zip(ids, resident(("packing", path), lambda: WordTokens(path, most)).encode(found), strict=True):
            data += close
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                for column, value in zip(out, (i, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    column.append(value)
        return {n: pa.array(x, t) for n, x, t in zip(("doc_id", "piece", "start", "length", "ids_crc32"), out, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)}

    return map_rows(df, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], "doc_id long, piece int, start long, length long, ids_crc32 long", batch)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions, longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        by_room[room - n].append(k)
        rooms |= 1 << (room - n)
    return bins


def _sums(b: Counter) -> tuple[list[int], list[int], dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
    """The lengths in a bin, each once, the sums of two, and what makes them up."""
    one = {n: (n,) for n in sorted(b)}
    two = {n + m: (n, m) for x, n in enumerate(one) for m in [*one][x:] if n != m or b[n] > 1}
    return [*one], [*two], one, two


def _exchange(a: Counter, b: Counter, room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The lengths to take from a and from b so that b, the fuller one, gains most within its room."""
    ones, twos, one_a, two_a = _sums(a)
    _, _, one_b, two_b = _sums(b)
    best, found = 0, None
    for from_a, sums, from_b in ((one_a, ones, {0: ()} | two_b | one_b), (two_a, twos, {0: ()} | one_b)):
        have = sorted(from_b)
        for n in sums:
            at = bisect_left(have, n - room)
            if at < len(have) and best < n - have[at]:
                best, found = n - have[at], (from_a[n], from_b[have[at]])
    return found


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search until no two sequences have an exchange left, or no set of sequences can be smaller.

    The emptiest are tried first, more of them when these have none left, at last all. Each exchange raises the sum
    of squared fills, so the search ends. takes[0][n, k] says that bin k gains by a
    piece of n tokens, takes[1][n, k] by two of n together, against nothing or against pieces of its own: a row
    holds the partners for n.
    """
    size = lengths.tolist()
    least = -(-sum(size) // capacity)
    held = [Counter(size[i] for i in b) for b in bins if b]
    fill = np.array([sum(n * c for n, c in b.items()) for b in held], np.int64)
    left = len(held)
    if left <= least:
        return [b for b in bins if b]
    takes = np.zeros((2, capacity + 1, len(held)), bool)
    sums: list[tuple[list[int], list[int]]] = [([], [])] * len(held)

    def note(k: int) -> None:
        ones, twos, _, _ = _sums(held[k])
        sums[k] = ones, twos
        room = capacity - int(fill[k])
        takes[:, :, k] = False
        if room and fill[k]:
            for table, own in ((0, (0, *ones, *twos)), (1, (0, *ones))):
                for n in own:
                    takes[table, n + 1 : n + room + 1, k] = True

    for k in range(len(held)):
        note(k)
    some = 8
    while some and left > least:
        changed = False
        order = [k for k in np.argsort(fill, kind="stable").tolist() if 0 < fill[k] < capacity]
        rank = np.full(len(held), -1)
        rank[order] = range(len(order))
        for k in order[:some]:
            last = len(order)
            while 0 < fill[k] < capacity and left > least:
                hit = (takes[0][sums[k][0]].any(0) | takes[1][sums[k][1]].any(0)) & (fill >= fill[k]) & (rank <= last)
                hit[k] = False
                if not hit.any():
                    break
                other = int(np.where(hit, rank, -1).argmax())
                last = rank[other]
                x, y = _exchange(held[k], held[other], capacity - int(fill[other]))
                held[k] += Counter(y)
                held[k] -= Counter(x)
                held[other] += Counter(x)
                held[other] -= Counter(y)
                gain = sum(x) - sum(y)
                fill[k] -= gain
                fill[other] += gain
                left -= fill[k] == 0
                changed = True
                note(k)
                note(other)
        some = 8 if changed else 4 * some if some < len(order) else 0
    places: dict[int, list[int]] = defaultdict(list)
    for i in range(len(size) - 1, -1, -1):
        places[size[i]].append(i)
    return [[places[n].pop() for n in sorted(b, reverse=True) for _ in range(b[n])] for b in held if b]


def _packed(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    lengths = pdf["length"].to_numpy()
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    number, offset, full = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            number[i], offset[i] = k, at
            at += int(lengths[i])
        full[b] = at
    pdf["sequence_id"] = pdf["bucket"].to_numpy().astype(np.int64) * (1 << 24) + number
    return pdf.assign(offset=offset, fill=full)


def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces() with sequence_id long and offset long; each sequence holds at most capacity tokens, without gaps.

    Equal lengths are taken in the order of id and piece. An empty table stays empty.
    """
    spark = found.sparkSession
    folder = shared_folder(spark, "packing")
    rows = staged(found, f"{folder}/pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket long, sequence_id long, offset long, fill long"

    def deal(df: DataFrame, groups: int, first: int) -> DataFrame:
        """Rows by their place in the written table, so that no id can crowd a group."""
        dealt = df.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)) + first)
        return dealt.groupBy("bucket").applyInPandas(lambda pdf: _packed(pdf, capacity), schema)

    groups = max(1, -(-rows.count() // group))
    once = staged(deal(rows, groups, 0), f"{folder}/once")
    if groups == 1:
        return once.select(*names, "sequence_id", "offset")
    loose = F.col("fill") < capacity
    rest = once.where(loose).select(*names)
    again = deal(rest, max(1, -(-rest.count() // group)), groups)
    return once.where(~loose).unionByName(again).select(*names, "sequence_id", "offset")
