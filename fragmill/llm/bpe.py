"""Operator 1: byte-level BPE as a lazily determinised finite-state transducer.

A byte string's BPE tokens are the one chain of vocabulary tokens in which every
neighbouring pair is stable: encoding the pair's bytes gives the pair back. So each
prefix has one last token, and a transducer can read bytes from left to right. A
state is the last emitted token with the ways on from there; a byte leads to a state
in which every token that all still possible continuations share has been emitted.
A continuation can only start where the bytes read so far could begin a longer
token, which bounds the lookahead. States and arrows are made when first met, up to
a number; beyond it states serve once, and after many of those all start afresh.

Decoding concatenates tokens' bytes; a UTF-8 state machine, run token by token,
says where characters are complete, so that text can be handed out as ids arrive.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import map_rows, resident

#: Unicode's White_Space characters.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and decimal rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _State:
    """ways: the last emitted token, where it still matters; then, for each place from which a token may still come,
    in order, the trie's node reached from there and the tokens between the anchor and there. The last place is here."""

    __slots__ = ("ways", "arrows")

    def __init__(self, ways: tuple):
        self.ways, self.arrows = ways, {}


class Transducer:
    """ranks: token bytes to id. most: states kept before the machine starts afresh."""

    def __init__(self, ranks: dict[bytes, int], most: int = 200_000):
        self.ranks, self.most = ranks, most
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.below: dict[int, int] = {}  # node * 256 + byte to node
        self.token, inner = [-1], [True]
        for t, r in ranks.items():
            node = 0
            for byte in t:
                inner[node] = True
                then = self.below.get(node << 8 | byte)
                if then is None:
                    then = self.below[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    inner.append(False)
                node = then
            self.token[node] = r
        self.inner = bytes(inner)
        self.stable: dict[int, bool] = {}
        self._afresh()

    def _afresh(self) -> None:
        self.start = _State((-1, 0, ()))
        self.states = {self.start.ways: self.start}
        self.chains: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.over = 0

    def merged(self, piece: bytes) -> list[int]:
        """Tokens by repeated merging of the lowest ranked pair, the definition itself."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [self.ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while ranks and (least := min(ranks)) < 1 << 60:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(ranks):
                ranks[i] = self.ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [self.ranks[p] for p in parts]

    def _fits(self, before: int, token: int) -> bool:
        key = before << 32 | token
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) > 300_000:
                self.stable.clear()
            known = self.stable[key] = self.merged(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        return known

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        below, token, mine, ways = self.below, self.token, None, state.ways
        anchor, nodes, chains = ways[0], [], []
        for node, chain in zip(ways[1::2], ways[2::2], strict=True):
            node = below.get(node << 8 | byte)
            if node is None:
                continue
            if mine is None and (t := token[node]) >= 0:
                before = chain[-1] if chain else anchor
                if before < 0 or self._fits(before, t):
                    mine = (*chain, t)
            if self.inner[node]:
                nodes.append(node)
                chains.append(chain)
        if mine is None:
            raise ValueError("the vocabulary lacks a byte")
        shared = len(mine)
        for chain in chains:
            if not chain or chain[0] != mine[0]:
                shared = 0
                break
            k, most = 1, min(shared, len(chain))
            while k < most and mine[k] == chain[k]:
                k += 1
            shared = k
        nodes.append(0)
        chains.append(mine)
        out = mine[:shared]
        if shared:
            anchor = mine[shared - 1]
            chains = [chain[shared:] for chain in chains]
        flat = [anchor if () in chains else -2]  # else every way on knows its own last token
        for pair in zip(nodes, chains, strict=True):
            flat += pair
        key = tuple(flat)
        found = self.states.get(key)
        if found is None:
            found = _State(key)
            if len(self.states) >= self.most:  # full: this state serves once
                self.over += 1
                if self.over > 20 * self.most:
                    self._afresh()
                return found, out
            found.ways = tuple(self.chains.setdefault(x, x) if i % 2 == 0 and i else x for i, x in enumerate(key))
            self.states[found.ways] = found
        state.arrows[byte] = (found, self.chains.setdefault(out, out))
        return found, out

    def encode(self, piece: bytes) -> list[int]:
        state, ids = self.start, []
        for byte in piece:
            arrow = state.arrows.get(byte)
            state, out = arrow if arrow is not None else self._step(state, byte)
            if out:
                ids += out
        ids += state.ways[-1]
        return ids


class Utf8Machine:
    """States of UTF-8: 0 between characters, else what must follow; -1 after a bad byte."""

    #: Fixed values: (low, high) of the bytes that a character may start with, and the state after it.
    STARTS = ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7))
    #: State to (low, high, next state).
    FOLLOWS = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}

    @classmethod
    def step(cls, state: int, byte: int) -> int:
        if state < 0:
            return -1
        if state:
            low, high, then = cls.FOLLOWS[state]
            return then if low <= byte <= high else -1
        return next((then for low, high, then in cls.STARTS if low <= byte <= high), -1)


class Decoder:
    """Ids to bytes; whole() says whether ids end between characters without a bad byte."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.moves: dict[tuple[int, int], int] = {}
        self.closed = np.zeros(max(bytes_of) + 1, bool)
        for i in bytes_of:
            self.closed[i] = self.move(0, i) == 0

    def move(self, state: int, token: int) -> int:
        then = self.moves.get((state, token))
        if then is None:
            then = state
            for byte in self.bytes_of[token]:
                then = Utf8Machine.step(then, byte)
            self.moves[state, token] = then
        return then

    def bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def whole(self, ids: np.ndarray) -> bool:
        """Closed tokens leave state 0 as it is; the machine walks the runs from each open one."""
        i, n = 0, len(ids)
        loose = np.flatnonzero(~self.closed[ids])
        while (k := int(np.searchsorted(loose, i))) < len(loose):
            i, state = int(loose[k]), 0
            while i < n:
                state = self.move(state, int(ids[i]))
                i += 1
                if state <= 0:
                    break
            if state:
                return False
        return True

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are complete; bad bytes become U+FFFD."""
        held, state = b"", 0
        for token in ids:
            held += self.bytes_of[token]
            state = self.move(state, token)
            if state == 0:
                yield held.decode()
                held = b""
            elif state < 0:
                yield held.decode(errors="replace")
                held, state = b"", 0
        if held:
            yield held.decode(errors="replace")


class Codec:
    """Text to ids and back. Chunks (a run without white space and a space before it, or white space) are
    encoded once and kept, the last met up to twice `most`; the pattern cannot match across them."""

    def __init__(self, path: str, pattern: str, most: int = 200_000):
        import re

        import regex

        self.machine = Transducer(read_ranks(path))
        self.decoder = Decoder(self.machine.bytes_of)
        self.pattern = regex.compile(pattern.replace("[^\\s", f"[^{SPACES}").replace("\\S", f"[^{SPACES}]").replace("\\s", f"[{SPACES}]"))
        self.chunks = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
        self.most, self.known, self.older = most, {}, {}

    def _keep(self, piece: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(piece) <= 64:
            if len(self.known) >= self.most:
                self.known, self.older = {}, self.known
            self.known[piece] = ids
        return ids

    def _find(self, piece: str) -> tuple[int, ...] | None:
        """From the older half of what is kept, which then counts as new."""
        got = self.older.get(piece)
        return got if got is None else self._keep(piece, got)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        got = self._find(chunk)
        if got is not None:
            return got
        out: list[int] = []
        pieces = [chunk] if chunk.lstrip(" ").isalpha() and chunk[:2] != "  " else self.pattern.findall(chunk)
        for piece in pieces:
            got = self.known.get(piece) or self._find(piece)
            out += got if got is not None else self._keep(piece, tuple(self.machine.encode(piece.encode())))
        return self._keep(chunk, tuple(out)) if len(pieces) > 1 else tuple(out)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for chunk in self.chunks.findall(text):
            got = self.known.get(chunk)
            ids += got if got is not None else self._chunk(chunk)
        return ids

def decoder(path: str) -> Decoder:
    return Decoder({r: t for t, r in read_ranks(path).items()})


def codec(path: str, pattern: str) -> Codec:
    return resident(("bpe", path, pattern), lambda: Codec(path, pattern))


def _decoded(d: Decoder, rows: list[np.ndarray]) -> dict:
    return {"decoded": pa.array([d.bytes(ids.tolist()) for ids in rows], pa.binary()), "whole": [d.whole(ids) for ids in rows]}


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, ids array<int> of each row's whole text; with `decoded`, decode()'s columns of those ids too, from
    the same worker.

    A null or empty text has no ids. Rows are independent: repeated rows and ids give repeated rows,
    an empty table an empty one. Other columns are left out.
    """

    def batch(b: pa.RecordBatch) -> dict:
        c = codec(path, pattern)
        rows = [np.array(c.encode(text or ""), np.int32) for text in b.column(1).to_pylist()]
        ends = np.append(0, np.cumsum([len(x) for x in rows])).astype(np.int32)
        values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        out = {"doc_id": b.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(values))}
        return out | (_decoded(c.decoder, rows) if decoded else {})

    schema = "doc_id long, ids array<int>" + ", decoded binary, whole boolean" * decoded
    return map_rows(df, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], schema, batch)


def decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded binary, whole boolean (the bytes are whole UTF-8 characters) of doc_id, ids.

    Null or no ids decode to no bytes, which are whole.
    """

    def batch(b: pa.RecordBatch) -> dict:
        rows = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in b.column(1)]
        return {"doc_id": b.column(0), "ids": b.column(1)} | _decoded(resident(("decoder", path), lambda: decoder(path)), rows)

    return map_rows(df, ["doc_id", "ids"], "doc_id long, ids array<int>, decoded binary, whole boolean", batch)
