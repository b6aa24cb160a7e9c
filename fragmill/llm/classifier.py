"""Operator 8: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Tokens are runs of letters, of digits or of marks. Features are hashed 1- and 2-grams
of tokens, of their shapes (letter case, digits, marks with their length), and the
2- and 3-grams' patterns of equal tokens. A feature's value is SCALE times its share
of the text's features, so a score is a sparse dot product that length leaves alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import Hashes, bounded_sample, map_rows, mix, resident

TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
BITS, SCALE, EPOCHS = 20, 30.0, 4
#: Labelled rows that a model is fitted on at most.
MAX_FIT = 6000
#: Tokens hashed at a time; a longer text's counts are summed over its parts.
PART = 200_000


def shape(token: str) -> str:
    if token[0].isdigit():
        return "0"
    if token[0].isalpha():
        kind = "A" if token.isupper() else "a" if token.islower() else "Aa" if token[1:].islower() else "aA"
        return kind if len(token) > 1 else kind + "1"
    return token[:1] + ("+" if len(token) > 1 else "")


class _Tokens:
    """Rows of hashes (word, shape) of the tokens met, up to `most`."""

    def __init__(self, most: int = 300_000):
        self.most, self.hashes = most, Hashes(1)
        self._afresh()

    def _afresh(self) -> None:
        self.row: dict[str, int] = {}
        self.table, self.n = np.zeros((1024, 2), np.uint64), 0

    def _add(self, token: str) -> int:
        if self.n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.n] = self.hashes[token.lower().encode()], self.hashes[b"\0" + shape(token).encode()]
        self.row[token] = self.n
        self.n += 1
        return self.n - 1

    def of(self, tokens: list[str]) -> np.ndarray:
        if self.n > self.most:
            self._afresh()
        get, add = self.row.get, self._add
        rows = [i if (i := get(t)) is not None else add(t) for t in tokens]
        return self.table[rows]


def _part(tokens: list[str]) -> np.ndarray:
    both = resident("classifier", _Tokens).of(tokens)
    word, kind = both[:, 0], both[:, 1]
    n, u = len(tokens), np.uint64
    pairs = lambda a, salt: mix(a[:-1] * u(0x9E3779B97F4A7C15) + a[1:] + u(salt))
    same2 = (word[:-1] == word[1:]).astype(u)
    parts = [mix(word), mix(kind + u(1)), pairs(word, 2), pairs(kind, 3), mix(same2 + u(11))]
    if n > 2:
        parts.append(mix((word[:-2] == word[2:]).astype(u) * u(2) + same2[1:] + u(21)))
    return (np.concatenate(parts) >> u(64 - BITS)).astype(np.int64)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a whole text; none without tokens."""
    tokens = TOKENS.findall(text)
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    ids, counts = np.unique(np.concatenate([_part(tokens[i : i + PART]) for i in range(0, len(tokens), PART)]), return_counts=True)
    return ids, counts * (SCALE / counts.sum())


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        ids, values = grams(text)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[ids] @ values, -35, 35))))


def train(rows: list[tuple[str, int]], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01) -> Model | None:
    """rows: (text, 0 or 1), in the order given, EPOCHS times. None without rows."""
    if not rows:
        return None
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    seen = [(np.append(i, size), np.append(v, 1.0), y) for (i, v), y in ((grams(t), y) for t, y in rows)]

    def weights(i: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(EPOCHS):
        for i, v, y in seen:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    w = weights(slice(None))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, limit: int = MAX_FIT) -> Model | None:
    """On at most `limit` documents that meet `where` and whose quality label is 0 or 1; of several labels the greater counts."""
    marks = labels.where("doc_id is not null and quality in (0, 1)")
    marks = {r[0]: r[1] for r in (marks if where is None else marks.where(where)).groupBy("doc_id").agg(F.max("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()}
    if not marks:
        return None
    chosen = docs.sparkSession.createDataFrame([(i,) for i in marks], "doc_id long")
    good = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    rows = bounded_sample(good, F.col("text").isNotNull(), limit)
    rows.sort(key=lambda r: hash((r["id"] * 0x9E3779B97F4A7C15) & 0xFFFFFFFF))
    return train([(r["text"], marks[r["id"]]) for r in rows])


def score(df: DataFrame, model: Model | None, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score double, predicted int (score >= least) of each row's whole text.

    A null text is scored as empty, by the bias alone; without a model every score is 0.5. Rows are
    independent; other columns are left out.
    """
    held = df.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights of 4 bytes

    def batch(b: pa.RecordBatch) -> dict:
        m = held.value
        found = np.array([0.5 if m is None else m.score(t or "") for t in b.column(1).to_pylist()], np.float64)
        return {"doc_id": b.column(0), "score": found, "predicted": (found >= least).astype(np.int32)}

    return map_rows(df, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], "doc_id long, score double, predicted int", batch)
