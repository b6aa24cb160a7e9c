"""Operator 4: gradient-boosted trees over document statistics.

measure() counts statistics of whole texts. train() boosts shallow trees on their
histograms by the logistic loss; a feature may be constrained to only raise or only
lower the score. The trees are flattened into numpy node arrays: scoring walks all
documents down a level of all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import map_rows, texts

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Labelled rows that a model is fitted on at most.
MAX_FIT = 6000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_digits", "n_punctuation", "n_distinct", "n_lines", "longest_word")
#: Feature to the direction that the score may take as it rises: 1, -1, or 0 for either.
FEATURES = {"word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0, "punctuation_share": -1, "distinct_share": 0, "words_per_line": 0, "log_words": 0}

_CLASS = np.zeros(256, np.uint8)  # 0: any other byte that starts a character
_CLASS[list(b" \t\n\x0b\x0c\r")] = 1
_CLASS[0x80:0xC0] = 2  # inside a character
_CLASS[list(range(0x21, 0x30)) + list(range(0x3A, 0x41)) + list(range(0x5B, 0x61)) + list(range(0x7B, 0x7F))] = 3
_CLASS[list(SYMBOLS)] = 4
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 5
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 6
_CLASS[list(b"0123456789")] = 7


def repeated(ids: np.ndarray, distinct: int) -> int:
    """Words in windows of three that occur twice or more; ids are below distinct."""
    n = len(ids)
    if n < 4:
        return 0
    if distinct < 2_000_000:
        windows = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        _, pairs = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)
        windows = pairs * distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(n - 2, bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    hit = np.zeros(n, bool)
    hit[:-2] |= again
    hit[1:-1] |= again
    hit[2:] |= again
    return int(hit.sum())


def count(text: bytes) -> tuple[int, ...]:
    """The values of COUNTS."""
    words = text.split()
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        int(len(text) - kinds[1] - kinds[2]),
        int(kinds[4]),
        len(lines) - len(set(lines)),
        repeated(ids, len(index)),
        int(kinds[5]),
        int(kinds[6]),
        int(kinds[7]),
        int(kinds[3] + kinds[4]),
        len(index),
        len(lines),
        max(map(len, index), default=0),
    )


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of FEATURES from columns of COUNTS."""
    words, chars, letters = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_upper"] + c["n_lower"], 1)
    return np.column_stack(
        [
            c["word_chars"] / words,
            c["n_symbols"] / words,
            c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_repeat_words"] / words,
            c["n_upper"] / letters,
            c["n_digits"] / chars,
            c["n_punctuation"] / words,
            c["n_distinct"] / words,
            c["n_words"] / np.maximum(c["n_lines"], 1),
            np.log1p(c["n_words"]),
        ]
    ).astype(np.float64)


@dataclass
class Trees:
    """Node arrays: a leaf points to itself; a row at or below the threshold goes left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, directions: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Trees | None:
    """Newton boosting. A split on a constrained feature is allowed only if its children's values keep the
    direction, and the middle of the two bounds what stands below either child. None without rows."""
    if not len(y):
        return None
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = [np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])]
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    nodes: list[list] = []
    roots, margin = [], np.full(len(y), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, left_depth: int) -> int:
        at = len(nodes)
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-sum_g / (sum_h + ridge), low, high))
        nodes.append([0, np.inf, at, at, rate * value])
        best = (1e-3, None)
        for j in range(x.shape[1]) if left_depth and len(rows) >= 20 else ():
            if not len(edges[j]):
                continue
            c = codes[j][rows]
            gl = np.cumsum(np.bincount(c, g[rows], len(edges[j]) + 1))[:-1]
            hl = np.cumsum(np.bincount(c, h[rows], len(edges[j]) + 1))[:-1]
            nl = np.cumsum(np.bincount(c, minlength=len(edges[j]) + 1))[:-1]
            gr, hr = sum_g - gl, sum_h - hl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            worth = lambda v, a, b: -(a * v + 0.5 * (b + ridge) * v * v)
            gain = worth(vl, gl, hl) + worth(vr, gr, hr) - worth(value, sum_g, sum_h)
            gain[(nl < 10) | (len(rows) - nl < 10) | (directions[j] * (vr - vl) < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k, vl[k], vr[k]))
        if best[1]:
            j, k, vl, vr = best[1]
            middle = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[directions[j]]
            goes = codes[j][rows] <= k
            a = grow(rows[goes], g, h, *bounds[0], left_depth - 1)
            b = grow(rows[~goes], g, h, *bounds[1], left_depth - 1)
            nodes[at][:4] = [j, float(edges[j][k]), a, b]
        return at

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, depth))
        tree = _flat(nodes, roots[-1:], 0.0, depth)
        margin += tree.margin(x)
    return _flat(nodes, roots, base, depth)


def _flat(nodes: list[list], roots: list[int], base: float, depth: int) -> Trees:
    f, t, a, b, v = zip(*nodes, strict=True)
    return Trees(np.array(f), np.array(t), np.array(a), np.array(b), np.array(v), np.array(roots), base, depth)


def measure(df: DataFrame, model: Trees | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the COUNTS (long) and score double (null without a model) of each row's whole text.

    A null or empty text has counts of 0. Rows are independent; other columns are left out.
    """
    held = df.sparkSession.sparkContext.broadcast(model)  # at most rounds * 2^(depth+1) nodes

    def batch(b: pa.RecordBatch) -> dict:
        rows = [count(t) for t in texts(b.column(1))]
        found = {k: np.array(v, np.int64) for k, v in zip(COUNTS, zip(*rows, strict=True), strict=True)} if rows else {k: np.zeros(0, np.int64) for k in COUNTS}
        score = pa.array(held.value.score(features(found))) if held.value else pa.nulls(len(rows), pa.float64())
        return {"doc_id": b.column(0), **found, "score": score}

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", score double"
    return map_rows(df, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], schema, batch)


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, limit: int = MAX_FIT) -> Trees | None:
    """On at most `limit` documents (by a hash of the id) with a quality label of 0 or 1."""
    marks = {r[0]: r[1] for r in labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()}
    if not marks:
        return None
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(i,) for i in marks], "doc_id long")
    good = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    rows = measure(good if where is None else good.where(where)).orderBy("doc_id").limit(limit).collect()
    if not rows:
        return None
    found = {k: np.array([r[k] for r in rows], np.int64) for k in COUNTS}
    return train(features(found), np.array([marks[r["doc_id"]] for r in rows], np.float64), list(FEATURES.values()))


def judge(df: DataFrame, model: Trees | None, least: float = 0.5) -> DataFrame:
    """measure() with base_failed and kept: not base_failed and, given a model, a score of `least` or more."""
    found = measure(df, model)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce(F.col("score"), F.lit(1.0)) >= least))


