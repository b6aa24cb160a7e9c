"""Operator 10: an interpolated modified Kneser-Ney bigram model, counted in Spark.

Tasks count their bigrams as sorted arrays of word hashes and send them to shards by the
first word; first words that a sample finds very frequent are spread by the second one
too. A shard merges what it gets into a file of sorted bigram hashes and counts. What
each word counts as a token, as a continuation and as a context is merged by word into
files of sorted word hashes. Workers memory-map these files to score texts, so the model
may outgrow memory. The files lie in the shared folder, which must be mounted.
"""

from __future__ import annotations

import os
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import Hashes, bounded_sample, map_rows, mix, resident, shared_folder, texts

#: Bytes of training text for each shard, and tokens that a task counts at a time.
SHARD_BYTES, FLUSH = 32 << 20, 4_000_000
#: Shards that a task writes to at most; beyond it, to groups of shards, which are dealt again. Tasks that deal a group.
FAN_OUT, DEALERS = 256, 64
#: Pairs of files that a worker keeps mapped.
MAPS = 4096
#: Documents that are sampled, only to spread frequent first words.
SAMPLE = 500
#: Words hold no white space, so these hashes are free for the start and the end of a text.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" ", b"\n"))

_U = np.uint64


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the words, A-Z in lower case, and of the end."""
    return np.append(resident("hashes", Hashes).of(text.lower().split()), END)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit, else in 64."""
    return x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64)


def _pack(x: np.ndarray) -> bytes:
    x = _narrow(x)
    return x.dtype.char.encode() + zstandard.compress(x.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), data[:1].decode()).astype(np.int64)


def _summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and each column's sums."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], *(np.add.reduceat(c[order].astype(np.int64), starts) if len(keys) else np.zeros(0, np.int64) for c in columns)


def _pairs(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order of u and v with their sums."""
    order = np.lexsort((v, u))
    u, v, n = u[order], v[order], n[order]
    if not len(u):
        return u, v, n
    starts = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
    return u[starts], v[starts], np.add.reduceat(n, starts)


def _shard(u: np.ndarray, v: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    at = u >> _U(33)
    if len(hot):
        at = at + np.where(np.isin(u, hot), v >> _U(33), _U(0))
    return (at % _U(shards)).astype(np.int64)


def _bigram_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u * _U(0x9E3779B97F4A7C15) + v)


def _save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Each array as a file; whole or not at all, and the same however often it is written."""
    for i, x in enumerate(arrays):
        path = f"{folder}/{name}.{i}.npy"
        part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(part, "wb") as f:
            np.save(f, x)
        os.replace(part, path)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many have counts of 1, 2, 3 and 4; where those are too few, half the count."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


@dataclass(frozen=True)
class Model:
    """Where the files are, and the corpus's figures: shards, tokens, distinct words and bigrams, discounts."""

    folder: str
    shards: int
    hot: tuple[int, ...]
    tokens: int
    words: int
    bigrams: int
    discount: tuple[float, float, float]
    base_discount: tuple[float, float, float]
    base_rest: float


def _local(uri: str) -> str:
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"workers memory-map the model: spark.checkpoint.dir must be a mounted folder, not {uri}")
    return unquote(at.path) if at.scheme else uri


BIGRAMS = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("u", "each", "v", "n"))])
WORDS = pa.schema([("shard", pa.int32()), ("w", pa.binary()), ("counts", pa.list_(pa.binary())), ("figures", pa.list_(pa.int64()))])


def _dealt(u: np.ndarray, v: np.ndarray, n: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """A row for each place in `at` of distinct bigrams in order: its bigrams by first word."""
    order = np.argsort(at, kind="stable")
    places, starts = np.unique(at[order], return_index=True)
    rows = []
    for k, some in zip(places.tolist(), np.split(order, starts[1:]), strict=True):
        firsts = np.flatnonzero(np.append(True, u[some][1:] != u[some][:-1]))
        rows.append({"shard": k, "u": u[some][firsts].tobytes(), "each": _pack(np.diff(np.append(firsts, len(some)))), "v": v[some].tobytes(), "n": _pack(n[some])})
    return pa.RecordBatch.from_pylist(rows, schema=BIGRAMS)


def _bigrams(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams in order with their counts."""
    u = np.concatenate([np.repeat(np.frombuffer(a, _U), _unpack(k)) for a, k in zip(t.column("u").to_pylist(), t.column("each").to_pylist(), strict=True)])
    v = np.concatenate([np.frombuffer(x, _U) for x in t.column("v").to_pylist()])
    return _pairs(u, v, np.concatenate([_unpack(x) for x in t.column("n").to_pylist()]))


def _dealt_words(w: np.ndarray, sums: list[np.ndarray], at: np.ndarray) -> list[dict]:
    order = np.argsort(at, kind="stable")
    places, starts = np.unique(at[order], return_index=True)
    return [{"shard": k, "w": w[some].tobytes(), "counts": [_pack(s[some]) for s in sums], "figures": None} for k, some in zip(places.tolist(), np.split(order, starts[1:]), strict=True)]


def _words(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    counts = t.column("counts").to_pylist()
    return _summed(np.concatenate([np.frombuffer(x, _U) for x in t.column("w").to_pylist()]), *(np.concatenate([_unpack(c[i]) for c in counts]) for i in range(6)))


def _count(batches: Iterator[pa.RecordBatch], shards: int, per: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows shard, u, each (bigrams by u), v, n: arrays of a task's distinct bigrams; per: shards of a group."""
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        v = np.concatenate(held)
        u = np.concatenate([np.append(START, x[:-1]) for x in held])
        u, v, n = _pairs(u, v, np.ones(len(u), np.int64))
        return _dealt(u, v, n, _shard(u, v, hot, shards) // per)

    total = 0
    for b in batches:
        for text in texts(b.column(0)):
            held.append(tokens(text))
            total += len(held[-1])
            if total >= FLUSH:
                yield flush()
                held.clear()
                total = 0
    if held:
        yield flush()


def _deal_again(batches: Iterator[pa.RecordBatch], key: str, split) -> Iterator[pa.RecordBatch]:
    """Rows of groups of shards, sorted by group, as rows of shards: `split` takes up to about FLUSH entries of one group."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            if held and (total >= FLUSH or held[0].column("shard")[0] != row.column("shard")[0]):
                yield split(pa.Table.from_batches(held))
                held, total = [], 0
            held.append(row)
            total += len(row.column(key)[0].as_py()) // 8
    if held:
        yield split(pa.Table.from_batches(held))


def _merge(table: pa.Table, folder: str, shards: int, per: int) -> pa.Table:
    """Writes a shard's bigrams; rows word shard, w, counts (six arrays in a row each) and the shard's figures."""
    shard = table["shard"][0].as_py()
    u, v, n = _bigrams(table)
    key = _bigram_key(u, v)
    order = np.argsort(key)
    _save(folder, f"bigrams-{shard}", key[order], _narrow(n[order]))
    ones = np.ones(len(n), np.int64)
    first = _summed(u, n, n == 1, n == 2, n > 2)
    second = _summed(v, n, ones)
    zero = lambda x, k: [np.zeros(len(x[0]), np.int64)] * k
    columns = [np.concatenate([a, b]) for a, b in zip([second[0], second[1], second[2], *zero(second, 4)], [first[0], *zero(first, 2), *first[1:]], strict=True)]
    w, *sums = _summed(columns[0], *columns[1:])
    of = [int((n == k).sum()) for k in (1, 2, 3, 4)]
    rows = _dealt_words(w, sums, _word_shard(w, shards) // per)
    rows.append({"shard": -1, "w": None, "counts": None, "figures": [int(n.sum()), len(n), *of]})
    return pa.Table.from_pylist(rows, schema=WORDS)


def _word_shard(w: np.ndarray, shards: int) -> np.ndarray:
    return ((w >> _U(33)) % _U(shards)).astype(np.int64)


def _merge_words(table: pa.Table, folder: str) -> pa.Table:
    """Writes a shard's words: as a token, as a continuation, as a context; returns its figures."""
    w, *sums = _words(table)
    _save(folder, f"words-{table['shard'][0].as_py()}", w, _narrow(np.column_stack(sums).ravel()).reshape(-1, 6))
    cont = sums[1]
    return pa.table({"words": [int((sums[0] > 0).sum())], **{f"c{k}": [int((cont == k).sum())] for k in (1, 2, 3, 4)}, "more": [int((cont > 2).sum())]})


def fit(df: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of all rows' whole texts that meet `where` (null texts: empty)."""
    spark = df.sparkSession
    uri = shared_folder(spark, "lm")
    folder = _local(uri)
    os.makedirs(folder, exist_ok=True)
    train = df if where is None else df.where(where)
    size = train.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(4, -(-size // SHARD_BYTES))
    seen = Counter(h for r in bounded_sample(train.where(F.col(id_col).isNotNull()), F.col(text_col).isNotNull(), SAMPLE, id_col, text_col) for h in tokens(r["text"].encode()).tolist())
    least = seen.total() / (2 * shards)
    hot = tuple(h for h, k in seen.items() if k >= least)
    hot_words = np.array(hot, _U)

    groups = shards if shards <= FAN_OUT else int(np.ceil(shards**0.5))
    per = -(-shards // groups)
    kind, schema = "shard int, u binary, each binary, v binary, n binary", "shard int, w binary, counts array<binary>, figures array<long>"

    def fine(df: DataFrame, schema: str, key: str, split) -> DataFrame:
        """Rows by shard of rows by group of shards."""
        if per == 1:
            return df
        dealer = F.pmod(F.xxhash64(key), F.lit(DEALERS))
        return df.repartition("shard", dealer).sortWithinPartitions("shard").mapInArrow(lambda b: _deal_again(b, key, split), schema)

    def split_bigrams(t: pa.Table) -> pa.RecordBatch:
        u, v, n = _bigrams(t)
        return _dealt(u, v, n, _shard(u, v, hot_words, shards))

    def split_words(t: pa.Table) -> pa.RecordBatch:
        w, *sums = _words(t)
        return pa.RecordBatch.from_pylist(_dealt_words(w, sums, _word_shard(w, shards)), schema=WORDS)

    counted = train.select(F.col(text_col).alias("text")).mapInArrow(lambda b: _count(b, shards, per, hot_words), kind)
    merged = fine(counted, kind, "v", split_bigrams).groupBy("shard").applyInArrow(lambda t: _merge(t, folder, shards, per), schema)
    merged.write.parquet(f"{uri}/merged")
    merged = spark.read.schema(schema).parquet(f"{uri}/merged")
    total = merged.where("shard = -1").agg(*(F.sum(F.get("figures", F.lit(i))) for i in range(6))).first()
    n_tokens, n_bigrams, *of = (x or 0 for x in total)
    words = fine(merged.where("shard >= 0"), schema, "w", split_words).select("shard", "w", "counts").groupBy("shard").applyInArrow(lambda t: _merge_words(t, folder), "words long, c1 long, c2 long, c3 long, c4 long, more long")
    n_words, *cont, more = (x or 0 for x in words.agg(*(F.sum(c) for c in ("words", "c1", "c2", "c3", "c4", "more"))).first())
    base = discounts(cont)
    rest = (base[0] * cont[0] + base[1] * cont[1] + base[2] * more) / n_bigrams if n_bigrams else 1.0
    return Model(folder, shards, hot, n_tokens, n_words, n_bigrams, discounts(of), base, rest)


def _discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return n - np.array([0.0, *d])[np.minimum(n, 3)]


class Scorer:
    def __init__(self, model: Model):
        self.m, self.open, self.hot = model, OrderedDict(), np.array(model.hot, _U)

    def _shard(self, kind: str, k: int) -> list[np.ndarray] | None:
        if (kind, k) not in self.open:
            paths = [f"{self.m.folder}/{kind}-{k}.{i}.npy" for i in range(2)]
            self.open[kind, k] = [np.load(p, mmap_mode="r") for p in paths] if os.path.exists(paths[1]) else None
            if len(self.open) > MAPS:
                self.open.popitem(last=False)
        self.open.move_to_end((kind, k))
        return self.open[kind, k]

    def _find(self, kind: str, keys: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """The values of each key, 0 where it is unknown; each shard is read in the order of its keys."""
        out = np.zeros((len(keys), width), np.int64)
        order = np.lexsort((keys, at))
        cuts = np.searchsorted(at[order], np.arange(self.m.shards + 1))
        for k in range(self.m.shards):
            some = order[cuts[k] : cuts[k + 1]]
            shard = self._shard(kind, k) if len(some) else None
            if shard is None or not len(shard[0]):
                continue
            place = np.searchsorted(shard[0], keys[some])
            place[place == len(shard[0])] = 0
            hit = shard[0][place] == keys[some]
            out[some[hit]] = shard[1][place[hit]].reshape(-1, width)
        return out

    def score(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens, known ones, the base score, the model's log10 probability."""
        m, each = self.m, [tokens(t) for t in found]
        sizes = np.array([len(x) for x in each])
        starts = np.cumsum(sizes) - sizes
        v = np.concatenate(each)
        u = np.empty_like(v)
        u[1:] = v[:-1]
        u[starts] = START
        w, at = np.unique(np.append(v, START), return_inverse=True)
        word = self._find("words", w, _word_shard(w, m.shards), 6)
        of_v = at[:-1]
        of_u = np.empty_like(of_v)
        of_u[1:] = of_v[:-1]
        of_u[starts] = at[-1]
        c = word[:, 0]
        base = np.log10((c + 1) / (m.tokens + m.words + 1))[of_v]
        cont = word[:, 1]
        one = (_discounted(cont, m.base_discount) / m.bigrams if m.bigrams else 0.0 * cont) + m.base_rest / (m.words + 1)
        total = word[:, 2]
        gamma = np.where(total > 0, (word[:, 3:6] @ np.array(m.discount)) / np.maximum(total, 1), 1.0)
        n = self._find("bigrams", _bigram_key(u, v), _shard(u, v, self.hot, m.shards), 1)[:, 0]
        p = _discounted(n, m.discount) / np.maximum(total, 1)[of_u] + gamma[of_u] * one[of_v]
        add = lambda x: np.add.reduceat(x, starts)
        return sizes, add((c > 0).astype(np.int64)[of_v]), add(base), add(np.log10(p))


@lru_cache(2)
def _scorer(model: Model) -> Scorer:
    return Scorer(model)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row's whole text.

    Tokens are the words and one end; a null or empty text is the end alone. base_score adds one to counts; score
    is the model's log10 probability. A model of no texts gives every token the probability 1. Rows are
    independent; other columns are left out.
    """

    def batch(b: pa.RecordBatch) -> dict | None:
        if not b.num_rows:
            return None
        n, known, base, got = _scorer(model).score(texts(b.column(1)))
        return {"doc_id": b.column(0), "n_tokens": n.astype(np.int64), "n_known": known, "train_tokens": np.full(len(n), model.tokens, np.int64), "base_score": base, "score": got, "perplexity": 10 ** np.minimum(-got / n, 300)}

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return map_rows(df, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], schema, batch)
