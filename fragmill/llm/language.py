"""Operator 7: language by known words first, by ever shorter character n-grams otherwise.

The model holds, for each language, log frequencies of words and of padded character
n-grams of 5 down to 1. A text's score for a language is the sum over its words: a
known word by its frequency, another by the mean frequency of its longest n-grams of
which the model knows any. The probability is the softmax of those sums.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import bounded_sample, map_rows, own_names, resident

#: Runs of letters, and of signs such as fractions and Roman numerals, which letters() tells apart.
WORDLIKE = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: Labelled rows that a model is fitted on at most; a hash of the id chooses them.
MAX_FIT = 4000


def letters(text: str) -> list[str]:
    """The runs of letters in a text."""
    found = WORDLIKE.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [x for run in found for x in (run,) * run.isalpha() or "".join(c if c.isalpha() else " " for c in run).split()]


def has_letter(text: str) -> bool:
    first = WORDLIKE.search(text)
    return first is not None and (first.group().isalpha() or any(map(str.isalpha, text)))


def _grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """langs in order; a row of `table` for each known word and n-gram: its log frequencies by language."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[int, dict[str, np.ndarray]], prior: np.ndarray):
        self.langs, self.prior = langs, prior
        self.words = {w: i for i, w in enumerate(words)}
        self.grams: dict[int, dict[str, int]] = {}
        rows, at = [*words.values()], len(words)
        for n, table in grams.items():
            self.grams[n] = {g: at + i for i, g in enumerate(table)}
            rows += table.values()
            at += len(table)
        self.table = np.array(rows, np.float32).reshape(-1, len(langs))

    def rows(self, word: str) -> list[int]:
        """The rows whose mean is a word's: its own, or those of its longest n-grams that are known; none at all."""
        found = self.words.get(word)
        if found is not None:
            return [found]
        padded = f" {word} "
        for n in range(LONGEST, 0, -1):
            get = self.grams[n].get
            text = padded if n > 1 else word
            hits = [r for i in range(len(text) - n + 1) if (r := get(text[i : i + n])) is not None]
            if hits:
                return hits
        return []


def _logs(counts: dict[str, Counter], langs: list[str], least: int) -> dict[str, np.ndarray]:
    total = Counter()
    for c in counts.values():
        total.update(c)
    known = sorted(g for g, k in total.items() if k >= least)
    size = {x: sum(counts[x].values()) + 0.5 * len(known) for x in langs}
    return {g: np.array([np.log((counts[x][g] + 0.5) / size[x]) for x in langs], np.float32) for g in known}


def train(rows: list[tuple[str, str]]) -> Model | None:
    """rows: (text, language). None without rows that have letters."""
    words: dict[str, Counter] = defaultdict(Counter)
    grams: dict[int, dict[str, Counter]] = {n: defaultdict(Counter) for n in range(1, LONGEST + 1)}
    docs: Counter = Counter()
    for text, lang in rows:
        found = letters(text.lower())
        if found:
            words[lang].update(found)
            docs[lang] += 1
    if not docs:
        return None
    langs = sorted(docs)
    for lang in langs:
        for word, k in words[lang].items():
            for n in grams:
                for g in _grams(word, n):
                    grams[n][lang][g] += k
    prior = np.log(np.array([docs[x] for x in langs]) / sum(docs.values()))
    return Model(langs, _logs(words, langs, 3), {n: _logs(grams[n], langs, 2) for n in grams}, prior)


def fit(df: DataFrame, where: Column | None = None, lang_col: str = "lang", limit: int = MAX_FIT) -> Model | None:
    """From at most `limit` rows of df(doc_id, text, lang) with text and lang that meet `where`."""
    good = F.col("text").isNotNull() & F.col(lang_col).isNotNull()
    rows = bounded_sample(df, good if where is None else good & where, limit, keep=(lang_col,))
    return train([(r["text"], r[lang_col]) for r in rows])


class Scorer:
    """Texts' languages. What words add is kept for up to about `most` words."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self._afresh()

    def _afresh(self) -> None:
        self.row: dict[str, int] = {}
        self.table, self.n = np.zeros((1024, len(self.model.langs)), np.float32), 0

    def _learn(self, words: list[str]) -> None:
        """A word's row is the sum over its runs of letters of the mean of their rows."""
        flat: list[int] = []
        owner, sizes = [], []
        for i, word in enumerate(words):
            for piece in letters(word.lower()):
                rows = self.model.rows(piece)
                if rows:
                    flat += rows
                    owner.append(i)
                    sizes.append(len(rows))
        new = np.zeros((len(words), len(self.model.langs)), np.float32)
        if sizes:
            k = np.array(sizes)
            np.add.at(new, owner, np.add.reduceat(self.model.table[flat], np.cumsum(k) - k, axis=0) / k[:, None])
        while self.n + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.n : self.n + len(words)] = new
        self.row.update(zip(words, range(self.n, self.n + len(words)), strict=True))
        self.n += len(words)

    def score(self, text: str) -> tuple[str, float]:
        return self.scores([text])[0]

    def scores(self, texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for some in range(0, len(texts), 64):
            split = [t.split() for t in texts[some : some + 64]]
            self._learn(list(set().union(*split).difference(self.row)))
            for words in split:
                sums = self.model.prior.copy()
                for at in range(0, len(words), 100_000):
                    sums += self.table[list(map(self.row.__getitem__, words[at : at + 100_000]))].sum(0, dtype=np.float64)
                p = np.exp(sums - sums.max())
                p /= p.sum()
                best = int(p.argmax())
                out.append((self.model.langs[best], float(p[best])))
            if self.n > self.most:
                self._afresh()
        return out


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred string, score double of each row's whole text, and the columns in keep.

    A text that is null, empty or has no letter, and every text under no model: `und`, 0.0. Of languages that
    score alike the first by name counts. Texts of any length are taken whole. Rows are independent, repeated and
    null ids too; an empty table stays empty. Where keep has a column lang_pred or score, the operator's own, which
    are always the second and third, get underscores behind their names.
    """
    held, name = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by the fitted sample
    kinds, known = dict(df.dtypes), model is not None
    lang_pred, score = own_names(("lang_pred", "score"), keep)

    def batch(b: pa.RecordBatch) -> dict:
        scorer = resident(("language", name), lambda: Scorer(held.value)) if known else None
        found = b.column(1).to_pylist()
        fit_for = [i for i, t in enumerate(found) if t and scorer and has_letter(t)]
        got = [("und", 0.0)] * len(found)
        for i, g in zip(fit_for, scorer.scores([found[i] for i in fit_for]) if fit_for else [], strict=True):
            got[i] = g
        out = {"doc_id": b.column(0), lang_pred: pa.array([x for x, _ in got], pa.string()), score: pa.array([s for _, s in got], pa.float64())}
        return out | {k: b.column(2 + i) for i, k in enumerate(keep)}

    schema = ", ".join([f"doc_id long, {lang_pred} string, {score} double", *(f"`{k}` {kinds[k]}" for k in keep)])
    return map_rows(df, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep], schema, batch)
