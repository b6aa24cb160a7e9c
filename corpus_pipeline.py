"""Documents to packed sequences: language, frequent lines, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents; n_chars follows the text. A stage that changes texts keeps every row, so
that a document may become empty; only the first and the third let documents go.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.llm import language, lines, neardup, packing, pii
from fragmill.llm.common import documents, fold, shared_folder, staged

#: A document goes if no language reaches this probability, or if it has no letter.
LEAST_LANGUAGE = 0.5
#: Documents that hold a line before it goes.
LINE_DOCS = 10
#: Words of a shingle, and the similarity in percent from which documents are near-duplicates.
SHINGLE, PERCENT = 5, 80


def _again(docs: DataFrame, new: DataFrame) -> DataFrame:
    """new's rows with the columns of docs, in their order and types, and n_chars counted anew."""
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose likeliest language has LEAST_LANGUAGE; learnt as operator 7's query does.

    Null, empty and letterless texts go. Rows are judged one by one, so repeated rows and null ids stay or go alike.
    """
    model = language.fit(docs, fold("doc_id", 4) != 2)
    keep = [c for c in docs.columns if c != "doc_id"]
    found = language.predict(docs, model, keep=tuple(keep))
    lang, score = (F.col(c) for c in found.columns[1:3])
    return found.where((lang != "und") & (score >= LEAST_LANGUAGE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that LINE_DOCS of them hold. Every row stays; a null text becomes an empty one."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    return _again(docs, lines.drop_frequent(docs, LINE_DOCS, keep=keep))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates. Rows without an id, and texts without words, stay;
    repeated rows of an id stay or go together."""
    found = neardup.link(docs, PERCENT, SHINGLE)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the kind of each identifier in its place. Every row stays, null texts as they are."""
    return _again(docs, pii.redact(docs, pii.find(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences. A null or empty text is the end id alone; repeated
    rows are packed each."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), most=250_000))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: SQL can't express MinHash bands, the tokenizer or the packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = shared_folder(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
