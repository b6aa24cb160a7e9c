"""The queries of the training-text operators: whole tables, digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.llm import bpe, classifier, language, lines, lm, media, neardup, packing, pii, rules
from fragmill.llm.common import documents, fold, labels

BYTE_BPE = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "whole",
    )


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.columns(media.store(documents(spark, sf_dir)))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("codec="), "codec"),
            F.concat(F.lit("timescale="), "timescale"),
            F.concat(F.lit("duration="), "duration"),
            F.concat(F.lit("samples="), "n_samples"),
            F.concat(F.lit("keys="), F.expr("array_join(transform(key_ranges, x -> concat(x.start, '-', x.stop)), ',')")),
        ).alias("feature"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs, fold("doc_id", 4) != 2)
    return language.predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_frequent(documents(spark, sf_dir), min_docs=10, least_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = rules.judge(docs, rules.fit(docs, labels(spark, sf_dir)))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir)).select(
        "doc_id",
        *(f"n_{k}" for k in pii.KINDS),
        F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"),
        pii.listed("spans").alias("spans"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE)))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = classifier.fit(docs, labels(spark, sf_dir), fold("doc_id", 5) != 0)
    return classifier.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(documents(spark, sf_dir), percent=85, width=3)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = lm.fit(docs, F.coalesce(fold("doc_id", 7) != 2, F.lit(True)))
    return lm.score(docs, model).select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def queries() -> dict:
    return {f.__name__: f for f in (op1_byte_bpe, op2_line_dedup, op3_media_columns, op4_quality_rules, op5_pii, op6_best_fit_packing, op7_language_id, op8_quality_classifier, op9_minhash_neardup, op10_lm_scoring)}


ORACLE_OP2 = r"""
with lines as (
  select doc_id, i, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as stripped
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents)),
keyed as (
  select doc_id, i, line, translate(stripped, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
frequent as (select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where f.key is null), '')) as kept_sha256
from keyed left join frequent f using (key) group by doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": ORACLE_OP2}
