"""Genomic tables made from the driver's tables, as SQL that Spark and DuckDB both read.

Every statement is a plain projection, so a query over a fixture scans only the columns
it needs. read_id orders otherwise equal rows; rows that share it are equal throughout.
"""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAG_PE = """
select l_orderkey * 8 + l_linenumber as read_id, concat('chr', cast(l_suppkey % 5 + 1 as string)) as chrom,
       cast((l_partkey % 500) * 50 as bigint) as start, 50 + (cast(l_quantity as bigint) % 4) * 50 as len,
       cast(l_orderkey % 16 as bigint) as bc, cast(round(l_discount * 100) as bigint) * 6 as mapq,
       cast(l_linenumber % 2 as bigint) as dir, 1 as uniq, 50 as pos_len, 50 as neg_len
from lineitem"""
FRAG_SE = FRAG_PE.replace(", 50 as pos_len, 50 as neg_len", "")
PEAKS = """
select o_orderkey as peak_id, concat('chr', cast(o_custkey % 5 + 1 as string)) as chrom,
       (o_orderkey % 250) * 100 as start, (o_orderkey % 250) * 100 + 60 + (o_custkey % 7) * 20 as stop
from orders"""
_BASE = " || ".join(f"substr('ACGT', cast(1 + ((h >> {s}) & 3) as int), 1)" for s in range(30, -2, -2))
BARCODES = f"""
select event_id, user_id, true_bc,
  case when event_id % 25 = 0 then substr(true_bc, 1, cast(event_id % 16 as int)) || 'N' || substr(true_bc, cast(event_id % 16 as int) + 2)
       when event_id % 10 = 1 then substr(true_bc, 1, cast(event_id % 16 as int)) || translate(substr(true_bc, cast(event_id % 16 as int) + 1, 1), 'ACGT', 'CGTA') || substr(true_bc, cast(event_id % 16 as int) + 2)
       else true_bc end as bc,
  case when event_id % 25 = 0 or event_id % 10 = 1 then repeat('I', cast(event_id % 16 as int)) || '#' || repeat('I', cast(15 - event_id % 16 as int)) else repeat('I', 16) end as qual
from (select event_id, user_id, {_BASE} as true_bc
      from (select event_id, user_id, (user_id * 2654435761) % 4294967296 as h from events))"""
PAIRS = """
select l_orderkey * 8 + l_linenumber as k, cast(l_suppkey % 5 as int) as rid1, (l_partkey % 500) * 50 as pos1, cast(l_linenumber % 2 as int) as s1,
       cast(l_partkey % 5 as int) as rid2, (l_suppkey * 131 % 500) * 50 as pos2, cast(cast(l_quantity as bigint) % 2 as int) as s2
from lineitem"""
SEQUENCES = """
select doc_id, upper(translate(lower(regexp_replace(text, '[^a-zA-Z]', ''{g})),
       'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac')) as seq from documents"""
DRAFTS = """
select l_orderkey - l_orderkey % 4 as read_id, cast(l_linenumber % 2 as int) as mate, cast(l_suppkey % 2 as int) as strand, cast(l_suppkey % 5 as int) as rid,
       (l_partkey % 500) * 50 + l_linenumber as pos, cast(cast(l_quantity as bigint) % 9 as int) as err
from lineitem"""
SAM_LITE = """
select cast(case when l_orderkey % 50 = 0 then -1 else l_suppkey % 5 end as int) as tid, (l_partkey % 500) * 50 as pos, cast((l_linenumber % 2) * 16 as int) as flag,
       cast(l_partkey % 5 as int) as mtid, (l_suppkey * 131 % 500) * 50 as mpos, cast(l_quantity as bigint) - 25 as isize, l_orderkey * 8 + l_linenumber as read_id
from lineitem"""
SLOTS = "select user_id % 16 as bc, (event_id * 7919) % 4000003 as slot from events"
NAMES = "select p_partkey, '@' || replace(p_name, ' ', '_') || case when p_partkey % 3 = 0 then '/1' when p_partkey % 3 = 1 then '/2 extra' else ' comment' end as name from part"
CONTIGS = """
select * from (values (0, 'chr1'), (1, 'chr2'), (2, 'chrY'), (3, 'Y'), (4, 'chr_y'), (5, 'chrY_alt'), (6, 'chrUn_Y'), (7, 'y'), (8, 'chr'), (9, 'CHRY')) as t(rid, name)"""

#: Fixture to the driver tables that its SQL names.
TABLES = {"frag_pe": (FRAG_PE, "lineitem"), "frag_se": (FRAG_SE, "lineitem"), "peaks": (PEAKS, "orders"), "barcodes": (BARCODES, "events"), "pairs": (PAIRS, "lineitem"), "sequences": (SEQUENCES, "documents"), "drafts": (DRAFTS, "lineitem"), "sam_lite": (SAM_LITE, "lineitem"), "slots": (SLOTS, "events"), "names": (NAMES, "part"), "contigs": (CONTIGS, None)}


_LETTERS = string.ascii_letters.encode()
_TO_BASES = bytes.maketrans(_LETTERS, b"ACGTACGTACGTACGTACGTACGTAC" * 2)
_NO_LETTERS = bytes(set(range(256)).difference(_LETTERS))


def bases(text: bytes) -> str:
    """A text of `documents` as its sequence."""
    return text.translate(_TO_BASES, _NO_LETTERS).decode()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (its bytes): what bases() makes of them is `sequences`."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary"))


def _sequences(docs: DataFrame) -> DataFrame:
    """SEQUENCES by a byte table, since Spark's regexp_replace and translate take half a microsecond a character."""

    def run(batches):
        for b in batches:
            seqs = [t if t is None else t.translate(_TO_BASES, _NO_LETTERS) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seqs, pa.binary()).cast(pa.string())], ["doc_id", "seq"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, seq string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, source = TABLES[name]
    sql = sql.replace("{g}", "")
    if source is None:
        return spark.sql(sql)
    if name == "sequences":
        return _sequences(spark.read.parquet(f"{sf_dir}/{source}.parquet"))
    return spark.sql(sql.replace(f"from {source}", "from {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def duck(name: str) -> str:
    """The fixture as a DuckDB subquery."""
    return "(" + TABLES[name][0].replace("{g}", ", 'g'").replace("as string)", "as varchar)") + ")"


def with_all(*names: str) -> str:
    """A DuckDB WITH clause that defines fixtures by name."""
    return "with " + ",\n".join(f"{n} as {duck(n)}" for n in names)
