"""Every catalogue query against its DuckDB equivalent on the smallest tables."""

import decimal

import duckdb
import pytest

from fragmill.plans import catalogue
from fragmill.plans.fixtures import table

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (bool, int)):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows(columns, found):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).limit(1).collect() or name == "narrow_peaks"


def test_entry_point_names_match():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sequences_hold_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = table(spark, SF, "sequences").collect()
    letters = lambda t: sum(c.isascii() and c.isalpha() for c in t or "")
    assert sorted((r["doc_id"], len(r["seq"] or "")) for r in got) == sorted((r["doc_id"], letters(r["text"])) for r in docs)


def test_peaks_hold_all_orders(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        orders = spark.read.parquet(f"{sf}/orders.parquet")
        assert table(spark, sf, "peaks").count() == orders.count() > 1000


def test_jaccard_takes_all_fragments(spark):
    covered = {(r["chrom"], x) for r in table(spark, SF, "frag_pe").select("chrom", "start", "len").distinct().collect() for x in range(r["start"], r["start"] + r["len"])}
    assert catalogue.queries()["interval_jaccard"](spark, SF).first()["a_bases"] == len(covered)


def test_rank_takes_all_rows_without_one_window(spark):
    sf = "/root/testdata/sf0.01"
    got = catalogue.queries()["coord_sort_rank"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    last = lambda v: 2147483647 if v == -1 else v
    key = lambda r: (last(r["tid"]), last(r["pos"]), r["flag"], last(r["mtid"]), last(r["mpos"]), r["isize"], r["read_id"])
    rank = {}
    for i, k in enumerate(sorted(map(key, got)), 1):
        rank.setdefault(k, i)
    assert all(r["rank"] == rank[key(r)] for r in got)


def test_gate_takes_the_first_of_all_reads(spark):
    sf = "/root/testdata/sf0.01"
    assert catalogue.queries()["whitelist_gate"](spark, sf).first()["n"] == min(100_000, spark.read.parquet(f"{sf}/events.parquet").count())
