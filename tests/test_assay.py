"""Reads of a made genome, mapped back to where they were taken."""

import random

import pytest
from pyspark.sql import functions as F

from fragmill import presets
from fragmill.functions import kernels
from fragmill.plans import assay


@pytest.fixture(scope="module")
def genome(spark):
    r = random.Random(20)
    seqs = ["".join(r.choice("ACGT") for _ in range(3000)) for _ in range(3)]
    return seqs, spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(zip(("chr1", "chr2", "chrY"), seqs, strict=True))], "rid long, name string, seq string")


def make(seqs, n, errors=0, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        rid, start, size = r.randrange(3), r.randrange(100, 2500), r.randrange(120, 300)
        a, b = seqs[rid][start : start + 76], kernels.revcomp(seqs[rid][start + size - 76 : start + size])
        a = list(a)
        for _ in range(errors):
            a[r.randrange(10, 66)] = r.choice("ACGT")
        one, two = ("".join(a), b) if i % 2 else (b, "".join(a))
        out.append((i, one, two, i % 4, ("chr1", "chr2", "chrY")[rid], start, size))
    return out


@pytest.mark.parametrize("errors", [0, 3])
def test_pairs_map_home(spark, genome, errors):
    seqs, ref = genome
    rows = make(seqs, 30, errors)
    reads = spark.createDataFrame([r[:4] for r in rows], "read_id long, seq1 string, seq2 string, bc long")
    got = {r["read_id"]: (r["chrom"], r["start"], r["len"], r["dir"]) for r in assay.map_pairs(reads, ref, presets.preset("atac")).collect()}
    assert got == {r[0]: (r[4], r[5], r[6], r[0] % 2) for r in rows}


def test_preset_chain(spark, genome):
    seqs, ref = genome
    rows = make(seqs, 6)
    rows += [(100 + r[0], *r[1:]) for r in rows]
    reads = spark.createDataFrame([r[:4] for r in rows], "read_id long, seq1 string, seq2 string, bc long")
    got = assay.fragments(reads, ref, presets.preset("atac", least_mapq=0)).collect()
    assert sorted((r["chrom"], r["start"], r["len"], r["num_dups"]) for r in got) == sorted((r[4], r[5] + 4, r[6] - 9, 2) for r in rows[:6])


def test_reads_from_elsewhere_are_left_out(spark, genome):
    r = random.Random(99)
    reads = spark.createDataFrame([(1, "".join(r.choice("ACGT") for _ in range(76)), "".join(r.choice("ACGT") for _ in range(76)), 0), (2, "ACGT", "ACGT", 0)], "read_id long, seq1 string, seq2 string, bc long")
    assert assay.map_pairs(reads, genome[1], presets.preset("atac")).count() == 0


def test_windows_cross_pieces(spark, monkeypatch, genome):
    monkeypatch.setattr(assay, "CHUNK", 256)
    seqs, ref = genome
    c = spark.createDataFrame([(0, s, seqs[0][s : s + 76]) for s in (100, 250, 256, 500, 2900)], "rid long, start long, seq string")
    got = {r["start"]: r["pattern"] for r in assay.windows(c, assay.chunks(ref, 92), 8).collect()}
    assert got == {s: seqs[0][s - 8 : s + 84] for s in (100, 250, 256, 500, 2900)}
    assert assay.chunks(ref, 92).agg(F.max(F.length("piece"))).first()[0] <= 256 + 92


def test_mates_on_two_contigs_are_contacts(spark, genome):
    seqs, ref = genome
    r = random.Random(31)
    rows = []
    for i in range(20):
        (c1, p1), (c2, p2) = sorted(((r.randrange(3), r.randrange(100, 2800)) for _ in range(2)))
        a, b = seqs[c1][p1 : p1 + 70], kernels.revcomp(seqs[c2][p2 : p2 + 70])
        rows.append((i, *((a, b) if i % 2 else (b, a)), i, (c1, p1, 1), (c2, p2 + 69, 0)))
    rows.append((100, *rows[0][1:]))
    reads = spark.createDataFrame([x[:4] for x in rows], "read_id long, seq1 string, seq2 string, bc long")
    p = presets.preset("hic", remove_duplicates=True)
    name = ("chr1", "chr2", "chrY")
    flat = lambda x: (name[x[0]], x[1], x[2])
    want = sorted((i, *flat(min(x, y)), *flat(max(x, y)), 1 + (i == 100)) for i, *_, x, y in rows if i)
    got = assay.contacts(reads, ref, p)
    assert sorted((g["read_id"], g["chrom1"], g["pos1"], g["s1"], g["chrom2"], g["pos2"], g["s2"], g["num_dups"]) for g in got.collect()) == want
    with pytest.raises(ValueError):
        assay.map_pairs(reads, ref, p)


def test_barcodes_are_corrected_before_duplicates_go(spark, genome):
    seqs, ref = genome
    rows = make(seqs, 4)
    bcs = ["AAAACCCC", "AAAACCCC", "AAAACCCC", "GGGGGGGG"]
    reads = [(10 * k + x[0], x[1], x[2], "AATACCCC" if k == 1 and x[0] < 3 else bcs[x[0]], "IIIIIIII") for x in rows for k in range(2)]
    reads = spark.createDataFrame(reads, "read_id long, seq1 string, seq2 string, bc string, bc_qual string")
    whitelist = spark.createDataFrame([("AAAACCCC",)], "bc string")
    names = spark.createDataFrame([("AAAACCCC", "cell"), ("GGGGGGGG", "other")], "from string, to string")
    p = presets.preset("atac", least_mapq=0)
    got = assay.fragments(reads, ref, p, whitelist, names).collect()
    assert sorted((g["chrom"], g["start"], g["bc"], g["num_dups"]) for g in got) == sorted((x[4], x[5] + 4, "cell", 2) for x in rows[:3])
    both = assay.fragments(reads, ref, presets.preset("atac", least_mapq=0, output_off_whitelist=True), whitelist, names).collect()
    assert sorted(g["bc"] for g in both) == ["cell"] * 3 + ["other"]


def test_long_reads_fit_between_pieces(spark, genome, monkeypatch):
    monkeypatch.setattr(assay, "CHUNK", 64)
    seqs, ref = genome
    a, b = seqs[0][500:1400], kernels.revcomp(seqs[0][600:1500])
    reads = spark.createDataFrame([(1, a, b, 0)], "read_id long, seq1 string, seq2 string, bc long")
    got = assay.map_pairs(reads, ref, presets.preset("chip")).collect()
    assert [(g["chrom"], g["start"], g["len"]) for g in got] == [("chr1", 500, 1000)]
