"""Invariants and traps of the operators on small tables."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmill import presets
from fragmill.functions import kernels
from fragmill.operators import barcode, dedup, gather, intervals, mapping, matrix, peaks, qc
from fragmill.plans import catalogue
from fragmill.plans.fixtures import table
from fragmill.sources import formats

SF = "/root/testdata/sf0.001"
FRAG = "read_id long, chrom string, start long, len long, bc long, mapq long, dir long, uniq int, pos_len int, neg_len int"


def frags(spark, n=400, seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([(i, f"chr{r.randint(1, 2)}", 50 * r.randint(0, 8), 50 * r.randint(1, 2), r.randint(0, 3), r.randint(0, 60), r.randint(0, 1), 1, 50, 50) for i in range(n)], FRAG)


def test_duplicates_sum_to_rows_whatever_the_partitions(spark):
    f = frags(spark)
    one, many = (dedup.dedup(f.repartition(n)).orderBy("chrom", "start", "len", "bc").collect() for n in (1, 7))
    assert one == many and sum(r["num_dups"] for r in one) == 400


def test_the_last_row_survives(spark):
    f = spark.createDataFrame([(1, "c", 0, 50, 1, 30, 0, 1, 50, 50), (2, "c", 0, 50, 1, 40, 0, 1, 50, 50), (3, "c", 0, 50, 1, 40, 0, 1, 50, 50)], FRAG)
    assert [(r["read_id"], r["num_dups"]) for r in dedup.dedup(f).collect()] == [(3, 3)]


def test_duplicates_are_capped(spark):
    f = spark.range(300).select(F.col("id").alias("read_id"), F.lit("c").alias("chrom"), F.lit(1).alias("start"), F.lit(2).alias("len"), F.lit(3).alias("bc"), F.lit(9).alias("mapq"))
    assert dedup.dedup(f).first()["num_dups"] == 255


def test_single_ends_split_where_lengths_interleave(spark):
    """Equal start and barcode, but another barcode's length in between: two islands."""
    f = spark.createDataFrame([(1, "c", 0, 50, 1, 9, 1, 1), (2, "c", 0, 60, 2, 9, 1, 1), (3, "c", 0, 70, 1, 9, 1, 1)], "read_id long, chrom string, start long, len long, bc long, mapq long, dir long, uniq int")
    assert dedup.dedup(f, layout="se").count() == 3
    assert dedup.dedup(f.drop("bc"), "bulk", "se").count() == 1


def test_pileup_area_is_the_length(spark, monkeypatch):
    monkeypatch.setattr(intervals, "SCAN_BIN", 100)
    f = frags(spark).withColumn("stop", F.col("start") + F.col("len"))
    steps = intervals.pileup(f)
    area = steps.agg(F.sum((F.col("stop") - F.col("start")) * F.col("depth"))).first()[0]
    assert area == f.agg(F.sum("len")).first()[0]


@pytest.mark.parametrize("bin_size", [7, 100, 1 << 20])
def test_merge_and_overlap_against_brute_force(spark, monkeypatch, bin_size):
    monkeypatch.setattr(intervals, "SCAN_BIN", bin_size)
    r = random.Random(bin_size)
    a = [("c", s, s + r.randint(1, 30)) for s in (r.randint(0, 500) for _ in range(60))]
    b = [("c", s, s + r.randint(1, 30)) for s in (r.randint(0, 500) for _ in range(60))]
    da, db = (spark.createDataFrame(x, "chrom string, start long, stop long") for x in (a, b))
    pairs = sorted((x[1], x[2], y[1], y[2]) for x in a for y in b if x[1] < y[2] and y[1] < x[2])
    got = intervals.overlap_join(da, db, bin_size=16).select("a_start", "a_stop", "b_start", "b_stop").collect()
    assert sorted(map(tuple, got)) == pairs
    want = []
    for _, s, e in sorted(a):
        if want and s <= want[-1][1] + 3:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    assert sorted([x["start"], x["stop"]] for x in intervals.merge(da, gap=3).collect()) == want


def test_no_intervals_give_no_rows(spark):
    none = spark.createDataFrame([], "chrom string, start long, stop long")
    assert intervals.merge(none).count() == intervals.pileup(none).count() == intervals.overlap_join(none, none).count() == 0


def test_lone_neighbour_needs_no_confidence(spark):
    """One neighbour is accepted even without abundance; of two equal ones none is."""
    reads = spark.createDataFrame([(1, "AAAC", "IIII"), (2, "GGTT", "IIII"), (3, "NNAA", "IIII"), (4, "CCCN", "IIII")], "id long, bc string, qual string")
    known = spark.createDataFrame([("AAAA", 0), ("GGTA", 5), ("GGTC", 5), ("CCCG", 2)], "bc string, abundance long")
    got = {r["id"]: (r["corrected"], r["status"]) for r in barcode.correct(reads, known, "id").collect()}
    assert got == {1: ("AAAA", "corrected"), 2: (None, "rejected"), 3: (None, "rejected"), 4: ("CCCG", "corrected")}


def test_two_errors_reach_further(spark):
    reads = spark.createDataFrame([(1, "AACC", "IIII"), (2, "NATC", "IIII")], "id long, bc string, qual string")
    known = spark.createDataFrame([("AAAA", 3), ("GATT", 3)], "bc string, abundance long")
    got = {r["id"]: r["corrected"] for r in barcode.correct(reads, known, "id", errors=2).collect()}
    assert got == {1: "AAAA", 2: "GATT"}


def test_a_missing_translation_raises(spark):
    table = spark.createDataFrame([("AA", "x")], "from string, to string")
    ok = spark.createDataFrame([("AAAA",)], "bc string")
    assert barcode.translate(ok, table, 2).first()["name"] == "x-x"
    with pytest.raises(Exception, match="not in the table"):
        barcode.translate(spark.createDataFrame([("AACC",)], "bc string"), table, 2).collect()


def test_shards_are_checked_and_renumbered(spark):
    f = frags(spark).withColumn("shard", F.col("read_id") % 3).withColumn("local_read_id", F.expr("read_id div 3"))
    gather.validate(gather.manifest(f), 3)
    with pytest.raises(ValueError):
        gather.validate(gather.manifest(f.where("shard <> 1")), 3)
    assert gather.rebase(f).select("read_id").distinct().count() == 400


def test_multi_mappings_get_one_row(spark):
    f = frags(spark).withColumn("read_id", F.when(F.col("mapq") < 4, F.col("read_id") % 10 + 1000).otherwise(F.col("read_id")))
    a = dedup.allocate_multi(f)
    assert a.where("mapq < 4").groupBy("read_id").count().where("count > 1").count() == 0
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, dedup.allocate_multi(f.repartition(5)).select(*a.columns).collect()))


def test_y_and_the_rest_are_all(spark):
    f = frags(spark)
    y, rest = formats.split_y(f, f.where("chrom = 'chr2'"))
    assert y.count() + rest.count() == f.count() and y.intersect(rest).count() == 0


def test_bottom_k_below_k_is_zero(spark):
    slots = spark.createDataFrame([(1, i) for i in range(1, 6)], "bc long, slot long")
    assert [r["estimate"] for r in qc.bottom_k(slots, k=6).collect()] == [0]
    assert [r["estimate"] for r in qc.bottom_k(slots, k=5, span=100).collect()] == [99]


def test_peaks_are_called_where_fragments_pile_up(spark):
    rows = [("chr1", 5000 + i % 50, 5200 + i % 50, 1) for i in range(200)] + [("chr1", 400 * i, 400 * i + 50, 1) for i in range(100)]
    f = spark.createDataFrame(rows, "chrom string, start long, stop long, count long")
    found = peaks.call(f, p=1e-5, genome=100_000, local=10_000).collect()
    assert len(found) == 1 and found[0]["start"] <= 5050 and found[0]["stop"] >= 5200
    with pytest.raises(ValueError):
        peaks.call(f, p=0.1, q=0.1)


# Kernels against slow twins


def slow_distance(pattern, text, e):
    inf = 10**6
    row = {d: 0 for d in range(2 * e + 1)}
    for i, c in enumerate(text):
        new = {}
        for d in range(2 * e + 1):
            best = row[d] + (pattern[i + d] != c)
            best = min(best, row.get(d + 1, inf) + 1, new.get(d - 1, inf) + 1)
            new[d] = best
        row = new
        if row[0] > 3 * e:
            return e + 1
    return min(row.values())


def test_banded_distance_against_table():
    r = random.Random(5)
    for _ in range(300):
        e, n = r.randint(1, 6), r.randint(5, 40)
        p = "".join(r.choice("ACGT") for _ in range(n + 2 * e))
        t = list(p[e : e + n])
        for _ in range(r.randint(0, 5)):
            t[r.randrange(n)] = r.choice("ACGT")
        assert kernels.banded_distance(p, "".join(t), e)[0] == slow_distance(p, "".join(t), e)


def test_alignment_explains_its_edits():
    r = random.Random(6)
    for _ in range(60):
        ref = "".join(r.choice("ACGT") for _ in range(60))
        read = ref[10:30] + r.choice(["", "A"]) + ref[31:50]
        _, at, cigar = kernels.align(ref, read)
        assert sum(n for n, op in cigar if op != "D") == len(read)
        nm, _ = kernels.nm_md(cigar, ref[at:], read)
        assert nm <= 2


def slow_clusters(hits, n, errors, least):
    """By counting anew at each hit what has been gathered so far."""
    from collections import Counter

    out, held = [], []
    best = lambda: max(Counter(held).items(), key=lambda x: (x[1], -x[0]))
    for p in [*hits, None]:
        if held and (p is None or p - held[-1] > errors or (len(held) >= n and p - best()[0] > errors)):
            out += [best()] * (len(held) >= least)
            held = []
        held.append(p)
    return out


def test_clusters_against_counting():
    r = random.Random(11)
    for _ in range(2000):
        hits = sorted(r.randint(0, 40) for _ in range(r.randint(0, 14)))
        n, errors, least = r.randint(1, 8), r.randint(1, 8), r.randint(1, 4)
        assert kernels.cluster_hits(np.array(hits, np.int64), n, errors, least) == slow_clusters(hits, n, errors, least)


def slow_minimizers(s, k, w):
    kept = []
    for i in range(len(s) - k + 1):
        word = s[i : i + k]
        if set(word) - set("ACGT"):
            kept.append((None, i + k - 1, 0))
        elif word != kernels.revcomp(word):
            code = lambda x: np.array([int("".join(str("ACGT".index(c)) for c in x), 4)], np.uint64)
            f, v = (int(kernels.hash64(code(x), 2 * k)[0]) for x in (word, kernels.revcomp(word)))
            kept.append((int(kernels.hash64(np.array([min(f, v)], np.uint64), 2 * k)[0]), i + k - 1, int(f >= v)))
    out = set()
    for i in range(len(kept) - w + 1):
        part = kept[i : i + w]
        if all(x[0] is not None for x in part):
            out |= {x for x in part if x[0] == min(y[0] for y in part)}
    tail = [x for x in kept[-w:] if x[0] is not None]
    if tail:
        out.add(max((x for x in tail if x[0] == min(y[0] for y in tail)), key=lambda x: x[1]))
    return sorted(out, key=lambda x: x[1])


@pytest.mark.parametrize("piece", [1, 3, 20, 1 << 20])
def test_minimizers_against_definition(monkeypatch, piece):
    monkeypatch.setattr(kernels, "PIECE", piece)
    r = random.Random(12)
    for _ in range(60):
        s = "".join(r.choice("ACGTACGTACGTN" if r.random() < 0.3 else "ACGT") for _ in range(r.randint(0, 60)))
        k, w = r.choice([(4, 3), (5, 4), (3, 2)])
        assert kernels.minimizers(s, k, w) == slow_minimizers(s, k, w)


def test_overlaps_against_all_shifts():
    r = random.Random(13)
    for _ in range(500):
        core = "".join(r.choice("ACGT") for _ in range(r.randint(10, 60)))
        a = core + "".join(r.choice("ACGT") for _ in range(r.randint(0, 12)))
        b = kernels.revcomp(core) + "".join(r.choice("ACGT") for _ in range(r.randint(0, 12)))
        a = list(a)
        for _ in range(r.randint(0, 2)):
            a[r.randrange(len(a))] = r.choice("ACGT")
        a = "".join(a)
        short, back = (a, kernels.revcomp(b)) if len(a) <= len(b) else (b, kernels.revcomp(a))
        fits = []
        for shift in range(len(back) - 29):
            wrong = [i for i, (x, y) in enumerate(zip(back[shift:], short, strict=False)) if x != y]
            if len(wrong) <= 1 and len(short) >= 15 and (not wrong or wrong[0] >= 15 or len(short) >= 30):
                fits.append((bool(wrong) and wrong[0] < 15, shift))
        want = (len(a), len(b))
        if fits:
            n = len(back) - min(fits)[1]
            want = (min(n, len(short)), n) if len(a) <= len(b) else (n, min(n, len(short)))
        assert kernels.overlap_trim(a, b) == want


def test_distances_of_a_batch_equal_single_ones():
    r = random.Random(14)
    texts = ["".join(r.choice("ACGTN") for _ in range(r.choice([20, 31]))) for _ in range(40)]
    patterns = ["".join(r.choice("ACGT") for _ in range(4)) + t.replace("N", "A") + "ACGTACGTA" for t in texts]
    edits, ends = kernels.banded_distances(patterns, texts, 4)
    assert list(zip(edits.tolist(), ends.tolist(), strict=True)) == [kernels.banded_distance(p, t, 4) for p, t in zip(patterns, texts, strict=True)]


def test_alignment_scores_are_the_best():
    r = random.Random(15)
    for _ in range(60):
        p, t = ("".join(r.choice("ACG") for _ in range(r.randint(1, n))) for n in (14, 9))
        best = {}

        def score(i, j, state, p=p, t=t, best=best):
            """All of t[i:] against some of p[j:]."""
            if i == len(t):
                return 0
            if (i, j, state) not in best:
                gap = lambda s: -1 if state == s else -7
                ways = [gap("I") + score(i + 1, j, "I")]
                if j < len(p):
                    ways += [(1 if p[j] == t[i] else -4) + score(i + 1, j + 1, "M"), gap("D") + score(i, j + 1, "D")]
                best[i, j, state] = max(ways)
            return best[i, j, state]

        got, at, cigar = kernels.align(p, t)
        assert got == max(score(0, j, "M") for j in range(len(p) + 1))
        nm, md = kernels.nm_md(cigar, p[at:], t)
        assert nm == sum(c.isalpha() for c in md) + sum(n for n, op in cigar if op == "I")


def test_candidates_merge_from_the_left(spark):
    r = random.Random(16)
    rows = [[(i, 1, 0, at, c) for i in range(12) for at, c in {r.randint(0, 60): r.randint(1, 9) for _ in range(r.randint(0, 6))}.items()] for _ in range(2)]
    a, b = (spark.createDataFrame(x, "id long, same int, rid long, at long, count int") for x in rows)
    want = []
    for i in range(12):
        best = {}
        for _, _, _, at, c in (x for part in rows for x in part if x[0] == i):
            best[at] = max(best.get(at, 0), c)
        last = None
        for at in sorted(best):
            if last is None or at > last + 8:
                want.append((i, 1, 0, at, best[at]))
                last = at
    assert sorted(map(tuple, mapping.merge_candidates(a, b).collect())) == want


def test_reads_that_did_not_map_are_counted(spark):
    found = spark.createDataFrame([("A", 60, 3, 1), ("B", 5, 2, 0), ("X", 60, 1, 0)], "bc string, mapq int, num_dups int, cachehit int")
    reads = spark.createDataFrame([(b,) for b in "AAAAABBCXY"], "bc string")
    got = {r["bc"]: tuple(r)[1:] for r in qc.summary(found, spark.createDataFrame([("A",), ("B",), ("C",)], "bc string"), reads).collect()}
    assert got == {"A": (5, 2, 3, 0, 1), "B": (2, 0, 2, 2, 0), "C": (1, 0, 0, 0, 0), "non-whitelist": (2, 0, 1, 0, 0)}


def test_formats_of_alignments_are_not_shifted(spark):
    from fragmill.functions import shift

    f = frags(spark, 5)
    assert shift.for_output(f, "pairs").collect() == f.collect() != shift.for_output(f, "bed").collect()


def test_bed_profile_takes_chosen_cells(spark):
    rows = [("chr1", 5000 + i % 50, 5200 + i % 50, 1, "a") for i in range(200)] + [("chr1", 9000 + i % 50, 9200, 1, "b") for i in range(200)]
    f = spark.createDataFrame(rows, "chrom string, start long, stop long, count long, bc string")
    found = peaks.bed_profile(f, spark.createDataFrame([("a",)], "bc string"), genome=100_000).collect()
    assert found and all(r["stop"] < 6000 for r in found)
    assert dict(map(tuple, peaks.parameters(spark, q_value=0.05).collect()))["q_value"] == "0.05"


def test_minimizers_are_strand_free_and_cover_windows():
    r = random.Random(7)
    s = "".join(r.choice("ACGT") for _ in range(400))
    fwd, rev = ({m[0] for m in kernels.minimizers(x, 17, 7)} for x in (s, kernels.revcomp(s)))
    assert len(fwd & rev) >= len(fwd) - 2
    places = sorted(m[1] for m in kernels.minimizers(s, 17, 7))
    assert max(b - a for a, b in zip(places, places[1:], strict=False)) <= 7
    assert kernels.minimizers("ACGT", 17, 7) == [] and kernels.minimizers("N" * 50, 17, 7) == []


def test_reads_map_where_they_come_from(spark):
    r = random.Random(8)
    ref = ["".join(r.choice("ACGT") for _ in range(3000)) for _ in range(3)]
    reads = [(i, rid, at, kernels.revcomp(ref[rid][at : at + 76]) if i % 2 else ref[rid][at : at + 76]) for i, (rid, at) in enumerate((r.randrange(3), r.randrange(2900)) for _ in range(24))]
    index = mapping.build_index(spark.createDataFrame(list(enumerate(ref)), "rid long, seq string"))
    m = mapping.minimizers(spark.createDataFrame([(i, s) for i, _, _, s in reads], "read_id long, seq string"))
    c = mapping.candidates(mapping.two_rounds(m, index), m.groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    found = {(x["id"], x["rid"], x["at"], x["same"]) for x in c.collect()}
    assert all((i, rid, at + 75 * (i % 2), 1 - i % 2) in found for i, rid, at, _ in reads)  # minus reads by their end


def test_errors_are_bounded(spark):
    with pytest.raises(ValueError):
        mapping.verify(spark.createDataFrame([("A", "A")], "pattern string, seq string"), 16)


def test_adapters_are_cut_where_mates_overlap():
    r = random.Random(9)
    core = "".join(r.choice("ACGT") for _ in range(40))
    assert kernels.overlap_trim(core + "T" * 8, kernels.revcomp(core) + "G" * 7) == (40, 40)
    assert kernels.overlap_trim("A" * 50, "C" * 50) == (50, 50)


def test_presets_and_rules():
    assert presets.preset("atac").tn5_shift and presets.preset("hic").errors == 4
    for bad in ({"errors": 16}, {"p_value": 0.1, "q_value": 0.1}, {"split_alignment": True}, {"barcode_errors": 3}):
        with pytest.raises(ValueError):
            presets.preset("atac", **bad)
    assert presets.size("8G") == 8 << 30 and presets.size("512M") == 512 << 20
    assert presets.y_paths("d/x_R1.fastq.gz") == ("d/y_separated/x_Y_R1.fastq.gz", "d/y_separated/x_noY_R1.fastq.gz")


def test_kmers_are_counted_without_a_row_for_each_window(spark):
    from fragmill.plans import catalogue

    r = random.Random(5)
    texts = [None, "", "ACG", "acgtacgtacgt", "ACGTNACGTACGTé", *("".join(r.choices("ACGT", k=n)) for n in (11, 12, 3000))]
    before, kernels.PIECE = kernels.PIECE, 100
    try:
        for k in (3, 11, 13, 31):
            want = Counter(s[i : i + k] for s in texts if s for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT"))
            got = Counter()
            for keys, n in kernels.kmer_counts(texts, k):
                for key, m in zip(keys.tolist(), n.tolist(), strict=True):
                    got["".join("ACGT"[key >> 2 * i & 3] for i in range(k - 1, -1, -1))] += m
            assert got == want
    finally:
        kernels.PIECE = before
    for name in ("kmer_spectrum", "kmer_hash"):
        assert "Generate" not in catalogue.queries()[name](spark, SF)._jdf.queryExecution().toString()


def test_sequences_are_what_their_sql_says(spark):
    from fragmill.plans import fixtures

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Aé-b\n Zz\u212a\u0130 xyz"), (4, "".join(map(chr, range(1, 600))))], "doc_id long, text string")
    want = spark.sql(fixtures.SEQUENCES.replace("{g}", "").replace("from documents", "from {docs}"), docs=docs)
    got = fixtures._sequences(docs)
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())


def _deep(spark, n=300, seed=3):
    """Fragments and peaks, most of them in the same places, some empty, one id twice."""
    r = random.Random(seed)
    f = [(i, r.choice(["c1", "c2", None]), r.randint(0, 30) * 50, r.choice([50, 100, 0]), r.randint(0, 3)) for i in range(n)]
    p = [(i, r.choice(["c1", "c2", "c3"]), s := r.randint(0, 30) * 50, s + r.choice([60, 80, 300, 0])) for i in range(n // 4)]
    p.append((0, "c1", 100, 700))
    return f, p, spark.createDataFrame(f, "read_id long, chrom string, start long, len long, bc long"), spark.createDataFrame(p, "peak_id long, chrom string, start long, stop long")


def _meet(f, p, distance=0):
    return f[1] == p[1] and f[3] > 0 and p[3] > p[2] and f[2] < p[3] + distance and p[2] - distance < f[2] + f[3]


def test_overlaps_are_counted_without_pairs(spark):
    f, p, df, dp = _deep(spark)
    b = df.withColumn("stop", F.col("start") + F.col("len")).select("chrom", "start", "stop")
    for distance in (0, 100):
        got = intervals.overlap_count(dp, b, ["peak_id"], distance)
        want = {i: sum(_meet(x, y, distance) for x in f for y in p if y[0] == i) for i, *_ in p}
        assert {r["peak_id"]: r["n"] for r in got.collect()} == want and got.count() == len(want)
    # 2,000 fragments and 2,000 peaks in one place have four million pairs, of which no row is made
    many = spark.range(2000).select(F.lit("c").alias("chrom"), F.lit(0).alias("start"), F.lit(50).alias("stop"), F.col("id").alias("peak_id"))
    got = intervals.overlap_count(many, many, ["peak_id"])
    assert got.agg(F.min("n"), F.max("n"), F.count("n")).first() == (2000, 2000, 2000)
    assert "b_bin" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_pairs_of_deep_stacks_come_from_many_tasks(spark, monkeypatch, block):
    f, p, df, dp = _deep(spark)
    a = df.withColumn("stop", F.col("start") + F.col("len")).select("read_id", "chrom", "start", "stop", "bc")
    twice = a.unionByName(a.where("read_id % 5 = 0"))  # equal rows stay as many as they are
    monkeypatch.setattr(intervals, "BLOCK", block)
    for distance in (0, 100):
        got, want = intervals.overlap_pairs(twice, dp, distance), intervals.overlap_join(twice, dp, distance)
        assert got.columns == want.columns and Counter(got.collect()) == Counter(want.collect())
    assert intervals.overlap_pairs(a.where("false"), dp).count() == 0
    # 600 reads and 600 peaks in each of 20 places of a bin: the overlap join leaves all pairs to one task
    monkeypatch.setattr(intervals, "BLOCK", 100)
    deep = spark.range(12_000).select(F.lit("c").alias("chrom"), (F.col("id") % 20 * 10).alias("start"), (F.col("id") % 20 * 10 + 10).alias("stop"), F.col("id").alias("peak_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        by_task = [r["count"] for r in intervals.overlap_pairs(deep, deep).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(by_task) == 20 * 600 * 600 and max(by_task) < sum(by_task) / 2


def test_query_of_overlaps_stacks_equal_intervals(spark):
    plan = catalogue.queries()["overlap_join"](spark, SF)._jdf.queryExecution().toString()
    assert "collect_list" in plan


def test_cells_over_peaks_make_no_pair_for_each_row(spark):
    f, p, df, dp = _deep(spark)
    want = Counter((x[4], y[0]) for x in f for y in p if _meet(x, y))
    got = matrix.cell_by_peak(df, dp)
    assert {(r["bc"], r["peak_id"]): r["n"] for r in got.collect()} == want and got.count() == len(want)
    # a barcode's 3,000 fragments over 3,000 peaks in one place: the overlap join makes one row of nine million
    deep = spark.range(3000).select(F.lit(1).alias("bc"), F.lit("c").alias("chrom"), F.lit(0).alias("start"), F.lit(50).alias("len"))
    peaks_ = spark.range(3000).select(F.col("id").alias("peak_id"), F.lit("c").alias("chrom"), F.lit(10).alias("start"), F.lit(60).alias("stop"))
    assert matrix._by_place(deep, peaks_, 200).collect() == [(1, "c", 10, 60, 3000)]
    assert matrix.cell_by_peak(deep, peaks_).agg(F.min("n"), F.max("n"), F.count("n")).first() == (3000, 3000, 3000)


def test_peaks_are_numbered_before_counts_are_spread(spark):
    f, p, df, dp = _deep(spark)
    got = matrix.numbered_peaks(df, dp)
    assert sorted(got.collect()) == sorted(matrix.numbered(matrix.cell_by_peak(df, dp), df).collect())
    met = Counter((x[4], y[0]) for x in f for y in p if _meet(x, y))
    ids = {i: k for k, i in enumerate(sorted({i for _, i in met}))}
    assert Counter({(r["feat_idx"], r["n"]): 1 for r in got.collect()}) == Counter({(ids[i], n): 1 for (_, i), n in met.items()})


def test_multi_mapping_weights_make_no_pairs(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i % 40, r.choice(["c1", "c2"]), r.randint(0, 20) * 50, r.choice([50, 100]), r.randint(0, 2), r.choice([0, 30])) for i in range(600)]
    f = spark.createDataFrame(rows, "read_id long, chrom string, start long, len long, bc long, mapq long")
    unique, multi = [x for x in rows if x[5] >= 4], [x for x in rows if x[5] < 4]
    weight = Counter()
    for x in multi:
        weight[x[:5]] += sum(y[1] == x[1] and x[2] - 60 < y[2] + y[3] and y[2] < x[2] + x[3] + 60 for y in unique)
    want = []
    for i in {x[0] for x in multi}:
        mine = sorted(k for k in weight if k[0] == i and weight[k])
        if total := sum(weight[k] for k in mine):
            draw = spark.range(1).select(F.pmod(F.xxhash64(F.lit(11), F.lit(i).cast("long")), F.lit(total))).first()[0]
            want.append(next(k for n, k in enumerate(mine) if draw < sum(weight[x] for x in mine[: n + 1])))
    monkeypatch.setattr(intervals, "overlap_join", None)  # makes a row for each pair
    got = [tuple(x) for x in dedup.allocate_multi(f, distance=60).collect()]
    assert sorted(x[:5] for x in got if x[5] < 4) == sorted(want)
    assert sorted(x for x in got if x[5] >= 4) == sorted(unique)


@pytest.mark.parametrize("seed", range(4))
def test_clusters_of_many_groups_are_those_of_each(seed, monkeypatch):
    r = np.random.default_rng(seed)
    group = np.sort(r.integers(0, 300, 2000))
    at = r.integers(0, (12, 60, 400, 5000)[seed], 2000)
    order = np.lexsort((at, group))
    group, at = group[order], at[order]
    for n in (1, 3, 9, 50):
        want = sorted((g, *c) for g in set(group.tolist()) for c in kernels.cluster_hits(at[group == g], n, 8, 2))
        assert sorted(zip(*(x.tolist() for x in kernels.cluster_groups(group, at, n, 8, 2)), strict=True)) == want
    assert all(len(x) == 0 for x in kernels.cluster_groups(group[:0], at[:0], 3, 8, 2))
    # groups within the read's minimizers are never taken one by one
    monkeypatch.setattr(kernels, "cluster_hits", None)
    kernels.cluster_groups(group, at, 2000, 8, 2)


def _hits(df):
    return sorted(map(tuple, df.select("id", "same", "rid", "at").collect()))


def test_sequences_against_themselves_hit_as_by_joins(spark):
    r = random.Random(5)
    common = ["".join(r.choice("ACGT") for _ in range(60)) for _ in range(4)]
    long = "".join(r.choice("ACGT") for _ in range(3 * kernels.BATCH // 2))
    seqs = ["".join(r.choice([*common, "N", "ACGTACGTT", "".join(r.choice("ACGTn") for _ in range(30))]) for _ in range(r.randint(0, 6))) for _ in range(60)]
    rows = [(i * 10**13 - 3 * 10**14, s) for i, s in enumerate([*seqs, None, "", "ACG", *common, *common[:2] * 4, kernels.revcomp(common[3]), long, long[50:90]])] + [(7, common[0]), (7, seqs[0])]
    df = spark.createDataFrame(rows, "doc_id long, seq string").repartition(3)
    m, index = mapping.minimizers(df, id_col="doc_id"), mapping.build_index(df.withColumnRenamed("doc_id", "rid"))
    second_rounds = 0
    for first, second in ((500, 1000), (40, 60), (10, 45), (2, 30), (2, 3), (1, 1000)):
        want = _hits(mapping.two_rounds(m, index, 17, first, second))
        second_rounds += len(want) > mapping.seed_hits(m, index, 17, first).count()
        assert _hits(mapping.self_hits(df, id_col="doc_id", first=first, second=second)) == want
    assert second_rounds >= 2
    assert mapping.self_hits(df.where("false"), id_col="doc_id").count() == 0
    s = table(spark, SF, "sequences")
    want = mapping.two_rounds(mapping.minimizers(s, id_col="doc_id"), mapping.build_index(s.withColumnRenamed("doc_id", "rid")))
    assert _hits(catalogue.queries()["seed_join_hits"](spark, SF)) == _hits(want)


def test_seeds_of_sequences_are_dealt_out_once(spark):
    """What is shuffled stays below four times the compressed texts; joins of rows took seven times."""
    sf = "/root/testdata/sf0.01"
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    catalogue.queries()["seed_join_hits"](spark, sf).write.format("noop").mode("overwrite").save()
    assert 0 < written() - before < 4 * os.path.getsize(f"{sf}/documents.parquet")


@pytest.mark.parametrize(("k", "w"), [(17, 7), (4, 3), (2, 7), (5, 1), (31, 10)])
def test_minimizers_of_many_sequences_are_those_of_each(k, w):
    r = random.Random(k)
    pick = [lambda n: ("ACGT" * n)[:n], lambda n: "A" * n, lambda n: "".join(r.choice("ACGTacgt") for _ in range(n)), lambda n: "".join(r.choice("ACGTNé€") for _ in range(n))]
    for _ in range(60):
        seqs = [r.choice(pick)(r.choice([0, 1, k - 1, k, k + 1, k + w - 2, k + w - 1, 60, 300])) for _ in range(r.randint(0, 12))]
        of, *found = kernels.minimizers_of(seqs, k, w)
        got = sorted(zip(of.tolist(), *(x.astype(np.int64).tolist() for x in found), strict=True))
        assert got == sorted((i, *x) for i, s in enumerate(seqs) for x in kernels.minimizers(s, k, w))


@pytest.mark.parametrize("most", [0, 1, 255, 256, 1 << 34, (1 << 63) + 1])
def test_numbers_come_back_from_their_planes(most):
    x = np.array([0, most, most // 3, 0], np.uint64)
    planes = kernels.planes(x)
    assert planes.shape[1] == max(1, (most.bit_length() + 7) // 8)
    packs = [planes.T.tobytes(), b"", kernels.planes(x[:1]).T.tobytes(), planes[:2].T.tobytes()]
    assert kernels.from_planes(packs, [4, 0, 1, 2]).tolist() == [*x.tolist(), 0, 0, most]


def _slow_candidates(df, **limits):
    m = mapping.minimizers(df, id_col="doc_id")
    hits = mapping.two_rounds(m, mapping.build_index(df.withColumnRenamed("doc_id", "rid")), 17, **limits)
    return sorted(map(tuple, mapping.candidates(hits, m.groupBy("id").agg(F.count("*").alias("n"))).collect()))


def test_clusters_of_sequences_in_themselves_are_those_of_their_hits(spark):
    r = random.Random(5)
    common = ["".join(r.choice("ACGT") for _ in range(60)) for _ in range(4)]
    long = "".join(r.choice("ACGT") for _ in range(3 * kernels.BATCH // 2))
    seqs = ["".join(r.choice([*common, "N", "ACGTACGTT", "".join(r.choice("ACGTn") for _ in range(30))]) for _ in range(r.randint(0, 6))) for _ in range(60)]
    texts = [*seqs, None, "", "ACG", *common, *common[:2] * 4, kernels.revcomp(common[3]), long, long[50:90], long[::-1], "ACGTTGCA" * 40, "A" * 90]
    near = [(i * 7 - 100, s) for i, s in enumerate(texts)]
    far = [(i * 10**17 - 3 * 10**18, s) for i, s in enumerate(texts[:40])]
    for rows in (near, far, near + near[:3]):
        df = spark.createDataFrame(rows, "doc_id long, seq string").repartition(3).cache()
        for n, (first, second) in enumerate(((500, 1000), (40, 60), (10, 45), (2, 30), (1, 1000))[: 5 if rows is near else 1]):
            got = mapping.self_candidates(df, id_col="doc_id", first=first, second=second, **({"look": 50, "hits": 100} if n % 2 else {}))
            assert sorted(map(tuple, got.collect())) == _slow_candidates(df, first=first, second=second) and got.count() > 10
    assert mapping.self_candidates(df.where("false"), id_col="doc_id").count() == 0
    got = catalogue.queries()["candidate_clusters"](spark, SF)
    assert sorted(map(tuple, got.collect())) == _slow_candidates(table(spark, SF, "sequences"), first=500, second=1000)


def test_hits_of_candidate_clusters_are_not_dealt_out(spark):
    """What is shuffled stays below four times the compressed texts, as the seeds alone are."""
    sf = "/root/testdata/sf0.01"
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    catalogue.queries()["candidate_clusters"](spark, sf).write.format("noop").mode("overwrite").save()
    assert 0 < written() - before < 4 * os.path.getsize(f"{sf}/documents.parquet")


def test_blocks_of_stacks_are_dealt_out_once(spark):
    """What is shuffled is some 70 bytes for each of 12,000 rows a side; blocks dealt out once for each meeting took 360."""
    rows = spark.range(12_000).select(F.lit("c").alias("chrom"), (F.col("id") % 200 * 10).alias("start"), (F.col("id") % 200 * 10 + 100).alias("stop"), F.xxhash64("id").alias("read_id"))
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    intervals.overlap_pairs(rows, rows.withColumnRenamed("read_id", "peak_id")).write.format("noop").mode("overwrite").save()
    assert 0 < written() - before < 130 * 12_000
