"""A paired-end assay from reads to fragments, as one chain of DataFrames.

reads(read_id, seq1, seq2, bc) and ref(rid, name, seq) give fragments(read_id, chrom, start, len, bc, mapq,
dir, uniq, pos_len, neg_len), which the duplicate, shift and peak operators take from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.functions import kernels, mapq, sam, seq, shift
from fragmill.operators import barcode, dedup, mapping
from fragmill.plans.lineage import cut
from fragmill.presets import Parameters, check

#: Bases of a stored piece of a contig. Its overlap with the next holds the longest read and its band.
CHUNK = 1 << 16


def trim(reads: DataFrame, least: int = 30) -> DataFrame:
    """Both mates cut where they overlap, so that no adapter is left."""

    def run(batches):
        for pdf in batches:
            ends = [kernels.overlap_trim(a, b, least) for a, b in zip(pdf["seq1"], pdf["seq2"], strict=True)]
            pdf["seq1"] = [s[:e[0]] for s, e in zip(pdf["seq1"], ends, strict=True)]
            pdf["seq2"] = [s[:e[1]] for s, e in zip(pdf["seq2"], ends, strict=True)]
            yield pdf

    return reads.mapInPandas(run, reads.schema)


def barcoded(reads: DataFrame, whitelist: DataFrame, p: Parameters) -> DataFrame:
    """reads(read_id, ..., bc, bc_qual) with whitelist barcodes, corrected by their abundance among the reads. Others go,
    or keep what was read if off-whitelist output is asked for."""
    raw = cut(reads.select("read_id", "bc", F.col("bc_qual").alias("qual")))
    found = barcode.correct(raw, barcode.abundance(raw, whitelist), "read_id", p.barcode_errors, p.barcode_confidence)
    found = found.select(F.col("id").alias("read_id"), F.col("corrected").alias("_bc"))
    bc = F.coalesce("_bc", "bc") if p.output_off_whitelist else F.col("_bc")
    return reads.join(found, "read_id").withColumn("bc", bc).where("bc is not null").drop("_bc", "bc_qual")


def chunks(ref: DataFrame, overlap: int) -> DataFrame:
    """rid, chunk, piece: overlapping pieces of contigs, so that a lookup ships a piece and not a contig."""
    n = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / CHUNK)))
    cutout = F.substring(F.col("seq"), (F.col("chunk") * CHUNK + 1).cast("int"), F.lit(CHUNK + overlap))
    return ref.withColumn("chunk", n).select("rid", "chunk", cutout.alias("piece"))


def windows(cands: DataFrame, pieces: DataFrame, errors: int) -> DataFrame:
    """Adds pattern: the reference from errors before `start` to errors past the read. Windows that leave the contig go."""
    first = F.col("start") - errors
    at = cands.where(first >= 0).withColumn("chunk", F.floor(first / CHUNK))
    size = F.length("seq") + 2 * errors
    out = at.join(pieces, ["rid", "chunk"]).withColumn("pattern", F.substring(F.col("piece"), (first - F.col("chunk") * CHUNK + 1).cast("int"), size))
    return out.where(F.length("pattern") == size).drop("piece", "chunk")


def _located(rows: DataFrame, errors: int) -> DataFrame:
    """Adds begin and finish, the inclusive ends on the reference, from an alignment within the window."""

    def run(batches):
        for pdf in batches:
            got = []
            for p, s, e in zip(pdf["pattern"], pdf["seq"], pdf["err"], strict=True):
                if p[errors : errors + len(s)] == s or not e:
                    got.append((errors, errors + len(s) - 1))
                    continue
                _, at, cigar = kernels.align(p, s)
                got.append((at, at + sum(n for n, op in cigar if op != "I") - 1))
            pdf["begin"] = pdf["start"] - errors + [g[0] for g in got]
            pdf["finish"] = pdf["start"] - errors + [g[1] for g in got]
            yield pdf.drop(columns=["pattern", "seq"])

    kept = [f"`{n}` {t}" for n, t in rows.dtypes if n not in ("pattern", "seq")]
    return rows.mapInPandas(run, ", ".join([*kept, "begin long, finish long"]))


def drafts(mates: DataFrame, ref: DataFrame, p: Parameters, k: int = 17, w: int = 7) -> tuple[DataFrame, DataFrame]:
    """Verified places of mates(id, seq): id, strand (1 plus), rid, start, err, end, pattern, seq; and the bases of
    each mate that frequent seeds cover."""
    index = cut(mapping.build_index(ref, k, w))
    mins = cut(mapping.minimizers(mates, k, w, "id"))
    hits = mapping.two_rounds(mins, index, k, *p.max_seed_frequencies)
    found = mapping.candidates(hits, mins.groupBy("id").agg(F.count(F.lit(1)).alias("n")), p.errors, p.min_seeds)
    placed = found.join(mates, "id")
    plus = F.col("same") == 1
    placed = placed.select("id", F.col("same").alias("strand"), "rid", F.when(plus, F.col("at")).otherwise(F.col("at") - F.length("seq") + 1).alias("start"), F.when(plus, F.col("seq")).otherwise(seq.revcomp("seq")).alias("seq"))
    longest = mates.agg(F.max(F.length("seq"))).first()[0] or 0
    verified = mapping.verify(windows(placed.distinct(), chunks(ref, longest + 2 * p.errors), p.errors), p.errors)
    return verified, mapping.repetitive_length(mins, index, k, w, p.max_seed_frequencies[0])


def _placed(reads: DataFrame, ref: DataFrame, p: Parameters) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The reads that count, all places of their mates (id, read_id, mate, strand, rid, begin, finish, err), and each
    mate's quality and least errors."""
    check(p)
    reads = trim(reads, p.min_read_length) if p.trim_adapters else reads
    reads = reads.where((F.length("seq1") >= p.min_read_length) & (F.length("seq2") >= p.min_read_length))
    both = reads.select("read_id", F.posexplode(F.array("seq1", "seq2")).alias("mate", "seq"))
    mates = cut(both.select((F.col("read_id") * 2 + F.col("mate")).alias("id"), F.upper("seq").alias("seq")))
    verified, repeats = drafts(mates, ref, p)
    placed = cut(_located(verified, p.errors).withColumn("read_id", F.expr("id div 2")).withColumn("mate", (F.col("id") % 2).cast("int")))
    alone = mapping.best_and_second(placed, ["id"], "err", p.errors + 1)
    read_len = mates.select("id", F.length("seq").alias("read_len"))
    own = alone.join(read_len, "id").join(repeats, "id", "left").fillna(0, ["rep_len", "rep_seeds"])
    q = mapq.single(F.col("best"), F.col("second"), F.col("n_best"), F.col("n_second"), F.col("read_len"), F.col("read_len"), F.col("rep_len"), p.errors)
    return reads, placed, cut(own.select("id", q.alias("q"), F.col("best").alias("m"), "n_best", "read_len", "rep_len"))


def contacts(reads: DataFrame, ref: DataFrame, p: Parameters) -> DataFrame:
    """read_id, chrom1, pos1, s1, chrom2, pos2, s2, mapq, uniq, bc, num_dups: both mates' 5' ends wherever they map, also on two
    contigs, the end on the earlier contig (or the smaller place) first.

    Each mate has its best place, one of equals drawn by the read's number; the lower of both qualities counts. Mates
    map as a whole: a read across a junction maps only if its errors stay within the limit.
    """
    reads, placed, own = _placed(reads, ref, p)
    best = mapping.pick_best(placed.distinct(), ["id"], "err", ["rid", "begin", "strand"], 1, most=p.drop_repetitive).join(own.select("id", "q", "n_best"), "id")
    at = F.when(F.col("strand") == 1, F.col("begin")).otherwise(F.col("finish"))
    side = lambda n: best.where(F.col("mate") == n - 1).select("read_id", F.col("rid").alias(f"rid{n}"), at.alias(f"pos{n}"), F.col("strand").alias(f"s{n}"), F.col("q").alias(f"q{n}"), F.col("n_best").alias(f"n{n}"))
    both = side(1).join(side(2), "read_id")
    both = both.select("read_id", "rid1", "pos1", "s1", "rid2", "pos2", "s2", F.least("q1", "q2").cast("long").alias("mapq"), ((F.col("n1") == 1) & (F.col("n2") == 1)).cast("int").alias("uniq"))
    both = sam.pairs_flip(both.where(F.col("mapq") >= p.least_mapq)).join(reads.select("read_id", "bc"), "read_id")
    both = dedup.dedup_pairs(both) if p.remove_duplicates else both.withColumn("num_dups", F.lit(1))
    name = lambda n: ref.select(F.col("rid").alias(f"rid{n}"), F.col("name").alias(f"chrom{n}"))
    return both.join(name(1), "rid1").join(name(2), "rid2").select("read_id", "chrom1", "pos1", "s1", "chrom2", "pos2", "s2", "mapq", "uniq", "bc", "num_dups")


def map_pairs(reads: DataFrame, ref: DataFrame, p: Parameters) -> DataFrame:
    """The best mapping of each pair, one of equals drawn by the read's number."""
    if p.split_alignment:
        raise ValueError("mates that may lie anywhere give contacts(), not fragments")
    reads, placed, own = _placed(reads, ref, p)

    side = lambda s, x: placed.where(F.col("strand") == s).select("read_id", "rid", F.col("mate").alias(f"mate{x}"), F.col("begin").alias(f"begin{x}"), F.col("finish").alias(f"finish{x}"), F.col("err").alias(f"err{x}"))
    pairs = side(1, "1").join(side(0, "2"), ["read_id", "rid"]).where("mate1 <> mate2")
    length = F.col("finish1") - F.col("begin1") + 1
    near = (F.col("finish1") <= F.col("finish2") + length - p.min_read_length) & (F.col("finish2") <= F.col("finish1") + p.max_insert - length)
    pairs = cut(pairs.where(near).distinct().withColumn("err", F.col("err1") + F.col("err2")))
    sums = mapping.best_and_second(pairs, ["read_id"], "err", 2 * p.errors + 1)
    best = mapping.pick_best(pairs, ["read_id"], "err", ["rid", "begin1", "begin2"], p.best, most=p.drop_repetitive)
    mate = lambda n: own.where(F.col("id") % 2 == n).select(F.expr("id div 2").alias("read_id"), *(F.col(c).alias(f"{c}_{n}") for c in ("q", "m", "read_len", "rep_len")))
    out = best.join(sums.drop("err"), "read_id").join(mate(0), "read_id").join(mate(1), "read_id")
    quality = mapq.paired(F.col("q_0"), F.col("q_1"), F.col("m_0"), F.col("m_1"), F.col("best"), F.col("second"), F.col("n_best"), F.col("n_second"), F.col("rep_len_0") + F.col("rep_len_1"), F.col("read_len_0") + F.col("read_len_1"))
    f = mapping.fragment(F.col("begin1"), F.col("finish1"), F.col("begin2"), F.col("finish2"), F.lit(True))
    names = ref.select("rid", F.col("name").alias("chrom"))
    out = out.join(names, "rid").join(reads.select("read_id", "bc"), "read_id")
    return out.select("read_id", "chrom", *(c.alias(n) for n, c in f.items()), "bc", quality.cast("long").alias("mapq"), (F.col("mate1") == 0).cast("long").alias("dir"), (F.col("n_best") == 1).cast("int").alias("uniq"))


def fragments(reads: DataFrame, ref: DataFrame, p: Parameters, whitelist: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Mapped, deduplicated, filtered and shifted, in the order that the parameters ask for.

    With a whitelist(bc), reads have text barcodes and bc_qual, which are corrected first. names(from, to) translates the
    barcodes that are left.
    """
    reads = reads if whitelist is None else cut(barcoded(reads, whitelist, p))
    found = map_pairs(reads, ref, p)
    shifted = (lambda d: shift.for_output(d, p.output, True, *p.tn5)) if p.tn5_shift else (lambda d: d)
    if not p.shift_after_dedup:
        found = shifted(found)
    if not p.remove_duplicates:
        found = found.withColumn("num_dups", F.lit(1))
    elif p.bulk_level_dedup:
        found = cut(found)
        found = dedup.dedup_cells_at_bulk(found, dedup.abundance(found))
    else:
        found = dedup.dedup(found)
    if p.allocate_multi:
        found = dedup.allocate_multi(cut(found))
    kept = dedup.mapq_filter(found, p.least_mapq)
    kept = shifted(kept) if p.shift_after_dedup else kept
    return kept if names is None else barcode.translate(kept, names).drop("bc").withColumnRenamed("name", "bc")


