"""Readers and writers, round trips and refusals."""

import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from fragmill import streaming
from fragmill.operators import dedup
from fragmill.sources import binary, fastx, formats


def test_fastq_plain_and_gzipped(spark, tmp_path):
    text = "@r1 x\nACGT\n+\nIIII\n@r2\nAC\nGT\n+r2\n@I\nII\n@empty\n\n+\n\n"
    (tmp_path / "a.fq").write_text(text)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(text)
    rows = fastx.read(spark, f"{tmp_path}/a.fq,{tmp_path}/b.fq.gz").orderBy("lane", "read_id").collect()
    assert [(r["lane"], r["read_id"], r["name"], r["seq"], r["qual"]) for r in rows] == [(n, i, f"r{i + 1}", "ACGT", q) for n in (0, 1) for i, q in ((0, "IIII"), (1, "@III"))]
    with pytest.raises(FileNotFoundError):
        fastx.expand(f"{tmp_path}/none*")
    with pytest.raises(ValueError):
        list(fastx.records(iter(["@r", "ACGT", "+", "II"])))


def test_reference_and_lanes(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 first\nACGT\nacgt\n>chrY\nTT\n")
    ref = fastx.reference(spark, f"{tmp_path}/g.fa").orderBy("rid").collect()
    assert [(r["name"], r["length"], r["seq"]) for r in ref] == [("chr1", 8, "ACGTACGT"), ("chrY", 2, "TT")]
    a = fastx.read(spark, f"{tmp_path}/g.fa")
    assert fastx.zip_lanes(a, a).count() == 2
    with pytest.raises(ValueError):
        fastx.zip_lanes(a, a.limit(1))


def test_lists(spark, tmp_path):
    (tmp_path / "wl").write_text("ACGT\nGGGG\nACGT\n")
    assert formats.read_whitelist(spark, f"{tmp_path}/wl").count() == 2
    (tmp_path / "bad").write_text("ACGT\nGGG\n")
    with pytest.raises(ValueError):
        formats.read_whitelist(spark, f"{tmp_path}/bad")
    (tmp_path / "tr").write_text("x,ACGT\nlonely\ny\tGGGG\n")
    assert sorted(map(tuple, formats.read_translation(spark, f"{tmp_path}/tr").collect())) == [("ACGT", "x"), ("GGGG", "y")]
    (tmp_path / "order").write_text("chrY\nchr1\n")
    ref = spark.createDataFrame([(0, "chr1"), (1, "chr2"), (2, "chrY")], "rid int, name string")
    ranks = formats.chromosome_ranks(ref, formats.read_order(spark, f"{tmp_path}/order"))
    assert [r["name"] for r in ranks.orderBy("rank").collect()] == ["chrY", "chr1", "chr2"]
    with pytest.raises(ValueError):
        formats.chromosome_ranks(ref, ["chr9"])


def test_fragments_survive_text(spark, tmp_path):
    f = spark.createDataFrame([("chr1", 5, 50, "ACGT", 2)], "chrom string, start long, len long, bc string, num_dups int")
    formats.write_tsv(formats.bed_cell(f), f"{tmp_path}/out", compressed=True)
    assert [tuple(r) for r in formats.read_fragments(spark, f"{tmp_path}/out").collect()] == [("chr1", 5, 55, "ACGT", 2)]


def test_fixed_width_fragments(spark, tmp_path):
    f = spark.range(100).select((F.col("id") % 2).alias("chrom_id"), "id", (F.col("id") + 9).alias("stop"), F.lit(1).alias("count"), F.lit(7).alias("barcode_key")).withColumnRenamed("id", "start")
    n = binary.write_aev1(f, ["chr1", "chr2"], f"{tmp_path}/f.aev1")
    data = (tmp_path / "f.aev1").read_bytes()
    assert n == 100 and sorted(r[1] for r in binary.read_aev1(data)) == list(range(100))
    with pytest.raises(ValueError):
        binary.read_aev1(data[:-1])


def test_bam_is_whole_and_ordered(spark, tmp_path):
    rows = [("r%d" % i, 99, i % 2, 500 - i, 60, "4M", i % 2, 600, 100, "ACGT", "IIII", 0, "4", "AACC", None, i) for i in range(50)]
    schema = "qname string, flag int, rid int, pos int, mapq int, cigar string, mrid int, mpos int, tlen int, seq string, qual string, nm int, md string, bc string, rg string, read_id long"
    assert binary.write_bam(spark.createDataFrame(rows, schema), [("chr1", 1000), ("chr2", 1000)], f"{tmp_path}/x.bam") == 50
    data, out = (tmp_path / "x.bam").read_bytes(), b""
    assert data.endswith(binary.BGZF_END)
    while data:
        size = struct.unpack_from("<H", data, 16)[0] + 1
        out += zlib.decompress(data[18 : size - 8], -15)
        data = data[size:]
    assert out[:4] == b"BAM\1"
    at = 8 + struct.unpack_from("<i", out, 4)[0]
    n_ref, at = struct.unpack_from("<i", out, at)[0], at + 4
    for _ in range(n_ref):
        at += 8 + struct.unpack_from("<i", out, at)[0]
    places = []
    while at < len(out):
        size, rid, pos = struct.unpack_from("<iii", out, at)
        places.append((rid, pos))
        at += 4 + size
    assert len(places) == 50 and places == sorted(places)


def test_streamed_shards_equal_one_batch(spark, tmp_path):
    rows = [(i % 3, i, "chr1", 50 * (i % 7), 50, i % 2, 30, 1, 1, 50, 50, None) for i in range(90)]
    df = spark.createDataFrame(rows, streaming.SHARD)
    for s in range(3):
        df.where(f"shard = {s}").coalesce(1).write.parquet(f"{tmp_path}/in/{s}")
    src = streaming.read_shards(spark, f"{tmp_path}/in/*", files=1)
    streaming.gather_into(src, f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    want = dedup.dedup(df.drop("arrived", "shard"))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_live_counts_keep_a_bounded_state(spark, tmp_path):
    src = streaming.read_shards(spark, f"{tmp_path}")
    assert streaming.live_counts(src).isStreaming and streaming.first_copies(src).isStreaming


def test_columnar_reads_by_range(spark, tmp_path):
    import random

    from fragmill.sources import cbq

    r = random.Random(4)
    records = []
    for i in range(25):
        pair = []
        for m in (1, 2):
            n = r.randint(1, 90)
            pair.append((f"r{i}/{m}", "".join(r.choice("ACGTN") for _ in range(n)), "".join(r.choice("#I5") for _ in range(n))))
        records.append(pair)
    (tmp_path / "x.cbq").write_bytes(cbq.encode(records, 7))
    flat = [(i, m, *records[i][m]) for i in range(25) for m in (0, 1)]
    got = cbq.read(spark, f"{tmp_path}/x.cbq").select("read_id", "mate", "name", "seq", "qual")
    assert sorted(map(tuple, got.collect())) == flat
    part = cbq.read(spark, f"{tmp_path}/x.cbq", 5, 11)
    assert sorted((x["read_id"], x["mate"]) for x in part.collect()) == [x[:2] for x in flat if 5 <= x[0] < 16]
    assert part.rdd.getNumPartitions() == 3
    (tmp_path / "y.cbq").write_bytes(cbq.encode(records, 7)[:-1])
    with pytest.raises(ValueError):
        cbq.read_index(f"{tmp_path}/y.cbq")


def test_index_is_stored_with_its_reference(spark, tmp_path):
    from fragmill.sources import index

    ref = spark.createDataFrame([(0, "chr1", 120, "ACGTTGCAAC" * 12, 1)], "rid long, name string, length int, seq string, crc long")
    index.save(ref, f"{tmp_path}/i", 15, 5)
    mins, stored, k, w = index.load(spark, f"{tmp_path}/i", ref)
    assert (k, w) == (15, 5) and mins.count() > 0 and stored.count() == 1
    with pytest.raises(ValueError):
        index.load(spark, f"{tmp_path}/i", ref.withColumn("crc", F.lit(2)))


def test_lanes_must_have_equal_counts_and_names(spark):
    from fragmill.sources import fastx

    def lane(sizes, name="r"):
        rows = [(k, i, f"{name}{k}.{i}", "ACGT", "IIII") for k, n in enumerate(sizes) for i in range(n)]
        return spark.createDataFrame(rows, "lane int, read_id long, name string, seq string, qual string")

    assert fastx.zip_lanes(lane([3, 2]), lane([3, 2]), names=True).count() == 5
    with pytest.raises(ValueError, match="don't match"):
        fastx.zip_lanes(lane([3, 2]), lane([2, 3]))
    with pytest.raises(Exception, match="names don't match"):
        fastx.zip_lanes(lane([3]), lane([3], "x"), names=True).collect()


def test_fastq_of_y_and_the_rest(spark, tmp_path):
    from fragmill.sources import fastx

    reads = spark.createDataFrame([(i, f"r{i}", "ACGT"[: 1 + i % 4], "IIII"[: 1 + i % 4], "GG", None) for i in range(20)], "read_id long, name string, seq1 string, qual1 string, seq2 string, qual2 string")
    folders = formats.write_fastq_split(reads, reads.where("read_id % 5 = 0"), f"{tmp_path}/x", ("1", "2"))
    assert [f.rsplit("/", 1)[1] for f in folders] == ["x_Y_R1", "x_Y_R2", "x_noY_R1", "x_noY_R2"]
    names = [sorted(r["name"] for r in fastx.read(spark, f"{f}/*.gz").collect()) for f in folders]
    assert names[0] == names[1] == sorted(f"r{i}" for i in range(0, 20, 5)) and sorted(names[0] + names[2]) == sorted(f"r{i}" for i in range(20))


def test_materialized_fragments_by_range(spark, tmp_path):
    f = spark.range(200).selectExpr("concat('chr', id % 2) chrom", "id * 10 start", "50L len", "id % 3 bc")
    formats.write_materialized(f, f"{tmp_path}/m")
    assert formats.read_materialized(spark, f"{tmp_path}/m").count() == 200
    got = formats.read_materialized(spark, f"{tmp_path}/m", "chr1", 500, 700).collect()
    assert sorted(r["start"] for r in got) == [x for x in range(10, 2000, 20) if x + 50 > 500 and x < 700]


def test_both_outputs_of_one_computation(spark, tmp_path):
    rows = spark.range(30).withColumn("x", F.rand())  # two computations would differ
    formats.write_both(rows, lambda d: d.select("id", "x"), lambda d: d.select("x", "id"), f"{tmp_path}/a", f"{tmp_path}/b")
    a, b = (spark.read.csv(f"{tmp_path}/{n}", sep="\t").collect() for n in "ab")
    assert sorted(map(tuple, a)) == sorted((y, x) for x, y in b)


def test_index_finds_records(spark, tmp_path):
    rows = [("r%d" % i, 99, i % 2, 700 * (i // 2), 60, "4M", i % 2, 600, 100, "ACGT", "IIII", 0, "4", "AACC", None, i) for i in range(400)] + [("u", 4, -1, -1, 0, "*", -1, -1, 0, "AC", None, 0, "", None, None, 999)]
    schema = "qname string, flag int, rid int, pos int, mapq int, cigar string, mrid int, mpos int, tlen int, seq string, qual string, nm int, md string, bc string, rg string, read_id long"
    binary.write_bam(spark.createDataFrame(rows, schema).repartition(5), [("chr1", 10**6), ("chr2", 10**6)], f"{tmp_path}/x.bam", index=True)
    data, bai = (tmp_path / "x.bam").read_bytes(), (tmp_path / "x.bam.bai").read_bytes()
    with pytest.raises(ValueError):
        binary.write_bam(spark.createDataFrame(rows, schema), [], f"{tmp_path}/y.bam", ordered=False, index=True)
    blocks, at = {}, 0
    while at < len(data):
        size = struct.unpack_from("<H", data, at + 16)[0] + 1
        blocks[at] = (zlib.decompress(data[at + 18 : at + size - 8], -15), at + size)
        at += size

    def records(begin, end):
        coffset, u = begin >> 16, begin & 0xFFFF
        text, out = b"", []
        k = coffset
        while k in blocks and k <= end >> 16:
            text, k = text + (blocks[k][0] if k < end >> 16 else blocks[k][0][: end & 0xFFFF]), blocks[k][1]
        while u < len(text):
            size, rid, pos = struct.unpack_from("<iii", text, u)
            out.append((rid, pos))
            u += 4 + size
        return out

    assert bai[:4] == b"BAI\1"
    found, at = [], 8
    for rid in range(struct.unpack_from("<i", bai, 4)[0]):
        n_bin, at = struct.unpack_from("<i", bai, at)[0], at + 4
        for _ in range(n_bin):
            where, n = struct.unpack_from("<Ii", bai, at)
            at += 8
            for _ in range(n):
                got = records(*struct.unpack_from("<QQ", bai, at))
                assert got and all(r == rid and binary._bin(p, p + 4) == where for r, p in got)
                found += got
                at += 16
        n, at = struct.unpack_from("<i", bai, at)[0], at + 4
        assert n == (700 * 199 + 3 >> 14) + 1
        at += 8 * n
    assert sorted(found) == sorted((r[2], r[3]) for r in rows[:-1]) and at == len(bai)


def test_gathered_shards_equal_one_run(spark, tmp_path):
    import random

    from fragmill import presets
    from fragmill.operators import barcode, qc
    from fragmill.sources import shards

    r = random.Random(17)
    cells = ["AAAACCCC", "GGGGTTTT", "ACGTACGT"]
    spoil = lambda b: b if r.random() < 0.7 else b[:3] + r.choice("ACGTN") + b[4:] if r.random() < 0.8 else "TTTTTTTT"
    reads = [(i, spoil(r.choice(cells)), "IIIIIIII", r.randint(0, 1)) for i in range(300)]
    rows = [(i, f"chr{r.randint(1, 2)}", 50 * r.randint(0, 5), 50, r.choice([0, 40, 60]), 1, 1, 50, 50) for i in range(300) if r.random() < 0.9]
    kinds = "read_id long, chrom string, start long, len long, mapq long, dir long, uniq int, pos_len int, neg_len int"
    whitelist = spark.createDataFrame([(c,) for c in cells], "bc string")
    p = presets.preset("atac")
    for shard in range(3):
        mine = lambda x: [(y[0] - 100 * shard, *y[1:]) for y in x if y[0] // 100 == shard]  # noqa: E731, B023
        f = spark.createDataFrame(mine(rows), kinds).withColumnRenamed("read_id", "local_read_id")
        shards.write(f, spark.createDataFrame(mine(reads), "local_read_id long, bc string, qual string, cachehit int"), f"{tmp_path}/s", shard, "one")
    got, counts = shards.collect(spark, f"{tmp_path}/s", 3, whitelist, p, "one")
    raw = spark.createDataFrame(reads, "read_id long, bc string, qual string, cachehit int")
    fixed = barcode.correct(raw, barcode.abundance(raw, whitelist), "read_id").select(F.col("id").alias("read_id"), F.col("corrected").alias("bc"))
    whole = dedup.dedup(spark.createDataFrame(rows, kinds).join(fixed.where("bc is not null"), "read_id"))
    want = dedup.mapq_filter(whole, p.least_mapq).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, qc.summary(whole, whitelist, fixed.join(raw.select("read_id", "cachehit"), "read_id")).collect()))
    assert tuple(counts.agg(F.sum("total"), F.sum("cachehit")).first()) == (300, sum(x[3] for x in reads))
    for n, contract in ((4, "one"), (3, "two")):
        with pytest.raises(ValueError):
            shards.read(spark, f"{tmp_path}/s", n, contract)
