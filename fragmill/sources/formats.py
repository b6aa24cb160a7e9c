"""Rows of the text formats, and their readers and writers. All are tab-separated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.plans.lineage import cut


def _strand(col: str = "dir") -> Column:
    return F.when(F.col(col) == 1, F.lit("+")).otherwise(F.lit("-"))


def _flip(col: str = "dir") -> Column:
    return F.when(F.col(col) == 1, F.lit("-")).otherwise(F.lit("+"))


def bed_cell(frags: DataFrame, barcode: str = "bc") -> DataFrame:
    """chrom, start, stop, barcode, num_dups."""
    return frags.select("chrom", "start", (F.col("start") + F.col("len")).alias("stop"), F.col(barcode).alias("barcode"), "num_dups")


def bed_bulk(frags: DataFrame) -> DataFrame:
    """chrom, start, stop, N, mapq, strand, num_dups."""
    return frags.select("chrom", "start", (F.col("start") + F.col("len")).alias("stop"), F.lit("N").alias("name"), "mapq", _strand().alias("strand"), "num_dups")


def tagalign_single(frags: DataFrame, cell: bool) -> DataFrame:
    """chrom, start, stop, N, mapq, strand; without barcodes num_dups too."""
    out = frags.select("chrom", "start", (F.col("start") + F.col("len")).alias("stop"), F.lit("N").alias("name"), "mapq", _strand().alias("strand"), "num_dups")
    return out.drop("num_dups") if cell else out


def tagalign_pairs(frags: DataFrame, cell: bool) -> DataFrame:
    """Two rows a fragment, read 1's strand first: nth tells them apart. Without barcodes the second has num_dups."""
    plus = F.struct(F.col("start").alias("start"), (F.col("start") + F.col("pos_len")).alias("stop"), F.lit("+").alias("strand"))
    end = F.col("start") + F.col("len")
    minus = F.struct((end - F.col("neg_len")).alias("start"), end.alias("stop"), F.lit("-").alias("strand"))
    rows = F.when(F.col("dir") == 1, F.array(plus, minus)).otherwise(F.array(minus, plus))
    out = frags.select("chrom", "read_id", "mapq", "num_dups", F.posexplode(rows).alias("nth", "r"))
    base = ["chrom", "r.start", "r.stop", F.lit("N").alias("name"), "mapq", "r.strand", "read_id", "nth"]
    return out.select(*base) if cell else out.select(*base, F.when(F.col("nth") == 1, F.col("num_dups")).alias("num_dups"))


def paf(frags: DataFrame, ref_len: Column, read_len: Column, mapq: str = "mapq") -> DataFrame:
    """PAF's twelve columns; matches and block length are the fragment's."""
    stop = F.col("start") + F.col("len")
    return frags.select(F.col("read_id").cast("string").alias("name"), read_len.alias("read_len"), F.lit(0).alias("read_start"), read_len.alias("read_stop"), _strand().alias("strand"), "chrom", ref_len.alias("ref_len"), "start", stop.alias("stop"), read_len.alias("matches"), F.col("len").alias("block"), F.col(mapq).alias("mapq"))


def paf_pairs(frags: DataFrame, ref_len: Column) -> DataFrame:
    """Both mates' PAF rows with their own qualities mapq1 and mapq2."""
    end = F.col("start") + F.col("len")
    plus = F.struct(F.col("start").alias("start"), (F.col("start") + F.col("pos_len")).alias("stop"), F.lit("+").alias("strand"))
    minus = F.struct((end - F.col("neg_len")).alias("start"), end.alias("stop"), F.lit("-").alias("strand"))
    rows = F.when(F.col("dir") == 1, F.array(plus, minus)).otherwise(F.array(minus, plus))
    out = frags.select("read_id", "chrom", "mapq1", "mapq2", F.posexplode(rows).alias("nth", "r"))
    length = F.col("r.stop") - F.col("r.start")
    return out.select(F.concat(F.col("read_id").cast("string"), F.lit("/"), (F.col("nth") + 1).cast("string")).alias("name"), length.alias("read_len"), "r.strand", "chrom", ref_len.alias("ref_len"), "r.start", "r.stop", F.when(F.col("nth") == 0, F.col("mapq1")).otherwise(F.col("mapq2")).alias("mapq"))


def sam(rows: DataFrame) -> DataFrame:
    """SAM's columns of rows(qname, flag, rname, pos, mapq, cigar, mrname, mpos, tlen, seq, qual, nm, md, bc); 0-based places in."""
    same = F.col("mrname").isNull()
    tags = F.concat_ws("\t", F.concat(F.lit("NM:i:"), F.col("nm")), F.concat(F.lit("MD:Z:"), F.col("md")), F.concat(F.lit("CB:Z:"), F.col("bc")))
    return rows.select("qname", "flag", "rname", (F.col("pos") + 1).alias("pos"), "mapq", "cigar", F.when(same, "*").when(F.col("mrname") == F.col("rname"), "=").otherwise(F.col("mrname")).alias("rnext"), F.when(same, 0).otherwise(F.col("mpos") + 1).alias("pnext"), "tlen", "seq", F.coalesce("qual", F.lit("*")).alias("qual"), tags.alias("tags"))


def sam_header(ref: DataFrame) -> DataFrame:
    return ref.orderBy("rid").select(F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "name"), F.concat(F.lit("LN:"), "length")).alias("value"))


def pairs(rows: DataFrame) -> DataFrame:
    """readID, chr1, pos1, chr2, pos2, strand1, strand2, pair_type of rows with 0-based places."""
    sign = lambda c: F.when(F.col(c) == 1, "+").otherwise("-")
    return rows.select(F.col("read_name").alias("readID"), F.col("chrom1").alias("chr1"), (F.col("pos1") + 1).alias("pos1"), F.col("chrom2").alias("chr2"), (F.col("pos2") + 1).alias("pos2"), sign("s1").alias("strand1"), sign("s2").alias("strand2"), F.lit("UU").alias("pair_type"))


def pairs_header(ref: list[tuple[str, int]]) -> list[str]:
    """ref: (name, length) in rank order, a row for each contig."""
    return ["## pairs format v1.0.0", "#shape: upper triangle", *(f"#chromsize: {n} {size}" for n, size in ref), "#columns: readID chr1 pos1 chr2 pos2 strand1 strand2 pair_type"]


def qc_csv(counts: DataFrame) -> DataFrame:
    """barcode, total, duplicate, unmapped, lowmapq, cachehit, fric, estfrip, the last two with five places."""
    five = lambda c: F.format_string("%.5f", F.col(c).cast("double"))
    return counts.select(F.col("bc").alias("barcode"), "total", F.col("dup").alias("duplicate"), "unmapped", "lowmapq", "cachehit", five("fric").alias("fric"), five("est_frip").alias("estfrip"))


def narrow_peak(peaks: DataFrame, prefix: str = "peak") -> DataFrame:
    """narrowPeak's ten columns; names follow a hash-free order of place within the chromosome."""
    name = F.concat(F.lit(f"{prefix}_"), "chrom", F.lit("_"), F.col("start").cast("string"))
    return peaks.select("chrom", "start", "stop", name.alias("name"), "score", F.lit(".").alias("strand"), "signal", "p", "q", F.col("summit").alias("peak"))


def summits(peaks: DataFrame, prefix: str = "peak") -> DataFrame:
    at = F.col("start") + F.col("summit")
    return peaks.select("chrom", at.alias("start"), (at + 1).alias("stop"), F.concat(F.lit(f"{prefix}_"), "chrom", F.lit("_"), F.col("start").cast("string")).alias("name"), F.col("p").alias("score"))


def bedgraph(steps: DataFrame, value: str) -> DataFrame:
    return steps.select("chrom", "start", "stop", F.col(value).alias("value"))


def matrix_market(counts: DataFrame, n_features: int, n_cells: int, n_entries: int) -> tuple[list[str], DataFrame]:
    """Header lines and entries `feature cell n`, numbered from 0 and ordered by cell."""
    head = ["%%MatrixMarket matrix coordinate integer general", f"{n_features} {n_cells} {n_entries}"]
    return head, counts.orderBy("bc_idx", "feat_idx").select("feat_idx", "bc_idx", "n")


def matrix_sides(cells: DataFrame, feats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Barcodes with `-1` after them, in number order, and features with starts counted from 1."""
    return cells.orderBy("bc_idx").select(F.concat(F.col("bc").cast("string"), F.lit("-1")).alias("barcode")), feats.orderBy("feat_idx").select("chrom", (F.col("start") + 1).alias("start"), "stop")


def write_tsv(df: DataFrame, path: str, compressed: bool = False) -> None:
    """One folder of part files; rows stay where they are computed."""
    df.write.mode("overwrite").options(sep="\t", header=False, quote="", emptyValue="").option("compression", "gzip" if compressed else "none").csv(path)


def write_both(found: DataFrame, fragments, alignments, frag_path: str, sam_path: str) -> None:
    """Fragments and alignments from one computation: `found` is checkpointed, and both functions of it are written."""
    kept = cut(found)
    write_tsv(fragments(kept), frag_path, compressed=True)
    write_tsv(alignments(kept), sam_path)


def fastq(reads: DataFrame, mate: str = "") -> DataFrame:
    """value: the four lines of each read (name, seq and qual with `mate` behind their names); a null quality is `I`s."""
    seq, qual = F.col(f"seq{mate}"), F.coalesce(F.col(f"qual{mate}"), F.repeat(F.lit("I"), F.length(f"seq{mate}")))
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), seq, F.lit("+"), qual).alias("value"))


def write_fastq_split(reads: DataFrame, y_reads: DataFrame, path: str, mates: tuple[str, ...] = ("",), key: str = "read_id") -> list[str]:
    """A folder of gzipped FASTQ parts for the reads that touch Y and one for the others, for each mate; a pair goes to Y
    if either mate does. Rows keep the order of `key` within and across parts."""
    out = []
    for tag, rows in zip(("_Y", "_noY"), split_y(reads, y_reads, key), strict=True):
        rows = cut(rows.repartitionByRange(key).sortWithinPartitions(key))
        for nth, mate in enumerate(mates, 1):
            out.append(f"{path}{tag}_R{nth}")
            fastq(rows, mate).write.mode("overwrite").option("compression", "gzip").text(out[-1])
    return out


def write_materialized(frags: DataFrame, path: str) -> None:
    """Fragments as Parquet in the order of place: a reader of a range skips files and row groups by their statistics,
    and barcodes are dictionary-encoded."""
    frags.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start", "len", "bc").write.mode("overwrite").parquet(path)


def read_materialized(spark: SparkSession, path: str, chrom: str | None = None, start: int = 0, stop: int | None = None) -> DataFrame:
    """All fragments, or those that overlap a range of a chromosome."""
    df = spark.read.parquet(path)
    if chrom is None:
        return df
    df = df.where((F.col("chrom") == chrom) & (F.col("start") + F.col("len") > start))
    return df if stop is None else df.where(F.col("start") < stop)


def split_y(rows: DataFrame, y_reads: DataFrame, key: str = "read_id") -> tuple[DataFrame, DataFrame]:
    """Rows whose read touches Y, and the others; together they are all rows."""
    hits = y_reads.select(key).distinct()
    return rows.join(hits, key, "left_semi"), rows.join(hits, key, "left_anti")


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.csv(path, sep="\t", schema="chrom string, start long, stop long, bc string, count long", comment="#")
    return out.where("stop > start and count > 0")


def read_bed3(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, start long, stop long", comment="#", mode="DROPMALFORMED")


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, start long, stop long, value double", comment="#").where("chrom not like 'track%'")


def read_narrow_peak(spark: SparkSession, path: str) -> DataFrame:
    schema = "chrom string, start long, stop long, name string, score int, strand string, signal double, p double, q double, peak long"
    return spark.read.csv(path, sep="\t", schema=schema, comment="#")


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """bc of a list, plain or gzipped; barcodes of over 32 bases or of several lengths raise."""
    df = spark.read.text(path).select(F.trim("value").alias("bc")).where("bc <> ''")
    r = df.agg(F.min(F.length("bc")).alias("low"), F.max(F.length("bc")).alias("high")).first()
    if r["high"] is not None and (r["high"] > 32 or r["low"] != r["high"]):
        raise ValueError(f"barcodes of {r['low']} to {r['high']} bases")
    return df.distinct()


def read_translation(spark: SparkSession, path: str, from_first: bool = False) -> DataFrame:
    """from, to of lines split at the first comma or tab, `to` first unless from_first; other lines don't count."""
    parts = F.regexp_extract("value", r"^([^,\t]*)[,\t](.*)$", 1), F.regexp_extract("value", r"^([^,\t]*)[,\t](.*)$", 2)
    df = spark.read.text(path).where(F.col("value").rlike("[,\t]"))
    return df.select(parts[0 if from_first else 1].alias("from"), parts[1 if from_first else 0].alias("to"))


def read_order(spark: SparkSession, path: str) -> list[str]:
    """Chromosome names in order; the list is as short as the genome's."""
    return [r[0] for r in spark.read.text(path, wholetext=False).coalesce(1).select(F.trim("value")).where("trim(value) <> ''").collect()]


def chromosome_ranks(ref: DataFrame, order: list[str]) -> DataFrame:
    """ref(rid, name, ...) with rank: listed names first, the others in file order. Unknown names raise."""
    spark = ref.sparkSession
    listed = spark.createDataFrame([(n, i) for i, n in enumerate(order)], "listed string, at int")
    unknown = listed.join(ref, F.col("listed") == F.col("name"), "left_anti").count()
    if unknown:
        raise ValueError(f"{unknown} names are not in the reference")
    from pyspark.sql import Window

    joined = ref.join(F.broadcast(listed), F.col("name") == F.col("listed"), "left")  # as long as the genome's contigs
    ranked = F.row_number().over(Window.orderBy(F.col("at").isNull(), "at", "rid")) - 1
    return joined.withColumn("rank", ranked).drop("listed", "at")
