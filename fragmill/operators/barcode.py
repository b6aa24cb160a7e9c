"""Cell barcodes: whitelist lookup, abundance, correction and translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a whitelist is sent to every task; longer ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Phred qualities are clamped to this range, and offset by 33 in text.
LEAST_QUAL, MOST_QUAL, QUAL_OFFSET = 3, 40, 33


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def exact_hits(reads: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Reads whose barcode is on the whitelist as it stands."""
    return reads.join(small(whitelist.select("bc")), "bc", "left_semi")


def abundance(reads: DataFrame, whitelist: DataFrame) -> DataFrame:
    """bc, abundance of each whitelist barcode: reads that show it without an unknown base; 0 for none."""
    clean = reads.where(~F.contains("bc", F.lit("N"))).groupBy("bc").agg(F.count(F.lit(1)).alias("n"))
    return whitelist.select("bc").distinct().join(clean, "bc", "left").select("bc", F.coalesce("n", F.lit(0)).alias("abundance"))


def gate(reads: DataFrame, whitelist: DataFrame, first: int = 100_000, order: str = "event_id") -> DataFrame:
    """n, hits, share, passed: at least 5 % of the first reads must be on the whitelist."""
    batch = reads.orderBy(order).limit(first)
    hit = whitelist.select("bc", F.lit(1).alias("hit")).distinct()
    out = batch.join(hit, "bc", "left").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    return out.withColumn("share", F.round(F.col("hits") / F.col("n"), 6)).withColumn("passed", (F.col("hits") * 20 >= F.col("n")).cast("int"))


def error_chance(qual: Column, at: Column) -> Column:
    """The chance that the base at a 1-based place is wrong, by its clamped quality."""
    q = F.least(F.greatest(F.ascii(F.substring(qual, at, F.lit(1))) - QUAL_OFFSET, F.lit(LEAST_QUAL)), F.lit(MOST_QUAL))
    return F.pow(F.lit(10.0), -q / 10)


def correct(reads: DataFrame, known: DataFrame, id_col: str, errors: int = 1, least: float = 0.9) -> DataFrame:
    """id, bc, corrected, status (exact, corrected, rejected) of each read.

    known(bc, abundance) is the whitelist. A barcode with more unknown bases than errors is rejected; one on
    the whitelist is exact (an unknown base reads as A). Others take the whitelist's barcodes within so many
    substitutions, at the unknown place first: a lone one is accepted; of several the likeliest, by the quality
    of the changed base and abundance, if its share of all exceeds `least`. With errors of 2 and one unknown
    base, the second change lies after it. Only reads off the whitelist make neighbours.
    """
    reads = reads.select(F.col(id_col).alias("id"), "bc", "qual").withColumn("ns", F.length("bc") - F.length(F.translate("bc", "N", "")))
    reads = reads.withColumn("asis", F.translate("bc", "N", "A"))
    wl = small(known.select(F.col("bc").alias("wl"), "abundance"))
    tested = reads.join(wl, F.col("asis") == F.col("wl"), "left").withColumn("on", F.col("wl").isNotNull()).drop("wl", "abundance")
    off = tested.where(~F.col("on") & (F.col("ns") <= errors))
    chance = error_chance(F.col("qual"), F.col("at"))

    def changed(df: DataFrame, source: str, after: str | None) -> DataFrame:
        """Every substitution at each place, or only after the place named; score multiplies the error's chance."""
        places = F.sequence(F.lit(1), F.length("bc"))
        if after:
            places = F.filter(places, lambda i: i > F.col(after))
        df = df.withColumn("at", F.explode(places)).withColumn("to", F.explode(F.split(F.lit("ACGT"), "")))
        here = F.substring(F.col(source), F.col("at"), F.lit(1))
        fixed = (F.substring(F.col("bc"), F.col("at"), F.lit(1)) == "N") if after is None else F.lit(False)
        df = df.where((F.col("to") != "") & ((F.col("to") != here) | fixed))
        new = F.concat(F.substring(F.col(source), F.lit(1), F.col("at") - 1), F.col("to"), F.substring(F.col(source), F.col("at") + 1, F.length(source)))
        return df.withColumns({"cand": new, "score": F.col("score") * chance})

    start = off.withColumn("score", F.lit(1.0)).withColumn("n_at", F.locate("N", "bc"))
    first = changed(start, "asis", None).where((F.col("n_at") == 0) | (F.col("at") == F.col("n_at")))
    found = first.select("id", "cand", "score")
    if errors == 2:
        one = changed(start, "asis", None).withColumn("i", F.col("at")).withColumn("mid", F.col("cand"))
        two = changed(one.where((F.col("n_at") == 0) | (F.col("i") == F.col("n_at"))), "mid", "i")
        found = found.unionByName(two.select("id", "cand", "score"))
    scored = found.join(wl, F.col("cand") == F.col("wl")).withColumn("score", F.col("score") * F.col("abundance")).groupBy("id", "cand").agg(F.max("score").alias("score"))
    best = scored.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.max(F.struct("score", "cand")).alias("top"))
    good = best.where((F.col("n") == 1) | ((F.col("total") > 0) & (F.col("top.score") / F.nullif("total", F.lit(0.0)) > least))).select(F.col("id").alias("good"), F.col("top.cand").alias("cand"))
    joined = tested.join(good, F.col("id") == F.col("good"), "left")
    accepted = F.when(F.col("on") & (F.col("ns") <= errors), F.col("asis")).when(F.col("cand").isNotNull(), F.col("cand"))
    status = F.when(F.col("on") & (F.col("ns") <= errors), "exact").when(F.col("cand").isNotNull(), "corrected").otherwise("rejected")
    return joined.select("id", "bc", accepted.alias("corrected"), status.alias("status"))


def translate(reads: DataFrame, table: DataFrame, segments: int = 1) -> DataFrame:
    """Adds `name`: each of so many equal parts of the barcode by table(from, to), joined by `-`. A part that
    the table lacks raises."""
    size = F.length("bc") / segments
    out = reads
    for i in range(segments):
        part = F.substring(F.col("bc"), (F.lit(1) + i * size).cast("int"), size.cast("int"))
        side = small(table.select(F.col("from").alias(f"_f{i}"), F.col("to").alias(f"_t{i}")))
        out = out.withColumn(f"_p{i}", part).join(side, F.col(f"_p{i}") == F.col(f"_f{i}"), "left")
    names = [F.when(F.col(f"_t{i}").isNull(), F.raise_error(F.concat(F.lit("barcode not in the table: "), F.col(f"_p{i}")))).otherwise(F.col(f"_t{i}")) for i in range(segments)]
    out = out.withColumn("name", F.concat_ws("-", *names))
    return out.drop(*(f"_{x}{i}" for x in "pft" for i in range(segments)))


def number_first_seen(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """key and its 0-based number in the order of first appearance: a row for each distinct key is ranked, by ranges."""
    from fragmill.operators.gather import rank

    firsts = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    ranked = rank(firsts, [*(F.col(f"_first.{c}") for c in order), F.col(key)])
    return ranked.select(key, (F.col("rank") - 1).cast("int").alias(out))


def whitelist_fingerprint(whitelist: DataFrame) -> DataFrame:
    """n and an order-free 64-bit digest of the distinct barcodes."""
    return whitelist.select("bc").distinct().agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("bc")).alias("digest"))
