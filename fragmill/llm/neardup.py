"""Operator 9: near-duplicates by MinHash bands, odd sketches and exact verification.

Texts with equal shingle sets form a class, of which the smallest id goes on. Bands of
MinHash values deal the classes into buckets; each member of a bucket is paired with the
bucket's smallest. A pair's similarity is estimated from odd sketches: one-permutation
MinHash samples toggle bits of a bitmap, and the XOR's population count tells how many
samples differ. What the estimate leaves is confirmed on the full sets. Links become
components; then, in buckets that still hold several, the members outside the largest one
are compared with all, in blocks, so that no pair within a component, no pair of the
largest component's members and no group's square is ever listed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import Hashes, join_few, map_rows, mix, resident, shared_folder, staged, texts

#: MinHash values of a text, and the probability at most that all bands miss a pair at the threshold.
HASHES, MISS = 120, 1e-6
#: Bins of the samples (2^BIN_BITS) and bits of the sketch (2^SKETCH_BITS).
BIN_BITS, SKETCH_BITS = 12, 11
#: Standard deviations of the estimate below the threshold at which a pair still goes on.
SIGMAS = 5.5
#: Members of a block when a bucket is compared across its components.
BLOCK = 256
#: Copies from which a class counts as hot, if at least one row in HOT_PART has its text: so at most HOT_PART classes are.
HOT, HOT_PART = 1000, 100_000

_RNG = np.random.default_rng(20240229)
_MULTIPLIERS = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(text: bytes, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = resident("hashes", Hashes).of(words)
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for i in range(min(width, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def minhash(s: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty."""
    least = None
    for at in range(0, len(s), 4096):
        part = (s[at : at + 4096, None] * _MULTIPLIERS + _ADDENDS).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def band_rows(threshold: float) -> int:
    """Values in a band: as many as MISS allows. 5 (24 bands) for 0.85, 4 (30 bands) for 0.8."""
    return next((r for r in range(8, 1, -1) if (1 - threshold**r) ** (HASHES // r) <= MISS), 1)


def bands(m: np.ndarray, rows: int) -> np.ndarray:
    n = HASHES // rows
    h = np.arange(n, dtype=np.uint64)
    for i in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m[: n * rows].reshape(n, rows)[:, i])
    return h.view(np.int64)


def _bitmap(samples: np.ndarray) -> bytes:
    bits = np.bincount((mix(samples) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def odd_sketch(s: np.ndarray) -> tuple[int, bytes]:
    """MinHash samples (the least hash of each bin that isn't empty) and the bitmap of their parities."""
    bins = s >> np.uint64(64 - BIN_BITS)
    samples = s[np.append(True, bins[1:] != bins[:-1])]
    return len(samples), _bitmap(samples)


def _filled(n: np.ndarray) -> np.ndarray:
    """Expected bins with one of n or more elements."""
    k = 1 << BIN_BITS
    return k * -np.expm1(n * np.log1p(-1 / k))


def may_link(na: np.ndarray, nb: np.ndarray, ka: np.ndarray, kb: np.ndarray, sa: np.ndarray, sb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of na and nb elements, with ka and kb samples and such sketches, may be that similar (from 0.5).

    Odd bits are at most the samples in one set alone. Those are at most the elements in one set alone, which at the
    threshold are (1 - t) / (1 + t) of both sizes, and the elements that no bin kept: a bin's two samples differ only if
    one of them lies in one set alone, and the other does too unless it was not kept. Beside this bound, which holds for
    certain, samples in common are estimated from odd bits: at the threshold the samples of the union are a draw without
    replacement, which gives their mean and deviation, and a pair goes on unless it falls SIGMAS short.
    """
    k, m = float(1 << BIN_BITS), float(1 << SKETCH_BITS)
    odd = np.bitwise_count(sa ^ sb).sum(axis=1)
    lost = (na - ka) + (nb - kb)
    ok = odd <= (na + nb) * (1 - threshold) / (1 + threshold) + lost + 1e-9
    drawn_from = lost > 0
    if drawn_from.any():
        differ = np.log(np.maximum(1 - 2 * odd / m, 1e-6)) / np.log1p(-2 / m)
        common = (ka + kb - differ) / 2
        union = (na + nb) / (1 + threshold)
        drawn = np.minimum(_filled(union) + ((ka - _filled(na)) + (kb - _filled(nb))) / 2, union)
        c = union / k
        spread = drawn * threshold * (1 - threshold) * np.maximum(union - drawn, 0) / np.maximum(union - 1, 1)
        spread = spread + 0.5 * threshold**2 * k * np.maximum(np.exp(-c) - (1 + c) * np.exp(-2 * c), 0)
        d = 2 * (1 - threshold) * drawn
        noise = m / 4 * -np.expm1(-4 * d / m) - d * np.exp(-4 * d / m)
        spread = spread + np.maximum(noise, 0) / np.exp(-4 * d / m) / 4 + 1
        ok &= ~drawn_from | (common >= threshold * drawn - SIGMAS * np.sqrt(spread))
    return ok & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)


def sketches(df: DataFrame, width: int = 3, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, s1, s2 (a hash of the set), bands array<long>, k (samples), sketch binary; null but for the first two for an empty set."""

    of_band = band_rows(threshold)

    def batch(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {x: [] for x in ("n", "s1", "s2", "bands", "k", "sketch")}
        for text in texts(b.column(1)):
            s = shingles(text, width)
            row: tuple = (len(s), None, None, None, None, None)
            if len(s):
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                row = (len(s), (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), bands(minhash(s), of_band), *odd_sketch(s))
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        return {
            "doc_id": b.column(0),
            "n_shingles": pa.array(out["n"], pa.int64()),
            **{x: pa.array(out[x], pa.int64()) for x in ("s1", "s2")},
            "bands": pa.array(out["bands"], pa.list_(pa.int64())),
            "k": pa.array(out["k"], pa.int64()),
            "sketch": pa.array(out["sketch"], pa.binary()),
        }

    schema = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, k long, sketch binary"
    return map_rows(df, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], schema, batch)


def _words64(sketch: pa.Array | list) -> np.ndarray:
    return np.frombuffer(b"".join(sketch), np.uint64).reshape(-1, (1 << SKETCH_BITS) // 64)


def _plausible(pairs: DataFrame, info: DataFrame, threshold: float) -> DataFrame:
    """Of pairs a, b those that the sketches don't exclude."""
    side = lambda x: info.select(*(F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "k", "sketch")))
    joined = pairs.join(side("a"), F.col("a") == F.col("rep_a")).join(side("b"), F.col("b") == F.col("rep_b"))

    def batch(b: pa.RecordBatch) -> dict:
        v = {n: b.column(i).to_numpy() for i, n in enumerate(("a", "b", "na", "nb", "ka", "kb"))}
        ok = may_link(v["na"], v["nb"], v["ka"], v["kb"], _words64(b.column(6).to_pylist()), _words64(b.column(7).to_pylist()), threshold)
        return {"a": v["a"][ok], "b": v["b"][ok]}

    return map_rows(joined, ["a", "b", "n_a", "n_b", "k_a", "k_b", "sketch_a", "sketch_b"], "a long, b long", batch)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs a, b those with 100 * intersection >= percent * union, by the full sets."""
    side = lambda x: sets.select(F.col("rep").alias(f"rep_{x}"), F.col("items").alias(f"items_{x}"))
    joined = pairs.join(side("a"), F.col("a") == F.col("rep_a")).join(side("b"), F.col("b") == F.col("rep_b"))

    def batch(b: pa.RecordBatch) -> dict:
        ok = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            common = int((x[at] == y).sum())
            ok.append(100 * common >= percent * (len(x) + len(y) - common))
        return {n: b.column(i).filter(pa.array(ok, pa.bool_())) for i, n in enumerate(("a", "b"))}

    return map_rows(joined, ["a", "b", "items_a", "items_b"], "a long, b long", batch)


def _dealt(members: DataFrame) -> DataFrame:
    """members once for each group i, j of their bucket that needs them: as strays, members outside the bucket's largest
    component, in block i of the strays, and as others in block j of all. So a bucket's rows are its members times the
    blocks of its strays, and its strays times its blocks."""
    spot = lambda n: F.pmod(F.xxhash64("rep"), F.ceil(F.col(n) / F.lit(BLOCK))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / F.lit(BLOCK)) - 1).cast("int")))
    stray = F.col("comp") != F.col("main")
    marked = members.withColumn("stray", stray)
    others = marked.withColumn("first", F.lit(False)).withColumn("j", spot("size")).withColumn("i", every("strays"))
    strays = marked.where("stray").withColumn("first", F.lit(True)).withColumn("i", spot("strays")).withColumn("j", every("size"))
    return others.unionByName(strays).drop("size", "strays", "main")


def _across(members: DataFrame, threshold: float) -> DataFrame:
    """Plausible pairs a, b of members(band, bucket, lead, size, strays, main, rep, comp, n, k, sketch, bands) in one bucket
    but different components, each in the first band that the two share, without pairs that hold the lead."""
    names = ["band", "bucket", "i", "j", "first", "stray", "lead", "rep", "comp", "n", "k"]

    def compare(v: dict[str, np.ndarray], band: int, sketch: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Pairs of a group's strays and others (at: their places). Of two strays the smaller stands first."""
        first, second = at[v["first"][at]], at[~v["first"][at]]
        found = []
        for part in range(0, len(first), 128):
            x = first[part : part + 128]
            near = v["comp"][x][:, None] != v["comp"][second][None, :]
            near &= ~v["stray"][second][None, :] | (v["rep"][x][:, None] < v["rep"][second][None, :])
            for k in range(band):
                near &= v["bands"][x, k][:, None] != v["bands"][second, k][None, :]
            p, q = np.nonzero(near)
            for some in range(0, len(p), 65536):
                a, b = x[p[some : some + 65536]], second[q[some : some + 65536]]
                ok = may_link(v["n"][a], v["n"][b], v["k"][a], v["k"][b], sketch[a], sketch[b], threshold)
                if ok.any():
                    found.append(np.column_stack([v["rep"][a[ok]], v["rep"][b[ok]]]))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; the last group of a batch waits for the next batch."""
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                keys = [batch.column(c).to_numpy() for c in range(4)]
                if all((x[0] == x[-1]) for x in keys) and all(h.column(c)[0] == batch.column(c)[0] for h in held[:1] for c in range(4)):
                    continue
            if not held:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            v = {n: np.asarray(t[n].to_numpy()) for n in names}
            new = np.append(True, np.any([v[c][1:] != v[c][:-1] for c in names[:4]], axis=0))
            starts = np.append(np.flatnonzero(new), len(new))
            last = len(starts) - 1 if batch is None else len(starts) - 2
            held = t.slice(starts[last]).to_batches()
            bands_of = t["bands"].combine_chunks()
            v["bands"] = bands_of.flatten().to_numpy().reshape(len(new), -1)
            sketch, out = _words64(t["sketch"].to_pylist()), []
            for k in range(last):
                at = np.arange(starts[k], starts[k + 1])
                at = at[v["rep"][at] != v["lead"][at]]
                if len(at) > 1:
                    out.append(compare(v, int(v["band"][at[0]]), sketch, at))
            both = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both.min(axis=1)), pa.array(both.max(axis=1))], names=["a", "b"])

    dealt = _dealt(members).select(*names, "bands", "sketch").repartition("band", "bucket", "i", "j").sortWithinPartitions("band", "bucket", "i", "j", "rep")
    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, comp: the least node that edges a, b connect each of their nodes with.

    Large and small stars in turn: each node hands its larger, then its other neighbours to the least one.
    Each round is written to the shared folder; a round that changes nothing ends it. Rounds grow with the logarithm
    of the nodes, so a hundred without an end are an error.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/edges-0")
    before = None
    for i in range(1, 100):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        low = low.withColumnRenamed("u", "node")
        small = large.join(low, F.col("u") == F.col("node"))
        small = small.select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct()
        now = staged(small, f"{folder}/edges-{i}")
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("the components have not settled")
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def link(df: DataFrame, percent: int = 85, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row.

    Words are runs without ASCII white space, A-Z in lower case; a set holds the distinct shingles of `width`
    words, of a shorter text its words as one; long texts are taken whole. Ids are taken to be unique: of several
    texts under one id the first in byte order of its set stands for it in comparisons, and all rows of an id are
    kept or not by the class of their own text. Texts link if 100 * intersection >= percent * union. A null, empty
    or blank text has an empty set, links with nothing and is kept. Rows with equal texts link, also with the
    same id; a null id gives a null component unless a link gives another, and is then not kept. Other columns
    are left out.
    """
    spark, threshold = df.sparkSession, percent / 100
    folder = shared_folder(spark, "neardup")
    rows = staged(sketches(df, width, threshold, id_col, text_col), f"{folder}/sketches")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    firsts = full.groupBy("s1", "s2").agg(F.min_by(F.struct("n_shingles", "bands", "k", "sketch"), "doc_id").alias("x"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = staged(firsts.select("rep", "s1", "s2", "copies", F.col("x.n_shingles").alias("n"), "x.bands", "x.k", "x.sketch"), f"{folder}/classes")

    spread = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    leads = spread.groupBy("band", "bucket").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    multi = staged(spread.join(leads, ["band", "bucket"]), f"{folder}/buckets")
    info = classes.select("rep", "n", "k", "sketch")
    pairs = multi.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = staged(_plausible(pairs, info, threshold), f"{folder}/pairs")

    ids = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = multi.select(F.col("rep").alias("wanted")).distinct()
    texts_of = ids.join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")

    def items(b: pa.RecordBatch) -> dict:
        found = [shingles(t, width) for t in texts(b.column(1))]
        return {"rep": b.column(0), "n": pa.array(map(len, found), pa.int64()), "items": pa.array([x.tobytes() for x in found], pa.binary())}

    sets = map_rows(texts_of, ["doc_id", "text"], "rep long, n long, items binary", items)
    sets = staged(sets.where("n > 0").groupBy("rep").agg(F.min("items").alias("items")), f"{folder}/sets")
    links = staged(_confirmed(pairs, sets, percent), f"{folder}/links")

    comp = components(links, f"{folder}/first")
    members = multi.join(comp, F.col("rep") == F.col("node"), "left").select("band", "bucket", "lead", "rep", F.coalesce("comp", "rep").alias("comp"))
    kinds = members.groupBy("band", "bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = kinds.groupBy("band", "bucket").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed = staged(mixed.select("band", "bucket", "size", (F.col("size") - F.col("top.c")).alias("strays"), F.col("top.comp").alias("main")), f"{folder}/mixed")
    members = join_few(members, mixed, ["band", "bucket"]).join(classes.select("rep", "n", "k", "sketch", "bands"), "rep")
    more = staged(_across(members, threshold), f"{folder}/across")
    links = links.unionByName(staged(_confirmed(more, sets, percent), f"{folder}/more"))

    comp = staged(components(links, f"{folder}/second"), f"{folder}/components")
    known = classes.join(comp, F.col("rep") == F.col("node"), "left").select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "copies", "rep", F.coalesce("comp", "rep").alias("component"))
    known = staged(known.where("copies > 1 or component <> rep").drop("rep"), f"{folder}/known")  # other rows are their own
    least = max(HOT, rows.count() // HOT_PART)
    hot = F.broadcast(known.where(F.col("copies") >= least).drop("copies"))
    cold = known.where(F.col("copies") < least).drop("copies")
    same = (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2"))
    some, none = rows.where("s1 is not null").select("doc_id", "n_shingles", "s1", "s2"), F.lit(None).cast("long").alias("component")
    out = some.join(hot, same).select("doc_id", "n_shingles", "component")
    out = out.unionByName(some.join(hot, same, "left_anti").join(cold, same, "left").select("doc_id", "n_shingles", "component"))
    out = out.unionByName(rows.where("s1 is null").select("doc_id", "n_shingles", none))
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
