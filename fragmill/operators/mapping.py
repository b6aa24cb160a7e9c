"""Reads to a genome: seeds, candidates, pairs of drafts, best and second best."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmill.functions import kernels
from fragmill.plans.lineage import mounted_folder


def minimizers(seqs: DataFrame, k: int = 17, w: int = 7, id_col: str = "read_id", seq: str = "seq") -> DataFrame:
    """id, hash, pos (of the k-mer's last base), strand of each sequence's minimizers."""

    def frame(ids: list[int], pieces: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        key, place, strand = (np.concatenate(x) for x in zip(*pieces, strict=True))
        return pd.DataFrame({"id": np.repeat(ids, [len(p[0]) for p in pieces]), "hash": key.astype(np.int64), "pos": place, "strand": strand})

    def run(batches):
        for pdf in batches:
            ids, pieces, n = [], [], 0
            for i, s in zip(pdf["id"], pdf["seq"], strict=True):
                for piece in kernels.minimizer_pieces(s or "", k, w):
                    ids.append(i)
                    pieces.append(piece)
                    n += len(piece[0])
                    if n >= kernels.PIECE // 4:
                        yield frame(ids, pieces)
                        ids, pieces, n = [], [], 0
            if pieces:
                yield frame(ids, pieces)

    return seqs.select(F.col(id_col).alias("id"), F.col(seq).alias("seq")).mapInPandas(run, "id long, hash long, pos int, strand int")


def kmer_counts(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """key, n: of each packed k-mer of upper-case bases its windows in all sequences. A task counts its own rows
    before anything is shuffled, so no row for each window is made."""

    def run(batches):
        texts = (s for b in batches for s in b.column(0).to_pylist())
        for key, n in kernels.kmer_counts(texts, k):
            for at in range(0, len(key), kernels.PIECE):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + kernels.PIECE].astype(np.int64)) for x in (key, n)], ["key", "n"])

    return seqs.select(F.col(seq)).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def build_index(ref: DataFrame, k: int = 17, w: int = 7) -> DataFrame:
    """hash, rid, pos, strand, n_occ of ref(rid, seq). Written sorted by hash it is the index."""
    m = minimizers(ref, k, w, "rid").withColumnRenamed("id", "rid")
    n = m.groupBy("hash").agg(F.count(F.lit(1)).alias("n_occ"))
    return m.join(n, "hash").select("hash", "rid", "pos", "strand", "n_occ")


def index_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_hashes"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("n_single"), F.sum("n").alias("n_occurrences"), F.max("n").alias("most"))


def seed_hits(mins: DataFrame, index: DataFrame, k: int = 17, most: int = 500) -> DataFrame:
    """id, same (strands agree), rid, at (where the read would start): minimizers by hash in the index, frequent
    seeds left out before the join. Starts before 0 go."""
    ref = index.where(F.col("n_occ") < most).select("hash", "rid", F.col("pos").alias("ref_pos"), F.col("strand").alias("ref_strand"))
    hits = mins.join(ref, "hash").withColumn("same", (F.col("strand") == F.col("ref_strand")).cast("int"))
    at = F.when(F.col("same") == 1, F.col("ref_pos") - F.col("pos")).otherwise(F.col("ref_pos") + F.col("pos") - k + 1)
    return hits.select("id", "same", "rid", at.alias("at")).where("at >= 0")


def two_rounds(mins: DataFrame, index: DataFrame, k: int = 17, first: int = 500, second: int = 1000) -> DataFrame:
    """seed_hits, with the higher limit for reads that have none below the lower one."""
    low = seed_hits(mins, index, k, first)
    without = mins.join(low.select("id").distinct(), "id", "left_anti")
    return low.unionByName(seed_hits(without, index, k, second))


#: Shares that self_hits() deals hashes into, by their low bits.
PARTS = 1 << 10
#: Minimizers that are packed at a time, so few that Arrow's batches of 10,000 rows stay small.
_PACK = kernels.PIECE // 2
_PACKED = "part int, base long, n int, hash binary, ids binary, places binary, often binary"


def _found(batches, k: int, w: int, clean: Callable | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, hashes, places, strands) of the minimizers of many sequences at a time, or of a piece of a long one, whose pieces
    follow each other."""
    ids, seqs, n = [], [], 0

    def many() -> tuple[np.ndarray, ...]:
        of, *rest = kernels.minimizers_of(seqs, k, w)
        return np.array(ids, np.int64)[of], *rest

    for b in batches:
        for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            s = clean(s) if clean and s else s
            if len(s or "") > kernels.BATCH:
                yield from ((np.full(len(p[0]), i, np.int64), *p) for p in kernels.minimizer_pieces(s, k, w))
            elif s:
                ids.append(i)
                seqs.append(s)
                n += len(s)
            if n >= kernels.BATCH:
                yield many()
                ids, seqs, n = [], [], 0
    yield many()


def _packed(seqs: DataFrame, k: int, w: int, second: int, clean: Callable | None) -> DataFrame:
    """The minimizers of seqs(id, seq), each seq through clean, as a row for each share and _PACK of them: numbers by byte planes, ids from a
    base on, places with the strand as their last bit. Seeds that a pack alone holds `second` times go as `often`,
    without their places: they are too frequent whatever the other packs hold."""

    def frame(pieces: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, key, place, strand = (np.concatenate(x) for x in zip(*pieces, strict=True))
        place = place * 2 + strand
        often = kernels.frequent(key, second)
        if len(often):
            rare = ~np.isin(key, often)
            key, ids, place = key[rare], ids[rare], place[rare]
        share = np.uint64(PARTS - 1)
        part = (key & share).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        base = int(ids.min(initial=np.iinfo(np.int64).max))
        cols = [kernels.planes(x[order]) for x in (key // np.uint64(PARTS), (ids - base).view(np.uint64), place.astype(np.uint64))]
        ends = np.cumsum(np.bincount(part, minlength=PARTS)).tolist()
        common = [often[often & share == np.uint64(p)].astype("<u8").tobytes() for p in range(PARTS)] if len(often) else [b""] * PARTS
        rows = [(p, stop - start, start, stop) for p, (start, stop) in enumerate(zip([0, *ends], ends)) if stop > start or common[p]]
        parts, n = [r[0] for r in rows], [r[1] for r in rows]
        packs = [[c[start:stop].T.tobytes() for _, _, start, stop in rows] for c in cols]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([base] * len(rows), pa.int64()), pa.array(n, pa.int32()), *(pa.array(x, pa.binary()) for x in packs), pa.array([common[p] for p in parts], pa.binary())], ["part", "base", "n", "hash", "ids", "places", "often"])

    def run(batches):
        pieces, n = [], 0
        for piece in _found(batches, k, w, clean):
            pieces.append(piece)
            n += len(piece[0])
            if n >= _PACK:
                yield frame(pieces)
                pieces, n = [], 0
        if n:
            yield frame(pieces)

    return seqs.mapInArrow(run, _PACKED)


def _shares(batches, least: int):
    """(hashes, n of each, n in all, ids, places, ids of the rest, `often`) of each share, sorted by hash. batches: _packed() rows
    sorted by share, each share whole. Of seeds whose low bits are found fewer than `least` times, which spares sorting
    them, only the ids come, as the rest. The n in all is 2^31 where a pack had the seed too often."""

    def share(part: int, rows: list[tuple]):
        base, n, *packs, often = zip(*rows, strict=True)
        key, ids, places = (kernels.from_planes(x, n) for x in packs)
        ids = ids.view(np.int64) + np.repeat(np.array(base, np.int64), n)
        often = np.frombuffer(b"".join(often), "<u8")
        rest = ids[:0]
        if least > 1:
            low = lambda x: (x & np.uint64((1 << 18) - 1)).astype(np.int64)
            many = np.bincount(low(key), minlength=1 << 18) >= least
            many[low(often // np.uint64(PARTS))] = True
            mine = many[low(key)]
            rest, key, ids, places = ids[~mine], key[mine], ids[mine], places[mine]
        key = key * np.uint64(PARTS) + np.uint64(part)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        n = np.diff(np.append(first, len(key)))
        n_occ = np.where(np.isin(key[first], often), 1 << 31, n) if len(often) else n
        return key[first].astype(np.int64), n, n_occ, ids[order], places[order].astype(np.int64), rest, np.unique(often).astype(np.int64)

    part, rows = None, []
    for b in batches:
        for p, *r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p != part and rows:
                yield share(part, rows)
                rows = []
            part = p
            rows.append(r)
    if rows:
        yield share(part, rows)


def _seeds(dealt: DataFrame, least: int, below: int) -> DataFrame:
    """hash, ids, places of the seeds that are found `least` times to fewer than `below`: a row for each."""

    def run(batches):
        for key, n, n_occ, ids, places, *_ in _shares(batches, least):
            keep = (n_occ >= least) & (n_occ < below)
            mine = np.repeat(keep, n)
            key, n, ids, places = key[keep], n[keep], ids[mine], places[mine]
            ends = np.append(0, np.cumsum(n))
            at = 0
            while at < len(key):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + kernels.PIECE // 16, "right")) - 1)
                offsets = pa.array((ends[at : to + 1] - ends[at]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[ends[at] : ends[to]])) for x in (ids, places)]
                yield pa.RecordBatch.from_arrays([pa.array(key[at:to]), *lists], ["hash", "ids", "places"])
                at = to

    return dealt.mapInArrow(run, "hash long, ids array<long>, places array<long>")


def _asked(dealt: DataFrame, first: int, second: int, tasks: int) -> DataFrame:
    """id, hash: of the ids without a seed found fewer than `first` times, their seeds found fewer than `second`.

    A task tells the ids that have such a seed there, with -1, and of others the seeds that may be asked for.
    """
    batch = lambda of, key: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (of, key)], ["id", "hash"])

    def tell(batches):
        known, keys, ids = np.zeros(0, np.int64), [], []
        for key, n, n_occ, of, _, rest, _ in _shares(batches, first):
            known = pd.unique(np.concatenate([known, rest, of[np.repeat(n_occ < first, n)]]))
            some = np.repeat((n_occ >= first) & (n_occ < second), n)
            keys.append(np.repeat(key, n)[some])
            ids.append(of[some])
        if keys:
            key, of = np.concatenate(keys), np.concatenate(ids)
            new = ~np.isin(of, known)
            yield batch(known, np.full(len(known), -1))
            yield batch(of[new], key[new])

    def ask(batches):
        rows = [[b.column(c).to_numpy() for c in ("id", "hash")] for b in batches if b.num_rows]
        if rows:
            of, key = (np.concatenate(x) for x in zip(*rows, strict=True))
            new = (key >= 0) & ~np.isin(of, of[key < 0])
            yield batch(of[new], key[new])

    return dealt.mapInArrow(tell, "id long, hash long").repartition(tasks, "id").mapInArrow(ask, "id long, hash long")


def self_hits(seqs: DataFrame, k: int = 17, w: int = 7, id_col: str = "rid", seq: str = "seq", first: int = 500, second: int = 1000, clean: Callable | None = None) -> DataFrame:
    """two_rounds() of sequences against an index of the same ones. clean: makes a sequence of what seq holds, in the
    Python worker that takes its minimizers.

    Their minimizers are dealt out once, packed, and a seed's places meet in the task that has them: no join. A
    sequence hits itself by each of its seeds, so those without a hit below `first` have no seed below it.
    """
    tasks = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = _packed(seqs.select(F.col(id_col).alias("id"), F.col(seq).alias("seq")), k, w, second, clean)
    dealt = packed.repartition(tasks, "part").sortWithinPartitions("part")

    def pairs(seeds: DataFrame) -> DataFrame:
        mine = seeds.select("*", F.posexplode("ids").alias("_i", "id"))
        if "asked" in seeds.columns:
            mine = mine.where(F.array_contains("asked", F.col("id")))
        mine = mine.select("id", F.col("places")[F.col("_i")].alias("place"), "ids", "places")
        both = mine.select("id", "place", "places", F.posexplode("ids").alias("_j", "rid"))
        both = both.select("id", "rid", "place", F.col("places")[F.col("_j")].alias("ref"))
        pos, ref = (F.shiftright(c, 1).cast("int") for c in ("place", "ref"))
        same = F.col("place").bitwiseAND(1) == F.col("ref").bitwiseAND(1)
        at = F.when(same, ref - pos).otherwise(ref + pos - k + 1)
        return both.select("id", same.cast("int").alias("same"), "rid", at.alias("at")).where("at >= 0")

    asked = _asked(dealt, first, second, tasks).groupBy("hash").agg(F.collect_set("id").alias("asked"))
    return pairs(_seeds(dealt, 1, first)).unionByName(pairs(_seeds(dealt, first, second).join(asked, "hash")))


def repetitive_length(mins: DataFrame, index: DataFrame, k: int = 17, w: int = 7, least: int = 500) -> DataFrame:
    """id, rep_len, rep_seeds: bases that frequent seeds cover, near ones counted by their distance."""
    often = index.where(F.col("n_occ") >= least).select("hash").distinct()
    order = Window.partitionBy("id").orderBy("pos")
    before = F.lag("pos").over(order)
    add = F.when(before.isNotNull() & (F.col("pos") < before + k + w - 1), F.col("pos") - before).otherwise(F.lit(k))
    return mins.join(often, "hash", "left_semi").withColumn("add", add).groupBy("id").agg(F.sum("add").alias("rep_len"), F.count(F.lit(1)).alias("rep_seeds"))


def candidates(hits: DataFrame, n_minimizers: DataFrame, errors: int = 8, least: int = 2) -> DataFrame:
    """id, same, rid, at, count: clusters of hits of a read, see kernels.cluster_hits. A read's hits are bounded
    by its minimizers and the seeds' limit, so a group fits a task."""
    rows = hits.join(n_minimizers.select("id", F.col("n").alias("n_min")), "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same, rid, at = (pdf[c].to_numpy() for c in ("same", "rid", "at"))
        order = np.lexsort((at, rid, same))
        same, rid, at = same[order], rid[order], at[order]
        group = np.cumsum(np.append(False, (same[1:] != same[:-1]) | (rid[1:] != rid[:-1])))
        g, place, count = kernels.cluster_groups(group, at, int(pdf["n_min"].iloc[0]), errors, least)
        heads = np.searchsorted(group, g)
        return pd.DataFrame({"id": pdf["id"].iloc[0], "same": same[heads], "rid": rid[heads], "at": place, "count": count})

    return rows.groupBy("id").applyInPandas(run, "id long, same int, rid long, at long, count int")


#: Files of an index, each of neighbouring shares; minimizers that are looked up, and hits that are clustered, at a time.
FILES, LOOK, HITS = 1 << 8, 1 << 20, 1 << 22


@dataclass(frozen=True)
class _Index:
    """Seeds found twice or more, in files: sorted seeds, where each one's places start, and the places as numbers of `width` bytes,
    an id from a base on before a place with its strand. Seeds found `second` times or more have no places there."""

    folder: str
    k: int
    base: int
    id_bits: int
    place_bits: int

    @property
    def width(self) -> int:
        return (self.id_bits + self.place_bits + 7) // 8

    @property
    def low_bits(self) -> int:
        """Bits of a seed within its file."""
        return max(2 * self.k - (PARTS - 1).bit_length(), 0) + (PARTS // FILES - 1).bit_length()

    def turned(self, key: np.ndarray) -> np.ndarray:
        """Hashes with the bits of their share first: file, then seed within it."""
        share = (PARTS - 1).bit_length()
        return (key & (PARTS - 1)) << max(2 * self.k - share, 0) | key >> share

    @property
    def types(self) -> tuple[str, str, str]:
        return "<u4" if self.low_bits <= 32 else "<u8", "<u4", f"V{self.width}"

    def path(self, file: int, what: int) -> str:
        return f"{self.folder}/{file}.{what}"

    def write(self, batches, second: int) -> Iterator[pa.RecordBatch]:
        """Writes the files of shares that come in order; each whole or not at all, and the same however often it is written."""
        file, open_, names, total = None, [], [], 0

        def close() -> None:
            if open_:
                open_[1].write(np.array([total], "<u4").tobytes())
            for f, name in zip(open_, names, strict=True):
                f.close()
                os.replace(name, name.rsplit(".", 2)[0])

        for key, n, n_occ, ids, places, _, often in _shares(batches, 1):
            keep = (n_occ > 1) & (n_occ < second)
            mine = np.repeat(keep, n)
            common = np.union1d(key[n_occ >= second], often)
            seeds = self.turned(np.append(key[keep], common))
            if not len(seeds):
                continue
            if seeds[0] >> self.low_bits != file:
                close()
                file, total = int(seeds[0] >> self.low_bits), 0
                names = [f"{self.path(file, i)}.{os.getpid()}.{os.urandom(4).hex()}" for i in range(3)]
                open_ = [open(name, "wb") for name in names]
            order = np.argsort(seeds, kind="stable")
            size = np.append(n[keep], np.zeros(len(common), np.int64))[order]
            ends = total + np.cumsum(size)
            if ends[-1] >= 1 << 32:
                raise OverflowError("a file of the index holds fewer than 2^32 places")
            number = ((ids[mine] - self.base) << self.place_bits | places[mine]).astype("<u8")
            open_[0].write((seeds[order] & ((1 << self.low_bits) - 1)).astype(self.types[0]).tobytes())
            open_[1].write((ends - size).astype("<u4").tobytes())
            open_[2].write(number.view(np.uint8).reshape(-1, 8)[:, : self.width].tobytes())
            total = int(ends[-1])
        close()
        yield from ()

    def files(self, file: int) -> list[np.ndarray] | None:
        return _mapped(self, file)

    def numbers(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 8), np.uint8)
        out[:, : self.width] = rows.view(np.uint8).reshape(-1, self.width)
        return out.view("<i8").ravel()


@lru_cache(4 * FILES)
def _mapped(index: _Index, file: int) -> list[np.ndarray] | None:
    paths = [index.path(file, i) for i in range(3)]
    if not os.path.exists(paths[2]):
        return None
    return [np.asarray(np.memmap(p, t, "r")) if os.path.getsize(p) else np.zeros(0, t) for p, t in zip(paths, index.types, strict=True)]


def _clusters(index: _Index, found: tuple[np.ndarray, ...], errors: int, least: int, first: int, second: int, at_once: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, same, rid, at, count) of the clusters of whole sequences, whose minimizers are in `found`; some at a time."""
    ids, key, pos, strand = found
    heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    n_min = np.diff(np.append(heads, len(ids)))
    read = np.repeat(np.arange(len(heads)), n_min)
    seeds = index.turned(key.astype(np.int64))
    order = np.argsort(seeds)
    seeds, read, pos, strand = seeds[order], read[order], pos[order], strand[order]
    start, n = np.full(len(seeds), -1), np.ones(len(seeds), np.int64)  # a seed that the index lacks is found once, here
    cuts = np.searchsorted(seeds, np.arange(FILES + 1) << index.low_bits)
    for f in range(FILES):
        some = slice(cuts[f], cuts[f + 1])
        here = index.files(f) if cuts[f + 1] > cuts[f] else None
        if here is not None:
            mine = (seeds[some] & ((1 << index.low_bits) - 1)).astype(index.types[0])
            at = np.minimum(np.searchsorted(here[0], mine), len(here[0]) - 1)
            known = here[0][at] == mine
            begin, end = here[1][at].astype(np.int64), here[1][at + 1].astype(np.int64)
            start[some] = np.where(known, begin, -1)
            n[some] = np.where(known, end - begin, 1)
    low = (n > 0) & (n < first)
    more = np.bincount(read[low], minlength=len(heads)) == 0
    n[~(low | (more[read] & (n < second)))] = 0

    at_bits = index.place_bits
    same_bit = index.id_bits + at_bits
    most = 1 << max(62 - same_bit, 0)  # sequences that the numbers of a chunk have room for
    hits = np.append(0, np.cumsum(np.bincount(read, n, len(heads)).astype(np.int64)))
    a = 0
    while a < len(heads):
        b = min(max(a + 1, int(np.searchsorted(hits, hits[a] + at_once, "right")) - 1), a + most)
        number, used = np.empty(hits[b] - hits[a], np.int64), 0
        mine = (read >= a) & (read < b) & (n > 0)
        alone = read[mine & (start < 0)]
        number[: len(alone)] = ((alone - a) << (same_bit + 1)) | 1 << same_bit | (ids[heads[alone]] - index.base) << at_bits
        used = len(alone)
        some = np.flatnonzero(mine & (start >= 0))
        ends = np.searchsorted(some, cuts)
        for f in range(FILES):
            q = some[ends[f] : ends[f + 1]]
            if not len(q):
                continue
            size = n[q]
            stop = np.cumsum(size)
            ref = index.numbers(index.files(f)[2][np.repeat(start[q] - stop + size, size) + np.arange(stop[-1])])
            place = ref & ((1 << index.place_bits) - 1)
            same = (place & 1) == np.repeat(strand[q], size)
            place >>= 1
            mine_at = np.repeat(pos[q], size)
            at = place + np.where(same, -mine_at, mine_at - index.k + 1)
            ref >>= index.place_bits
            ref <<= at_bits
            ref |= at
            ref |= np.repeat((read[q] - a) << (same_bit + 1), size)
            ref |= same.astype(np.int64) << same_bit
            ref = ref[at >= 0]
            number[used : used + len(ref)] = ref
            used += len(ref)
        number = number[:used]
        number.sort()
        # places of two groups lie further apart than `errors`, as at_bits leave room for it
        begin = np.flatnonzero(np.append(True, np.diff(number) > errors)[:used])
        size = np.diff(np.append(begin, used))
        number = number[np.repeat(size >= least, size)]
        group, at = number >> at_bits, number & ((1 << at_bits) - 1)
        of = group >> (index.id_bits + 1)
        group, at, count = kernels.cluster_groups(group, at, n_min[of + a], errors, least)
        of = group >> (index.id_bits + 1)
        yield ids[heads[of + a]], group >> index.id_bits & 1, (group & ((1 << index.id_bits) - 1)) + index.base, at, count
        a = b


def self_candidates(seqs: DataFrame, k: int = 17, w: int = 7, id_col: str = "rid", seq: str = "seq", errors: int = 8, least: int = 2, first: int = 500, second: int = 1000, clean: Callable | None = None, look: int = LOOK, hits: int = HITS) -> DataFrame:
    """candidates() of self_hits(), without a row for each hit.

    Seeds found twice or more go to files in the shared folder, which must be mounted. A worker maps them, looks up all
    minimizers of a sequence, and clusters its hits where they are found: no hit is dealt out. Ids that are found twice, or
    so far apart that an id and a place need more than 60 bits, take the way of self_hits(). clean makes no text longer.
    look, hits: minimizers that are looked up, and hits that are clustered, at a time; a sequence's stay together.
    """
    spark = seqs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seqs = seqs.select(F.col(id_col).cast("long").alias("id"), F.col(seq).alias("seq"))
    rows, ids, low, high, longest = seqs.agg(F.count(F.lit(1)), F.count_distinct("id"), F.min("id"), F.max("id"), F.max(F.octet_length("seq"))).first()
    id_bits = max(((high or 0) - (low or 0)).bit_length(), 1)
    place_bits = (2 * (longest or 0) + errors + 1).bit_length()
    if rows > ids or id_bits + place_bits > 60:
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array(p[0], pa.int64())], ["id"]) for p in _found(batches, k, w, clean))
        n = seqs.mapInArrow(sizes, "id long").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        return candidates(self_hits(seqs, k, w, "id", "seq", first, second, clean), n, errors, least)
    index = _Index(mounted_folder(spark, "seeds"), k, low or 0, id_bits, place_bits)
    os.makedirs(index.folder, exist_ok=True)
    shares = F.shiftright("part", (PARTS // FILES - 1).bit_length())
    dealt = _packed(seqs, k, w, second, clean).repartition(tasks, shares).sortWithinPartitions("part")
    dealt.mapInArrow(lambda batches: index.write(batches, second), "file int").count()
    names = ["id", "same", "rid", "at", "count"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches):
        def some(pieces):
            for out in _clusters(index, tuple(np.concatenate(x) for x in zip(*pieces, strict=True)), errors, least, first, second, hits):
                for at in range(0, len(out[0]), kernels.PIECE // 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + kernels.PIECE // 16], t) for x, t in zip(out, types, strict=True)], names)

        pieces, n = [], 0
        for piece in _found(batches, k, w, clean):
            if not len(piece[0]):
                continue
            if n >= look and piece[0][0] != pieces[-1][0][-1]:
                yield from some(pieces)
                pieces, n = [], 0
            pieces.append(piece)
            n += len(piece[0])
        if n:
            yield from some(pieces)

    return seqs.mapInArrow(run, "id long, same int, rid long, at long, count int")


def in_order(cands: DataFrame) -> DataFrame:
    """Adds nth to candidates (id, same, rid, at, count) of each read: most support first, then by place."""
    w = Window.partitionBy("id").orderBy(F.desc("count"), "rid", "at", "same")
    return cands.withColumn("nth", F.row_number().over(w))


def merge_candidates(a: DataFrame, b: DataFrame, errors: int = 8) -> DataFrame:
    """Two lists of candidates (id, same, rid, at, count) as one: from the smallest place on, each that lies more than
    `errors` beyond the last one kept. Of two at a place the larger count stays. A read's candidates are few, so they
    meet in an array; nothing leaves the JVM."""
    both = a.unionByName(b).groupBy("id", "same", "rid", "at").agg(F.max("count").alias("count"))
    lists = both.groupBy("id", "same", "rid").agg(F.array_sort(F.collect_list(F.struct("at", "count"))).alias("c"))
    none = F.array().cast("array<struct<at:bigint,count:int>>")
    apart = lambda kept, x: F.when((F.size(kept) == 0) | (x["at"] > F.element_at(kept, -1)["at"] + errors), F.concat(kept, F.array(x))).otherwise(kept)
    lists = lists.withColumn("c", F.col("c").cast("array<struct<at:bigint,count:int>>"))
    return lists.select("id", "same", "rid", F.inline(F.aggregate("c", none, apart)))


def rescue_ranges(best: DataFrame, reach: int = 2000) -> DataFrame:
    """read_id, rid, start, stop: where a mate may lie, within reach of the other's best candidates, merged."""
    order = Window.partitionBy("read_id", "rid").orderBy("start", "stop")
    rows = best.select("read_id", "rid", F.greatest(F.col("at") - reach, F.lit(0)).alias("start"), (F.col("at") + reach + 1).alias("stop"))
    seen = rows.withColumn("upto", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    islands = seen.withColumn("island", F.sum((F.col("upto").isNull() | (F.col("start") > F.col("upto"))).cast("int")).over(order))
    return islands.groupBy("read_id", "rid", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def supplement(hits: DataFrame, ranges: DataFrame) -> DataFrame:
    """Hits of a mate (read_id, rid, at) inside its rescue ranges; ranges of a read are few and disjoint."""
    inside = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop"))
    return hits.join(ranges, ["read_id", "rid"]).where(inside).select(*hits.columns)


def reduce_candidates(c1: DataFrame, c2: DataFrame, insert: int = 1000, strong: int = 6, spare: int = 5) -> tuple[DataFrame, DataFrame]:
    """Candidates (read_id, rid, at, count) with a mate's candidate within insert, and each read's `spare` best
    others with a count of `strong` or more."""

    def keep(mine: DataFrame, other: DataFrame) -> DataFrame:
        o = other.select("read_id", "rid", F.col("at").alias("mate_at"))
        near = mine.join(o, ["read_id", "rid"]).where(F.abs(F.col("at") - F.col("mate_at")) <= insert).select("read_id", "rid", "at").distinct().withColumn("near", F.lit(1))
        marked = mine.join(near, ["read_id", "rid", "at"], "left")
        w = Window.partitionBy("read_id", "near").orderBy(F.desc("count"), "rid", "at")
        ranked = marked.withColumn("r", F.row_number().over(w))
        return ranked.where((F.col("near") == 1) | ((F.col("count") >= strong) & (F.col("r") <= spare))).select(*mine.columns)

    return keep(c1, c2), keep(c2, c1)


def verify(cands: DataFrame, errors: int = 8) -> DataFrame:
    """Adds err and end to candidates with the read and the reference around them: seq, and pattern of
    length len(seq) + 2 * errors from at - errors. Rows above the errors go."""
    if not 0 < errors <= 15:
        raise ValueError("the band is a 32-bit word: errors must be 1 to 15")

    def run(batches):
        for pdf in batches:
            pdf["err"], pdf["end"] = kernels.banded_distances(pdf["pattern"].tolist(), pdf["seq"].tolist(), errors)
            yield pdf[pdf["err"] <= errors]

    schema = ", ".join(f"`{n}` {t}" for n, t in cands.dtypes) + ", err int, end int"
    return cands.mapInPandas(run, schema)


def pair_drafts(drafts: DataFrame, insert: int = 1000, read_len: int = 50, least: int = 30) -> DataFrame:
    """read_id, rid, forward_mate, pos1, pos2, err_sum of drafts of two mates on opposite strands within the
    insert: the plus mate may lie beyond the minus one by an overlap of at least `least` bases.

    drafts(read_id, mate, strand, rid, pos, err); strand 1 is plus. The band is a residual of an equi-join
    on the read and the reference, so it stays within a read.
    """
    plus = drafts.where("strand = 1").select("read_id", "rid", F.col("mate").alias("forward_mate"), F.col("pos").alias("pos1"), F.col("err").alias("err1"))
    minus = drafts.where("strand = 0").select("read_id", "rid", F.col("mate").alias("other_mate"), F.col("pos").alias("pos2"), F.col("err").alias("err2"))
    band = (F.col("pos1") <= F.col("pos2") + read_len - least) & (F.col("pos2") <= F.col("pos1") + insert - read_len)
    pairs = plus.join(minus, ["read_id", "rid"]).where((F.col("forward_mate") != F.col("other_mate")) & band)
    return pairs.select("read_id", "rid", "forward_mate", "pos1", "pos2", (F.col("err1") + F.col("err2")).alias("err_sum"))


def split_pairs(drafts: DataFrame) -> DataFrame:
    """read_id, rid1, pos1, rid2, pos2: every place with the least errors of mate 0 with every such place of mate 1,
    joined on the read."""
    low = drafts.withColumn("least", F.min("err").over(Window.partitionBy("read_id", "mate"))).where("err = least")
    side = lambda m: low.where(F.col("mate") == m - 1).select("read_id", F.col("rid").alias(f"rid{m}"), F.col("pos").alias(f"pos{m}"))
    return side(1).join(side(2), "read_id")


def best_and_second(rows: DataFrame, key: list[str], error: str, none: int) -> DataFrame:
    """key, best, n_best, second, n_second: the two least errors and their counts; second is `none` without one."""
    counts = rows.groupBy(*key, error).agg(F.count(F.lit(1)).alias("n"))
    two = counts.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(error))).where("r <= 2")
    pick = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    out = two.groupBy(*key).agg(pick(1, error).alias("best"), pick(1, "n").alias("n_best"), pick(2, error).alias("second"), pick(2, "n").alias("n_second"))
    return out.withColumns({"second": F.coalesce("second", F.lit(none)), "n_second": F.coalesce("n_second", F.lit(0))})


def pick_best(rows: DataFrame, key: list[str], error: str, tie: list[str], n: int = 1, seed: int = 11, most: int = 500_000) -> DataFrame:
    """n of the rows with the least error of each key, drawn by a hash (any partitioning gives the same); keys
    with more than `most` such rows go."""
    w = Window.partitionBy(*key)
    low = rows.withColumn("_low", F.min(error).over(w)).where(F.col(error) == F.col("_low")).drop("_low")
    order = Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed), *tie), *tie)
    ranked = low.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(order))
    return ranked.where((F.col("_n") <= most) & (F.col("_r") <= n)).drop("_n", "_r")


def fragment(start1: Column, end1: Column, start2: Column, end2: Column, plus_first: Column) -> dict[str, Column]:
    """start, len, pos_len, neg_len of a fragment from its mates' inclusive ends; plus_first: mate 1 is plus."""
    length = lambda a, b: b - a + 1
    return {
        "start": F.when(plus_first, start1).otherwise(start2),
        "len": F.when(plus_first, length(start1, end2)).otherwise(length(start2, end1)),
        "pos_len": F.when(plus_first, length(start1, end1)).otherwise(length(start2, end2)),
        "neg_len": F.when(plus_first, length(start2, end2)).otherwise(length(start1, end1)),
    }
