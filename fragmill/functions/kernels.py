"""Sequence kernels in numpy, for use inside Arrow functions. Those named in the plural take many reads at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Codes of bases; any other character is 4.
CODES = {"A": 0, "C": 1, "G": 2, "T": 3}
_CODE = np.full(256, 4, np.uint8)
for _c, _v in CODES.items():
    _CODE[[ord(_c), ord(_c.lower())]] = _v
_FLIP = str.maketrans("ACGTacgt", "TGCAtgca")


def revcomp(s: str) -> str:
    return s.translate(_FLIP)[::-1]


def hash64(x: np.ndarray, bits: int) -> np.ndarray:
    """An invertible mix of numbers of so many bits. The shifts are fixed values."""
    u, mask = np.uint64, np.uint64((1 << bits) - 1)
    t = x << u(21)
    x = ~x
    x += t
    x &= mask
    x ^= np.right_shift(x, u(24), out=t)
    np.left_shift(x, u(8), out=t)
    t += x
    x <<= u(3)
    x += t
    x &= mask
    x ^= np.right_shift(x, u(14), out=t)
    np.left_shift(x, u(4), out=t)
    t += x
    x <<= u(2)
    x += t
    x &= mask
    x ^= np.right_shift(x, u(28), out=t)
    x += np.left_shift(x, u(31), out=t)
    x &= mask
    return x


#: k-mers that minimizers() has in memory at a time.
PIECE = 1 << 20


def _packed(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed k-mers that end at each place from k - 1 on, forward and reverse-complemented."""
    u, n = np.uint64, len(codes) - k + 1
    known = np.minimum(codes, 3).astype(u)
    fwd, rev = np.zeros(n, u), np.zeros(n, u)
    for i in range(k):
        base = known[i : i + n]
        fwd = (fwd << u(2)) | base
        rev |= (u(3) - base) << u(2 * i)
    return fwd, rev


#: Longest k-mers that kmer_counts() counts in an array of all of them.
DENSE = 12
_UPPER = np.full(256, 4, np.uint8)
_UPPER[[ord(_c) for _c in CODES]] = list(CODES.values())


def kmer_counts(seqs: Iterable[str | None], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(packed k-mers, their counts) over all windows of k upper-case bases without others, the first base most
    significant. Short k-mers come once, longer ones once for each PIECE of bases, so that memory is bounded."""
    if not 0 < k <= 31:
        raise ValueError("a packed k-mer has 1 to 31 bases")
    dense = np.zeros(1 << 2 * k, np.int64) if k <= DENSE else None

    def packed(parts: list[str]) -> np.ndarray:
        codes = _UPPER[np.frombuffer("\n".join(parts).encode("latin-1", "replace"), np.uint8)]
        n = len(codes) - k + 1
        key, bases = np.zeros(n, np.int64), (codes & 3).astype(np.int64)
        for i in range(k):
            key <<= 2
            key |= bases[i : i + n]
        unknown = np.cumsum(np.append(0, codes > 3))
        return key[unknown[k:] == unknown[:-k]]

    def pieces() -> Iterator[np.ndarray]:
        parts, n = [], 0
        for s in seqs:
            for start in range(0, len(s or "") - k + 1, PIECE):
                parts.append(s[start : start + PIECE + k - 1])
                n += len(parts[-1])
                if n >= PIECE:
                    yield packed(parts)
                    parts, n = [], 0
        if parts:
            yield packed(parts)

    for key in pieces():
        if dense is None:
            yield np.unique(key, return_counts=True)
        else:
            dense += np.bincount(key, minlength=len(dense))
    if dense is not None:
        found = np.flatnonzero(dense)
        yield found, dense[found]


def planes(x: np.ndarray) -> np.ndarray:
    """A row of bytes for each unsigned number, least byte first, as wide as the largest needs."""
    x = np.ascontiguousarray(x, "<u8")
    return x.view(np.uint8).reshape(-1, 8)[:, : max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)]


def from_planes(packs: list[bytes], sizes: list[int]) -> np.ndarray:
    """The numbers of packs of so many each, whose planes() were written byte by byte: all least bytes, then all next."""
    out = np.zeros((sum(sizes), 8), np.uint8)
    wide = max((len(b) // n for b, n in zip(packs, sizes, strict=True) if n), default=0)
    for i in range(wide):
        plane = b"".join([b[i * n : i * n + n] or bytes(n) for b, n in zip(packs, sizes, strict=True)])
        out[:, i] = np.frombuffer(plane, np.uint8)
    return out.view("<u8").ravel()


def frequent(key: np.ndarray, least: int) -> np.ndarray:
    """The numbers that are found `least` times or more, sorted."""
    low = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
    found, n = np.unique(key[np.bincount(low, minlength=1 << 20)[low] >= least], return_counts=True)
    return found[n >= least]


def minimizer_pieces(seq: str, k: int, w: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, place of the k-mer's last base, strand) of the k-mers that are least in a window of w, piece by piece.

    Of equal ones all count. A window lies within known bases and holds w k-mers that differ from their reverse
    complement, which has no strand and takes no place; the sequence's last places give their least k-mer even
    if they don't fill a window. The last w k-mers of a piece go into the next one's windows.
    """
    none = np.uint64((1 << 64) - 1)
    key, place, strand, told = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    for start in range(0, len(seq) - k + 1, PIECE):
        codes = _CODE[np.frombuffer(seq[start : start + PIECE + k - 1].encode("latin-1", "replace"), np.uint8)]
        fwd, rev = _packed(codes, k)
        unknown = np.cumsum(np.append(0, codes > 3))
        known = unknown[k:] == unknown[:-k]
        keep = ~known | (fwd != rev)
        hf, hr = hash64(fwd[keep], 2 * k), hash64(rev[keep], 2 * k)
        key = np.append(key, np.where(known[keep], hash64(np.minimum(hf, hr), 2 * k), none))
        place = np.append(place, np.flatnonzero(keep) + start + k - 1)
        strand = np.append(strand, (hf >= hr).astype(np.int64))
        told = np.append(told, np.zeros(len(hf), bool))
        chosen = np.zeros(len(key), bool)
        if len(key) >= w:
            n = len(key) - w + 1
            least, most = key[:n].copy(), key[:n].copy()
            for i in range(1, w):
                least, most = np.minimum(least, key[i : i + n]), np.maximum(most, key[i : i + n])
            least[most == none] = none
            for i in range(w):
                chosen[i : i + n] |= (key[i : i + n] == least) & (least != none)
        new = chosen & ~told
        yield key[new], place[new], strand[new]
        told |= chosen
        key, place, strand, told = key[-w:], place[-w:], strand[-w:], told[-w:]
    if len(key) and key.min() != none:
        last = len(key) - 1 - int(np.argmin(key[::-1]))
        if not told[last]:
            yield key[last : last + 1], place[last : last + 1], strand[last : last + 1]


#: Bases that minimizers_of() gets at a time, so few that its vectors stay in a core's cache.
BATCH = 1 << 15


def _doubled(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """_packed() from k-mers of 1, 2, 4 and more bases, each joined from two shorter ones."""
    one = np.minimum(codes, 3).astype(np.uint64)
    base = one, np.uint64(3) - one
    (fwd, rev), m = base, 1

    def joined(last: tuple[np.ndarray, np.ndarray], more: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(fwd) - more
        return (fwd[:n] << np.uint64(2 * more)) | last[0][m : m + n], rev[:n] | (last[1][m : m + n] << np.uint64(2 * m))

    for bit in f"{k:b}"[1:]:
        fwd, rev = joined((fwd, rev), m)
        m *= 2
        if bit == "1":
            fwd, rev = joined(base, 1)
            m += 1
    return fwd, rev


def minimizers_of(seqs: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the sequence, hash, place, strand) of all of minimizer_pieces() of many sequences, laid end to end.

    What stands between two is no base, so no window reaches from one into the next.
    """
    none, bad = np.uint64((1 << 64) - 1), np.uint64((1 << 64) - 2)
    lengths = np.array([len(s) for s in seqs], np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    codes = _CODE[np.frombuffer("\n".join([*seqs, ""]).encode("latin-1", "replace"), np.uint8)]
    if len(codes) < k:
        return begin[:0], np.zeros(0, np.uint64), begin[:0], begin[:0]
    fwd, rev = _doubled(codes, k)
    unknown = np.cumsum(np.append(0, codes > 3))
    known = unknown[k:] == unknown[:-k]
    at = np.flatnonzero(~known | (fwd != rev))
    hf, hr = hash64(fwd[at], 2 * k), hash64(rev[at], 2 * k)
    key = np.where(known[at], hash64(np.minimum(hf, hr), 2 * k), none)
    chosen = np.zeros(len(key), bool)
    if len(key) >= w:
        n = len(key) - w + 1
        least, size = key, 1
        while size < w:
            step = min(size, w - size)
            least = np.minimum(least[: len(least) - step], least[step:])
            size += step
        unclear = np.cumsum(np.append(0, key == none))
        least = np.where(unclear[w:] == unclear[:-w], least, bad)
        for i in range(w):
            chosen[i : i + n] |= key[i : i + n] == least
    # a sequence's last w k-mers give their least one, of equal ones the last
    first, end = np.searchsorted(at, begin), np.searchsorted(at, begin + lengths - k + 1)
    first, end = first[end > first], end[end > first]
    low, where = np.full(len(end), none), np.zeros(len(end), np.int64)
    for i in range(1, w + 1):
        here = np.maximum(end - i, first)
        less = (end - i >= first) & (key[here] < low)
        low, where = np.where(less, key[here], low), np.where(less, here, where)
    chosen[where[low != none]] = True
    found = np.flatnonzero(chosen)
    of = np.searchsorted(begin, at[found], "right") - 1
    return of, key[found], at[found] - begin[of] + k - 1, (hf[found] >= hr[found]).astype(np.int64)


def minimizers(seq: str, k: int, w: int) -> list[tuple[int, int, int]]:
    """All of minimizer_pieces() in the order of their places."""
    pieces = list(minimizer_pieces(seq, k, w))
    if not pieces:
        return []
    key, place, strand = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.argsort(place)
    return list(zip(key[order].astype(np.int64).tolist(), place[order].tolist(), strand[order].tolist(), strict=True))


def cluster_hits(at: np.ndarray, n_minimizers: int, errors: int, least: int) -> list[tuple[int, int]]:
    """(place, support) of clusters of sorted hit places of one reference and strand.

    Gaps wider than `errors` part the hits. Within a part, a cluster's place is the first of those that most hits
    share so far; it closes before a hit more than `errors` beyond that place once it has as many hits as the read has
    minimizers. Clusters of fewer than `least` hits go.
    """
    out: list[tuple[int, int]] = []
    for part in np.split(at, np.flatnonzero(np.diff(at) > errors) + 1):
        while len(part):
            index = np.arange(len(part))
            firsts = np.append(True, part[1:] != part[:-1])
            run = index + 1 - np.maximum.accumulate(np.where(firsts, index, 0))
            highest = np.maximum.accumulate(run)
            leads = np.append(True, highest[1:] > highest[:-1])
            place = part[np.maximum.accumulate(np.where(leads, index, 0))]
            beyond = np.flatnonzero((index[1:] >= n_minimizers) & (part[1:] > place[:-1] + errors))
            n = int(beyond[0]) + 1 if len(beyond) else len(part)
            if n >= least:
                out.append((int(place[n - 1]), int(highest[n - 1])))
            part = part[n:]
    return out


def cluster_groups(group: np.ndarray, at: np.ndarray, n_minimizers: int | np.ndarray, errors: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, place, support) of cluster_hits() of many groups at once; rows are sorted by group and place. n_minimizers: of all,
    or of each row's read.

    A part without a gap that has at most n_minimizers hits never closes early: it is one cluster, at its first longest
    run of equal places. Parts of fewer than `least` hits go; longer ones are taken one by one.
    """
    if not len(at):
        return group, at, at
    new = np.append(True, (group[1:] != group[:-1]) | (np.diff(at) > errors))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    runs = np.flatnonzero(new | np.append(True, at[1:] != at[:-1]))
    length = np.diff(np.append(runs, len(at)))
    part = np.cumsum(new)[runs] - 1
    highest = np.maximum.reduceat(length, np.searchsorted(runs, first))
    top = np.flatnonzero(length == highest[part])
    place = at[runs[top[np.searchsorted(part[top], np.arange(len(first)))]]]
    n = np.broadcast_to(n_minimizers, len(at))[first]
    whole = (size >= least) & (size <= n)
    out = [(group[first[whole]], place[whole], highest[whole])]
    for p in np.flatnonzero((size >= least) & (size > n)):
        found = np.array(cluster_hits(at[first[p] : first[p] + size[p]], int(n[p]), errors, least), at.dtype).reshape(-1, 2)
        out.append((np.repeat(group[first[p]], len(found)), found[:, 0], found[:, 1]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def banded_distances(patterns: list[str], texts: list[str], errors: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, ends): least edits of each text against a stretch of its pattern that starts and stays within a band of
    2 * errors + 1 diagonals, and where it ends in the pattern; of equal ends the band's middle wins, then the first.

    All texts of one length move through their tables together. A row of a table is a vector over the diagonals: a
    base more in the pattern moves right along it, which a running minimum of cost minus place does at once. Where
    the first diagonal passes 3 * errors the text counts as errors + 1 edits.
    """
    width, far = 2 * errors + 1, 1 << 20
    steps = np.arange(width)
    edits, ends = np.full(len(texts), errors + 1), np.full(len(texts), -1)
    lengths = np.array([len(t) for t in texts], np.int64)
    for n in np.unique(lengths).tolist():
        some = np.flatnonzero(lengths == n)
        t = _coded([texts[i] for i in some], n)
        p = _coded([patterns[i][: n + 2 * errors] for i in some], n + 2 * errors)
        cost, gone = np.zeros((len(some), width), np.int64), np.zeros(len(some), bool)
        for i in range(n):
            less = np.column_stack([cost[:, 1:], np.full(len(some), far)]) + 1
            cost = np.minimum(cost + (p[:, i : i + width] != t[:, i : i + 1]), less)
            cost = np.minimum.accumulate(cost - steps, axis=1) + steps
            gone |= cost[:, 0] > 3 * errors
        best = cost.min(axis=1)
        end = np.where(cost[:, errors] == best, errors, cost.argmin(axis=1))
        edits[some] = np.where(gone, errors + 1, best)
        ends[some] = np.where(gone, -1, n - 1 + end)
    return edits, ends


def banded_distance(pattern: str, text: str, errors: int) -> tuple[int, int]:
    edits, ends = banded_distances([pattern], [text], errors)
    return int(edits[0]), int(ends[0])


def _coded(seqs: list[str], n: int) -> np.ndarray:
    return _CODE[np.frombuffer("".join(seqs).encode("latin-1", "replace"), np.uint8)].reshape(-1, n)


def align(pattern: str, text: str, match: int = 1, mismatch: int = 4, open_: int = 6, extend: int = 1) -> tuple[int, int, list[tuple[int, str]]]:
    """(score, start in pattern, CIGAR) of all of text against a free stretch of pattern, affine gaps.

    A row of the tables is a vector over the pattern. A gap along it starts at a cell that it didn't reach itself, so
    a running maximum finds the best start for every cell.
    """
    n, m, low = len(text), len(pattern), -(10**9)
    h = np.full((n + 1, m + 1), low, np.int64)
    e, f = h.copy(), h.copy()
    h[0] = 0
    letters, along = np.frombuffer(pattern.encode("latin-1", "replace"), np.uint8), extend * np.arange(m + 1)
    for i, c in enumerate(text.encode("latin-1", "replace"), 1):
        f[i] = np.maximum(f[i - 1], h[i - 1] - open_) - extend  # text base against nothing
        here = f[i].copy()
        here[1:] = np.maximum(here[1:], h[i - 1, :-1] + np.where(letters == c, match, -mismatch))
        e[i, 1:] = np.maximum.accumulate(here + along)[:-1] - open_ - along[1:]
        h[i] = np.maximum(here, e[i])
    j = int(h[n].argmax())
    i, ops, score, state = n, [], int(h[n, j]), "M"
    while i:
        if state == "M":
            if j and h[i, j] == h[i - 1, j - 1] + (match if pattern[j - 1] == text[i - 1] else -mismatch):
                ops.append("M")
                i, j = i - 1, j - 1
            else:
                state = "I" if h[i, j] == f[i, j] else "D"
        elif state == "I":
            ops.append("I")
            state = "M" if f[i, j] == h[i - 1, j] - open_ - extend else "I"
            i -= 1
        else:
            ops.append("D")
            state = "M" if e[i, j] == h[i, j - 1] - open_ - extend else "D"
            j -= 1
    cigar: list[tuple[int, str]] = []
    for op in reversed(ops):
        if cigar and cigar[-1][1] == op:
            cigar[-1] = (cigar[-1][0] + 1, op)
        else:
            cigar.append((1, op))
    return score, j, cigar


def nm_md(cigar: list[tuple[int, str]], ref: str, read: str) -> tuple[int, str]:
    """Edits and the MD string; ref starts where the alignment does."""
    nm, md, run, i, j = 0, "", 0, 0, 0
    for n, op in cigar:
        if op == "M":
            for a, b in zip(ref[i : i + n], read[j : j + n], strict=True):
                if a == b:
                    run += 1
                else:
                    md, run, nm = f"{md}{run}{a}", 0, nm + 1
            i, j = i + n, j + n
        elif op == "I":
            nm, j = nm + n, j + n
        else:
            md, run, nm, i = f"{md}{run}^{ref[i : i + n]}", 0, nm + n, i + n
    return nm, f"{md}{run}"


def matches(cigar: list[tuple[int, str]], ref: str, read: str) -> int:
    """Equal bases of an alignment."""
    total = i = j = 0
    for n, op in cigar:
        if op == "M":
            total += sum(a == b for a, b in zip(ref[i : i + n], read[j : j + n], strict=True))
        i, j = i + n * (op != "I"), j + n * (op != "D")
    return total


def overlap_trim(read1: str, read2: str, least: int = 30) -> tuple[int, int]:
    """Lengths to which a pair is cut where the mates overlap, so that what follows is adapter.

    The shorter read is laid along the other's reverse complement. Of the shifts that leave `least` bases and have one
    mismatch at most, those that match in the first least // 2 bases come first, then the smallest. What the overlap
    covers stays; without one, nothing is cut.
    """
    swapped = len(read1) > len(read2)
    short, back = (read2, revcomp(read1)) if swapped else (read1, revcomp(read2))
    half, shifts = least // 2, np.arange(max(0, len(back) - least + 1))
    if len(shifts) and len(short) >= half:
        s, b = (np.frombuffer(x.encode("latin-1", "replace"), np.uint8) for x in (short, back))
        laid = np.lib.stride_tricks.sliding_window_view(np.append(b, np.zeros(len(s), np.uint8)), len(s))[shifts]
        differ = (laid != s) & (shifts[:, None] + np.arange(len(s)) < len(b))
        late = differ[:, :half].any(axis=1)
        fits = (differ.sum(axis=1) <= 1) & (~late | (len(s) >= 2 * half))
        if fits.any():
            shift = int(np.lexsort((shifts, late, ~fits))[0])
            cut = min(len(short), len(back) - shift), len(back) - shift
            return cut[::-1] if swapped else cut
    return len(read1), len(read2)


def log10_poisson_tail(k: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """-log10 P(X > k) for Poisson X, summed from the term after k in logs."""
    k, rate = np.floor(np.asarray(k, np.float64)), np.maximum(np.asarray(rate, np.float64), 1e-300)
    from math import lgamma

    out = np.zeros(len(k))
    for x in range(len(k)):
        n, lam = k[x], rate[x]
        if n + 1 <= lam:  # the lower part is the shorter sum
            terms = np.arange(0, n + 1)
            logs = terms * np.log(lam) - lam - np.array([lgamma(t + 1) for t in terms])
            low = np.exp(logs).sum()
            out[x] = 0.0 - np.log10(min(max(1 - low, 1e-300), 1.0))
            continue
        first = (n + 1) * np.log(lam) - lam - lgamma(n + 2)
        total, term, t = 1.0, 1.0, n + 2
        while term > total * 1e-17:
            term *= lam / t
            total += term
            t += 1
        out[x] = -(first + np.log(total)) / np.log(10)
    return out + 0.0
