"""Each operator against its definition or a brute-force version, over the edge cases too."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from helpers import EDGES, LONG, SF, empty, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fragmill.llm import bpe, classifier, language, lines, lm, media, neardup, packing, pii, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE, WORD_BPE = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def low_words(t):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(t or "")]


# 1


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(BYTE_BPE), special_tokens={})


CODEC = bpe.Codec(BYTE_BPE, P.PATTERN, most=50)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcdetions THE'sll 09.,!?é漢🙂\n\t \x1c\xa0"), max_size=80))
def test_bpe_equals_tiktoken(text):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.machine.ranks, special_tokens={})
    ids = CODEC.encode(text)
    assert ids == enc.encode_ordinary(text)
    d = CODEC.decoder
    assert d.bytes(ids) == text.encode() and d.whole(np.array(ids, np.int64)) and "".join(d.stream(ids)) == text


def test_every_token_is_its_own_encoding():
    machine = bpe.Transducer(bpe.read_ranks(BYTE_BPE), most=500)
    assert all(machine.encode(t) == [r] for t, r in list(machine.ranks.items())[::37])


def test_decoder_tells_cut_characters():
    d = bpe.Decoder({i: bytes([i]) for i in range(256)})
    assert not d.whole(np.array(list("é".encode()[:1]))) and not d.whole(np.array([0xC0, 0x80])) and d.whole(np.array(list("é漢".encode())))
    assert list(d.stream("é".encode() + b"\xff")) == ["é", "�"]


def test_bpe_rows(spark, oracle):
    df = frame(spark, [*EDGES, (8, LONG, None, None, 0)])
    got = bpe.encode(df, BYTE_BPE, P.PATTERN, decoded=True).collect()
    want = Counter((i, tuple(oracle.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in [*EDGES, (8, LONG)])
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want and all(r["whole"] for r in got)
    again = bpe.decode(bpe.encode(df, BYTE_BPE, P.PATTERN), BYTE_BPE).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in again) == Counter((i, d) for i, _, d in want.elements())
    assert bpe.encode(empty(spark), BYTE_BPE, P.PATTERN).count() == 0


# 2


def brute_lines(rows, least):
    seen = defaultdict(set)
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    out = []
    for i, t, *_ in rows:
        found = (t or "").split("\n")
        kept = [x for x in found if not key(x) or len(seen[key(x)]) < least]
        out.append((i, "\n".join(kept), len(found), len(found) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 4])
def test_frequent_lines_go(spark, batches):
    shared = [(200 + i, f"Shared Line \nown {i}\n\tSHARED line\r\nÄhnlich" + "\nnine" * (i < 9), None, None, 0) for i in range(12)]
    data = [*EDGES, *prose(), *shared]
    got = lines.drop_frequent(frame(spark, data), 10, keep=("lang",), batches=batches)
    assert rows_of(got, "doc_id", "text", "n_lines", "n_dropped") == brute_lines(data, 10)
    assert lines.drop_frequent(empty(spark), 10).count() == 0


def test_runs_are_merged_and_add_up(spark):
    runs = lines.LineRuns(spark, 5, buckets=3)
    for b in range(5):
        runs.add(spark.createDataFrame([(10 * b + i, i % 3, 7) for i in range(6)] + [(b, 99, 1), (b, 50 + b, 2)], "doc_id long, h1 long, h2 long"))
        assert rows_of(runs.frequent(), "h1") == [(i,) for i in (0, 1, 2)] * (b >= 2) + [(99,)] * (b == 4)
    assert len(runs.names()) <= 3
    batch = spark.createDataFrame([(90, 1, 7), (91, 60, 2), (92, 53, 2), (93, 99, 1), (94, 99, 1)], "doc_id long, h1 long, h2 long").repartition(2)
    with runs._ordered():
        more = runs._totals(batch)
        assert rows_of(more, "h1", "n", "total") == [(53, 1, 2), (60, 1, 1)]
        plan = more._jdf.queryExecution().executedPlan().toString()
    # what stands above the batch's dealing is merged as it lies
    above = plan[: plan.index("REPARTITION_BY_NUM")]
    assert above.count("SortMergeJoin") == len(runs.names()) and above.count("Exchange") == 1 and above.count("Sort [") == 1
    runs.close()


def test_frequent_lines_beyond_a_broadcast(spark, monkeypatch):
    from fragmill.llm import common

    monkeypatch.setattr(common, "FEW", 0)
    data = [(None if i % 4 == 0 else i, f"both\nhalf{i % 2}\nown {i}", None, None, 0) for i in range(30)]
    assert rows_of(lines.drop_frequent(frame(spark, data), 10), "doc_id", "text", "n_lines", "n_dropped") == brute_lines(data, 10)


# 3


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000).map(lambda b: b * 9))
def test_media_round_trip(data):
    full = media.padded(data)
    made = media.mux(full)
    (track,) = media.probe(made)
    assert media.payload(made, track) == full and len(full) % 64 == 0 and len(full) >= 64
    assert track.duration == len(full) and track.codec == "raw"
    assert b"".join(made[a:b] for a, b in track.key_ranges()) == full


def test_broken_boxes_raise():
    with pytest.raises(ValueError):
        media.probe(media.mux(media.padded(b"x"))[:-10])


def chunks_by_hand(made):
    """An independent reader: finds the tables by their names and adds chunk after chunk."""
    table = lambda name: made.index(name) + 8  # noqa: E731  past name, version and flags
    number = lambda at: int.from_bytes(made[at : at + 4], "big")
    at = table(b"stsz")
    sizes = [number(at)] * number(at + 4) if number(at) else [number(at + 8 + 4 * i) for i in range(number(at + 4))]
    at = table(b"stsc")
    runs = [(number(at + 4 + 12 * i), number(at + 8 + 12 * i)) for i in range(number(at))]
    at = table(b"stco")
    out, k = [], 0
    for c in range(number(at)):
        start = number(at + 4 + 4 * c)
        for _ in range(next(n for first, n in reversed(runs) if first <= c + 1)):
            out.append(made[start : start + sizes[k]])
            start, k = start + sizes[k], k + 1
    return out


@pytest.mark.parametrize("n", [0, 64, 1024, 16 * 1024, 16 * 1024 + 64, 100_000])
def test_an_independent_reader_agrees(n):
    full = media.padded(random.Random(n).randbytes(n).replace(b"st", b"  "))
    made = media.mux(full)
    samples = chunks_by_hand(made)
    (track,) = media.probe(made)
    assert b"".join(samples) == full and [len(x) for x in samples] == track.sizes.tolist()


def test_compact_sizes():
    """stz2 instead of stsz: the tables lie behind the samples, so that only the outer boxes' sizes change."""
    made = media.mux(media.padded(b"x" * 900))
    at = made.index(b"stsz") - 4
    for bits, data in ((8, bytes([255])), (16, (960).to_bytes(2, "big")), (4, bytes([0x80]))):
        box = b"stz2" + bytes(4) + bytes([0, 0, 0, bits]) + (1).to_bytes(4, "big") + data
        new = bytearray(made[:at] + (len(box) + 4).to_bytes(4, "big") + box + made[at + int.from_bytes(made[at : at + 4], "big") :])
        for name in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
            k = new.index(name) - 4
            new[k : k + 4] = (int.from_bytes(new[k : k + 4], "big") + len(new) - len(made)).to_bytes(4, "big")
        (track,) = media.probe(bytes(new))
        assert track.sizes.tolist() == [{8: 255, 16: 960, 4: 8}[bits]]


def test_media_that_is_broken(spark):
    good = media.mux(media.padded(b"x" * 5000))
    r = random.Random(5)
    bad = [b"", b"junk", good[:-10], good[:40], good.replace(b"stco", b"free"), good.replace(b"trak", b"free"), bytes(r.randbytes(300))]
    for _ in range(200):
        x = bytearray(good)
        for _ in range(3):
            x[r.randrange(len(x) - 700, len(x))] = r.randrange(256)
        bad.append(bytes(x))
    rows = spark.createDataFrame([(i, 5, x) for i, x in enumerate([good, None, *bad])], "doc_id long, n_bytes long, media binary")
    got = sorted(media.columns(rows).collect(), key=lambda r: r["doc_id"])
    assert got[0]["broken"] is None and len(got[0]["payload"]) == 5056 and got[1]["broken"] is None and got[1]["payload"] is None
    assert all(x["broken"] and x["codec"] is None and x["payload"] is None for x in got[2:9])


def test_media_rows(spark):
    data = [*EDGES, (8, LONG, None, None, 0)]
    got = media.columns(media.store(frame(spark, data))).collect()
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["payload"])) for r in got) == Counter((i, len((t or "").encode()), media.padded((t or "").encode())) for i, t, *_ in data)
    by_text = {bytes(r["payload"]): bytes(r["media"]) for r in got}
    assert all(by_text[bytes(r["payload"])] == bytes(r["media"]) for r in got)
    assert media.columns(media.store(empty(spark))).count() == 0


# 4


def brute_counts(t):
    w = WORD.findall(t or "")
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    ls = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(hit)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#|é\x0b\x1c"), max_size=80))
def test_counts_equal_brute_force(text):
    assert rules.count(text.encode())[:5] == brute_counts(text)


def test_repeats_without_packing():
    assert rules.repeated(np.array([1, 2, 3, 1, 2, 3]), 3_000_000) == rules.repeated(np.array([1, 2, 3, 1, 2, 3]), 4) == 6


def test_trees_learn_and_keep_directions():
    r = np.random.default_rng(1)
    x = r.random((600, 3))
    y = ((x[:, 0] < 0.5) ^ (r.random(600) < 0.05)).astype(float)
    t = rules.train(x, y, [-1, 0, 1])
    assert ((t.score(x) >= 0.5) == y).mean() > 0.9
    for j, d in ((0, -1), (2, 1)):
        z = x.copy()
        z[:, j] += 0.3
        assert ((t.margin(z) - t.margin(x)) * d >= -1e-9).all()
    assert rules.train(x[:0], y[:0], [0, 0, 0]) is None


def test_rules_rows(spark):
    junk = [(300 + i, "%%% ### && || " * 40, None, None, 0) for i in range(20)]
    good = [(i, " ".join(f"good{(i * 7 + j) % 97}" for j in range(90)), None, None, 0) for i in range(400, 440)]
    data = [*EDGES, *junk, *good]
    df = frame(spark, data)
    labels = spark.createDataFrame([(i, int(i >= 400)) for i, *_ in junk + good], "doc_id long, quality int")
    got = rules.judge(df, rules.fit(df, labels)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter((i, *brute_counts(t)) for i, t, *_ in data)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert all(r["kept"] for r in got if (r["doc_id"] or 0) >= 400) and not any(r["kept"] for r in got if 300 <= (r["doc_id"] or 0) < 400)
    none = rules.fit(df, labels.limit(0))
    assert none is None and all(r["kept"] != r["base_failed"] for r in rules.judge(df, none).collect())
    assert rules.judge(empty(spark), None).count() == 0


# 5

FORMATS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 12 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in twice) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_spans(t):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(FORMATS.items()) for m in re.finditer(p, t or "") if valid(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_pii_equals_brute_force(spark):
    r = random.Random(3)
    parts = [*"a1 2.3@-+(4)5_%\n6é🙂", "@b.c", "1.2.3.4", "4111 1111 1111 1111", "4785380592391139", "+1 (743) 555-3824", "x@y.z", "256.1.1.1", "000000000000000255.1.1.1"]
    data = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 60))), None, None, 0) for i in range(1000, 1800)]
    data += [*EDGES, (10, "1" * 30_000, None, None, 0), (11, "1.2." * 3000, None, None, 0), (12, "a" * 30_000 + "@", None, None, 0), (13, "a@b.c%d@e.f", None, None, 0), (14, "1 " * 20_000, None, None, 0)]
    got = pii.find(frame(spark, data).repartition(4))
    assert Counter((x[0], x[1]) for x in got.select("doc_id", pii.listed("base")).collect()) == Counter((i, brute_spans(t)) for i, t, *_ in data)
    assert pii.find(empty(spark)).count() == 0


def brute_discovery(rows):
    """(id, start, stop) that the rules add, by plain loops over every word."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    seen, places = Counter(), []
    for i, t, *_ in rows:
        found = [(m.start(), m.group()) for m in word.finditer(t or "")]
        low = [w.lower() for _, w in found]
        for k, w in enumerate(low):
            seen["1", w] += 1
            seen["2", w, low[k + 1] if k + 1 < len(low) else None] += 1
            seen["3", w, low[k + 2] if k + 2 < len(low) else None] += 1
        base = [tuple(map(int, x.split(":")[1:])) for x in brute_spans(t).split(",") if x]
        for k, (at, w) in enumerate(found):
            core = re.search(r"[A-Za-z0-9+@](?:.*[A-Za-z0-9])?", w)
            if not re.search("[0-9@]", w) or not core:
                continue
            a, z = at + len(re.match("[^A-Za-z0-9+@]*", w).group()), 0
            z = a + len(core.group())
            shape = tuple(bool(re.search(c, core.group())) for c in ("@", "[A-Za-z]", "[0-9]"))
            near, after = low[k - 1] if k else None, low[k + 1] if k + 1 < len(low) else None
            gap_words = 0  # two words before count only if no instance stands between
            while k - 1 - gap_words >= 0 and not re.search("[0-9@]", low[k - 1 - gap_words]):
                gap_words += 1
            around = [(("1", near), 0)] * (near is not None) + [(("2", low[k - 2] if k > 1 else None, near), 0)] * (gap_words > 1) + [(("1", after), 1)] * (after is not None) + [(("3", near, after), 0)] * (near is not None and after is not None)
            places.append((i, t, a, z, core.group(), shape, around, any(x < z and a < y for x, y in base)))
    known = {p[4] for p in places if p[7] or re.fullmatch("(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,128}", p[4].lower())}
    while True:
        hits = defaultdict(list)
        for p in places:
            for x in p[6]:
                if p[4] in known:
                    hits[x, p[5]].append(p[4])
        trust = {k: min(len(v) / seen[k[0][0]], 0.999) for k, v in hits.items() if len(set(v)) >= 5 and len(v) >= 0.5 * seen[k[0][0]]}
        doubt, under, total = defaultdict(set), Counter(), Counter()
        for p in places:
            good = {(x, p[5]) for x in p[6]} & set(trust)
            doubt[p[4]] |= good
            under[p[4]] += bool(good)
            total[p[4]] += bool(p[6])
        new = {x for x, ks in doubt.items() if ks and 1 - math.prod(1 - trust[k] for k in ks) >= 0.5 and under[x] >= 0.5 * total[x]}
        if new <= known:
            return Counter((p[0], p[2], p[3]) for p in places if p[4] in new and not p[7])
        known |= new


def test_contexts_teach_new_identifiers(spark):
    hexa = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    data = [(i, f"employee badge: user{i}@corp.example.com joined", None, None, 0) for i in range(8)]
    data += [(100 + i, f"again badge: EMP-{10000 + i}@x was seen", None, None, 0) for i in range(3)]
    data += [(200 + i, f"the 98765{i} of the {i} the", None, None, 0) for i in range(30)]
    data += [(300 + i, f'words{i} of token = "{hexa(i)}"### more of it', None, None, 0) for i in range(9)]
    data += [(320 + i, f"TOKEN = 'short-{i}x' more", None, None, 0) for i in range(4)]
    data += [(340, "short-1x begins and ends the text short-2x", None, None, 0), (341, f"commit {hexa('alone')} in prose", None, None, 0)]
    data += [(360 + i, f"key other-{i}x yields {7000 + i} now", None, None, 0) for i in range(4)]
    df = frame(spark, [*data, *EDGES])
    got = pii.find(df)
    spans = {r[0]: r[1] for r in got.select("doc_id", pii.listed("spans")).collect()}
    assert spans[305].count("id:") == 1 and spans[321] == "id:9:17" and not spans[341] and spans[103 - 1].startswith("id:13:")
    assert not any(spans[200 + i] for i in range(30))
    new = Counter((i, s["start"], s["stop"]) for i, x in got.select("doc_id", "spans").collect() for s in x if s["kind"] == "id")
    assert new == brute_discovery([*data, *EDGES])
    text = {r["doc_id"]: r["text"] for r in pii.redact(df, got).collect()}
    assert text[305] == 'words5 of token = "[id]"### more of it' and text[0] == "employee badge: [email] joined"


@pytest.mark.parametrize("few", [0, 200_000])
def test_discovery_equals_brute_force_on_random_words(spark, monkeypatch, few):
    from fragmill.llm import common

    monkeypatch.setattr(common, "FEW", few)
    r = random.Random(8)
    vocabulary = ["key", "=", "of", "the", "no.", "id", "a1", "b22", "c-3", "x@y", "u@v.org", "4111111111111111", "10.0.0.1"]
    data = [(i, " ".join(r.choice([*vocabulary, f"n{r.randrange(30)}", f"m{r.randrange(9)}@h.org", f"10.1.1.{r.randrange(40)}"]) for _ in range(r.randint(0, 9))), None, None, 0) for i in range(400)]
    got = pii.find(frame(spark, data))
    assert Counter((i, s["start"], s["stop"]) for i, x in got.select("doc_id", "spans").collect() for s in x if s["kind"] == "id") == brute_discovery(data)


# 6


def test_word_tokens_equal_the_library():
    w = packing.WordTokens(WORD_BPE, most=40)
    r = random.Random(2)
    parts = [*"abcDE '’sTLl éÀß×÷²½ªµº\n\t.,!?&#0123\xad", "'s", "N'T", "漢", "é", "\x85", "\xa0", "\x1c", "<|endoftext|>"]
    for _ in range(600):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert next(w.encode([s])) == np.array(w._ids(s), "<u4").tobytes(), s


def test_word_tokens_learn_a_word_once_whatever_sign_follows():
    w = packing.WordTokens(WORD_BPE)
    texts = ["Word, word. WORD!", "", "\n", "(word) Été, été; it's word's don't.", "漢 word,", "×, é÷. ß? a,b.c!d", "word"]
    assert list(w.encode(texts)) == [np.array(w._ids(s), "<u4").tobytes() for s in texts]
    assert {x for x in w.known if x.startswith("word")} == {"word", "word's"}
    r = random.Random(4)
    texts = ["".join(r.choices("abAB,.!'`s é\xd7\xdf\xc9\xaa1\n", k=r.randint(0, 30))) for _ in range(500)]
    assert list(w.encode(texts)) == [np.array(w._ids(s), "<u4").tobytes() for s in texts]


@pytest.mark.parametrize("seed", range(4))
def test_bins_are_within_capacity_and_few(seed):
    n = np.random.default_rng(seed).integers(*((1, 2049), (500, 1200), (1, 300), (900, 1100))[seed], 800)
    first = packing.best_fit(n, 2048)
    bins = packing.improve([list(b) for b in first], n, 2048)
    assert sorted(i for b in bins for i in b) == list(range(800)) and all(n[b].sum() <= 2048 for b in bins) and len(bins) <= len(first)


def exchanges(a, b, room):
    """All that a can give for what b gives back so that b gains within its room."""
    take = lambda x, most: [c for m in range(most + 1) for c in itertools.combinations(x, m)]
    return [(x, y) for x in take(a, 2)[1:] for y in take(b, 2 if len(x) == 1 else 1) if 0 < sum(x) - sum(y) <= room]


@pytest.mark.parametrize("seed", range(3))
def test_packing_searches_until_no_exchange_is_left(seed):
    n = np.random.default_rng(seed).integers(400, 701, 600)
    bins = packing.improve(packing.best_fit(n, 2048), n, 2048)
    assert sorted(i for b in bins for i in b) == list(range(600)) and all(n[b].sum() <= 2048 for b in bins)
    held = sorted((n[b].tolist() for b in bins), key=sum)
    if len(held) > -(-n.sum() // 2048):
        assert not any(exchanges(a, b, 2048 - sum(b)) for k, a in enumerate(held) for b in held[k + 1 :] if 2048 > sum(b))


def test_packing_rows(spark):
    data = [*EDGES, (8, LONG, None, None, 0), *prose(60)]
    found = packing.pieces(frame(spark, data), WORD_BPE)
    got = packing.pack(found, group=16).collect()
    w = packing.WordTokens(WORD_BPE)
    want = Counter()
    for i, t, *_ in data:
        ids = [*w._ids(t or ""), 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(k[3] * n for k, n in want.items())
    assert len(bins) <= math.ceil(total / 2048) + 2
    assert packing.pack(packing.pieces(empty(spark), WORD_BPE)).count() == 0


# 7


def test_language_learns_and_backs_off():
    en, de = "the of and thing with there", "der die und ung nicht schön"
    r = random.Random(1)
    make = lambda s: " ".join(r.choice(s.split()) + r.choice(["", r.choice(s.split())]) for _ in range(30))
    m = language.train([(make(en), "en") for _ in range(30)] + [(make(de), "de") for _ in range(30)])
    s = language.Scorer(m, most=20)
    assert all(s.score(make(en))[0] == "en" and s.score(make(de))[0] == "de" for _ in range(20))
    assert s.score("ungungung schönung")[0] == "de" and 0 <= s.score("xyz")[1] <= 1
    assert language.letters("ab½c ⅧxÉ ²") == ["ab", "c", "xÉ"] and not language.has_letter("½ ² ① Ⅷ 12_") and language.has_letter("½a")
    assert language.train([]) is None and language.train([("123", "en")]) is None


def test_language_rows(spark):
    data = [*EDGES, *prose(), (8, LONG, "en", None, 0)]
    df = frame(spark, data)
    model = language.fit(df)
    got = language.predict(df, model, keep=("lang", "text")).collect()
    assert len(got) == len(data)
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in language.predict(df, None).collect()} == {"und"}
    assert language.fit(empty(spark)) is None and language.predict(empty(spark), model).count() == 0


# 8


def test_classifier_tells_junk(spark):
    r = random.Random(4)
    good = lambda: " ".join("".join(r.choice("aeioubcdst") for _ in range(5)) for _ in range(80)) + "."
    junk = lambda: " ".join("".join(r.choice("AEIOUBCD") for _ in range(5)) + "!!" for _ in range(80))
    data = [(i, good() if i % 2 else junk(), None, None, 0) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    df = frame(spark, [*data, *[x for x in EDGES if (x[0] or 99) < 9], (999, LONG, None, None, 0)])
    m = classifier.fit(df.where("doc_id <> 6"), labels, F.col("doc_id") % 5 != 0)
    assert all((m.score(t) >= 0.3) == bool(i % 2) for i, t, *_ in data if i % 5 == 0 and i > 9)
    got = classifier.score(df, m).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    none = classifier.fit(df, labels.limit(0))
    assert none is None and {r["score"] for r in classifier.score(df, none).collect()} == {0.5}
    assert classifier.score(empty(spark), m).count() == 0


def test_long_texts_are_summed_over_parts(monkeypatch):
    text = " ".join(f"w{i % 7}" for i in range(500))
    whole = classifier.grams(text)
    monkeypatch.setattr(classifier, "PART", 10**9)
    assert np.allclose(classifier.grams(text)[1].sum(), whole[1].sum())


# 9


def brute_groups(rows, percent, width):
    sets = []
    for _, t, *_ in rows:
        w = low_words(t)
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        c = min((x for x in least[top(i)] if x is not None), default=None)
        out.append((r[0], len(sets[i]), c, c is None or r[0] == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("percent", "width"), [(85, 3), (80, 5)])
def test_groups_equal_brute_force(spark, percent, width):
    r = random.Random(percent)
    data = [*EDGES]
    for g in range(12):
        base = [f"t{r.randrange(5000)}" for _ in range(r.choice([4, 8, 40, 150]))]
        for k in range(12):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
            data.append((1000 - 20 * g - k, " ".join(w).upper() if k % 3 == 0 else " ".join(w), None, None, 0))
    got = neardup.link(frame(spark, data).repartition(3), percent, width)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == brute_groups(data, percent, width)


def test_blocks_cover_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    r = random.Random(2)
    base = [f"t{i}" for i in range(120)]
    data = []
    for k in range(60):
        w = list(base)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(120)] = f"x{k}{r.random()}"
        data.append((k, " ".join(w), None, None, 0))
    assert rows_of(neardup.link(frame(spark, data), 85, 3), "doc_id", "n_shingles", "component_id", "kept") == brute_groups(data, 85, 3)


def test_a_stray_in_a_large_bucket_costs_a_row_for_each_member(spark):
    for n in (1000, 4000):
        members = spark.range(n).selectExpr("0 band", "7L bucket", "0L lead", "id rep", f"if(id = {n - 1}, id, 0L) comp", f"{n}L size", "1L strays", "0L main")
        assert neardup._dealt(members).count() == n + -(-n // neardup.BLOCK)


def test_hot_classes_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 5)
    data = [(i, f"copy {i % 3 if i % 2 else 0} of one text with some words", None, None, 0) for i in range(30)] + [*EDGES]
    assert rows_of(neardup.link(frame(spark, data), 85, 3), "doc_id", "n_shingles", "component_id", "kept") == brute_groups(data, 85, 3)


def test_no_rows_and_no_words(spark):
    assert neardup.link(empty(spark)).count() == 0
    assert all(r["kept"] for r in neardup.link(frame(spark, EDGES[:3])).collect())


def test_small_sketches_never_exclude_a_link():
    r = np.random.default_rng(3)
    for n in (5, 20, 60, 200, 900, 1500, 4000, 20_000):
        for _ in range(60):
            u = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = int(0.15 * len(u)) // 2
            a, b = u[drop:], u[: len(u) - drop]
            j = len(np.intersect1d(a, b)) / len(u)
            (ka, sa), (kb, sb) = neardup.odd_sketch(a), neardup.odd_sketch(b)
            x = [np.array([v]) for v in (len(a), len(b), ka, kb)]
            assert j < 0.85 or neardup.may_link(*x, neardup._words64([sa]), neardup._words64([sb]), 0.85)[0]


def test_bands_miss_rarely():
    assert neardup.band_rows(0.85) == 5 and neardup.band_rows(0.8) == 4
    assert all((1 - t**neardup.band_rows(t)) ** (120 // neardup.band_rows(t)) <= 1e-6 for t in (0.7, 0.8, 0.85, 0.9))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    from fragmill.llm.common import shared_folder

    got = dict(rows_of(neardup.components(edges, shared_folder(spark, "t")), "node", "comp"))
    assert all(got[i] == 1 for i in range(2, 41)) and got[101] == 100


# 10


def brute_lm(train, texts):
    tk = lambda t: [*low_words(t), "\n"]
    seen = [tk(t) for t in train]
    c = Counter(w for t in seen for w in t)
    n, v = sum(c.values()), len(c)
    two = Counter(p for t in seen for p in zip([" ", *t], t, strict=False))
    cont = Counter(b for _, b in two)
    d2, d1 = ((0, *lm.discounts([sum(x == k for x in counts.values()) for k in (1, 2, 3, 4)])) for counts in (two, cont))
    total, mass = Counter(), defaultdict(float)
    for (a, _), k in two.items():
        total[a] += k
        mass[a] += d2[min(k, 3)]
    rest = sum(d1[min(k, 3)] for k in cont.values()) / len(two) if two else 1.0

    def p(a, b):
        one = (cont[b] - d1[min(cont[b], 3)]) / len(two) + rest / (v + 1) if two else rest / (v + 1)
        if not total[a]:
            return one
        return (two[a, b] - d2[min(two[a, b], 3)]) / total[a] + mass[a] / total[a] * one

    for t in texts:
        w = tk(t)
        yield len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(a, b)) for a, b in zip([" ", *w], w, strict=False))


def test_counts_beyond_32_bits(tmp_path):
    big = (1 << 33) + 5
    u, v, n = np.array([1, 1, 2], np.uint64), np.array([2, 3, 3], np.uint64), np.array([big, 1, 7])
    t = pa.Table.from_batches([lm._dealt(u, v, n, np.zeros(3, np.int64))])
    assert lm._bigrams(pa.concat_tables([t, t]))[2].tolist() == [2 * big, 2, 14]
    out = lm._merge(t, str(tmp_path), 1, 1)
    assert out["figures"].to_pylist()[-1] == [big + 8, 3, 1, 0, 0, 0]
    lm._merge_words(out.slice(0, 1), str(tmp_path))
    model = lm.Model(str(tmp_path), 1, (), big + 8, 2, 3, (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 0.5)
    found = lm.Scorer(model)._find("words", np.array([1, 2, 3], np.uint64), np.zeros(3, np.int64), 6)
    assert found[:, 0].tolist() == [0, big, 8] and found[:, 2].tolist() == [big + 1, 7, 0]
    assert lm.Scorer(model)._find("bigrams", lm._bigram_key(u, v), np.zeros(3, np.int64), 1)[:, 0].tolist() == [big, 1, 7]


@pytest.mark.parametrize("fan_out", [256, 2])
def test_lm_equals_brute_force(spark, monkeypatch, fan_out):
    monkeypatch.setattr(lm, "SHARD_BYTES", 500)
    monkeypatch.setattr(lm, "FAN_OUT", fan_out)
    monkeypatch.setattr(lm, "MAPS", 5)
    data = [*[x for x in EDGES if x[0] is not None], *prose(80), (8, LONG, None, None, 0)]
    df = frame(spark, data)
    model = lm.fit(df, F.col("doc_id") % 4 != 0)
    assert model.shards > 4
    got = sorted(lm.score(df, model).collect(), key=lambda r: (r["doc_id"], r["n_tokens"]))
    data.sort(key=lambda r: (r[0], len(low_words(r[1]))))
    want = brute_lm([t for i, t, *_ in data if i % 4], [t for _, t, *_ in data])
    for r, w in zip(got, want, strict=True):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert r["base_score"] == pytest.approx(w[3], rel=1e-9, abs=1e-9) and r["score"] == pytest.approx(w[4], rel=1e-9, abs=1e-9)


def test_frequent_words_are_spread(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 2000)
    data = [(i, " ".join(f"the w{i}x{j}" for j in range(40)), None, None, 0) for i in range(40)]
    df = frame(spark, data)
    model = lm.fit(df)
    assert model.hot
    for r, w in zip(sorted(lm.score(df, model).collect(), key=lambda r: r["doc_id"]), brute_lm([t for _, t, *_ in data], [t for _, t, *_ in data]), strict=True):
        assert r["score"] == pytest.approx(w[4], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    data = prose(30)
    words = sorted({w for _, t, *_ in data for w in low_words(t)})
    df = frame(spark, data)
    model = lm.fit(df)
    for context in (words[0], "never"):
        pairs = frame(spark, [(i, f"{context} {w}", None, None, 0) for i, w in enumerate([*words, "unknown-word"])])
        whole = {r["doc_id"]: r["score"] for r in lm.score(pairs, model).collect()}
        first = lm.score(frame(spark, [(0, context, None, None, 0)]), model).first()["score"]
        ends = list(brute_lm([t for _, t, *_ in data], [f"{context} {w}" for w in [*words, "unknown-word"]]))
        assert whole[0] == pytest.approx(ends[0][4]) and first < 0


def test_lm_of_nothing(spark):
    model = lm.fit(empty(spark))
    r = lm.score(frame(spark, EDGES[:2]), model).collect()
    assert {(x["n_tokens"], x["n_known"], x["base_score"], x["score"]) for x in r} == {(1, 0, 0.0, 0.0)}
    assert lm.score(empty(spark), model).count() == 0
    with pytest.raises(ValueError):
        lm._local("hdfs://x/y")


def test_digest_queries_have_their_columns(spark):
    from fragmill.llm import queries

    want = {
        "op1_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op3_media_columns": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
        "op5_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
        "op7_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    }
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for name, columns in want.items():
        got = queries.queries()[name](spark, SF)
        assert columns <= set(got.columns) and got.count() == len(docs)
    for r in queries.queries()["op5_pii"](spark, SF).collect():
        assert r["base_sha256"] == hashlib.sha256(brute_spans(docs[r["doc_id"]]).encode()).hexdigest()
    for r in queries.queries()["op1_byte_bpe"](spark, SF).collect():
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    held = queries.queries()["op7_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_queries_equal_brute_force_on_whole_tables(spark):
    from fragmill.llm import queries

    q = queries.queries()
    docs = sorted((r["doc_id"], r["text"], None, None, 0) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert rows_of(q["op9_minhash_neardup"](spark, SF), "doc_id", "n_shingles", "component_id", "kept") == brute_groups(docs, 85, 3)
    got = sorted(q["op10_lm_scoring"](spark, SF).collect(), key=lambda r: r["doc_id"])
    train = [t for i, t, *_ in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    for r, w in zip(got, brute_lm(train, [t for _, t, *_ in docs]), strict=True):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(w[3], rel=1e-9) and r["score"] == pytest.approx(w[4], rel=1e-9)
    w = packing.WordTokens(WORD_BPE)
    ids = {i: np.array([*w._ids(t or ""), 0], "<u4") for i, t, *_ in docs}
    rows = q["op6_best_fit_packing"](spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter((i, k, 2048 * k, len(x[2048 * k : 2048 * k + 2048]), zlib.crc32(x[2048 * k : 2048 * k + 2048].tobytes())) for i, x in ids.items() for k in range(-(-len(x) // 2048)))
    assert len({r["sequence_id"] for r in rows}) <= math.ceil(sum(map(len, ids.values())) / 2048) + 2
    for r, (i, t, *_) in zip(sorted(q["op4_quality_rules"](spark, SF).collect(), key=lambda r: r["doc_id"]), docs, strict=True):
        assert (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (i, *brute_counts(t))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = q["op8_quality_classifier"](spark, SF).collect()
    held = [(r["score"], labels[r["doc_id"]]) for r in judged if r["held_out"] and r["doc_id"] in labels]
    assert len(judged) == len(docs) and all(a > b for a, x in held for b, y in held if x > y)
