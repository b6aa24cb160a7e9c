"""Operator 5: personal data by fixed formats, and by contexts that known entities teach.

All of it is DataFrame and SQL functions. Base spans follow four formats. Words with a digit
or an @ are instances. The words around an instance (one or two before it, one after it, one
on each side) together with its shape are its patterns. Seeds are the base spans and words in
the form of a hexadecimal key; a key alone is no finding, its contexts must bear it out. A
pattern's trust is the share of its context's occurrences in the whole corpus that hold a known
instance of its shape; instances that trusted patterns point at become known, which scores the
patterns anew, until no instance is added. Known instances' further spans are of the kind `id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import join_few, shared_folder, staged, unused

KINDS = ("email", "ip", "card", "phone")
#: A pattern's known instances at least, its trust, an instance's score, and the share of its places under such patterns.
MIN_SUPPORT, MIN_PATTERN, MIN_INSTANCE, MIN_SHARE = 5, 0.5, 0.5, 0.5
#: One text in so many rules out common contexts before the others are counted in all texts.
PART = 64

#: The formats, written so that Java's engine neither recurses nor reads a run of characters twice: a match is
#: tried only where a run starts (or the match before it ended), and repeats keep what they took. A card's own
#: bounds on digits are part of the pattern: a run of digits of another length is no match as a whole.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_SPACE = r"\x20\x09-\x0D"
#: A word with a digit or an @.
CANDIDATE = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
#: The form of keys and digests that serves as a seed beside the base spans.
KEY = "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,128}$"
_SPAN = "array<struct<start:int,stop:int,hit:string>>"


def _luhn(digits: Column) -> Column:
    """The check sum of a string of digits is a multiple of ten."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return _luhn(F.translate(hit, " -", ""))
    if kind == "phone":
        n = F.length(F.regexp_replace(hit, "[^0-9]", ""))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _keep(kind: str):
    return lambda s: _valid(kind, s["hit"])


def _tag(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"))


def _located(df: DataFrame, pattern: str, needs: str | None, out: str) -> DataFrame:
    """Adds the matches' code point spans, which follow from the lengths of the pieces between them."""
    none = F.array().cast("array<string>")
    hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    df = df.withColumn("_hits", F.when(F.contains("text", F.lit(needs)), hits).otherwise(none) if needs else hits)
    df = df.withColumn("_gaps", F.when(F.size("_hits") > 0, F.split("text", pattern, -1)).otherwise(none))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc: Column, i: Column) -> Column:
        hit = F.get("_hits", i)
        begin = acc["at"] + F.length(F.get("_gaps", i))
        span = F.struct(begin.alias("start"), (begin + F.length(hit)).alias("stop"), hit.alias("hit"))
        return F.struct((begin + F.length(hit)).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    spans = F.aggregate(F.sequence(F.lit(0), F.size("_hits") - 1), start, add)["out"]
    return df.withColumn(out, F.when(F.size("_hits") > 0, spans).otherwise(F.array().cast(_SPAN)))


def base(df: DataFrame) -> DataFrame:
    """Adds to df(text) a column of spans for each of KINDS."""
    for kind in KINDS:
        df = _located(df, PATTERNS[kind], _NEEDS.get(kind), f"_{kind}")
        df = df.withColumn(f"_{kind}", F.filter(f"_{kind}", _keep(kind)))
    return df.drop("_hits", "_gaps")


def _all_base() -> Column:
    """The base spans with their kinds, by start and then kind."""
    tagged = [F.transform(f"_{kind}", _tag(i, kind)) for i, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*tagged))


def listed(spans: str | Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _candidates(df: DataFrame) -> DataFrame:
    """Adds `_cand`: start, stop and text of words that may identify, without marks around them, their shape and contexts."""
    df = _located(df, CANDIDATE, None, "_words")

    def one(s: Column, i: Column) -> Column:
        lead = F.length(F.regexp_extract(s["hit"], "^[^A-Za-z0-9+@]*", 0))
        core = F.regexp_extract(s["hit"], "[A-Za-z0-9+@](?:.*[A-Za-z0-9])?", 0)
        gap, hit = F.get("_gaps", i), lambda k: F.coalesce(F.get("_hits", k), F.lit(""))
        some = lambda x, other: F.when(x != "", x).otherwise(other)
        near = some(F.regexp_extract(gap, rf"(?<![^{_SPACE}])([^{_SPACE}]++)[{_SPACE}]*+$", 1), F.when(i > 0, hit(i - 1)).otherwise(F.lit("")))
        two = F.regexp_extract(gap, rf"(?<![^{_SPACE}])([^{_SPACE}]++)[{_SPACE}]++[^{_SPACE}]++[{_SPACE}]*+$", 1)
        after = some(F.regexp_extract(F.get("_gaps", i + 1), rf"^[{_SPACE}]*+([^{_SPACE}]++)", 1), hit(i + 1))
        begin = s["start"] + lead
        shape = F.concat(F.when(F.contains(core, F.lit("@")), F.lit("@")).otherwise(F.lit("")), F.when(F.rlike(core, F.lit("[A-Za-z]")), F.lit("a")).otherwise(F.lit("")), F.when(F.rlike(core, F.lit("[0-9]")), F.lit("9")).otherwise(F.lit("")))
        near, two, after = F.lower(near), F.lower(two), F.lower(after)
        contexts = F.array(
            F.when(near != "", F.concat(F.lit("1 "), near)),
            F.when((near != "") & (two != ""), F.concat(F.lit("2 "), two, F.lit(" "), near)),
            F.when(after != "", F.concat(F.lit("1 "), after)),
            F.when((near != "") & (after != ""), F.concat(F.lit("3 "), near, F.lit(" "), after)),
        )
        sides = F.transform(contexts, lambda c, k: F.when(c.isNotNull(), F.struct(c.alias("context"), (k == 2).alias("right"))))
        return F.struct(begin.alias("start"), (begin + F.length(core)).alias("stop"), core.alias("inst"), shape.alias("shape"), F.filter(sides, lambda c: c.isNotNull()).alias("around"))

    found = F.filter(F.transform("_words", one), lambda c: c["inst"] != "")
    return df.withColumn("_cand", found).drop("_words", "_hits", "_gaps")


def _counted(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """context, seen: occurrences of each context: a word (1), a word and the next (2) or the next but one (3)."""
    words = docs.select(F.filter(F.split(F.lower("text"), f"[{_SPACE}]+"), lambda w: w != "").alias("w"))
    rest = lambda k: F.when(F.size("w") > k, F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    each = words.select(F.inline(F.arrays_zip(F.col("w").alias("a"), rest(1).alias("b"), rest(2).alias("c"))))
    keys = F.array(F.concat(F.lit("1 "), F.col("a")), F.concat(F.lit("2 "), F.col("a"), F.lit(" "), F.col("b")), F.concat(F.lit("3 "), F.col("a"), F.lit(" "), F.col("c")))
    occurring = each.select(F.explode(keys).alias("context")).where("context is not null")
    return join_few(occurring, contexts, ["context"], lambda d: d.groupBy("context").agg(F.count(F.lit(1)).alias("seen")))


def _occurrences(edges: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """context, seen of the contexts that can be a pattern's: with enough instances, and not more often without one.

    A part of the corpus bounds a context's occurrences from below, which rules out common words for certain; the
    others are counted in all of it.
    """
    each = edges.groupBy("context", "right", "shape").agg(F.countDistinct("inst").alias("k"), F.count(F.lit(1)).alias("most")).where(F.col("k") >= MIN_SUPPORT)
    most = staged(each.groupBy("context").agg(F.max("most").alias("most")), f"{folder}/contexts")
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0)
    least = _counted(part, most.select("context"))
    left = most.join(least, "context", "left").where(F.col("most") >= MIN_PATTERN * F.coalesce("seen", F.lit(0))).select("context")
    return staged(_counted(docs, staged(left, f"{folder}/rare")), f"{folder}/seen")


def discover(rows: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """key_id, key_text, start, stop of new identifiers in rows(key_id, key_text, base, _cand); docs(text) is the corpus.

    A pattern is a context, its side and a shape. Its trust is the share of the context's occurrences in the corpus
    where a known instance of that shape stands; an instance's score is one less the product of its patterns' doubts,
    and MIN_SHARE of its places must have such a pattern. What is known only grows, and so do all these numbers, so the
    rounds end when one adds nothing.
    """
    one = rows.select("key_id", "key_text", "base", F.explode("_cand").alias("c")).select("key_id", "key_text", "c.*", F.exists("base", lambda b: (b["start"] < F.col("c.stop")) & (F.col("c.start") < b["stop"])).alias("seed"))
    one = staged(one, f"{folder}/instances")
    around = staged(one.select("key_id", "key_text", "start", "inst", "shape", "seed", F.explode("around").alias("x")).select("key_id", "key_text", "start", "inst", "shape", "seed", "x.*"), f"{folder}/around")
    seen = _occurrences(around, docs, folder)
    edges = staged(join_few(around, seen, ["context"]), f"{folder}/edges")
    graph = staged(edges.groupBy("context", "right", "shape", "inst").agg(F.count(F.lit(1)).alias("n"), F.first("seen").alias("seen")), f"{folder}/graph")
    known = staged(one.where(F.col("seed") | F.rlike(F.lower("inst"), F.lit(KEY))).select("inst").distinct(), f"{folder}/known-0")
    places = staged(join_few(one.where(F.size("around") > 0), graph.select("inst").distinct(), ["inst"], lambda d: d.groupBy("inst").agg(F.count(F.lit(1)).alias("places"))), f"{folder}/places")
    i = 0
    while True:
        i += 1
        scored = join_few(graph, known, ["inst"]).groupBy("context", "right", "shape").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("support"), F.first("seen").alias("seen"))
        scored = scored.where(F.col("support") >= MIN_SUPPORT).select("context", "right", "shape", F.least(F.col("hits") / F.col("seen"), F.lit(0.999)).alias("trust"))
        patterns = staged(scored.where(F.col("trust") >= MIN_PATTERN), f"{folder}/patterns-{i}")
        score = join_few(graph, patterns, ["context", "right", "shape"]).groupBy("inst").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score")).where(F.col("score") >= MIN_INSTANCE)
        under = join_few(edges, patterns, ["context", "right", "shape"]).select("inst", "key_id", "key_text", "start").distinct().groupBy("inst").agg(F.count(F.lit(1)).alias("under"))
        good = score.join(under, "inst").join(places, "inst").where(F.col("under") >= MIN_SHARE * F.col("places")).select("inst")
        good = staged(good, f"{folder}/good-{i}")
        before, known = known, staged(known.unionByName(good).distinct(), f"{folder}/known-{i}")
        if known.count() == before.count():
            break
    return join_few(one.where(~F.col("seed")), good, ["inst"]).select("key_id", "key_text", "start", "stop").distinct()


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_email, n_ip, n_card, n_phone, base, spans (arrays of start, rank, stop, kind) of each row's whole text.

    A null or empty text has no spans. Rows are told apart by id and text, null ids too: repeated rows each get
    their spans. Starts are code points, ends exclusive. Discovered spans are of the kind `id`, of rank 4, and
    never overlap base spans. An empty table stays empty; other columns are left out.
    """
    folder = shared_folder(df.sparkSession, "pii")
    docs = df.select(F.col(id_col).cast("long").alias("key_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _candidates(base(docs)).withColumn("base", _all_base()).select("key_id", F.xxhash64("text").alias("key_text"), *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS), "base", "_cand")
    rows = staged(rows, f"{folder}/rows")
    new = discover(rows.where(F.size("_cand") > 0), docs, folder)
    new = new.groupBy(F.col("key_id").alias("i"), F.col("key_text").alias("t")).agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("rank"), "stop", F.lit("id").alias("kind"))).alias("new"))
    out = rows.join(new, F.col("key_id").eqNullSafe(F.col("i")) & (F.col("key_text") == F.col("t")), "left")
    spans = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.coalesce("new", F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string>>")))))
    return out.select(F.col("key_id").alias("doc_id"), F.col("key_text").alias("text_hash"), *(f"n_{k}" for k in KINDS), "base", spans.alias("spans"))


def redact(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with each span of find() replaced by its kind in square brackets; of overlapping spans the first counts.

    Null texts stay null.
    """
    i, t, s_ = (unused(df, x) for x in ("i", "t", "spans"))
    spans = found.where(F.size("spans") > 0).select(F.col("doc_id").alias(i), F.col("text_hash").alias(t), F.col("spans").alias(s_)).dropDuplicates([i, t])
    joined = df.join(spans.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(t)), "left")
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        clear = s["start"] >= acc["at"]
        return F.struct(F.when(clear, s["stop"]).otherwise(F.greatest(acc["at"], s["stop"])).alias("at"), F.when(clear, piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(s_, start, add)
    new = F.when(F.col(s_).isNull() | text.isNull(), text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    return joined.withColumn(text_col, new).drop(i, t, s_)
