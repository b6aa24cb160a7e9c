"""Small documents with the cases that every operator must take."""

import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty and blank texts, a null id, repeated rows, ties, and characters outside ASCII.
EDGES = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t\n ", "en", "s", 5),
    (4, "one", "en", "s", 3),
    (5, "Über 漢字 🙂 naïve line\x1cgroup\x85next\xa0hard", None, "s", 30),
    (6, "same words here and there " * 30, "en", "s", 780),
    (6, "same words here and there " * 30, "en", "s", 780),
    (7, "12345 $$$ ### !!!", "en", None, 17),
    (None, "no id at all", "en", "s", 12),
]


def words(r, n, size=400):
    return " ".join("w%d" % min(int(r.expovariate(1 / 60)), size) for _ in range(n))


def prose(n=40, seed=3, first=100):
    r = random.Random(seed)
    return [(first + i, "\n".join(words(r, r.randint(3, 40)) for _ in range(r.randint(1, 6))), ("en", "de")[i % 2], "s%d" % (i % 3), 0) for i in range(n)]


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    extra = {c: F.lit("x") for c in ("ids", "score", "bands", "rep", "comp", "bucket", "gone", "h1", "piece", "length", "base", "cue", "media", "payload", "kept", "w", "shard", "c0", "_t", "key_id")}
    return df.withColumns(extra)


def empty(spark):
    return spark.createDataFrame([], DOCS)


LONG = " ".join(f"tok{i % 977} pad" for i in range(60_000))
