"""The pipeline against a brute-force version, stage by stage, each on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline as cp
import pytest
from helpers import EDGES, SF, empty, frame, prose
from pyspark.sql import functions as F
from test_ops import brute_groups, brute_lines

from fragmill.llm import language, packing
from fragmill.llm.common import fold, shared_folder, staged


#: Further columns with the names that the stages use themselves.
CLASHES = ("lang_pred", "Score_", "n_lines", "n_dropped", "gone_id", "gone_t", "t", "h2", "batch", "salt", "c1", "c2", "s1", "s2", "n_shingles", "component_id", "component", "copies", "i", "spans", "text_hash", "key_text", "inst", "chosen_id", "start", "ids_crc32", "offset", "fill", "sequence_id")


@pytest.fixture(scope="module")
def data():
    copies = [(500 + i, "copied words " + " ".join(f"c{j}" for j in range(60)) + (" changed" if i % 2 else ""), "en", "s0", 0) for i in range(8)]
    shared = [(600 + i, f"A shared line\nown text number {i} of many", "en", "s1", 0) for i in range(12)]
    private = [(700, "Mail jo@ex.org or +1 (743) 555-3824 now", "en", "s2", 0)]
    return [*EDGES, *prose(), *copies, *shared, *private]


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_are_the_named_ones():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_duplicates", "personal_data", "pack"] and cp.ORACLE_SQL is None


def test_each_stage(spark, data):
    docs = frame(spark, data).withColumns({c: F.lit("y") for c in CLASHES})
    folder = shared_folder(spark, "test")
    out = staged(cp.language_id(spark, docs, ""), f"{folder}/1")
    model = language.fit(docs, fold("doc_id", 4) != 2)
    scorer = language.Scorer(model)
    keeps = lambda t: any(map(str.isalpha, t or "")) and scorer.score(t)[1] >= 0.5
    assert texts(out) == Counter((i, t) for i, t, *_ in data if keeps(t)) and out.columns == docs.columns

    rows = [tuple(r) for r in out.collect()]
    out = staged(cp.line_dedup(spark, out, ""), f"{folder}/2")
    assert texts(out) == Counter((i, t) for i, t, *_ in brute_lines(rows, 10)) and out.columns == docs.columns
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0

    rows = [tuple(r) for r in out.collect()]
    out = staged(cp.near_duplicates(spark, out, ""), f"{folder}/3")
    gone = {i for i, _, _, kept in brute_groups(rows, 80, 5) if not kept}
    assert texts(out) == Counter((r[0], r[1]) for r in rows if r[0] not in gone)
    assert len([1 for r in out.collect() if r["doc_id"] and 500 <= r["doc_id"] < 508]) == 1

    out = staged(cp.personal_data(spark, out, ""), f"{folder}/4")
    assert {r["text"] for r in out.where("doc_id = 700").collect()} == {"Mail [email] or [phone] now"} and out.columns == docs.columns

    packed = cp.pack(spark, out, "").collect()
    w = packing.WordTokens(cp.public_tokenizers.path("word_bpe_49k.json"))
    total = defaultdict(int)
    for r in packed:
        total[r["doc_id"]] += r["length"]
    want = defaultdict(int)
    for r in out.collect():
        want[r["doc_id"]] += len(w._ids(r["text"] or "")) + 1
    assert total == want


def test_whole_run(spark):
    out = cp.run(spark, SF)
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_no_documents(spark):
    docs = empty(spark)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
