import hashlib
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from engram.llm import ngramjoin

from .test_first_ops import expected, tik
from .test_pairs import brute_join

SF = "/root/testdata/sf0.001"


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    out, kept = docs, set(rows)
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        out = stage(spark, out, SF)
        got = out.collect()
        kept = {r["doc_id"] for r in got}
        if name != "bpe":
            assert out.columns == docs.columns and all(r == rows[r["doc_id"]] for r in got)
        if name == "language_id":
            assert kept == {d for d, r in rows.items() if any(map(str.isalpha, r["text"] or ""))}
        if name == "ngram_join":
            comp = {d: c for d, _, c, _ in brute_join([(d, rows[d]["text"]) for d in before], 80, 5)}
            assert kept == {d for d in before if comp[d] == d} and len(got) == len(kept) < len(before)
        if name == "mixing":
            assert kept == before and max(Counter(r["doc_id"] for r in got).values()) == 2
            mixed = Counter(r["doc_id"] for r in got)
        if name == "bpe":
            enc = tik()
            assert Counter(r["doc_id"] for r in got) == mixed
            assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(enc, rows[r["doc_id"]]["text"]) for r in got)


def test_pipeline_query_runs_all_stages(spark):
    got = __spark_entry__.queries()["pipeline"](spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 100


def test_pipeline_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "!!! 123", "en", "a", 0), (4, text, "en", "a", 0), (4, text, "en", "a", 0), (5, text + " tail", "en", "b", 0),
            (None, text + " end", "en", "b", 0), (None, "alone here", "de", "b", 0), (6, "hot " * 40_000, "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"k": F.lit(1), "lang_pred": F.lit("clash"), "_hash": F.lit(2), "_id": F.lit(3), "_sk": F.lit(4), "row": F.lit(5)})
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "")
        out = spark.createDataFrame(out.collect(), out.schema)
        ids = sorted(str(r["doc_id"]) for r in out.collect())
        if name == "language_id":
            assert ids == sorted(["4", "4", "5", "None", "None", "6"])
        if name == "ngram_join":
            assert ids == sorted(["4", "None", "6"])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_near_duplicates_of_five_words_and_eight_tenths(spark):
    """Two of a hundred words replaced, far apart: 86 of 106 five-word n-grams are shared, but only 89 of 105 four-word ones."""
    words = [f"w{i}" for i in range(100)]
    edited = [("x" if i in (30, 70) else w) for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, "short one")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.ngram_join(spark, docs, "").collect()) == [1, 3]


def test_keep_one_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(None, text), (None, text + " x"), (None, text), (7, "other words in here"), (7, text)], "doc_id long, text string")
    got = [(r["doc_id"], hashlib.md5(r["text"].encode()).hexdigest()) for r in ngramjoin.keep_one(docs).collect()]
    assert sorted(x for x, _ in got) == [7, 7] and len(set(got)) == 2


def test_language_id_stage_keeps_lettered_texts_without_labels(spark):
    rows = [(1, "plain words here", None), (2, "Été", None), (3, "12 !", None), (4, "", None), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [1, 2]
