"""Language ID by word-first backoff.

A known word scores its smoothed log frequency in each language. An unseen word falls back to its
longest character n-grams (ends marked) of which any is known, from ``ORDERS[0]`` letters down to one, scoring
their mean log frequency. A document's score is the sum over its words; the prediction is the
language with the highest score (ties: the smallest name), and ``score`` its softmax share.

Fitting is Spark SQL over a bounded sample of labelled rows: at most about ``per_language`` documents
of each language, chosen by a hash of the id, of the ``MAX_LANGUAGES`` most frequent languages (rarer labels are never
predicted). The model keeps ``words`` (language, word) and ``grams`` (language, n-gram) entries, the most frequent ones of each
language in equal shares, so that what is broadcast has a fixed bound; all other words count as unseen. Prediction is one Arrow pass without a shuffle; a worker
holds a batch, the model and a bounded cache of word scores.

Defined results: a text that is null or has no letter is ``und`` with score 0; words without any
known n-gram are neutral; without a labelled row to learn from, everything is ``und``; repeated rows
each get a row; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, held, held_out, spread_out, table

ORDERS = (5, 4, 3, 2, 1)
PER_LANGUAGE = 1500
WORDS = 40_000
#: Longer words (characters) are never known ones, so that the model has a bound in bytes as well.
LONGEST = 64
GRAMS = 80_000
MAX_LANGUAGES = 256
CACHE_BYTES = 48 << 20
CACHE_WORDS = 100_000


def _tuples(df: DataFrame) -> list[tuple]:
    """Rows of a table of bounded size, by way of Arrow: lighter on the driver than row objects."""
    return list(zip(*(c.to_pylist() for c in df.toArrow().columns), strict=True))


def _most_frequent(counts: DataFrame, n: int, *names: str) -> DataFrame:
    """The n most frequent entries of each language, so that rare languages keep theirs. counts comes from the bounded sample."""
    order = Window.partitionBy("lang").orderBy(F.desc("c"), *names)
    return counts.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= max(1, n))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, words: int = WORDS, grams: int = GRAMS) -> dict:
    """Model from text and lang alone of labelled rows that are not held out."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return {"langs": []}
    langs = sorted(r["lang"] for r in sizes)
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))))
    dice = F.pmod(F.xxhash64("doc_id", F.crc32("text")), F.lit(1 << 30)) / float(1 << 30)
    sample = train.where(dice < share[F.col("lang")])
    found = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    counts = found.groupBy("lang", "w").agg(F.count("*").alias("c")).persist(StorageLevel.DISK_ONLY)
    try:
        total = {r["lang"]: (r["n"], r["k"]) for r in counts.groupBy("lang").agg(F.sum("c").alias("n"), F.count("*").alias("k")).collect()}
        top = _tuples(_most_frequent(counts.where(F.length("w") <= LONGEST), words // len(langs), "w").select("lang", "w", "c"))
        marked = F.concat(F.lit("^"), "w", F.lit("$"))

        def entry(n: int):  # a lambda of one parameter: a second one would be the place in the array
            return lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"))

        cut = [F.transform(F.regexp_extract_all(F.col("w") if n == 1 else marked, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)), entry(n)) for n in ORDERS]
        pieces = counts.select("lang", "c", F.inline(F.concat(*cut))).groupBy("lang", "n", "g").agg(F.sum("c").alias("c"))
        pieces = pieces.persist(StorageLevel.DISK_ONLY)
        sums = {(r["lang"], r["n"]): (r["s"], r["k"]) for r in pieces.groupBy("lang", "n").agg(F.sum("c").alias("s"), F.count("*").alias("k")).collect()}
        kept = _tuples(_most_frequent(pieces, grams // len(langs), "n", "g").select("lang", "g", "c"))
        pieces.unpersist()
    finally:
        counts.unpersist()
    row = {lang: i for i, lang in enumerate(langs)}

    def matrix(entries, mass):
        """Log frequency of every entry in every language; what a language lacks counts as half an occurrence."""
        index = {k: i for i, k in enumerate(sorted({k for _, k, _ in entries}))}
        m = np.empty((len(index), len(langs)), np.float32)
        for k, i in index.items():
            for lang, j in row.items():
                n, kinds = mass(k, lang)
                m[i, j] = math.log(0.5 / (n + 0.5 * kinds + 1))
        for lang, k, c in entries:
            n, kinds = mass(k, lang)
            m[index[k], row[lang]] = math.log((c + 0.5) / (n + 0.5 * kinds + 1))
        return index, m

    word_index, word_m = matrix(top, lambda _, lang: total.get(lang, (0, 0)))
    gram_index, gram_m = matrix(kept, lambda g, lang: sums.get((lang, len(g)), (0, 0)))
    return {"langs": langs, "words": (word_index, word_m), "grams": (gram_index, gram_m)}


class Scorer:
    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.words, self.word_m = model["words"]
        self.grams, self.gram_m = model["grams"]
        self.cap = max(1000, min(CACHE_WORDS, CACHE_BYTES // (4 * len(self.langs))))
        self.find = re.compile(r"[^\W\d_]+").findall
        self.reset()

    def reset(self):
        self.known: dict[str, int] = {}
        self.m = np.zeros((self.cap + 1, len(self.langs)), np.float32)

    def word(self, w: str):
        """Scores of one word in all languages; None if it has no letter."""
        if (i := self.words.get(w)) is not None:
            return self.word_m[i]
        if not any(map(str.isalpha, w)):
            return None
        marked = f"^{w}$"
        for n in ORDERS:
            s = w if n == 1 else marked
            hits = [i for k in range(len(s) - n + 1) if (i := self.grams.get(s[k : k + n])) is not None]
            if hits:
                return self.gram_m[hits].mean(0)
        return np.zeros(len(self.langs), np.float32)

    def rows(self, words: list[str]) -> list[int]:
        """Each word's row in the cache; 0 for none."""
        new = {w for w in words if w not in self.known}
        if len(self.known) + len(new) > self.cap:
            self.reset()
            new = set(words)
        if len(new) > self.cap:  # one text with more distinct words than the cache holds
            return []
        for w in new:
            s = self.word(w)
            if s is None:
                self.known[w] = 0
            else:
                i = len(self.known) + 1
                self.known[w] = i
                self.m[i] = s
        return list(map(self.known.__getitem__, words))

    def text(self, text: str | None) -> tuple[str, float]:
        words = self.find(text.lower()) if text else []
        total, lettered = np.zeros(len(self.langs)), False
        for k in range(0, len(words), self.cap):
            at = np.array(self.rows(words[k : k + self.cap]), np.int64)
            lettered |= bool(at.any())
            total += self.m[at].sum(0, dtype=np.float64)
        if not lettered or not self.langs:
            return "und", 0.0
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score of every whole text; only the text enters the prediction. doc_id can be of any type."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most WORDS + GRAMS entries
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        model = shared.value
        scorer = held(("langid", id(model)), lambda: Scorer(model) if model["langs"] else None)
        for b in batches:
            out = [scorer.text(t) if scorer else ("und", 0.0) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return spread_out(docs.select("doc_id", "text")).mapInArrow(run, schema)


def keep_recognised(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has a letter, so that its language can be told by a model of their own labels. Without
    labels to learn from, all such rows stay as well."""
    whole = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    model = fit(docs)
    if not model["langs"]:
        none = {}, np.zeros((0, 1), np.float32)
        model = {"langs": ["unknown"], "words": none, "grams": none}
    return predict(whole, model).where("lang_pred != 'und'").select("doc_id.*")


def op3_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
