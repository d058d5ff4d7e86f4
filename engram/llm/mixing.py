"""Mixing sources to target weights: temperature, then budgeted block permutations.

*Weights.* A source with token share p gets the weight ``p^a / sum of p^a``. The exponent ``a`` is the one
that meets a target entropy (as a share of the most there can be, log of the number of sources), or
the smallest one (the flattest mixture) whose most repeated source stays within a repetition limit. It is
bisected: every round evaluates ``POINTS`` exponents in one aggregate over the table of sources, so the sources, however
many, stay distributed.

*Realisation.* A source's budget is its weight times the token budget. Its documents lie in blocks of about
``BLOCK_ROWS`` rows by a hash. Every pass over the source (epoch) permutes its blocks anew; the budget
takes whole passes, then a stretch of whole blocks, and of the next block the documents with the smallest order
keys up to the one that meets the budget. So each source is within one document of its budget (copies of one
row in the last place share its fate). Only the small block table is ordered; of the documents only
those of each source's last block. Documents join the block table by source and block; the block table
is broadcast only if counted to be small, else both sides are shuffled.

Defined results: a null source is one source of its own; null and empty texts count no tokens, and a source
without tokens is left out, as it has weight 0; repeated rows count and are taken as rows of their own;
an empty table gives an empty result; other columns pass through ``realise`` inside of ``row``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table

POINTS, ROUNDS = 24, 4
#: Where sources are so nearly equal that no exponent up to this one meets a target entropy, it is the one that is taken.
MOST_EXPONENT = 16.0**4
BLOCK_ROWS, MAX_BLOCKS = 256, 1 << 16
#: Rows of the block table up to which it is broadcast (about 100 bytes each).
BROADCAST_ROWS = 100_000
SEED = 17


def tokens(text: str = "text") -> Column:
    """Runs of characters other than white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_sk")


def _order_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.crc32(F.coalesce(F.col("text"), F.lit("")))).alias("_key")


def source_table(docs: DataFrame) -> DataFrame:
    """_sk, t (tokens), rows, blocks of every source."""
    blocks = F.least(F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.lit(1)), F.lit(MAX_BLOCKS)).cast("long")
    sums = docs.select(_source_key(), tokens().alias("t")).groupBy("_sk").agg(F.sum("t").alias("t"), F.count("*").alias("rows"))
    return sums.withColumn("blocks", blocks)


def _measures(sources: DataFrame, total: int, exponents: list[float]) -> list[dict]:
    """For every exponent: normaliser z, entropy, and the extremes of weight over share."""
    p = F.col("t") / float(total)
    cols = []  # of shares below one, high powers fade to 0: there the sums are those of the largest sources, as they should be
    for i, a in enumerate(exponents):
        w = F.pow(p, F.lit(a))
        cols += [
            F.sum(w).alias(f"z{i}"), F.sum(w * F.log(p)).alias(f"l{i}"),
            F.max(F.pow(p, F.lit(a - 1))).alias(f"h{i}"), F.min(F.pow(p, F.lit(a - 1))).alias(f"m{i}"),
        ]
    r = sources.where("t > 0").agg(*cols).first()
    return [
        {"a": a, "z": r[f"z{i}"], "entropy": math.log(r[f"z{i}"]) - a * r[f"l{i}"] / r[f"z{i}"], "high": r[f"h{i}"], "low": r[f"m{i}"]}
        for i, a in enumerate(exponents)
    ]


def bisect_exponent(sources: DataFrame, total: int, reached, low: float, high: float) -> float:
    """The smallest exponent for which reached(measures) holds; it must be monotone, from false to true."""
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / POINTS for i in range(POINTS + 1)]
        for m in _measures(sources, total, points):
            if reached(m):
                high = m["a"]
                break
            low = m["a"]
        else:
            return high
        if high == points[0]:
            return high
    return high


def temperature(sources: DataFrame, total: int, budget: float | None, entropy: float | None, repeats: float | None) -> tuple[float, float, float]:
    """(exponent, normaliser, budget in tokens). Without a budget: the smallest one that takes every source whole."""
    kinds = sources.where("t > 0").count()
    if entropy is not None:
        goal = entropy * math.log(kinds) if kinds > 1 else 0.0
        met = lambda m: m["entropy"] <= goal + 1e-12
        high = 16.0
        while kinds > 1 and high < MOST_EXPONENT and not met(_measures(sources, total, [high])[0]):
            high *= 16
        a = bisect_exponent(sources, total, met, 0.0, high) if kinds > 1 else 1.0
    else:
        most = math.inf if repeats is None else repeats

        def within(m):
            took = m["high"] / m["low"] if budget is None else budget / total * m["high"] / m["z"]
            return took <= most * (1 + 1e-12)

        a = bisect_exponent(sources, total, within, 0.0, 1.0)
    m = _measures(sources, total, [a])[0]
    return a, m["z"], float(budget) if budget is not None else total * m["z"] / m["low"]


def plan(docs: DataFrame, budget: float | None = None, entropy: float | None = None, repeats: float | None = 4.0) -> tuple[DataFrame, DataFrame]:
    """(sources, taken): sources has _sk, t, rows, blocks, weight, budget; taken has _sk, block, epoch, at, cut:
    the block comes in that epoch, after ``at`` tokens of its source, up to the order key ``cut`` (null: whole)."""
    if (entropy is None) == (repeats is None):
        raise ValueError("give a target entropy or a repetition limit")
    docs = docs.select("doc_id", "source", "text")
    sources = cut_lineage(source_table(docs))
    total = sources.agg(F.sum("t")).first()[0] or 0
    if not total:
        none = sources.where("false")
        return none.withColumns({"weight": F.lit(0.0), "budget": F.lit(0.0)}), none.select(
            "_sk", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("epoch"), F.lit(0.0).alias("at"), F.lit(0).cast("long").alias("cut")
        )
    a, z, whole = temperature(sources, total, budget, entropy, repeats)
    weight = F.pow(F.col("t") / float(total), F.lit(a)) / z
    # a budget that is a whole number of passes but for rounding is that number
    passes = F.col("budget") / F.col("t")
    passes = F.when(F.abs(passes - F.round(passes)) < 1e-9, F.round(passes)).otherwise(passes)
    sources = sources.where("t > 0").withColumn("weight", weight).withColumn("budget", F.col("weight") * whole).withColumn("passes", passes)
    sources = cut_lineage(sources.withColumn("left", (F.col("passes") - F.floor("passes")) * F.col("t")))

    sums = blocked(docs, sources).select("_sk", "_block", tokens().alias("t")).groupBy("_sk", "_block").agg(F.sum("t").alias("bt"))
    grid = sums.join(sources.select("_sk", "t", "passes", "left"), "_sk")
    grid = grid.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor("passes"))))
    order = Window.partitionBy("_sk", "epoch").orderBy(F.xxhash64(F.lit(SEED), "epoch", "_block"), "_block")
    grid = grid.withColumn("before", F.sum("bt").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bt"))
    last = F.col("epoch") == F.floor("passes")
    grid = cut_lineage(grid.where(~last | (F.col("before") < F.col("left"))))
    partial = last & (F.col("before") + F.col("bt") > F.col("left"))

    # documents of each source's last, broken block: at most one block a source
    broken = grid.where(partial).select("_sk", "_block", "before", "left")
    inside = blocked(docs, sources).select("_sk", "_block", "_key", tokens().alias("t")).join(_small(broken), ["_sk", "_block"])
    by_key = inside.groupBy("_sk", "_block", "_key", "before", "left").agg(F.sum("t").alias("t"))
    run = F.sum("t").over(Window.partitionBy("_sk", "_block").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0))
    cuts = by_key.withColumn("start", F.col("before") + run - F.col("t")).where("start < left")
    cuts = cuts.groupBy("_sk", "_block").agg(F.max("_key").alias("cut")).withColumn("partial", F.lit(True))
    taken = grid.withColumn("partial", partial).join(cuts, ["_sk", "_block", "partial"], "left")
    at = F.col("epoch") * F.col("t") + F.col("before")
    return sources, cut_lineage(taken.select("_sk", F.col("_block").alias("block"), "epoch", at.cast("double").alias("at"), "cut"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if counted to be small; else left to a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def blocked(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """row (all columns), text, _sk, _key and _block of docs; rows of sources without tokens are gone."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "text", _source_key(), _order_key())
    keyed = keyed.join(_small(sources.select("_sk", "blocks")), "_sk")
    return keyed.select("row", "text", "_sk", "_key", F.pmod(F.xxhash64(F.lit(SEED), "_key"), F.col("blocks")).alias("_block"))


def realise(docs: DataFrame, sources: DataFrame, taken: DataFrame) -> DataFrame:
    """row (a struct of the columns of docs), as often as the mixture takes it, with _sk, _key, _epoch, _block and _at."""
    t = taken.select("_sk", F.col("block").alias("_block"), F.col("epoch").alias("_epoch"), F.col("at").alias("_at"), F.col("cut").alias("_cut"))
    rows = blocked(docs, sources).join(_small(t), ["_sk", "_block"])
    return rows.where(F.col("_cut").isNull() | (F.col("_key") <= F.col("_cut"))).drop("_cut")


def mix(docs: DataFrame, budget: float | None = None, entropy: float | None = None, repeats: float | None = 4.0) -> DataFrame:
    """doc_id, source, tokens, weight, epoch, block, place, key of every realised document.

    ``place`` is the share of the source's budget before the block; by (place, key) all sources run side by side
    in proportion to their weights.
    """
    narrow = docs.select("doc_id", "source", "text")
    sources, taken = plan(narrow, budget, entropy, repeats)
    weights = sources.select("_sk", "weight", "budget")
    rows = realise(narrow, sources, taken).join(_small(weights), "_sk")
    return rows.select(
        "row.doc_id", "row.source", tokens().alias("tokens"), "weight", F.col("_epoch").cast("int").alias("epoch"), F.col("_block").alias("block"),
        (F.col("_at") / F.col("budget")).alias("place"), F.col("_key").alias("key"),
    )


def op4_mixing(spark, sf_dir):
    """Mixture with 0.95 of the greatest entropy, as many tokens as the corpus has."""
    docs = table(spark, sf_dir, "documents")
    total = docs.agg(F.sum(tokens())).first()[0] or 0
    return mix(docs, budget=total, entropy=0.95, repeats=None)
