"""Associative memory as DataFrame operators: strength folds, co-access links, recall with spreading activation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import memory as M


def fold(rows: DataFrame, log: DataFrame) -> DataFrame:
    """_rid, strength, access_count, last of every row.

    rows: _rid, strength0, access0, last0. log: _rid, ts (seconds), seq, kind (touch or reset), boost.
    A row's strength is the sum of its boosts, each decayed since its time, from its last reset on. Only where the
    undecayed sum could pass the ceiling, the events are folded one by one in order; nothing else is gathered.
    """
    last_reset = F.max(F.when(F.col("kind") == "reset", F.col("seq")))
    resets = log.where("kind = 'reset'").groupBy("_rid").agg(last_reset.alias("reset_seq"), F.max(F.struct("seq", "ts"))["ts"].alias("reset_ts"))
    tagged = log.join(resets, "_rid", "left")
    live = (F.col("kind") == "touch") & (F.col("reset_seq").isNull() | (F.col("seq") > F.col("reset_seq")))
    sums = tagged.groupBy("_rid").agg(
        F.count(F.when(F.col("kind") == "touch", 1)).alias("touches"),
        F.max("ts").alias("last_ts"),
        F.sum(F.when(live, F.col("boost"))).alias("most"),
        F.max("reset_seq").alias("reset_seq"),
        F.max("reset_ts").alias("reset_ts"),
    )
    state = rows.join(sums, "_rid", "left")
    end = F.greatest("last0", F.coalesce("last_ts", F.col("last0")))
    state = state.withColumn("end", end)
    # decayed to each row's last event
    touches = tagged.where(live).join(state.select("_rid", "end"), "_rid")
    decays = touches.groupBy("_rid").agg(F.sum(F.col("boost") * F.pow(F.lit(2.0), -(F.col("end") - F.col("ts")).cast("double") / M.HALF_LIFE)).alias("gained"))
    state = state.join(decays, "_rid", "left")
    kept = F.when(F.col("reset_seq").isNull(), F.col("strength0") * F.pow(F.lit(2.0), -(F.col("end") - F.col("last0")).cast("double") / M.HALF_LIFE)).otherwise(F.lit(0.0))
    state = state.withColumn("closed", kept + F.coalesce("gained", F.lit(0.0)))
    crowded = F.coalesce(F.col("most"), F.lit(0.0)) + F.when(F.col("reset_seq").isNull(), F.col("strength0")).otherwise(0.0) > M.MAX_STRENGTH
    state = state.withColumn("crowded", crowded)
    events = log.join(state.where("crowded").select("_rid", "strength0", "last0"), "_rid")
    exact = events.groupBy("_rid", "strength0", "last0").agg(F.array_sort(F.collect_list(F.struct("seq", "ts", "kind", "boost"))).alias("es"))

    def step(acc: Column, e: Column) -> Column:
        now = F.greatest(acc["last"], e["ts"])
        s = acc["s"] * F.pow(F.lit(2.0), -(now - acc["last"]).cast("double") / M.HALF_LIFE)
        s = F.when(e["kind"] == "reset", F.lit(0.0)).otherwise(F.least(s + e["boost"], F.lit(M.MAX_STRENGTH)))
        return F.struct(s.alias("s"), now.alias("last"))

    begin = F.struct(F.col("strength0").cast("double").alias("s"), F.col("last0").alias("last"))
    exact = exact.select("_rid", F.aggregate("es", begin, step)["s"].alias("folded"))
    state = state.join(exact, "_rid", "left")
    return state.select(
        "_rid",
        F.coalesce("folded", "closed").alias("strength"),
        (F.col("access0") + F.coalesce("touches", F.lit(0))).cast("long").alias("access_count"),
        F.col("end").alias("last"),
    )


def co_access(groups: DataFrame, group: list[str], member: str, order: list[str], boost: float = M.LINK_BOOST) -> DataFrame:
    """a, b, w of all pairs of the first CO_ACCESS members of each group, summed over groups up to LINK_MAX."""
    first = groups.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= M.CO_ACCESS)
    few = first.groupBy(*group).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(member).alias("m")))), lambda x: x["m"])).alias("ms"))
    pairs = few.select(F.explode("ms").alias("a"), "ms").select("a", F.explode("ms").alias("b")).where("a < b")  # 66 pairs of a group at most
    return pairs.groupBy("a", "b").agg(F.least(F.lit(M.LINK_MAX), F.count("*") * F.lit(boost)).alias("w"))


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b", "w").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def neighbours(links: DataFrame, rid: int) -> DataFrame:
    """rid, w of all rows linked with a row."""
    n = F.when(F.col("a") == rid, F.col("b")).otherwise(F.col("a"))
    return links.where((F.col("a") == rid) | (F.col("b") == rid)).select(n.alias("rid"), "w")


def prune(links: DataFrame) -> DataFrame:
    """All weights halved; what is weak then goes."""
    return links.withColumn("w", F.col("w") * 0.5).where(F.col("w") >= M.LINK_DROP)


def without(links: DataFrame, rids: DataFrame) -> DataFrame:
    """Links that touch none of the rows (column _rid)."""
    gone = rids.select("_rid").distinct()
    return links.join(gone, links["a"] == gone["_rid"], "left_anti").join(gone, F.col("b") == gone["_rid"], "left_anti")


def hits(rows: DataFrame, phrase: str, texts: list[str], key: str, strength: Column, accesses: Column) -> DataFrame:
    """rows that have any term of the phrase, with lex and base score."""
    lex = M.lexical(phrase, [F.col(f"`{t}`").cast("string") for t in texts])
    found = rows.withColumn("_lex", lex).where("_lex > 0")
    return found.withColumn("_base", M.familiar(F.col("_lex"), strength, accesses))


def spread(found: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """found with _score: its base, and of every linked hit that hit's lexical score times weight times SPREAD."""
    give = found.select(F.col(key).alias("a"), F.col("_lex").alias("_given"))
    gain = both_ways(links).join(give, "a").groupBy(F.col("b").alias("_to")).agg(F.sum(F.col("_given") * F.col("w") * M.SPREAD).alias("_gain"))
    return found.join(gain, found[key] == gain["_to"], "left").withColumn("_score", F.col("_base") + F.coalesce("_gain", F.lit(0.0))).drop("_to", "_gain")
