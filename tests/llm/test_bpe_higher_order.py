"""Operator 2 beside a second version of it, made of Spark's higher-order functions alone over a literal rank map.

Both give the same ids. The README states why the query doesn't run this one: its cost for each text, and pieces of many bytes,
whose fold takes a step for each byte and a look-up for each pair left in every step.
"""

import json
import zlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from engram.llm import bpe

BUCKETS = 1 << 16


def literal_ranks(ranks):
    """The rank map as one literal: hash buckets of about one token each, so that a look-up takes constant time."""
    buckets = [{} for _ in range(BUCKETS)]
    for t, r in ranks.items():
        s = t.decode("latin-1")
        buckets[zlib.crc32(s.encode()) % BUCKETS][s] = r
    spark = SparkSession.getActiveSession()
    jvm = spark._jvm
    kind = "array<map<string,int>>"
    row = spark.range(1).select(F.from_json(F.lit(json.dumps(buckets)), kind))._jdf.queryExecution().executedPlan().executeCollect()[0]
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(row.getArray(0), jvm.org.apache.spark.sql.types.DataType.fromDDL(kind))
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def encode(docs, rank_file, pattern):
    """doc_id, ids: each distinct piece of a text starts as its bytes and folds the adjacent pair of the lowest rank, one pair a step."""
    with open(rank_file, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    table = literal_ranks(ranks)

    def rank(s):
        return F.get(table, F.pmod(F.crc32(s.cast("binary")), F.lit(BUCKETS)).cast("int"))[s]

    def step(parts, _):
        pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(rank(F.concat(parts[i - 1], parts[i])).alias("r"), i.alias("i")))
        best = F.array_min(F.filter(pairs, lambda p: p["r"].isNotNull()))
        merged = F.transform(F.array(best), lambda b: F.when(b.isNull(), parts).otherwise(
            F.concat(F.slice(parts, 1, b["i"] - 1), F.array(F.concat(parts[b["i"] - 1], parts[b["i"]])), F.slice(parts, b["i"] + 2, F.size(parts)))))
        return F.when(F.size(parts) < 2, parts).otherwise(merged[0])

    def fold(w):
        s = F.decode(F.encode(w, "UTF-8"), "ISO-8859-1")
        return F.transform(F.array(s), lambda s: F.when(rank(s).isNotNull(), F.array(rank(s))).otherwise(
            F.transform(F.aggregate(F.sequence(F.lit(2), F.length(s)), F.split(s, ""), step), rank)))[0]

    cut = docs.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?U)" + pattern), F.lit(0)).alias("p"))
    def bind(value, use):  # a value worked out once for each row, however often it is used
        return F.transform(F.array(value), use)[0]

    ids = bind(F.col("p"), lambda p: bind(F.array_distinct(p), lambda d: bind(F.transform(d, fold), lambda c: F.flatten(F.transform(p, lambda x: c[F.array_position(d, x).cast("int") - 1])))))
    return cut.select("doc_id", ids.alias("ids"))


def test_bpe_equals_higher_order_fold(spark):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    odd = [(1, None), (2, ""), (3, "same same"), (3, "same same"), (None, "no id"), (5, "don't  stop\n\n \u00e9t\u00e9 \u4e2d\u6587 123 !?  "), (6, "x" * 300)]
    for docs in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), spark.createDataFrame(odd, "doc_id long, text string")):
        own = [(str(r["doc_id"]), [int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)]) for r in bpe.encode(docs, path, P.PATTERN).collect()]
        assert sorted(own) == sorted((str(r["doc_id"]), list(r["ids"])) for r in encode(docs, path, P.PATTERN).collect())
