"""Exact top-k by inner product with M-trees.

Inner products become distances: with M the largest norm, candidate x is the point
``(x, sqrt(M^2 - |x|^2))`` and query q the point ``(q, 0)``; their squared distance is
``|q|^2 + M^2 - 2 q.x``, so the nearest points have the highest scores.

The top level is a set of at most ``MAX_PIVOTS`` routing objects with covering radii; below each, chunks
of bounded size hold one paged M-tree each. A query first searches the chunks of its nearest routing
object; the k-th score found there bounds the search. It then visits only the chunks whose routing
object's distance less its radius is within that bound. In a tree, best-first search takes the node
with the smallest possible distance from a queue. Entries carry their distance to the parent's
routing object: by the triangle inequality, an entry with ``|d(q, parent) - d(entry, parent)| - radius``
beyond the bound is passed over without computing its distance. Bounds have slack for rounding; scores are
integers, computed exactly.

Queries are packed in blocks, so a task holds one chunk and one block of queries. Only pivots, radii and
counts of the cells come to the driver.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; a null
id takes no part either; a query never meets a row of its own id; fewer candidates than k give fewer
rows; vectors of another length than the query's are no candidates; repeated candidate rows each
count; repeated query ids are one query (the smallest vector); other columns are ignored. Components must be
below 2^26, so that scores fit a long.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage, table
from .vectors import SLACK, chunk_rows, deal, distances, sample, stack, valid

FANOUT, LEAF = 16, 256
QUERY_BLOCK = 2048


class MTree:
    """Bulk-loaded tree over points; a page holds its entries' points, radii and distances to the parent."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.pages: list[tuple] = []  # (indexes of points or pages, points, radii, distances to the page's routing object)
        self.root = self._build(np.arange(len(points)), None)

    def _build(self, at: np.ndarray, centre: np.ndarray | None) -> int:
        if len(at) <= LEAF:
            p = self.points[at]
            up = distances(p, centre[None])[:, 0] if centre is not None else np.zeros(len(at))
            self.pages.append((True, at, np.ascontiguousarray(p[:, :-1]), 0.0, up))
            return len(self.pages) - 1
        # routing objects by farthest-first choice, entries to the nearest one
        chosen = [0]
        d = distances(self.points[at], self.points[at[:1]])[:, 0]
        while len(chosen) < FANOUT and d.max() > 0:
            chosen.append(int(d.argmax()))
            d = np.minimum(d, distances(self.points[at], self.points[at[chosen[-1:]]])[:, 0])
        near = distances(self.points[at], self.points[at[chosen]])
        group, entries = near.argmin(1), []
        if len(chosen) == 1:  # all points are equal
            entries = [(part, chosen[0], 0) for part in np.array_split(np.arange(len(at)), math.ceil(len(at) / LEAF))]
        else:
            entries = [(np.nonzero(group == g)[0], c, g) for g, c in enumerate(chosen)]
        pages, routing, radii = [], [], []
        for part, c, g in entries:
            p = self.points[at[c]]
            pages.append(self._build(at[part], p))
            routing.append(p)
            radii.append(near[part, g].max())
        routing = np.stack(routing)
        up = distances(routing, centre[None])[:, 0] if centre is not None else np.zeros(len(routing))
        self.pages.append((False, np.array(pages), routing, np.array(radii), up))
        return len(self.pages) - 1

    def search(self, q: np.ndarray, bound: float, slack: float, visit) -> int:
        """Best-first. visit(indexes, points) takes leaf entries, without their last coordinate, and returns the new
        bound; returns how many distances were computed."""
        queue, computed = [(0.0, self.root, None)], 0
        while queue:
            least, page, to_parent = heapq.heappop(queue)
            if least > bound + slack:
                break
            leaf, index, points, radii, up = self.pages[page]
            if to_parent is not None:
                open_ = np.abs(to_parent - up) - radii <= bound + slack
                if not open_.all():
                    index, points = index[open_], points[open_]
                    radii = 0.0 if leaf else radii[open_]
            if not len(index):
                continue
            computed += len(index)
            if leaf:
                bound = visit(index, points)
                continue
            d = np.sqrt(((points - q) ** 2).sum(1))
            for e, r, x in zip(index.tolist(), radii.tolist(), d.tolist(), strict=True):
                if x - r <= bound + slack:
                    heapq.heappush(queue, (max(0.0, x - r), e, x))
        return computed


def lift(v: np.ndarray, m2: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(m2 - (v * v).sum(1), 0))[:, None]], 1)


def search_chunk(ids: np.ndarray, v: np.ndarray, query_ids, queries, floors, m2: float, k: int):
    """(query, vec, score) of the k best of a chunk for each query, of those at least at the query's floor."""
    tree = MTree(lift(v, m2))
    slack = SLACK * (1 + math.sqrt(m2))
    exact = np.float64 if m2 < 1 << 52 else object  # sums of whole numbers below 2^53 are exact in doubles
    for qid, q, floor in zip(query_ids, queries, floors, strict=True):
        if exact is object:
            whole = np.array([int(x) for x in q], object)
        q2 = float(q @ q)
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        top = q2 + m2
        start = math.inf if floor is None else math.sqrt(max(0.0, top - 2 * floor))
        worst = -math.inf if floor is None else floor

        def visit(index, points):
            nonlocal worst
            scores = points @ q if exact is np.float64 else np.array([int(whole @ [int(x) for x in p]) for p in points], object)
            near = np.nonzero(scores >= worst)[0]
            if len(near):
                for s, x in zip(scores[near].tolist(), ids[index[near]].tolist(), strict=True):
                    if x == qid:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (int(s), -x))
                    elif (s, -x) > best[0]:
                        heapq.heapreplace(best, (int(s), -x))
                if len(best) == k:
                    worst = best[0][0]
            return min(start, math.sqrt(max(0.0, top - 2 * best[0][0]))) if len(best) == k else start

        tree.search(np.append(q, 0.0), start, slack + SLACK * math.sqrt(q2), visit)
        for s, x in best:
            yield qid, -x, s


def _pack(t: pa.Table) -> pa.Table:
    ids = np.array(t.column("id"), np.int64)
    return pa.table({"chunk": t.column("chunk")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "v": pa.array([b"".join(t.column("v").to_pylist())], pa.binary())})


def _search(dim: int, m2: float, k: int):
    """A group's rows: one with ids (the chunk), the others one query each."""

    def run(t: pa.Table) -> pa.Table:
        packed, v = t.column("ids").to_pylist(), t.column("v").to_pylist()
        at = [i for i, x in enumerate(packed) if x is not None]
        rest = [i for i, x in enumerate(packed) if x is None]
        found = []
        if at and rest:
            qid, floor = t.column("qid").to_pylist(), t.column("floor").to_pylist()
            found = search_chunk(
                np.frombuffer(packed[at[0]], np.int64), stack([v[at[0]]], dim), [qid[i] for i in rest],
                stack([v[i] for i in rest], dim), [floor[i] for i in rest], m2, k,
            )
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for rows whose vec_id is divisible by ``every``, against all other rows."""
    spark = vectors.sparkSession
    bound_batches(spark)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = valid(vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding")).where("id is not null").select("id", whole.alias("x"))

    def to_bytes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(x).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["id", "v"])

    points = cut_lineage(rows.mapInArrow(to_bytes, "id long, v binary"))
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for r in points.groupBy(F.octet_length("v").alias("size")).count().orderBy("size").collect():
        same = points.where(F.octet_length("v") == r["size"])
        found = found.union(_top_k(same, r["count"], r["size"] // 8, k, every))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _norms(batches):
    for b in batches:
        m = max((float((np.frombuffer(x) ** 2).sum()) for x in b.column(0).to_pylist()), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([m])], ["m"])


def _top_k(points: DataFrame, n: int, dim: int, k: int, every: int) -> DataFrame:
    spark = points.sparkSession
    m2 = points.select("v").mapInArrow(_norms, "m double").agg(F.max("m")).first()[0]
    pivots = lift(np.stack([np.frombuffer(x) for x in sample(points, n)]), m2)
    dealt = cut_lineage(deal(points, lambda v: lift(v, m2), pivots))
    rows = chunk_rows(n)
    cells = {r["cell"]: (math.ceil(r["c"] / rows), r["r"]) for r in dealt.groupBy("cell").agg(F.count("*").alias("c"), F.max("dist").alias("r")).collect()}
    split = spark.createDataFrame([(c, x[0]) for c, x in cells.items()], "cell long, n long")
    chunk = (F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("id", "v"), F.col("n"))).alias("chunk")
    packed = cut_lineage(
        dealt.join(split, "cell").select("id", "v", chunk).groupBy("chunk").applyInArrow(_pack, "chunk long, ids binary, v binary")
    )
    asked = dealt.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("v", "cell")).alias("s"))
    asked = cut_lineage(asked.select(F.col("id").alias("qid"), "s.v", "s.cell"))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    nothing = F.lit(None)

    def answer(routed: DataFrame) -> DataFrame:
        """routed: qid, v, floor, chunk."""
        block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("long").alias("block")
        held = packed.select(
            "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "ids", "v",
            nothing.cast("long").alias("qid"), nothing.cast("long").alias("floor"),
        )
        come = routed.select("chunk", block, nothing.cast("binary").alias("ids"), "v", "qid", "floor")
        return held.union(come).groupBy("chunk", "block").applyInArrow(_search(dim, m2, k), "query_id long, vec_id long, score long")

    own = asked.join(split, "cell").select(
        "qid", "v", nothing.cast("long").alias("floor"),
        F.explode(F.sequence(F.col("cell") * (1 << 32), F.col("cell") * (1 << 32) + F.col("n") - 1)).alias("chunk"),
    )
    first = cut_lineage(answer(own))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = first.withColumn("i", F.row_number().over(best)).where(F.col("i") == k).select(F.col("query_id").alias("qid"), F.col("score").alias("floor"))
    ready = asked.join(floors, "qid", "left").select("qid", "v", "cell", "floor")
    shared = spark.sparkContext.broadcast((pivots, cells))

    def route(batches):
        """Chunks of all cells but the query's own that the bound does not exclude."""
        p, cs = shared.value
        names = sorted(cs)
        radii = np.array([cs[c][1] for c in names])
        for b in batches:
            qid, v, cell, floor = (c.to_pylist() for c in b.columns)
            out = [[], [], [], []]
            for i in range(len(qid)):
                q = np.frombuffer(v[i])
                q2 = float((q * q).sum())
                gap = distances(np.append(q, 0.0)[None], p[names])[0] - radii
                reach = math.inf if floor[i] is None else math.sqrt(max(0.0, q2 + m2 - 2 * floor[i]))
                near = gap <= reach + SLACK * (1 + math.sqrt(m2) + math.sqrt(q2))
                for c, go in zip(names, near.tolist(), strict=True):
                    if go and c != cell[i]:
                        for x in range(cs[c][0]):
                            for column, value in zip(out, (qid[i], v[i], floor[i], c * (1 << 32) + x), strict=True):
                                column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["qid", "v", "floor", "chunk"])

    return first.union(answer(ready.mapInArrow(route, "qid long, v binary, floor long, chunk long")))


def op9_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))
