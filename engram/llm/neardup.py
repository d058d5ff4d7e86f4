"""Near duplicates among embeddings, exact, by int8 tile products.

Equal vectors are one class. Classes go to metric cells (nearest of at most ``MAX_PIVOTS`` pivots, by whole-number products, so that
copies agree wherever they are) and
cells to chunks of bounded size. Two chunks meet in a tile unless the triangle inequality shows that
their cells are too far apart. Vectors move and are written once, to their chunks, in the width they came in; tiles read the written chunks
by a Cartesian product of their partitions, which neither shuffles nor writes. A tile quantises its unit vectors to int8 with one scale for each
chunk; the product of the codes is exact. With the measured quantisation errors ``e`` (norm of what
rounding took off each vector), a cosine differs from the scaled product by at most
``e_x + e_y + e_x * e_y``. Only pairs that may thus reach the threshold, and aren't sure to, are recomputed in doubles. A
tile is worked through in strips of rows, so that its memory doesn't depend on how many of its pairs link.

The tiles of a task return one spanning forest and link counts, never pairs; components of the forest are the result.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing (n_links 0, their own component); vectors of different lengths don't link; a null id never
names a component; copies count as links; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage, park, remove, table, write_out
from .components import components
from .vectors import MAX_PIVOTS, SLACK, chunk_rows, valid

THRESHOLD = 0.95


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow or underflow of squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Codes in -127..127, their common scale, and a bound of each row's error norm."""
    scale = 127 / np.abs(u).max()
    q = np.rint(u * scale)
    e = np.sqrt(((u - q / scale) ** 2).sum(1)) + 1e-12
    return q.astype(np.int8), scale, e


def int_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of int8 codes: float32 holds integers below 2^24, float64 below 2^53."""
    kind = np.float32 if 127 * 127 * a.shape[1] < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


#: Cells of a strip of a tile: so many products, and candidate pairs, are held at once.
STRIP_CELLS, PAIRS = 1 << 20, 1 << 14


def tile_links(a: np.ndarray, b: np.ndarray | None, threshold: float):
    """Yields (i, js) for rows i of unit vectors a and the rows js of b (without b: the later ones of a) with cosine >= threshold. Works
    through strips of rows: however many pairs link, no more than a strip's are held. Pairs that the bounds put beyond the threshold
    need no second look, pairs that may reach it are recomputed in doubles."""
    other = a if b is None else b
    (qa, sa, ea), (qb, sb, eb) = quantise(a), quantise(other)
    step = max(1, STRIP_CELLS // max(1, len(other)))
    for at in range(0, len(a), step):
        rows = slice(at, at + step)
        g = int_product(qa[rows], qb) / (sa * sb)
        slack = ea[rows, None] + eb + ea[rows, None] * eb + 1e-9
        maybe = g + slack >= threshold
        if b is None:
            maybe &= np.arange(len(other)) > np.arange(at, at + len(g))[:, None]
        hit = maybe & (g - slack >= threshold)
        i, j = np.nonzero(maybe & ~hit)
        for k in range(0, len(i), PAIRS):
            p, q = i[k : k + PAIRS], j[k : k + PAIRS]
            hit[p, q] = (a[at + p] * other[q]).sum(1) >= threshold
        for r in np.nonzero(hit.any(1))[0]:
            yield at + int(r), np.nonzero(hit[r])[0]


def tile_forest(a: np.ndarray, b: np.ndarray | None, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of a, then those of b: the smallest row that each reaches, and the copies of all rows it links with."""
    first = 0 if b is None else len(a)
    root, links = np.arange(len(copies)), np.zeros(len(copies), np.int64)
    for i, js in tile_links(a, b, threshold):
        js = js + first
        links[i] += copies[js].sum()
        links[js] += copies[i]
        own = np.unique(root[np.append(js, i)])
        if len(own) > 1:
            root[np.isin(root, own)] = own[0]
    return root, links


def _rows(column: pa.Array, kind: str) -> list[bytes]:
    """Each list's numbers as bytes; -0.0 and 0.0 are one value."""
    flat = (np.asarray(column.flatten().cast(pa.float32() if kind == "f4" else pa.float64())) + np.dtype(kind).type(0)).tobytes()
    at = (np.asarray(column.offsets).astype(np.int64) - column.offsets[0].as_py()) * np.dtype(kind).itemsize
    return [flat[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def matrix(blobs: list[bytes], kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(-1, dim).astype(np.float64)


#: Length of the whole-number vectors by which cells are chosen: sums of their products stay below 2^53, so that no order of adding changes them.
CODE = 1 << 25


def pivot_codes(pivots: np.ndarray) -> np.ndarray:
    return np.rint(unit(pivots) * CODE)


def cells_of(v: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The pivot with the greatest product, by angle the nearest."""
    whole = np.rint(v / np.abs(v).max(1, keepdims=True) * int(CODE / math.sqrt(v.shape[1])))
    return (whole @ codes.T).argmax(1)


#: Classes whose copies a task counts before it passes them on.
SEEN = 200_000


def _to_chunks(kind: str, dim: int, codes, chunks):
    """Vectors to (cell, chunk, k, v, copies): each class with its vector once a task, further copies as a count."""

    def run(batches):
        more: dict[bytes, list] = {}

        def counts():
            extra = [(*x, k) for k, x in more.items() if x[2]]
            more.clear()
            for at in range(0, len(extra), 10_000):
                cell, chunk, n, k = zip(*extra[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(chunk, pa.int64()), pa.array(k, pa.binary()), pa.nulls(len(k), pa.binary()), pa.array(n, pa.int64())], ["cell", "chunk", "k", "v", "copies"])

        for b in batches:
            new = {}
            for x in _rows(b.column(0), kind):
                k = xxhash.xxh3_128_digest(x)
                if k in more:
                    more[k][2] += 1
                elif k in new:
                    new[k][1] += 1
                else:
                    new[k] = [x, 0]
            if new:
                cell = cells_of(matrix([x for x, _ in new.values()], kind, dim), codes.value).tolist()
                chunk = [(c << 32) + int.from_bytes(k[:8], "little") % chunks.value[c] for c, k in zip(cell, new, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(chunk, pa.int64()), pa.array(list(new), pa.binary()), pa.array([x for x, _ in new.values()], pa.binary()), pa.array([1] * len(new), pa.int64())], ["cell", "chunk", "k", "v", "copies"])
                more.update({k: [c, h, n] for (k, (_, n)), c, h in zip(new.items(), cell, chunk, strict=True)})
            if len(more) > SEEN:
                yield from counts()
        yield from counts()

    return run


def _pack_chunk(kind: str, dim: int, pivots):
    def run(t: pa.Table) -> pa.Table:
        v, copies = {}, {}
        for k, x, n in zip(*(t.column(c).to_pylist() for c in ("k", "v", "copies")), strict=True):
            copies[k] = copies.get(k, 0) + n
            if x is not None:
                v[k] = x
        keys, cell = sorted(v), t.column("cell")[0].as_py()
        far = np.sqrt(((unit(matrix([v[k] for k in keys], kind, dim)) - pivots.value[cell]) ** 2).sum(1)).max()
        return pa.table(
            {
                "cell": t.column("cell")[:1], "chunk": t.column("chunk")[:1], "r": pa.array([float(far)]), "keys": pa.array([b"".join(keys)], pa.binary()),
                "copies": pa.array([np.array([copies[k] for k in keys], np.int64).tobytes()], pa.binary()), "v": pa.array([b"".join(v[k] for k in keys)], pa.binary()),
            }
        )

    return run


def _tiles_of_task(threshold: float, kind: str, dim: int):
    """Rows (a, keys, copies, v and b, keys, copies, v of two chunks) to one forest (k, root, links) of all that the task sees."""

    def run(batches):
        start: dict[int, int] = {}  # chunk to the place of its first class
        keys: list[bytes] = []
        top: list[int] = []
        links = np.zeros(0, np.int64)

        def find(i):
            while top[i] != i:
                top[i] = i = top[top[i]]
            return i

        for b in batches:
            for row in range(b.num_rows):
                sides = [tuple(b.column(c)[row].as_py() for c in range(at, at + 4)) for at in (0, 4)]
                for chunk, ks, _, _ in sides:
                    if chunk not in start:
                        start[chunk] = len(keys)
                        keys += [ks[x : x + 16] for x in range(0, len(ks), 16)]
                        top += range(len(top), len(keys))
                        links = np.append(links, np.zeros(len(keys) - len(links), np.int64))
                sides = sides[:1] if sides[0][0] == sides[1][0] else sides
                parts = [unit(matrix([v], kind, dim)) for *_, v in sides]
                copies = np.concatenate([np.frombuffer(c, np.int64) for _, _, c, _ in sides])
                at = np.concatenate([start[s[0]] + np.arange(len(p)) for s, p in zip(sides, parts, strict=True)])
                root, n = tile_forest(parts[0], parts[1] if len(parts) == 2 else None, copies, threshold)
                links[at] += n
                for i in np.nonzero(root != np.arange(len(root)))[0].tolist():
                    top[find(int(at[i]))] = find(int(at[root[i]]))
        keep = np.nonzero(links)[0].tolist()
        for x in range(0, len(keep), 10_000):
            some = keep[x : x + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some], pa.binary()), pa.array([keys[find(i)] for i in some], pa.binary()), pa.array(links[some], pa.int64())], ["k", "root", "links"])

    return run


def _usable(vectors: DataFrame) -> DataFrame:
    return valid(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).where(F.exists("embedding", lambda x: x != 0))


def _keyed(usable: DataFrame, kind: str) -> DataFrame:
    """vec_id, k (16 bytes: digest of the vector) and dim of usable rows."""

    def run(batches):
        for b in batches:
            v = _rows(b.column(1), kind)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in v], pa.binary()), pa.array([len(x) // np.dtype(kind).itemsize for x in v], pa.int32())], ["vec_id", "k", "dim"]
            )

    return usable.mapInArrow(run, "vec_id long, k binary, dim int")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    bound_batches(spark)
    kind = "f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "f8"
    usable = _usable(vectors)
    keyed = park(_keyed(usable, kind))
    classes = park(keyed.groupBy("k").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("dim").alias("dim")))
    forest_rows = spark.createDataFrame([], "k binary, root binary, links long")
    for r in classes.groupBy("dim").count().orderBy("dim").collect():  # the vectors' lengths
        same = usable.where(F.size("embedding") == r["dim"]).select("embedding")
        forest_rows = forest_rows.union(_tiles(same, r["count"], r["dim"], kind, threshold))
    joined = components(forest_rows.select("k", "root"), "k", "root")
    links = forest_rows.groupBy("k").agg(F.sum("links").alias("links"))
    named = classes.select("k", "copies", "least").join(joined.withColumnRenamed("node", "k"), "k", "left").join(links, "k", "left")
    named = cut_lineage(named.withColumn("root", F.coalesce("root", "k")))
    names = cut_lineage(named.groupBy("root").agg(F.min("least").alias("component_id")))  # the join below can then split a large component
    named = named.join(names, "root").select("k", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = keyed.select("vec_id", "k").join(named, "k").select("vec_id", "n_links", "component_id")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = F.coalesce(
        F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
        F.lit(False),
    )
    alone = ids.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select(
        "vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )


def _smallest(k: int, kind: str):
    """The k vectors with the smallest digests, copies once."""

    def run(batches):
        best: dict[bytes, bytes] = {}
        for b in batches:
            best.update((xxhash.xxh3_128_digest(x), x) for x in _rows(b.column(0), kind))
            best = {d: best[d] for d in sorted(best)[:k]}
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.binary()), pa.array(list(best.values()), pa.binary())], ["k", "v"])

    return run


def _tiles(vectors: DataFrame, n: int, dim: int, kind: str, threshold: float) -> DataFrame:
    """Spanning forest rows of n classes, all of one vector length, written out; their chunks are deleted."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    rows = chunk_rows(n)
    most = max(1, min(MAX_PIVOTS, n // (2 * rows)))
    raw = vectors.mapInArrow(_smallest(most, kind), "k binary, v binary").groupBy("k").agg(F.first("v").alias("v")).orderBy("k").limit(most).collect()
    pivots = unit(matrix([bytes(r["v"]) for r in raw], kind, dim))
    shared, codes = sc.broadcast(pivots), sc.broadcast(pivot_codes(pivots))  # MAX_PIVOTS vectors at most

    def count(batches):
        for b in batches:
            v = _rows(b.column(0), kind)
            if v:
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in v], pa.binary()), pa.array(cells_of(matrix(v, kind, dim), codes.value))], ["k", "cell"])

    counted = vectors.mapInArrow(count, "k binary, cell long").distinct().groupBy("cell").count().collect()
    chunks = {c["cell"]: math.ceil(c["count"] / rows) for c in counted}
    dealt = vectors.mapInArrow(_to_chunks(kind, dim, codes, sc.broadcast(chunks)), "cell long, chunk long, k binary, v binary, copies long")
    packed, at = write_out(dealt.groupBy("chunk").applyInArrow(_pack_chunk(kind, dim, shared), "cell long, chunk long, r double, keys binary, copies binary, v binary"))
    cells = packed.groupBy("cell").agg(F.max("r").alias("r")).orderBy("cell").collect()
    # chord of the threshold's angle; two cells may hold a link if their pivots are no further apart than that and both radii
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK * 4
    meet = [(c["cell"], [d["cell"] for d in cells if float(np.linalg.norm(pivots[c["cell"]] - pivots[d["cell"]])) - c["r"] - d["r"] <= reach]) for c in cells]
    meeting = spark.createDataFrame(meet, "cell long, others array<long>")  # MAX_PIVOTS^2 numbers at most
    total = sum(chunks.values())
    parts = max(1, min(total, max(math.ceil(total / 8), math.ceil(math.sqrt(4 * sc.defaultParallelism)))))
    odd = (F.col("cell") + F.col("chunk")) % 2
    a = packed.join(F.broadcast(meeting), "cell").select(F.col("chunk").alias("a"), "keys", "copies", "v", "others", odd.alias("odd")).coalesce(parts)
    b = packed.select(F.col("chunk").alias("b"), F.col("keys").alias("keys_b"), F.col("copies").alias("copies_b"), F.col("v").alias("v_b"), F.col("cell").alias("cell_b"), odd.alias("odd_b")).coalesce(parts)
    # each two chunks meet once; which one is on the left changes from pair to pair, so that all tasks have as much to do
    once = F.expr("a = b or (a < b) = (odd = odd_b)") & F.array_contains("others", F.col("cell_b"))
    met = a.join(b.hint("shuffle_replicate_nl"), once).select("a", "keys", "copies", "v", "b", "keys_b", "copies_b", "v_b")
    forest = park(met.mapInArrow(_tiles_of_task(threshold, kind, dim), "k binary, root binary, links long"))
    remove(spark, at)
    return forest


def op7_embedding_neardup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
