"""N-gram Jaccard join by prefix trees.

A document's set holds the 64-bit hashes of its distinct word n-grams, at every input size. Hashes decide in two places only: two n-grams of one
compared pair of sets that agree would count as one (for sets of a and b n-grams a chance below a * b / 2^64), and sets are told apart by
128 bits. All sets share one global order, n-grams that are frequent in the corpus last. Two sets that reach the
threshold share l n-grams among the first ``size - ceil(t * size) + l`` of each (the prefix); l grows with the size, so that one
common passage doesn't bring two sets together.

1. *Sets.* One pass over the texts writes the size and the digest of each document's set, and counts the n-grams of all sets in cells of a
   sketch (one cell for about
   as many n-grams at every size, ``CELL_BITS`` at most). The order is by the logarithm of the cell's count, then by hash: any
   order gives the same result, a better one only makes prefixes rarer, so cells that n-grams share cost no link. Sets take twice the room of
   the texts and are never written: the second pass makes them again for their prefixes, the third for the few that meet others.
2. *Blocks.* Prefix n-grams meet by one shuffle of 16 bytes each, whatever the size of the corpus. A set that shares too few of its
   own ends here; the others that share one are connected, components are the blocks. No pairs are made. The texts of the blocks' sets are
   found by ``marked``, one bit for each cell of row hashes, and an exact join: the bits only spare work.
3. *Trie join.* Tiles are worked through in rounds, so that the sets which move at once are a bounded part of all.
   A block of at most ``BLOCK_SETS`` sets and about ``BLOCK_GRAMS`` n-grams is one tile, and a set goes there once. A larger
   block whose sets mostly don't share their n-grams (a chain of common phrases) falls apart into one group for each shared
   prefix n-gram: a set goes to the groups of its own prefix only, and a pair counts in the group of its smallest common prefix n-gram. As
   a linked pair has l of them in common, the smallest is not among the l - 1 greatest of either set, and a set stays out of those groups.
   Only where nearly all sets of a large block or group share their n-grams, so that all pairs have to be compared, it is cut into chunks and
   every two chunks meet. A tile stores its sets in a path-compressed trie, frequent n-grams
   first, and walks it once for all query sets together: the partial overlap at a node is shared by
   all sets below it, and a query leaves a subtree as soon as its overlap plus the smaller of the two
   remaining lengths can't reach the threshold. Tiles return a spanning forest and link counts.
4. Components of these forests give the result.

Equal sets are one class: a class meets others once, however many copies it has. Every row lost with
an executor is remade from its input.

Defined results: texts that are null or have no words have an empty set and link with nothing; fewer
than n words are one n-gram; a null id links like any other row but never names a component; rows of
one id are separate rows; other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, collect_garbage, cut_lineage, held, park, spread_out, table
from .components import components

WORDS, PERCENT = 4, 85
BLOCK_SETS, BLOCK_GRAMS = 128, 1 << 17
#: The sketch has about CELLS_A_ROW cells for each document, from 2^16 up to 2^CELL_BITS.
CELLS_A_ROW, CELL_BITS = 16, 24
#: The sketch travels in so many slices; FAN partial sums of each are added up first.
SLICES, FAN = 64, 4
#: Prefixes are longer by one n-gram for each so many of a set, and have to share as many more.
PREFIX_SHARE = 12
#: Cells of the query-by-n-gram matrix that a tile holds at once.
CELLS = 8 << 20
#: Rows (of about 40 bytes) up to which a list of documents or blocks is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Bytes of sets that move in one round of tiles: so many, or a share of all sets' if that is more.
ROUND_BYTES, ROUND_SHARE = 1 << 30, 0.25
HASH_CACHE = 150_000


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_M1, _M2, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def ngrams(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a UTF-8 text; words are runs of other than \\x20 \\x09-\\x0D, A-Z lower-cased."""
    words = text.lower().split() if text else []  # of bytes: ASCII only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(held("ngrams", WordHash).__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = (out ^ h[k : k + len(out)]) * _M1
            out ^= out >> _S
            out *= _M2
            out ^= out >> np.uint64(32)
    return np.unique(out)


def least_shared(size, percent: int):
    """The fewest n-grams that a set of this size shares with any partner."""
    return (percent * size + 99) // 100


def in_common(size):
    """How many n-grams the prefixes of two linked sets have in common, if this is the smaller one's size."""
    return size // PREFIX_SHARE + 1


def pack(*arrays: np.ndarray) -> bytes:
    """Each array as its length and its bytes."""
    return b"".join(x for a in arrays for x in (struct.pack("<q", a.nbytes), a.tobytes()))


def unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        (n,) = struct.unpack_from("<q", body, at)
        out.append(np.frombuffer(body, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


#: Documents (``r``: hash of id and text), and at the end of each partition its part of the sketch.
SETS = "doc_id long, text_hash long, r long, n long, k binary, u long, slice int, fan int, counts binary"
_SETS_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("r", pa.int64()), ("n", pa.int64()), ("k", pa.binary()), ("u", pa.int64()),
     ("slice", pa.int32()), ("fan", pa.int32()), ("counts", pa.binary())]
)


def squeeze(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def expand(body: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def cell_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def _digest(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _part() -> int:
    return TaskContext.get().partitionId() if TaskContext.get() else 0


def _slices(counts: np.ndarray, part: int):
    """A partition's counts (up to 255, which only makes the order coarser) in slices."""
    bodies = [squeeze(x) for x in np.split(np.minimum(counts, 255).astype(np.uint32), SLICES)]
    return pa.array(range(SLICES), pa.int32()), pa.array([part % FAN] * SLICES, pa.int32()), pa.array(bodies, pa.binary())


def sets_of(n: int, bits: int):
    """Rows of (doc_id, text, text_hash, r) to SETS."""

    def run(batches):
        seen: set[bytes] = set()  # classes of this partition
        counts = np.zeros(1 << bits, np.uint32)
        for b in batches:
            sizes, keys = [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                s = ngrams(t, n)
                k = _digest(s)
                if k is not None and k not in seen:
                    seen.add(k)
                    counts[np.unique(cell_of(s, bits))] += 1
                sizes.append(len(s))
                keys.append(k)
            u = [int.from_bytes(k[:8], "little", signed=True) if k else None for k in keys]
            none = pa.nulls(len(sizes), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(u, pa.int64()), none, none, pa.nulls(len(sizes), pa.binary())],
                schema=_SETS_ARROW,
            )
        if seen:
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(SLICES, pa.binary()), none, *_slices(counts, _part())], schema=_SETS_ARROW)

    return run


def bodies_of(n: int):
    """Rows of (text, r) to (k, r, tokens), each r once a partition."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            keys, rows, tokens = [], [], []
            for t, r in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                if r not in seen and len(s := ngrams(t, n)):
                    seen.add(r)
                    keys.append(_digest(s))
                    rows.append(r)
                    tokens.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(rows, pa.int64()), pa.array(tokens, pa.binary())], ["k", "r", "tokens"])

    return run


def _sum_slices(cells: int):
    def run(t: pa.Table) -> pa.Table:
        total = np.zeros(cells, np.uint32)
        for x in t.column("counts"):
            total += expand(x.as_py(), "<u4", cells)
        return pa.table({"slice": t.column("slice")[:1], "fan": t.column("fan")[:1], "counts": pa.array([squeeze(total)], pa.binary())})

    return run


def rarity(part: DataFrame, bits: int) -> np.ndarray:
    """A byte for each cell: the more n-grams it counts, the higher (four steps for each doubling). part: slice, fan, counts."""
    cells = (1 << bits) // SLICES
    for by in (("slice", "fan"), ("slice",)):
        part = part.groupBy(*by).applyInArrow(_sum_slices(cells), "slice int, fan int, counts binary")
    out = np.zeros((SLICES, cells), np.uint8)
    for r in part.select("slice", "counts").collect():  # 2^CELL_BITS counts at most, compressed
        out[r["slice"]] = np.minimum(255, 4 * np.log2(expand(r["counts"], "<u4", cells).astype(np.float64) + 1)).astype(np.uint8)
    return out.reshape(-1)


def bits_for(rows: int) -> int:
    return min(CELL_BITS, max(16, (rows * CELLS_A_ROW).bit_length()))


def marked(hashes: DataFrame, rows: int):
    """A function of a column of 64-bit hashes: true for all that are in hashes (one column, about so many rows), and for few others. Only
    2^CELL_BITS bits at most go to the driver and back, however many hashes there are."""
    bits = bits_for(rows)

    def count(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for b in batches:
            counts[cell_of(np.asarray(b.column(0)).view("u8"), bits)] = 1
        if counts.any():
            yield pa.RecordBatch.from_arrays([*_slices(counts, _part())], ["slice", "fan", "counts"])

    known = np.packbits(rarity(hashes.mapInArrow(count, "slice int, fan int, counts binary"), bits) > 0)
    shared = hashes.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("boolean")
    def is_marked(h: pa.Array) -> pa.Array:
        cell = cell_of(np.asarray(h).view("u8"), bits)
        return pa.array((shared.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1, pa.uint8()).cast(pa.bool_())

    return is_marked


def prefix_of(tokens: np.ndarray, level: np.ndarray, bits: int, percent: int) -> np.ndarray:
    n = len(tokens)
    order = np.lexsort((tokens, level[cell_of(tokens, bits)]))
    return tokens[order[: n - least_shared(n, percent) + in_common(n)]]


def prefixes(level, n: int, bits: int, percent: int):
    """Texts to (u, prefix), each set once a partition."""

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            us, found = [], []
            for t in b.column(0).cast(pa.binary()).to_pylist():
                s = ngrams(t, n)
                k = _digest(s)
                if k is not None and k not in seen:
                    seen.add(k)
                    us.append(int.from_bytes(k[:8], "little", signed=True))
                    found.append(prefix_of(s, level.value, bits, percent).view(np.int64))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), lists], ["u", "prefix"])

    return run


class Trie:
    """Path-compressed prefix tree of sets of ranks, each ascending."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes = sets, sizes
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.lcp = [0] * len(sets)
        for p in range(1, len(sets)):
            a, b = sets[self.order[p - 1]], sets[self.order[p]]
            m = min(len(a), len(b))
            d = np.nonzero(a[:m] != b[:m])[0]
            self.lcp[p] = int(d[0]) if len(d) else m

    def walk(self, member: np.ndarray, sizes: np.ndarray, percent: int):
        """Yields (x, queries, overlaps) for each stored set x that some queries reach the threshold with.
        member: queries by ranks, 0 or 1; sizes: of the queries' whole sets."""
        # what a query has from each rank on
        rest = np.concatenate([np.cumsum(member[:, ::-1], 1, dtype=np.int32)[:, ::-1], np.zeros((len(member), 1), np.int32)], 1)
        todo = [(0, len(self.sets), 0, np.arange(len(member)), np.zeros(len(member), np.int64))] if self.sets else []
        while todo:
            lo, hi, depth, live, shared = todo.pop()
            inside = self.order[lo:hi]
            common = min(self.lcp[lo + 1 : hi]) if hi - lo > 1 else len(self.sets[inside[0]])
            path = self.sets[inside[0]][depth:common]
            shared = shared + member[np.ix_(live, path)].sum(1, dtype=np.int64)
            after = int(self.sets[inside[0]][common - 1]) + 1 if common else 0
            longest = max(len(self.sets[i]) for i in inside) - common
            least = int(self.sizes[inside].min())
            best = shared + np.minimum(rest[live, after], longest)
            hope = (100 + percent) * best >= percent * (least + sizes[live])
            live, shared = live[hope], shared[hope]
            if not len(live):
                continue
            while lo < hi and len(self.sets[self.order[lo]]) == common:  # these end here
                x = self.order[lo]
                hit = (100 + percent) * shared >= percent * (self.sizes[x] + sizes[live])
                if hit.any():
                    yield x, live[hit], shared[hit]
                lo += 1
            start = lo
            for p in range(lo + 1, hi + 1):
                if p == hi or self.lcp[p] <= common:
                    todo.append((start, p, common, live, shared))
                    start = p


def join_sets(stored: list[np.ndarray], stored_sizes, queries: list[np.ndarray], query_sizes, percent: int):
    """Yields (stored index, query indexes) of all links. Sets are arrays of n-gram hashes without order."""
    both = [*stored, *queries]
    kinds, inverse, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = count > 1
    by = np.lexsort((kinds[shared], -count[shared]))  # frequent first: long shared paths
    rank = np.full(len(kinds), -1, np.int64)
    rank[np.nonzero(shared)[0][by]] = np.arange(len(by))
    ranks = np.split(rank[inverse], np.cumsum([len(s) for s in both])[:-1])
    ranks = [np.sort(r[r >= 0]) for r in ranks]
    trie = Trie(ranks[: len(stored)], np.asarray(stored_sizes, np.int64))
    asked, sizes = ranks[len(stored) :], np.asarray(query_sizes, np.int64)
    step = max(1, CELLS // max(1, len(by)))
    for at in range(0, len(asked), step):
        part = asked[at : at + step]
        member = np.zeros((len(part), max(1, len(by))), np.uint8)
        for i, r in enumerate(part):
            member[i, r] = 1
        for x, who, _ in trie.walk(member, sizes[at : at + step], percent):
            yield x, who + at


def join_tile(percent: int, level, bits: int):
    """Rows (k, root, links) of a tile: a spanning forest of its links, and how many documents each class links with.
    In the group of a prefix n-gram, only pairs that have no smaller one in common."""

    def run(t: pa.Table) -> pa.Table:
        first = {k: i for i, k in reversed(list(enumerate(t.column("k").to_pylist())))}  # rows that repeat both id and text bring a set twice
        t = t if len(first) == len(t) else t.take(sorted(first.values()))
        keys, chunk = t.column("k").to_pylist(), np.array(t.column("chunk"))
        sizes, copies = np.array(t.column("n")), np.array(t.column("copies"))
        sets = [np.frombuffer(x, "u8") for x in t.column("tokens").to_pylist()]
        a, b, by = t.column("a")[0].as_py(), t.column("b")[0].as_py(), t.column("by")[0].as_py()
        left, right = np.nonzero(chunk == a)[0], np.nonzero(chunk == b)[0]
        top, links = list(range(len(keys))), np.zeros(len(keys), np.int64)
        if by is not None:
            begin = [prefix_of(s, level.value, bits, percent).view(np.int64) for s in sets]

        def find(i):
            while top[i] != i:
                top[i] = i = top[top[i]]
            return i

        if len(left) and len(right):
            for x, who in join_sets([sets[i] for i in left], sizes[left], [sets[i] for i in right], sizes[right], percent):
                i, js = left[x], right[who]
                if a == b:
                    js = js[js > i]
                if by is not None:
                    js = js[[int(np.intersect1d(begin[i], begin[j], True).min()) == by for j in js]] if len(js) else js
                np.add.at(links, js, copies[i])
                links[i] += copies[js].sum()
                for j in js:
                    top[find(j)] = find(i)
        root = [keys[find(i)] for i in range(len(keys))]
        keep = links > 0
        return pa.table({"k": pa.array(keys, pa.binary()), "root": pa.array(root, pa.binary()), "links": pa.array(links)}).filter(pa.array(keep))

    return run


def least_shared_sql(n: str, percent: int) -> str:
    return f"(({percent} * {n} + 99) div 100)"


def in_common_sql(n: str) -> str:
    return f"({n} div {PREFIX_SHARE} + 1)"


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if counted to be small; else left to a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _cut(sizes: DataFrame, *by: str) -> DataFrame:
    """Into how many chunks each block or group (c sets, g n-grams) goes."""
    return sizes.select(*by, "c", F.ceil(F.greatest(F.col("c") / BLOCK_SETS, F.col("g") / BLOCK_GRAMS)).alias("chunks"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, text_hash, component_key of every row of docs (doc_id long, text string).

    Links: 100 * intersection >= percent * union of the sets of ``words``-word n-grams; component_id
    is the smallest doc_id reachable; n_links counts the other rows linked directly, copies included. text_hash is
    xxhash64 of the text, component_key tells components apart even where ids repeat (null: an empty set).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.count()
    bits = bits_for(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).withColumn("r", F.xxhash64("doc_id", "text"))
    written = park(spread_out(texts).mapInArrow(sets_of(words, bits), SETS))
    level = spark.sparkContext.broadcast(rarity(written.where("slice is not null").select("slice", "fan", "counts"), bits))  # 2^CELL_BITS bytes at most
    every = written.where("slice is null")
    classes = park(every.where("n > 0").groupBy("k").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.first("u").alias("u"), F.first("n").alias("n"), F.min("r").alias("r")))

    first = spread_out(texts.select("text")).mapInArrow(prefixes(level, words, bits, percent), "u long, prefix array<long>").select(F.explode("prefix").alias("g"), "u")
    same = Window.partitionBy("g")
    met = park(first.withColumns({"lo": F.min("u").over(same), "hi": F.max("u").over(same)}).where("lo < hi").select("g", "u").distinct())  # of two sets or more
    enough = in_common_sql(least_shared_sql("n", percent))
    hopeful = met.groupBy("u").agg(F.count("*").alias("shared")).join(classes.select("u", "n"), "u").where(f"shared >= {enough}").select("u").distinct()
    met = met.join(_small(cut_lineage(hopeful)), "u")
    met = park(met.withColumns({"lo": F.min("u").over(same), "hi": F.max("u").over(same)}).where("lo < hi").select("g", "u", "lo"))
    blocks = cut_lineage(components(met.select("lo", "u").where("lo != u"), "lo", "u").select(F.col("node").alias("u"), F.col("root").alias("block")))
    chosen = park(classes.join(_small(blocks), "u").select("block", "u", "k", "n", "copies", "r"))
    is_marked = marked(chosen.select("r"), rows)
    bodies = park(texts.select("text", "r").where(is_marked("r")).mapInArrow(bodies_of(words), "k binary, r long, tokens binary").join(_small(chosen.select("k", "r")), ["k", "r"]))

    size = cut_lineage(_cut(chosen.groupBy("block").agg(F.count("*").alias("c"), F.sum("n").alias("g")), "block"))
    large = size.where("chunks > 1")
    # large blocks whose shared n-grams ask for fewer comparisons than all pairs fall apart into the groups of these n-grams
    in_large = _small(park(chosen.join(_small(large.select("block", "c")), "block").select("block", "c", "u", "n")))
    mine = Window.partitionBy("u")
    of_large = met.select("g", "u").join(in_large, "u").withColumns({"m": F.count("*").over(mine), "at": F.row_number().over(mine.orderBy("g"))})
    of_large = park(of_large.where(f"at <= m - {enough} + 1").select("block", "g", "u", "c"))
    asked = of_large.groupBy("block", "g", "c").agg(F.count("*").cast("double").alias("m")).groupBy("block", "c").agg(F.sum(F.col("m") * F.col("m")).alias("work"))
    apart = cut_lineage(asked.where("work < 1.0 * c * c").select("block"))
    one = size.join(_small(apart), "block", "left_anti")
    tiles = chosen.join(_small(one.select("block", "chunks")), "block").withColumn("by", F.lit(None).cast("long"))
    grams = of_large.join(_small(apart), "block").select(F.col("g").alias("by"), "u").join(_small(chosen), "u")
    cut = cut_lineage(_cut(grams.groupBy("by").agg(F.count("*").alias("c"), F.sum("n").alias("g")), "by").select("by", "chunks"))
    tiles = tiles.unionByName(grams.join(_small(cut), "by"))
    tiles = tiles.withColumn("chunk", F.pmod(F.xxhash64("k"), F.col("chunks")))
    tiles = tiles.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    tiles = park(tiles.select("block", "by", "k", "n", "copies", "chunk", F.least("chunk", "o").alias("a"), F.greatest("chunk", "o").alias("b")))
    # a set goes to each of its tiles; what moves at once is bounded, and deleted before the next round
    moved, whole = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * 8 for df in (tiles, classes))
    rounds = max(1, -(-moved // max(ROUND_BYTES, int(ROUND_SHARE * whole))))
    forest = None
    for i in range(rounds):
        now = tiles.where(F.pmod(F.xxhash64("block", "by", "a", "b"), F.lit(rounds)) == i) if rounds > 1 else tiles
        found = bodies.select("k", "tokens").join(_small(now), "k").groupBy("block", "by", "a", "b").applyInArrow(join_tile(percent, level, bits), "k binary, root binary, links long")
        found = park(found)
        forest = found if forest is None else forest.union(found)
        if rounds > 1:
            collect_garbage(spark)

    # only the classes of the forest need names; all others name themselves
    joined = components(forest.select("k", "root"), "k", "root").withColumnRenamed("node", "k")
    links = forest.groupBy("k").agg(F.sum("links").alias("links"))
    linked = cut_lineage(joined.join(links, "k", "left"))
    linked = cut_lineage(classes.select("k", "least").join(_small(linked), "k"))
    names = cut_lineage(linked.groupBy("root").agg(F.min("least").alias("component_id")))  # the join below can then split a large component
    linked = cut_lineage(linked.join(_small(names), "root").select("k", "root", "component_id", "links"))
    named = classes.select("k", "copies", "least").join(_small(linked), "k", "left").select(
        "k", F.coalesce("root", "k").alias("component_key"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    return every.select("doc_id", "text_hash", "n", "k").join(named, "k", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "text_hash",
        "component_key",
    )


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near duplicates: of every component the row with the smallest id (nulls last) stays,
    and every row with an empty set. What goes is joined by (doc_id, text_hash), broadcast only if counted to be small; else only rows
    whose text is marked move, with the texts of copies at most."""
    rows = cut_lineage(jaccard_components(docs, words, percent))
    ranked = rows.where("component_key is not null").select("component_key", F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash").alias("s"))
    first = cut_lineage(ranked.groupBy("component_key").agg(F.min("s").alias("f")))  # the join below can then split a large component
    gone = cut_lineage(ranked.join(first, "component_key").where(~F.col("s").eqNullSafe(F.col("f"))).select("s.doc_id", "s.text_hash").distinct())
    twice = cut_lineage(ranked.groupBy("s").count().where("count > 1").select("s.doc_id", "s.text_hash"))

    def having(df: DataFrame, keys: DataFrame, n: int, how: str) -> DataFrame:
        keys = F.broadcast(keys) if n <= BROADCAST_ROWS else keys
        return df.join(keys, df["doc_id"].eqNullSafe(keys["doc_id"]) & (F.xxhash64(df["text"]) == keys["text_hash"]), how)

    def split(df: DataFrame, keys: DataFrame, n: int) -> tuple[DataFrame | None, DataFrame]:
        """Rows that can't be among the keys, and those that may be."""
        if n <= BROADCAST_ROWS:
            return None, df
        is_marked = marked(keys.select("text_hash"), rows.count())(F.xxhash64(df["text"]))
        return df.where(~is_marked), df.where(is_marked)

    far, near = split(docs, gone, n := gone.count())
    kept = having(near, gone, n, "left_anti")
    kept = kept if far is None else far.union(kept)
    if n := twice.count():  # rows that repeat both id and text: one of them
        far, near = split(kept, twice, n)
        kept = having(near, twice, n, "left_anti").union(having(near, twice, n, "left_semi").dropDuplicates(["doc_id", "text"]))
        kept = kept if far is None else far.union(kept)
    return kept


def op5_ngram_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).drop("text_hash", "component_key")
