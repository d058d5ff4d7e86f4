"""Byte-level BPE by a file of merge ranks, whole texts, without special tokens.

A text is cut by the split pattern; each distinct piece of a batch is encoded once: a piece that is a
token itself takes its id, any other starts as its single bytes and folds the adjacent pair of the
lowest rank, the leftmost first, until no pair has a rank. The fold runs over the byte arrays of all
new distinct pieces of one length at a time, as matrix operations; pieces over ``LONG`` bytes fold
one by one with a heap. Decoding looks up each id's bytes and concatenates them.

Style: Arrow batches. The same fold as Spark higher-order functions needs a map look-up per pair per
step, and a literal map of 50,000 entries is searched entry by entry; a join of all pieces with a
table of distinct words would shuffle several times the input. Here nothing is shuffled: memory is
one batch, the rank table (fixed) and a cache of ``CACHE`` pieces.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows each get a
row; null ids of documents stay null; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held, spread_out, table

CACHE = 150_000
LONG = 64
NONE = np.int64(1) << 40
_SHIFT, _MULT = 20, np.uint64(0x9E3779B97F4A7C15)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PairTable:
    """(left id, right id) -> id of the joined token; open addressing over arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [
            ((ranks[t[:i]] << _SHIFT) | ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        size = 1 << max(4, (4 * len(pairs)).bit_length())
        self.down = np.uint64(64 - (size.bit_length() - 1))
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.vals = np.full(size, NONE, np.int64)
        keys = np.array([k for k, _ in pairs], np.int64)
        vals = np.array([v for _, v in pairs], np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several for one slot, the last stays
            done = self.keys[at] == keys
            self.vals[at[done]] = vals[done]
            keys, vals, at = keys[~done], vals[~done], (at[~done] + 1) & self.mask

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * _MULT) >> self.down).astype(np.int64)

    def __call__(self, left, right):
        keys = (left << _SHIFT) | right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.vals[at], NONE)
        again = np.nonzero((found != keys) & (found != -1))[0]
        while len(again):
            at[again] = (at[again] + 1) & self.mask
            found = self.keys[at[again]]
            out[again] = np.where(found == keys[again], self.vals[at[again]], NONE)
            again = again[(found != keys[again]) & (found != -1)]
        return out


class Bpe:
    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.pieces[r] = t
        if any(bytes([b]) not in self.ranks for b in range(256)) or len(self.pieces) > 1 << _SHIFT:
            raise ValueError("the rank file needs all single bytes, and ids under 2^20")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair = PairTable(self.ranks)
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def fold(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(w) > LONG:
                out[i] = np.array(self._fold_long(w), "<u4").tobytes()
            elif w:
                by_length[len(w)].append(i)
        for length, where in by_length.items():
            self._fold_equal(length, np.array(where), [words[i] for i in where], out)
        return out

    def _fold_equal(self, length, where, words, out):
        """All words have one length; every step merges one pair in each word that still has one."""
        t = self.byte_ids[np.frombuffer(b"".join(words), np.uint8).reshape(-1, length)]
        r = self.pair(t[:, :-1].ravel(), t[:, 1:].ravel()).reshape(len(words), -1)
        while True:
            width = t.shape[1]
            j = r.argmin(1) if width > 1 else np.zeros(len(t), np.int64)
            best = r[np.arange(len(t)), j] if width > 1 else np.full(len(t), NONE)
            over = best == NONE
            if over.any():
                step, ids = 4 * width, t[over].astype("<u4").tobytes()
                for n, i in enumerate(where[over].tolist()):
                    out[i] = ids[n * step : (n + 1) * step]
                go = ~over
                t, r, j, best, where = t[go], r[go], j[go], best[go], where[go]
            if not len(t):
                return
            rows, at = np.arange(len(t)), j[:, None]
            t[rows, j] = best
            cols = np.arange(width - 1)[None, :]
            t = np.take_along_axis(t, cols + (cols > at), 1)
            cols = np.arange(width - 2)[None, :]
            r = np.take_along_axis(r, cols + (cols >= at), 1)
            k = np.nonzero(j > 0)[0]
            r[k, j[k] - 1] = self.pair(t[k, j[k] - 1], best[k])
            k = np.nonzero(j < width - 2)[0]
            r[k, j[k]] = self.pair(best[k], t[k, j[k] + 1])

    def _fold_long(self, word: bytes) -> list[int]:
        ids = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        left = list(range(-1, len(ids) - 1))
        right = [*range(1, len(ids)), -1]
        rank = lambda a, b: self.ranks.get(self.pieces[ids[a]] + self.pieces[ids[b]])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            n = right[i]
            if ids[i] != a or n < 0 or ids[n] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[n] = r, -1
            right[i] = right[n]
            if right[i] >= 0:
                left[right[i]] = i
                if (q := rank(i, right[i])) is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[right[i]]))
            if left[i] >= 0 and (q := rank(left[i], i)) is not None:
                heapq.heappush(heap, (q, left[i], ids[left[i]], ids[i]))
        return [x for x in ids if x >= 0]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        cuts = [self.cut(x) if x else [] for x in texts]
        distinct: set[str] = set()
        for c in cuts:
            distinct.update(c)
        if len(self.known) + len(distinct) > CACHE:
            self.known.clear()
        known = self.known
        new = [w for w in distinct if w not in known]
        known.update(zip(new, self.fold([w.encode() for w in new]), strict=True))
        return [b"".join(map(known.__getitem__, c)) for c in cuts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _bpe(data: bytes, pattern: str) -> Bpe:
    """One coder for each worker process and rank file."""
    return held(("bpe", hash(data), pattern), lambda: Bpe(data, pattern))


def encode(docs: DataFrame, rank_file: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) and, if asked for, the ids decoded to bytes."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # fixed: the vocabulary file
    id_type = docs.schema["doc_id"].dataType

    def run(batches):
        bpe = _bpe(ranks.value, pattern)
        for b in batches:
            ids = bpe.encode_batch(b.column(1).to_pylist())
            columns = [b.column(0), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(map(bpe.decode, ids), pa.binary(), size=len(ids)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    schema = f"doc_id {id_type.simpleString()}, ids binary" + ", decoded binary" * decoded
    return spread_out(docs.select("doc_id", "text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) of rows doc_id, ids as ``encode`` returns them; null ids decode to no bytes."""
    spark = encoded.sparkSession
    bound_batches(spark)
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    id_type = encoded.schema["doc_id"].dataType

    def run(batches):
        bpe = _bpe(ranks.value, pattern)
        for b in batches:
            out = [bpe.decode(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type.simpleString()}, decoded binary")


def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    rows = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
