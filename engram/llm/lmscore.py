"""Language-model scoring by cross-entropy difference.

Target and background models are interpolated bigram models over one shared vocabulary: all words with at least
``least`` occurrences in all documents; all other words are one unknown word. A document's score
is the mean over its tokens of target loss less background loss, in nats: the lower, the more the
document is like the target. The target is the documents that ``labels`` calls good (quality 1), the background all documents.

Counts are exact (words and bigrams are told apart by hashes of 64 bits), cover every whole text and stay distributed. Texts
are encoded in chunks of about ``CHUNK`` tokens. A chunk sends each of its distinct words, with their counts, once to a range
of the hash space; the range adds them up and tells each chunk the sums of its words. Then the same with bigrams, over the
words that the first round left known. However frequent a word or bigram, a chunk sends it once. Ranges grow in number
with the chunks; only the chunks' and ranges' totals come to the driver. Labels, which grow with the input, are joined by a shuffle.

Defined results: null and empty texts have no tokens and null losses and score; without target documents, the
target model is uniform over the vocabulary; repeated rows count and are scored as rows of their own; of repeated labels of
one document, any good one counts; other columns are ignored. ``words`` is for callers that want the most frequent
words only.
"""

from __future__ import annotations

import contextlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage, spread_out, table
from .ngramjoin import pack, unpack

LEAST = 3
FLUSH = 300_000
#: Tokens of a chunk, about; a batch more at most.
CHUNK = 1 << 22
#: Least number of ranges, as a power of two; from there on a range holds about two chunks' worth.
RANGE_BITS = 6
#: Pseudo-counts: of a word in the unigram model, and of the unigram model behind a history.
ADD, BACK = 0.5, 8.0
UNKNOWN, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

CHUNKS = "at int, chunk long, counts boolean, scores boolean, tokens array<long>, body binary"
TOLD = "at int, chunk long, body binary"


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _count_words(batches):
    """Partial counts; the table is sent on whenever it gets large."""

    def rows(c: Counter):
        keys = list(c)
        for k in range(0, len(keys), 20_000):
            part = keys[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([c[x] for x in part], pa.int64())], ["w", "c"])

    seen: Counter = Counter()
    for b in batches:
        for t in b.column(0).cast(pa.binary()).to_pylist():
            seen.update(_words(t))
            if len(seen) > FLUSH:
                yield from rows(seen)
                seen.clear()
    yield from rows(seen)


def vocabulary(docs: DataFrame, words: int, least: int = LEAST) -> list[bytes]:
    """The most frequent words; as many as the caller bounds them to."""
    counts = spread_out(docs.select("text")).mapInArrow(_count_words, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))
    return [bytes(r["w"]) for r in counts.where(F.col("c") >= least).orderBy(F.desc("c"), "w").limit(words).select("w").collect()]


def _squeeze(*arrays: np.ndarray) -> bytes:
    raw = pack(*arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(body: bytes, *kinds: str) -> list[np.ndarray]:
    return unpack(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True), *kinds)


class _Places(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _encode(counts: bool, scores: bool):
    """Chunks: ids of the rows, tokens of each, good or not, place of each token's word among the sorted hashes."""

    def run(batches):
        place = 0
        ids, sizes, good, tokens, seen = [], [], [], [], _Places()

        def row():
            size, flag = np.concatenate(sizes), np.concatenate(good)
            hashes, back = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen)), return_inverse=True)
            at = back.astype("<u4")[np.concatenate(tokens)]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids[0].schema) as w:
                for b in ids:
                    w.write_batch(b)
            body = _squeeze(np.frombuffer(sink.getvalue(), "u1"), size, flag, at, hashes.astype("<u8"))
            total = [int(size.sum()), int(size[flag > 0].sum()), int((size > 0).sum()), int(((size > 0) & (flag > 0)).sum())]
            chunk = (0 if counts else 1 << 62) | TaskContext.get().partitionId() << 32 | place
            cols = [pa.array([-1], pa.int32()), pa.array([chunk]), pa.array([counts]), pa.array([scores]), pa.array([total], pa.list_(pa.int64())), pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["at", "chunk", "counts", "scores", "tokens", "body"])

        for b in batches:
            cut = [_words(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            ids.append(b.select([0]))
            sizes.append(np.array([len(c) for c in cut], "<i8"))
            good.append(np.array([bool(x) for x in b.column(2).to_pylist()], "u1"))
            tokens.append(np.fromiter((i for c in cut for i in map(seen.__getitem__, c)), "<u4", int(sizes[-1].sum())))
            if sum(map(len, tokens)) >= CHUNK:
                yield row()
                place += 1
                ids, sizes, good, tokens, seen = [], [], [], [], _Places()
        if ids:
            yield row()

    return run


def chunks(docs: DataFrame, counts: bool, scores: bool) -> DataFrame:
    """docs has doc_id, text, _good."""
    return cut_lineage(docs.mapInArrow(_encode(counts, scores), CHUNKS))


def _gaps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys by their gaps: six bytes each unless a gap needs more."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    wide = len(gaps) < 2 or int(gaps[1:].max()) >> 48
    return gaps.view("u1") if wide else np.concatenate([gaps[:1].view("u1"), gaps[1:].view("u1").reshape(-1, 8)[:, :6].reshape(-1)])


def _keys(body: np.ndarray, n: int) -> np.ndarray:
    """What ``_gaps`` packed."""
    if len(body) == 8 * n:
        return np.cumsum(np.frombuffer(body.tobytes(), "<u8"), dtype=np.uint64)
    out = np.zeros((n, 8), "u1")
    out[0], out[1:, :6] = body[:8], body[8:].reshape(-1, 6)
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=np.uint64)


def _asked(bits: int, keys: np.ndarray, total: np.ndarray, good: np.ndarray, chunk: int):
    """Messages to the ranges of sorted keys."""
    ends = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    to = np.nonzero(np.diff(ends))[0]
    bodies = [_squeeze(_gaps(keys[a:b]), total[a:b].astype("<u4"), good[a:b].astype("<u4")) for a, b in zip(ends[to], ends[to + 1], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([chunk] * len(to), pa.int64()), pa.array(bodies, pa.binary())], ["at", "chunk", "body"])


def _ask_words(bits: int):
    def run(batches):
        for b in batches:
            for r in b.select(["chunk", "counts", "body"]).to_pylist():
                _, sizes, good, at, keys = _expand(r["body"], "u1", "<i8", "u1", "<u4", "<u8")
                total = np.bincount(at, minlength=len(keys)) * r["counts"]
                yield _asked(bits, keys, total, np.bincount(at[np.repeat(good > 0, sizes)], minlength=len(keys)) * r["counts"], r["chunk"])

    return run


def _bigrams(sizes: np.ndarray, at: np.ndarray, words: np.ndarray):
    """(hash of each token's bigram, place of the word before it, where texts start)."""
    before = np.empty_like(at)
    before[1:] = at[:-1]
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    before[:1] = 0
    history = words[before]
    history[starts] = START
    with np.errstate(over="ignore"):
        h = history * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h = (h + words[at]) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h, before, starts


KNOWN = ("u1", "<i8", "u1", "<u4", "<u8", "<i8", "<i8")


def _ask_bigrams(bits: int):
    def run(batches):
        for b in batches:
            for r in b.select(["chunk", "counts", "body"]).to_pylist():
                _, sizes, good, at, words, _, _ = _expand(r["body"], *KNOWN)
                keys, back = np.unique(_bigrams(sizes, at, words)[0], return_inverse=True)
                total = np.bincount(back, minlength=len(keys)) * r["counts"]
                yield _asked(bits, keys, total, np.bincount(back[np.repeat(good > 0, sizes)], minlength=len(keys)) * r["counts"], r["chunk"])

    return run


def _add_up(least: int, keep: np.ndarray | None):
    """A range's sums for each chunk that asked; keys with fewer than ``least`` count nothing. Chunk -1 has the range's totals."""

    def run(t: pa.Table) -> pa.Table:
        parts = [_expand(x, "u1", "<u4", "<u4") for x in t.column("body").to_pylist()]
        parts = [(_keys(k, len(a)), a, b) for k, a, b in parts]
        keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sums = []
        for k in (1, 2):
            s = np.zeros(len(keys), np.int64)
            np.add.at(s, back, np.concatenate([p[k] for p in parts]).astype(np.int64))
            sums.append(s)
        known = sums[0] >= max(least, 1)
        if keep is not None:
            known &= np.isin(keys, keep)
        sums = [np.where(known, s, 0).astype("<i8") for s in sums]
        ends = np.cumsum([len(p[0]) for p in parts])
        bodies = [_squeeze(*(s[back[e - len(p[0]) : e]] for s in sums)) for e, p in zip(ends, parts, strict=True)]
        bodies.append(pack(np.array([known.sum(), *(s.sum() for s in sums)], "<i8")))
        return pa.table(
            {"at": pa.array([t.column("at")[0].as_py()] * len(bodies), pa.int32()), "chunk": pa.array([*t.column("chunk").to_pylist(), -1], pa.int64()), "body": pa.array(bodies, pa.binary())}
        )

    return run


def _told(t: pa.Table) -> tuple[dict, np.ndarray, np.ndarray]:
    """A chunk's own row and the sums of its keys in order."""
    rows = sorted(t.select(["at", "body"]).to_pylist(), key=lambda r: r["at"])
    parts = [_expand(r["body"], "<i8", "<i8") for r in rows[1:]]
    none = np.empty(0, "<i8")
    return rows[0], np.concatenate([none, *(p[0] for p in parts)]), np.concatenate([none, *(p[1] for p in parts)])


def _settle(t: pa.Table) -> pa.Table:
    r, total, good = _told(t)
    ids, sizes, flag, at, keys = _expand(r["body"], "u1", "<i8", "u1", "<u4", "<u8")
    body = _squeeze(ids, sizes, flag, at, np.where(total > 0, keys, UNKNOWN).astype("<u8"), total, good)
    return t.filter(pc.equal(t.column("at"), -1)).drop_columns(["body"]).append_column("body", pa.array([body], pa.binary()))


def losses(uni: np.ndarray, unknown: int, start: int, tokens: int, size: int, at, before, starts, both) -> np.ndarray:
    """Negative log probability of every token."""
    uni = np.where(uni < 0, unknown, uni).astype(np.float64)  # unknown words are marked
    p = (uni[at] + ADD) / (tokens + ADD * (size + 1))
    history = uni[before]
    history[starts] = start
    return -np.log((both + BACK * p) / (history + BACK))


def _finish(totals: dict):
    def run(t: pa.Table) -> pa.Table:
        r, total, good = _told(t)
        ids, sizes, _, at, words, *uni = _expand(r["body"], *KNOWN)
        keys, before, starts = _bigrams(sizes, at, words)
        back = np.unique(keys, return_inverse=True)[1]
        owner, none, unk = np.repeat(np.arange(len(sizes)), sizes), sizes == 0, uni[0] == 0
        out = []
        for k, both in ((1, good), (0, total)):
            m = totals["models"][k]
            loss = losses(np.where(unk, -1, uni[k]), m["unknown"], m["start"], m["tokens"], totals["size"], at, before, starts, both[back])
            out.append(np.bincount(owner, loss, len(sizes)) / np.maximum(sizes, 1))
        doc_id = pa.ipc.open_stream(ids.tobytes()).read_all().column(0)
        return pa.table([doc_id, pa.array(sizes), *(pa.array(x, mask=none) for x in (*out, out[0] - out[1]))], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


@contextlib.contextmanager
def _swept(spark):
    """Shuffle files, which are as large as the texts, go as soon as a checkpoint no longer needs them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _drop(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing reads any more."""
    spark = df.sparkSession
    path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if path.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(path.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fit(docs: DataFrame, labels: DataFrame, words: int | None = None, least: int = LEAST) -> dict:
    """The documents in chunks, with what they count for."""
    spark = docs.sparkSession
    bound_batches(spark)
    keep = None if words is None else np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary(docs, words, least)], np.uint64)
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select("doc_id", F.lit(True).alias("_good"))
    # labels grow with the documents, so both sides are shuffled at every size
    with _swept(spark):
        marked = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left").select("doc_id", "text", "_good")
        own = chunks(marked, True, True)
    return {"docs": docs, "chunks": own, "least": least, "keep": keep}


def score(docs: DataFrame, model: dict, once: bool = False) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score. ``once``: the model is not needed again, and its chunks go early."""
    spark = docs.sparkSession
    bound_batches(spark)
    own = model["chunks"]
    if docs is not model["docs"]:
        other = spread_out(docs.select("doc_id", "text")).withColumn("_good", F.lit(False))
        own = own.withColumn("scores", F.lit(False)).union(chunks(other, False, True))
    n, *sums = own.agg(F.count("*"), *(F.sum(F.when(F.col("counts"), F.col("tokens")[k])) for k in range(4))).first()
    tokens, good_tokens, starts, good_starts = (x or 0 for x in sums)
    bits = max(RANGE_BITS, (n // 2).bit_length())

    with _swept(spark):
        told = cut_lineage(own.mapInArrow(_ask_words(bits), TOLD).groupBy("at").applyInArrow(_add_up(model["least"], model["keep"]), TOLD))
        known = np.sum([unpack(r["body"], "<i8")[0] for r in told.where("chunk = -1").collect()] or [np.zeros(3)], axis=0)  # a row of a range
        pad = [F.lit(None).cast(k).alias(c) for c, k in (("counts", "boolean"), ("scores", "boolean"), ("tokens", "array<long>"))]
        back = told.where("chunk >= 0").select("at", "chunk", *pad, "body")
        settled = cut_lineage(own.union(back).groupBy("chunk").applyInArrow(_settle, CHUNKS))
    if once:
        _drop(model["chunks"])

    size, known_tokens, known_good = map(int, known)
    models = [{"tokens": tokens, "unknown": tokens - known_tokens, "start": starts}, {"tokens": good_tokens, "unknown": good_tokens - known_good, "start": good_starts}]
    sums = settled.mapInArrow(_ask_bigrams(bits), TOLD).groupBy("at").applyInArrow(_add_up(1, None), TOLD)
    to_score = settled.where("scores").select("at", "chunk", "body")
    if docs is not model["docs"]:
        sums = sums.join(F.broadcast(to_score.select("chunk")), "chunk", "left_semi").select("at", "chunk", "body")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double"
    return to_score.union(sums.where("chunk >= 0")).groupBy("chunk").applyInArrow(_finish({"size": size, "models": models}), schema)


def op8_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), once=True)
