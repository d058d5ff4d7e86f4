import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import mtree, neardup, ngramjoin
from engram.llm.components import components

SF = "/root/testdata/sf0.001"


def union_find(nodes, pairs):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    r = random.Random(5)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(pairs, "u long, v long")).collect())
    good = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == union_find({x for p in good for x in p}, good)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 5: n-gram Jaccard join


def brute_sets(text, n=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def brute_join(rows, percent=85, words=4):
    """{row index: (size, component's smallest id, links)}"""
    sets = [brute_sets(t, words) for _, t in rows]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            at[g].append(i)
    both = defaultdict(int)
    for g, xs in at.items():
        for i in xs:
            for j in xs:
                if i < j:
                    both[i, j] += 1
    links = [p for p, o in both.items() if 100 * o >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - o)]
    top = union_find(range(len(rows)), links)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top[i]].append(d)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return [(rows[i][0], len(sets[i]), min(least[top[i]], default=None), n[i]) for i in range(len(rows))]


def compare_join(spark, rows, words=4, percent=85):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit("clash")).withColumn("n", F.lit(0))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, ngramjoin.jaccard_components(docs, words, percent).drop("text_hash", "component_key").collect()), key=key) == sorted(brute_join(rows, percent, words), key=key)


def test_ngram_join_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    compare_join(spark, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_ngram_join_on_more_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngramjoin.op5_ngram_join(spark, "/root/testdata/sf0.01").collect()}
    want = {d: (n, c, k) for d, n, c, k in brute_join([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert got == want and len({c for _, c, _ in got.values()}) < len(got)


def test_ngram_join_random_edits_and_odd_rows(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "A b"), (5, "a B"), (6, "a b"), (7, "x y z w"), (8, "X Y z w"), (None, "x y z w"), (9, "É b c d"), (10, "é b c d"),
            (11, "long " * 30_000), (12, "long " * 4), (13, "long " * 4), (13, "long " * 4)]
    for base in range(6):
        text = [r.choice(words) for _ in range(120)]
        for v in range(25):
            t = list(text)
            for _ in range(r.randrange(8)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((100 * (base + 1) + v, " ".join(t)))
    passage = " ".join(r.choice(words) for _ in range(60))
    rows += [(2000 + i, " ".join(f"u{i}_{k}" for k in range(i % 30)) + " " + passage) for i in range(60)]
    r.shuffle(rows)
    compare_join(spark, rows)


def test_ngram_join_cuts_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", 7)
    r = random.Random(4)
    text = [f"w{i}" for i in range(80)]
    rows = []
    for v in range(60):
        t = list(text)
        for _ in range(r.randrange(4)):
            t[r.randrange(80)] = "z"
        rows.append((v, " ".join(t)))
    compare_join(spark, rows)


def test_ngram_join_takes_sparse_blocks_apart(spark, monkeypatch):
    """Texts in a chain of common phrases: one large block, few links."""
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", 5)
    r = random.Random(11)
    phrases = [[f"p{i}w{k}" for k in range(9)] for i in range(90)]
    rows = []
    for i in range(89):
        for v in range(r.choice([1, 1, 2, 9])):
            t = phrases[i] + phrases[i + 1]
            if v % 2:
                t = t + [f"x{i}{v}"]
            rows.append((1000 * i + v, " ".join(t)))
    seen = []
    real = ngramjoin.join_tile
    monkeypatch.setattr(ngramjoin, "join_tile", lambda *a: seen.append(a) or real(*a))
    for words, percent in ((4, 85), (5, 80)):
        compare_join(spark, rows, words, percent)


def test_prefixes_share_an_ngram_for_every_order():
    r = np.random.default_rng(6)
    for percent in (80, 85):
        for _ in range(300):
            level = r.integers(0, 5, 1 << 16).astype(np.uint8)
            base = np.unique(r.integers(0, 2**63, r.integers(1, 200)).astype("u8"))
            a, b = (np.unique(np.concatenate([base, r.integers(0, 2**63, r.integers(0, 25)).astype("u8")])) for _ in range(2))
            if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                both = np.intersect1d(*(ngramjoin.prefix_of(x, level, 16, percent) for x in (a, b)))
                assert all(len(both) >= ngramjoin.in_common(ngramjoin.least_shared(len(x), percent)) for x in (a, b))


def test_ngram_join_writes_no_sets_that_meet_none(spark):
    import os

    from engram.llm.common import shared_folder

    def written():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(shared_folder(spark).removeprefix("file:")) for f in fs)

    r = random.Random(12)
    texts = [" ".join(f"{r.randrange(10**7)}" for _ in range(2000)) for _ in range(200)]
    before = written()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(x) for x in ngramjoin.jaccard_components(docs).select("doc_id", "component_id", "n_links").collect()} == {(i, i, 0) for i in range(200)}
    assert written() - before < 0.6 * sum(map(len, texts))


def test_ngram_join_in_rounds(spark, monkeypatch):
    """Sets that move in several rounds, every list shuffled: the same links; and near copies go by marks."""
    for name, value in (("BLOCK_SETS", 5), ("ROUND_BYTES", 1 << 12), ("ROUND_SHARE", 0), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(ngramjoin, name, value)
    r = random.Random(13)
    rows = []
    for base in range(4):
        text = [f"b{base}w{i}" for i in range(70)]
        for v in range(12):
            t = list(text)
            for _ in range(r.randrange(4)):
                t[r.randrange(70)] = "z"
            rows.append((100 * base + v, " ".join(t)))
    rows += [(3, rows[3][1]), (None, rows[20][1]), (900, "alone in its own words"), (901, None)]
    compare_join(spark, rows)
    kept = ngramjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    least = {c for _, n, c, _ in brute_join(rows) if n}
    assert sorted(x["doc_id"] for x in kept) == sorted(least | {901})


def test_keep_one_moves_no_texts_but_marked_ones(spark, monkeypatch):
    """Where the list of copies is too long to broadcast, the texts of other rows stay where they are."""
    monkeypatch.setattr(ngramjoin, "BROADCAST_ROWS", 0)
    r = random.Random(15)
    texts = [" ".join(f"{r.randrange(10**7)}" for _ in range(1000)) for _ in range(150)]
    rows = [*enumerate(texts), (200, texts[7]), (201, texts[8] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        every = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngramjoin.keep_one(docs, 5, 80)
        at = moved()
        assert sorted(x["doc_id"] for x in kept.collect()) == list(range(150))
        assert moved() - at < 0.2 * sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_marks_hold_all_and_few_others(spark):
    ids = spark.range(40_000).select(F.col("id"), F.xxhash64("id").alias("h"))
    is_marked = ngramjoin.marked(ids.where("id < 4000").select("h"), 40_000)
    got = {x["id"] for x in ids.where(is_marked("h")).collect()}
    assert got >= set(range(4000)) and len(got) < 8000


def test_ngram_join_empty(spark):
    assert ngramjoin.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_walk_against_all_pairs():
    r = np.random.default_rng(1)
    base = r.choice(10**9, 90, replace=False).astype("u8")
    sets = []
    for _ in range(70):
        s = base[r.random(90) < r.choice([0.5, 0.9, 0.97])]
        sets.append(np.unique(np.concatenate([s, r.integers(10**10, 10**11, r.integers(0, 9)).astype("u8")])))
    sizes = [len(s) for s in sets]
    got = {(x, int(j)) for x, who in ngramjoin.join_sets(sets, sizes, sets, sizes, 85) for j in who}
    want = {(i, j) for i in range(70) for j in range(70) if (o := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 85 * (sizes[i] + sizes[j] - o)}
    assert got == want and len(want) > 100


# --- 7: embedding near duplicates


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute_cosine(rows, threshold=0.95):
    good = [i for i, (_, v) in enumerate(rows) if usable(v)]
    links = []
    for x, i in enumerate(good):
        for j in good[:x]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                links.append((i, j))
    top = union_find(range(len(rows)), links)
    least, n = defaultdict(list), defaultdict(int)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top[i]].append(d)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = [min(least[top[i]], default=None) for i in range(len(rows))]
    return [(rows[i][0], n[i], comp[i], comp[i] == rows[i][0]) for i in range(len(rows))]


def compare_cosine(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("k", F.lit(1)).withColumn("cell", F.lit(1))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted(map(tuple, neardup.near_duplicates(df).collect()), key=key) == sorted(brute_cosine(rows), key=key)


def test_neardup_on_embeddings(spark):
    compare_cosine(spark, [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])


def test_neardup_odd_rows(spark):
    r = np.random.default_rng(2)
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, -0.0]), (9, [1.0, 0.0]),
            (None, [1.0, 0.001]), (11, [1.0, 0.0, 0.0]), (12, [1e30, 1e30]), (13, [1e-30, 1e-30]), (14, [-1.0, 0.0])]
    for c in range(12):
        base = r.normal(size=24)
        rows += [(100 + 40 * c + i, (base + r.normal(size=24) * r.choice([0.05, 0.2, 0.3])).tolist()) for i in range(30)]
    compare_cosine(spark, rows)
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neardup_moves_vectors_once(spark):
    """What is shuffled grows with the vectors, not with the pairs of chunks."""

    def moved():
        store = spark.sparkContext._jsc.sc().statusStore()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(e.totalShuffleWrite() for e in (store.executorList(False).apply(i) for i in range(store.executorList(False).size())))

    r = np.random.default_rng(14)
    rows = [(i, r.normal(size=64).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[i % 40][1]) for i in range(400)] + [(6000 + i, (np.array(rows[i][1]) * 3 + 0.01).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    before = moved()
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in neardup.near_duplicates(df).collect()}
    assert moved() - before < 4 * 256 * len(rows)
    assert got[0] == (11, 0) and got[6000] == (11, 0) and got[45] == (1, 45) and got[6045] == (1, 45) and got[2000] == (0, 2000)
    doubles = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in doubles.collect()} == got


def test_quantisation_bound_is_rigorous():
    r = np.random.default_rng(3)
    for dim in (2, 64, 1500):
        u = neardup.unit(r.normal(size=(80, dim)))
        v = neardup.unit(r.normal(size=(60, dim)) * r.choice([1, 100], size=(60, dim)))
        (qa, sa, ea), (qb, sb, eb) = neardup.quantise(u), neardup.quantise(v)
        g = neardup.int_product(qa, qb)
        assert (g == qa.astype(np.int64) @ qb.astype(np.int64).T).all()
        assert (np.abs(g / (sa * sb) - u @ v.T) <= ea[:, None] + eb + ea[:, None] * eb).all()


def test_a_dense_tile_keeps_no_pairs():
    import tracemalloc

    r = np.random.default_rng(5)
    u = neardup.unit(r.normal(size=64) + 0.01 * r.normal(size=(4096, 64)))
    copies = np.ones(4096, np.int64)
    tracemalloc.start()
    root, links = neardup.tile_forest(u, None, copies, 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (root == 0).all() and (links == 4095).all() and peak < 150 << 20
    root, links = neardup.tile_forest(u[:1000], u[1000:], copies, 0.95)
    assert (root == 0).all() and (links[:1000] == 3096).all() and (links[1000:] == 1000).all()


def test_tile_strips_against_all_cosines(monkeypatch):
    monkeypatch.setattr(neardup, "STRIP_CELLS", 400)
    r = np.random.default_rng(9)
    u = neardup.unit(np.repeat(r.normal(size=(12, 20)), 8, 0) + r.normal(size=(96, 20)) * r.choice([0.1, 0.25, 0.3], size=(96, 1)))
    want = {(i, j) for i in range(96) for j in range(i + 1, 96) if u[i] @ u[j] >= 0.95}
    assert {(i, int(j)) for i, js in neardup.tile_links(u, None, 0.95) for j in js} == want and len(want) > 50
    assert {(i, int(j) + 40) for i, js in neardup.tile_links(u[:40], u[40:], 0.95) for j in js} == {p for p in want if p[0] < 40 <= p[1]}


# --- 9: exact top-k


def brute_top(rows, k=5, every=50):
    good = [(d, np.floor(256 * np.array(v, float)).astype(int)) for d, v in rows if d is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            s = sorted((-int(a @ b), d) for d, b in good if d != q and len(a) == len(b))
            out += [(q, i + 1, d, -x) for i, (x, d) in enumerate(s[:k])]
    return out


def compare_top(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("id", F.lit(1))
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted(map(tuple, mtree.top_k(df).collect())) == sorted(brute_top(rows))


def test_topk_on_embeddings(spark):
    compare_top(spark, [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])


def test_topk_odd_rows_and_ties(spark):
    r = np.random.default_rng(7)
    nan = float("nan")
    rows = [(0, [0.0] * 8), (50, None), (100, [1.0, None]), (150, [nan] * 8), (200, [1.0, 2.0]), (None, [1.0] * 8), (250, [3.0, 4.0, 5.0])]
    rows += [(1000 + i, [float(x) for x in r.integers(-2, 3, 8)]) for i in range(900)]  # many ties and copies
    compare_top(spark, rows)
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_mtree_passes_over_far_entries():
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 6)) * 50
    v = np.floor(np.repeat(centres, 60, 0) + r.normal(size=(2400, 6)))
    m2 = float((v * v).sum(1).max())
    tree, q = mtree.MTree(mtree.lift(v, m2)), v[5]
    seen = []

    def visit(index, points):
        seen.extend(index.tolist())
        top = sorted((v[seen] @ q).tolist())[-5:]
        return np.sqrt(max(0.0, q @ q + m2 - 2 * top[0])) if len(top) == 5 else np.inf

    computed = tree.search(np.append(q, 0.0), np.inf, 1e-3, visit)
    assert sorted((v[seen] @ q).tolist())[-5:] == sorted((v @ q).tolist())[-5:]
    assert computed < 1500


@pytest.mark.parametrize("n", [1, 5, 97, 400])
def test_mtree_covers_all_points(n):
    tree = mtree.MTree(np.random.default_rng(n).normal(size=(n, 3)).round(0))
    leaves = [i for leaf, index, *_ in tree.pages if leaf for i in index.tolist()]
    assert sorted(leaves) == list(range(n))
