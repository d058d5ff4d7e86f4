import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import html, lmscore, mixing

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- 4: mixing


def shares(rows):
    t = Counter()
    for r in rows:
        t[r["source"]] += len((r["text"] or "").split())
    return t


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_mixing_meets_entropy_and_budget(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    rows = docs.collect()
    t = shares(rows)
    total = sum(t.values())
    got = mixing.mix(docs, budget=total, entropy=0.9, repeats=None).collect()
    w = {r["source"]: r["weight"] for r in got}
    entropy = -sum(x * math.log(x) for x in w.values())
    assert abs(sum(w.values()) - 1) < 1e-9 and abs(entropy - 0.9 * math.log(len(t))) < 1e-3
    # one exponent for all sources
    a = [math.log(w[s] / w["hot"]) / math.log(t[s] / t["hot"]) for s in t if s != "hot"]
    assert max(a) - min(a) < 1e-6
    check_realised(rows, got, w, t, total)


def check_realised(rows, got, w, t, total):
    longest = defaultdict(int)
    for r in rows:
        longest[r["source"]] = max(longest[r["source"]], len((r["text"] or "").split()))
    took = Counter()
    for r in got:
        took[r["source"]] += r["tokens"]
    for s in w:
        assert w[s] * total - 1e-6 <= took[s] <= w[s] * total + longest[s]
    times = Counter((r["doc_id"], r["epoch"]) for r in got)
    assert max(times.values()) == 1
    passes = {s: math.floor(w[s] * total / t[s] + 1e-9) for s in w}
    by_doc = Counter(r["doc_id"] for r in got)
    assert all(passes[r["source"]] <= by_doc[r["doc_id"]] <= passes[r["source"]] + 1 for r in rows if r["source"] in w)


def test_mixing_repetition_limit_and_whole_cover(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)))
    rows = docs.collect()
    t = shares(rows)
    got = mixing.mix(docs, budget=None, repeats=2.0).collect()
    by_doc = Counter(r["doc_id"] for r in got)
    assert set(by_doc) == {r["doc_id"] for r in rows} and max(by_doc.values()) <= 2
    passes = {r["source"]: r["weight"] / t[r["source"]] for r in got}
    assert abs(max(passes.values()) / min(passes.values()) - min(2.0, max(t.values()) / min(t.values()))) < 0.01


def test_mixing_of_nearly_equal_sources_still_meets_its_target(spark):
    docs = spark.createDataFrame([(i, "a b c d e", "en", "x" if i < 505 else "y", 0) for i in range(1000)], DOCS)
    w = {r["source"]: r["weight"] for r in mixing.mix(docs, budget=1000, entropy=0.9, repeats=None).collect()}
    assert abs(-sum(x * math.log(x) for x in w.values()) / math.log(2) - 0.9) < 0.02


def test_mixing_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "x y", "en", None, 0), (3, "x y", "en", None, 0), (4, "one two three", "en", "a", 0), (None, "q", "en", "b", 0), (5, None, "en", "empty", 0),
            (6, "word " * 50_000, "en", "c", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"tokens": F.lit("clash"), "t": F.lit(1), "blocks": F.lit(1), "epoch": F.lit(1), "_sk": F.lit(1), "_at": F.lit(1), "row": F.lit(1)})
    got = mixing.mix(docs, budget=None, repeats=1.0).collect()
    assert sorted((r["doc_id"] or 0, r["tokens"]) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2), (4, 3), (6, 50_000)]
    assert mixing.mix(docs.limit(0), budget=None, repeats=2.0).count() == 0
    assert mixing.mix(docs.where("text is null"), budget=None, repeats=2.0).count() == 0
    sources, taken = mixing.plan(docs, budget=None, repeats=1.0)
    assert mixing.realise(docs, sources, taken).select("row.*").columns == docs.columns
    with pytest.raises(ValueError):
        mixing.plan(docs, entropy=0.5)


def test_mixing_blocks_are_taken_in_order(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", "s", 0) for i in range(3000)] + [(10_000 + i, "a", "en", "z", 0) for i in range(20)], DOCS)
    got = mixing.mix(docs, budget=6000, entropy=0.5, repeats=None).where("source = 's'").collect()
    place = {(r["epoch"], r["block"]): r["place"] for r in got}
    ordered = sorted(place, key=place.get)
    n = Counter((r["epoch"], r["block"]) for r in got)
    whole = Counter(r["block"] for r in mixing.mix(docs, budget=None, repeats=1.0).where("source = 's'").collect())
    assert [n[b] == whole[b[1]] for b in ordered[:-1]] == [True] * (len(ordered) - 1)
    assert 1 <= n[ordered[-1]] <= whole[ordered[-1][1]]


# --- 6: HTML


class Plain(HTMLParser):
    """Visible words by a plain parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in html.BLOCK or tag == "br":
            self.words.append(" ")
        self.skip += tag in ("script", "style", "title", "template")

    def handle_endtag(self, tag):
        if tag in html.BLOCK:
            self.words.append(" ")
        self.skip -= tag in ("script", "style", "title", "template")

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def test_html_words_equal_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r["html"])
        plain.close()
        want = [w for w in "".join(plain.words).split()]
        have = [w for line in got[r["page_id"]].split("\n") for w in re.sub(r"^\s*(- |\d+\. |> )", "", line).split()]
        assert have == want, r["page_id"]


CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<b>a</b> <i>b</i>c", "a bc"),
    ("  a \n\t b  ", "a b"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n\n  - c\n- d"),
    ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"),
    ("<table><tr><th colspan=2>head<th>x<tr><td>a<td>b<td>c</table>", "head  x\na  b  c"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<pre>\n  a\n    b</pre>c", "  a\n    b\n\nc"),
    ("<blockquote><p>a<p>b</blockquote>", "> a\n>\n> b"),
    ("<head><title>t</title><style>x{}</style></head><body>v", "v"),
    ("a<script>var t='</p>';</script>b", "ab"),
    ("a<!-- x <p> -->b<!-- open", "ab"),
    ("<p hidden>a</p><p style='display: none'>b</p><p>c", "c"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"),
    ("<details><summary>s</summary>x</details><details open><summary>t</summary>y</details>", "s\nt\ny"),
    ("<select><option>a<option selected>b</select>", "b"),
    ("<template>x</template><noscript>n</noscript>", "n"),
    ("a < b and c > d", "a < b and c > d"),
    ("<p title='a>b'>x</p>", "x"),
    ("</p>a</div>b</li>", "ab"),
    ("<textarea> k\n l</textarea>", " k\n l"),
    ('x<a href="unclosed>y', "x"),
    ("<p>&copy;&nbsp;&#233;&#x4e2d;", "© é中"),
    ("<svg/><p>a", "a"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_html_rendering(page, text):
    assert html.html_text(page) == text


def test_html_long_and_deep_pages_stay_linear():
    import time

    began = time.time()
    assert html.html_text("<div>" * 50_000 + "x").strip() == "x"
    assert html.html_text("<ul><li>" * 5_000 + "x").endswith("x")
    assert html.html_text("<table><tr><td>" * 3_000 + "x").strip() == "x"
    assert html.html_text("<" * 200_000).count("<") == 200_000
    assert html.html_text("<a b='" * 20_000) == ""
    assert len(html.html_text("<p>word " * 100_000).split()) == 100_000
    wide = html.html_text("<table>" + "<tr><td>a<td>b" * 3000 + "<tr><td>" + "x" * 50_000 + "<td>y</table>")
    assert len(wide) < 400_000 and "x" * 50_000 + "  y" in wide
    assert time.time() - began < 20


def test_html_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (None, "b")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))
    got = html.extract(pages).collect()
    assert sorted((str(r["page_id"]), str(r["text"])) for r in got) == [("1", "None"), ("2", ""), ("3", "a"), ("3", "a"), ("None", "b")]
    assert html.extract(pages.limit(0)).count() == 0


# --- 8: LM scoring


def brute_scores(docs, good, words, least):
    cut = [(d, [w for w in (t or "").encode().lower().split()]) for d, t in docs]
    n = Counter(w for _, ws in cut for w in ws)
    vocab = [w for w, c in sorted(n.items(), key=lambda x: (-x[1], x[0])) if c >= least][:words]
    ident = {w: i for i, w in enumerate(vocab)}
    unk, start = len(vocab), len(vocab) + 1
    models = {}
    for name in ("target", "background"):
        uni, bi = Counter(), Counter()
        for d, ws in cut:
            if name == "background" or d in good:
                before = start
                uni[start] += bool(ws)
                for w in ws:
                    i = ident.get(w, unk)
                    uni[i] += 1
                    bi[before, i] += 1
                    before = i
        models[name] = uni, bi
    out = {}
    for d, ws in cut:
        loss = {}
        for name, (uni, bi) in models.items():
            total = sum(uni[i] for i in range(unk + 1))
            s, before = 0.0, start
            for w in ws:
                i = ident.get(w, unk)
                p = (uni[i] + lmscore.ADD) / (total + lmscore.ADD * (unk + 1))
                s -= math.log((bi[before, i] + lmscore.BACK * p) / (uni[before] + lmscore.BACK))
                before = i
            loss[name] = s / len(ws) if ws else None
        out[d] = (len(ws), loss["target"], loss["background"])
    return out


def test_lm_scores_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = lmscore.fit(docs, labels, words=300, least=3)
    got = {r["doc_id"]: r for r in lmscore.score(docs, model).collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    want = brute_scores([(r["doc_id"], r["text"]) for r in docs.collect()], good, 300, 3)
    assert set(got) == set(want)
    for d, (n, t, b) in want.items():
        r = got[d]
        assert r["n_tokens"] == n
        assert abs(r["target_loss"] - t) < 1e-9 and abs(r["background_loss"] - b) < 1e-9
        assert abs(r["score"] - (r["target_loss"] - r["background_loss"])) < 1e-9


def test_lm_prefers_the_target(spark):
    a = [(i, " ".join(f"good{(i * k) % 17}" for k in range(30))) for i in range(60)]
    b = [(100 + i, " ".join(f"bad{(i * k) % 17}" for k in range(30))) for i in range(60)]
    docs = spark.createDataFrame(a + b, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in lmscore.score(docs, lmscore.fit(docs, labels)).collect()}
    assert max(got[i] for i in range(30, 60)) < min(got[100 + i] for i in range(60))


def test_lm_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a a a b"), (3, "a a a b"), (None, "a b"), (4, "w " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "_good": F.lit(1)})
    labels = spark.createDataFrame([(3, 1, 0), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = lmscore.fit(docs, labels)
    got = lmscore.score(docs, model).collect()
    assert len(got) == len(rows)
    assert [(r["n_tokens"], r["score"]) for r in got if r["doc_id"] in (1, 2)] == [(0, None)] * 2
    assert all(np.isfinite(r["score"]) for r in got if r["n_tokens"])
    empty = lmscore.fit(docs.limit(0), labels)
    assert lmscore.score(docs.limit(0), empty).count() == 0
    assert all(np.isfinite(r["score"]) for r in lmscore.score(docs, lmscore.fit(docs, labels.limit(0))).collect() if r["n_tokens"])


def test_lm_counts_are_exact_and_the_floor_alone_cuts(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    # words enough that any fixed number of cells or words is too small
    rows += [(10**6 + i, " ".join(f"v{i}x{k}" for k in range(2000) for _ in range(3))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1} | {10**6}
    labels = labels.select("doc_id", "quality").union(spark.createDataFrame([(10**6, 1)], "doc_id long, quality int"))
    got = {r["doc_id"]: r for r in lmscore.score(docs, lmscore.fit(docs, labels)).collect()}
    want = brute_scores(rows, good, None, 3)
    assert len({w for _, t in rows for w in (t or "").encode().lower().split()}) > 50_000 and set(got) == set(want)
    for d, (n, t, b) in want.items():
        assert got[d]["n_tokens"] == n
        if n:
            assert abs(got[d]["target_loss"] - t) < 1e-9 and abs(got[d]["background_loss"] - b) < 1e-9
        else:
            assert got[d]["score"] is None
