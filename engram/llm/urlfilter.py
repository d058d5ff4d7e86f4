"""URL filter: host and path rules first, else logistic regression on hashed character n-grams.

Native: everything that touches the table is a Spark SQL expression. The model is trained on the
driver from a small labelled URL table (``MAX_LABELLED`` rows at most), whose features come from the
same expressions; its weights go into the plan as one constant array of ``BUCKETS`` doubles.

Defined results: a url that is null or has no ``://`` has an empty host and path, no rule, and the
method's verdict on two empty strings (the bias alone); repeated rows each get a row; other columns
are ignored. N-grams are cut by one look-ahead pattern, so a very long url costs linear time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 14
ORDERS = (3, 4, 5)
MAX_LABELLED = 10_000
#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Words that tell unwanted hosts and paths, and words of ordinary ones, for the labelled table.
UNWANTED = (
    "casino poker slots jackpot betting roulette viagra pills pharma steroids porn xxx sex escort camgirls hookup warez crack keygen torrent "
    "payday loans replica lottery spam phishing malware popunder clickbait backlinks"
).split()
ORDINARY = (
    "library museum school garden weather recipes history travel music science forum journal river city sport farm bakery books maps news "
    "university medicine parliament archive theatre cycling harbour market poems physics village kitchen"
).split()
SYLLABLES = "ba to ri ne sta mol en ka lu fe ron di sha ge wi on th er tion he st and ing re ly es ha ou ble wh th in at nd the or".split()
LANGUAGES = ("en", "de", "fr", "es", "it", "")
DOORS = ("", "www.", "m.", "blog.", "shop.")
NAMES = ("{w}", "{w}-{v}", "{v}{w}", "{w}{v}", "{v}-{w}")
ENDS = (".com", ".org", ".net", ".info", ".biz", ".example.org", ".example.com", ".example.net")
PATHS = ("/{l}/{n}", "/{l}/{n}.html", "/{l}/{n}/", "/{l}/{v}/{n}?page=2", "/{v}/{l}#top", "/")


def labelled_table(rounds: int = 120) -> list[tuple[str, int]]:
    """The small labelled table of invented urls, by a rule: (url, 1 for block). Both classes have every form of host and path
    and every language; they differ in one word of the host only. Of four ordinary urls, one has an ordinary word
    there and three have made-up ones."""
    out = []
    for i in range(rounds * len(ENDS)):
        made = ["".join(SYLLABLES[(i * k + i // 5 + k * m) % len(SYLLABLES)] for k in (1, 7, 11)[: 2 + (i + m) % 2]) for m in (1, 2, 3, 4)]
        name = DOORS[i % 5] + NAMES[i // 5 % 5] + ENDS[(i + i // 25) % len(ENDS)]
        for j, w in enumerate((UNWANTED[i % len(UNWANTED)], ORDINARY[(i * 11) % len(ORDINARY)], *made[:3])):
            v = made[3] if (i + j) % 2 else ORDINARY[(i * 5 + j) % len(ORDINARY)]
            path = PATHS[(i // 3 + j) % len(PATHS)].format(l=LANGUAGES[(i + j + i // 6) % len(LANGUAGES)], v=v, n=(i * 997 + j * 331) % 10_000)
            out.append(("http" + "s" * (i % 2) + "://" + name.format(w=w, v=v) + path.replace("//", "/"), int(j == 0)))
    return out


LABELLED = tuple(labelled_table())


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_name(rule: tuple[str, str, str]) -> str:
    return rule[1] + rule[2]


def rule_case(h: Column, p: Column, rules, value) -> Column:
    """value(rule) of the longest rule that fits, else null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(rule_name(r)), rule_name(r))):
        fits = ((h == rule[1]) | h.endswith("." + rule[1])) & p.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))) if out is None else out.when(fits, F.lit(value(rule)))
    return F.lit(None).cast("string") if out is None else out


def buckets(h: Column, p: Column) -> Column:
    """Bucket numbers of all n-grams; host and path n-grams hash apart, and both have marked ends."""

    def hashed(tag: str):  # a lambda of one parameter: a second one would be the place in the array
        return lambda gram: F.pmod(F.crc32(F.concat(F.lit(tag), gram)), F.lit(BUCKETS)).cast("int")

    parts = []
    for tag, text in (("h", h), ("p", p)):
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        for n in ORDERS:
            parts.append(F.transform(F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), hashed(tag)))
    return F.concat(*parts)


def train(spark: SparkSession, labelled=LABELLED, epochs: int = 300, rate: float = 8.0, decay: float = 1e-7):
    """(weights, bias) by gradient descent with a step for each weight, on the driver; features are n-gram shares of a url.
    Bounded by MAX_LABELLED rows."""
    if not 0 < len(labelled) <= MAX_LABELLED:
        raise ValueError(f"the labelled table needs 1 to {MAX_LABELLED} rows")
    urls = F.split(F.lit("\n".join(u for u, _ in labelled)), "\n")
    rows = spark.range(1).select(F.posexplode(urls).alias("i", "url"))
    cut = {r["i"]: r["b"] for r in rows.select("i", buckets(host(F.col("url")), path(F.col("url"))).alias("b")).collect()}
    sizes = np.array([len(cut[i]) for i in range(len(labelled))])
    at, row = np.concatenate([np.array(cut[i], np.int64) for i in range(len(labelled))]), np.repeat(np.arange(len(labelled)), sizes)
    share, y = 1 / sizes[row], np.array([v for _, v in labelled], float)
    used, at = np.unique(at, return_inverse=True)
    w, bias, steps, bias_steps = np.zeros(len(used)), 0.0, np.full(len(used), 1e-12), 1e-12
    for _ in range(epochs):
        z = np.bincount(row, w[at] * share, len(y)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        slope, bias_slope = np.bincount(at, err[row] * share, len(used)) + decay * w, float(err.sum())
        steps, bias_steps = steps + slope * slope, bias_steps + bias_slope * bias_slope
        w -= rate * slope / np.sqrt(steps)
        bias -= 0.1 * rate * bias_slope / bias_steps**0.5
    out = np.zeros(BUCKETS)
    out[used] = w
    return out.tolist(), float(bias)


def score(h: Column, p: Column, model) -> Column:
    """Log-odds of block."""
    w, bias = model
    weights = F.split(F.lit(",".join(f"{x:.6g}" for x in w)), ",").cast("array<double>")
    b = buckets(h, p)
    total = F.aggregate(b, F.lit(0.0), lambda acc, i: acc + F.element_at(weights, i + 1))
    return F.lit(bias) + F.coalesce(total / F.nullif(F.size(b), F.lit(0)), F.lit(0.0))


def filter_urls(pages: DataFrame, rules=RULES, labelled=LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log-odds of block by the model, whatever the rule says)."""
    model = train(pages.sparkSession, labelled)
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    h, p = F.col("host"), F.col("path")
    judged = parts.select(
        "page_id", h, p, rule_case(h, p, rules, rule_name).alias("rule"),
        rule_case(h, p, rules, lambda r: r[0]).alias("_said"), score(h, p, model).alias("score"),
    )
    by_model = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("_said", by_model).alias("verdict"), "score"
    )


def op10_url_filter(spark, sf_dir):
    from .common import table

    return filter_urls(table(spark, sf_dir, "pages"))
