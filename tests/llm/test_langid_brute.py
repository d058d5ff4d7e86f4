"""Operator 3 beside a plain version of it: its own counts, tops, backoff and softmax, word by word."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
import regex

from engram.llm import langid

SF = "/root/testdata/sf0.001"


def brute_fit(rows, words, grams):
    by_lang = defaultdict(Counter)
    for doc_id, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            by_lang[lang].update(regex.findall(r"\p{L}+", text.lower()))
    pieces = {lang: Counter() for lang in by_lang}
    for lang, counts in by_lang.items():
        for w, c in counts.items():
            for n in langid.ORDERS:
                s = w if n == 1 else f"^{w}$"
                for k in range(len(s) - n + 1):
                    pieces[lang][s[k : k + n]] += c
    known_words = {lang: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: words // len(by_lang)]) for lang, c in by_lang.items()}
    known_grams = {lang: dict(sorted(c.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[: grams // len(by_lang)]) for lang, c in pieces.items()}
    masses = {lang: {n: (sum(c for g, c in p.items() if len(g) == n), sum(len(g) == n for g in p)) for n in langid.ORDERS} for lang, p in pieces.items()}
    for lang, counts in by_lang.items():
        masses[lang]["words"] = sum(counts.values()), len(counts)
    return masses, known_words, known_grams, set().union(*known_words.values()), set().union(*known_grams.values())


def brute_predict(model, text):
    masses, known_words, known_grams, word_union, gram_union = model
    langs = sorted(masses)

    def log_frequency(kept, mass, key):
        return math.log((kept.get(key, 0) + 0.5) / (mass[0] + 0.5 * mass[1] + 1))

    score = dict.fromkeys(langs, 0.0)
    found = regex.findall(r"\p{L}+", (text or "").lower())
    if not found:
        return "und", 0.0
    for w, times in Counter(found).items():
        if w in word_union:
            for lang in langs:
                score[lang] += times * log_frequency(known_words[lang], masses[lang]["words"], w)
            continue
        for n in langid.ORDERS:
            s = w if n == 1 else f"^{w}$"
            hits = [g for k in range(len(s) - n + 1) if (g := s[k : k + n]) in gram_union]
            if hits:
                for lang in langs:
                    score[lang] += times * sum(log_frequency(known_grams[lang], masses[lang][n], g) for g in hits) / len(hits)
                break
    best = max(langs, key=lambda lang: score[lang])
    return best, 1 / sum(math.exp(score[lang] - score[best]) for lang in langs)


@pytest.mark.parametrize("words,grams", [(langid.WORDS, langid.GRAMS), (200, 400)])
def test_langid_equals_brute_force(spark, words, grams):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs, words=words, grams=grams)).collect()}
    model = brute_fit(rows, words, grams)
    assert len(got) == len(rows)
    for doc_id, text, _ in rows:
        lang, score = brute_predict(model, text)
        assert got[doc_id]["lang_pred"] == lang
        assert got[doc_id]["score"] == pytest.approx(score, abs=1e-3)
