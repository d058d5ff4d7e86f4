"""Formulas of the associative memory as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the memory model.
HALF_LIFE = 7 * 24 * 3600
INITIAL = 1.0
BOOST = 1.0
RECALL_BOOST = 1.5
REMEMBER_BOOST = 3.0
MAX_STRENGTH = 1000.0
LINK_BOOST = 0.30
LINK_MAX = 50.0
CO_ACCESS = 12
SPREAD = 0.45
LINK_CAP = 1 << 17
LINK_DROP = 0.05
#: Share of LINK_CAP beyond which links are pruned.
PRUNE_FROM = 0.7
TINY = 1e-9


def decayed(stored: Column, last: Column, now: Column) -> Column:
    """Strength ``now`` of what was ``stored`` at ``last`` (seconds): half after HALF_LIFE, nothing below TINY."""
    s = stored * F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), (now - last).cast("double")) / F.lit(float(HALF_LIFE)))
    return F.when((stored <= 0) | (s < TINY), F.lit(0.0)).otherwise(s)


def terms(phrase: str) -> list[str]:
    """Words of a recall phrase: distinct, lower case, two characters at least, from an alphanumeric one on."""
    words = re.findall(r"[A-Za-z0-9][A-Za-z0-9_]*", phrase)
    return list(dict.fromkeys(w.lower() for w in words if len(w) >= 2))


def typos(word: str) -> int:
    """Edits that a word of this length forgives."""
    return 0 if len(word) <= 4 else 1 if len(word) <= 7 else 2


def term_score(term: str, texts: list[Column]) -> Column:
    """1 if the first text that has the term at all has it as a part, 0.8 if as a near word, else 0."""
    k, score = typos(term), None
    for t in texts:
        exact = F.contains(F.lower(t), F.lit(term))
        if k:
            near = F.exists(F.regexp_extract_all(t, F.lit("[A-Za-z0-9][A-Za-z0-9_]*"), F.lit(0)), lambda w: F.levenshtein(F.lower(w), F.lit(term), k) >= 0)
            hit = F.when(exact, 1.0).when(near, 0.8)
        else:
            hit = F.when(exact, 1.0)
        score = hit if score is None else F.coalesce(score, hit)
    return F.coalesce(score, F.lit(0.0)) if score is not None else F.lit(0.0)


def lexical(phrase: str, texts: list[Column]) -> Column:
    total = F.lit(0.0)
    for t in terms(phrase):
        total = total + term_score(t, texts)
    return total


def familiar(lex: Column, strength: Column, accesses: Column) -> Column:
    return 2.0 * lex + 1.5 * F.log1p(strength) + 0.5 * F.log1p(accesses.cast("double"))
