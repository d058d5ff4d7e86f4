"""Full-text functions: lexemes, queries, match and rank, all as Spark SQL text over arrays."""

from __future__ import annotations

import re

from ..errors import EngineError
from .scalar import quote

# The English stop words that can be whole lexemes (words with an apostrophe never are), in alphabetical order.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does "
    "doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself me more "
    "most my myself no nor not of off on once only or other ought our ours ourselves out over own same she should so some such than that the their theirs "
    "them themselves then there these they this those through to too under until up very was we were what when where which while who whom why with would "
    "you your yours yourself yourselves"
).split()
_STOP = frozenset(STOP_WORDS)
MAX_LEXEME = 63
_WORD = re.compile(r"[A-Za-z0-9_]+")


def lexemes(text: str) -> list[str]:
    """Lexemes of a text on the driver (for queries)."""
    words = (w.lower()[:MAX_LEXEME] for w in _WORD.findall(text))
    return [w for w in words if w not in _STOP]


def lexeme_array(sql: str) -> str:
    """array<string> of all lexemes in order, repeats included."""
    stop = ", ".join(map(quote, STOP_WORDS))  # so many literals become a hash set
    words = f"transform(regexp_extract_all({sql}, '[A-Za-z0-9_]+', 0), w -> left(lower(w), {MAX_LEXEME}))"
    return f"filter({words}, w -> w NOT IN ({stop}))"


def stored_array(sql: str) -> str:
    """Lexemes, each as often as it has positions, of a vector in its text form."""
    return f"transform(filter(split({sql}, ' '), w -> w <> ''), w -> substring_index(w, ':', 1))"


def vector_text(sql: str) -> str:
    """to_tsvector: ``lexeme:positions`` in order of first use. One sort of (lexeme, position) makes runs of one lexeme, a
    second one puts the runs in order of their first position: n log n in the words of a text."""

    def let(value: str, name: str, body: str) -> str:
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    sorted_pairs = f"sort_array(transform({lexeme_array(sql)}, (w, i) -> named_struct('w', w, 'p', i + 1)))"
    starts = "filter(sequence(0, size(ps)), k -> k = 0 OR k = size(ps) OR ps[k].w <> ps[k - 1].w)"  # and the end
    places = "array_join(transform(slice(ps, k + 1, ks[j + 1] - k), x -> CAST(x.p AS STRING)), ',')"
    runs = f"transform(slice(ks, 1, size(ks) - 1), (k, j) -> named_struct('p', ps[k].p, 't', concat(ps[k].w, ':', {places})))"
    joined = f"array_join(transform(sort_array({let(starts, 'ks', runs)}), x -> x.t), ' ')"
    return let(sorted_pairs, "ps", f"IF(size(ps) > 0, {joined}, IF(ps IS NULL, NULL, ''))")


# --- queries: trees of ('lex', word), ('and', l, r), ('or', l, r), ('not', x); None matches nothing


def parse_query(text: str):
    """to_tsquery text; ! binds tighter than &, & tighter than |. Stop words fold out."""
    parts = re.findall(r"[A-Za-z0-9_]+|[&|!()]|\S", text)
    at = 0

    def peek():
        return parts[at] if at < len(parts) else None

    def unary():
        nonlocal at
        p = peek()
        if p is None:
            raise EngineError("the text query ends too early")
        at += 1
        if p == "!":
            x = unary()
            return ("not", x) if x else None
        if p == "(":
            x = any_of()
            if peek() != ")":
                raise EngineError("the text query lacks a ')'")
            at += 1
            return x
        if _WORD.fullmatch(p):
            w = lexemes(p)
            return ("lex", w[0]) if w else None
        raise EngineError(f"unexpected '{p}' in a text query")

    def fold(op, left, right):
        return (op, left, right) if left and right else left or right

    def all_of():
        nonlocal at
        x = unary()
        while peek() == "&":
            at += 1
            x = fold("and", x, unary())
        return x

    def any_of():
        nonlocal at
        x = all_of()
        while peek() == "|":
            at += 1
            x = fold("or", x, all_of())
        return x

    if not parts:
        return None
    tree = any_of()
    if at < len(parts):
        raise EngineError(f"unexpected '{parts[at]}' in a text query")
    return tree


def plain_query(text: str):
    """plainto_tsquery: all lexemes."""
    tree = None
    for w in dict.fromkeys(lexemes(text)):
        tree = ("and", tree, ("lex", w)) if tree else ("lex", w)
    return tree


def query_text(tree) -> str:
    """Text form of a query."""
    rank = {"or": 0, "and": 1, "not": 2, "lex": 3}

    def show(t, least):
        if t[0] == "lex":
            s = t[1]
        elif t[0] == "not":
            s = "!" + show(t[1], 2)
        else:
            s = f"{show(t[1], rank[t[0]])} {'&' if t[0] == 'and' else '|'} {show(t[2], rank[t[0]] + 1)}"
        return f"({s})" if rank[t[0]] < least else s

    return show(tree, 0) if tree else ""


def match(array_sql: str, tree) -> str:
    """array @@ query."""
    if tree is None:
        return f"IF({array_sql} IS NULL, NULL, false)"
    return _conditions(tree, lambda w: f"array_contains({array_sql}, {quote(w)})")


def match_text(sql: str, tree) -> str:
    """to_tsvector(text) @@ query without the vector: a search for each lexeme as a whole word."""
    if tree is None:
        return f"IF({sql} IS NULL, NULL, false)"
    if any(len(w) >= MAX_LEXEME for w in _lexemes_of(tree)):  # longer words share this lexeme
        return match(lexeme_array(sql), tree)
    return _conditions(tree, lambda w: f"({sql} RLIKE '(?i)(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])')")


def _conditions(t, one) -> str:
    if t[0] == "lex":
        return one(t[1])
    if t[0] == "not":
        return f"(NOT {_conditions(t[1], one)})"
    return f"({_conditions(t[1], one)} {t[0].upper()} {_conditions(t[2], one)})"


def _lexemes_of(t) -> list[str]:
    return [t[1]] if t[0] == "lex" else [w for x in t[1:] for w in _lexemes_of(x)]


def positives(tree) -> list[str]:
    """Lexemes that are not negated, each once."""
    if tree is None:
        return []
    if tree[0] == "lex":
        return [tree[1]]
    if tree[0] == "not":
        return []
    return list(dict.fromkeys(positives(tree[1]) + positives(tree[2])))


def rank_text(sql: str, tree) -> str:
    """ts_rank of a text: sum of 1 / (1 + position) over all positions of positive lexemes, in one pass over its words."""
    words = positives(tree)
    if not words:
        return f"IF({sql} IS NULL, NULL, CAST(0 AS DOUBLE))"
    stop, those = (", ".join(map(quote, ws)) for ws in (STOP_WORDS, words))
    tokens = f"transform(regexp_extract_all({sql}, '[A-Za-z0-9_]+', 0), w -> left(lower(w), {MAX_LEXEME}))"
    step = f"IF(w IN ({stop}), a, named_struct('p', a.p + 1, 's', IF(w IN ({those}), a.s + 1D / (2 + a.p), a.s)))"
    return f"aggregate({tokens}, named_struct('p', 0, 's', 0D), (a, w) -> {step}, a -> a.s)"


def rank_stored(sql: str, tree) -> str:
    """ts_rank of a vector in its text form."""
    words = positives(tree)
    if not words:
        return f"IF({sql} IS NULL, NULL, CAST(0 AS DOUBLE))"
    those = "array(" + ", ".join(map(quote, words)) + ")"
    entries = f"filter(split({sql}, ' '), e -> array_contains({those}, substring_index(e, ':', 1)))"
    places = f"flatten(transform({entries}, e -> transform(split(substring_index(e, ':', -1), ','), p -> 1D / (1 + CAST(p AS INT)))))"
    return f"aggregate({places}, 0D, (s, x) -> s + x)"


def candidates(tree) -> list[str] | None:
    """Lexemes of which every matching row has at least one; None if there is no such list."""
    if tree is None:
        return []
    if tree[0] == "lex":
        return [tree[1]]
    if tree[0] == "not":
        return None
    left, right = candidates(tree[1]), candidates(tree[2])
    if tree[0] == "and":
        return left if left is not None else right
    return left + right if left is not None and right is not None else None
