"""Tokens of the dialect: one pattern, names and keywords without regard to case."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import SyntaxProblem

_TOKEN = re.compile(
    r"""
    (?P<skip>\s+ | --[^\n]* | /\*.*?\*/)
  | (?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
  | (?P<str>[nN]?'(?:[^']|'')*')
  | (?P<quoted>\[[^\]]*\] | "[^"]*")
  | (?P<sys>@@(?:error_message|fetch_status)\b)
  | (?P<var>@[A-Za-z_][\w$\#]*)
  | (?P<id>[A-Za-z_][\w$\#]*)
  | (?P<op>@@ | <> | != | <= | >= | \|\| | [(),;*=<>+\-/.%])
    """,
    re.X | re.S | re.I,
)
LONG_MAX = 2**63 - 1


@dataclass(frozen=True)
class Token:
    kind: str  # num, str, quoted, sys, var, id, op, end
    text: str
    value: object
    start: int
    stop: int

    def word(self) -> str:
        """Upper-cased keyword; empty for what can't be one."""
        return self.text.upper() if self.kind == "id" else ""


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            what = "unterminated string" if text[at] == "'" else f"unexpected character {text[at]!r}"
            raise SyntaxProblem(f"{what} at position {at}")
        if text.startswith("/*", at) and m.lastgroup != "skip":
            raise SyntaxProblem("unterminated comment")
        kind, piece = m.lastgroup, m.group()
        if kind != "skip":
            out.append(Token(kind, piece, _value(kind, piece), at, m.end()))
        at = m.end()
    out.append(Token("end", "", None, len(text), len(text)))
    return out


def _value(kind: str, piece: str):
    if kind == "num":
        if re.fullmatch(r"\d+", piece):
            if int(piece) > LONG_MAX:
                raise SyntaxProblem(f"number {piece} is too large")
            return int(piece)
        return float(piece)
    if kind == "str":
        return piece[piece.index("'") + 1 : -1].replace("''", "'")
    if kind == "quoted":
        return piece[1:-1]
    if kind in ("var", "sys"):
        return piece.lower()
    return piece
