"""Syntax trees: one frozen class for each kind of expression, one class for each kind of statement."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# --- expressions


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    x: Any


@dataclass(frozen=True)
class Neg:
    x: Any


@dataclass(frozen=True)
class Func:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Case:
    operand: Any
    whens: tuple
    default: Any


@dataclass(frozen=True)
class Type:
    name: str
    length: int | None = None  # None: no limit


@dataclass(frozen=True)
class Cast:
    x: Any
    type: Type


@dataclass(frozen=True)
class IsNull:
    x: Any
    negated: bool


@dataclass(frozen=True)
class Between:
    x: Any
    low: Any
    high: Any
    negated: bool


@dataclass(frozen=True)
class Like:
    x: Any
    pattern: Any
    escape: str | None
    negated: bool


@dataclass(frozen=True)
class InList:
    x: Any
    items: tuple
    negated: bool


@dataclass(frozen=True)
class InQuery:
    x: Any
    query: Any
    negated: bool


@dataclass(frozen=True)
class Exists:
    query: Any


@dataclass(frozen=True)
class Quantified:
    op: str
    kind: str  # ANY, ALL
    x: Any
    query: Any


@dataclass(frozen=True)
class Scalar:
    query: Any


# --- queries


@dataclass(frozen=True)
class Source:
    table: str | None
    query: Any
    alias: str | None


@dataclass(frozen=True)
class Join:
    kind: str  # INNER, LEFT, ...
    source: Source
    on: Any


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None


@dataclass(frozen=True)
class Core:
    items: tuple
    source: Source | None
    joins: tuple
    where: Any
    group: tuple
    having: Any
    distinct: bool
    top: int | None


@dataclass(frozen=True)
class Select:
    first: Core
    rest: tuple  # of (UNION, UNION ALL, INTERSECT or EXCEPT; Core)
    order: tuple  # of (expression, descending)
    limit: int | None
    offset: int | None


# --- statements


@dataclass
class ColumnDef:
    name: str
    type: Type
    not_null: bool = False
    primary: bool = False
    unique: bool = False
    default: Any = None  # an expression
    identity: tuple | None = None  # (seed, step)
    check: str | None = None
    ref: tuple | None = None  # (table, [columns], on delete, on update)


@dataclass
class Statement:
    kind: str
    f: dict = field(default_factory=dict)
    text: str = ""

    def __getattr__(self, name):
        try:
            return self.__dict__["f"][name]
        except KeyError:
            raise AttributeError(name) from None
