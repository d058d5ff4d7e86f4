"""Constraint checks over sets of rows: each is one query that must find nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError


def key(df: DataFrame, column: str, text: bool) -> Column:
    """A key column for comparison; text keys collide without regard to case."""
    c = df[f"`{column}`"]
    return F.collate(c, "UTF8_LCASE") if text else c


def first(df: DataFrame):
    rows = df.limit(1).collect()
    return rows[0] if rows else None


def not_null(df: DataFrame, columns: list[str]):
    for c in columns:
        if first(df.where(F.col(f"`{c}`").isNull()).select(F.lit(1))):
            raise EngineError(f"column '{c}' does not accept NULL")


def violations_check(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a condition is false (unknown passes)."""
    return df.where(f"NOT coalesce(({condition}), true)")


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that occur twice or more; nulls never collide."""
    d = df
    for c in columns:
        d = d.where(F.col(f"`{c}`").isNotNull())
    return d.groupBy(*[F.col(f"`{c}`") for c in columns]).count().where("count > 1")


def unique(new: DataFrame, old: DataFrame | None, column: str, text: bool, what: str):
    k = F.collate(F.col(f"`{column}`"), "UTF8_LCASE") if text else F.col(f"`{column}`")
    found = first(new.where(F.col(f"`{column}`").isNotNull()).groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.min(f"`{column}`").alias("v")).where("n > 1").select("v"))
    if found is None and old is not None:
        a, b = new.select(k.alias("k"), F.col(f"`{column}`").alias("v")), old.select(k.alias("k"))
        found = first(a.join(b, "k", "left_semi").select("v"))
    if found is not None:
        raise EngineError(f"{what} '{found['v']}' already exists")


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, targets: list[str], texts: list[bool]) -> DataFrame:
    """Child rows whose whole key is not null and has no parent."""
    c = child
    for x in columns:
        c = c.where(F.col(f"`{x}`").isNotNull())
    return c.join(parent.select(*[F.col(f"`{x}`") for x in dict.fromkeys(targets)]), on_keys(c, columns, parent, targets, texts), "left_anti")


def on_keys(child: DataFrame, columns: list[str], parent: DataFrame, targets: list[str], texts: list[bool]) -> Column:
    cond = None
    for c, p, t in zip(columns, targets, texts, strict=True):
        one = key(child, c, t) == key(parent, p, t)
        cond = one if cond is None else cond & one
    return cond
