"""From syntax trees to Spark SQL text; Catalyst does the rest.

A scope lists the sources of one SELECT and links to the scope around it, so correlated names resolve outwards.
Text compares without regard to case (collation UTF8_LCASE at the comparison, plain strings in results) unless
the engine is told to compare bytes, which Parquet can filter on.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import types as T

from ..errors import EngineError
from ..functions import fulltext as FT
from ..functions import scalar as S
from . import ast as A
from .parser import parse_query

Value = tuple[str, str]
PSEUDO = {"_rid": "int", "_strength": "float", "_access": "int", "_access_count": "int", "_last": "int", "_last_access": "int", "_score": "float"}
STATEFUL = ("_strength", "_access", "_access_count", "_last", "_last_access")


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def spark_kind(t: T.DataType) -> str:
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(t, T.FloatType | T.DoubleType | T.DecimalType):
        return "float"
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "ts"
    return "null" if isinstance(t, T.NullType) else "other"


@dataclass
class Source:
    """One table of a FROM: SQL of the relation, the names it answers to and its columns with their kinds."""

    relation: str
    alias: str
    names: tuple[str, ...]
    columns: list[tuple[str, str]]
    table: str | None = None  # a table of the catalog, with memory


@dataclass
class Scope:
    sources: list[Source] = field(default_factory=list)
    outer: Scope | None = None
    names_outer: bool = False  # whether anything in it came from outside


@dataclass
class Compiled:
    sql: str
    names: list[str]
    kinds: list[str]
    correlated: bool = False
    single_row: bool = False  # an aggregate without groups


class Compiler:
    def __init__(self, engine, variables: dict | None = None, capture: bool = False):
        self.engine, self.vars = engine, variables if variables is not None else {}
        self.fold = engine.string_semantics == "fold"
        self.n = 0
        self.capture = capture

    def fresh(self, stem: str) -> str:
        self.n += 1
        return f"_{stem}{self.n}"

    def ci(self, sql: str, kind: str) -> str:
        return f"({sql} COLLATE UTF8_LCASE)" if kind == "text" and self.fold else sql

    # --- names

    def resolve(self, name: A.Name, scope: Scope | None) -> Value:
        at, depth = scope, 0
        while at is not None:
            found = []
            for s in at.sources:
                if name.table is not None and name.table.lower() not in s.names:
                    continue
                for c, kind in s.columns:
                    if c.lower() == name.column.lower():
                        found.append((f"{ident(s.alias)}.{ident(c)}", kind))
                if s.table is not None and name.column.lower() in PSEUDO:
                    col = name.column.lower()
                    if col == "_score":
                        found.append(("CAST(0 AS DOUBLE)", "float"))
                    else:
                        col = {"_access_count": "_access", "_last_access": "_last"}.get(col, col)
                        found.append((f"{ident(s.alias)}.{ident(col)}", PSEUDO[col]))
            if len(found) > 1:
                raise EngineError(f"column '{name.column}' is ambiguous")
            if found:
                if depth:
                    scope.names_outer = True
                    inner = scope
                    while inner is not at:
                        inner.names_outer = True
                        inner = inner.outer
                return found[0]
            at, depth = at.outer, depth + 1
        what = f"{name.table}.{name.column}" if name.table else name.column
        raise EngineError(f"no column '{what}'")

    # --- expressions

    def bool_sql(self, e, scope) -> str:
        return S.as_bool(self.expr(e, scope))

    def expr(self, e, scope: Scope | None) -> Value:
        return getattr(self, "_" + type(e).__name__.lower())(e, scope)

    def _lit(self, e: A.Lit, scope) -> Value:
        return S.literal(e.value)

    def _var(self, e: A.Var, scope) -> Value:
        if e.name not in self.vars:
            raise EngineError(f"variable {e.name} is not defined")
        v = self.vars[e.name]
        if isinstance(v, datetime | date):
            v = str(v)
        return S.literal(v)

    def _name(self, e: A.Name, scope) -> Value:
        if e.column.upper() in S.CLOCK and e.table is None and not self._known(e, scope):
            return self.engine.clock_sql(), "text"
        return self.resolve(e, scope)

    def _known(self, e, scope) -> bool:
        try:
            self.resolve(e, scope)
            return True
        except EngineError:
            return False

    def _star(self, e, scope):
        raise EngineError("* is only for select lists and COUNT(*)")

    def _neg(self, e: A.Neg, scope) -> Value:
        sql, kind = self.expr(e.x, scope)
        if kind in ("text", "null"):
            return "CAST(NULL AS DOUBLE)", "float"
        sql, kind = S.as_number((sql, kind))
        return f"(- {sql})", kind

    def _not(self, e: A.Not, scope) -> Value:
        return f"(NOT {self.bool_sql(e.x, scope)})", "bool"

    def _bin(self, e: A.Bin, scope) -> Value:
        if e.op in ("AND", "OR"):
            return f"({self.bool_sql(e.left, scope)} {e.op} {self.bool_sql(e.right, scope)})", "bool"
        if e.op == "@@":
            return self.match(e, scope), "bool"
        left, right = self.expr(e.left, scope), self.expr(e.right, scope)
        if e.op in ("=", "<>", "<", "<=", ">", ">="):
            return self.compare(e.op, left, right), "bool"
        if e.op == "+" and "text" in (left[1], right[1]):
            return f"concat({S.as_text(left)}, {S.as_text(right)})", "text"
        if e.op == "/":
            return f"({S.as_double(left)} / {S.as_double(right)})", "float"
        (a, ka), (b, kb) = S.as_number(left), S.as_number(right)
        if ka == kb == "int":
            if e.op == "%":
                return f"({a} % {b})", "int"
            return f"(CAST({a} AS BIGINT) {e.op} CAST({b} AS BIGINT))", "int"
        return f"({a} {e.op} {b})", "float"

    def compare(self, op: str, left: Value, right: Value) -> str:
        a, b = self.comparable(left, right)
        return f"({a} {op} {b})"

    def comparable(self, left: Value, right: Value) -> tuple[str, str]:
        ka, kb = left[1], right[1]
        if "null" in (ka, kb):
            return left[0], right[0]
        if ka == kb == "text":
            return self.ci(left[0], ka), self.ci(right[0], kb)
        if "ts" in (ka, kb):
            one = lambda v: v[0] if v[1] == "ts" else f"CAST({v[0]} AS TIMESTAMP)"
            return one(left), one(right)
        if "other" in (ka, kb):
            return left[0], right[0]
        (a, _), (b, _) = S.as_number(left), S.as_number(right)
        return a, b

    def _isnull(self, e: A.IsNull, scope) -> Value:
        return f"({self.expr(e.x, scope)[0]} IS {'NOT ' * e.negated}NULL)", "bool"

    def _between(self, e: A.Between, scope) -> Value:
        x, low, high = (self.expr(v, scope) for v in (e.x, e.low, e.high))
        sql = f"({self.compare('>=', x, low)} AND {self.compare('<=', x, high)})"
        return f"(NOT {sql})" if e.negated else sql, "bool"

    def _like(self, e: A.Like, scope) -> Value:
        x, p = S.as_text(self.expr(e.x, scope)), self.expr(e.pattern, scope)
        word = "ILIKE" if self.fold else "LIKE"
        if isinstance(e.pattern, A.Lit) and isinstance(e.pattern.value, str):
            # Spark knows one escape character only, so the pattern is rewritten for the default one
            out, raw, i = "", e.pattern.value, 0
            while i < len(raw):
                c = raw[i]
                if e.escape and c == e.escape and i + 1 < len(raw):
                    i += 1
                    out += "\\" + raw[i] if raw[i] in "%_\\" else raw[i]
                else:
                    out += "\\\\" if c == "\\" else c
                i += 1
            pattern = S.quote(out)
        elif e.escape:
            return f"({x} {'NOT ' * e.negated}{word} {S.as_text(p)} ESCAPE {S.quote(e.escape)})", "bool"
        else:
            pattern = f"replace({S.as_text(p)}, {S.quote(chr(92))}, {S.quote(chr(92) * 2)})"
        return f"({x} {'NOT ' * e.negated}{word} {pattern})", "bool"

    def _inlist(self, e: A.InList, scope) -> Value:
        x, items = self.expr(e.x, scope), [self.expr(i, scope) for i in e.items]
        pairs = [self.comparable(x, i) for i in items]
        if len({a for a, _ in pairs}) == 1:
            return f"({pairs[0][0]} {'NOT ' * e.negated}IN ({', '.join(b for _, b in pairs)}))", "bool"
        sql = "(" + " OR ".join(f"{a} = {b}" for a, b in pairs) + ")"
        return f"(NOT {sql})" if e.negated else sql, "bool"

    def column_query(self, q: A.Select, scope, wanted: Value | None = None) -> tuple[Compiled, str, str]:
        """A one-column subquery, its column as SQL and its kind."""
        c = self.select(q, Scope(outer=scope))
        if len(c.names) != 1:
            raise EngineError("a subquery here needs exactly one column")
        return c, c.names[0], c.kinds[0]

    def _inquery(self, e: A.InQuery, scope) -> Value:
        x = self.expr(e.x, scope)
        c, _, kind = self.column_query(e.query, scope)
        t = self.fresh("s")
        a, b = self.comparable(x, (f"{t}.c0", kind))
        return f"({a} {'NOT ' * e.negated}IN (SELECT {b} FROM ({c.sql}) AS {t}(c0)))", "bool"

    def _exists(self, e: A.Exists, scope) -> Value:
        return f"EXISTS ({self.select(e.query, Scope(outer=scope)).sql})", "bool"

    def _quantified(self, e: A.Quantified, scope) -> Value:
        if e.op == "=" and e.kind == "ANY":
            return self._inquery(A.InQuery(e.x, e.query, False), scope)
        x = self.expr(e.x, scope)
        c, _, kind = self.column_query(e.query, scope)
        t = self.fresh("s")
        col = (f"{t}.c0", kind)
        a, b = self.comparable(x, col)

        def pick(agg: str) -> str:
            return f"(SELECT {agg}({b}) FROM ({c.sql}) AS {t}(c0))"

        if e.op in ("=", "<>"):
            every = f"({a} = {pick('min')} AND {a} = {pick('max')})"
            if e.op == "=":  # = ALL
                return f"({pick('count')} = 0 OR coalesce({every}, false))", "bool"
            if e.kind == "ANY":
                return f"coalesce(NOT {every}, false)", "bool"
            inside = f"coalesce({a} IN (SELECT {b} FROM ({c.sql}) AS {t}(c0) WHERE {t}.c0 IS NOT NULL), false)"
            return f"(NOT {inside})", "bool"
        bound = pick("min" if (e.op in (">", ">=")) == (e.kind == "ANY") else "max")
        if e.kind == "ANY":
            return f"coalesce({a} {e.op} {bound}, false)", "bool"
        return f"({pick('count')} = 0 OR coalesce({a} {e.op} {bound}, false))", "bool"

    def _scalar(self, e: A.Scalar, scope) -> Value:
        c, _, kind = self.column_query(e.query, scope)
        if c.single_row:
            return f"({c.sql})", kind
        t = self.fresh("s")
        if c.correlated:  # the first of several rows; Spark wants an aggregate here
            return f"(SELECT first({t}.c0) FROM ({c.sql}) AS {t}(c0))", kind
        return f"(SELECT {t}.c0 FROM ({c.sql}) AS {t}(c0) LIMIT 1)", kind

    def _case(self, e: A.Case, scope) -> Value:
        values = [self.expr(v, scope) for _, v in e.whens] + [self.expr(e.default, scope) if e.default is not None else S.literal(None)]
        sqls, kind = S.common(values)
        if e.operand is not None:
            x = self.expr(e.operand, scope)
            conds = [self.compare("=", x, self.expr(c, scope)) for c, _ in e.whens]
        else:
            conds = [self.bool_sql(c, scope) for c, _ in e.whens]
        arms = " ".join(f"WHEN {c} THEN {v}" for c, v in zip(conds, sqls, strict=False))
        return f"(CASE {arms} ELSE {sqls[-1]} END)", kind

    def _cast(self, e: A.Cast, scope) -> Value:
        return S.cast(self.expr(e.x, scope), e.type.name, e.type.length)

    def _func(self, e: A.Func, scope) -> Value:
        if e.name in S.AGGREGATES:
            return self.aggregate(e, scope)
        if e.name in S.CLOCK:
            if e.args:
                raise EngineError(f"{e.name} takes no arguments")
            return self.engine.clock_sql(), "text"
        if e.name == "TO_TSVECTOR":
            self.arity(e, 1)
            return FT.vector_text(S.as_text(self.expr(e.args[0], scope))), "text"
        if e.name in ("TO_TSQUERY", "PLAINTO_TSQUERY"):
            return S.quote(FT.query_text(self.text_query(e, scope))), "text"
        if e.name == "TS_RANK":
            self.arity(e, 2)
            tree = self.text_query(e.args[1], scope)
            vec = e.args[0]
            if isinstance(vec, A.Func) and vec.name == "TO_TSVECTOR":
                return FT.rank_text(S.as_text(self.expr(vec.args[0], scope)), tree), "float"
            return FT.rank_stored(S.as_text(self.expr(vec, scope)), tree), "float"
        return S.call(e.name, [self.expr(a, scope) for a in e.args])

    def arity(self, e: A.Func, n: int):
        if len(e.args) != n:
            raise EngineError(f"{e.name} takes {n} argument{'s' * (n != 1)}, not {len(e.args)}")

    def constant_text(self, e, scope) -> str:
        if isinstance(e, A.Lit) and isinstance(e.value, str):
            return e.value
        if isinstance(e, A.Var) and isinstance(self.vars.get(e.name), str):
            return self.vars[e.name]
        raise EngineError("a text query must be a constant")

    def text_query(self, e, scope):
        if isinstance(e, A.Func) and e.name in ("TO_TSQUERY", "PLAINTO_TSQUERY"):
            self.arity(e, 1)
            text = self.constant_text(e.args[0], scope)
            return FT.parse_query(text) if e.name == "TO_TSQUERY" else FT.plain_query(text)
        return FT.parse_query(self.constant_text(e, scope))

    def match(self, e: A.Bin, scope) -> str:
        vec = e.left
        if isinstance(vec, A.Func) and vec.name == "TO_TSVECTOR":
            self.arity(vec, 1)
            return FT.match_text(S.as_text(self.expr(vec.args[0], scope)), self.text_query(e.right, scope))
        return FT.match(FT.stored_array(S.as_text(self.expr(vec, scope))), self.text_query(e.right, scope))

    def aggregate(self, e: A.Func, scope) -> Value:
        if e.star:
            if e.name != "COUNT":
                raise EngineError(f"{e.name}(*) is not an aggregate")
            return "count(1)", "int"
        self.arity(e, 1)
        if has_aggregate(e.args[0]):
            raise EngineError("an aggregate can't be inside of another")
        v = self.expr(e.args[0], scope)
        d = "DISTINCT " * e.distinct
        if e.name == "COUNT":
            return f"count({d}{self.ci(*v)})", "int"
        if e.name == "SUM":
            sql, kind = S.as_number(v)
            return (f"sum({d}CAST({sql} AS BIGINT))" if kind == "int" else f"sum({d}{sql})"), kind
        if e.name == "AVG":
            return f"avg({d}{S.as_double(v)})", "float"
        sql, kind = v
        if kind == "bool":
            sql, kind = f"CAST({sql} AS INT)", "int"
        if kind == "text" and self.fold:
            return f"({e.name.lower()}({self.ci(sql, kind)}) COLLATE UTF8_BINARY)", kind
        return f"{e.name.lower()}({sql})", kind

    # --- queries

    def relation(self, s: A.Source, scope: Scope, wanted: set[str]) -> Source:
        if s.query is not None:
            c = self.select(s.query, Scope(outer=None))
            return Source(f"({c.sql})", s.alias, (s.alias.lower(),), list(zip(c.names, c.kinds, strict=True)))
        alias = s.alias or s.table
        names = (alias.lower(),) if s.alias else (s.table.lower(),)
        view = self.engine.view_text(s.table)
        if view is not None:
            c = self.select(parse_query(view), Scope())
            return Source(f"({c.sql})", alias, names, list(zip(c.names, c.kinds, strict=True)))
        relation, columns, managed = self.engine.relation(s.table, bool(wanted & set(STATEFUL)))
        return Source(relation, alias, names, columns, s.table if managed else None)

    def from_sql(self, core: A.Core, scope: Scope, order=()) -> str:
        wanted = {n.lower() for n in names_in(core) | names_in(tuple(e for e, _ in order))}
        sources = [core.source, *(j.source for j in core.joins)]
        out = ""
        for i, s in enumerate(sources):
            src = self.relation(s, scope, wanted)
            if any(src.alias.lower() == o.alias.lower() for o in scope.sources):
                raise EngineError(f"the name '{src.alias}' is used twice, give an alias")
            cols = ""
            if s.query is not None or self.engine.view_text(s.table or "") is not None:
                cols = "(" + ", ".join(ident(c) for c, _ in src.columns) + ")"
            scope.sources.append(src)
            piece = f"{src.relation} AS {ident(src.alias)}{cols}"
            if i == 0:
                out = piece
            else:
                j = core.joins[i - 1]
                word = {"INNER": "JOIN", "LEFT": "LEFT JOIN", "RIGHT": "RIGHT JOIN", "FULL": "FULL JOIN", "CROSS": "CROSS JOIN"}[j.kind]
                out += f" {word} {piece}" + (f" ON {self.bool_sql(j.on, scope)}" if j.on is not None else "")
        return out

    def index_hint(self, core: A.Core, scope: Scope) -> str | None:
        """A semi-join with the postings of a text index, if a conjunct of WHERE can use one."""
        if core.where is None or core.joins or not scope.sources or scope.sources[0].table is None:
            return None
        for c in conjuncts(core.where):
            if isinstance(c, A.Bin) and c.op == "@@" and isinstance(c.left, A.Func) and c.left.name == "TO_TSVECTOR" and len(c.left.args) == 1 and isinstance(c.left.args[0], A.Name):
                try:
                    words = FT.candidates(self.text_query(c.right, scope))
                except EngineError:
                    continue
                view = self.engine.postings(scope.sources[0].table, c.left.args[0].column) if words else None
                if view:
                    those = ", ".join(map(S.quote, words))
                    return f"{ident(scope.sources[0].alias)}._rid IN (SELECT rid FROM {view} WHERE lexeme IN ({those}))"
        return None

    def items(self, core: A.Core, scope: Scope) -> list[tuple[str, str, str]]:
        """(sql, name, kind) of the select list, stars expanded."""
        out = []
        for item in core.items:
            if isinstance(item.expr, A.Star):
                if not scope.sources:
                    raise EngineError("* needs a FROM")
                found = False
                for s in scope.sources:
                    if item.expr.table is None or item.expr.table.lower() in s.names:
                        found = True
                        out += [(f"{ident(s.alias)}.{ident(c)}", c, k) for c, k in s.columns if not c.startswith("_")]
                if not found:
                    raise EngineError(f"unknown table '{item.expr.table}'")
                continue
            sql, kind = self.expr(item.expr, scope)
            if kind == "bool":
                sql, kind = f"CAST({sql} AS INT)", "int"
            out.append((sql, item.alias or label(item.expr), kind))
        return out

    def core(self, core: A.Core, scope: Scope, order=(), limit=None, offset=None, extra: list[str] | None = None) -> Compiled:
        """One SELECT with the ORDER BY and limits that are its own. extra: more columns for the memory layer."""
        frm = self.from_sql(core, scope, order) if core.source else ""
        grouped = bool(core.group) or any(has_aggregate(i.expr) for i in core.items) or has_aggregate(core.having) or any(has_aggregate(e) for e, _ in order)
        items = self.items(core, scope)
        if grouped and any(isinstance(i.expr, A.Star) for i in core.items):
            raise EngineError("SELECT * can't be grouped")
        names, kinds = [n for _, n, _ in items], [k for *_, k in items]
        where = [self.bool_sql(core.where, scope)] if core.where is not None else []
        if has_aggregate(core.where):
            raise EngineError("WHERE can't have aggregates, use HAVING")
        if hint := self.index_hint(core, scope):
            where.insert(0, hint)
        tail = f" FROM {frm}" if frm else ""
        tail += f" WHERE {' AND '.join(where)}" if where else ""
        if core.group:
            keys = []
            for g in core.group:
                sql, kind = self.expr(g, scope)
                keys.append(sql)
            tail += f" GROUP BY {', '.join(keys)}"
        if core.having is not None:
            tail += f" HAVING {self.bool_sql(core.having, scope)}"
            if not grouped:
                raise EngineError("HAVING needs GROUP BY or an aggregate")
        if core.top is not None:
            limit = core.top if limit is None else min(limit, core.top)
        cut = (f" LIMIT {limit}" if limit is not None else "") + (f" OFFSET {offset}" if offset else "")
        stable = not grouped and scope.sources and scope.sources[0].table is not None
        rid = f"{ident(scope.sources[0].alias)}._rid" if stable else None
        if core.distinct:
            return self.distinct(core, scope, items, tail, order, cut, rid)
        cols = [f"{sql} AS {ident(n)}" for sql, n, _ in items] + (extra or [])
        keys = [self.order_key(e, desc, items, scope, grouped) for e, desc in order]
        if keys and rid:
            keys.append(rid)
        sql = f"SELECT {', '.join(cols)}{tail}" + (f" ORDER BY {', '.join(keys)}" if keys else "") + cut
        single = grouped and not core.group
        return Compiled(sql, names, kinds, scope.names_outer, single)

    def order_key(self, e, desc: bool, items, scope, grouped: bool) -> str:
        word = " DESC" * desc
        if isinstance(e, A.Lit) and isinstance(e.value, int):
            if not 1 <= e.value <= len(items):
                raise EngineError(f"ORDER BY position {e.value} is not in the select list")
            sql, _, kind = items[e.value - 1]
            return self.ci(sql, kind) + word
        if isinstance(e, A.Name) and e.table is None and (grouped or not self._known(e, Scope(scope.sources))):
            for sql, n, kind in items:
                if n.lower() == e.column.lower():
                    return self.ci(sql, kind) + word
        return self.ci(*self.expr(e, scope)) + word

    def distinct(self, core, scope, items, tail, order, cut, rid) -> Compiled:
        names, kinds = [n for _, n, _ in items], [k for *_, k in items]
        cs = [f"c{i}" for i in range(len(items))]
        inner = ", ".join(f"{sql} AS {c}" for (sql, _, _), c in zip(items, cs, strict=True))
        keys, outside = [], []
        for e, desc in order:
            sql = self.order_key(e, False, items, scope, True)
            at = next((i for i, (s, _, k) in enumerate(items) if self.ci(s, k) == sql), None)
            if at is None:
                outside.append(sql)
                keys.append((f"o{len(outside) - 1}", desc))
            else:
                keys.append((self.ci(cs[at], kinds[at]), desc))
        by = [self.ci(c, k) for c, k in zip(cs, kinds, strict=True)]
        out = ", ".join(f"{c} AS {ident(n)}" for c, n in zip(cs, names, strict=True))
        more = "".join(f", {s} AS o{i}" for i, s in enumerate(outside))
        if outside:  # the first row of each kind gives the order
            first = rid or "1"
            body = (
                f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY _r) AS _n "
                f"FROM (SELECT {inner}{more}, {first} AS _r{tail})) WHERE _n = 1"
            )
        elif any(k == "text" and self.fold for k in kinds):
            agg = ", ".join(f"min({c}) AS {c}" for c in cs)
            body = f"SELECT {agg} FROM (SELECT {inner}{tail}) GROUP BY {', '.join(by)}"
        else:
            body = f"SELECT DISTINCT {', '.join(cs)} FROM (SELECT {inner}{tail})"
        sort = f" ORDER BY {', '.join(k + ' DESC' * d for k, d in keys)}" if keys else ""
        return Compiled(f"SELECT {out} FROM ({body}){sort}{cut}", names, kinds, scope.names_outer)

    def select(self, q: A.Select, scope: Scope, extra: list[str] | None = None) -> Compiled:
        if not q.rest:
            if isinstance(q.first, A.Select):
                if not (q.order or q.limit is not None or q.offset):
                    return self.select(q.first, scope)
                c = self.select(q.first, scope)
                return self.finish(c, q)
            return self.core(q.first, scope, q.order, q.limit, q.offset, extra)

        def operand(o) -> Compiled:
            s = Scope(outer=scope.outer)
            c = self.select(o, s) if isinstance(o, A.Select) else self.core(o, s)
            scope.names_outer |= s.names_outer
            return c

        left = operand(q.first)
        for op, o in q.rest:
            left = self.combine(op, left, operand(o))
        left.correlated = scope.names_outer
        return self.finish(left, q)

    def finish(self, c: Compiled, q: A.Select) -> Compiled:
        """ORDER BY and limits of a compound."""
        t = self.fresh("u")
        inner = Scope([Source("", t, (t,), list(zip(c.names, c.kinds, strict=True)))])
        cs = ", ".join(ident(n) for n in c.names)
        items = [(f"{t}.{ident(n)}", n, k) for n, k in zip(c.names, c.kinds, strict=True)]
        keys = [self.order_key(e, d, items, inner, False) for e, d in q.order]
        cut = (f" LIMIT {q.limit}" if q.limit is not None else "") + (f" OFFSET {q.offset}" if q.offset else "")
        if not keys and not cut:
            return c
        sort = f" ORDER BY {', '.join(keys)}" if keys else ""
        out = ", ".join(f"{s} AS {ident(n)}" for s, n, _ in items)
        return Compiled(f"SELECT {out} FROM ({c.sql}) AS {t}({cs}){sort}{cut}", c.names, c.kinds, c.correlated)

    def combine(self, op: str, a: Compiled, b: Compiled) -> Compiled:
        if len(a.names) != len(b.names):
            raise EngineError(f"{op} needs as many columns on both sides: {len(a.names)} and {len(b.names)}")
        pairs = [S.common([(f"c{i}", x), (f"c{i}", y)]) for i, (x, y) in enumerate(zip(a.kinds, b.kinds, strict=True))]
        kinds = [k for _, k in pairs]
        cs = [f"c{i}" for i in range(len(kinds))]
        alias = ", ".join(cs)
        sides = []
        for n, c in enumerate((a, b)):
            cols = ", ".join(f"{sqls[n]} AS {x}" for (sqls, _), x in zip(pairs, cs, strict=True))
            sides.append(f"SELECT {cols} FROM ({c.sql}) AS {self.fresh('o')}({alias})")
        out = ", ".join(f"{c} AS {ident(n)}" for c, n in zip(cs, a.names, strict=True))
        by = ", ".join(self.ci(c, k) for c, k in zip(cs, kinds, strict=True))

        def unique(sql: str) -> str:
            if any(k == "text" and self.fold for k in kinds):
                return f"SELECT {', '.join(f'min({c}) AS {c}' for c in cs)} FROM ({sql}) GROUP BY {by}"
            return f"SELECT DISTINCT {alias} FROM ({sql})"

        if op == "UNION ALL":
            body = f"{sides[0]} UNION ALL {sides[1]}"
        elif op == "UNION":
            body = unique(f"{sides[0]} UNION ALL {sides[1]}")
        else:
            x, y = self.fresh("x"), self.fresh("y")
            same = " AND ".join(f"{self.ci(f'{x}.{c}', k)} <=> {self.ci(f'{y}.{c}', k)}" for c, k in zip(cs, kinds, strict=True))
            kind = "LEFT SEMI" if op == "INTERSECT" else "LEFT ANTI"
            body = f"SELECT {', '.join(f'{x}.{c}' for c in cs)} FROM ({unique(sides[0])}) AS {x} {kind} JOIN ({sides[1]}) AS {y} ON {same}"
        return Compiled(f"SELECT {out} FROM ({body})", a.names, kinds, a.correlated or b.correlated)


# --- walks over trees


def children(e):
    if isinstance(e, tuple | list):
        yield from e
    elif hasattr(e, "__dataclass_fields__"):
        for f in e.__dataclass_fields__:
            yield getattr(e, f)


def has_aggregate(e) -> bool:
    """Whether an expression has an aggregate of its own query."""
    if isinstance(e, A.Func) and e.name in S.AGGREGATES:
        return True
    if e is None or isinstance(e, A.Select | A.Core | str | int | float):
        return False
    return any(has_aggregate(c) for c in children(e))


def names_in(e) -> set[str]:
    """Column names anywhere in a query."""
    if isinstance(e, A.Name):
        return {e.column}
    if e is None or isinstance(e, str | int | float | bool):
        return set()
    return set().union(*(names_in(c) for c in children(e)))


def conjuncts(e):
    if isinstance(e, A.Bin) and e.op == "AND":
        yield from conjuncts(e.left)
        yield from conjuncts(e.right)
    else:
        yield e


def label(e) -> str:
    if isinstance(e, A.Name):
        return e.column
    if isinstance(e, A.Func):
        if e.star:
            return f"{e.name}(*)"
        if len(e.args) == 1 and isinstance(e.args[0], A.Name):
            return f"{e.name}({e.args[0].column})"
        return f"{e.name}(...)" if e.args else f"{e.name}()"
    if isinstance(e, A.Cast):
        return "cast"
    if isinstance(e, A.Case):
        return "case"
    return "value" if isinstance(e, A.Lit) else "expr"
