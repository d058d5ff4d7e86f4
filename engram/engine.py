"""The engine: statements of the dialect over managed tables and registered DataFrames.

    engine = Engine(spark, path)
    engine.register("orders", spark.read.parquet(...))
    engine.sql("SELECT TOP 3 ...").show()

Queries compile to Spark SQL and stay lazy. Reads of managed tables are remembered (unless ``observer``): the engine
appends to an access log after the rows are known, from which strengths and links follow.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError, SyntaxProblem
from .functions import fulltext as FT
from .functions import memory as M
from .functions import scalar as S
from .operators import memory as OM
from .operators.dml import Dml
from .plans import ast as A
from .plans.compiler import Compiler, Scope, Source, has_aggregate, ident, names_in, spark_kind, STATEFUL
from .plans.parser import Parser
from .plans.procedures import Frame, Interpreter
from .sources.storage import Storage


POSTINGS = "lexeme string, rid bigint"
#: Statements after which the catalog is as it was.
READS = ("select", "explain", "print", "begin", "commit", "rollback", "show_tables", "show_memory", "show_links")


@dataclass
class Result:
    """What one statement gave: rows, or a message."""

    df: DataFrame | None = None
    message: str | None = None


def rows_text(n: int, what: str) -> str:
    return f"({n} row{'s' * (n != 1)} {what})"


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        path: str | None = None,
        observer: bool = False,
        string_semantics: str = "fold",
        clock: Callable[[], float] | None = None,
        on_error: str = "stop",
    ):
        if string_semantics not in ("fold", "binary"):
            raise ValueError("string_semantics is fold or binary")
        if on_error not in ("stop", "continue"):
            raise ValueError("on_error is stop or continue")
        self.spark, self.observer, self.string_semantics, self.on_error = spark, observer, string_semantics, on_error
        self.clock = clock or time.time
        self.storage = Storage(spark, path)
        self.external: dict[str, tuple[str, list]] = {}
        self.dml = Dml(self)
        self.interpreter = Interpreter(self)

    # --- the outside

    def register(self, name: str, df: DataFrame):
        """A DataFrame as a table that can be read, without memory."""
        view = f"_engram_ext_{abs(hash((id(self), name.lower())))}"
        df.createOrReplaceTempView(view)
        self.external[name.lower()] = (view, [(f.name, spark_kind(f.dataType)) for f in df.schema])

    def register_parquet(self, directory: str, *names: str):
        for n in names:
            self.register(n, self.spark.read.parquet(f"{directory}/{n}.parquet"))

    def sql(self, text: str) -> DataFrame:
        """Runs all statements; the rows of the last one that has any, else its message as a row."""
        results = self.run(text)
        for r in reversed(results):
            if r.df is not None:
                return r.df
        message = results[-1].message if results else ""
        return self.spark.createDataFrame([(message,)], "message string")

    def run(self, text: str) -> list[Result]:
        """Statement by statement, each as soon as it is read. A failing one is undone; with on_error 'continue' the next ones still run."""
        out: list[Result] = []
        parser = Parser(text)
        while True:
            try:
                s = parser.next_statement()
                if s is None:
                    return out
                out.extend(self.top(s))
            except (EngineError, PySparkException) as error:
                if self.storage.stack:
                    self.storage.catalog = self.storage.stack[0]
                    self.storage.stack.clear()
                if self.on_error == "stop":
                    raise error if isinstance(error, EngineError) else EngineError(self.error_text(error)) from error
                out.append(Result(message=f"error: {self.error_text(error)}"))
                if isinstance(error, SyntaxProblem):
                    parser.skip_statement()

    run_script = run

    def top(self, s: A.Statement) -> list[Result]:
        frame = Frame()
        out: list[Result] = []
        self.interpreter.run(s, frame, out)
        return out

    def show(self, result: Result | DataFrame, width: int = 48) -> str:
        """Aligned text grid with a row count."""
        df = result.df if isinstance(result, Result) else result
        if df is None:
            return result.message or ""
        rows = [[self.display(v)[:width] for v in r] for r in df.collect()]
        widths = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(df.columns)]
        lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in [df.columns, ["-" * w for w in widths], *rows]]
        return "\n".join([*lines, f"({len(rows)} row{'s' * (len(rows) != 1)})"])

    @staticmethod
    def display(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(int(v))
        return repr(v) if isinstance(v, float) else str(v)

    @staticmethod
    def error_text(error: Exception) -> str:
        text = str(error)
        if isinstance(error, PySparkException):
            if "DIVIDE_BY_ZERO" in text or "REMAINDER_BY_ZERO" in text:
                return "division by zero"
            if "USER_RAISED_EXCEPTION" in text:
                return text.split("USER_RAISED_EXCEPTION]")[1].split("SQLSTATE")[0].strip()
            if "CAST_INVALID_INPUT" in text:
                return "text compared or computed with a number is not a number"
            return text.split("SQLSTATE")[0].strip()
        return text

    # --- time

    def now(self) -> float:
        return float(self.clock())

    def clock_sql(self) -> str:
        return S.quote(time.strftime("%Y-%m-%d %H:%M:%S", time.localtime(self.now())))

    # --- what the compiler asks

    def view_text(self, name: str) -> str | None:
        v = self.storage.catalog["views"].get(name.lower())
        return v["body"] if v else None

    def relation(self, name: str, stateful: bool):
        """(view, columns, managed) of a table."""
        t = self.storage.catalog["tables"].get(name.lower())
        if t is None:
            if name.lower() in self.external:
                view, columns = self.external[name.lower()]
                return view, columns, False
            raise EngineError(f"unknown table '{name}'")
        return self.view_of(t, stateful), self.storage.kinds(t), True

    def view_of(self, t: dict, stateful: bool) -> str:
        """Temporary view over the segments of a table (or of a copy of its entry with some of them)."""
        view = f"_engram_{abs(hash((id(self), t['name'].lower(), tuple(t['segments']))))}_{t['version']}_{int(stateful)}"
        (self.with_state(t) if stateful else self.storage.rows(t)).createOrReplaceTempView(view)
        return view

    def with_state(self, t: dict) -> DataFrame:
        """Rows with _strength (now), _access and _last."""
        rows = self.storage.rows(t)
        base = rows.select("_rid", F.col("_s0").alias("strength0"), F.col("_a0").alias("access0"), F.col("_l0").alias("last0"))
        state = OM.fold(base, self.storage.log())
        now = F.lit(self.now())
        state = state.select("_rid", M.decayed(F.col("strength"), F.col("last"), now).alias("_strength"), F.col("access_count").alias("_access"), F.col("last").cast("long").alias("_last"))
        return rows.join(state, "_rid")

    def postings(self, table: str, column: str) -> str | None:
        """View of the inverted index of a column, brought up to date."""
        t = self.storage.table(table)
        for name, x in t["indexes"].items():
            if x["column"].lower() == column.lower():
                self.refresh_index(t, name)
                view = f"_engram_idx_{abs(hash((id(self), table.lower(), name)))}"
                parts = list(x["parts"].values())
                found = self.spark.read.schema(POSTINGS).parquet(*parts) if parts else self.spark.createDataFrame([], POSTINGS)
                found.createOrReplaceTempView(view)
                return view
        return None

    def refresh_index(self, t: dict, name: str):
        """Postings are kept by segment, and segments never change: only new segments are read, gone ones are let go."""
        x = t["indexes"][name]
        new = [s for s in t["segments"] if s not in x["parts"]]
        parts = {s: d for s, d in x["parts"].items() if s in t["segments"]}
        for s in new:
            rows = self.storage.rows(t | {"segments": [s]})
            words = F.expr(f"array_distinct({FT.lexeme_array(ident(self.storage.column(t, x['column'])['name']))})")
            postings = rows.select(F.explode(words).alias("lexeme"), F.col("_rid").alias("rid"))
            d = self.storage.new_dir("index")
            postings.repartition("lexeme").sortWithinPartitions("lexeme").write.parquet(d)  # row groups by lexeme, so a look-up skips most
            parts[s] = d
        x["parts"] = parts

    def refresh_indexes(self):
        for t in self.storage.catalog["tables"].values():
            for name in t["indexes"]:
                self.refresh_index(t, name)

    # --- expressions over one table

    def _table_scope(self, t: dict, alias: str) -> Scope:
        return Scope([Source("", alias, (t["name"].lower(), alias.lower()), self.storage.kinds(t), t["name"])])

    def condition(self, e, t: dict, alias: str, variables: dict | None = None) -> str:
        return Compiler(self, variables if variables is not None else self.current).bool_sql(e, self._table_scope(t, alias))

    def value(self, e, t: dict, alias: str):
        return Compiler(self, self.current).expr(e, self._table_scope(t, alias))

    current: dict = {}

    def update_relation(self, t: dict, exprs: list) -> str:
        return self.view_of(t, bool({n.lower() for e in exprs for n in names_in(e)} & set(STATEFUL)))

    def matching(self, t: dict, where) -> DataFrame:
        """Rows (with _rid) that a condition holds for."""
        relation = self.update_relation(t, [where] if where is not None else [])
        cond = f" WHERE {self.condition(where, t, '__m')}" if where is not None else ""
        return self.spark.sql(f"SELECT __m.* FROM {relation} AS __m{cond}")

    def evaluate(self, e, variables: dict):
        sql, _ = Compiler(self, variables).expr(e, Scope())
        return self.spark.sql(f"SELECT {sql}").first()[0]

    def materialise(self, df: DataFrame) -> DataFrame:
        """The rows of a query, computed now and kept in their order."""
        names = df.columns
        fixed = self.storage.stage(df.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("__o", F.monotonically_increasing_id()))
        return fixed.orderBy("__o").drop("__o").toDF(*names)

    # --- statements

    def execute(self, s: A.Statement, frame: Frame) -> list[Result]:
        method = getattr(self, "do_" + s.kind, None)
        if method is None:
            raise EngineError(f"'{s.kind}' can't be used here")
        before = self.current
        self.current = frame.variables()
        try:
            r = method(s, frame)
        finally:
            self.current = before
        if s.kind not in READS:
            self.refresh_indexes()
            self.storage.save()
        return r if isinstance(r, list) else [r]

    # queries

    def captured(self, q: A.Select, variables: dict) -> DataFrame:
        """A query's rows for a cursor: touched, not associated."""
        if self._plain(q) and self._remembered(q) is not None:
            self.touch(self._read_rows(q, variables), M.BOOST)
            self.storage.save()
        return self.spark.sql(Compiler(self, variables).select(q, Scope()).sql)

    @staticmethod
    def _plain(q: A.Select) -> bool:
        """Whether each row of the result is a row of the first table."""
        return isinstance(q.first, A.Core) and not (q.first.group or q.first.distinct or any(has_aggregate(i.expr) for i in q.first.items))

    def _read_rows(self, q: A.Select, variables: dict) -> DataFrame:
        """_rid of the first table's rows in the order of the result; other columns are not computed."""
        alias = q.first.source.alias or q.first.source.table
        df = self.spark.sql(Compiler(self, variables).select(q, Scope(), [f"{ident(alias)}._rid AS __rid"]).sql)
        return df.select(F.col("__rid").alias("_rid")).where("_rid IS NOT NULL")

    def do_select(self, s: A.Statement, frame: Frame) -> Result:
        q = s.query
        table = self._remembered(q)
        comp = Compiler(self, self.current)
        if table is None:
            return Result(self.spark.sql(comp.select(q, Scope()).sql))
        core = q.first
        df = self.spark.sql(comp.select(q, Scope()).sql)
        if not self._plain(q):
            if core.group and not core.distinct:
                self._reinforce_groups(q, core.source.alias or core.source.table)
            return Result(df)
        read = self._read_rows(q, self.current)
        self.touch(read, M.BOOST)
        if not core.joins:
            self.associate([r[0] for r in read.limit(M.CO_ACCESS).collect()])
        self.storage.save()
        return Result(df)

    def _remembered(self, q: A.Select) -> dict | None:
        """The managed table whose rows a query reads first, if reads are remembered."""
        if self.observer or q.rest or not isinstance(q.first, A.Core) or q.first.source is None or q.first.source.table is None:
            return None
        if self.view_text(q.first.source.table) is not None:
            return None
        return self.storage.catalog["tables"].get(q.first.source.table.lower())

    def _reinforce_groups(self, q: A.Select, alias: str):
        """The first rows of every displayed group are touched and linked."""
        core = q.first
        keys = [A.Item(g, f"k{i}") for i, g in enumerate(core.group)]
        shown = A.Select(A.Core(tuple([*core.items, *keys]), core.source, core.joins, core.where, core.group, core.having, False, core.top), (), q.order, q.limit, q.offset)
        groups = self.spark.sql(Compiler(self, self.current).select(shown, Scope()).sql)
        groups = groups.toDF(*[f"c{i}" for i in range(len(groups.columns) - len(keys))], *[f"k{i}" for i in range(len(keys))]).select(*[f"k{i}" for i in range(len(keys))])
        rows = A.Select(A.Core(tuple(keys), core.source, core.joins, core.where, (), None, False, None), (), (), None, None)
        members = self.spark.sql(Compiler(self, self.current).select(rows, Scope(), [f"{ident(alias)}._rid AS _rid"]).sql)
        cond = None
        for i in range(len(keys)):
            one = members[f"k{i}"].eqNullSafe(groups[f"k{i}"])
            cond = one if cond is None else cond & one
        members = members.join(groups, cond, "left_semi").where("_rid IS NOT NULL")
        by = [f"k{i}" for i in range(len(keys))]
        w = OM.Window.partitionBy(*by).orderBy("_rid")
        first = self.storage.stage(members.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= M.CO_ACCESS))
        self.touch(first.select("_rid"), M.BOOST)
        pairs = OM.co_access(first, by, "_rid", ["_n"])
        if pairs.limit(1).count():
            self.storage.append("links", pairs, self._merged_links)
        self.storage.save()

    def do_explain(self, s: A.Statement, frame: Frame) -> Result:
        inner = s.inner
        lines = [f"statement: {inner.kind}"]
        if inner.kind == "select":
            sql = Compiler(self, self.current).select(inner.query, Scope()).sql
            lines += [f"spark sql: {sql}", self.spark.sql(f"EXPLAIN FORMATTED {sql}").first()[0]]
        else:
            lines += [f"{k}: {v}" for k, v in inner.f.items() if isinstance(v, str | int | list) and k not in ("body", "rows")]
        return Result(self.spark.createDataFrame([("\n".join(lines),)], "plan string"))

    def do_print(self, s: A.Statement, frame: Frame) -> Result:
        return Result(message=self.display(self.interpreter.value(s.expr, frame)))

    # data

    def do_insert_values(self, s: A.Statement, frame: Frame) -> Result:
        t = self.storage.table(s.table)
        columns = s.columns or [c["name"] for c in t["columns"]]
        comp = Compiler(self, self.current)
        for n in columns:
            self.storage.column(t, n)
        rows = []
        for row in s.rows:
            if len(row) != len(columns):
                raise EngineError(f"{len(columns)} columns but {len(row)} values")
            cells = []
            for n, e in zip(columns, row, strict=True):
                c = self.storage.column(t, n)
                cells.append(S.store(comp.expr(e, Scope()), c["name"], c["type"], c["length"]))
            rows.append("(" + ", ".join(cells) + ")")
        names = ", ".join(f"c{i}" for i in range(len(columns)))
        parts = [f"SELECT {r[1:-1]}" for r in rows] if "uuid()" in "".join(rows) or "raise_error" in "".join(rows) or "SELECT" in "".join(rows) else None
        sql = f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS v({names})" if parts else f"SELECT * FROM VALUES {', '.join(rows)} AS v({names})"
        n = self.dml.insert(t, s.columns, self.spark.sql(sql).coalesce(1))
        return Result(message=rows_text(n, "inserted"))

    def do_insert_select(self, s: A.Statement, frame: Frame) -> Result:
        t = self.storage.table(s.table)
        source = self.spark.sql(Compiler(self, self.current).select(s.query, Scope()).sql)
        read = self._read_rows(s.query, self.current) if self._plain(s.query) and self._remembered(s.query) is not None else None
        n = self.dml.insert(t, s.columns, source)
        if read is not None:
            self.touch(read, M.BOOST)
        return Result(message=rows_text(n, "inserted"))

    def do_insert_exec(self, s: A.Statement, frame: Frame) -> Result:
        inner = self.interpreter.call(s.call, frame) if s.call.kind == "call" else self.interpreter.dynamic(s.call, frame)
        first = next((r.df for r in inner if r.df is not None), None)
        if first is None:
            raise EngineError("the procedure returned no rows to insert")
        n = self.dml.insert(self.storage.table(s.table), s.columns, first)
        return Result(message=rows_text(n, "inserted"))

    def do_update(self, s: A.Statement, frame: Frame) -> Result:
        return Result(message=rows_text(self.dml.update(self.storage.table(s.table), s.sets, s.where), "updated"))

    def do_delete(self, s: A.Statement, frame: Frame) -> Result:
        return Result(message=rows_text(self.dml.delete(self.storage.table(s.table), s.where), "deleted"))

    def do_truncate(self, s: A.Statement, frame: Frame) -> Result:
        return Result(message=rows_text(self.dml.truncate(self.storage.table(s.table)), "removed"))

    # definitions

    def _free(self, name: str):
        c = self.storage.catalog
        if name.startswith("_"):
            raise EngineError(f"'{name}': names starting with _ are reserved")
        if name.lower() in c["tables"] or name.lower() in c["views"]:
            raise EngineError(f"'{name}' already exists")

    @staticmethod
    def _default(e) -> dict | None:
        if e is None:
            return None
        if isinstance(e, A.Lit):
            return {"value": e.value}
        name = e.name if isinstance(e, A.Func) else e.column.upper() if isinstance(e, A.Name) else ""
        if name in (*S.CLOCK, "NEWID"):
            return {"func": name}
        raise EngineError("a DEFAULT is a literal, a clock function or NEWID()")

    def _column(self, c: A.ColumnDef, phys: str) -> dict:
        return {
            "name": c.name, "phys": phys, "type": c.type.name, "length": c.type.length, "not_null": c.not_null, "primary": c.primary, "unique": c.unique,
            "default": self._default(c.default), "identity": list(c.identity) if c.identity else None, "next": c.identity[0] if c.identity else None,
        }

    def _reference(self, t: dict, columns: list[str], table: str, targets: list[str] | None, on_delete: str, on_update: str) -> dict:
        p = t if table.lower() == t["name"].lower() else self.storage.table(table)
        if targets is None:
            targets = [c["name"] for c in p["columns"] if c["primary"]]
            if len(targets) != len(columns):
                raise EngineError(f"'{p['name']}' has no primary key to refer to")
        if len(targets) != len(columns):
            raise EngineError("a foreign key needs as many columns on both sides")
        for c in columns:
            self.storage.column(t, c)
        for x in targets:
            found = next((c for c in p["columns"] if c["name"].lower() == x.lower()), None)
            if found is None:
                raise EngineError(f"unknown column '{x}' in '{p['name']}'")
            if not (found["primary"] or found["unique"]):
                raise EngineError(f"column '{x}' of '{p['name']}' is not UNIQUE")
        return {"columns": columns, "table": p["name"], "targets": targets, "on_delete": on_delete, "on_update": on_update}

    def do_create_table(self, s: A.Statement, frame: Frame) -> Result:
        self._free(s.name)
        names = [c.name.lower() for c in s.columns]
        if twice := next((n for n in names if names.count(n) > 1), None):
            raise EngineError(f"column '{twice}' is declared twice")
        if sum(c.primary for c in s.columns) > 1:
            raise EngineError("only one column can be the primary key")
        t = {
            "name": s.name, "columns": [self._column(c, f"c{i}") for i, c in enumerate(s.columns)], "next_phys": len(s.columns),
            "checks": [c.check for c in s.columns if c.check] + s.checks, "refs": [], "segments": [], "version": 0, "rows": 0, "indexes": {},
        }
        t["refs"] = [self._reference(t, [c.name], *c.ref) for c in s.columns if c.ref] + [self._reference(t, *r) for r in s.refs]
        for text in t["checks"]:
            self.condition(Parser(text).expr(), t, "__check", {})
        self.storage.catalog["tables"][s.name.lower()] = t
        return Result(message=f"table '{s.name}' created")

    def do_drop_table(self, s: A.Statement, frame: Frame) -> Result:
        if s.name.lower() not in self.storage.catalog["tables"]:
            if s.if_exists:
                return Result(message=f"no table '{s.name}'")
            raise EngineError(f"unknown table '{s.name}'")
        t = self.storage.table(s.name)
        for child, _ in self.dml.referencing(s.name):
            if child is not t:
                raise EngineError(f"cannot drop '{t['name']}': '{child['name']}' references it")
        if t["rows"]:
            self.forget_links(self.storage.physical(t).select("_rid"))
        del self.storage.catalog["tables"][s.name.lower()]
        return Result(message=f"table '{t['name']}' dropped")

    def do_alter_add(self, s: A.Statement, frame: Frame) -> Result:
        t = self.storage.table(s.table)
        c = s.column
        if any(x["name"].lower() == c.name.lower() for x in t["columns"]):
            raise EngineError(f"column '{c.name}' already exists")
        if c.not_null and c.default is None and t["rows"]:
            raise EngineError(f"cannot add NOT NULL column '{c.name}' without a DEFAULT")
        new = self._column(c, f"c{t['next_phys']}")
        nt = t | {"columns": [*t["columns"], new], "next_phys": t["next_phys"] + 1, "checks": t["checks"] + ([c.check] if c.check else [])}
        if c.ref:
            nt["refs"] = [*t["refs"], self._reference(nt, [c.name], *c.ref)]
        if c.default is not None and t["rows"]:
            filled = self.storage.physical(nt).withColumn(new["phys"], F.expr(self.dml.default_sql(new)))
            nt["segments"] = [self.storage.write(filled)]
            nt["version"] += 1
        self.dml.check_rows(nt, self.storage.rows(nt), None, {c.name.lower()})
        t.clear()
        t.update(nt)
        return Result(message=f"column '{c.name}' added")

    def _used(self, t: dict, name: str) -> str | None:
        for text in t["checks"]:
            if name.lower() in {n.lower() for n in names_in(Parser(text).expr())}:
                return f"CHECK ({text})"
        if any(name.lower() in [c.lower() for c in r["columns"]] for r in t["refs"]):
            return "a foreign key"
        for child, r in self.dml.referencing(t["name"]):
            if name.lower() in [c.lower() for c in r["targets"]]:
                return f"a foreign key of '{child['name']}'"
        return None

    def do_alter_drop(self, s: A.Statement, frame: Frame) -> Result:
        t = self.storage.table(s.table)
        c = self.storage.column(t, s.name)
        if why := self._used(t, s.name):
            raise EngineError(f"column '{c['name']}' is used by {why}")
        if len(t["columns"]) == 1:
            raise EngineError("a table needs a column")
        t["columns"].remove(c)
        t["indexes"] = {n: x for n, x in t["indexes"].items() if x["column"].lower() != s.name.lower()}
        t["version"] += 1
        return Result(message=f"column '{c['name']}' dropped")

    def do_alter_rename(self, s: A.Statement, frame: Frame) -> Result:
        t = self.storage.table(s.table)
        c = self.storage.column(t, s.name)
        if any(x["name"].lower() == s.to.lower() for x in t["columns"] if x is not c):
            raise EngineError(f"column '{s.to}' already exists")
        if any(s.name.lower() in {n.lower() for n in names_in(Parser(x).expr())} for x in t["checks"]):
            raise EngineError(f"column '{c['name']}' is used by a CHECK")
        for r in t["refs"]:
            r["columns"] = [s.to if x.lower() == s.name.lower() else x for x in r["columns"]]
        for _, r in self.dml.referencing(t["name"]):
            r["targets"] = [s.to if x.lower() == s.name.lower() else x for x in r["targets"]]
        for x in t["indexes"].values():
            x["column"] = s.to if x["column"].lower() == s.name.lower() else x["column"]
        c["name"] = s.to
        t["version"] += 1
        return Result(message=f"column '{s.name}' renamed to '{s.to}'")

    def do_alter_alter(self, s: A.Statement, frame: Frame) -> Result:
        t = self.storage.table(s.table)
        c = self.storage.column(t, s.name)
        new = c | {"type": s.type.name, "length": s.type.length, "phys": f"c{t['next_phys']}"}
        rows = self.storage.physical(t)
        value = S.store((ident(c["phys"]), S.kind_of(c["type"])), c["name"], s.type.name, s.type.length)
        segments = t["segments"]
        if t["rows"]:
            low_high = S.INT_RANGES.get(s.type.name)
            if low_high and S.kind_of(c["type"]) == "int":
                bad = rows.where(~F.col(c["phys"]).between(*low_high)).select(c["phys"]).limit(1).collect()
                if bad:
                    raise EngineError(f"column '{c['name']}' has value {bad[0][0]}, out of range for {s.type.name}")
            segments = [self.storage.write(rows.withColumn(new["phys"], F.expr(value)).drop(c["phys"]))]
        t["columns"] = [new if x is c else x for x in t["columns"]]
        t["next_phys"] += 1
        self.storage.replace(t, segments)
        return Result(message=f"column '{c['name']}' type changed")

    def do_create_view(self, s: A.Statement, frame: Frame) -> Result:
        self._free(s.name)
        self.storage.catalog["views"][s.name.lower()] = {"name": s.name, "body": s.body}
        return Result(message=f"view '{s.name}' created")

    def _drop(self, kind: str, what: str, s: A.Statement) -> Result:
        if self.storage.catalog[kind].pop(s.name.lower(), None) is None:
            if s.if_exists:
                return Result(message=f"no {what} '{s.name}'")
            raise EngineError(f"unknown {what} '{s.name}'")
        return Result(message=f"{what} '{s.name}' dropped")

    def do_drop_view(self, s: A.Statement, frame: Frame) -> Result:
        return self._drop("views", "view", s)

    def do_create_procedure(self, s: A.Statement, frame: Frame) -> Result:
        if s.name.lower() in self.storage.catalog["procs"]:
            raise EngineError(f"procedure '{s.name}' already exists")
        self.storage.catalog["procs"][s.name.lower()] = {"name": s.name, "head": s.head, "body": s.body}
        return Result(message=f"procedure '{s.name}' created")

    def do_drop_procedure(self, s: A.Statement, frame: Frame) -> Result:
        return self._drop("procs", "procedure", s)

    def do_create_index(self, s: A.Statement, frame: Frame) -> Result:
        if not s.gin:
            raise EngineError("only USING GIN indexes can be created")
        t = self.storage.table(s.table)
        c = self.storage.column(t, s.column)
        if S.kind_of(c["type"]) != "text":
            raise EngineError("a GIN index needs a text column")
        if any(s.name.lower() in x["indexes"] for x in self.storage.catalog["tables"].values()):
            raise EngineError(f"index '{s.name}' already exists")
        t["indexes"][s.name.lower()] = {"column": c["name"], "parts": {}}
        return Result(message=f"index '{s.name}' created")

    def do_drop_index(self, s: A.Statement, frame: Frame) -> Result:
        for t in self.storage.catalog["tables"].values():
            if (s.table is None or t["name"].lower() == s.table.lower()) and t["indexes"].pop(s.name.lower(), None) is not None:
                return Result(message=f"index '{s.name}' dropped")
        if s.if_exists:
            return Result(message=f"no index '{s.name}'")
        raise EngineError(f"unknown index '{s.name}'")

    # transactions and upkeep

    def do_begin(self, s: A.Statement, frame: Frame) -> Result:
        self.storage.begin()
        return Result(message="transaction started")

    def do_commit(self, s: A.Statement, frame: Frame) -> Result:
        self.storage.commit()
        return Result(message="committed")

    def do_rollback(self, s: A.Statement, frame: Frame) -> Result:
        self.storage.rollback()
        return Result(message="rolled back")

    def do_checkpoint(self, s: A.Statement, frame: Frame) -> Result:
        return Result(message="checkpoint complete")

    def do_vacuum(self, s: A.Statement, frame: Frame) -> Result:
        """Folds the access log into the rows, merges segments and link changes, deletes what nothing refers to."""
        if self.storage.stack:
            raise EngineError("VACUUM can't run in a transaction")
        st = self.storage
        log = st.log()
        for t in st.catalog["tables"].values():
            rows = st.physical(t)
            if not t["rows"]:
                st.replace(t, [])
                continue
            state = OM.fold(rows.select("_rid", F.col("_s0").alias("strength0"), F.col("_a0").alias("access0"), F.col("_l0").alias("last0")), log)
            folded = rows.drop("_s0", "_a0", "_l0").join(state, "_rid")
            folded = folded.withColumnsRenamed({"strength": "_s0", "access_count": "_a0", "last": "_l0"}).select(*st.schema(t).names)
            st.replace(t, [st.write(folded)])
        kept = st.new_dir("links")
        self._merged_links(st.links_raw()).write.parquet(kept)
        st.catalog["links"], st.catalog["log"] = [kept], []
        self.refresh_indexes()
        st.save()
        st.sweep()
        return Result(message="vacuum complete")

    # memory

    def touch(self, rids: DataFrame, boost: float, kind: str = "touch"):
        """Log records for rows (column _rid, once for each use)."""
        seq = self.storage.next_seq()
        self.storage.append("log", rids.select("_rid", F.lit(self.now()).alias("ts"), F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.lit(float(boost)).alias("boost")))

    def associate(self, rids: list[int]):
        """Links between the first CO_ACCESS rows of a statement."""
        rids = list(dict.fromkeys(r for r in rids if r))[: M.CO_ACCESS]
        pairs = [(min(a, b), max(a, b), M.LINK_BOOST) for i, a in enumerate(rids) for b in rids[:i]]
        if pairs:
            self.storage.append("links", self.spark.createDataFrame(pairs, "a bigint, b bigint, w double").coalesce(1), self._merged_links)

    @staticmethod
    def _summed(raw: DataFrame) -> DataFrame:
        return raw.groupBy("a", "b").agg(F.least(F.lit(M.LINK_MAX), F.sum("w")).alias("w"))

    def links(self) -> DataFrame:
        """a, b, w of all associations."""
        return self._summed(self.storage.links_raw())

    def _merged_links(self, raw: DataFrame) -> DataFrame:
        """Changes of links as one table of links, weakened and thinned out when there are many."""
        links = self.storage.stage(self._summed(raw))
        return OM.prune(links) if links.count() > M.PRUNE_FROM * M.LINK_CAP else links

    def forget_links(self, rids: DataFrame):
        if not self.storage.catalog["links"]:
            return
        kept = OM.without(self.links(), rids)
        d = self.storage.new_dir("links")
        kept.write.parquet(d)
        self.storage.catalog["links"] = [d]

    def neighbours(self, rid: int) -> DataFrame:
        return OM.neighbours(self.links(), rid)

    def do_remember(self, s: A.Statement, frame: Frame) -> Result:
        t = self.storage.table(s.table)
        rows = self.storage.stage(self.matching(t, s.where).select("_rid"))
        n = rows.count()
        if n:
            self.touch(rows, M.REMEMBER_BOOST)
            self.associate([r[0] for r in rows.orderBy("_rid").limit(M.CO_ACCESS).collect()])
        return Result(message=rows_text(n, "reinforced"))

    def do_forget(self, s: A.Statement, frame: Frame) -> Result:
        t = self.storage.table(s.table)
        rows = self.storage.stage(self.matching(t, s.where).select("_rid"))
        n = rows.count()
        if n:
            self.touch(rows, 0.0, "reset")
        return Result(message=rows_text(n, "faded"))

    def _preview(self, t: dict):
        cells = [F.coalesce(F.col(ident(c["name"])).cast("string"), F.lit("NULL")) for c in t["columns"]]
        return F.concat_ws(" | ", *cells)

    def do_show_tables(self, s: A.Statement, frame: Frame) -> Result:
        out = None
        for t in self.storage.catalog["tables"].values():
            avg = self.with_state(t).agg(F.coalesce(F.avg("_strength"), F.lit(0.0)).alias("avg_strength"))
            one = avg.select(F.lit(t["name"]).alias("table"), F.lit(len(t["columns"])).alias("columns"), F.lit(t["rows"]).cast("long").alias("rows"), "avg_strength")
            out = one if out is None else out.union(one)
        return Result(out if out is not None else self.spark.createDataFrame([], "table string, columns int, rows bigint, avg_strength double"))

    def do_show_memory(self, s: A.Statement, frame: Frame) -> Result:
        t = self.storage.table(s.table)
        df = self.with_state(t).select("_rid", "_strength", F.col("_access").alias("_access_count"), "_last", self._preview(t).alias("row")).orderBy(F.desc("_strength"), "_rid")
        return Result(df.limit(s.top) if s.top is not None else df)

    def _previews(self) -> DataFrame:
        out = None
        for t in self.storage.catalog["tables"].values():
            one = self.storage.rows(t).select("_rid", F.lit(t["name"]).alias("table"), self._preview(t).alias("row"))
            out = one if out is None else out.union(one)
        return out if out is not None else self.spark.createDataFrame([], "_rid bigint, table string, row string")

    def do_show_links(self, s: A.Statement, frame: Frame) -> Result:
        rows = self._previews()
        if s.table is not None:
            self.storage.table(s.table)
        a = rows.select(F.col("_rid").alias("a"), F.col("table").alias("table_a"), F.col("row").alias("row_a"))
        b = rows.select(F.col("_rid").alias("b"), F.col("table").alias("table_b"), F.col("row").alias("row_b"))
        df = self.links().join(a, "a").join(b, "b")
        if s.table is not None:
            name = s.table.lower()
            df = df.where((F.lower("table_a") == name) | (F.lower("table_b") == name))
        df = df.select(F.col("w").alias("weight"), "table_a", "a", "row_a", "table_b", "b", "row_b")
        return Result(df.orderBy(F.desc("weight"), "a", "b").limit(s.top if s.top is not None else 20))

    def recall(self, phrase: str, table: str | None = None, top: int = 10) -> DataFrame:
        """score, table, _rid, _strength, row of the best hits, over one table or all; nothing is reinforced."""
        tables = [self.storage.table(table)] if table else list(self.storage.catalog["tables"].values())
        found = None
        for t in tables:
            rows = self.with_state(t)
            h = OM.hits(rows, phrase, [c["name"] for c in t["columns"]], "_rid", F.col("_strength"), F.col("_access"))
            h = h.select("_rid", F.lit(t["name"]).alias("table"), "_strength", self._preview(t).alias("row"), "_lex", "_base")
            found = h if found is None else found.union(h)
        if found is None:
            return self.spark.createDataFrame([], "score double, table string, _rid bigint, _strength double, row string")
        scored = OM.spread(found, self.links(), "_rid")
        return scored.select(F.col("_score").alias("score"), "table", "_rid", "_strength", "row").orderBy(F.desc("score"), "_rid").limit(top)

    def do_recall(self, s: A.Statement, frame: Frame) -> list[Result]:
        df = self.storage.stage(self.recall(s.phrase, s.table, s.top)).orderBy(F.desc("score"), "_rid")
        rids = [r[0] for r in df.select("_rid").limit(M.CO_ACCESS).collect()]
        if not rids:
            return [Result(message=f'nothing comes to mind for "{s.phrase}"')]
        if not self.observer:
            self.touch(df.select("_rid"), M.RECALL_BOOST)
            self.associate(rids)
        return [Result(df)]


__all__ = ["Engine", "Result"]
