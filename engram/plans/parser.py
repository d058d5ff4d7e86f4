"""Recursive-descent parser of the dialect, one statement at a time."""

from __future__ import annotations

from ..errors import SyntaxProblem
from . import ast as A
from .lexer import Token, tokens

#: Words that end an expression or a source and so can't be a bare alias.
RESERVED = frozenset(
    "SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT JOIN INNER LEFT RIGHT FULL CROSS OUTER ON AS AND OR NOT IN IS NULL LIKE "
    "BETWEEN EXISTS CASE WHEN THEN ELSE END CAST DISTINCT TOP BY ASC DESC SET VALUES INSERT UPDATE DELETE CREATE DROP ALTER TRUNCATE BEGIN COMMIT ROLLBACK "
    "GO IF WHILE BREAK CONTINUE RETURN DECLARE PRINT EXEC EXECUTE CALL OPEN FETCH CLOSE DEALLOCATE RECALL REMEMBER FORGET SHOW EXPLAIN VACUUM CHECKPOINT "
    "ESCAPE ANY ALL INTO".split()
)
STARTS = frozenset(
    "SELECT INSERT UPDATE DELETE CREATE DROP ALTER TRUNCATE BEGIN COMMIT ROLLBACK IF WHILE BREAK CONTINUE RETURN DECLARE SET PRINT EXEC EXECUTE CALL OPEN FETCH "
    "CLOSE DEALLOCATE RECALL REMEMBER FORGET SHOW EXPLAIN VACUUM CHECKPOINT".split()
)
COMPARE = {"=", "<>", "!=", "<", "<=", ">", ">="}
INT_TYPES = ("TINYINT", "SMALLINT", "INT", "INTEGER", "BIGINT")
FLOAT_TYPES = ("FLOAT", "REAL", "DECIMAL", "NUMERIC", "MONEY")
TEXT_TYPES = ("NVARCHAR", "VARCHAR", "CHAR", "NCHAR", "TEXT", "NTEXT")
DATE_TYPES = ("DATETIME", "DATE", "DATETIME2", "SMALLDATETIME")
MAX_NAME = 127


class Parser:
    def __init__(self, text: str):
        self.text, self.toks, self.at = text, tokens(text), 0

    # --- helpers

    @property
    def cur(self) -> Token:
        return self.toks[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.toks[min(self.at + n, len(self.toks) - 1)]

    def fail(self, what: str):
        near = self.cur.text or "the end"
        raise SyntaxProblem(f"{what} near '{near}'")

    def is_word(self, *words: str) -> bool:
        return self.cur.word() in words and bool(self.cur.word())

    def is_op(self, *ops: str) -> bool:
        return self.cur.kind == "op" and self.cur.text in ops

    def take_word(self, *words: str) -> str | None:
        if self.is_word(*words):
            w = self.cur.word()
            self.at += 1
            return w
        return None

    def take_op(self, *ops: str) -> str | None:
        if self.is_op(*ops):
            self.at += 1
            return self.toks[self.at - 1].text
        return None

    def need_word(self, *words: str) -> str:
        return self.take_word(*words) or self.fail(f"expected {' or '.join(words)}")

    def need_op(self, *ops: str) -> str:
        return self.take_op(*ops) or self.fail(f"expected '{ops[0]}'")

    def ident(self, what: str = "a name") -> str:
        t = self.cur
        if t.kind == "quoted" or (t.kind == "id" and t.word() not in RESERVED):
            self.at += 1
            if len(t.value) > MAX_NAME:
                raise SyntaxProblem(f"the name is {len(t.value)} characters; the limit is {MAX_NAME}")
            return t.value
        self.fail(f"expected {what}")

    def integer(self) -> int:
        t = self.cur
        if t.kind == "num" and isinstance(t.value, int):
            self.at += 1
            return t.value
        self.fail("expected a whole number")

    def number(self):
        sign = -1 if self.take_op("-") else 1
        t = self.cur
        if t.kind != "num":
            self.fail("expected a number")
        self.at += 1
        return sign * t.value

    def comma_list(self, one) -> list:
        out = [one()]
        while self.take_op(","):
            out.append(one())
        return out

    def name_list(self) -> list[str]:
        self.need_op("(")
        names = self.comma_list(self.ident)
        self.need_op(")")
        return names

    # --- scripts

    def next_statement(self) -> A.Statement | None:
        """The next statement of a script; None at the end. It must end at a boundary."""
        while self.is_op(";") or self.is_word("GO"):
            self.at += 1
        if self.cur.kind == "end":
            return None
        s = self.statement(False)
        if not (self.cur.kind == "end" or self.is_op(";") or self.is_word("GO")):
            self.fail("unexpected text after the statement. Nothing was run")
        return s

    def skip_statement(self):
        """To the next boundary, after a syntax error."""
        self.at += self.cur.kind != "end"
        while self.cur.kind != "end" and not self.is_op(";") and not self.is_word("GO"):
            self.at += 1

    def statement(self, inside: bool) -> A.Statement:
        start = self.cur.start
        s = self._statement(inside)
        s.text = self.text[start : self.toks[self.at - 1].stop]
        return s

    def _statement(self, inside: bool) -> A.Statement:
        w = self.cur.word()
        if w == "SELECT" or self.is_op("("):
            return A.Statement("select", {"query": self.query()})
        simple = {
            "INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete, "TRUNCATE": self.truncate, "CREATE": self.create, "DROP": self.drop,
            "ALTER": self.alter, "SHOW": self.show, "RECALL": self.recall, "REMEMBER": self.remember, "FORGET": self.remember, "EXEC": self.call,
            "EXECUTE": self.call, "CALL": self.call,
        }
        if w in simple:
            return simple[w]()
        if w in ("VACUUM", "CHECKPOINT"):
            self.at += 1
            return A.Statement(w.lower())
        if w in ("COMMIT", "ROLLBACK"):
            self.at += 1
            self.take_word("TRANSACTION")
            return A.Statement(w.lower())
        if w == "EXPLAIN":
            self.at += 1
            return A.Statement("explain", {"inner": self.statement(inside)})
        if w == "PRINT":
            self.at += 1
            return A.Statement("print", {"expr": self.expr()})
        if w == "BEGIN":
            if self.peek().word() == "TRY":
                return self.try_catch()
            if not inside or self.peek().word() == "TRANSACTION":
                self.at += 1
                self.take_word("TRANSACTION")
                return A.Statement("begin")
            return self.block()
        if inside and w in ("IF", "WHILE", "BREAK", "CONTINUE", "RETURN", "DECLARE", "SET", "OPEN", "FETCH", "CLOSE", "DEALLOCATE"):
            return self.control(w)
        self.fail("unrecognised statement")

    # --- queries

    def query(self) -> A.Select:
        first, rest = self.operand(), []
        while op := self.take_word("UNION", "INTERSECT", "EXCEPT"):
            if op == "UNION" and self.take_word("ALL"):
                op = "UNION ALL"
            rest.append((op, self.operand()))
        order, limit, offset = [], None, None
        if self.take_word("ORDER"):
            self.need_word("BY")
            order = self.comma_list(self.order_key)
        if self.take_word("LIMIT"):
            limit = self.integer()
        if self.take_word("OFFSET"):
            offset = self.integer()
        return A.Select(first, tuple(rest), tuple(order), limit, offset)

    def operand(self):
        if self.take_op("("):
            q = self.query()
            self.need_op(")")
            return q
        return self.core()

    def order_key(self):
        e = self.expr()
        return e, self.take_word("ASC", "DESC") == "DESC"

    def core(self) -> A.Core:
        self.need_word("SELECT")
        distinct = self.take_word("DISTINCT", "ALL") == "DISTINCT"
        top = None
        if self.is_word("TOP"):
            self.at += 1
            paren = self.take_op("(")
            top = self.integer()
            if paren:
                self.need_op(")")
        items = self.comma_list(self.item)
        source, joins, where, group, having = None, [], None, [], None
        if self.take_word("FROM"):
            source = self.source()
            while j := self.join():
                joins.append(j)
            if self.is_op(","):
                self.fail("comma joins are not supported, use JOIN")
        if self.take_word("WHERE"):
            where = self.expr()
        if self.take_word("GROUP"):
            self.need_word("BY")
            group = self.comma_list(self.expr)
        if self.take_word("HAVING"):
            having = self.expr()
        return A.Core(tuple(items), source, tuple(joins), where, tuple(group), having, distinct, top)

    def item(self) -> A.Item:
        if self.take_op("*"):
            return A.Item(A.Star(), None)
        if self.cur.kind in ("id", "quoted") and self.peek().text == "." and self.peek(2).text == "*":
            t = self.ident()
            self.at += 2
            return A.Item(A.Star(t), None)
        e = self.expr()
        return A.Item(e, self.alias())

    def alias(self) -> str | None:
        if self.take_word("AS"):
            if self.cur.kind == "str":
                self.at += 1
                return self.toks[self.at - 1].value
            return self.ident("an alias")
        if self.cur.kind == "quoted" or (self.cur.kind == "id" and self.cur.word() not in RESERVED):
            return self.ident()
        return None

    def source(self) -> A.Source:
        if self.take_op("("):
            q = self.query()
            self.need_op(")")
            alias = self.alias()
            if alias is None:
                self.fail("a derived table needs an alias")
            return A.Source(None, q, alias)
        return A.Source(self.ident("a table"), None, self.alias())

    def join(self) -> A.Join | None:
        kind = None
        if self.take_word("JOIN"):
            kind = "INNER"
        elif self.is_word("INNER", "LEFT", "RIGHT", "FULL", "CROSS"):
            kind = self.take_word("INNER", "LEFT", "RIGHT", "FULL", "CROSS")
            self.take_word("OUTER")
            self.need_word("JOIN")
        if kind is None:
            return None
        s = self.source()
        if kind == "CROSS":
            return A.Join(kind, s, None)
        self.need_word("ON")
        return A.Join(kind, s, self.expr())

    # --- expressions, from the weakest operator to the strongest

    def expr(self):
        e = self.and_expr()
        while self.take_word("OR"):
            e = A.Bin("OR", e, self.and_expr())
        return e

    def and_expr(self):
        e = self.not_expr()
        while self.take_word("AND"):
            e = A.Bin("AND", e, self.not_expr())
        return e

    def not_expr(self):
        if self.take_word("NOT"):
            return A.Not(self.not_expr())
        return self.predicate()

    def predicate(self):
        if self.take_word("EXISTS"):
            return A.Exists(self.paren_query())
        e = self.sum()
        while True:
            if self.take_word("IS"):
                neg = bool(self.take_word("NOT"))
                self.need_word("NULL")
                e = A.IsNull(e, neg)
                continue
            neg = self.is_word("NOT") and self.peek().word() in ("LIKE", "IN", "BETWEEN")
            self.at += neg
            if self.take_word("BETWEEN"):
                low = self.sum()
                self.need_word("AND")
                e = A.Between(e, low, self.sum(), neg)
            elif self.take_word("LIKE"):
                pattern, escape = self.sum(), None
                if self.take_word("ESCAPE"):
                    t = self.cur
                    if t.kind != "str" or len(t.value) != 1:
                        self.fail("ESCAPE needs a single-character string")
                    self.at += 1
                    escape = t.value
                e = A.Like(e, pattern, escape, neg)
            elif self.take_word("IN"):
                self.need_op("(")
                if self.is_word("SELECT"):
                    q = self.query()
                    self.need_op(")")
                    e = A.InQuery(e, q, neg)
                else:
                    items = self.comma_list(self.expr)
                    self.need_op(")")
                    e = A.InList(e, tuple(items), neg)
            elif self.is_op("@@"):
                self.at += 1
                e = A.Bin("@@", e, self.sum())
            elif self.is_op(*COMPARE):
                op = self.cur.text
                self.at += 1
                op = "<>" if op == "!=" else op
                if self.is_word("ANY", "ALL"):
                    kind = self.take_word("ANY", "ALL")
                    e = A.Quantified(op, kind, e, self.paren_query())
                else:
                    e = A.Bin(op, e, self.sum())
            else:
                return e

    def paren_query(self) -> A.Select:
        self.need_op("(")
        q = self.query()
        self.need_op(")")
        return q

    def sum(self):
        e = self.product()
        while op := self.take_op("+", "-"):
            e = A.Bin(op, e, self.product())
        return e

    def product(self):
        e = self.unary()
        while op := self.take_op("*", "/", "%"):
            e = A.Bin(op, e, self.unary())
        return e

    def unary(self):
        if self.take_op("-"):
            x = self.unary()
            return A.Lit(-x.value) if isinstance(x, A.Lit) and isinstance(x.value, int | float) and not isinstance(x.value, bool) else A.Neg(x)
        self.take_op("+")
        return self.primary()

    def primary(self):
        t = self.cur
        if t.kind in ("num", "str"):
            self.at += 1
            return A.Lit(t.value)
        if t.kind in ("var", "sys"):
            self.at += 1
            return A.Var(t.value)
        if self.take_op("("):
            if self.is_word("SELECT"):
                q = self.query()
                self.need_op(")")
                return A.Scalar(q)
            e = self.expr()
            self.need_op(")")
            return e
        if self.take_word("NULL"):
            return A.Lit(None)
        if self.take_word("CASE"):
            return self.case()
        if self.is_word("CAST") and self.peek().text == "(":
            self.at += 2
            x = self.expr()
            self.need_word("AS")
            ty = self.type()
            self.need_op(")")
            return A.Cast(x, ty)
        if (t.kind == "quoted" or t.kind == "id") and self.peek().text == "(" and (t.word() not in RESERVED or t.word() in ("LEFT", "RIGHT")):
            self.at += 2
            return self.function(t.value)
        name = self.ident("an expression")
        if self.is_op(".") and self.peek().kind in ("id", "quoted"):
            self.at += 1
            return A.Name(self.ident(), name)
        return A.Name(name)

    def function(self, name: str) -> A.Func:
        if self.take_op("*"):
            self.need_op(")")
            return A.Func(name.upper(), (), star=True)
        distinct = bool(self.take_word("DISTINCT"))
        args = [] if self.is_op(")") else self.comma_list(self.expr)
        self.need_op(")")
        return A.Func(name.upper(), tuple(args), distinct)

    def case(self) -> A.Case:
        operand = None if self.is_word("WHEN") else self.expr()
        whens = []
        while self.take_word("WHEN"):
            c = self.expr()
            self.need_word("THEN")
            whens.append((c, self.expr()))
        if not whens:
            self.fail("CASE needs a WHEN")
        default = self.expr() if self.take_word("ELSE") else None
        self.need_word("END")
        return A.Case(operand, tuple(whens), default)

    def type(self) -> A.Type:
        name = self.ident("a type").upper()
        length = None
        if name in INT_TYPES:
            return A.Type("INT" if name == "INTEGER" else name)
        if name in FLOAT_TYPES:
            if self.take_op("("):
                self.integer()
                if self.take_op(","):
                    self.integer()
                self.need_op(")")
            return A.Type("FLOAT")
        if name == "BIT":
            return A.Type("BIT")
        if name in TEXT_TYPES:
            if self.take_op("("):
                length = None if self.take_word("MAX") else self.integer()
                self.need_op(")")
            return A.Type("TEXT", length)
        if name in DATE_TYPES:
            return A.Type("DATETIME", 19)
        if name == "UNIQUEIDENTIFIER":
            return A.Type("UUID", 36)
        self.fail(f"unknown type {name}")

    # --- data

    def insert(self) -> A.Statement:
        self.at += 1
        self.take_word("INTO")
        f = {"table": self.ident("a table"), "columns": None}
        if self.is_op("(") and self.peek().word() != "SELECT":
            f["columns"] = self.name_list()
        if self.take_word("VALUES"):
            f["rows"] = self.comma_list(self.value_row)
            return A.Statement("insert_values", f)
        if self.is_word("EXEC", "EXECUTE", "CALL"):
            f["call"] = self.call()
            return A.Statement("insert_exec", f)
        f["query"] = self.query()
        return A.Statement("insert_select", f)

    def value_row(self) -> list:
        self.need_op("(")
        row = self.comma_list(self.expr)
        self.need_op(")")
        return row

    def update(self) -> A.Statement:
        self.at += 1
        table = self.ident("a table")
        self.need_word("SET")

        def one():
            c = self.ident("a column")
            self.need_op("=")
            return c, self.expr()

        sets = self.comma_list(one)
        where = self.expr() if self.take_word("WHERE") else None
        return A.Statement("update", {"table": table, "sets": sets, "where": where})

    def delete(self) -> A.Statement:
        self.at += 1
        self.take_word("FROM")
        table = self.ident("a table")
        return A.Statement("delete", {"table": table, "where": self.expr() if self.take_word("WHERE") else None})

    def truncate(self) -> A.Statement:
        self.at += 1
        self.take_word("TABLE")
        return A.Statement("truncate", {"table": self.ident("a table")})

    # --- definitions

    def create(self) -> A.Statement:
        self.at += 1
        if self.take_word("TABLE"):
            return self.create_table()
        if self.take_word("VIEW"):
            name = self.ident("a view")
            self.need_word("AS")
            start = self.cur.start
            self.query()
            return A.Statement("create_view", {"name": name, "body": self.text[start : self.toks[self.at - 1].stop]})
        if self.take_word("PROCEDURE"):
            return self.create_procedure()
        if self.take_word("INDEX"):
            name = self.ident("an index")
            self.need_word("ON")
            table = self.ident("a table")
            self.need_op("(")
            column = self.ident("a column")
            self.need_op(")")
            gin = False
            if self.take_word("USING"):
                self.need_word("GIN")
                gin = True
            return A.Statement("create_index", {"name": name, "table": table, "column": column, "gin": gin})
        self.fail("expected TABLE, VIEW, PROCEDURE or INDEX")

    def paren_text(self) -> str:
        """Text of a parenthesised expression, which must parse."""
        self.need_op("(")
        start = self.cur.start
        self.expr()
        text = self.text[start : self.toks[self.at - 1].stop]
        self.need_op(")")
        return text

    def create_table(self) -> A.Statement:
        name = self.ident("a table")
        self.need_op("(")
        columns, checks, refs = [], [], []
        while True:
            if self.is_word("CHECK"):
                self.at += 1
                checks.append(self.paren_text())
            elif self.is_word("FOREIGN"):
                self.at += 1
                self.need_word("KEY")
                own = self.name_list()
                self.need_word("REFERENCES")
                refs.append((own, *self.reference()))
            else:
                columns.append(self.column_def())
            if not self.take_op(","):
                break
        self.need_op(")")
        return A.Statement("create_table", {"name": name, "columns": columns, "checks": checks, "refs": refs})

    def reference(self) -> tuple:
        table = self.ident("a table")
        columns = self.name_list() if self.is_op("(") else None
        act = {"DELETE": "NO ACTION", "UPDATE": "NO ACTION"}
        while self.take_word("ON"):
            what = self.need_word("DELETE", "UPDATE")
            if self.take_word("CASCADE"):
                act[what] = "CASCADE"
            else:
                self.need_word("NO")
                self.need_word("ACTION")
        return table, columns, act["DELETE"], act["UPDATE"]

    def column_def(self) -> A.ColumnDef:
        c = A.ColumnDef(self.ident("a column"), self.type())
        if c.name.startswith("_"):
            raise SyntaxProblem(f"column '{c.name}': names starting with _ are reserved")
        while True:
            if self.is_word("NOT"):
                self.at += 1
                self.need_word("NULL")
                c.not_null = True
            elif self.take_word("NULL"):
                pass
            elif self.take_word("PRIMARY"):
                self.need_word("KEY")
                c.primary = c.not_null = True
            elif self.take_word("UNIQUE"):
                c.unique = True
            elif self.take_word("DEFAULT"):
                c.default = self.unary()
            elif self.take_word("IDENTITY"):
                seed, step = 1, 1
                if self.take_op("("):
                    seed = self.number()
                    self.need_op(",")
                    step = self.number()
                    self.need_op(")")
                if step == 0 or not (isinstance(seed, int) and isinstance(step, int)):
                    self.fail("IDENTITY needs whole numbers and a step other than 0")
                if c.type.name not in INT_TYPES:
                    self.fail("IDENTITY needs an integer column")
                c.identity = (seed, step)
            elif self.take_word("CHECK"):
                c.check = self.paren_text()
            elif self.take_word("REFERENCES"):
                c.ref = self.reference()
            else:
                return c

    def drop(self) -> A.Statement:
        self.at += 1
        what = self.need_word("TABLE", "VIEW", "PROCEDURE", "INDEX")
        if_exists = False
        if self.take_word("IF"):
            self.need_word("EXISTS")
            if_exists = True
        f = {"name": self.ident(), "if_exists": if_exists, "table": None}
        if what == "INDEX" and self.take_word("ON"):
            f["table"] = self.ident("a table")
        return A.Statement(f"drop_{what.lower()}", f)

    def alter(self) -> A.Statement:
        self.at += 1
        self.need_word("TABLE")
        table = self.ident("a table")
        what = self.need_word("ADD", "DROP", "RENAME", "ALTER")
        self.take_word("COLUMN")
        f: dict = {"table": table}
        if what == "ADD":
            f["column"] = self.column_def()
        elif what == "DROP":
            f["name"] = self.ident("a column")
        elif what == "RENAME":
            f["name"] = self.ident("a column")
            self.need_word("TO")
            f["to"] = self.ident("a column")
        else:
            f["name"] = self.ident("a column")
            self.take_word("TYPE")
            f["type"] = self.type()
        return A.Statement(f"alter_{what.lower()}", f)

    # --- memory

    def top(self) -> int | None:
        if not self.take_word("TOP"):
            return None
        paren = self.take_op("(")
        n = self.integer()
        if paren:
            self.need_op(")")
        return n

    def show(self) -> A.Statement:
        self.at += 1
        what = self.need_word("TABLES", "MEMORY", "LINKS")
        f: dict = {"table": None, "top": None}
        if what != "TABLES":
            f["top"] = self.top()
            if self.take_word("FROM"):
                f["table"] = self.ident("a table")
            if f["top"] is None:
                f["top"] = self.top()
            if what == "MEMORY" and f["table"] is None:
                self.fail("SHOW MEMORY needs FROM")
        return A.Statement(f"show_{what.lower()}", f)

    def recall(self) -> A.Statement:
        self.at += 1
        top = self.top()
        if self.cur.kind != "str":
            self.fail("RECALL needs a phrase")
        phrase = self.cur.value
        self.at += 1
        table = self.ident("a table") if self.take_word("FROM") else None
        top2 = self.top()
        return A.Statement("recall", {"phrase": phrase, "table": table, "top": next((t for t in (top, top2) if t is not None), 10)})

    def remember(self) -> A.Statement:
        kind = self.cur.word().lower()
        self.at += 1
        self.take_word("FROM")
        table = self.ident("a table")
        return A.Statement(kind, {"table": table, "where": self.expr() if self.take_word("WHERE") else None})

    # --- procedures

    def create_procedure(self) -> A.Statement:
        name, params = self.ident("a procedure"), []
        start = self.cur.start
        paren = self.take_op("(")
        while self.cur.kind == "var":
            params.append(self.parameter())
            if not self.take_op(","):
                break
        if paren:
            self.need_op(")")
        head = self.text[start : self.cur.start]
        self.need_word("AS")
        if self.cur.kind == "end" or self.is_op(";"):
            self.fail("a procedure body must be a statement")
        body = self.statement(True)
        return A.Statement("create_procedure", {"name": name, "params": params, "body": body.text, "head": head})

    def parameter(self) -> tuple:
        var = self.cur.value
        self.at += 1
        self.take_word("AS")
        self.type()
        default = self.expr() if self.take_op("=") else None
        out = bool(self.take_word("OUTPUT", "OUT"))
        return var, default, out

    def call(self) -> A.Statement:
        self.at += 1
        rc = None
        if self.cur.kind == "var" and self.peek().text == "=":
            rc = self.cur.value
            self.at += 2
        if self.is_op("("):
            self.at += 1
            e = self.expr()
            self.need_op(")")
            return A.Statement("exec_text", {"expr": e, "rc": rc})
        name, args = self.ident("a procedure"), []
        if self.take_op("("):
            if not self.is_op(")"):
                args = self.comma_list(self.argument)
            self.need_op(")")
        elif not (self.cur.kind in ("end",) or self.is_op(";", ")") or self.is_word("GO") or self.cur.word() in STARTS or self.is_word("END", "ELSE")):
            args = self.comma_list(self.argument)
        return A.Statement("call", {"name": name, "args": args, "rc": rc})

    def argument(self) -> tuple:
        """(parameter name or None, expression, OUTPUT)"""
        name = None
        if self.cur.kind == "var" and self.peek().text == "=":
            name = self.cur.value
            self.at += 2
        e = self.expr()
        return name, e, bool(self.take_word("OUTPUT", "OUT"))

    def body_until(self, *ends: str) -> list[A.Statement]:
        out = []
        while True:
            while self.take_op(";"):
                pass
            if self.is_word(*ends):
                return out
            if self.cur.kind == "end":
                self.fail(f"expected {ends[0]}")
            out.append(self.statement(True))

    def block(self) -> A.Statement:
        self.need_word("BEGIN")
        body = self.body_until("END")
        self.need_word("END")
        return A.Statement("block", {"body": body})

    def try_catch(self) -> A.Statement:
        self.need_word("BEGIN")
        self.need_word("TRY")
        body = self.body_until("END")
        self.need_word("END")
        self.need_word("TRY")
        while self.take_op(";"):
            pass
        self.need_word("BEGIN")
        self.need_word("CATCH")
        handler = self.body_until("END")
        self.need_word("END")
        self.need_word("CATCH")
        return A.Statement("try", {"body": body, "handler": handler})

    def control(self, w: str) -> A.Statement:
        self.at += 1
        if w == "IF":
            cond, then = self.expr(), self.statement(True)
            save = self.at
            while self.take_op(";"):
                pass
            if self.take_word("ELSE"):
                return A.Statement("if", {"cond": cond, "then": then, "other": self.statement(True)})
            self.at = save
            return A.Statement("if", {"cond": cond, "then": then, "other": None})
        if w == "WHILE":
            return A.Statement("while", {"cond": self.expr(), "body": self.statement(True)})
        if w in ("BREAK", "CONTINUE"):
            return A.Statement(w.lower())
        if w == "RETURN":
            end = self.cur.kind == "end" or self.is_op(";") or self.is_word("END", "ELSE", "GO") or self.cur.word() in STARTS
            return A.Statement("return", {"expr": None if end else self.expr()})
        if w == "DECLARE":
            if self.cur.kind == "var":
                var = self.cur.value
                self.at += 1
                self.take_word("AS")
                self.type()
                return A.Statement("declare", {"var": var, "expr": self.expr() if self.take_op("=") else None})
            name = self.ident("a cursor")
            self.need_word("CURSOR")
            self.need_word("FOR")
            return A.Statement("declare_cursor", {"name": name.lower(), "query": self.query()})
        if w == "SET":
            if self.cur.kind != "var":
                self.fail("SET needs a variable")
            var = self.cur.value
            self.at += 1
            self.need_op("=")
            return A.Statement("set", {"var": var, "expr": self.expr()})
        if w == "FETCH":
            self.need_word("NEXT")
            self.need_word("FROM")
            name = self.ident("a cursor")
            self.need_word("INTO")

            def one():
                if self.cur.kind != "var":
                    self.fail("FETCH needs variables")
                self.at += 1
                return self.toks[self.at - 1].value

            return A.Statement("fetch", {"name": name.lower(), "into": self.comma_list(one)})
        return A.Statement(f"{w.lower()}_cursor", {"name": self.ident("a cursor").lower()})


def parse_expression(text: str):
    p = Parser(text)
    e = p.expr()
    if p.cur.kind != "end":
        p.fail("unexpected text after the expression")
    return e


def parse_query(text: str) -> A.Select:
    p = Parser(text)
    q = p.query()
    if p.cur.kind != "end" and not p.is_op(";"):
        p.fail("unexpected text after the query")
    return q
