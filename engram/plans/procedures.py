"""Interpreter of stored procedures: frames, control flow, cursors, TRY/CATCH, dynamic SQL. Data work stays in Spark."""

from __future__ import annotations

import sys

from ..errors import EngineError
from . import ast as A
from .parser import Parser

MAX_DEPTH = 128
#: Python frames that one procedure call needs at most.
FRAMES = 60


class Break(Exception):
    pass


class Continue(Exception):
    pass


class Return(Exception):
    def __init__(self, value):
        self.value = value


class Frame:
    """Variables of one call, in nested blocks, and its cursors."""

    def __init__(self):
        self.scopes: list[dict] = [{}]
        self.cursors: dict[str, dict] = {}
        self.system = {"@@fetch_status": -1, "@@error_message": None}

    def variables(self) -> dict:
        out = dict(self.system)
        for s in self.scopes:
            out |= s
        return out

    def declare(self, name: str, value):
        if name in self.scopes[-1]:
            raise EngineError(f"variable {name} is already declared")
        self.scopes[-1][name] = value

    def assign(self, name: str, value):
        for s in reversed(self.scopes):
            if name in s:
                s[name] = value
                return
        raise EngineError(f"variable {name} is not defined")


class Interpreter:
    def __init__(self, engine):
        self.e, self.depth = engine, 0

    def message(self, error: Exception) -> str:
        return self.e.error_text(error)

    def value(self, e, frame: Frame | None):
        variables = frame.variables() if frame else {}
        ok, v = quick(e, variables)
        return v if ok else self.e.evaluate(e, variables)

    def truth(self, e, frame: Frame) -> bool:
        ok, v = quick(e, frame.variables())
        if ok:
            return bool(v)
        return bool(self.e.evaluate(A.Func("IIF", (e, A.Lit(1), A.Lit(0))), frame.variables()))

    # --- calls

    def call(self, s: A.Statement, frame: Frame | None, capture: bool = False) -> list:
        p = self.e.storage.catalog["procs"].get(s.name.lower())
        if p is None:
            raise EngineError(f"unknown procedure '{s.name}'")
        params = _params(p["head"])
        if len(s.args) > len(params):
            raise EngineError(f"procedure '{p['name']}' takes at most {len(params)} arguments")
        given: dict[str, tuple] = {}
        for i, (name, e, out) in enumerate(s.args):
            if name is None:
                name = params[i][0]
            elif name not in [x for x, _, _ in params]:
                raise EngineError(f"procedure '{p['name']}' has no parameter {name}")
            if name in given:
                raise EngineError(f"parameter {name} is given more than once")
            if out and not isinstance(e, A.Var):
                raise EngineError("an OUTPUT argument must be a variable")
            given[name] = (e, out)
        own, back = Frame(), []
        for name, default, is_out in params:
            if name in given:
                e, out = given[name]
                if out and is_out:
                    back.append((name, e.name))
                    value = frame.variables().get(e.name) if frame else None
                else:
                    value = self.value(e, frame)
            elif default is not None:
                value = self.value(default, own)
            elif is_out:
                value = None
            else:
                raise EngineError(f"procedure '{p['name']}' expects an argument for {name}")
            own.declare(name, value)
        if self.depth >= MAX_DEPTH:
            raise EngineError("procedure call depth exceeded")
        if sys.getrecursionlimit() < MAX_DEPTH * FRAMES + 1000:
            sys.setrecursionlimit(MAX_DEPTH * FRAMES + 1000)
        self.depth += 1
        results, code = [], 0
        own.scopes.append({})
        try:
            parser = Parser(p["body"])
            self.run(parser.statement(True), own, results)
        except Return as r:
            code = r.value if r.value is not None else 0
        except (Break, Continue):
            raise EngineError("BREAK or CONTINUE outside of a loop") from None
        finally:
            self.depth -= 1
        for name, target in back:
            frame.assign(target, own.variables()[name])
        if s.rc and frame:
            frame.assign(s.rc, code)
        return results

    def dynamic(self, s: A.Statement, frame: Frame | None) -> list:
        text = self.value(s.expr, frame)
        results: list = []
        p = Parser(str(text) if text is not None else "")
        while (inner := p.next_statement()) is not None:
            self.run(inner, frame or Frame(), results)
        if s.rc and frame:
            rows = next((r for r in results if r.df is not None), None)
            first = rows.df.first() if rows else None
            frame.assign(s.rc, first[0] if first else None)
            return [r for r in results if r is not rows]
        return results

    # --- statements

    def run(self, s: A.Statement, frame: Frame, out: list):
        k = s.kind
        if k == "block":
            frame.scopes.append({})
            try:
                for x in s.body:
                    self.run(x, frame, out)
            finally:
                frame.scopes.pop()
        elif k == "if":
            if self.truth(s.cond, frame):
                self.run(s.then, frame, out)
            elif s.other is not None:
                self.run(s.other, frame, out)
        elif k == "while":
            while self.truth(s.cond, frame):
                try:
                    self.run(s.body, frame, out)
                except Break:
                    break
                except Continue:
                    continue
        elif k == "break":
            raise Break
        elif k == "continue":
            raise Continue
        elif k == "return":
            raise Return(self.value(s.expr, frame) if s.expr is not None else None)
        elif k == "declare":
            frame.declare(s.var, self.value(s.expr, frame) if s.expr is not None else None)
        elif k == "set":
            frame.assign(s.var, self.value(s.expr, frame))
        elif k == "try":
            self.guarded(s, frame, out)
        elif k == "call":
            out.extend(self.call(s, frame))
        elif k == "exec_text":
            out.extend(self.dynamic(s, frame))
        elif k.endswith("_cursor") or k == "fetch":
            self.cursor(s, frame)
        else:
            out.extend(self.e.execute(s, frame))

    def guarded(self, s: A.Statement, frame: Frame, out: list):
        depth = len(frame.scopes)
        try:
            for x in s.body:
                found: list = []
                self.run(x, frame, found)
                for r in found:  # rows are computed here, so that their errors are caught here
                    if r.df is not None:
                        r.df = self.e.materialise(r.df)
                out.extend(found)
        except (Break, Continue, Return):
            raise
        except Exception as error:
            del frame.scopes[depth:]
            frame.system["@@error_message"] = self.message(error)
            for x in s.handler:
                self.run(x, frame, out)

    def cursor(self, s: A.Statement, frame: Frame):
        if s.kind == "declare_cursor":
            if s.name in frame.cursors:
                raise EngineError(f"cursor '{s.name}' is already declared")
            frame.cursors[s.name] = {"query": s.query, "rows": None}
            return
        c = frame.cursors.get(s.name)
        if c is None:
            raise EngineError(f"cursor '{s.name}' is not declared")
        if s.kind == "open_cursor":
            df = self.e.captured(s.query if "query" in s.f else c["query"], frame.variables())
            c["rows"] = self.e.materialise(df).toLocalIterator()  # partition by partition
        elif s.kind == "close_cursor":
            c["rows"] = None
        elif s.kind == "deallocate_cursor":
            del frame.cursors[s.name]
        else:
            if c["rows"] is None:
                raise EngineError(f"cursor '{s.name}' is not open")
            row = next(c["rows"], None)
            frame.system["@@fetch_status"] = 0 if row is not None else -1
            if row is not None:
                if len(row) != len(s.into):
                    raise EngineError(f"FETCH needs {len(row)} variables")
                for name, v in zip(s.into, row, strict=True):
                    frame.assign(name, v)


def _params(head: str) -> list[tuple]:
    p = Parser(head)
    out = []
    p.take_op("(")
    while p.cur.kind == "var":
        out.append(p.parameter())
        if not p.take_op(","):
            break
    return out


_QUICK = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def quick(e, variables: dict) -> tuple[bool, object]:
    """Whole-number arithmetic of loops without a Spark job: (known, value)."""
    if isinstance(e, A.Lit) and (e.value is None or isinstance(e.value, int | str | float)):
        return True, e.value
    if isinstance(e, A.Var) and e.name in variables:
        return True, variables[e.name]
    if isinstance(e, A.Bin) and e.op in _QUICK:
        ok1, a = quick(e.left, variables)
        ok2, b = quick(e.right, variables)
        if ok1 and ok2 and type(a) is int and type(b) is int:
            v = _QUICK[e.op](a, b)
            if isinstance(v, bool) or abs(v) < 2**62:
                return True, v
    return False, None
