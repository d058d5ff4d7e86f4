"""JSON lines over TCP or a unix socket: one request and one response a line.

Request: {"sql": ..., "session": id or absent, "token": ..., "observe": "0" or "1"}; response: {"ok", "text", "columns", "rows", "session"}.
Statements run one at a time on one engine; a session that has begun a transaction keeps the engine until it ends. For many
clients and large results, Spark Connect is the better door; this one serves small tools.
"""

from __future__ import annotations

import hmac
import json
import os
import socketserver
import threading
import time
import uuid

from pyspark.errors import PySparkException

from ..errors import EngineError

#: Rows of a result that go into one response; the rest is announced in the text.
MAX_ROWS = 10_000


class Service:
    def __init__(self, engine, token: str | None = None, ttl: float = 300.0, clock=time.monotonic):
        self.engine, self.token, self.ttl, self.clock = engine, token, ttl, clock
        self.sessions: dict[str, float] = {}
        self.free = threading.Condition()
        self.owner: str | None = None  # the session inside of a transaction

    def _session(self, given: str | None) -> str:
        now = self.clock()
        for s in [s for s, t in self.sessions.items() if now - t > self.ttl]:
            del self.sessions[s]
            if s == self.owner:
                self._abandon()
        s = given if given in self.sessions else uuid.uuid4().hex
        self.sessions[s] = now
        return s

    def _abandon(self):
        while self.engine.storage.stack:
            self.engine.storage.rollback()
        self.owner = None
        self.free.notify_all()

    def handle(self, line: str) -> dict:
        try:
            q = json.loads(line)
            sql = q["sql"]
        except (ValueError, KeyError, TypeError):
            return {"ok": False, "text": "a request is a JSON object with sql", "columns": [], "rows": [], "session": None}
        if self.token is not None and not hmac.compare_digest(str(q.get("token", "")), self.token):
            return {"ok": False, "text": "wrong token", "columns": [], "rows": [], "session": None}
        with self.free:
            s = self._session(q.get("session"))
            while self.owner not in (None, s):
                self.free.wait(1.0)
                self._session(s)
            out = self._run(sql, str(q.get("observe", "1")) == "0")
            self.owner = s if self.engine.storage.stack else None
            self.free.notify_all()
        return out | {"session": s}

    def _run(self, sql: str, observe: bool) -> dict:
        before = self.engine.observer
        self.engine.observer = before or observe
        columns, rows, text = [], [], []
        try:
            for r in self.engine.run(sql):
                if r.df is None:
                    text.append(r.message or "")
                    continue
                columns = r.df.columns
                got = r.df.limit(MAX_ROWS + 1).collect()
                rows = [[v if isinstance(v, int | float | str | None) else str(v) for v in x] for x in got[:MAX_ROWS]]
                text.append(f"({len(rows)} row{'s' * (len(rows) != 1)}{', more not sent' if len(got) > MAX_ROWS else ''})")
            return {"ok": True, "text": "\n".join(text), "columns": columns, "rows": rows}
        except (EngineError, PySparkException) as error:
            return {"ok": False, "text": self.engine.error_text(error), "columns": [], "rows": []}
        finally:
            self.engine.observer = before


def make_server(service: Service, port: int | None = None, unix: str | None = None):
    class Handler(socketserver.StreamRequestHandler):
        def handle(self):
            for line in self.rfile:
                if line.strip():
                    self.wfile.write((json.dumps(service.handle(line.decode("utf-8", "replace"))) + "\n").encode())

    class Tcp(socketserver.ThreadingTCPServer):
        allow_reuse_address, daemon_threads = True, True

    class Unix(socketserver.ThreadingUnixStreamServer):
        daemon_threads = True

    if unix:
        if os.path.exists(unix):
            os.unlink(unix)
        return Unix(unix, Handler)
    return Tcp(("127.0.0.1", port or 0), Handler)
