"""Command line: run statements, a script, a shell or a JSON-lines server over a database directory.

    python -m engram DIR [-c SQL | -f FILE] [-r] [--binary] [--on-error stop|continue]
    python -m engram serve DIR [--port N | --unix PATH] [--token T] [--session-ttl S]
"""

from __future__ import annotations

import argparse
import sys

from . import Engine, EngineError, __version__
from .plans.lexer import tokens


def session():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.appName("engram").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    return s


def complete(text: str) -> bool:
    """Whether a shell batch can run: it ends with ; or GO and all BEGIN and CASE are closed."""
    try:
        words = [t.word() or t.text for t in tokens(text)[:-1]]
    except EngineError:
        return False
    depth = 0
    for i, w in enumerate(words):
        after = words[i + 1] if i + 1 < len(words) else ""
        if w == "CASE" or (w == "BEGIN" and after not in (";", "TRANSACTION", "GO", "")):
            depth += 1
        elif w == "END":
            depth -= 1
    return depth <= 0 and bool(words) and words[-1] in (";", "GO")


def run(engine: Engine, text: str, out=sys.stdout) -> bool:
    try:
        for r in engine.run(text):
            print(engine.show(r), file=out)
    except EngineError as error:
        print(f"error: {error}", file=out)
        return False
    except Exception as error:  # a query's own error, when its rows are computed
        print(f"error: {engine.error_text(error)}", file=out)
        return False
    return True


def command(engine: Engine, line: str, out=sys.stdout) -> bool:
    """A dot command of the shell; False ends it."""
    name, _, rest = line.partition(" ")
    rest = rest.strip()
    if name in (".exit", ".quit"):
        return False
    if name == ".help":
        print(".help .tables .schema [table] .memory TABLE .links [TABLE] .read FILE .exit .quit", file=out)
    elif name == ".tables":
        run(engine, "SHOW TABLES", out)
    elif name == ".memory" and rest:
        run(engine, f"SHOW MEMORY FROM [{rest}]", out)
    elif name == ".links":
        run(engine, f"SHOW LINKS FROM [{rest}]" if rest else "SHOW LINKS", out)
    elif name == ".read" and rest:
        with open(rest) as f:
            run(engine, f.read(), out)
    elif name == ".schema":
        for t in engine.storage.catalog["tables"].values():
            if not rest or t["name"].lower() == rest.lower():
                cols = [f"{c['name']} {c['type']}{'(' + str(c['length']) + ')' if c['length'] else ''}{' PRIMARY KEY' * c['primary']}{' UNIQUE' * c['unique']}{' NOT NULL' * (c['not_null'] and not c['primary'])}" for c in t["columns"]]
                print(f"{t['name']} ({', '.join(cols)})", file=out)
    else:
        print(f"unknown command {name}, try .help", file=out)
    return True


def shell(engine: Engine, source=sys.stdin, out=sys.stdout):
    batch = ""
    for line in source:
        if not batch and line.strip().startswith("."):
            if not command(engine, line.strip(), out):
                return
            continue
        batch += line
        if complete(batch):
            run(engine, batch, out)
            batch = ""
    if batch.strip():
        run(engine, batch, out)


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv[:1] == ["serve"]:
        p = argparse.ArgumentParser("engram serve")
        p.add_argument("dir")
        p.add_argument("--port", type=int, default=7878)
        p.add_argument("--unix")
        p.add_argument("--token")
        p.add_argument("--session-ttl", type=float, default=300)
        a = p.parse_args(argv[1:])
        from .sources.server import Service, make_server

        with make_server(Service(Engine(session(), a.dir), a.token, a.session_ttl), a.port, a.unix) as server:
            server.serve_forever()
        return 0
    p = argparse.ArgumentParser("engram")
    p.add_argument("dir")
    p.add_argument("-c", dest="sql")
    p.add_argument("-f", dest="file")
    p.add_argument("-r", "--no-reinforce", action="store_true")
    p.add_argument("--binary", action="store_true", help="compare text by its bytes")
    p.add_argument("--on-error", choices=["stop", "continue"], default="continue")
    p.add_argument("-v", "--version", action="version", version=__version__)
    a = p.parse_args(argv)
    engine = Engine(session(), a.dir, observer=a.no_reinforce, string_semantics="binary" if a.binary else "fold", on_error=a.on_error)
    if a.sql is not None:
        return 0 if run(engine, a.sql) else 1
    if a.file is not None:
        with open(a.file) as f:
            return 0 if run(engine, f.read()) else 1
    shell(engine)
    return 0


if __name__ == "__main__":
    sys.exit(main())
