"""Shell, server and streaming."""

import io
import json
import socket
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram import Engine, EngineError
from engram.__main__ import complete, run, shell
from engram.functions import fulltext as FT
from engram.functions import memory as M
from engram.operators import memory as OM
from engram.plans.lexer import tokens
from engram.plans.parser import Parser, parse_expression
from engram.sources.server import Service, make_server


@pytest.fixture
def e(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def test_shell(e, tmp_path):
    script = tmp_path / "s.sql"
    script.write_text("PRINT 'read'")
    out = io.StringIO()
    text = f"CREATE TABLE t (a INT PRIMARY KEY, s NVARCHAR(5));\nINSERT INTO t\nVALUES (1, NULL);\nSELECT a, s,\n CASE WHEN 1 = 1 THEN 2.5 END AS c FROM t;\n.tables\n.schema\n.memory t\n.links\n.read {script}\n.nosuch\n.help\nSELEC;\nPRINT 'x' GO\n.exit\nPRINT 'never';\n"
    shell(e, io.StringIO(text), out)
    got = out.getvalue()
    for part in ["table 't' created", "(1 row inserted)", "NULL  2.5", "t (a INT PRIMARY KEY, s TEXT(5))", "read", "unknown command .nosuch", "error: unrecognised statement", "\nx\n"]:
        assert part in got
    assert "never" not in got
    assert not run(e, "SELECT 1 / 0 AS x", out) and "division by zero" in out.getvalue()


def test_batches_wait_for_their_end():
    assert complete("SELECT 1;") and complete("BEGIN; ") and complete("SELECT 1 GO") and complete("BEGIN TRANSACTION;")
    assert not complete("SELECT 1") and not complete("CREATE PROCEDURE p AS BEGIN SELECT 1;") and complete("CREATE PROCEDURE p AS BEGIN SELECT CASE WHEN 1 = 1 THEN 2 END; END;")
    assert not complete("SELECT 'open;")


def test_server(e, tmp_path):
    service = Service(e, token="t", ttl=60)
    path = str(tmp_path / "sock")
    with make_server(service, unix=path) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        with socket.socket(socket.AF_UNIX) as s:
            s.connect(path)
            f = s.makefile("rw")

            def ask(**q):
                f.write(json.dumps(q) + "\n")
                f.flush()
                return json.loads(f.readline())

            assert not ask(sql="SELECT 1")["ok"]
            a = ask(sql="CREATE TABLE t (a INT); INSERT INTO t VALUES (1), (NULL); SELECT a FROM t ORDER BY a", token="t")
            assert a["ok"] and a["columns"] == ["a"] and a["rows"] == [[None], [1]]
            b = ask(sql="SELECT nope FROM t", token="t", session=a["session"])
            assert not b["ok"] and b["session"] == a["session"] and "no column" in b["text"]
            assert ask(sql="BEGIN; DELETE FROM t", token="t", session=a["session"])["ok"]
            assert service.owner == a["session"]
            assert ask(sql="ROLLBACK; SELECT COUNT(*) FROM t", token="t", session=a["session"], observe="0")["rows"] == [[2]]
            assert ask(nothing=1)["ok"] is False
        server.shutdown()


def test_expired_session_gives_up_its_transaction(e):
    now = [0.0]
    service = Service(e, ttl=10, clock=lambda: now[0])
    a = service.handle(json.dumps({"sql": "CREATE TABLE t (a INT); BEGIN; INSERT INTO t VALUES (1)"}))
    now[0] = 20.0
    b = service.handle(json.dumps({"sql": "SELECT COUNT(*) FROM t", "session": a["session"]}))
    assert b["rows"] == [[0]] and b["session"] != a["session"]


def test_streaming_strengths_equal_the_fold(spark, tmp_path):
    from engram.streaming.strength import strengths, touches_per_window

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    touches = ev.select(F.col("user_id").alias("rid"), F.date_trunc("second", "ts").alias("ts"), F.col("event_id").alias("seq"), F.lit("touch").alias("kind"), F.lit(1.0).alias("boost"))
    src = str(tmp_path / "in")
    touches.orderBy("ts").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(touches.schema).parquet(src)
    q = strengths(stream).writeStream.format("memory").queryName("live").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["rid"]: (round(r["strength"], 6), r["accesses"]) for r in spark.table("live").collect()}
    log = touches.select(F.col("rid").alias("_rid"), F.unix_timestamp("ts").cast("double").alias("ts"), "seq", "kind", "boost")
    rows = log.groupBy("_rid").agg(F.min("ts").alias("last0")).select("_rid", F.lit(1.0).alias("strength0"), F.lit(0).cast("long").alias("access0"), "last0")
    want = {r["_rid"]: (round(r["strength"], 6), r["access_count"]) for r in OM.fold(rows, log).collect()}
    assert got == want
    q = touches_per_window(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("daily").agg(F.sum("touches")).first()[0] == touches.count()


# --- properties


def model(events, start, initial=1.0):
    """The fold, one event after another."""
    s, last, n = initial, start, 0
    for ts, kind, boost in events:
        now = max(last, ts)
        s *= 2 ** (-(now - last) / M.HALF_LIFE)
        last = now
        if kind == "reset":
            s = 0.0
        else:
            s, n = min(s + boost, M.MAX_STRENGTH), n + 1
    return s, n


EVENT = st.tuples(st.integers(0, 40 * 86400), st.sampled_from(["touch", "touch", "touch", "reset"]), st.sampled_from([1.0, 1.5, 3.0, 300.0]))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(EVENT, max_size=8), min_size=1, max_size=12))
def test_fold_equals_the_model(spark, histories):
    log, rows, want = [], [], {}
    for rid, events in enumerate(histories):
        events = sorted(events)
        rows.append((rid, 1.0, 0, 0.0))
        log += [(rid, float(ts), i, kind, boost) for i, (ts, kind, boost) in enumerate(events)]
        want[rid] = model(events, 0)
    got = OM.fold(
        spark.createDataFrame(rows, "_rid long, strength0 double, access0 long, last0 double"), spark.createDataFrame(log, "_rid long, ts double, seq long, kind string, boost double")
    ).collect()
    for r in got:
        s, n = want[r["_rid"]]
        assert abs(r["strength"] - s) < 1e-6 and r["access_count"] == n


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_lexer_accepts_or_refuses(text):
    try:
        got = tokens(text)
    except EngineError:
        return
    assert got[-1].kind == "end" and all(text[t.start : t.stop] == t.text for t in got)


QUERY = st.recursive(st.sampled_from(["fox", "dog", "the", "x1"]), lambda q: st.one_of(q.map(lambda a: f"!{a}"), st.tuples(q, st.sampled_from("&|"), q).map(lambda t: f"({t[0]} {t[1]} {t[2]})")), max_leaves=6)


@settings(max_examples=200, deadline=None)
@given(QUERY, st.sets(st.sampled_from(["fox", "dog", "x1"])))
def test_text_queries_round_trip_and_index_candidates(query, doc):
    tree = FT.parse_query(query)

    def holds(t):
        if t[0] == "lex":
            return t[1] in doc
        if t[0] == "not":
            return not holds(t[1])
        return holds(t[1]) and holds(t[2]) if t[0] == "and" else holds(t[1]) or holds(t[2])

    if tree is None:
        return
    assert FT.parse_query(FT.query_text(tree)) is not None
    again = FT.parse_query(FT.query_text(tree))
    match, tree2 = holds(tree), again
    tree = tree2
    assert holds(tree) == match
    words = FT.candidates(tree)
    if match and words is not None:
        assert doc & set(words)


def test_parser_precedence():
    e = parse_expression("1 + 2 * 3 = 7 OR NOT a AND b")
    assert e.op == "OR" and e.left.op == "=" and e.right.op == "AND"
    p = Parser("SELECT 1; SELECT 2 GO SELECT 3")
    n = 0
    while p.next_statement():
        n += 1
    assert n == 3
