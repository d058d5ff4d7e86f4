"""Manifests: no crash loses a database, no two engines overwrite each other, row ids stay dense, indexes follow their segments."""

import json

import pytest

from engram import Engine, EngineError
from engram.sources.storage import Storage


def count(engine, table="ledger"):
    return engine.sql(f"SELECT COUNT(*) AS n FROM {table}").first()[0]


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "db")
    Engine(spark, path, observer=True).run("CREATE TABLE ledger (k INT PRIMARY KEY, note NVARCHAR(40)); INSERT INTO ledger VALUES (1, 'oak plank'), (2, 'pine plank')")
    return path


class Killed(Exception):
    pass


@pytest.mark.parametrize("at", ["_write_aside", "half", "_publish", "after"])
def test_a_crash_between_any_two_steps_keeps_one_whole_state(spark, path, monkeypatch, at):
    real = getattr(Storage, "_write_aside" if at == "half" else "_publish" if at == "after" else at)

    def die(self, *args):
        if at == "half":  # half of the manifest is written
            real(self, args[0][: len(args[0]) // 2])
        if at == "after":
            real(self, *args)
        raise Killed

    e = Engine(spark, path, observer=True)
    monkeypatch.setattr(Storage, "_write_aside" if at == "half" else "_publish" if at == "after" else at, die)
    with pytest.raises(Killed):
        e.run("INSERT INTO ledger VALUES (3, 'elm plank')")
    monkeypatch.undo()
    again = Engine(spark, path, observer=True)
    assert count(again) == (3 if at == "after" else 2)
    again.run("INSERT INTO ledger VALUES (4, 'ash plank'); VACUUM")
    assert count(Engine(spark, path, observer=True)) == (4 if at == "after" else 3)


def test_the_slower_of_two_engines_is_refused(spark, path, tmp_path):
    a, b = Engine(spark, path, observer=True), Engine(spark, path, observer=True)
    a.run("INSERT INTO ledger VALUES (3, 'elm plank')")
    with pytest.raises(EngineError, match="another engine"):
        b.run("INSERT INTO ledger VALUES (5, 'yew plank')")
    assert count(b) == 3  # it now sees what the other did
    b.run("INSERT INTO ledger VALUES (5, 'yew plank')")
    with pytest.raises(EngineError, match="another engine"):
        a.run("VACUUM")
    assert count(Engine(spark, path, observer=True)) == 4


def test_commit_is_one_manifest_and_vacuum_drops_older_ones(spark, path, tmp_path):
    manifests = lambda: sorted(p.name for p in (tmp_path / "db").glob("catalog-*.json"))
    e = Engine(spark, path, observer=True)
    before = manifests()
    e.run("BEGIN; INSERT INTO ledger VALUES (7, 'a'); DELETE FROM ledger WHERE k = 1; INSERT INTO ledger VALUES (8, 'b'); COMMIT")
    assert len(manifests()) == len(before) + 1
    e.run("VACUUM")
    assert len(manifests()) == 1 and json.loads((tmp_path / "db" / manifests()[0]).read_text())["tables"]["ledger"]["rows"] == 3
    e.run("SELECT k FROM ledger; PRINT 'nothing changes'")
    assert len(manifests()) == 1


def test_row_ids_have_no_gaps(spark, path):
    e = Engine(spark, path, observer=True)
    e.register("many", spark.range(100, 160, 1, 7).withColumnRenamed("id", "k"))
    e.run("INSERT INTO ledger (k) SELECT k FROM many; INSERT INTO ledger VALUES (999, 'last')")
    rids = [r[0] for r in e.sql("SELECT _rid FROM ledger ORDER BY _rid").collect()]
    assert rids == list(range(1, 64)) and e.sql("SELECT _rid FROM ledger WHERE k = 999").first()[0] == 63


def test_an_index_is_kept_up_by_segment(spark, path, monkeypatch):
    e = Engine(spark, path, observer=True)
    e.run("CREATE INDEX words ON ledger (note) USING GIN; INSERT INTO ledger VALUES (3, 'oak beam')")
    first = dict(e.storage.table("ledger")["indexes"]["words"]["parts"])
    e.run("DELETE FROM ledger WHERE k = 3; INSERT INTO ledger VALUES (4, 'oak door')")
    second = e.storage.table("ledger")["indexes"]["words"]["parts"]
    assert len(first) == 2 and len(set(first.values()) & set(second.values())) == 1  # the untouched segment's postings stay
    asked = "SELECT k FROM ledger WHERE to_tsvector(note) @@ to_tsquery('oak') ORDER BY k"
    assert "lexeme" in e.sql("EXPLAIN " + asked).first()[0]
    assert [r[0] for r in e.sql(asked).collect()] == [1, 4]
    monkeypatch.setattr(Engine, "refresh_index", lambda *a: None)
    assert [r[0] for r in Engine(spark, path, observer=True).sql(asked).collect()] == [1, 4]  # and are in the manifest


def test_only_constraints_on_changed_columns_are_checked(spark, path, monkeypatch):
    from engram.operators import constraints as C

    e = Engine(spark, path, observer=True)
    e.run("CREATE TABLE entry (id INT PRIMARY KEY, book INT REFERENCES ledger(k), v INT CHECK (v < 100)); INSERT INTO entry VALUES (1, 1, 5), (2, 2, 6)")
    asked = []
    for name in ("unique", "orphans"):
        real = getattr(C, name)
        monkeypatch.setattr(C, name, lambda *a, real=real, name=name: asked.append(name) or real(*a))
    e.run("UPDATE entry SET v = 9")
    assert asked == []
    e.run("UPDATE entry SET book = 1 WHERE id = 2")
    assert asked == ["orphans"]
    with pytest.raises(EngineError, match="already exists"):
        e.run("UPDATE entry SET id = 1 WHERE id = 2")
    with pytest.raises(EngineError, match="CHECK"):
        e.run("UPDATE entry SET v = 100 WHERE id = 2")


def test_text_vectors_of_long_texts(spark, path):
    words = [f"w{i}" for i in range(20_000)] * 2
    e = Engine(spark, path, observer=True)
    e.register("long", spark.createDataFrame([(" ".join(words),), ("",), (None,), ("The OF",), ("b a B the a",)], "t string"))
    got = [r[0] for r in e.sql("SELECT to_tsvector(t) FROM long").collect()]
    assert got[0].split(" ") == [f"w{i}:{i + 1},{i + 20_001}" for i in range(20_000)]
    assert got[1:] == ["", None, "", "b:1,2"]
