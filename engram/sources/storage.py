"""Catalog and snapshots: numbered JSON manifests beside immutable Parquet segments.

A table is a list of segments; a statement writes new ones and then publishes the next manifest, so readers see all of it or
nothing. Manifest n+1 is written whole under another name and then renamed to its number, which must be free: a crash
leaves manifest n in force, and of two engines that both start from n one is refused. Nothing is deleted before
VACUUM, which drops older manifests and what the newest does not name. Columns have physical names of their own: renaming,
dropping and adding without a default touch the manifest only. All file work goes through Hadoop's file systems, so the path can
be in any store that Spark reads.
"""

from __future__ import annotations

import copy
import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.scalar import SPARK_TYPES, kind_of

#: Physical columns of every row: its id, and strength, accesses and last access (seconds) as of the last compaction.
SYSTEM = [("_rid", "bigint"), ("_s0", "double"), ("_a0", "bigint"), ("_l0", "double")]
LOG_SCHEMA = "_rid bigint, ts double, seq bigint, kind string, boost double"
LINK_SCHEMA = "a bigint, b bigint, w double"
#: Segments of the log or the links beyond which they are merged.
MAX_SEGMENTS = 64
_MANIFEST = re.compile(r"catalog-(\d{12})\.json")
EMPTY = {"next_rid": 1, "seq": 0, "tables": {}, "views": {}, "procs": {}, "log": [], "links": []}


class Storage:
    def __init__(self, spark: SparkSession, path: str | None):
        self.spark = spark
        self.path = path or f"{spark.conf.get('spark.sql.warehouse.dir')}/engram-{uuid.uuid4().hex}"
        self.stack: list[dict] = []
        self.catalog = self._load()

    # --- files

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifests(self) -> list[int]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        found = (_MANIFEST.fullmatch(f.getPath().getName()) for f in fs.listStatus(p))
        return sorted(int(m[1]) for m in found if m)

    def _manifest(self, n: int) -> str:
        return f"{self.path}/catalog-{n:012d}.json"

    def _read(self, path: str) -> dict:
        return json.loads("".join(r.value for r in self.spark.read.text(path, wholetext=True).collect()))

    def _load(self) -> dict:
        """The newest manifest."""
        numbers = self._manifests()
        self.generation = numbers[-1] if numbers else 0
        catalog = self._read(self._manifest(self.generation)) if numbers else copy.deepcopy(EMPTY)
        self.saved = json.dumps(catalog)
        return catalog

    def save(self):
        """Publish the catalog as the next manifest, if it has changed; inside a transaction nothing is written."""
        if self.stack:
            return
        text = json.dumps(self.catalog)
        if text == self.saved:
            return
        if not self._publish(self._write_aside(text), self.generation + 1):
            self.catalog = self._load()
            raise EngineError("another engine has changed the database meanwhile; the statement is undone, run it again")
        self.generation += 1
        self.saved = text

    def _write_aside(self, text: str) -> str:
        path = f"{self.path}/catalog-{uuid.uuid4().hex}.new"
        fs, p = self._fs(path)
        out = fs.create(p, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return path

    def _publish(self, path: str, n: int) -> bool:
        """Rename to manifest n; False if there is one."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        fs, source = self._fs(path)
        target = self._fs(self._manifest(n))[1]
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never_over = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(source, target, never_over)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            fs.delete(source, False)
            return False
        return True

    def remove(self, path: str):
        fs, p = self._fs(path)
        fs.delete(p, True)

    def new_dir(self, kind: str) -> str:
        return f"{self.path}/{kind}/{uuid.uuid4().hex}"

    def stage(self, df: DataFrame) -> DataFrame:
        """Written out and read again: what follows sees one fixed set of rows."""
        d = self.new_dir("tmp")
        df.write.parquet(d)
        return self.spark.read.schema(df.schema).parquet(d)

    # --- transactions

    def begin(self):
        self.stack.append(copy.deepcopy(self.catalog))

    def commit(self):
        if not self.stack:
            raise EngineError("COMMIT without BEGIN")
        self.stack.pop()
        self.save()

    def rollback(self):
        if not self.stack:
            raise EngineError("ROLLBACK without BEGIN")
        self.catalog = self.stack.pop()

    # --- tables

    def table(self, name: str) -> dict:
        t = self.catalog["tables"].get(name.lower())
        if t is None:
            raise EngineError(f"unknown table '{name}'")
        return t

    def column(self, t: dict, name: str) -> dict:
        for c in t["columns"]:
            if c["name"].lower() == name.lower():
                return c
        raise EngineError(f"no column '{name}' in '{t['name']}'")

    def schema(self, t: dict) -> T.StructType:
        parts = [f"`{c['phys']}` {SPARK_TYPES[c['type']]}" for c in t["columns"]] + [f"`{n}` {k}" for n, k in SYSTEM]
        return T._parse_datatype_string(", ".join(parts))

    def physical(self, t: dict) -> DataFrame:
        """All rows under physical names."""
        schema = self.schema(t)
        if not t["segments"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*t["segments"])

    def rows(self, t: dict) -> DataFrame:
        """All rows under their names, with the system columns."""
        cols = [F.col(f"`{c['phys']}`").alias(c["name"]) for c in t["columns"]] + [F.col(n) for n, _ in SYSTEM]
        return self.physical(t).select(*cols)

    def kinds(self, t: dict) -> list[tuple[str, str]]:
        return [(c["name"], kind_of(c["type"])) for c in t["columns"]]

    def split(self, t: dict, rids: DataFrame) -> tuple[list[str], list[str]]:
        """(segments that hold any of the rows, all others); only the former need to be written anew."""
        if len(t["segments"]) < 2:
            return t["segments"], []
        place = F.regexp_extract(F.col("_metadata.file_path"), "/tables/([0-9a-f]{32})/", 1)
        files = self.spark.read.schema(self.schema(t)).parquet(*t["segments"]).select("_rid", place.alias("s"))
        found = {r["s"] for r in files.join(rids.select("_rid").distinct(), "_rid", "left_semi").select("s").distinct().collect()}  # a name for each segment
        hit = [d for d in t["segments"] if d.rsplit("/", 1)[1] in found]
        return hit, [d for d in t["segments"] if d not in hit]

    def write(self, df: DataFrame) -> str:
        d = self.new_dir("tables")
        df.write.parquet(d)
        return d

    def replace(self, t: dict, segments: list[str]):
        t["segments"] = segments
        t["version"] += 1

    def next_seq(self) -> int:
        self.catalog["seq"] += 1
        return self.catalog["seq"]

    # --- memory

    def log(self) -> DataFrame:
        return self._segments("log", LOG_SCHEMA)

    def links_raw(self) -> DataFrame:
        return self._segments("links", LINK_SCHEMA)

    def _segments(self, kind: str, schema: str) -> DataFrame:
        dirs = self.catalog[kind]
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*dirs)

    def append(self, kind: str, df: DataFrame, merged: Callable[[DataFrame], DataFrame] = lambda df: df):
        """One more segment of the log or the links; many small ones become one, as ``merged`` has it."""
        d = self.new_dir(kind)
        df.write.parquet(d)
        self.catalog[kind].append(d)
        if len(self.catalog[kind]) > MAX_SEGMENTS:
            one = self.new_dir(kind)
            merged(self._segments(kind, LOG_SCHEMA if kind == "log" else LINK_SCHEMA)).write.parquet(one)  # small files are read packed together
            self.catalog[kind] = [one]

    def sweep(self):
        """Deletes older manifests and directories that the newest one, which must be this engine's, does not name."""
        if self._manifests()[-1:] != [self.generation]:
            raise EngineError("another engine has changed the database meanwhile; nothing is deleted")
        c = self.catalog
        named = [*c["log"], *c["links"], *(d for t in c["tables"].values() for d in t["segments"])]
        named += [d for t in c["tables"].values() for x in t["indexes"].values() for d in x["parts"].values()]
        keep = {d.rsplit("/", 1)[1] for d in named}
        fs, p = self._fs(self.path)
        for f in fs.listStatus(p):
            name = f.getPath().getName()
            m = _MANIFEST.fullmatch(name)
            if (m and int(m[1]) < self.generation) or re.fullmatch(r"catalog-[0-9a-f]{32}\.new", name):
                fs.delete(f.getPath(), False)
        for kind in ("tables", "log", "links", "index", "tmp"):
            fs, p = self._fs(f"{self.path}/{kind}")
            if fs.exists(p):
                for f in fs.listStatus(p):
                    if f.getPath().getName() not in keep:
                        fs.delete(f.getPath(), True)
