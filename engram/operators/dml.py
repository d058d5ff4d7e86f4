"""INSERT, UPDATE, DELETE and TRUNCATE on snapshots, set at a time, with constraints and cascades.

A statement computes its new rows, checks every constraint with one query each, and only then swaps segments. Cascades
run to their fixpoint over sets of row ids before anything is applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import memory as M
from ..functions import scalar as S
from ..plans.compiler import ident, names_in, spark_kind
from ..plans.parser import parse_expression
from . import constraints as C

MAX_DEPTH = 256


def is_text(t: dict, column: str) -> bool:
    return next(S.kind_of(c["type"]) == "text" for c in t["columns"] if c["name"].lower() == column.lower())


def named(t: dict, column: str) -> str:
    return next(c["name"] for c in t["columns"] if c["name"].lower() == column.lower())


class Dml:
    def __init__(self, engine):
        self.e, self.spark, self.st = engine, engine.spark, engine.storage

    # --- INSERT

    def default_sql(self, c: dict) -> str:
        d = c["default"]
        if d is None:
            return f"CAST(NULL AS {S.SPARK_TYPES[c['type']]})"
        if "func" in d:
            v = ("uuid()", "text") if d["func"] == "NEWID" else (self.e.clock_sql(), "text")
        else:
            v = S.literal(d["value"])
        return S.store(v, c["name"], c["type"], c["length"])

    def insert(self, t: dict, columns: list[str] | None, source: DataFrame) -> int:
        """source: one column for each target, in order."""
        names = columns or [c["name"] for c in t["columns"]]
        for n in names:
            self.st.column(t, n)
        if len({n.lower() for n in names}) < len(names):
            raise EngineError("a column is listed twice")
        if len(source.columns) != len(names):
            raise EngineError(f"{len(names)} columns but {len(source.columns)} values")
        src = source.toDF(*[f"c{i}" for i in range(len(names))])
        given = {n.lower(): i for i, n in enumerate(names)}
        counter = next((c for c in t["columns"] if c["identity"] and c["name"].lower() not in given), None)
        src = self.numbered(src) if counter is not None else src.withColumn("__i", F.monotonically_increasing_id())
        cols = []
        for c in t["columns"]:
            if c["name"].lower() in given:
                f = src.schema[given[c["name"].lower()]]
                sql = S.store((f.name, spark_kind(f.dataType)), c["name"], c["type"], c["length"])
            elif c["identity"]:
                sql = S.store((f"({c['next']} + __i * {c['identity'][1]})", "int"), c["name"], c["type"], c["length"])
            else:
                sql = self.default_sql(c)
            cols.append(f"{sql} AS {ident(c['phys'])}")
        base = self.st.catalog["next_rid"]
        now = self.e.now()
        cols += [f"CAST({base} + __i AS BIGINT) AS _rid", f"CAST({M.INITIAL} AS DOUBLE) AS _s0", "CAST(0 AS BIGINT) AS _a0", f"CAST({now!r} AS DOUBLE) AS _l0"]
        segment = self.st.write(src.selectExpr(*cols))
        new_t = t | {"segments": [segment]}
        new = self.st.rows(new_t)
        try:
            self.check_rows(t, new, self.st.rows(t))
        except Exception:
            self.st.remove(segment)
            raise
        n, top = new.agg(F.count("*"), F.max("_rid")).first()
        if n:
            if top - base >= n:  # partitions leave gaps between their ids
                physical = self.st.physical(new_t)
                dense = self.numbered(physical.withColumn("__m", F.col("_rid") - base)).withColumn("_rid", F.lit(base) + F.col("__i"))
                gappy, segment = segment, self.st.write(dense.select(*physical.columns))
                self.st.remove(gappy)
            self.st.catalog["next_rid"] = base + n
            if counter is not None:
                counter["next"] += n * counter["identity"][1]
            self.st.replace(t, [*t["segments"], segment])
            t["rows"] += n
        else:
            self.st.remove(segment)
        return n

    def numbered(self, df: DataFrame) -> DataFrame:
        """__i: 0, 1, 2 ... over all partitions in order, without gathering rows: offsets come from counts by partition."""
        fixed = df if "__m" in df.columns else self.st.stage(df.withColumn("__m", F.monotonically_increasing_id()))
        part = F.shiftright("__m", 33)
        w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        offsets = fixed.groupBy(part.alias("p")).count().select("p", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("o"))  # one row for each partition
        return fixed.join(offsets, part == F.col("p")).withColumn("__i", F.col("o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("p", "o", "__m")

    # --- constraints

    def check_rows(self, t: dict, new: DataFrame, old: DataFrame | None, changed: set[str] | None = None, plan: dict | None = None):
        """new rows beside old ones (None: new is the whole table). changed: names of updated columns; only constraints on
        them are looked at. plan: entries that tables will have, as parents."""
        touched = lambda n: changed is None or n.lower() in changed
        C.not_null(new, [c["name"] for c in t["columns"] if c["not_null"] and touched(c["name"])])
        for text in t["checks"]:
            if changed is None or any(touched(n) for n in names_in(parse_expression(text))):
                self.check_condition(t, new, text)
        for c in t["columns"]:
            if (c["primary"] or c["unique"]) and touched(c["name"]):
                C.unique(new, old, c["name"], S.kind_of(c["type"]) == "text", "primary key" if c["primary"] else "unique value")
        for r in t["refs"]:
            if any(touched(c) for c in r["columns"]):
                p = self.st.table(r["table"])
                parent = self.st.rows((plan or {}).get(r["table"].lower(), p))
                if p is t and plan is None:
                    parent = parent.union(new) if old is not None else new
                self.no_orphans(t, new, r, p, parent)

    def check_condition(self, t: dict, rows: DataFrame, text: str):
        cond = self.e.condition(parse_expression(text), t, "__check")
        rows.createOrReplaceTempView("__check_rows")
        bad = self.spark.sql(f"SELECT 1 FROM __check_rows AS __check WHERE NOT coalesce({cond}, true) LIMIT 1").collect()
        if bad:
            raise EngineError(f"CHECK constraint failed: {text}")

    def no_orphans(self, t: dict, new: DataFrame, r: dict, p: dict, parent: DataFrame):
        texts = [is_text(t, c) and is_text(p, x) for c, x in zip(r["columns"], r["targets"], strict=True)]
        child = new.select(*[F.col(ident(named(t, c))).alias(f"k{i}") for i, c in enumerate(r["columns"])])
        keys = parent.select(*[F.col(ident(named(p, x))).alias(f"p{i}") for i, x in enumerate(r["targets"])])
        n = range(len(texts))
        if bad := C.first(C.orphans(child, [f"k{i}" for i in n], keys, [f"p{i}" for i in n], texts)):
            raise EngineError(f"foreign key violation: {tuple(bad)} is not in '{p['name']}'")

    def referencing(self, name: str):
        """(child table, reference) of all foreign keys to a table."""
        for t in self.st.catalog["tables"].values():
            for r in t["refs"]:
                if r["table"].lower() == name.lower():
                    yield t, r

    def children(self, child: dict, r: dict, parent: dict, parents: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """Rows of the child (or of the given rows of it) that refer to any of the parent rows."""
        texts = [is_text(child, c) and is_text(parent, x) for c, x in zip(r["columns"], r["targets"], strict=True)]
        mine = rows if rows is not None else self.st.rows(child)
        keys = parents.select(*[F.col(ident(named(parent, x))).alias(f"p{i}") for i, x in enumerate(r["targets"])])
        cond = C.on_keys(mine, [named(child, c) for c in r["columns"]], keys, [f"p{i}" for i in range(len(texts))], texts)
        return mine.join(keys, cond, "left_semi")

    # --- DELETE

    def delete(self, t: dict, where) -> int:
        doomed = self.st.stage(self.e.matching(t, where).select("_rid"))
        n = doomed.count()
        if not n:
            return 0
        gone = {t["name"].lower(): doomed}
        queue = [(t, doomed)]
        while queue:  # ends: every step removes rows that were there
            p, rids = queue.pop(0)
            lost = self.st.rows(p).join(rids, "_rid", "left_semi")
            for child, r in self.referencing(p["name"]):
                if r["on_delete"] != "CASCADE":
                    continue
                name = child["name"].lower()
                more = self.children(child, r, p, lost).select("_rid")
                if name in gone:
                    more = more.join(gone[name], "_rid", "left_anti")
                more = self.st.stage(more.distinct())
                if C.first(more):
                    gone[name] = gone[name].union(more) if name in gone else more
                    queue.append((child, more))
        for name, rids in gone.items():
            p = self.st.table(name)
            lost = self.st.rows(p).join(rids, "_rid", "left_semi")
            for child, r in self.referencing(name):
                if r["on_delete"] != "CASCADE":
                    left = self.children(child, r, p, lost)
                    if child["name"].lower() in gone:
                        left = left.join(gone[child["name"].lower()], "_rid", "left_anti")
                    if C.first(left.select(F.lit(1))):
                        raise EngineError(f"cannot delete from '{p['name']}': '{child['name']}' still references it")
        every = None
        for name, rids in gone.items():
            p = self.st.table(name)
            hit, rest = self.st.split(p, rids)
            kept = self.st.physical(p | {"segments": hit}).join(rids, "_rid", "left_anti").select(*self.st.schema(p).names)
            self.st.replace(p, [*rest, self.st.write(kept)])
            p["rows"] = self.st.physical(p).count()
            every = rids if every is None else every.union(rids)
        self.e.forget_links(every)
        return n

    def truncate(self, t: dict) -> int:
        for child, _ in self.referencing(t["name"]):
            if child is not t and child["rows"]:
                raise EngineError(f"cannot truncate '{t['name']}': '{child['name']}' references it")
        n = t["rows"]
        if n:
            self.e.forget_links(self.st.physical(t).select("_rid"))
        self.st.replace(t, [])
        t["rows"] = 0
        return n

    # --- UPDATE

    def update(self, t: dict, sets: list[tuple], where) -> int:
        names = [c.lower() for c, _ in sets]
        if len(set(names)) < len(names):
            raise EngineError("a column is assigned twice")
        new_values = {}
        for c, e in sets:
            col = self.st.column(t, c)
            new_values[col["name"]] = S.store(self.e.value(e, t, "__u"), col["name"], col["type"], col["length"])
        cond = "true" if where is None else f"coalesce({self.e.condition(where, t, '__u')}, false)"
        used = [e for _, e in sets] + ([where] if where is not None else [])
        relation = self.e.update_relation(t, used)
        cols = []
        for c in t["columns"]:
            old = f"__u.{ident(c['name'])}"
            new = f"CASE WHEN {cond} THEN {new_values[c['name']]} ELSE {old} END" if c["name"] in new_values else old
            cols.append(f"{new} AS {ident(c['phys'])}")
        cols += [f"__u.{n}" for n in ("_rid", "_s0", "_a0", "_l0")]
        hit = self.st.stage(self.spark.sql(f"SELECT __u._rid FROM {relation} AS __u WHERE {cond}"))
        n = hit.count()
        if not n:
            return 0
        before = self.st.rows(t)
        touched, rest = self.st.split(t, hit)
        part = self.e.update_relation(t | {"segments": touched}, used)
        segment = self.st.write(self.spark.sql(f"SELECT {', '.join(cols)} FROM {part} AS __u"))
        # of each table: its entry as it will be, ids of its changed rows, names of its changed columns
        plan = {t["name"].lower(): (t | {"segments": [*rest, segment]}, hit, set(names))}
        self.cascade_update(t, before.join(hit, "_rid", "left_semi"), set(names), plan)
        coming = {name: nt for name, (nt, _, _) in plan.items()}
        for name, (nt, rids, changed) in plan.items():
            rows = self.st.rows(nt)
            self.check_rows(self.st.table(name), rows.join(rids, "_rid", "left_semi"), rows.join(rids, "_rid", "left_anti"), changed, coming)
        for name, nt in coming.items():
            self.st.replace(self.st.table(name), nt["segments"])
        if not self.e.observer:
            self.e.touch(hit, M.BOOST)
        return n

    def cascade_update(self, t: dict, before: DataFrame, changed: set[str], plan: dict):
        """Carry changed parent keys to the children that follow them; refuse where they don't."""
        queue, steps = [(t, before, changed)], 0
        while queue:
            steps += 1
            if steps > MAX_DEPTH:
                raise EngineError("cascades nest too deep")
            p, old_rows, columns = queue.pop(0)
            after = self.st.rows(plan[p["name"].lower()][0])
            for child, r in list(self.referencing(p["name"])):
                targets = [named(p, x) for x in r["targets"]]
                if not any(x.lower() in columns for x in targets):
                    continue
                old = old_rows.select("_rid", *[F.col(ident(x)).alias(f"o{i}") for i, x in enumerate(targets)])
                new = after.select("_rid", *[F.col(ident(x)).alias(f"n{i}") for i, x in enumerate(targets)])
                moved = old.join(new, "_rid")
                differs = None
                for i in range(len(targets)):
                    d = ~F.col(f"o{i}").eqNullSafe(F.col(f"n{i}"))
                    differs = d if differs is None else differs | d
                moved = self.st.stage(moved.where(differs).drop("_rid"))
                if C.first(moved) is None:
                    continue
                cname = child["name"].lower()
                ct, moved_before, changed_before = plan.get(cname, (child, None, set()))
                rows = self.st.rows(ct)
                cols = [named(child, c) for c in r["columns"]]
                texts = [is_text(child, c) and is_text(p, x) for c, x in zip(r["columns"], r["targets"], strict=True)]
                cond = C.on_keys(rows, cols, moved, [f"o{i}" for i in range(len(cols))], texts)
                if r["on_update"] != "CASCADE":
                    if C.first(rows.join(moved, cond, "left_semi").select(F.lit(1))):
                        raise EngineError(f"cannot change a key of '{p['name']}': '{child['name']}' references it")
                    continue
                affected = self.st.stage(rows.join(moved, cond, "left_semi"))
                joined = rows.join(moved, cond, "left")
                out = []
                for c in child["columns"]:
                    if c["name"] in cols:
                        i = cols.index(c["name"])
                        out.append(F.when(F.col("o0").isNotNull(), F.col(f"n{i}")).otherwise(rows[ident(c["name"])]).alias(c["phys"]))
                    else:
                        out.append(rows[ident(c["name"])].alias(c["phys"]))
                out += [rows[x] for x in ("_rid", "_s0", "_a0", "_l0")]
                rids = affected.select("_rid")
                if moved_before is not None:
                    rids = rids.union(moved_before).distinct()
                plan[cname] = child | {"segments": [self.st.write(joined.select(*out))]}, rids, changed_before | {c.lower() for c in cols}
                queue.append((child, affected, {c.lower() for c in cols}))
