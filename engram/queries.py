"""Registered queries for the operators of the dialect, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import memory as M
from .operators import constraints as C
from .operators import memory as OM

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: A fixed clock for the memory queries, in seconds: some days after the last event.
NOW = 1_735_689_600.0


def engine(spark: SparkSession, sf_dir: str, tables: str = "", semantics: str = "binary", **kw) -> Engine:
    e = Engine(spark, observer=True, string_semantics=semantics, **kw)
    e.register_parquet(sf_dir, *tables.split())
    return e


def dialect(name: str, tables: str, sql: str, oracle: str | None = None, semantics: str = "binary"):
    """A query in the dialect over registered tables; without an oracle of its own, the same text is the oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, tables, semantics).sql(sql)

    QUERIES[name] = run
    ORACLE[name] = oracle if oracle is not None else sql


def native(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


# --- scans

dialect("scan_nation", "nation", "SELECT * FROM nation")
dialect("scan_events", "events", "SELECT event_id, user_id, event_type, value FROM events")
dialect("select_no_from", "", "SELECT 2 + 3 * 4 AS a, 7 % 3 AS b, 7 / 2 AS c, -7 % 3 AS d, 2.5 * 2 AS e", "SELECT 14::BIGINT AS a, 1 AS b, 3.5::DOUBLE AS c, -1 AS d, 5.0::DOUBLE AS e")
dialect("point_lookup_order", "orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 77")

# --- projection, filters, expressions

dialect("projection_expr", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity * 2 AS twice FROM lineitem")
dialect(
    "filter_and_or_not", "lineitem",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 AND NOT l_returnflag = 'N') OR (l_discount = 0.1 AND l_tax < 0.02)",
)
dialect(
    "filter_null_logic", "orders",
    "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS st FROM orders WHERE NOT (NULLIF(o_orderstatus, 'F') = 'O') OR NULLIF(o_orderstatus, 'F') IS NULL AND o_totalprice > 300000",
)
dialect("filter_is_not_null", "orders", "SELECT COUNT(*) AS n FROM orders WHERE NULLIF(o_orderstatus, 'F') IS NOT NULL")
dialect("filter_between", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
dialect("filter_not_between", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 2 AND 49")
dialect("filter_in_list", "customer", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
dialect("filter_not_in_list", "customer", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3, 20)")
dialect("filter_like", "part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%A%1_'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%1_'", "fold")
dialect("filter_not_like", "part", "SELECT p_partkey FROM part WHERE p_type NOT LIKE 's%'", "SELECT p_partkey FROM part WHERE p_type NOT ILIKE 's%'", "fold")
dialect(
    "filter_like_escape", "part", "SELECT p_partkey FROM part WHERE p_brand + '%' + p_type LIKE '%!%S%' ESCAPE '!'",
    "SELECT p_partkey FROM part WHERE p_brand || '%' || p_type ILIKE '%!%S%' ESCAPE '!'", "fold",
)
dialect("filter_case_insensitive", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'building'", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'", "fold")
dialect("text_concat_plus", "part", "SELECT p_partkey, p_brand + '-' + p_type AS t, p_name + p_size AS u FROM part", "SELECT p_partkey, p_brand || '-' || p_type AS t, p_name || p_size AS u FROM part")
dialect("compare_numeric_text", "part", "SELECT p_partkey, p_size FROM part WHERE p_size > '10'", "SELECT p_partkey, p_size FROM part WHERE p_size > CAST('10' AS DOUBLE)")
dialect("unary_minus", "customer", "SELECT c_custkey, -c_acctbal AS neg FROM customer WHERE -c_nationkey < -20")
dialect(
    "case_simple", "orders",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS st FROM orders",
)
dialect(
    "case_searched", "orders",
    "SELECT CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' END AS band, COUNT(*) AS n FROM orders GROUP BY CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' END",
)

# --- subqueries

dialect("in_subquery", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
dialect("not_in_subquery", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
dialect("exists_correlated", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE orders.o_custkey = customer.c_custkey AND o_orderstatus = 'P')")
dialect("not_exists_correlated", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE orders.o_custkey = customer.c_custkey)")
dialect("any_subquery", "part", "SELECT p_partkey FROM part WHERE p_size < ANY (SELECT p_size FROM part WHERE p_size > 40) AND p_size >= ANY (SELECT p_size FROM part WHERE p_size > 45)")
dialect("all_subquery", "part", "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size < 25)")
dialect("all_empty_subquery", "part", "SELECT COUNT(*) AS n FROM part WHERE p_size > ALL (SELECT p_size FROM part WHERE p_size < 0)")
dialect("scalar_subquery", "part", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)")
dialect(
    "scalar_correlated", "customer orders",
    "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE orders.o_custkey = customer.c_custkey) AS n FROM customer WHERE c_nationkey < 5",
)
dialect("derived_table", "orders", "SELECT t.k, t.p FROM (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'P') AS t WHERE t.p < 100000")
dialect("derived_table_agg", "orders", "SELECT t.n, COUNT(*) AS c FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS t GROUP BY t.n")


@native("view_expand", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2")
def view_expand(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.run("CREATE VIEW americas AS SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
    return e.sql("SELECT * FROM americas WHERE n_nationkey > 2")


# --- joins

dialect("join_inner", "nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
dialect("join_left", "customer orders", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
dialect("join_theta", "nation region", "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey AND n.n_nationkey > 10")
dialect(
    "join_multi", "region nation customer orders",
    "SELECT r_name, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
dialect("join_left_anti_idiom", "customer orders", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
dialect("join_star", "nation region", "SELECT r.*, n.n_name FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey < 8")
dialect("join_global_agg", "customer orders", "SELECT COUNT(*) AS n, MAX(o_totalprice) AS peak FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
dialect("join_group_agg", "customer orders", "SELECT c_mktsegment, COUNT(*) AS n, ROUND(AVG(o_totalprice), 2) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment HAVING COUNT(*) > 10")
dialect("join_derived", "orders lineitem", "SELECT o_orderstatus, SUM(t.n) AS n FROM orders JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey) AS t ON o_orderkey = t.l_orderkey GROUP BY o_orderstatus",
        "SELECT o_orderstatus, CAST(SUM(t.n) AS BIGINT) AS n FROM orders JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey) AS t ON o_orderkey = t.l_orderkey GROUP BY o_orderstatus")

# --- aggregates

dialect(
    "agg_global", "lineitem", "SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, ROUND(AVG(l_quantity), 6) AS a, MIN(l_shipdate) AS lo, MAX(l_returnflag) AS hi FROM lineitem",
    "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, ROUND(AVG(l_quantity), 6) AS a, MIN(l_shipdate) AS lo, MAX(l_returnflag) AS hi FROM lineitem",
)
dialect(
    "agg_empty", "orders", "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, AVG(o_totalprice) AS a, MIN(o_orderstatus) AS lo FROM orders WHERE o_orderkey < 0",
    "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, AVG(o_totalprice) AS a, MIN(o_orderstatus) AS lo FROM orders WHERE o_orderkey < 0",
)
dialect(
    "agg_group", "lineitem",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_extendedprice), 2) AS price FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
)
dialect("agg_group_expr", "orders", "SELECT o_custkey % 10 AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10")
dialect("agg_having", "orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 100000")
dialect("agg_having_global", "orders", "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 100")
dialect("agg_count_column", "orders", "SELECT COUNT(NULLIF(o_orderstatus, 'F')) AS n, COUNT(*) AS total FROM orders")
dialect("agg_distinct", "orders", "SELECT COUNT(DISTINCT o_custkey) AS n, COUNT(DISTINCT o_orderpriority) AS p FROM orders")
dialect("agg_distinct_fold", "part", "SELECT COUNT(DISTINCT CASE WHEN p_size > 20 THEN UPPER(p_type) ELSE LOWER(p_type) END) AS n, MIN(p_type) AS lo FROM part", "SELECT COUNT(DISTINCT lower(p_type)) AS n, MIN(p_type) AS lo FROM part", "fold")
dialect("agg_sum_distinct", "part", "SELECT SUM(DISTINCT p_size) AS s, ROUND(AVG(DISTINCT p_size), 6) AS a FROM part", "SELECT CAST(SUM(DISTINCT p_size) AS BIGINT) AS s, ROUND(AVG(DISTINCT p_size), 6) AS a FROM part")
dialect("agg_expr_over_agg", "lineitem", "SELECT l_returnflag, ROUND(SUM(l_extendedprice) / COUNT(*), 2) AS mean, MAX(l_linenumber) - MIN(l_linenumber) AS spread FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, ROUND(SUM(l_extendedprice) / COUNT(*), 2) AS mean, CAST(MAX(l_linenumber) - MIN(l_linenumber) AS BIGINT) AS spread FROM lineitem GROUP BY l_returnflag")

# --- order, limit, distinct, sets

dialect("order_multi_key_top", "orders", "SELECT TOP 20 o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey",
        "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey LIMIT 20")
dialect("limit_offset", "customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15 OFFSET 30")
dialect("order_alias", "part", "SELECT TOP 10 p_partkey, p_retailprice * p_size AS v FROM part ORDER BY v DESC, p_partkey", "SELECT p_partkey, p_retailprice * p_size AS v FROM part ORDER BY v DESC, p_partkey LIMIT 10")
dialect("order_nulls", "orders", "SELECT TOP 30 o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY s, o_orderkey",
        "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY s NULLS FIRST, o_orderkey LIMIT 30")
dialect("distinct_multi", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
dialect("set_union", "nation customer", "SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer WHERE c_nationkey > 3")
dialect("set_union_all", "nation region", "SELECT n_regionkey AS k, n_name AS t FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
dialect("set_intersect", "supplier customer", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 0")
dialect("set_except", "customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
dialect("set_chain_left_assoc", "nation", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 6 UNION SELECT n_regionkey FROM nation INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 2 EXCEPT SELECT 4",
        "((SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 6 UNION SELECT n_regionkey FROM nation) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 2) EXCEPT SELECT 4")
dialect("set_order_limit", "nation region", "SELECT n_name AS t FROM nation UNION SELECT r_name FROM region ORDER BY t DESC LIMIT 7")
dialect("set_union_fold", "region nation", "SELECT LOWER(r_name) AS t FROM region UNION SELECT UPPER(r_name) FROM region INTERSECT SELECT r_name FROM region", "SELECT min(x) AS t FROM (SELECT lower(r_name) AS x FROM region UNION ALL SELECT upper(r_name) FROM region) GROUP BY lower(x)", "fold")

# --- scalar functions

dialect("fn_len", "part", "SELECT p_partkey, LEN(p_name) AS n, DATALENGTH(p_type) AS m FROM part", "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, CAST(strlen(p_type) AS INTEGER) AS m FROM part")
dialect("fn_case", "part", "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l FROM part")
dialect("fn_trim", "part", "SELECT p_partkey, TRIM('  ' + p_name + ' ') AS t, LTRIM('  ' + p_brand) AS l, RTRIM(p_type + '   ') AS r FROM part", "SELECT p_partkey, p_name AS t, p_brand AS l, p_type AS r FROM part")
dialect("fn_substring", "part", "SELECT p_partkey, SUBSTRING(p_name, 3, 5) AS a, SUBSTRING(p_name, 0, 3) AS b, SUBSTRING(p_name, 4) AS c FROM part", "SELECT p_partkey, substring(p_name, 3, 5) AS a, substring(p_name, 1, 2) AS b, substring(p_name, 4) AS c FROM part")
dialect("fn_left_right", "part", "SELECT p_partkey, LEFT(p_name, 4) AS l, RIGHT(p_type, 3) AS r FROM part")
dialect("fn_replace", "part", "SELECT p_partkey, REPLACE(p_type, 'E', '*') AS t FROM part", "SELECT p_partkey, regexp_replace(p_type, 'e', '*', 'gi') AS t FROM part", "fold")
dialect("fn_concat", "part", "SELECT p_partkey, CONCAT(p_brand, '/', p_size) AS t, CONCAT(p_brand, NULLIF(p_size, 1)) AS u FROM part", "SELECT p_partkey, p_brand || '/' || p_size AS t, p_brand || NULLIF(p_size, 1) AS u FROM part")
dialect("fn_reverse", "part", "SELECT p_partkey, REVERSE(p_name) AS t FROM part")
dialect("fn_abs_sign", "customer", "SELECT c_custkey, ABS(c_acctbal) AS a, SIGN(c_acctbal) AS s FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS INTEGER) AS s FROM customer")
dialect("fn_sqrt_power", "part", "SELECT p_partkey, ROUND(SQRT(p_size), 9) AS r, POWER(p_size, 2) AS p FROM part")
dialect("fn_floor_ceil", "customer", "SELECT c_custkey, FLOOR(c_acctbal) AS f, CEILING(c_acctbal) AS c, CEIL(c_nationkey) AS i FROM customer", "SELECT c_custkey, CAST(floor(c_acctbal) AS DOUBLE) AS f, CAST(ceil(c_acctbal) AS DOUBLE) AS c, c_nationkey AS i FROM customer")
dialect("fn_round", "lineitem", "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice) AS a, ROUND(l_discount * 100, 1) AS b FROM lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice) AS a, round(l_discount * 100, 1) AS b FROM lineitem")
dialect(
    "fn_isnull_coalesce_nullif_iif", "orders",
    "SELECT o_orderkey, ISNULL(NULLIF(o_orderstatus, 'F'), 'none') AS a, COALESCE(NULL, NULLIF(o_orderstatus, 'O'), o_orderpriority) AS b, IIF(o_totalprice > 150000, 'big', 'small') AS c FROM orders",
    "SELECT o_orderkey, coalesce(NULLIF(o_orderstatus, 'F'), 'none') AS a, COALESCE(NULL, NULLIF(o_orderstatus, 'O'), o_orderpriority) AS b, CASE WHEN o_totalprice > 150000 THEN 'big' ELSE 'small' END AS c FROM orders",
)
dialect(
    "cast_matrix", "part",
    "SELECT p_partkey, CAST(p_retailprice AS INT) AS i, CAST('3.7' AS INT) AS t, CAST(p_size AS FLOAT) AS f, CAST(p_name AS NVARCHAR(5)) AS s, CAST(p_size AS VARCHAR) AS v, CAST(p_size % 2 AS BIT) AS b FROM part",
    "SELECT p_partkey, CAST(trunc(p_retailprice) AS INTEGER) AS i, 3 AS t, CAST(p_size AS DOUBLE) AS f, left(p_name, 5) AS s, CAST(p_size AS VARCHAR) AS v, p_size % 2 AS b FROM part",
)


@native("fn_newid_getdate", "SELECT r_regionkey, 36 AS n, 19 AS d FROM region")
def fn_newid_getdate(spark, sf_dir):
    return engine(spark, sf_dir, "region").sql("SELECT r_regionkey, LEN(NEWID()) AS n, LEN(GETDATE()) AS d FROM region")


# --- full text

_LEX = "list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: left(lower(w), 63)), lambda w: NOT list_contains(stop, w))"


def _fts(select: str, where: str = "", tail: str = "") -> str:
    from .functions.fulltext import STOP_WORDS

    stop = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
    return f"SELECT {select} FROM (SELECT doc_id, {_LEX} AS v FROM (SELECT doc_id, text, {stop} AS stop FROM documents)) {where} {tail}"


def _has(w: str) -> str:
    return f"list_contains(v, '{w}')"


dialect("fts_match_and", "documents", "SELECT doc_id FROM documents WHERE to_tsvector(text) @@ to_tsquery('tion & thon')", _fts("doc_id", f"WHERE {_has('tion')} AND {_has('thon')}"))
dialect("fts_match_or", "documents", "SELECT doc_id FROM documents WHERE to_tsvector(text) @@ to_tsquery('tion | les & !des')", _fts("doc_id", f"WHERE {_has('tion')} OR ({_has('les')} AND NOT {_has('des')})"))
dialect("fts_match_not", "documents", "SELECT doc_id FROM documents WHERE to_tsvector(text) @@ to_tsquery('!(en | de) & !the')", _fts("doc_id", f"WHERE NOT ({_has('en')} OR {_has('de')})"))
dialect("fts_plainto", "documents", "SELECT doc_id FROM documents WHERE to_tsvector(text) @@ plainto_tsquery('The Tion, en')", _fts("doc_id", f"WHERE {_has('tion')} AND {_has('en')}"))
dialect(
    "fts_rank_topk", "documents",
    "SELECT TOP 25 doc_id, ROUND(ts_rank(to_tsvector(text), to_tsquery('tion | en')), 9) AS r FROM documents WHERE to_tsvector(text) @@ to_tsquery('tion | en') ORDER BY r DESC, doc_id",
    _fts("doc_id, round(list_sum(list_transform(v, lambda w, i: CASE WHEN w = 'tion' OR w = 'en' THEN 1.0::DOUBLE / (1 + i) ELSE 0 END)), 9) AS r", f"WHERE {_has('tion')} OR {_has('en')}", "ORDER BY r DESC, doc_id LIMIT 25"),
)
_VECTOR = """e AS (SELECT doc_id, unnest(v) AS w, generate_subscripts(v, 1) AS p FROM s), g AS (SELECT doc_id, w, min(p) AS f, w || ':' || string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS t FROM e GROUP BY doc_id, w),
x AS (SELECT doc_id, string_agg(t, ' ' ORDER BY f) AS t FROM g GROUP BY doc_id)"""


@native("fts_tsvector", f"WITH s AS ({_fts('doc_id, v')}), {_VECTOR} SELECT s.doc_id, md5(coalesce(x.t, '')) AS vector, CAST(len(coalesce(x.t, '')) AS INTEGER) AS n FROM s LEFT JOIN x ON s.doc_id = x.doc_id")
def fts_tsvector(spark, sf_dir):
    vectors = engine(spark, sf_dir, "documents").sql("SELECT doc_id, to_tsvector(text) AS v FROM documents")
    return vectors.select("doc_id", F.md5("v").alias("vector"), F.length("v").alias("n"))


@native("fts_inverted_index", "SELECT lexeme, count(*) AS docs FROM (" + _fts("doc_id, unnest(list_distinct(v)) AS lexeme") + ") GROUP BY lexeme")
def fts_inverted_index(spark, sf_dir):
    from .functions.fulltext import lexeme_array

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    postings = docs.select("doc_id", F.explode(F.expr(f"array_distinct({lexeme_array('text')})")).alias("lexeme"))
    return postings.groupBy("lexeme").agg(F.count("*").alias("docs"))


# --- associative memory: events are touches of users, one row for each user


def _touches(spark, sf_dir) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(F.col("user_id").alias("_rid"), F.unix_timestamp("ts").cast("double").alias("ts"), F.col("event_id").alias("seq"), F.lit("touch").alias("kind"), F.lit(1.0).alias("boost"))


def _users(spark, sf_dir) -> DataFrame:
    first = _touches(spark, sf_dir).groupBy("_rid").agg(F.min("ts").alias("last0"))
    return first.select("_rid", F.lit(1.0).alias("strength0"), F.lit(0).cast("long").alias("access0"), "last0")


@native("mem_decay", f"SELECT event_id, round(CASE WHEN value * pow(2, -greatest(0, {NOW} - epoch(date_trunc('second', ts))) / 604800.0) < 1e-9 OR value <= 0 THEN 0 ELSE value * pow(2, -greatest(0, {NOW} - epoch(date_trunc('second', ts))) / 604800.0) END, 6) AS s FROM events")
def mem_decay(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select("event_id", F.round(M.decayed(F.col("value"), F.unix_timestamp("ts").cast("double"), F.lit(NOW)), 6).alias("s"))


_FOLD = """WITH t AS (SELECT user_id AS r, epoch(date_trunc('second', ts)) AS ts FROM events), e AS (SELECT r, min(ts) AS t0, max(ts) AS t1, count(*) AS n FROM t GROUP BY r),
s AS (SELECT t.r, sum(pow(2, -(t1 - ts) / 604800.0)) + min(pow(2, -(t1 - t0) / 604800.0)) AS s FROM t JOIN e ON t.r = e.r GROUP BY t.r)"""


@native("mem_strength_fold", _FOLD + " SELECT r AS user_id, round(s, 6) AS strength FROM s")
def mem_strength_fold(spark, sf_dir):
    return OM.fold(_users(spark, sf_dir), _touches(spark, sf_dir)).select(F.col("_rid").alias("user_id"), F.round("strength", 6).alias("strength"))


@native("mem_access_count", "SELECT user_id, count(*) AS accesses, CAST(max(epoch(date_trunc('second', ts))) AS BIGINT) AS last FROM events GROUP BY user_id")
def mem_access_count(spark, sf_dir):
    return OM.fold(_users(spark, sf_dir), _touches(spark, sf_dir)).select(F.col("_rid").alias("user_id"), F.col("access_count").alias("accesses"), F.col("last").cast("long").alias("last"))


@native(
    "mem_remember_forget",
    """WITH t AS (SELECT user_id AS r, event_id AS q, event_type = 'click' AS reset, epoch(date_trunc('second', ts)) AS ts FROM events),
    c AS (SELECT r, max(CASE WHEN reset THEN q END) AS rq, max(ts) AS t1 FROM t GROUP BY r)
    SELECT t.r AS user_id, round(coalesce(sum(CASE WHEN NOT reset AND (rq IS NULL OR q > rq) THEN 3 * pow(2, -(t1 - ts) / 604800.0) END), 0), 6) AS strength FROM t JOIN c ON t.r = c.r GROUP BY t.r""",
)
def mem_remember_forget(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = ev.select(
        F.col("user_id").alias("_rid"), F.unix_timestamp("ts").cast("double").alias("ts"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "click", "reset").otherwise("touch").alias("kind"), F.lit(M.REMEMBER_BOOST).alias("boost"),
    )
    rows = _users(spark, sf_dir).withColumn("strength0", F.lit(0.0))
    return OM.fold(rows, log).select(F.col("_rid").alias("user_id"), F.round("strength", 6).alias("strength"))


def _links(spark, sf_dir) -> DataFrame:
    """Users that act on the same day in the same kind of event are used together."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.to_date("ts").alias("day"), "event_type")
    return OM.co_access(ev, ["day", "event_type"], "user_id", ["event_id"])


_LINKS = """WITH f AS (SELECT * FROM (SELECT user_id, event_type, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY event_id) AS n FROM events) WHERE n <= 12),
m AS (SELECT DISTINCT d, event_type, user_id FROM f), l AS (SELECT x.user_id AS a, y.user_id AS b, least(50.0, count(*) * 0.3) AS w FROM m x JOIN m y ON x.d = y.d AND x.event_type = y.event_type AND x.user_id < y.user_id GROUP BY 1, 2)"""


@native("mem_links", _LINKS + " SELECT a, b, round(CAST(w AS DOUBLE), 6) AS w FROM l")
def mem_links(spark, sf_dir):
    return _links(spark, sf_dir).select("a", "b", F.round("w", 6).alias("w"))


@native("mem_top_links", _LINKS + " SELECT a, b, round(CAST(w AS DOUBLE), 6) AS w FROM l ORDER BY w DESC, a, b LIMIT 20")
def mem_top_links(spark, sf_dir):
    return _links(spark, sf_dir).select("a", "b", F.round("w", 6).alias("w")).orderBy(F.desc("w"), "a", "b").limit(20)


@native("mem_neighbors", _LINKS + " SELECT CASE WHEN a = 7 THEN b ELSE a END AS rid, round(CAST(w AS DOUBLE), 6) AS w FROM l WHERE a = 7 OR b = 7")
def mem_neighbors(spark, sf_dir):
    return OM.neighbours(_links(spark, sf_dir), 7).select("rid", F.round("w", 6).alias("w"))


@native("mem_prune", _LINKS + " SELECT a, b, round(CAST(w / 2 AS DOUBLE), 6) AS w FROM l WHERE w / 2 >= 0.05 AND a <> 7 AND b <> 7")
def mem_prune(spark, sf_dir):
    kept = OM.without(_links(spark, sf_dir), spark.range(7, 8).select(F.col("id").alias("_rid")))
    return OM.prune(kept).select("a", "b", F.round("w", 6).alias("w"))




def _parts(spark, sf_dir) -> DataFrame:
    """Parts as remembered rows: strength and accesses follow from their size."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.withColumns({"_strength": F.col("p_size") / 10.0, "_access": F.col("p_size") % 7})


_PHRASE = "Small stell item"
_TEXTS = ["p_name", "p_type"]


def _recall_sql(select: str, tail: str = "") -> str:
    """The three terms of the phrase: 'small' and 'stell' forgive one typo, 'item' none."""

    def near(col: str, t: str) -> str:
        return f"len(list_filter(regexp_extract_all({col}, '[A-Za-z0-9][A-Za-z0-9_]*'), lambda w: levenshtein(lower(w), '{t}') <= 1)) > 0"

    def one(col: str, t: str) -> str:
        fuzzy = f" WHEN {near(col, t)} THEN 0.8::DOUBLE" if len(t) > 4 else ""
        return f"CASE WHEN contains(lower({col}), '{t}') THEN 1.0::DOUBLE{fuzzy} END"

    lex = " + ".join(f"coalesce({one('p_name', t)}, {one('p_type', t)}, 0)" for t in ("small", "stell", "item"))
    return f"WITH h AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS st, p_size % 7 AS ac, {lex} AS lex FROM part), k AS (SELECT *, 2 * lex + 1.5 * ln(1 + st) + 0.5 * ln(1.0::DOUBLE + ac) AS base FROM h WHERE lex > 0) SELECT {select} FROM k {tail}"


def _hits(spark, sf_dir) -> DataFrame:
    return OM.hits(_parts(spark, sf_dir), _PHRASE, _TEXTS, "p_partkey", F.col("_strength"), F.col("_access"))


@native("recall_lexical", _recall_sql("p_partkey, round(lex, 6) AS lex"))
def recall_lexical(spark, sf_dir):
    return _hits(spark, sf_dir).select("p_partkey", F.round("_lex", 6).alias("lex"))


@native("recall_fuzzy", _recall_sql("p_partkey", "WHERE lex <> floor(lex)"))
def recall_fuzzy(spark, sf_dir):
    return _hits(spark, sf_dir).where(F.col("_lex") != F.floor("_lex")).select("p_partkey")


@native("recall_scored", _recall_sql("p_partkey, round(base, 6) AS score", "ORDER BY round(base, 6) DESC, p_partkey LIMIT 10"))
def recall_scored(spark, sf_dir):
    return _hits(spark, sf_dir).select("p_partkey", F.round("_base", 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(10)


@native(
    "recall_spread",
    _recall_sql("*").replace("SELECT * FROM k", """, l AS (SELECT p_partkey AS a, p_partkey + 3 AS b, 0.6::DOUBLE AS w FROM part), s AS (SELECT a, b, w FROM l UNION ALL SELECT b, a, w FROM l),
    g AS (SELECT s.b AS t, sum(k.lex * w * 0.45) AS gain FROM s JOIN k ON s.a = k.p_partkey GROUP BY s.b)
    SELECT p_partkey, round(base + coalesce(gain, 0), 6) AS score FROM k LEFT JOIN g ON k.p_partkey = g.t"""),
)
def recall_spread(spark, sf_dir):
    links = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 3).alias("b"), F.lit(0.6).alias("w"))
    return OM.spread(_hits(spark, sf_dir), links, "p_partkey").select("p_partkey", F.round("_score", 6).alias("score"))


# --- managed tables


def _managed(spark, sf_dir, tables: str) -> Engine:
    e = engine(spark, sf_dir, tables, clock=lambda: NOW)
    e.run("CREATE TABLE cust (id BIGINT PRIMARY KEY, nation INT, bal FLOAT, seg NVARCHAR(20))")
    return e


_FILL = "INSERT INTO cust (id, nation, bal, seg) SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@native("dml_insert_select", "SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS bal, c_mktsegment AS seg FROM customer")
def dml_insert_select(spark, sf_dir):
    e = _managed(spark, sf_dir, "customer")
    e.run(_FILL)
    return e.sql("SELECT * FROM cust")


@native("dml_update", "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS bal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'built' ELSE c_mktsegment END AS seg FROM customer")
def dml_update(spark, sf_dir):
    e = _managed(spark, sf_dir, "customer")
    e.run(_FILL + "; UPDATE cust SET bal = 0, seg = 'built' WHERE seg = 'BUILDING'")
    return e.sql("SELECT id, bal, seg FROM cust")


@native("dml_delete", "SELECT c_custkey AS id FROM customer WHERE NOT (c_acctbal < 0 OR c_nationkey = 3)")
def dml_delete(spark, sf_dir):
    e = _managed(spark, sf_dir, "customer")
    e.run(_FILL + "; DELETE FROM cust WHERE bal < 0 OR nation = 3")
    return e.sql("SELECT id FROM cust")


@native("dml_truncate", "SELECT CAST(0 AS BIGINT) AS n")
def dml_truncate(spark, sf_dir):
    e = _managed(spark, sf_dir, "customer")
    e.run(_FILL + "; TRUNCATE TABLE cust")
    return e.sql("SELECT COUNT(*) AS n FROM cust")


@native("ddl_alter_add_default", "SELECT c_custkey AS id, 'new' AS status, CAST(NULL AS INTEGER) AS extra FROM customer")
def ddl_alter_add_default(spark, sf_dir):
    e = _managed(spark, sf_dir, "customer")
    e.run(_FILL + "; ALTER TABLE cust ADD status NVARCHAR(10) DEFAULT 'new'; ALTER TABLE cust ADD extra INT; ALTER TABLE cust DROP COLUMN bal; ALTER TABLE cust RENAME COLUMN seg TO segment")
    return e.sql("SELECT id, status, extra FROM cust")


@native("ddl_alter_type", "SELECT CAST(c_custkey AS INTEGER) AS id, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def ddl_alter_type(spark, sf_dir):
    e = _managed(spark, sf_dir, "customer")
    e.run(_FILL + "; ALTER TABLE cust ALTER COLUMN nation NVARCHAR(4); ALTER TABLE cust ALTER COLUMN id TYPE INT")
    return e.sql("SELECT id, nation FROM cust")


@native("txn_rollback", "SELECT count(*) AS n FROM customer")
def txn_rollback(spark, sf_dir):
    e = _managed(spark, sf_dir, "customer")
    e.run(_FILL + "; BEGIN; DELETE FROM cust; BEGIN; TRUNCATE TABLE cust; COMMIT; ROLLBACK")
    return e.sql("SELECT COUNT(*) AS n FROM cust")


@native("identity_default", "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) * 10 AS INTEGER) AS id, 1 AS qty FROM region")
def identity_default(spark, sf_dir):
    e = engine(spark, sf_dir, "region")
    e.run("CREATE TABLE t (id INT IDENTITY(10, 10) PRIMARY KEY, name NVARCHAR(30), qty INT DEFAULT 1); INSERT INTO t (name) SELECT r_name FROM region")
    return e.sql("SELECT id, qty FROM t")


@native("show_tables", "SELECT 'cust' AS \"table\", 4 AS columns, count(*) AS rows, 1.0::DOUBLE AS avg_strength FROM customer")
def show_tables(spark, sf_dir):
    e = _managed(spark, sf_dir, "customer")
    e.run(_FILL)
    return e.sql("SHOW TABLES")


@native("show_memory", "SELECT CASE WHEN c_custkey <= 3 THEN 4.0 ELSE 1.0 END::DOUBLE AS s, count(*) AS n FROM customer GROUP BY 1")
def show_memory(spark, sf_dir):
    e = _managed(spark, sf_dir, "customer")
    e.run(_FILL + "; REMEMBER FROM cust WHERE id <= 3")
    rows = e.sql("SHOW MEMORY FROM cust")
    return rows.groupBy(F.round("_strength", 6).alias("s")).agg(F.count("*").alias("n"))


# --- constraints over whole tables


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@native("constraint_fk_violations", "SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey < 20)")
def constraint_fk_violations(spark, sf_dir):
    parent = _read(spark, sf_dir, "customer").where("c_nationkey < 20").select("c_custkey")
    return C.orphans(_read(spark, sf_dir, "orders"), ["o_custkey"], parent, ["c_custkey"], [False]).select("o_orderkey")


@native("constraint_check_violations", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity < 50 AND l_discount >= 0)")
def constraint_check_violations(spark, sf_dir):
    return C.violations_check(_read(spark, sf_dir, "lineitem"), "l_quantity < 50 AND l_discount >= 0").select("l_orderkey", "l_linenumber")


@native("constraint_unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def constraint_unique_violations(spark, sf_dir):
    return C.duplicates(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.col("count").alias("n"))


@native("fk_cascade_closure", "SELECT (SELECT count(*) FROM customer WHERE c_nationkey >= 3) AS customers, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey >= 3) AS orders")
def fk_cascade_closure(spark, sf_dir):
    e = engine(spark, sf_dir, "nation customer orders")
    e.run(
        "CREATE TABLE nat (id INT PRIMARY KEY, name NVARCHAR(40)); CREATE TABLE cus (id BIGINT PRIMARY KEY, nat INT REFERENCES nat(id) ON DELETE CASCADE); "
        "CREATE TABLE ord (id BIGINT, cus BIGINT REFERENCES cus(id) ON DELETE CASCADE); INSERT INTO nat SELECT n_nationkey, n_name FROM nation; "
        "INSERT INTO cus SELECT c_custkey, c_nationkey FROM customer; INSERT INTO ord SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer); "
        "DELETE FROM nat WHERE id < 3"
    )
    return e.sql("SELECT (SELECT COUNT(*) FROM cus) AS customers, (SELECT COUNT(*) FROM ord) AS orders")


# --- procedures


@native("proc_while_insert", "SELECT CAST(i AS INTEGER) AS n FROM range(1, 11) t(i) WHERE i <> 5")
def proc_while_insert(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.run(
        "CREATE TABLE t (n INT); CREATE PROCEDURE fill (@top INT) AS BEGIN DECLARE @i INT = 0; WHILE @i < @top BEGIN SET @i = @i + 1; IF @i = 5 CONTINUE; INSERT INTO t VALUES (@i); END END; EXEC fill 10"
    )
    return e.sql("SELECT n FROM t")


@native("proc_cursor_sum", "SELECT CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation WHERE n_regionkey = 2")
def proc_cursor_sum(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.run(
        "CREATE PROCEDURE total AS BEGIN DECLARE @k INT; DECLARE @s INT = 0; DECLARE c CURSOR FOR SELECT n_nationkey FROM nation WHERE n_regionkey = 2; OPEN c; FETCH NEXT FROM c INTO @k; "
        "WHILE @@fetch_status = 0 BEGIN SET @s = @s + @k; FETCH NEXT FROM c INTO @k; END CLOSE c; DEALLOCATE c; SELECT CAST(@s AS BIGINT) AS s; END"
    )
    return e.sql("CALL total")


@native("proc_try_catch", "SELECT 'caught: division by zero' AS m")
def proc_try_catch(spark, sf_dir):
    e = engine(spark, sf_dir)
    return e.sql("BEGIN TRY SELECT 1 / 0 AS x; END TRY BEGIN CATCH SELECT CONCAT('caught: ', @@error_message) AS m; END CATCH")


@native("insert_exec", "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey")
def insert_exec(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.run("CREATE TABLE t (k INT, n BIGINT); CREATE PROCEDURE p AS BEGIN SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey; SELECT 1, 2; END; INSERT INTO t EXEC p")
    return e.sql("SELECT k, n FROM t")


# --- statements, one after another on a managed table, and what they leave behind


def _remembering(spark, sf_dir, tables: str, clock=lambda: NOW) -> Engine:
    """An engine that reinforces what it reads, with the customers in a table of its own."""
    e = Engine(spark, string_semantics="binary", clock=clock)
    e.register_parquet(sf_dir, *tables.split())
    e.run("CREATE TABLE cust (id BIGINT PRIMARY KEY, nation INT, bal FLOAT, seg NVARCHAR(20))")
    e.run(_FILL)
    return e


def _watch(e: Engine, sql: str) -> DataFrame:
    """A query that leaves no trace."""
    e.observer = True
    return e.sql(sql)


_STATE = "SELECT id, _rid AS rid, _strength AS s, _access AS a, _access_count AS n, _score AS z FROM cust"


def _state_sql(strength: str, accesses: str) -> str:
    rows = "SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) AS rid, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS g FROM customer"
    return f"SELECT c_custkey AS id, rid, CAST({strength} AS DOUBLE) AS s, CAST({accesses} AS BIGINT) AS a, CAST({accesses} AS BIGINT) AS n, CAST(0 AS DOUBLE) AS z FROM ({rows})"


def stateful(name: str, statements: str, strength: str, accesses: str, tables: str = "customer"):
    """Statements, then strength and accesses of every row."""

    def run(spark, sf_dir):
        e = _remembering(spark, sf_dir, tables)
        for text in filter(None, statements.split(";")):
            e.run(text)
        return _watch(e, _STATE)

    native(name, _state_sql(strength, accesses))(run)


stateful("mem_pseudo_columns", "", "1", "0")
stateful("mem_reinforce_select", "SELECT id FROM cust WHERE nation = 3; SELECT TOP 4 id FROM cust ORDER BY id", "1 + (c_nationkey = 3)::INT + (rid <= 4)::INT", "(c_nationkey = 3)::INT + (rid <= 4)::INT")
stateful("mem_reinforce_groups", "SELECT seg, COUNT(*) FROM cust GROUP BY seg HAVING seg <> 'BUILDING'", "1 + (g <= 12 AND c_mktsegment <> 'BUILDING')::INT", "(g <= 12 AND c_mktsegment <> 'BUILDING')::INT")
stateful("mem_reinforce_join", "SELECT c.id FROM cust c JOIN nation ON nation = n_nationkey WHERE n_regionkey = 1", "1 + (c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))::INT", "(c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))::INT", "customer nation")
stateful("mem_reinforce_update", "UPDATE cust SET bal = 0 WHERE nation < 5", "1 + (c_nationkey < 5)::INT", "(c_nationkey < 5)::INT")
stateful("mem_reinforce_captured", "CREATE TABLE other (id BIGINT); INSERT INTO other SELECT id FROM cust WHERE nation = 7", "1 + (c_nationkey = 7)::INT", "(c_nationkey = 7)::INT")
stateful("mem_statements", "REMEMBER FROM cust WHERE nation = 2; FORGET FROM cust WHERE nation = 4; REMEMBER FROM cust WHERE nation = 4 AND id % 2 = 0",
         "CASE WHEN c_nationkey = 2 THEN 4 WHEN c_nationkey = 4 THEN 3 * (c_custkey % 2 = 0)::INT ELSE 1 END", "(c_nationkey = 2 OR (c_nationkey = 4 AND c_custkey % 2 = 0))::INT")
stateful("mem_distinct_reinforces_nothing", "SELECT DISTINCT seg FROM cust; SELECT COUNT(*) FROM cust", "1", "0")


@native("mem_observer", _state_sql("1", "0"))
def mem_observer(spark, sf_dir):
    e = _managed(spark, sf_dir, "customer")
    e.run(_FILL + "; SELECT * FROM cust; UPDATE cust SET bal = bal + 1")
    return e.sql(_STATE)


@native("mem_clock_and_vacuum", _state_sql("0.25 + 0.5 * (c_nationkey = 3)::INT", "(c_nationkey = 3)::INT"))
def mem_clock_and_vacuum(spark, sf_dir):
    """Two weeks pass; reads after the first; the log is folded in between."""
    now = [NOW]
    e = _remembering(spark, sf_dir, "customer", lambda: now[0])
    now[0] += M.HALF_LIFE
    e.run("SELECT id FROM cust WHERE nation = 3; VACUUM")
    now[0] += M.HALF_LIFE
    return _watch(e, _STATE)


_FIRST = "WITH f AS (SELECT rid, n FROM (SELECT rid, row_number() OVER (ORDER BY rid) AS n FROM (SELECT c_nationkey, row_number() OVER (ORDER BY c_custkey) AS rid FROM customer) WHERE c_nationkey = 3) WHERE n <= 12)"


@native("show_links", _FIRST + " SELECT round(CASE WHEN y.n <= 3 THEN 0.6 ELSE 0.3 END::DOUBLE, 6) AS weight, x.rid AS a, y.rid AS b, 'cust' AS table_a, 'cust' AS table_b FROM f x JOIN f y ON x.rid < y.rid ORDER BY 1 DESC, 2, 3 LIMIT 8")
def show_links(spark, sf_dir):
    e = _remembering(spark, sf_dir, "customer")
    e.run("SELECT id FROM cust WHERE nation = 3 ORDER BY id; SELECT TOP 3 id FROM cust WHERE nation = 3 ORDER BY id")
    return _watch(e, "SHOW LINKS FROM cust TOP 8").select(F.round("weight", 6).alias("weight"), "a", "b", "table_a", "table_b")


@native("vacuum_prunes_links", _FIRST + " SELECT round(0.15::DOUBLE, 6) AS w, count(*) AS n FROM f x JOIN f y ON x.rid < y.rid")
def vacuum_prunes_links(spark, sf_dir):
    """With more links than the cap allows, VACUUM halves them."""
    e = _remembering(spark, sf_dir, "customer")
    e.run("SELECT id FROM cust WHERE nation = 3 ORDER BY id")
    cap, M.LINK_CAP = M.LINK_CAP, 10
    try:
        e.run("VACUUM")
    finally:
        M.LINK_CAP = cap
    return e.links().groupBy(F.round("w", 6).alias("w")).agg(F.count("*").alias("n"))


def _parts_engine(spark, sf_dir) -> Engine:
    e = Engine(spark, string_semantics="binary", clock=lambda: NOW)
    e.register_parquet(sf_dir, "part")
    e.run("CREATE TABLE parts (name NVARCHAR(99), kind NVARCHAR(99)); INSERT INTO parts SELECT p_name, p_type FROM part")
    return e


_RECALLED = _recall_sql("rid, score", "").replace("p_size / 10.0::DOUBLE AS st, p_size % 7 AS ac", "1.0::DOUBLE AS st, 0 AS ac, row_number() OVER (ORDER BY p_partkey) AS rid").replace(
    "SELECT rid, score FROM k", ", top AS (SELECT rid, round(base, 6) AS score FROM k ORDER BY round(base, 6) DESC, rid LIMIT 10)")


@native("recall_statement", _RECALLED + " SELECT rid, score FROM top")
def recall_statement(spark, sf_dir):
    return _parts_engine(spark, sf_dir).sql(f"RECALL '{_PHRASE}' FROM parts").select(F.col("_rid").alias("rid"), F.round("score", 6).alias("score"))


@native("recall_reinforces", _RECALLED + " SELECT rid, 2.5::DOUBLE AS s, round(9 * 0.3::DOUBLE, 6) AS w FROM top")
def recall_reinforces(spark, sf_dir):
    """What was recalled is stronger, and linked with what was recalled beside it."""
    e = _parts_engine(spark, sf_dir)
    e.run(f"RECALL '{_PHRASE}' FROM parts")
    strong = _watch(e, "SELECT _rid AS rid, _strength AS s FROM parts WHERE _strength > 1")
    weights = OM.both_ways(e.links()).groupBy(F.col("a").alias("rid")).agg(F.round(F.sum("w"), 6).alias("w"))
    return strong.join(weights, "rid")


# --- text index


@native(
    "gin_lookup",
    "WITH m AS (" + _fts("doc_id, v") + f") SELECT doc_id AS id FROM m WHERE doc_id % 5 NOT IN (1, 2) AND {_has('tion')} AND {_has('en')} UNION ALL SELECT doc_id FROM documents WHERE doc_id % 5 = 2 UNION ALL SELECT 99000000",
)
def gin_lookup(spark, sf_dir):
    """An index, changes of the table after it, and a query that goes through it."""
    e = engine(spark, sf_dir, "documents", clock=lambda: NOW)
    e.run("CREATE TABLE d (id BIGINT, body NVARCHAR(MAX)); INSERT INTO d SELECT doc_id, text FROM documents; CREATE INDEX words ON d (body) USING GIN")
    e.run("DELETE FROM d WHERE id % 5 = 1; UPDATE d SET body = 'only tion, en' WHERE id % 5 = 2; INSERT INTO d VALUES (99000000, 'En tion'), (99000001, 'en')")
    asked = "SELECT id FROM d WHERE to_tsvector(body) @@ to_tsquery('tion & en')"
    assert "lexeme" in e.sql(f"EXPLAIN {asked}").first()[0]
    return e.sql(asked)


@native("gin_dropped", "SELECT doc_id AS id FROM (" + _fts("doc_id, v") + f") WHERE {_has('tion')}")
def gin_dropped(spark, sf_dir):
    e = engine(spark, sf_dir, "documents", clock=lambda: NOW)
    e.run("CREATE TABLE d (id BIGINT, body NVARCHAR(MAX)); INSERT INTO d SELECT doc_id, text FROM documents; CREATE INDEX words ON d (body) USING GIN; DROP INDEX words ON d")
    return e.sql("SELECT id FROM d WHERE to_tsvector(body) @@ 'tion'")


# --- names, order, comments, casts

dialect("auto_labels", "nation", "SELECT n_nationkey + 1, UPPER(n_name), 5, CAST(n_regionkey AS FLOAT), CASE WHEN n_regionkey = 1 THEN 2 END FROM nation",
        "SELECT n_nationkey + 1 AS expr, upper(n_name) AS \"UPPER(n_name)\", 5 AS value, CAST(n_regionkey AS DOUBLE) AS \"cast\", CASE WHEN n_regionkey = 1 THEN 2 END AS \"case\" FROM nation")
dialect("order_position", "nation", "SELECT n_name, n_regionkey FROM nation ORDER BY 2 DESC, 1 LIMIT 9")
dialect("offset_only", "nation", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 4")
dialect("all_any_equality", "part", "SELECT p_partkey FROM part WHERE p_size = ALL (SELECT 7) OR (p_size <> ANY (SELECT 7) AND p_size <> ALL (SELECT p_size FROM part WHERE p_size < 40))",
        "SELECT p_partkey FROM part WHERE p_size = 7 OR (p_size <> 7 AND p_size NOT IN (SELECT p_size FROM part WHERE p_size < 40))")
dialect("comments_and_quoted_names", "nation", "-- names\nSELECT /* in\ntwo lines */ [n_name] AS \"The Name\", n_regionkey AS [select] FROM \"nation\" WHERE [n_nationkey] < 5 -- end",
        "SELECT n_name AS \"The Name\", n_regionkey AS \"select\" FROM nation WHERE n_nationkey < 5")
dialect("cast_datetime_uuid", "orders", "SELECT o_orderkey, CAST('2024-02-29 12:30:00' AS DATETIME) AS d, CAST('6b29fc40-ca47-1067-b31d-00dd010662da' AS UNIQUEIDENTIFIER) AS u FROM orders WHERE o_orderkey < 50",
        "SELECT o_orderkey, '2024-02-29 12:30:00' AS d, '6b29fc40-ca47-1067-b31d-00dd010662da' AS u FROM orders WHERE o_orderkey < 50")
dialect("clock_functions", "region", "SELECT r_regionkey, LEN(CURRENT_TIMESTAMP) AS a, LEN(SYSDATETIME()) AS b, IIF(GETDATE() > '2020', 1, 0) AS c FROM region", "SELECT r_regionkey, 19 AS a, 19 AS b, 1 AS c FROM region")


# --- definitions and transactions


@native("ddl_rename_read_back", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING'")
def ddl_rename_read_back(spark, sf_dir):
    e = _managed(spark, sf_dir, "customer")
    e.run(_FILL + "; ALTER TABLE cust RENAME COLUMN seg TO segment")
    return e.sql("SELECT id, segment FROM cust WHERE segment = 'BUILDING'")


@native("vacuum", "SELECT count(*) AS n, round(sum(CASE WHEN c_nationkey = 2 THEN 1 ELSE c_acctbal END), 2) AS s, 1 AS segments FROM customer WHERE c_nationkey <> 3")
def vacuum(spark, sf_dir):
    e = _managed(spark, sf_dir, "customer")
    e.run(_FILL + "; DELETE FROM cust WHERE nation = 3; UPDATE cust SET bal = 1 WHERE nation = 2; CHECKPOINT; VACUUM")
    return e.sql("SELECT COUNT(*) AS n, ROUND(SUM(bal), 2) AS s FROM cust").withColumn("segments", F.lit(len(e.storage.table("cust")["segments"])))


@native("txn_commit_reopen", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS gone FROM customer WHERE c_nationkey <> 3")
def txn_commit_reopen(spark, sf_dir):
    """What was committed is there for the next engine; what was not is not."""
    e = _managed(spark, sf_dir, "customer")
    e.run(_FILL + "; BEGIN; DELETE FROM cust WHERE nation = 3; COMMIT; BEGIN; TRUNCATE TABLE cust; CREATE TABLE draft (x INT)")
    again = Engine(spark, e.storage.path, observer=True, clock=lambda: NOW)
    assert "draft" not in again.storage.catalog["tables"]
    return again.sql("SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM cust WHERE nation = 3) AS gone FROM cust")


def messages(name: str, texts: list[str], want: list[str], tables: str = "nation", setup: str = ""):
    """What statements answer, errors included."""

    def run(spark, sf_dir):
        e = engine(spark, sf_dir, tables, clock=lambda: NOW)
        if setup:
            e.run(setup)
        e.on_error = "continue"
        said = [(i, e.run(t)[-1].message) for i, t in enumerate(texts)]
        return spark.createDataFrame(said, "i int, said string").coalesce(1)

    values = ", ".join(f"({i}, '{w.replace(chr(39), chr(39) * 2)}')" for i, w in enumerate(want))
    native(name, f"SELECT CAST(i AS INTEGER) AS i, said FROM (VALUES {values}) AS t(i, said)")(run)


_WRONG = ["SELECT SUM(COUNT(*)) FROM nation", "SELECT n_name FROM nation WHERE COUNT(*) > 1", "SELECT * FROM nation GROUP BY n_regionkey", "SELECT 1 UNION SELECT 1, 2", "SELECT x FROM nation", "SELECT n_name FROM nowhere",
          "CREATE PROCEDURE deep AS EXEC deep; EXEC deep", "DECLARE @x INT", "SELECT LEN('a', 'b')"]
_ERRORS = ["error: an aggregate can't be inside of another", "error: WHERE can't have aggregates, use HAVING", "error: SELECT * can't be grouped", "error: UNION needs as many columns on both sides: 1 and 2",
           "error: no column 'x'", "error: unknown table 'nowhere'", "error: procedure call depth exceeded", "error: unrecognised statement near 'DECLARE'", "error: LEN takes 1 arguments, not 2"]
messages("ddl_messages",
         ["CREATE TABLE a (x INT)", "INSERT INTO a VALUES (1), (2)", "DELETE FROM a WHERE x = 1", "CREATE VIEW v AS SELECT x FROM a", "DROP VIEW v", "DROP VIEW IF EXISTS v", "CREATE PROCEDURE p AS PRINT 6 * 7", "CALL p",
          "DROP PROCEDURE p", "DROP TABLE a", "DROP TABLE IF EXISTS a", "PRINT 'a' + 'b'", "CHECKPOINT"],
         ["table 'a' created", "(2 rows inserted)", "(1 row deleted)", "view 'v' created", "view 'v' dropped", "no view 'v'", "procedure 'p' created", "42", "procedure 'p' dropped", "table 'a' dropped", "no table 'a'", "ab",
          "checkpoint complete"])
messages("error_rules", _WRONG, _ERRORS)


# --- procedures, dynamic SQL, scripts


@native("proc_return_code", "SELECT count(*) AS n FROM nation WHERE n_regionkey = 2")
def proc_return_code(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.run("CREATE PROCEDURE region_of (@k INT) AS BEGIN IF @k > 4 RETURN 4; RETURN @k + 1; END; CREATE PROCEDURE counted AS BEGIN DECLARE @r INT; EXEC @r = region_of 1; SELECT COUNT(*) AS n FROM nation WHERE n_regionkey = @r; END")
    return e.sql("CALL counted")


@native("proc_dynamic_sql", "SELECT n_regionkey AS k, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey")
def proc_dynamic_sql(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.run("CREATE PROCEDURE ask (@t NVARCHAR(20), @least INT) AS BEGIN DECLARE @q NVARCHAR(200) = 'SELECT n_regionkey AS k, COUNT(*) AS n FROM ' + @t + ' WHERE n_nationkey > @least GROUP BY n_regionkey'; EXEC (@q); END")
    return e.sql("EXEC ask 'nation', 3")


def _lines(spark, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.splitlines())), "i int, line string").coalesce(1)


_GRID = "SELECT CAST(i AS INTEGER) AS i, line FROM (SELECT 0 AS i, 'r_regionkey  r_name' AS line UNION ALL SELECT 1, '-----------  ' || repeat('-', (SELECT max(length(r_name)) FROM region)::INT) UNION ALL SELECT 2 + r_regionkey, rpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || '  ' || r_name FROM region UNION ALL SELECT 7, '(5 rows)')"


@native("text_grid", _GRID)
def text_grid(spark, sf_dir):
    e = engine(spark, sf_dir, "region")
    return _lines(spark, e.show(e.sql("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey")))


@native("shell_script", _GRID)
def shell_script(spark, sf_dir):
    """The same grid through the shell, its statement spread over lines."""
    import io

    from .__main__ import shell

    out = io.StringIO()
    shell(engine(spark, sf_dir, "region"), io.StringIO("-- a script\nSELECT r_regionkey,\n r_name FROM region\n ORDER BY r_regionkey;\n.exit\nPRINT 'never';\n"), out)
    lines = [x for x in out.getvalue().splitlines() if x.strip()]
    return _lines(spark, "\n".join(lines[-8:]))


@native("server_rows", "SELECT n_nationkey AS k, n_name AS name, 'true' AS ok FROM nation WHERE n_regionkey < 3")
def server_rows(spark, sf_dir):
    import json

    from .sources.server import Service

    a = Service(engine(spark, sf_dir, "nation"), token="t").handle(json.dumps({"sql": "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey < 3", "token": "t", "observe": "0"}))
    return spark.createDataFrame([(*r, str(a["ok"]).lower()) for r in a["rows"]], f"{a['columns'][0]} int, {a['columns'][1]} string, ok string")


@native("explain_pushes_filters", "SELECT 1 AS pushed, 1 AS pruned")
def explain_pushes_filters(spark, sf_dir):
    plan = engine(spark, sf_dir, "orders").sql("EXPLAIN SELECT o_orderkey FROM orders WHERE o_orderkey = 77").first()[0]
    found = "EqualTo(o_orderkey,77)" in plan, "ReadSchema: struct<o_orderkey:bigint>" in plan
    return spark.createDataFrame([tuple(map(int, found))], "pushed int, pruned int")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["agg_group"](spark, sf_dir)


