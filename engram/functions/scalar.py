"""Scalar functions of the dialect as Spark SQL text. A value is (sql, kind); kind is int, float, text, ts, bool, null or other."""

from __future__ import annotations

from ..errors import EngineError

BLANKS = r"' \t\n\r\f\u000b'"  # what TRIM removes

Value = tuple[str, str]


def quote(s: str) -> str:
    """A Spark string literal, safe from the session's variable substitution."""
    body = s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\x00", "\\u0000").replace("${", "\\u0024{")
    return f"'{body}'"


def literal(value) -> Value:
    if value is None:
        return "CAST(NULL AS STRING)", "null"
    if isinstance(value, bool):
        return str(int(value)), "int"
    if isinstance(value, int):
        return (str(value) if -(2**31) <= value < 2**31 else f"{value}L" if value > -(2**63) else "(-9223372036854775807L - 1L)"), "int"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)", "float"
    return quote(str(value)), "text"


def as_text(v: Value) -> str:
    sql, kind = v
    if kind in ("text", "null"):
        return sql
    if kind == "bool":
        return f"CAST(CAST({sql} AS INT) AS STRING)"
    return f"CAST({sql} AS STRING)"


def as_number(v: Value) -> Value:
    """Text must be a whole number or a float, else Spark raises an error."""
    sql, kind = v
    if kind in ("int", "float"):
        return v
    if kind == "bool":
        return f"CAST({sql} AS INT)", "int"
    if kind == "null":
        return "CAST(NULL AS DOUBLE)", "float"
    return f"CAST({sql} AS DOUBLE)", "float"


def as_double(v: Value) -> str:
    sql, kind = as_number(v)
    return sql if kind == "float" else f"CAST({sql} AS DOUBLE)"


def as_int(v: Value) -> str:
    sql, kind = as_number(v)
    return f"CAST({sql} AS INT)"


def as_bool(v: Value) -> str:
    """Truth of a value: null is unknown, 0 and '' are false."""
    sql, kind = v
    if kind == "bool":
        return sql
    if kind == "null":
        return "CAST(NULL AS BOOLEAN)"
    if kind in ("int", "float"):
        return f"({sql} <> 0)"
    return f"({sql} <> '')"


def common(values: list[Value]) -> tuple[list[str], str]:
    """All as one kind."""
    kinds = {k for _, k in values if k != "null"}
    if not kinds:
        return [s for s, _ in values], "null"
    if kinds <= {"int", "bool"}:
        return [s if k == "int" else f"CAST({s} AS INT)" for s, k in values], "int"
    if kinds <= {"int", "float", "bool"}:
        return [as_double(v) for v in values], "float"
    if len(kinds) == 1:
        return [s for s, _ in values], kinds.pop()
    return [as_text(v) for v in values], "text"


def _substring(a: list[Value]) -> Value:
    s, start = as_text(a[0]), as_int(a[1])
    if len(a) == 2:
        return f"substring({s}, greatest({start}, 1))", "text"
    n = as_int(a[2])
    return (
        f"IF({n} < 0, raise_error('SUBSTRING: negative length'), "
        f"IF({n} + least({start} - 1, 0) <= 0, IF({s} IS NULL, NULL, ''), substring({s}, greatest({start}, 1), {n} + least({start} - 1, 0))))"
    ), "text"


def _side(name: str):
    def build(a: list[Value]) -> Value:
        n = as_int(a[1])
        return f"IF({n} < 0, raise_error('{name}: negative length'), {name.lower()}({as_text(a[0])}, {n}))", "text"

    return build


def _replace(a: list[Value]) -> Value:
    s, find, rep = map(as_text, a)
    # without regard to case; an empty text to find leaves the input as it is
    return f"IF({find} = '', {s}, (replace({s} COLLATE UTF8_LCASE, {find}, {rep}) COLLATE UTF8_BINARY))", "text"


def _same(name: str):
    return lambda a: (f"{name}({as_number(a[0])[0]})", as_number(a[0])[1])


def _whole(name: str):
    def build(a: list[Value]) -> Value:
        sql, kind = as_number(a[0])
        return (sql, "int") if kind == "int" else (f"CAST({name}({sql}) AS DOUBLE)", "float")

    return build


def _round(a: list[Value]) -> Value:
    sql, kind = as_number(a[0])
    if len(a) == 1:
        return (sql, "int") if kind == "int" else (f"round({sql}, 0)", "float")
    return f"round({as_double(a[0])}, {as_int(a[1])})", "float"


def _coalesce(a: list[Value]) -> Value:
    sqls, kind = common(a)
    return f"coalesce({', '.join(sqls)})", kind


def _nullif(a: list[Value]) -> Value:
    (x, y), kind = common(a)
    return f"IF({_ci(x, kind)} = {_ci(y, kind)}, NULL, {a[0][0]})", a[0][1]


def _ci(sql: str, kind: str) -> str:
    return f"({sql} COLLATE UTF8_LCASE)" if kind == "text" else sql


def _iif(a: list[Value]) -> Value:
    (x, y), kind = common(a[1:])
    return f"IF(coalesce({as_bool(a[0])}, false), {x}, {y})", kind


def _text(name: str):
    return lambda a: (f"{name}({as_text(a[0])})", "text")


#: name -> (fewest arguments, most arguments, builder)
FUNCTIONS = {
    "LEN": (1, 1, lambda a: (f"char_length({as_text(a[0])})", "int")),
    "DATALENGTH": (1, 1, lambda a: (f"octet_length({as_text(a[0])})", "int")),
    "UPPER": (1, 1, _text("upper")),
    "LOWER": (1, 1, _text("lower")),
    "REVERSE": (1, 1, _text("reverse")),
    "TRIM": (1, 1, lambda a: (f"btrim({as_text(a[0])}, {BLANKS})", "text")),
    "LTRIM": (1, 1, lambda a: (f"ltrim({BLANKS}, {as_text(a[0])})", "text")),
    "RTRIM": (1, 1, lambda a: (f"rtrim({BLANKS}, {as_text(a[0])})", "text")),
    "SUBSTRING": (2, 3, _substring),
    "LEFT": (2, 2, _side("LEFT")),
    "RIGHT": (2, 2, _side("RIGHT")),
    "REPLACE": (3, 3, _replace),
    "CONCAT": (1, 254, lambda a: (f"concat({', '.join(map(as_text, a))})", "text")),
    "ABS": (1, 1, _same("abs")),
    "SIGN": (1, 1, lambda a: (f"CAST(sign({as_number(a[0])[0]}) AS INT)", "int")),
    "SQRT": (1, 1, lambda a: (f"IF({as_double(a[0])} < 0, raise_error('SQRT of a negative number'), sqrt({as_double(a[0])}))", "float")),
    "FLOOR": (1, 1, _whole("floor")),
    "CEILING": (1, 1, _whole("ceil")),
    "CEIL": (1, 1, _whole("ceil")),
    "ROUND": (1, 2, _round),
    "POWER": (2, 2, lambda a: (f"power({as_double(a[0])}, {as_double(a[1])})", "float")),
    "ISNULL": (2, 2, _coalesce),
    "COALESCE": (1, 254, _coalesce),
    "NULLIF": (2, 2, _nullif),
    "IIF": (3, 3, _iif),
    "NEWID": (0, 0, lambda a: ("uuid()", "text")),
}
CLOCK = ("GETDATE", "CURRENT_TIMESTAMP", "SYSDATETIME")
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")

INT_RANGES = {"TINYINT": (0, 255), "SMALLINT": (-(2**15), 2**15 - 1), "INT": (-(2**31), 2**31 - 1), "BIGINT": (-(2**63), 2**63 - 1)}
SPARK_TYPES = {"TINYINT": "smallint", "SMALLINT": "smallint", "INT": "int", "BIGINT": "bigint", "FLOAT": "double", "BIT": "int", "TEXT": "string", "DATETIME": "string", "UUID": "string"}


def kind_of(type_name: str) -> str:
    return "int" if type_name in INT_RANGES or type_name == "BIT" else "float" if type_name == "FLOAT" else "text"


def call(name: str, args: list[Value]) -> Value:
    if name not in FUNCTIONS:
        raise EngineError(f"unknown function '{name}'")
    low, high, build = FUNCTIONS[name]
    if not low <= len(args) <= high:
        raise EngineError(f"{name} takes {low if low == high else f'{low} to {high}'} arguments, not {len(args)}")
    return build(args)


def cast(v: Value, name: str, length: int | None) -> Value:
    """CAST: floats truncate, text must be a number, ranges are checked, text is cut to its length."""
    sql, kind = v
    if name in INT_RANGES:
        low, high = INT_RANGES[name]
        if kind in ("int", "bool"):
            n = f"CAST({sql} AS BIGINT)"
        elif kind == "float":
            n = f"CAST({sql} AS BIGINT)"
        else:
            n = f"coalesce(try_cast({sql} AS BIGINT), CAST(CAST({sql} AS DOUBLE) AS BIGINT))"
        if name != "BIGINT":
            n = f"IF({n} < {low} OR {n} > {high}, raise_error('value out of range for {name}'), {n})"
        return f"CAST({n} AS {SPARK_TYPES[name]})", "int"
    if name == "FLOAT":
        return as_double(v), "float"
    if name == "BIT":
        n, _ = as_number(v)
        return f"IF({n} IN (0, 1), CAST({n} AS INT), IF({n} IS NULL, NULL, raise_error('BIT holds 0 or 1')))", "int"
    text = as_text(v)
    return (f"left({text}, {length})" if length else text), "text"


DATE_PATTERN = r"[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?"
UUID_PATTERN = r"[{]?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}[}]?"


def store(v: Value, column: str, name: str, length: int | None) -> str:
    """The value as it is stored in a column; what does not fit raises an error."""
    sql, kind = v
    spark = SPARK_TYPES[name]
    if kind == "null":
        return f"CAST(NULL AS {spark})"

    def refuse(message: str) -> str:
        return f"raise_error(concat({message}))"

    shown = f"coalesce({as_text(v)}, '')"
    col = quote(column)
    if name in INT_RANGES:
        low, high = INT_RANGES[name]
        if kind == "text":
            d = f"try_cast({sql} AS DOUBLE)"
            bad = refuse(f"'cannot store ', {shown}, ' in ', {col}, ': the text is not a number'")
            n = f"coalesce(try_cast({sql} AS BIGINT), CAST({d} AS BIGINT))"
            whole = f"{d} = floor({d})"
            not_whole = refuse(f"'cannot store ', {shown}, ' in ', {col}, ': not a whole number'")
            checked = f"CASE WHEN {sql} IS NULL THEN NULL WHEN {d} IS NULL THEN {bad} WHEN NOT ({whole}) THEN {not_whole} ELSE {n} END"
        elif kind == "float":
            not_whole = refuse(f"'cannot store ', {shown}, ' in ', {col}, ': not a whole number'")
            checked = f"IF({sql} = floor({sql}) OR {sql} IS NULL, CAST({sql} AS BIGINT), {not_whole})"
        else:
            checked = f"CAST({sql} AS BIGINT)"
        if name != "BIGINT":
            out = refuse(f"{shown}, ' is out of range for ', {col}, ' ({name} holds {low} to {high})'")
            checked = f"IF({checked} NOT BETWEEN {low} AND {high}, {out}, {checked})"
        return f"CAST({checked} AS {spark})"
    if name == "FLOAT":
        if kind != "text":
            return as_double(v)
        bad = refuse(f"'cannot store ', {shown}, ' in ', {col}, ': the text is not a number'")
        return f"CASE WHEN {sql} IS NULL THEN NULL WHEN try_cast({sql} AS DOUBLE) IS NULL THEN {bad} ELSE try_cast({sql} AS DOUBLE) END"
    if name == "BIT":
        bad = refuse(f"'cannot store ', {shown}, ' in BIT column ', {col}, ': expected 0, 1, true or false'")
        if kind == "text":
            return f"CASE WHEN {sql} IS NULL THEN NULL WHEN lower({sql}) IN ('1', 'true') THEN 1 WHEN lower({sql}) IN ('0', 'false') THEN 0 ELSE {bad} END"
        n, _ = as_number(v)
        return f"CASE WHEN {n} IS NULL THEN NULL WHEN {n} IN (0, 1) THEN CAST({n} AS INT) ELSE {bad} END"
    text = as_text(v)
    checks = [f"WHEN {text} IS NULL THEN NULL"]
    if name == "DATETIME":
        good = f"({text} RLIKE '^{DATE_PATTERN}$' AND try_to_timestamp(rpad(replace({text}, 'T', ' '), 19, substring('0000-00-00 00:00:00', char_length({text}) + 1)), 'yyyy-MM-dd HH:mm:ss') IS NOT NULL)"
        checks.append(f"WHEN NOT coalesce({good}, false) THEN {refuse(f"{shown}, ' is not a valid date for ', {col}")}")
    if name == "UUID":
        checks.append(f"WHEN NOT ({text} RLIKE '^{UUID_PATTERN}$') THEN {refuse(f"{shown}, ' is not a UUID for ', {col}")}")
    elif length:
        checks.append(f"WHEN char_length({text}) > {length} THEN {refuse(f"'value for ', {col}, ' is ', char_length({text}), ' characters; the column holds {length}'")}")
    return f"CASE {' '.join(checks)} ELSE {text} END"
