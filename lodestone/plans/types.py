"""T-SQL types as short strings, their precedence, and their Spark counterparts."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: From the highest precedence to the lowest.
PRECEDENCE = (
    "sql_variant datetimeoffset datetime2 datetime smalldatetime date time float real decimal money smallmoney bigint int smallint tinyint bit "
    "ntext text image rowversion uniqueidentifier nvarchar nchar varchar char varbinary binary"
).split()
INTEGERS = ("bigint", "int", "smallint", "tinyint")
STRINGS = ("string", "nvarchar", "nchar", "varchar", "char", "ntext", "text", "uniqueidentifier", "xml")
DATES = ("date", "datetime", "datetime2", "smalldatetime", "datetimeoffset")
_SPARK = {
    "bit": "boolean", "tinyint": "smallint", "smallint": "smallint", "int": "int", "bigint": "bigint", "money": "decimal(19,4)", "smallmoney": "decimal(10,4)",
    "float": "double", "real": "float", "date": "date", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz", "smalldatetime": "timestamp_ntz",
    "datetimeoffset": "timestamp", "time": "string", "binary": "binary", "varbinary": "binary", "image": "binary", "rowversion": "binary", "sql_variant": "string",
}


def base(kind: str | None) -> str | None:
    if kind is None:
        return None
    name = kind.split("(")[0]
    return "decimal" if name in ("numeric", "dec") else "string" if name in STRINGS else name


def spark_type(kind: str) -> str:
    name = kind.split("(")[0].lower()
    if name in ("decimal", "numeric", "dec"):
        inner = re.findall(r"\d+", kind)
        return f"decimal({inner[0] if inner else 18},{inner[1] if len(inner) > 1 else 0})"
    if name in STRINGS:
        return "string"
    if name not in _SPARK:
        raise ValueError(kind)
    return _SPARK[name]


def of_spark(kind: T.DataType) -> str | None:
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision},{kind.scale})"
    names = {
        T.BooleanType: "bit", T.ByteType: "smallint", T.ShortType: "smallint", T.IntegerType: "int", T.LongType: "bigint", T.DoubleType: "float",
        T.FloatType: "real", T.StringType: "string", T.DateType: "date", T.TimestampType: "datetimeoffset", T.TimestampNTZType: "datetime2", T.BinaryType: "binary",
    }
    return names.get(type(kind))


def rank(kind: str | None) -> int:
    name = base(kind)
    name = "nvarchar" if name == "string" else name
    return PRECEDENCE.index(name) if name in PRECEDENCE else len(PRECEDENCE)


def _scale(kind: str) -> tuple[int, int]:
    name = base(kind)
    if name == "decimal":
        inner = [int(x) for x in re.findall(r"\d+", kind)]
        return (inner + [18, 0])[:2] if len(inner) > 1 else ((inner or [18])[0], 0)
    return {"bigint": (19, 0), "int": (10, 0), "smallint": (5, 0), "tinyint": (3, 0), "bit": (1, 0), "money": (19, 4), "smallmoney": (10, 4)}.get(name, (38, 6))


def common(a: str | None, b: str | None) -> str | None:
    """The type that two operands meet in: the higher precedence; NULL adopts the other side's."""
    if a in (None, "null"):
        return b
    if b in (None, "null"):
        return a
    if base(a) == "decimal" and base(b) in ("decimal", *INTEGERS, "bit") or base(b) == "decimal" and base(a) in (*INTEGERS, "bit"):
        (p, s), (q, t) = _scale(a), _scale(b)
        scale = max(s, t)
        return f"decimal({min(38, max(p - s, q - t) + scale)},{scale})"
    return a if rank(a) <= rank(b) else b


def arithmetic(op: str, a: str | None, b: str | None) -> str | None:
    kind = common(a, b)
    if base(kind) == "decimal":
        (p, s), (q, t) = _scale(a), _scale(b)
        if op in "+-":
            scale = max(s, t)
            precision = max(p - s, q - t) + scale + 1
        elif op == "*":
            scale, precision = s + t, p + q + 1
        elif op == "/":
            scale = max(6, s + q + 1)
            precision = p - s + t + scale
        else:
            scale = max(s, t)
            precision = min(p - s, q - t) + scale
        return f"decimal({min(precision, 38)},{min(scale, 38)})"
    return "int" if kind == "bit" else kind
