"""Errors with SQL Server's numbers."""

from __future__ import annotations


class TSqlError(Exception):
    def __init__(self, message: str, number: int = 50000, severity: int = 16, state: int = 1, line: int = 0):
        super().__init__(message)
        self.message, self.number, self.severity, self.state, self.line = message, number, severity, state, line


def syntax(near: str, line: int = 0) -> TSqlError:
    return TSqlError(f"Incorrect syntax near '{near}'.", 102, 15, line=line)


def unsupported(what: str, line: int = 0) -> TSqlError:
    return TSqlError(f"{what} is not supported.", 40517, 16, line=line)


#: Spark's error classes by SQL Server number.
SPARK_NUMBERS = {
    "DIVIDE_BY_ZERO": 8134, "REMAINDER_BY_ZERO": 8134, "ARITHMETIC_OVERFLOW": 8115, "NUMERIC_VALUE_OUT_OF_RANGE": 8115, "CAST_OVERFLOW": 8115,
    "CAST_INVALID_INPUT": 245, "SCALAR_SUBQUERY_TOO_MANY_ROWS": 512, "TABLE_OR_VIEW_NOT_FOUND": 208, "UNRESOLVED_COLUMN": 207,
    "AMBIGUOUS_REFERENCE": 209, "RECURSION_LEVEL_LIMIT_EXCEEDED": 530, "RECURSION_ROW_LIMIT_EXCEEDED": 530, "MISSING_AGGREGATION": 8120,
}


def translate(error: Exception) -> TSqlError:
    if isinstance(error, TSqlError):
        return error
    text = str(error)
    for name, number in SPARK_NUMBERS.items():
        if name in text:
            return TSqlError(text.splitlines()[0][:2000], number)
    return TSqlError(text.splitlines()[0][:2000] if text else repr(error))
