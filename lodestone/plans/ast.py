"""Syntax tree of statements and queries. Expressions are tuples whose first item names their kind:

("lit", type, value) ("col", parts) ("var", name) ("star", qualifier) ("un", op, x) ("bin", op, a, b)
("and", a, b) ("or", a, b) ("not", x) ("null", x, negated) ("between", x, a, b, negated)
("in", x, items or Query, negated) ("like", x, pattern, escape, negated) ("exists", Query)
("case", operand, [(when, then)], else) ("cast", x, type, style, try) ("func", name, args, options)
("sub", Query) ("collate", x, name) ("distinct", a, b, negated) ("contains", col, text)
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Select:
    items: list = field(default_factory=list)  #: (expression, alias, variable, operator)
    distinct: bool = False
    top: tuple | None = None  #: (expression, percent, ties)
    source: list = field(default_factory=list)
    where: tuple | None = None
    group: list = field(default_factory=list)
    grouping: str = ""  #: "", CUBE, ROLLUP
    having: tuple | None = None
    windows: dict = field(default_factory=dict)


@dataclass
class Values:
    rows: list


@dataclass
class SetOp:
    op: str
    left: object
    right: object


@dataclass
class Query:
    body: object  #: Select, SetOp, Values or Query
    ctes: list = field(default_factory=list)  #: (name, columns, Query)
    order: list = field(default_factory=list)  #: (expression, descending)
    offset: tuple | None = None  #: (offset, fetch)
    xml: dict | None = None
    hints: list = field(default_factory=list)


@dataclass
class Table:
    parts: list
    alias: str | None = None


@dataclass
class Derived:
    query: object
    alias: str
    columns: list = field(default_factory=list)


@dataclass
class Function:
    name: str
    args: list
    alias: str | None = None
    schema: list = field(default_factory=list)  #: OPENJSON: (column, type, path, as json)
    options: dict = field(default_factory=dict)


@dataclass
class Join:
    kind: str  #: INNER LEFT RIGHT FULL CROSS, CROSS APPLY, OUTER APPLY
    left: object
    right: object
    on: tuple | None = None
    hint: str = ""


@dataclass
class Statement:
    kind: str
    line: int = 0
    args: dict = field(default_factory=dict)

    def __getattr__(self, name):
        try:
            return self.__dict__["args"][name]
        except KeyError:
            raise AttributeError(name) from None
