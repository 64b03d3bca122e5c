"""The query language: parser, and planner onto DataFrames.

    SELECT documents|blocks|links|tags [WHERE field op value (AND ...)*] [LIMIT n]
    SEARCH fulltext|semantic 'text' [LIMIT n]

Keywords, entities and kinds of search ignore case; fields don't. Values are
UUIDs, strings in single quotes (without escapes) and unsigned integers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from mdlake import schema


class MqlError(ValueError):
    pass


class MqlParseError(MqlError):
    pass


class InvalidNumber(MqlError):
    pass


class InvalidUuid(MqlError):
    pass


class UnknownField(MqlError):
    pass


class TypeMismatch(MqlError):
    pass


@dataclass(frozen=True)
class Uuid:
    value: str


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: str | int | Uuid


@dataclass(frozen=True)
class Select:
    entity: str
    conditions: tuple[Condition, ...] = field(default=())
    limit: int | None = None


@dataclass(frozen=True)
class Search:
    kind: str
    text: str
    limit: int | None = None


_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_OPS = {"=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v}
_FIELDS = {"level": "heading_level", "ordered": "list_ordered"}


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.space()

    def space(self) -> None:
        self.at = re.compile(r"[ \t\r\n]*").match(self.text, self.at).end()

    def take(self, pattern: str, flags: int = 0) -> str | None:
        m = re.compile(pattern, flags).match(self.text, self.at)
        if not m:
            return None
        self.at = m.end()
        self.space()
        return m[0]

    def need(self, pattern: str, what: str, flags: int = 0) -> str:
        found = self.take(pattern, flags)
        if found is None:
            raise MqlParseError(f"{what} expected at {self.text[self.at:self.at + 20]!r}")
        return found


def parse(text: str) -> Select | Search:
    r = _Reader(text)
    if r.take("select", re.I):
        entity = r.need("documents|blocks|links|tags", "an entity", re.I).lower()
        conditions = []
        if r.take("where", re.I):
            conditions.append(_condition(r))
            while r.take("and", re.I):
                conditions.append(_condition(r))
        out: Select | Search = Select(entity, tuple(conditions), _limit(r))
    elif r.take("search", re.I):
        kind = r.need("fulltext|semantic", "fulltext or semantic", re.I).lower()
        out = Search(kind, r.need("'[^']*'", "a quoted text")[1:-1], _limit(r))
    else:
        raise MqlParseError("SELECT or SEARCH expected")
    if r.at < len(r.text):
        raise MqlParseError(f"unexpected {r.text[r.at:r.at + 20]!r}")
    return out


def _condition(r: _Reader) -> Condition:
    name = r.need("[A-Za-z_][A-Za-z0-9_]*", "a field")
    op = r.need("!=|>=|<=|=|>|<", "an operator")
    if (text := r.take(_UUID.pattern)) is not None:
        return Condition(name, op, Uuid(text.lower()))
    if (text := r.take("'[^']*'")) is not None:
        return Condition(name, op, text[1:-1])
    number = int(r.need("[0-9]+", "a value"))
    if number >= 1 << 63:
        raise InvalidNumber(f"{number} is too large")
    return Condition(name, op, number)


def _limit(r: _Reader) -> int | None:
    if not r.take("limit", re.I):
        return None
    number = int(r.need("[0-9]+", "a number"))
    if number >= 1 << 64:
        raise InvalidNumber(f"{number} is too large")
    return number


def predicate(c: Condition, kind: T.StructType) -> Column:
    """A condition on a table. Null compares as in SQL: neither true nor false."""
    name = _FIELDS.get(c.field, c.field)
    if name not in kind.names:
        raise UnknownField(f"no field {c.field}")
    of = kind[name].dataType
    value = c.value.value if isinstance(c.value, Uuid) else c.value
    if isinstance(of, T.StringType) != isinstance(value, str) or isinstance(of, (T.BooleanType, T.TimestampType)):
        raise TypeMismatch(f"{c.field} can't be compared with {value!r}")
    return _OPS[c.op](F.col(name), F.lit(value))


def plan(query: str | Select | Search, tables: Callable[[str], DataFrame], fulltext: Callable[[str, int], DataFrame] | None = None, semantic: Callable[[str, int], DataFrame] | None = None) -> DataFrame:
    """The rows of a query, in a total order of their table."""
    q = parse(query) if isinstance(query, str) else query
    if isinstance(q, Search):
        run, usual = (fulltext, 20) if q.kind == "fulltext" else (semantic, 10)
        if run is None:
            raise MqlError(f"no {q.kind} index")
        return run(q.text, _int(usual if q.limit is None else q.limit))
    rows = tables(q.entity)
    for c in q.conditions:
        rows = rows.where(predicate(c, schema.TABLES[q.entity]))
    rows = rows.orderBy(*schema.ORDER[q.entity])
    return rows if q.limit is None else rows.limit(_int(q.limit))


def _int(limit: Any) -> int:
    return min(int(limit), (1 << 31) - 1)
