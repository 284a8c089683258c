"""A fluent, immutable query builder whose clauses become DataFrame operations.

Every call returns a new Query. Conditions join in a flat chain in which AND binds tighter than OR; group() nests one
chain inside another. Nothing runs before to_df() is acted upon, so Catalyst sees one declarative plan.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$")
FORBIDDEN = re.compile(r"\b(drop|delete|insert|update|create|alter)\b", re.I)
JOINS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "CROSS": "cross", "SEMI": "left_semi", "ANTI": "left_anti"}


def similar_to_regex(pattern: str) -> str:
    """An anchored Java regex for a SQL SIMILAR TO pattern: % and _ are wild cards, | * + ? ( ) [ ] and braces keep
    their meaning, anything else is literal."""
    out = "".join(".*" if c == "%" else "." if c == "_" else "\\" + c if c in ".^$\\" else c for c in pattern)
    return f"^(?s:{out})$"


def _membership(c: Column, values: Iterable[Any], negated: bool) -> Column:
    values = list(values)
    if not values:
        return F.lit(negated)
    return ~c.isin(values) if negated else c.isin(values)


def _pair(values: Any) -> tuple[Any, Any]:
    values = list(values)
    if len(values) != 2:
        raise ValueError("BETWEEN takes exactly two values")
    return values[0], values[1]


PREDICATES: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == F.lit(v),
    "!=": lambda c, v: c != F.lit(v),
    "<>": lambda c, v: c != F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "LIKE": lambda c, v: c.like(v),
    "NOT LIKE": lambda c, v: ~c.like(v),
    "ILIKE": lambda c, v: c.ilike(v),
    "NOT ILIKE": lambda c, v: ~c.ilike(v),
    "IN": lambda c, v: _membership(c, v, False),
    "NOT IN": lambda c, v: _membership(c, v, True),
    "BETWEEN": lambda c, v: c.between(*_pair(v)),
    "NOT BETWEEN": lambda c, v: ~c.between(*_pair(v)),
    "IS NULL": lambda c, v: c.isNull(),
    "IS NOT NULL": lambda c, v: c.isNotNull(),
    "REGEXP": lambda c, v: c.rlike(v),
    "NOT REGEXP": lambda c, v: ~c.rlike(v),
    "RLIKE": lambda c, v: c.rlike(v),
    "SIMILAR TO": lambda c, v: c.rlike(similar_to_regex(v)),
    "NOT SIMILAR TO": lambda c, v: ~c.rlike(similar_to_regex(v)),
}


def predicate(column: Column, operator: str, value: Any = None) -> Column:
    found = PREDICATES.get(" ".join(operator.upper().split()))
    if found is None:
        raise ValueError(f"unknown operator: {operator}")
    return found(column, value)


def literal(value: Any) -> str:
    """value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float, Decimal)):
        return repr(value) if not isinstance(value, Decimal) else str(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def bound(sql: str, params: Mapping[str, Any]) -> str:
    """sql with its :names, outside of quoted strings, replaced by the literals of params."""

    def one(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        if m[1] not in params:
            raise ValueError(f"no value for :{m[1]}")
        return literal(params[m[1]])

    return re.sub(r"'(?:[^'\\]|\\.|'')*'|(?<!:):([A-Za-z_]\w*)", one, sql)


def split_items(text: str) -> list[str]:
    """The parts of text between top-level commas."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def flatten(columns: Iterable[Any]) -> list[str]:
    out: list[str] = []
    for c in columns:
        if c is None:
            continue
        if isinstance(c, (list, tuple)):
            out += flatten(c)
        else:
            out += split_items(str(c))
    return out


def alias_of(item: str) -> tuple[str, str | None]:
    """Expression and alias of a select item."""
    m = re.match(r"^(.*\S)\s+as\s+([A-Za-z_]\w*)$", item, re.I | re.S) or re.match(r"^(.*[\w)\]'\"])\s+([A-Za-z_]\w*)$", item, re.S)
    if m and m[2].lower() not in ("end", "null", "true", "false"):
        return m[1].strip(), m[2]
    return item, None


def checked(name: str) -> str:
    if not NAME.match(name):
        raise ValueError(f"not a column name: {name}")
    return name


@dataclass(frozen=True)
class Conditions:
    """A flat chain of conditions, each with the word that joins it to the one before."""

    items: tuple[tuple[str, Column], ...] = ()

    def add(self, condition: Column, conjunction: str = "AND") -> Conditions:
        return Conditions((*self.items, (conjunction, condition)))

    def where(self, column: str | Mapping[str, Any], operator: str | None = None, value: Any = None) -> Conditions:
        out = self
        for c in _conditions(column, operator, value):
            out = out.add(c)
        return out

    def or_where(self, column: str | Mapping[str, Any], operator: str | None = None, value: Any = None) -> Conditions:
        """A mapping's items are joined by OR into one group, which itself is joined by AND."""
        conditions = _conditions(column, operator, value)
        if isinstance(column, Mapping):
            group = Conditions(tuple(("OR", c) for c in conditions)).column()
            return self if group is None else self.add(group)
        return self.add(conditions[0], "OR")

    def group(self, build: Callable[[Conditions], Conditions], conjunction: str = "AND") -> Conditions:
        inner = build(Conditions()).column()
        return self if inner is None else self.add(inner, conjunction)

    def column(self) -> Column | None:
        """An OR of ANDs; the first item's conjunction has no meaning."""
        runs: list[Column] = []
        for i, (conjunction, c) in enumerate(self.items):
            if i and conjunction == "AND":
                runs[-1] = runs[-1] & c
            else:
                runs.append(c)
        out: Column | None = None
        for r in runs:
            out = r if out is None else out | r
        return out


def _conditions(column: str | Mapping[str, Any], operator: str | None, value: Any) -> list[Column]:
    if isinstance(column, Mapping):
        pairs = [(k, v[0], v[1]) if isinstance(v, list) and len(v) == 2 and isinstance(v[0], str) and v[0].upper() in PREDICATES else (k, "=", v) for k, v in column.items()]
        return [predicate(F.col(checked(k)), op, v) for k, op, v in pairs]
    if operator is None:
        raise ValueError("a condition needs an operator")
    return [predicate(F.col(checked(column)), operator, value)]


@dataclass(frozen=True)
class Query:
    """A query over one DataFrame."""

    source: DataFrame
    items: tuple[str, ...] = ()
    is_distinct: bool = False
    conditions: Conditions = field(default_factory=Conditions)
    joins: tuple[tuple[DataFrame, str | Column | None, str], ...] = ()
    groups: tuple[str, ...] = ()
    havings: tuple[str, ...] = ()
    orders: tuple[tuple[str, bool], ...] = ()
    n_limit: int | None = None
    n_offset: int | None = None
    options: Mapping[str, Any] = field(default_factory=dict)

    # projection
    def select(self, *columns: Any) -> Query:
        """Adds columns: names, expressions with or without an alias, lists of them. None is skipped; what differs
        only in case from an earlier item is dropped."""
        seen, kept = {i.lower() for i in self.items}, list(self.items)
        for item in flatten(columns):
            if item.lower() not in seen:
                seen.add(item.lower())
                kept.append(item)
        return replace(self, items=tuple(kept))

    def select_distinct(self, *columns: Any) -> Query:
        return replace(self.select(*columns), is_distinct=True)

    def remove_column(self, name: str) -> Query:
        keep = [i for i in self.items if name.lower() not in (i.lower(), alias_of(i)[0].lower(), (alias_of(i)[1] or "").lower())]
        return replace(self, items=tuple(keep))

    def has_column(self, name: str) -> bool:
        return len(self.remove_column(name).items) < len(self.items)

    def add_column(self, *columns: Any) -> Query:
        return self.select(*columns)

    def get_columns(self) -> list[str]:
        """The items in order, as they were given."""
        return list(self.items)

    def aliases(self) -> dict[str, str]:
        """Expressions by alias."""
        return {a: e for e, a in map(alias_of, self.items) if a}

    @property
    def is_select_all(self) -> bool:
        return not self.items or self.items == ("*",)

    def __len__(self) -> int:
        return len(self.items)

    def __bool__(self) -> bool:
        return True  # a query of all columns is one too

    def alias(self, name: str) -> Query:
        return replace(self, source=self.source.alias(checked(name)))

    # filters
    def where(self, column: str | Mapping[str, Any], operator: str | None = None, value: Any = None) -> Query:
        return replace(self, conditions=self.conditions.where(column, operator, value))

    def or_where(self, column: str | Mapping[str, Any], operator: str | None = None, value: Any = None) -> Query:
        return replace(self, conditions=self.conditions.or_where(column, operator, value))

    def where_in(self, column: str, values: Iterable[Any]) -> Query:
        return self.where(column, "IN", values)

    def where_not_in(self, column: str, values: Iterable[Any]) -> Query:
        return self.where(column, "NOT IN", values)

    def where_null(self, column: str) -> Query:
        return self.where(column, "IS NULL")

    def where_not_null(self, column: str) -> Query:
        return self.where(column, "IS NOT NULL")

    def where_between(self, column: str, low: Any, high: Any) -> Query:
        return self.where(column, "BETWEEN", [low, high])

    def where_like(self, column: str, pattern: str, case_sensitive: bool = True) -> Query:
        return self.where(column, "LIKE" if case_sensitive else "ILIKE", pattern)

    def where_function(self, expression: str, operator: str, value: Any = None) -> Query:
        if not re.match(r"^\s*\w+\s*\(.*\)\s*$", expression, re.S):
            raise ValueError("a function predicate needs a call such as lower(name)")
        return replace(self, conditions=self.conditions.add(predicate(F.expr(expression), operator, value)))

    def where_raw(self, sql: str, params: Mapping[str, Any] | None = None) -> Query:
        if FORBIDDEN.search(re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", sql)):
            raise ValueError("a raw condition can't change data")
        return replace(self, conditions=self.conditions.add(F.expr(bound(sql, params or {}))))

    def group(self, build: Callable[[Conditions], Conditions], conjunction: str = "AND") -> Query:
        return replace(self, conditions=self.conditions.group(build, conjunction))

    # joins, grouping, order
    def join(self, other: DataFrame, condition: str | Column | None = None, kind: str = "INNER") -> Query:
        kind = kind.upper()
        if kind not in JOINS:
            raise ValueError(f"unknown join: {kind}")
        if (condition is None) != (kind == "CROSS"):
            raise ValueError("every join but CROSS needs a condition")
        return replace(self, joins=(*self.joins, (other, condition, JOINS[kind])))

    def left_join(self, other: DataFrame, condition: str | Column) -> Query:
        return self.join(other, condition, "LEFT")

    def right_join(self, other: DataFrame, condition: str | Column) -> Query:
        return self.join(other, condition, "RIGHT")

    def group_by(self, *columns: str) -> Query:
        return replace(self, groups=(*self.groups, *flatten(columns)))

    def having(self, condition: str, params: Mapping[str, Any] | None = None) -> Query:
        """A condition over aggregates, such as count(*) > :n, or over aliases of the select list."""
        return replace(self, havings=(*self.havings, bound(condition, params or {})))

    def order_by(self, column: str, direction: str = "ASC") -> Query:
        if direction.upper() not in ("ASC", "DESC"):
            raise ValueError(f"unknown direction: {direction}")
        return replace(self, orders=(*self.orders, (column, direction.upper() == "ASC")))

    def limit(self, n: int) -> Query:
        if n < 0:
            raise ValueError("a limit can't be negative")
        return replace(self, n_limit=n)

    def offset(self, n: int) -> Query:
        if n < 0:
            raise ValueError("an offset can't be negative")
        return replace(self, n_offset=n)

    def reset(self, *parts: str) -> Query:
        """The query without some of conditions, joins, groups, havings and orders, or without all of these. A query
        never changes, so it needs no copies."""
        blank = {"conditions": Conditions(), "joins": (), "groups": (), "havings": (), "orders": ()}
        if unknown := set(parts) - set(blank):
            raise ValueError(f"no such parts: {sorted(unknown)}")
        return replace(self, **{k: v for k, v in blank.items() if not parts or k in parts})

    def with_option(self, name: str, value: Any) -> Query:
        """Keeps a note on how the query is to be run, which info() tells."""
        return replace(self, options={**self.options, name: value})

    def plan_text(self) -> str:
        """The optimised plan that Spark makes of the query."""
        return self.to_df()._jdf.queryExecution().optimizedPlan().toString()

    def info(self) -> dict[str, Any]:
        return {"columns": list(self.items), "distinct": self.is_distinct, "conditions": len(self.conditions.items), "select_all": self.is_select_all, "aliases": self.aliases(), "joins": [{"how": how, "on": on if on is None or isinstance(on, str) else str(on), "columns": list(other.columns)} for other, on, how in self.joins], "group_by": list(self.groups), "having": list(self.havings), "order_by": list(self.orders), "limit": self.n_limit, "offset": self.n_offset, "options": dict(self.options)}

    def to_df(self) -> DataFrame:
        df = self.source
        for other, condition, how in self.joins:
            df = df.crossJoin(other) if how == "cross" else df.join(other, F.expr(condition) if isinstance(condition, str) else condition, how)
        if (c := self.conditions.column()) is not None:
            df = df.where(c)
        if self.groups or self.havings:
            df = self._grouped(df)
        elif self.items:
            if self.orders and not self.is_distinct:
                df = df.orderBy(*self._order(df))
                return self._cut(df.selectExpr(*self.items))
            df = df.selectExpr(*self.items)
        if self.is_distinct:
            df = df.distinct()
        if self.orders:
            df = df.orderBy(*self._order(df))
        return self._cut(df)

    def _order(self, df: DataFrame) -> list[Column]:
        aliases = {a: e for e, a in map(alias_of, self.items) if a}
        known = {c.lower() for c in df.columns}
        pick = lambda c: F.expr(aliases[c]) if c in aliases and c.lower() not in known else F.expr(c)
        return [pick(c).asc() if up else pick(c).desc() for c, up in self.orders]

    def _grouped(self, df: DataFrame) -> DataFrame:
        keys = {g.lower() for g in self.groups}
        parts = [alias_of(i) for i in self.items]
        aggregates = [F.expr(e).alias(a or e) for e, a in parts if e.lower() not in keys]
        over_aggregates = [h for h in self.havings if "(" in h]
        flags = [F.expr(h).alias(f"__having_{i}") for i, h in enumerate(over_aggregates)]
        out = df.groupBy(*[F.expr(g).alias(g) for g in self.groups]).agg(*aggregates, *flags) if aggregates or flags else df.select(*[F.expr(g).alias(g) for g in self.groups]).distinct()
        for i in range(len(flags)):
            out = out.where(F.col(f"__having_{i}"))
        for h in self.havings:
            if "(" not in h:
                out = out.where(F.expr(h))
        return out.select(*[F.col(f"`{e if e.lower() in keys else a or e}`").alias(a or e) for e, a in parts] or [F.col(f"`{g}`") for g in self.groups])

    def _cut(self, df: DataFrame) -> DataFrame:
        if self.n_offset:
            df = df.offset(self.n_offset)
        return df if self.n_limit is None else df.limit(self.n_limit)
