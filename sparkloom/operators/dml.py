"""Inserts, updates and upserts as copy-on-write: each returns the table's new rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.builder import Conditions, checked


def insert_rows(table: DataFrame, rows: Mapping[str, Any] | Sequence[Mapping[str, Any]] | Mapping[str, Sequence[Any]]) -> DataFrame:
    """table and the new rows: one mapping, several with the same keys, or a mapping of lists. Columns that the rows
    lack become null."""
    if isinstance(rows, Mapping):
        lists = [v for v in rows.values() if isinstance(v, (list, tuple))]
        if lists and len(lists) == len(rows):
            if len({len(v) for v in lists}) > 1:
                raise ValueError("columns to insert differ in length")
            rows = [dict(zip(rows, values, strict=True)) for values in zip(*rows.values(), strict=True)]
        else:
            rows = [rows]
    if not rows or not rows[0]:
        raise ValueError("there is nothing to insert")
    if any(set(r) != set(rows[0]) for r in rows):
        raise ValueError("rows to insert have different columns")
    if unknown := set(rows[0]) - set(table.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    new = table.sparkSession.createDataFrame([[r.get(c) for c in table.columns] for r in rows], table.schema)
    return table.unionByName(new)


def insert_from(table: DataFrame, query: DataFrame) -> DataFrame:
    """table and query's rows, by the position of the columns."""
    if len(query.columns) != len(table.columns):
        raise ValueError("the query has another number of columns than the table")
    return table.union(query.select(*[F.col(f"`{q}`").cast(t.dataType).alias(t.name) for q, t in zip(query.columns, table.schema, strict=True)]))


def update(table: DataFrame, values: Mapping[str, Any], where: Conditions | None = None, cases: Sequence[tuple[str, Mapping[str, Any]]] = (), allow_full: bool = False) -> DataFrame:
    """table with values set in the rows that pass where; cases set further values where their condition holds too.
    Without where the whole table changes, which has to be allowed."""
    condition = where.column() if where else None
    if condition is None and not allow_full:
        raise ValueError("an update of the whole table has to be allowed")
    if not values and not cases:
        raise ValueError("there is nothing to update")
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    changed: dict[str, Column] = {checked(c): F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}
    for sql, more in cases:
        for c, v in more.items():
            changed[checked(c)] = F.when(hit & F.coalesce(F.expr(sql), F.lit(False)), F.lit(v)).otherwise(changed.get(c, F.col(c)))
    return table.select(*[changed[c].cast(table.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in table.columns])


def affected(table: DataFrame, where: Conditions) -> int:
    condition = where.column()
    return table.count() if condition is None else table.where(condition).count()


def upsert_first_wins(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key: an existing one if there is one, else the first of the new ones by order."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return first_rows(both, keys, F.struct("__new", order)).drop("__new")


def first_rows(table: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Per key the row of the least order, which must not be null. An aggregation, so that the rows of a frequent key
    are thinned out before they meet."""
    rest = [c for c in table.columns if c not in keys]
    return table.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row")).select(*[F.col(f"__row.{c}").alias(c) if c in rest else F.col(c) for c in table.columns])


def publish(existing: DataFrame, new: DataFrame, key: str, changed: str) -> DataFrame:
    """new with the action that publishing takes: published for an unknown key, updated if the column changed
    differs, else skipped."""
    known = existing.groupBy(key).agg(F.max(changed).alias("__was"), F.lit(True).alias("__known"))
    action = F.when(F.col("__known").isNull(), "published").when(~F.col(changed).eqNullSafe(F.col("__was")), "updated").otherwise("skipped")
    return new.join(known, key, "left").withColumn("action", action).drop("__was", "__known")


def last_wins(table: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The last row per key by order: what a lookup table keeps of repeated keys."""
    rest = [c for c in table.columns if c not in keys]
    last = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order.isNotNull(), order)).alias("__row"))
    return last.select(*[F.col(f"__row.{c}").alias(c) if c in rest else F.col(c) for c in table.columns])


def diff_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left without a partner in right on keys, where null equals null."""
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    condition = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        condition = c if condition is None else condition & c
    return left.join(r, condition, "left_anti")
