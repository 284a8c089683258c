"""Copies of large tables, range by range of a key, that go on where they were cut off and are checked on both sides.

The ranges follow from the quantiles of a bounded sample of the key and are kept with the copy, so that a later run
deals the rows out as the first did; rows without a key are a range of their own. Some ranges at a time are read, each
by a predicate that the source evaluates, and written to folders of their own. While rows pass, they are counted and
their hashes are summed up, which doesn't depend on their order; the same is then taken of what was written. A range
counts as copied once both agree: until then it is copied again, over what is there.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.numbering import numbered, with_checkpoints
from sparkloom.sources.files import exists

#: Reads the rows of a source that pass a predicate.
Source = Callable[[str], DataFrame]
RANGE = "range"


def of_frame(df: DataFrame) -> Source:
    return lambda predicate: df.where(predicate)


def of_jdbc(spark: SparkSession, options: Mapping[str, str], table: str) -> Source:
    """A table of a database, to which the predicate goes."""
    return lambda predicate: spark.read.jdbc(options["url"], table, predicates=[predicate], properties={k: v for k, v in options.items() if k != "url"})


def literal(value: Any) -> str:
    """A key as SQL has it."""
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, dt.date):
        return f"DATE '{value:%Y-%m-%d}'"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def bounds(keys: DataFrame, parts: int, sample: int = 100_000) -> list[Any]:
    """Where all ranges of a key but the first begin: quantiles of at most sample of the keys, drawn evenly. The keys
    are read once and written; they are drawn, sorted and numbered in parts, so that only the quantiles, and the least
    key, come to the driver. Equal keys are told apart by a random number, so that a frequent one fills several parts."""
    with_checkpoints(keys.sparkSession)
    key, draw = F.col("key"), F.col("draw")
    drawn = keys.toDF("key").where(key.isNotNull()).withColumn("draw", F.rand(0)).checkpoint()
    if (n := drawn.count()) > sample:
        few = drawn.where(draw < (sample + 6 * sample**0.5 + 36) / n)  # seldom too few, so that the rest needn't be sorted
        drawn = numbered(few, draw, key).where(F.col("number") <= sample).drop("number").checkpoint()
        n = drawn.count()
    places = {i * n // parts + 1 for i in range(parts)} if n else set()
    found = numbered(drawn, key, draw).where(F.col("number").isin(*places)).select("number", "key").collect() if places else []
    at = {r["number"]: r["key"] for r in found}  # a row per range
    return sorted(set(at.values()) - {at[1]}) if at else []


def predicates(key: str, starts: Sequence[Any]) -> list[str]:
    """One for each range in order, then that of rows without a key."""
    values = [literal(v) for v in starts]
    out = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(values[:-1], values[1:], strict=True)]
    ends = [f"{key} < {values[0]}", *out, f"{key} >= {values[-1]}"] if values else [f"{key} IS NOT NULL"]
    return [*ends, f"{key} IS NULL"]


def _check(columns: Sequence[str], within: Column) -> tuple[Column, Column]:
    """The count of rows and the sum of their hashes."""
    row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) for c in columns]).cast("decimal(38,0)")
    return F.count_if(within), F.coalesce(F.sum(F.when(within, row)), F.lit(0).cast("decimal(38,0)"))


class Transfer:
    """A copy of a source under target, by ranges of key, at_once of them in a job."""

    CHECKS = "range int, predicate string, rows long, sum decimal(38,0), copied_rows long, copied_sum decimal(38,0), same boolean"

    def __init__(self, spark: SparkSession, target: str, key: str, parts: int = 64, at_once: int = 8, sample: int = 100_000):
        self.spark, self.target, self.key, self.parts, self.at_once, self.sample = spark, target.rstrip("/"), key, parts, at_once, sample

    def _plan(self, source: Source) -> list[str]:
        place = f"{self.target}/plan"
        if not exists(self.spark, f"{place}/_SUCCESS"):
            found = predicates(self.key, bounds(source(f"{self.key} IS NOT NULL").select(self.key), self.parts, self.sample))
            self.spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(place)
        return json.loads(self.spark.read.text(place).first()[0])

    def checks(self) -> DataFrame:
        """A row per range that was copied, the last if it was copied several times: what was read, what was written
        and whether they agree."""
        place = f"{self.target}/checks"
        if not exists(self.spark, place):
            return self.spark.createDataFrame([], self.CHECKS)
        found = self.spark.read.schema(f"{self.CHECKS}, turn long").parquet(place)
        rest = [c for c in found.columns if c != RANGE]
        return found.groupBy(RANGE).agg(F.max_by(F.struct(*rest), "turn").alias("last")).select(RANGE, *[f"last.{c}" for c in rest if c != "turn"])

    def rows(self) -> DataFrame | None:
        """What was copied so far; None if no range was begun."""
        return self.spark.read.parquet(f"{self.target}/rows").drop(RANGE) if exists(self.spark, f"{self.target}/rows") else None

    def run(self, source: Source) -> DataFrame:
        """Copies the ranges that are still missing; returns all checks. An error leaves the ranges done before."""
        plan = self._plan(source)
        done = {r[RANGE] for r in self.checks().where("same").select(RANGE).collect()}  # a number per range
        missing = [i for i in range(len(plan)) if i not in done]
        for start in range(0, len(missing), self.at_once):
            self._copy(source, plan, missing[start : start + self.at_once])
        return self.checks()

    def verify(self) -> DataFrame:
        """Takes the copy's side of all checks anew; a range that has changed since is copied again by the next run."""
        rows, known = self.rows(), self.checks()
        if rows is None:
            return known
        kept = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(RANGE, T.IntegerType())])).parquet(f"{self.target}/rows")
        count, total = _check(rows.columns, F.lit(True))
        now = kept.groupBy(RANGE).agg(count.alias("now_rows"), total.alias("now_sum"))
        none = [F.coalesce("now_rows", F.lit(0)).alias("copied_rows"), F.coalesce("now_sum", F.lit(0).cast("decimal(38,0)")).alias("copied_sum")]
        found = known.drop("copied_rows", "copied_sum", "same").join(now, RANGE, "left").select("*", *none).drop("now_rows", "now_sum")
        found = found.withColumn("same", (F.col("rows") == F.col("copied_rows")) & (F.col("sum") == F.col("copied_sum")))
        self._note([tuple(r) for r in found.select(*known.columns).where("not same").collect()])
        return self.checks()

    def _note(self, found: list[tuple]) -> None:
        if not found:
            return
        place = f"{self.target}/checks"
        turn = self.spark.read.parquet(place).agg(F.max("turn")).first()[0] + 1 if exists(self.spark, place) else 0
        self.spark.createDataFrame([(*f, turn) for f in found], f"{self.CHECKS}, turn long").coalesce(1).write.mode("append").parquet(place)

    def _copy(self, source: Source, plan: list[str], ranges: list[int]) -> None:
        rows = reduce(DataFrame.unionByName, [source(plan[i]).withColumn(RANGE, F.lit(i)) for i in ranges])
        columns = [c for c in rows.columns if c != RANGE]
        if clash := [c for c in columns if c.lower() == RANGE and c != RANGE] or len(rows.columns) != len(set(rows.columns)):
            raise ValueError(f"a column is named like the copy's: {clash}")
        each = [c.alias(f"{name}{i}") for i in ranges for name, c in zip(("rows", "sum"), _check(columns, F.col(RANGE) == i), strict=True)]
        seen = Observation()
        rows.observe(seen, *each).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(f"{self.target}/rows")
        read = seen.get
        written = self.spark.read.schema(rows.schema).parquet(f"{self.target}/rows").where(F.col(RANGE).isin(ranges)).agg(*each).first()
        found = []
        for i in ranges:
            got, copied = ((m[f"rows{i}"], m[f"sum{i}"]) for m in (read, written))
            found.append((i, plan[i], *got, *copied, got == copied))
        self._note(found)
