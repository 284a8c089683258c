"""Columns to rows and back, transposition, profiles, Markdown sections and nested values."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from types import SimpleNamespace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import slug


def columns_to_rows(df: DataFrame, columns: Sequence[str], fill: Any = None, strict: bool = True) -> DataFrame:
    """Rows of parallel array columns, with their position. Lengths must agree if strict, else shorter columns are
    padded with fill, or null where fill is of another type; a null inside a column stays null."""
    longest = F.greatest(*[F.size(c) for c in columns]) if len(columns) > 1 else F.size(columns[0])
    if strict:
        for c in columns[1:]:
            df = df.where(F.when(F.size(c) == F.size(columns[0]), F.lit(True)).otherwise(F.raise_error(F.lit("columns differ in length"))))
    else:
        df = df.withColumns({c: F.concat(F.col(c), F.array_repeat(F.lit(fill).try_cast(df.schema[c].dataType.elementType), (longest - F.size(c)).cast("int"))) for c in columns})
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias("position", "__row")).select(*rest, "position", *[F.col(f"__row.{c}").alias(c) for c in columns])


def rows_to_columns(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], default: Any = None) -> DataFrame:
    """One row per key with an array per column, in the order given; nulls are default."""
    value = lambda c: F.coalesce(F.col(c), F.lit(default)) if default is not None else F.col(c)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__order"), *[value(c).alias(c) for c in columns])))
    out = df.groupBy(*keys).agg(rows.alias("__rows"))
    return out.select(*keys, *[F.col(f"__rows.{c}").alias(c) for c in columns])


def ragged_rows(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def transpose_matrix(matrix: Column) -> Column:
    """An array of equally long arrays with rows and columns exchanged."""
    width = F.coalesce(F.size(F.get(matrix, F.lit(0))), F.lit(0))
    index = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.transform(matrix, lambda r: F.get(r, i)))


def transpose_table(df: DataFrame, key: str, names: Sequence[Any]) -> DataFrame:
    """A row per column of df but key, and a column per value of key in names."""
    values = [c for c in df.columns if c != key]
    long = df.unpivot([key], values, "field", "value")
    return long.groupBy("field").pivot(key, list(names)).agg(F.first("value"))


def sketches(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group of by and column: its type, rows, nulls, a HyperLogLog sketch of its values and, of numbers, a KLL
    sketch of their distribution. One pass over df, whose rows are shrunk to sketches before they are shuffled."""
    names = [c for c in df.columns if c not in by]
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    plain = {f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.IntegerType, T.LongType, T.BinaryType))}
    text = lambda c: F.col(c) if c in plain else F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c).cast("string")
    own = lambda i, c: [F.count_if(F.col(c).isNull()).alias(f"__nulls{i}"), F.hll_sketch_agg(F.when(F.col(c).isNotNull(), text(c))).alias(f"__values{i}"), *([F.kll_sketch_agg_double(F.col(c).cast("double")).alias(f"__numbers{i}")] if c in numeric else [])]
    one = df.groupBy(*by).agg(F.count("*").alias("__rows"), *[a for i, c in enumerate(names) for a in own(i, c)])
    kinds = dict(df.dtypes)
    of = lambda i, c: F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col("__rows").alias("rows"), F.col(f"__nulls{i}").alias("nulls"), F.col(f"__values{i}").alias("values"), (F.col(f"__numbers{i}") if c in numeric else F.lit(None).cast("binary")).alias("numbers"))
    return one.select(*by, F.inline(F.array(*[of(i, c) for i, c in enumerate(names)])))


def merged(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What sketches() gives of the parts of a table, of several days for instance, as one of all of it."""
    return parts.groupBy(*by, "column", "type").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("values").alias("values"), F.when(F.count("numbers") > 0, F.kll_merge_agg_double("numbers")).alias("numbers"))


def described(sketched: DataFrame, ranks: Sequence[float] = (0.0, 0.5, 1.0)) -> DataFrame:
    """What sketches say of each column: rows, nulls, about how many distinct values, of numbers the values at about
    ranks (null if there are none), and an issue if all or some are null."""
    seen = (F.col("rows") > F.col("nulls")) & F.col("numbers").isNotNull()
    at = F.when(seen, F.array(*[F.kll_sketch_get_quantile_double("numbers", F.lit(r)) for r in ranks]))
    issue = F.when((F.col("rows") > 0) & (F.col("nulls") == F.col("rows")), "all null").when(F.col("nulls") > 0, "some null").otherwise("none")
    others = [c for c in sketched.columns if c not in ("values", "numbers")]
    return sketched.select(*others, F.hll_sketch_estimate("values").alias("distinct"), at.alias("quantiles"), issue.alias("issue"))


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """A row per column: its name, type, count of rows, nulls and distinct values, and an issue if all or some are
    null. Distinct values are estimated in one pass, true to a few percent, and exactly where they are few; if exact
    they are counted, column by column, so that no row is copied for each column."""
    found = described(sketches(df)).select("column", "type", "rows", "nulls", "distinct", "issue")
    if not exact:
        return found
    counts = None
    for c in df.columns:
        one = df.select(c).where(F.col(c).isNotNull()).groupBy(c).count().agg(F.count("*").alias("__distinct")).select(F.lit(c).alias("column"), "__distinct")
        counts = one if counts is None else counts.union(one)
    return found.join(F.broadcast(counts), "column").withColumn("distinct", F.col("__distinct")).drop("__distinct")


def batches(df: DataFrame, size: int = 1000) -> Iterator[list[dict[str, Any]]]:
    """The rows at the API's edge, size at a time; a partition at a time is fetched."""
    held: list[dict[str, Any]] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row.asDict(recursive=True))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def to_namespace(value: Any) -> Any:
    if isinstance(value, Mapping):
        return SimpleNamespace(**{k: to_namespace(v) for k, v in value.items()})
    return [to_namespace(v) for v in value] if isinstance(value, (list, tuple)) else value


def to_mapping(value: Any) -> Any:
    if isinstance(value, SimpleNamespace):
        return {k: to_mapping(v) for k, v in vars(value).items()}
    return [to_mapping(v) for v in value] if isinstance(value, (list, tuple)) else value


def flattened_json(c: Column, schema: str) -> Column:
    return F.from_json(c, schema)


def markdown_sections(df: DataFrame, text: str, key: str) -> DataFrame:
    """A row per section that a line `# heading` begins, the text before the first one included: key, its position,
    heading, body, and a file name that no other section of the key has."""
    parts = df.select(key, F.posexplode(F.split(F.col(text), r"(?m)^#\s+")).alias("position", "section")).where(F.trim("section") != "")
    heading = F.trim(F.substring_index("section", "\n", 1))
    body = F.regexp_replace(F.substring(F.col("section"), F.length(F.substring_index("section", "\n", 1)) + 2, F.lit(1 << 30)), r"^\s+|\s+$", "")
    rows = parts.select(key, "position", heading.alias("heading"), body.alias("body"), slug(heading).alias("stem"))
    again = F.row_number().over(W.partitionBy(key, "stem").orderBy("position")) - 1
    return rows.withColumn("file", F.concat("stem", F.when(again > 0, F.concat(F.lit("_"), again)).otherwise(""), F.lit(".md"))).drop("stem")


def datatype_spec(spec: str) -> dict[str, int]:
    """Counts by type of a spec such as int4:2;varchar(10):1; commas part like semicolons, repeats add up."""
    out: dict[str, int] = {}
    depth, item = 0, ""
    for c in spec + ";":
        depth += (c == "(") - (c == ")")
        if c in ",;" and not depth:
            if item.strip():
                name, _, n = item.strip().rpartition(":") if ":" in item else (item.strip(), "", "1")
                out[name.strip()] = out.get(name.strip(), 0) + int(n)
            item = ""
        else:
            item += c
    return out
