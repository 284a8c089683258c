"""De-identification: derived fields, masked ids, recipe tokens and presence masks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.security import tokens
from sparkloom.functions.text import month_text, parse_date, prefix, soundex_part, stringify, year_text

#: Transforms by name; a date format is an argument in parentheses.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {"stringify": stringify, "year": year_text, "month": month_text}


#: Fixed value: the label of masked ids.
MASK_LABEL = "MASK"


def derived_fields(df: DataFrame, schema: Mapping[str, str], specs: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """df with a column per spec {from, transform}, in order; from names a key of schema (its column is the value) or
    an earlier derived field."""
    made: set[str] = set()
    for name, spec in specs.items():
        source, transform = spec["from"], spec["transform"]
        if source not in made and source not in schema:
            raise KeyError(f"{name} derives from {source}, which is neither a field nor derived before it")
        c = F.col(source if source in made else schema[source])
        if transform.startswith("date_parse(") and transform.endswith(")"):
            out = parse_date(c, transform[len("date_parse(") : -1])
        elif transform in TRANSFORMS:
            out = TRANSFORMS[transform](c)
        else:
            raise ValueError(f"unknown transform: {transform}")
        df = df.withColumn(name, out)
        made.add(name)
    return df


def part(spec: str, schema: Mapping[str, str], columns: Sequence[str]) -> Column:
    """A recipe's part: `soundex:field`, `field:n` for the first n characters, or a field. Nulls are empty."""
    place = lambda name: schema.get(name, name)
    head, _, tail = spec.partition(":")
    name = place(tail if head == "soundex" and tail else head)
    if name not in columns:
        raise KeyError(f"unknown field in recipe: {spec}")
    if head == "soundex" and tail:
        return soundex_part(F.col(name))
    if tail:
        if not tail.isdigit():
            raise ValueError(f"unknown part of a recipe: {spec}")
        return prefix(F.col(name), int(tail))
    return stringify(F.col(name))


def enabled(recipe: Mapping[str, Any], versions: Sequence[str], families: Mapping[str, bool]) -> bool:
    return recipe["version"] in versions and bool(families.get(recipe["family"], False))


def masked_id(df: DataFrame, id_column: str, key: bytes, length: int = 22) -> DataFrame:
    return df.withColumn("masked_id", tokens(key, F.lit(MASK_LABEL), stringify(F.col(id_column)), length))


def with_token_ids(df: DataFrame, crosswalk: DataFrame, new_id: Column) -> tuple[DataFrame, DataFrame]:
    """df (id, masked_id) with tokenid, that of crosswalk (id, masked_id, tokenid) or a new one, and the crosswalk
    with the new rows. Of repeated masked ids in the crosswalk the least tokenid holds."""
    known = crosswalk.groupBy("masked_id").agg(F.min("tokenid").alias("__known"))
    fresh = df.select("id", "masked_id").join(known, "masked_id", "left_anti").groupBy("masked_id").agg(F.min("id").alias("id")).select("id", "masked_id", new_id.alias("tokenid"))
    crosswalk = crosswalk.select("id", "masked_id", "tokenid").unionByName(fresh)
    ids = crosswalk.groupBy("masked_id").agg(F.min("tokenid").alias("tokenid"))
    return df.join(ids, "masked_id", "left"), crosswalk


def build_tokens(df: DataFrame, schema: Mapping[str, str], recipes: Mapping[str, Mapping[str, Any]], key: bytes, versions: Sequence[str], families: Mapping[str, bool], id_column: str = "tokenid", length: int = 43) -> DataFrame:
    """A row per input row and enabled recipe: tokenid, token_name, token_version, token_family, token_hash. All
    recipes of a row are made side by side, so the input is read once and one Arrow pass hashes them."""
    structs = []
    for name, recipe in recipes.items():
        if enabled(recipe, versions, families):
            raw = F.concat(*[part(p, schema, df.columns) for p in recipe["parts"]])
            structs.append(F.struct(F.lit(name).alias("token_name"), F.lit(recipe["version"]).alias("token_version"), F.lit(recipe["family"]).alias("token_family"), raw.alias("raw")))
    if not structs:
        return df.sparkSession.createDataFrame([], "tokenid string, token_name string, token_version string, token_family string, token_hash string")
    rows = df.select(F.col(id_column).cast("string").alias("tokenid"), F.inline(F.array(*structs)))
    return rows.select("tokenid", "token_name", "token_version", "token_family", tokens(key, F.col("token_name"), F.col("raw"), length).alias("token_hash"))


def presence_mask(df: DataFrame, schema: Mapping[str, str], date_of_birth: str | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """df with each field of schema as 1 where it has a value and else 0, absent columns as 0, the year of birth in
    place of the date, and without the columns of drop."""
    year = [F.coalesce(*[F.year(parse_date(F.col(date_of_birth).cast("string"), f)) for f in ("%m/%d/%Y", "%Y-%m-%d")]).alias("birth_year")] if date_of_birth else []
    masked = [(F.col(c).isNotNull().cast("int") if c in df.columns else F.lit(0)).alias(c) for c in schema.values() if c not in drop]
    rest = [c for c in df.columns if c not in schema.values() and c not in drop]
    return df.select(*rest, *masked, *year)
