"""Identity resolution over tokens: which token rows belong to one person, with crosswalks kept by validity interval.

Every step takes and returns DataFrames. The clock and the source of new ids are arguments, so that runs can be
repeated. A table of tokens has tokenid, token_name, token_hash and what the steps add.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.dml import diff_null_safe, first_rows, last_wins
from sparkloom.operators.numbering import numbered, with_checkpoints
from sparkloom.sources.versions import Change, Reader, SnapshotSet

NO_ORDER = 999_999

#: The tables that outlast a run.
STATE = {
    "token_crosswalk": "tokenid string, detokenid string, startdate timestamp, enddate timestamp",
    "detoken_crosswalk": "detokenid string, token_hash string, token_order int",
    "merge_history": "tokenid string, old_detokenid string, new_detokenid string, merge_dt timestamp",
    "final_crosswalk": "detokenid string, id long",
}


def token_rows(tokens: DataFrame) -> DataFrame:
    """Step 1: the columns that the process works on, with typed empty ones for what is found later."""
    empty = {"create_date": "timestamp", "alt_tokenid": "string", "detokenid": "string"}
    return tokens.select("tokenid", "token_name", "token_hash", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])


def with_order(rows: DataFrame) -> DataFrame:
    """Step 2: a token's order is the number that ends its name; null without one."""
    return rows.withColumn("token_order", F.nullif(F.regexp_extract("token_name", r"_(\d+)$", 1), F.lit("")).cast("int"))


def without_invalid(rows: DataFrame) -> DataFrame:
    """Step 3: hashes that contain XXX are no hashes."""
    return rows.withColumn("token_hash", F.when(~F.upper("token_hash").contains("XXX"), F.col("token_hash")))


def without_unmergeable(rows: DataFrame, do_not_merge: DataFrame) -> DataFrame:
    """Step 4."""
    return rows.join(do_not_merge.select("tokenid").distinct(), "tokenid", "left_anti")


def with_create_date(rows: DataFrame, token_crosswalk: DataFrame, now: Column) -> DataFrame:
    """Step 5: when the crosswalk first had the token, else now. Of repeated tokens the last start holds."""
    start = last_wins(token_crosswalk.select("tokenid", "startdate"), ["tokenid"], F.col("startdate"))
    return rows.drop("create_date").join(start.withColumnRenamed("startdate", "create_date"), "tokenid", "left").withColumn("create_date", F.coalesce("create_date", now))


def is_valid(token_hash: Column) -> Column:
    return F.coalesce(token_hash.isNotNull() & (F.lower(token_hash) != "missing token") & ~F.upper(token_hash).contains("XXX"), F.lit(False))


def with_alternative(rows: DataFrame) -> DataFrame:
    """Step 6: of another row with the same hash and order that was there first, its tokenid. First is the earliest,
    then the greatest tokenid; null tokenids are passed over.

    Hashes that many share are found by aggregation, not by a window, so that no task holds all rows of one."""
    valid = rows.where(is_valid(F.col("token_hash")) & F.col("tokenid").isNotNull())
    earliest = F.struct(F.coalesce(-F.unix_micros("create_date"), F.lit(-(1 << 62))), "tokenid")
    firsts = valid.groupBy("token_hash").agg(F.max_by(F.struct("tokenid", "token_order"), earliest).alias("__first"))
    joined = rows.drop("alt_tokenid").join(firsts, "token_hash", "left")
    f = F.col("__first")
    ok = is_valid(F.col("token_hash")) & f["token_order"].eqNullSafe(F.col("token_order")) & (f["tokenid"] != F.col("tokenid"))
    return joined.withColumn("alt_tokenid", F.when(ok, f["tokenid"])).drop("__first")


def best_rows(rows: DataFrame) -> DataFrame:
    """Step 7: per tokenid the row with an alternative, of the least alternative, order, date and hash."""
    last = lambda c: (F.col(c).isNull(), F.col(c))  # noqa: E731  nulls come last
    return first_rows(rows, ["tokenid"], F.struct(*last("alt_tokenid"), F.coalesce("token_order", F.lit(NO_ORDER)), *last("create_date"), *last("token_hash")))


def with_identity(best: DataFrame, token_crosswalk: DataFrame, new_id: Column) -> DataFrame:
    """Step 8: the identity of the alternative if the crosswalk has it, else the row's own, else a new one unless
    there is an alternative; rows with an alternative then take what that row has, one step far."""
    known = last_wins(token_crosswalk.where("enddate is null").select("tokenid", "detokenid", "startdate"), ["tokenid"], F.col("startdate")).select("tokenid", "detokenid")
    out = best.drop("detokenid").join(known.select(F.col("tokenid").alias("alt_tokenid"), F.col("detokenid").alias("__alt")), "alt_tokenid", "left").join(known.withColumnRenamed("detokenid", "__own"), "tokenid", "left")
    out = out.withColumn("detokenid", F.coalesce("__alt", "__own", F.when(F.col("alt_tokenid").isNull(), new_id))).drop("__alt", "__own")
    step = out.select(F.col("tokenid").alias("alt_tokenid"), F.col("detokenid").alias("__next"))
    return out.join(step, "alt_tokenid", "left").withColumn("detokenid", F.coalesce("detokenid", "__next")).drop("__next")


def missing_tokens(all_ids: DataFrame, resolved: DataFrame, do_not_merge: DataFrame, token_crosswalk: DataFrame, new_id: Column) -> DataFrame:
    """Step 9: ids that were neither resolved nor known, and all that must not be merged, each with an id of its own."""
    known = token_crosswalk.select("tokenid").distinct()
    lost = all_ids.select("tokenid").distinct().join(resolved.select("tokenid"), "tokenid", "left_anti").join(known, "tokenid", "left_anti")
    own = do_not_merge.select("tokenid").distinct().join(known, "tokenid", "left_anti")
    return lost.union(own).distinct().select("tokenid", new_id.alias("detokenid"))


def new_mapping(resolved: DataFrame) -> DataFrame:
    """Step 10: the greatest identity of each hash, order and tokenid; null keys are groups."""
    return resolved.groupBy("tokenid", "token_hash", "token_order").agg(F.max("detokenid").alias("detokenid"))


def upsert_hashes(crosswalk: DataFrame, mapping: DataFrame) -> DataFrame:
    """Step 11: detoken crosswalk (detokenid, token_hash, token_order) with the mapping's new rows."""
    new = mapping.select("detokenid", "token_hash", "token_order").where("detokenid is not null").distinct()
    return crosswalk.select("detokenid", "token_hash", "token_order").unionByName(diff_null_safe(new, crosswalk, ["detokenid", "token_hash", "token_order"]))


def upsert_tokens(crosswalk: DataFrame, mapping: DataFrame, now: Column) -> DataFrame:
    """Step 12: token crosswalk (tokenid, detokenid, startdate, enddate) with the mapping's new pairs, open from now."""
    new = mapping.select("tokenid", "detokenid").where("detokenid is not null").distinct()
    new = diff_null_safe(new, crosswalk, ["tokenid", "detokenid"])
    return crosswalk.select("tokenid", "detokenid", "startdate", "enddate").unionByName(new.select("tokenid", "detokenid", now.alias("startdate"), F.lit(None).cast("timestamp").alias("enddate")))


def insert_missing(tokens: DataFrame, hashes: DataFrame, missing: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Step 13: both crosswalks with the missing ids."""
    mapping = missing.select("tokenid", "detokenid", F.lit(None).cast("string").alias("token_hash"), F.lit(None).cast("int").alias("token_order"))
    return upsert_tokens(tokens, mapping, now), upsert_hashes(hashes, mapping)


def close_intervals(crosswalk: DataFrame, now: Column) -> DataFrame:
    """Step 14: of a token's open rows only the latest stays open."""
    place = F.row_number().over(W.partitionBy("tokenid").orderBy(F.col("startdate").desc_nulls_last(), F.col("detokenid").desc()))
    out = crosswalk.withColumn("__place", place)
    return out.withColumn("enddate", F.when((F.col("__place") > 1) & F.col("enddate").isNull(), now).otherwise(F.col("enddate"))).drop("__place")


def merge_history(history: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Step 15: history (tokenid, old_detokenid, new_detokenid, merge_dt) with the ended rows that it lacks; the new
    identity of all is the current one."""
    ended = crosswalk.where("enddate is not null").select("tokenid", F.col("detokenid").alias("old_detokenid"), F.lit(None).cast("string").alias("new_detokenid"), F.col("enddate").alias("merge_dt"))
    both = history.select("tokenid", "old_detokenid", "new_detokenid", "merge_dt").unionByName(diff_null_safe(ended, history, ["tokenid", "old_detokenid"]))
    current = last_wins(crosswalk.where("enddate is null").select("tokenid", "detokenid", "startdate"), ["tokenid"], F.col("startdate")).select("tokenid", F.col("detokenid").alias("__current"))
    return both.join(current, "tokenid", "left").withColumn("new_detokenid", F.coalesce("__current", "new_detokenid")).drop("__current")


def person_ids(final: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Step 16: final crosswalk (detokenid, id) with the next numbers for new identities, in the order of their
    first start."""
    new = crosswalk.where("detokenid is not null").groupBy("detokenid").agg(F.min("startdate").alias("first")).join(final.select("detokenid"), "detokenid", "left_anti")
    last = final.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    rows = numbered(new, F.col("first").asc_nulls_last(), F.col("detokenid").asc())
    return final.select("detokenid", "id").unionByName(rows.join(F.broadcast(last)).select("detokenid", (F.col("__last") + F.col("number")).cast("long").alias("id")))


def run(tokens: DataFrame, state: Mapping[str, DataFrame], do_not_merge: DataFrame, now: Column, new_id: Column, missing_id: Column) -> dict[str, DataFrame]:
    """Steps 1 to 16 over a load of tokens: the tables of STATE after it. new_id and missing_id make the ids of
    resolved and of missing tokens; they are made once, as what they are given to is written before it is read again."""
    with_checkpoints(tokens.sparkSession)
    crosswalk = state["token_crosswalk"]
    rows = without_unmergeable(without_invalid(with_order(token_rows(tokens))), do_not_merge)
    rows = with_create_date(rows, crosswalk, now)
    found = with_identity(best_rows(with_alternative(rows)), crosswalk, new_id).checkpoint()
    missing = missing_tokens(rows, found, do_not_merge, crosswalk, missing_id).checkpoint()
    mapping = new_mapping(found)
    intervals, hashes = insert_missing(upsert_tokens(crosswalk, mapping, now), upsert_hashes(state["detoken_crosswalk"], mapping), missing, now)
    intervals = close_intervals(intervals, now).checkpoint()
    return {"token_crosswalk": intervals, "detoken_crosswalk": hashes, "merge_history": merge_history(state["merge_history"], intervals), "final_crosswalk": person_ids(state["final_crosswalk"], intervals)}


def load(store: SnapshotSet, tokens: DataFrame, do_not_merge: DataFrame, now: Column, new_id: Column | None = None, missing_id: Column | None = None) -> int:
    """Step 17: run() from the newest version of the state in store, kept as its next version, whose number is
    returned. All tables count together; if another load was quicker the run is made again from what it left."""
    new_id, missing_id = (F.expr("uuid()") if c is None else c for c in (new_id, missing_id))
    after: dict[str, DataFrame] = {}
    first, *others = STATE

    def made(read: Reader) -> DataFrame:
        state = {}
        for name, columns in STATE.items():
            kept = read(name)
            state[name] = tokens.sparkSession.createDataFrame([], columns) if kept is None else kept
        after.update(run(tokens, state, do_not_merge, now, new_id, missing_id))
        return after[first]

    return store.write([Change(first, made), *[Change(name, lambda _, name=name: after[name]) for name in others]])
