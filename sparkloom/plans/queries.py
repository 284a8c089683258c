"""The library's queries over the standard tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import assertions, security, text
from sparkloom.operators import deid, dml, generate, identity, reshape, rollups, sync
from sparkloom.operators.numbering import numbered, with_checkpoints
from sparkloom.plans.builder import Conditions, Query, literal, predicate, similar_to_regex
from sparkloom.sources import feed, files, ingest, scripts, tables, transfer, versions

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}

#: The key of the examples; not a secret.
KEY = b"example key"
#: The clock of the examples.
NOW = "2024-06-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


# predicates: one query each over a table and a column
WHERES = {
    "where_eq": ("orders", "o_orderkey", "o_orderstatus", "=", "F", "o_orderstatus = 'F'"),
    "where_ne": ("orders", "o_orderkey", "o_orderstatus", "!=", "F", "o_orderstatus != 'F'"),
    "where_ne_sql": ("orders", "o_orderkey", "o_orderstatus", "<>", "O", "o_orderstatus <> 'O'"),
    "where_lt": ("orders", "o_orderkey", "o_totalprice", "<", 50000.0, "o_totalprice < 50000"),
    "where_gt": ("orders", "o_orderkey", "o_totalprice", ">", 200000.0, "o_totalprice > 200000"),
    "where_le": ("part", "p_partkey", "p_size", "<=", 10, "p_size <= 10"),
    "where_ge": ("part", "p_partkey", "p_size", ">=", 40, "p_size >= 40"),
    "where_like": ("part", "p_partkey", "p_type", "LIKE", "%CON%", "p_type LIKE '%CON%'"),
    "where_not_like": ("part", "p_partkey", "p_type", "NOT LIKE", "%CON%", "p_type NOT LIKE '%CON%'"),
    "where_ilike": ("customer", "c_custkey", "c_mktsegment", "ILIKE", "b%", "c_mktsegment ILIKE 'b%'"),
    "where_not_ilike": ("customer", "c_custkey", "c_mktsegment", "NOT ILIKE", "b%", "c_mktsegment NOT ILIKE 'b%'"),
    "where_in": ("customer", "c_custkey", "c_nationkey", "IN", [1, 2, 3], "c_nationkey IN (1, 2, 3)"),
    "where_not_in": ("customer", "c_custkey", "c_nationkey", "NOT IN", [1, 2, 3], "c_nationkey NOT IN (1, 2, 3)"),
    "where_in_empty": ("customer", "c_custkey", "c_nationkey", "IN", [], "1 = 0"),
    "where_not_in_empty": ("customer", "c_custkey", "c_nationkey", "NOT IN", [], "1 = 1"),
    "where_between": ("lineitem", "l_orderkey", "l_quantity", "BETWEEN", [10.0, 12.0], "l_quantity BETWEEN 10 AND 12"),
    "where_not_between": ("lineitem", "l_orderkey", "l_quantity", "NOT BETWEEN", [5.0, 45.0], "l_quantity NOT BETWEEN 5 AND 45"),
    "where_regexp": ("part", "p_partkey", "p_brand", "REGEXP", "[12]$", "regexp_matches(p_brand, '[12]$')"),
    "where_not_regexp": ("part", "p_partkey", "p_brand", "NOT REGEXP", "[12]$", "NOT regexp_matches(p_brand, '[12]$')"),
    "where_rlike": ("customer", "c_custkey", "c_name", "RLIKE", "0+1$", "regexp_matches(c_name, '0+1$')"),
    "where_similar": ("part", "p_partkey", "p_brand", "SIMILAR TO", "Brand#(1|2)_", "regexp_matches(p_brand, '^(?s:Brand#(1|2).)$')"),
    "where_not_similar": ("part", "p_partkey", "p_brand", "NOT SIMILAR TO", "Brand#(1|2)_", "NOT regexp_matches(p_brand, '^(?s:Brand#(1|2).)$')"),
}


def _where(tbl: str, key: str, column: str, op: str, value: object) -> Run:
    return lambda spark, sf_dir: Query(table(spark, sf_dir, tbl)).select(key, column).where(column, op, value).to_df()


for _name, (_t, _k, _c, _op, _v, _sql) in WHERES.items():
    QUERIES[_name] = _where(_t, _k, _c, _op, _v)
    ORACLES[_name] = f"SELECT {_k}, {_c} FROM {_t} WHERE {_sql}"


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL")
def where_null(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return Query(df).select("c_custkey", "segment").where_null("segment").to_df()


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL")
def where_not_null(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return Query(df).select("c_custkey", "segment").where_not_null("segment").to_df()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 300000 OR o_totalprice < 5000)")
def where_group(spark, sf_dir):
    either = lambda g: g.where("o_totalprice", ">", 300000.0).or_where("o_totalprice", "<", 5000.0)
    return Query(table(spark, sf_dir, "orders")).select("o_orderkey").where("o_orderstatus", "=", "F").group(either).to_df()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice > 200000")
def where_or_precedence(spark, sf_dir):
    return Query(table(spark, sf_dir, "orders")).select("o_orderkey").where("o_orderstatus", "=", "F").or_where("o_orderstatus", "=", "O").where("o_totalprice", ">", 200000.0).to_df()


@query("SELECT p_partkey FROM part WHERE p_size > 20 AND p_brand = 'Brand#12'")
def where_dict(spark, sf_dir):
    return Query(table(spark, sf_dir, "part")).select("p_partkey").where({"p_size": [">", 20], "p_brand": "Brand#12"}).to_df()


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND (p_brand = 'Brand#12' OR p_size = 50)")
def where_or_dict(spark, sf_dir):
    return Query(table(spark, sf_dir, "part")).select("p_partkey").where("p_size", ">", 10).or_where({"p_brand": "Brand#12", "p_size": 50}).to_df()


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def where_function(spark, sf_dir):
    return Query(table(spark, sf_dir, "customer")).select("c_custkey").where_function("lower(c_mktsegment)", "=", "building").to_df()


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderpriority = '1-URGENT'")
def where_raw(spark, sf_dir):
    return Query(table(spark, sf_dir, "orders")).select("o_orderkey").where_raw("o_totalprice > :least AND o_orderpriority = :priority", {"least": 100000, "priority": "1-URGENT"}).to_df()


@query("SELECT DISTINCT p_brand, p_size FROM part")
def select_distinct(spark, sf_dir):
    return Query(table(spark, sf_dir, "part")).select_distinct("p_brand, p_size").to_df()


@query("SELECT c_custkey AS id, upper(c_mktsegment) AS segment, round(c_acctbal, 1) AS balance FROM customer")
def select_alias(spark, sf_dir):
    return Query(table(spark, sf_dir, "customer")).select("c_custkey AS id", ["upper(c_mktsegment) segment", None], "round(c_acctbal, 1) AS balance").to_df()


@query("SELECT c_custkey, c_name FROM customer")
def select_dedupe(spark, sf_dir):
    return Query(table(spark, sf_dir, "customer")).select("c_custkey", "C_CUSTKEY", "c_name").to_df()


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    return Query(table(spark, sf_dir, "orders")).join(table(spark, sf_dir, "customer"), "o_custkey = c_custkey").select("o_orderkey", "c_name").to_df()


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON o_custkey = c_custkey")
def join_left(spark, sf_dir):
    big = Query(table(spark, sf_dir, "orders")).where("o_totalprice", ">", 200000.0).to_df()
    return Query(table(spark, sf_dir, "customer")).left_join(big, "o_custkey = c_custkey").select("c_custkey", "o_orderkey").to_df()


@query("SELECT n_name, c_custkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) RIGHT JOIN nation ON c_nationkey = n_nationkey")
def join_right(spark, sf_dir):
    rich = Query(table(spark, sf_dir, "customer")).where("c_acctbal", ">", 5000.0).to_df()
    return Query(rich).right_join(table(spark, sf_dir, "nation"), "c_nationkey = n_nationkey").select("n_name", "c_custkey").to_df()


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20")
def join_full(spark, sf_dir):
    return Query(table(spark, sf_dir, "customer")).join(table(spark, sf_dir, "supplier"), "c_custkey = s_suppkey * 20", "FULL").select("c_custkey", "s_suppkey").to_df()


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf_dir):
    return Query(table(spark, sf_dir, "region")).join(table(spark, sf_dir, "nation"), kind="CROSS").select("r_name", "n_name").to_df()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_semi(spark, sf_dir):
    return Query(table(spark, sf_dir, "customer")).join(table(spark, sf_dir, "orders"), "o_custkey = c_custkey AND o_totalprice > 250000", "SEMI").select("c_custkey").to_df()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    return Query(table(spark, sf_dir, "customer")).join(table(spark, sf_dir, "orders"), "o_custkey = c_custkey", "ANTI").select("c_custkey").to_df()


_NULLABLE = "SELECT c_custkey, nullif(c_nationkey, 3) AS nation, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer"


@query(f"SELECT c_custkey FROM ({_NULLABLE}) a WHERE NOT EXISTS (SELECT 1 FROM ({_NULLABLE}) b WHERE b.c_custkey % 7 = 0 AND a.nation IS NOT DISTINCT FROM b.nation AND a.segment IS NOT DISTINCT FROM b.segment)")
def anti_composite(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nation"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return dml.diff_null_safe(df, df.where("c_custkey % 7 = 0"), ["nation", "segment"]).select("c_custkey")


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(n_nationkey, 3) GROUP BY n_name")
def join_nullsafe(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("nk", F.nullif("n_nationkey", F.lit(3)))
    customer = table(spark, sf_dir, "customer").withColumn("ck", F.nullif("c_nationkey", F.lit(3)))
    return Query(customer).join(nation, F.col("ck").eqNullSafe(F.col("nk"))).select("n_name", "count(*) AS customers").group_by("n_name").to_df()


@query(
    """SELECT r_name, l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS line_count
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE l_quantity >= 5 GROUP BY r_name, l_returnflag HAVING count(*) > 10"""
)
def revenue_by_region(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    q = Query(t("lineitem")).join(t("orders"), "l_orderkey = o_orderkey").join(t("customer"), "o_custkey = c_custkey").join(t("nation"), "c_nationkey = n_nationkey").join(t("region"), "n_regionkey = r_regionkey")
    q = q.where("l_quantity", ">=", 5.0).select("r_name", "l_returnflag", "round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue", "count(*) AS line_count")
    return q.group_by("r_name", "l_returnflag").having("count(*) > :n", {"n": 10}).to_df()


@query("SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS largest FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def group_having(spark, sf_dir):
    return Query(table(spark, sf_dir, "orders")).select("o_custkey", "count(*) AS orders", "max(o_totalprice) AS largest").group_by("o_custkey").having("orders >= 12").to_df()


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET 25")
def order_limit_offset(spark, sf_dir):
    return Query(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", "l_quantity").order_by("l_quantity", "DESC").order_by("l_orderkey").order_by("l_linenumber").limit(50).offset(25).to_df()


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def topk_latest(spark, sf_dir):
    return dml.last_wins(table(spark, sf_dir, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate")


# changes
@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'RISK' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_where(spark, sf_dir):
    return dml.update(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), {"c_mktsegment": "RISK"}, Conditions().where("c_acctbal", "<", 0.0)).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'big' WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def update_if(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return dml.update(df, {"o_orderpriority": "done"}, Conditions().where("o_orderstatus", "=", "F"), [("o_totalprice > 200000", {"o_orderpriority": "big"})]).select("o_orderkey", "o_orderpriority")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL VALUES (100, 'ATLANTIS', 1), (101, 'UTOPIA', NULL)")
def insert_batch(spark, sf_dir):
    return dml.insert_rows(table(spark, sf_dir, "nation"), {"n_nationkey": [100, 101], "n_name": ["ATLANTIS", "UTOPIA"], "n_regionkey": [1, None]})


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 1")
def insert_select(spark, sf_dir):
    new = Query(table(spark, sf_dir, "customer")).select("c_custkey", "c_name").where("c_nationkey", "=", 1).to_df()
    return dml.insert_from(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), new)


@query("SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def upsert_first_wins(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("v"))
    return dml.upsert_first_wins(old, new, ["k"], F.col("v"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'published' WHEN o_orderkey % 5 = 0 THEN 'updated' ELSE 'skipped' END AS action FROM orders"""
)
def publish_actions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("contenthash"), F.lit("main").alias("branch"))
    old = o.where("o_orderkey % 3 <> 0").withColumn("branch", F.when(F.col("o_orderkey") % 5 == 0, "old").otherwise("main"))
    return dml.publish(old, o, "contenthash", "branch").select("o_orderkey", "action")


# de-identification
SCHEMA = {"id": "id", "first_name": "first_name", "last_name": "last_name", "dob": "dob", "gender": "gender", "zip": "zip"}
DERIVED = {"zip_str": {"from": "zip", "transform": "stringify"}, "dob_parsed": {"from": "dob", "transform": "date_parse(%m/%d/%Y)"}, "dob_year": {"from": "dob_parsed", "transform": "year"}, "dob_month": {"from": "dob_parsed", "transform": "month"}}
RECIPES = {
    "token_1": {"version": "v1", "family": "strict", "parts": ["masked_id", "last_name", "dob_year"]},
    "token_2": {"version": "v1", "family": "strict", "parts": ["first_name:3", "last_name", "gender"]},
    "token_3": {"version": "v2", "family": "loose", "parts": ["gender", "zip_str:2"]},
    "token_4": {"version": "v3", "family": "loose", "parts": ["gender"]},
    "token_5": {"version": "v2", "family": "off", "parts": ["zip_str"]},
}
_PEOPLE = """(SELECT CAST(c_custkey AS VARCHAR) AS id, split_part(c_name, '#', 1) AS first_name, nullif(split_part(c_name, '#', 2), '000000003') AS last_name,
    CASE WHEN c_custkey % 10 = 0 THEN '02/30/2001' WHEN c_custkey % 7 = 0 THEN NULL ELSE (1 + c_custkey % 12) || '/' || (1 + c_custkey % 28) || '/' || (1950 + c_custkey % 50) END AS dob,
    c_mktsegment AS gender, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip FROM customer)"""
_DATE = "CASE WHEN dob = '02/30/2001' OR dob IS NULL THEN NULL ELSE make_date(CAST(split_part(dob, '/', 3) AS INT), CAST(split_part(dob, '/', 1) AS INT), CAST(split_part(dob, '/', 2) AS INT)) END"
_HEX_KEY = {c: bytes(b ^ c for b in KEY.ljust(64, b"\0")) for c in (0x36, 0x5C)}


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k, s = F.col("c_custkey"), lambda x: x.cast("string")
    dob = F.when(k % 10 == 0, "02/30/2001").when(k % 7 == 0, F.lit(None)).otherwise(F.concat_ws("/", s(k % 12 + 1), s(k % 28 + 1), s(k % 50 + 1950)))
    return c.select(s(k).alias("id"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"), F.nullif(F.split_part("c_name", F.lit("#"), F.lit(2)), F.lit("000000003")).alias("last_name"), dob.alias("dob"), F.col("c_mktsegment").alias("gender"), F.lpad(s(F.col("c_nationkey")), 5, "0").alias("zip"))


@query(f"SELECT id, coalesce(zip, '') AS zip_str, coalesce(CAST(year(d) AS VARCHAR), '') AS dob_year, coalesce(CAST(month(d) AS VARCHAR), '') AS dob_month FROM (SELECT *, {_DATE} AS d FROM {_PEOPLE})")
def derived_fields(spark, sf_dir):
    return deid.derived_fields(people(spark, sf_dir), SCHEMA, DERIVED).select("id", "zip_str", "dob_year", "dob_month")


@query(f"SELECT id, CAST({_DATE} AS TIMESTAMP) AS parsed FROM {_PEOPLE}")
def date_parse(spark, sf_dir):
    return people(spark, sf_dir).select("id", text.parse_date(F.col("dob"), "%m/%d/%Y").alias("parsed"))


@query(f"SELECT id, substr(coalesce(last_name, ''), 1, 4) AS part FROM {_PEOPLE}")
def prefix_part(spark, sf_dir):
    df = people(spark, sf_dir)
    return df.select("id", deid.part("last_name:4", SCHEMA, df.columns).alias("part"))


_CODES = f"translate(regexp_replace(upper(w), '[^A-Z]', '0', 'g'), 'AEIOUYBFPVCGJKQSXZDTLMNRHW', '{'0' * 6}{'1' * 4}{'2' * 8}33455677')"
_SOUNDEX = """(SELECT w, upper(w[1]) || rpad(array_to_string([l[i] FOR i IN range(2, len(l) + 1) IF l[i] <> l[i - 1] AND l[i] <> '0'][1:3], ''), 3, '0') AS code FROM (
    SELECT w, string_split(CASE WHEN c[1] = '7' THEN '9' ELSE c[1] END || replace(c[2:], '7', ''), '') AS l FROM (SELECT w, %s AS c FROM (SELECT DISTINCT p_type AS w FROM part UNION SELECT n_name FROM nation))))""" % _CODES


@query(f"SELECT p_partkey, code FROM part JOIN {_SOUNDEX} ON w = p_type")
def soundex_part(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.soundex_part(F.col("p_type")).alias("code"))


@query(f"SELECT n_name, code FROM nation JOIN {_SOUNDEX} ON w = n_name")
def soundex_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", text.soundex_part(F.col("n_name")).alias("code"))


def _hmac_sql(message: str) -> str:
    """Hexadecimal HMAC-SHA256 of an ASCII message in SQL."""
    inner = f"sha256(unhex('{_HEX_KEY[0x36].hex()}') || encode({message}))"
    return f"sha256(unhex('{_HEX_KEY[0x5C].hex()}') || unhex({inner}))"


@query(f"SELECT c_custkey, {_hmac_sql('c_name')} AS mac FROM customer")
def hmac_hex(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", security.hmac_sha256(KEY, F.col("c_name")).alias("mac"))


def masked_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deid.derived_fields(deid.masked_id(people(spark, sf_dir), "id", KEY), SCHEMA, DERIVED)


#: Steps of a long division by 62: the limbs of 32 bits that a 256-bit number leaves, and the digit.
_LIMBS = ", ".join(f"CAST('0x' || substr(mac, {1 + 8 * i}, 8) AS BIGINT) AS l{i}" for i in range(8))
_CARRY = ", ".join(["l0 % 62 AS r0", *(f"(r{i - 1} * 4294967296 + l{i}) % 62 AS r{i}" for i in range(1, 8))])
_DIVIDED = ", ".join(["l0 // 62 AS l0", *(f"(r{i - 1} * 4294967296 + l{i}) // 62 AS l{i}" for i in range(1, 8))])
_REST = " + ".join(f"l{i}" for i in range(8))


def _token_sql(rows: str, label: str, payload: str, length: int) -> str:
    """key and token of rows (key, ...): the HMAC of label and payload in base 62, the first digits of it."""
    return f"""(WITH RECURSIVE macs AS (SELECT key, {_hmac_sql(f"'{label}||' || {payload}")} AS mac FROM {rows}),
    turns AS (SELECT key, {_LIMBS}, '' AS digits FROM macs UNION ALL
        SELECT key, {_DIVIDED}, substr('{security.DIGITS}', CAST(r7 AS BIGINT) + 1, 1) || digits AS digits FROM (SELECT *, {_CARRY} FROM turns WHERE {_REST} > 0))
    SELECT key, substr(CASE WHEN digits = '' THEN '0' ELSE digits END, 1, {length}) AS token FROM turns WHERE {_REST} = 0)"""


_MASKED = _token_sql(f"(SELECT id AS key, id FROM {_PEOPLE})", deid.MASK_LABEL, "id", 22)
_TOKENS = {
    "token_1": ("v1", "strict", f"(SELECT id AS key, token || coalesce(last_name, '') || coalesce(CAST(year({_DATE}) AS VARCHAR), '') AS raw FROM {_PEOPLE} p JOIN {_MASKED} m ON p.id = m.key)"),
    "token_2": ("v1", "strict", f"(SELECT id AS key, substr(first_name, 1, 3) || coalesce(last_name, '') || gender AS raw FROM {_PEOPLE})"),
    "token_3": ("v2", "loose", f"(SELECT id AS key, gender || substr(zip, 1, 2) AS raw FROM {_PEOPLE})"),
}


@query(f"SELECT key AS id, token AS masked_id FROM {_MASKED}")
def masked_id(spark, sf_dir):
    return masked_people(spark, sf_dir).select("id", "masked_id")


@query(" UNION ALL ".join(f"SELECT key AS tokenid, '{name}' AS token_name, '{version}' AS token_version, '{family}' AS token_family, token AS token_hash FROM {_token_sql(rows, name, 'raw', 43)}" for name, (version, family, rows) in _TOKENS.items()))
def deid_tokens(spark, sf_dir):
    return deid.build_tokens(masked_people(spark, sf_dir), SCHEMA, RECIPES, KEY, ["v1", "v2"], {"strict": True, "loose": True}, id_column="id")


@query(
    f"""SELECT token_name, token_version, token_family, count(*) AS n, count(DISTINCT raw) AS hashes FROM (
    SELECT 'token_1' AS token_name, 'v1' AS token_version, 'strict' AS token_family, id AS raw FROM {_PEOPLE}
    UNION ALL SELECT 'token_2', 'v1', 'strict', substr(first_name, 1, 3) || coalesce(last_name, '') || gender FROM {_PEOPLE}
    UNION ALL SELECT 'token_3', 'v2', 'loose', gender || substr(zip, 1, 2) FROM {_PEOPLE}) GROUP BY ALL"""
)
def tokens_by_recipe(spark, sf_dir):
    return deid_tokens(spark, sf_dir).groupBy("token_name", "token_version", "token_family").agg(F.count("*").alias("n"), F.count_distinct("token_hash").alias("hashes"))


@query(f"SELECT id, CAST(first_name IS NOT NULL AS INT) AS first_name, CAST(last_name IS NOT NULL AS INT) AS last_name, CAST(dob IS NOT NULL AS INT) AS dob, CAST(gender IS NOT NULL AS INT) AS gender, CAST(zip IS NOT NULL AS INT) AS zip, 0 AS email, year({_DATE}) AS birth_year FROM {_PEOPLE}")
def presence_mask(spark, sf_dir):
    fields = {k: v for k, v in SCHEMA.items() if k != "id"} | {"email": "email"}
    return deid.presence_mask(people(spark, sf_dir), fields, "dob")


@query(f"SELECT id, 'T' || CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN id ELSE 'new' || id END AS tokenid FROM {_PEOPLE}")
def token_crosswalk(spark, sf_dir):
    df = masked_people(spark, sf_dir).select("id", "masked_id")
    old = df.where(F.col("id").cast("long") % 2 == 0).select("id", "masked_id", F.concat(F.lit("T"), "id").alias("tokenid"))
    return deid.with_token_ids(df, old, F.concat(F.lit("Tnew"), "id"))[0].select("id", "tokenid")


# identity resolution over tokens derived from customers
_TOKENS = """(SELECT 'T' || c_custkey AS tokenid, 'token_' || CASE WHEN c_nationkey % 3 = 0 THEN 'x' ELSE CAST(c_nationkey % 3 AS VARCHAR) END AS token_name,
    CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'missing token' WHEN c_custkey % 17 = 0 THEN 'aXXXb' ELSE c_mktsegment || c_nationkey END AS token_hash FROM customer)"""
_ORDERED = f"(SELECT *, CAST(nullif(regexp_extract(token_name, '_([0-9]+)$', 1), '') AS INT) AS token_order FROM {_TOKENS})"
_CROSS = "(SELECT 'T' || c_custkey AS tokenid, 'D' || (c_custkey - c_custkey % 5) AS detokenid, TIMESTAMP '2020-01-01' + INTERVAL 1 DAY * (c_custkey % 400) AS startdate, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2023-01-01' END AS enddate FROM customer WHERE c_custkey % 3 = 0)"
_CLEAN = f"(SELECT tokenid, token_name, token_order, CASE WHEN upper(token_hash) NOT LIKE '%XXX%' THEN token_hash END AS token_hash, coalesce(startdate, TIMESTAMP '{NOW}') AS create_date FROM {_ORDERED} LEFT JOIN (SELECT tokenid, max(startdate) AS startdate FROM {_CROSS} GROUP BY tokenid) USING (tokenid) WHERE tokenid NOT IN (SELECT 'T' || c_custkey FROM customer WHERE c_custkey % 29 = 0))"
_ALT = f"""(SELECT c.*, CASE WHEN first_id <> tokenid AND first_order IS NOT DISTINCT FROM token_order AND c.token_hash IS NOT NULL AND lower(c.token_hash) <> 'missing token' THEN first_id END AS alt_tokenid FROM {_CLEAN} c
    LEFT JOIN (SELECT token_hash, tokenid AS first_id, token_order AS first_order FROM (SELECT *, row_number() OVER (PARTITION BY token_hash ORDER BY create_date, tokenid DESC) AS n FROM {_CLEAN} WHERE token_hash IS NOT NULL AND lower(token_hash) <> 'missing token') WHERE n = 1) f ON c.token_hash = f.token_hash)"""
_BEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tokenid ORDER BY alt_tokenid IS NULL, alt_tokenid, coalesce(token_order, 999999), create_date, token_hash NULLS LAST) AS n FROM {_ALT}) WHERE n = 1)"
_KNOWN = f"(SELECT tokenid, detokenid FROM {_CROSS} WHERE enddate IS NULL)"
_STEP = f"(SELECT b.tokenid, b.token_hash, b.token_order, b.alt_tokenid, coalesce(a.detokenid, o.detokenid, CASE WHEN b.alt_tokenid IS NULL THEN 'N' || b.tokenid END) AS detokenid FROM {_BEST} b LEFT JOIN {_KNOWN} a ON a.tokenid = b.alt_tokenid LEFT JOIN {_KNOWN} o ON o.tokenid = b.tokenid)"
_RESOLVED = f"(SELECT s.tokenid, s.token_hash, s.token_order, s.alt_tokenid, coalesce(s.detokenid, t.detokenid) AS detokenid FROM {_STEP} s LEFT JOIN {_STEP} t ON t.tokenid = s.alt_tokenid)"


def token_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    name = F.concat(F.lit("token_"), F.when(n % 3 == 0, "x").otherwise((n % 3).cast("string")))
    value = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, "missing token").when(k % 17 == 0, "aXXXb").otherwise(F.concat("c_mktsegment", n.cast("string")))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("T"), k.cast("string")).alias("tokenid"), name.alias("token_name"), value.alias("token_hash"))


def token_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    start = F.timestamp_add("DAY", (k % 400).cast("int"), F.lit("2020-01-01").cast("timestamp"))
    end = F.when(k % 4 == 0, F.lit("2023-01-01").cast("timestamp"))
    return table(spark, sf_dir, "customer").where(k % 3 == 0).select(F.concat(F.lit("T"), k.cast("string")).alias("tokenid"), F.concat(F.lit("D"), (k - k % 5).cast("string")).alias("detokenid"), start.alias("startdate"), end.alias("enddate"))


def unmergeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 29 = 0").select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("tokenid"))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identity.without_invalid(identity.with_order(identity.token_rows(token_facts(spark, sf_dir))))
    return identity.with_create_date(identity.without_unmergeable(rows, unmergeable(spark, sf_dir)), token_intervals(spark, sf_dir), now())


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = identity.best_rows(identity.with_alternative(dated(spark, sf_dir)))
    return identity.with_identity(best, token_intervals(spark, sf_dir), F.concat(F.lit("N"), "tokenid"))


@query(f"SELECT tokenid, token_name, token_order FROM {_ORDERED}")
def r2_order(spark, sf_dir):
    return identity.with_order(token_facts(spark, sf_dir)).select("tokenid", "token_name", "token_order")


@query(f"SELECT tokenid, CASE WHEN upper(token_hash) NOT LIKE '%XXX%' THEN token_hash END AS token_hash FROM {_TOKENS}")
def r3_invalid(spark, sf_dir):
    return identity.without_invalid(token_facts(spark, sf_dir)).select("tokenid", "token_hash")


@query(f"SELECT tokenid FROM {_TOKENS} WHERE tokenid NOT IN (SELECT 'T' || c_custkey FROM customer WHERE c_custkey % 29 = 0)")
def r4_unmergeable(spark, sf_dir):
    return identity.without_unmergeable(token_facts(spark, sf_dir), unmergeable(spark, sf_dir)).select("tokenid")


@query(f"SELECT tokenid, create_date FROM {_CLEAN}")
def r5_create_date(spark, sf_dir):
    return dated(spark, sf_dir).select("tokenid", "create_date")


@query(f"SELECT tokenid, alt_tokenid FROM {_ALT}")
def r6_alternative(spark, sf_dir):
    return identity.with_alternative(dated(spark, sf_dir)).select("tokenid", "alt_tokenid")


@query(f"SELECT tokenid, alt_tokenid, token_order, token_hash FROM {_BEST}")
def r7_best(spark, sf_dir):
    return identity.best_rows(identity.with_alternative(dated(spark, sf_dir))).select("tokenid", "alt_tokenid", "token_order", "token_hash")


@query(f"SELECT tokenid, detokenid FROM {_RESOLVED}")
def r8_identity(spark, sf_dir):
    return resolved(spark, sf_dir).select("tokenid", "detokenid")


@query(f"SELECT tokenid, 'M' || tokenid AS detokenid FROM (SELECT 'T' || c_custkey AS tokenid FROM customer) WHERE tokenid NOT IN (SELECT tokenid FROM {_CROSS}) AND (tokenid NOT IN (SELECT tokenid FROM {_RESOLVED} WHERE CAST(substr(tokenid, 2) AS INT) % 4 = 0) OR CAST(substr(tokenid, 2) AS INT) % 29 = 0)")
def r9_missing(spark, sf_dir):
    every = token_facts(spark, sf_dir)
    done = resolved(spark, sf_dir).where("cast(substr(tokenid, 2) as int) % 4 = 0")
    return identity.missing_tokens(every, done, unmergeable(spark, sf_dir), token_intervals(spark, sf_dir), F.concat(F.lit("M"), "tokenid"))


@query(f"SELECT tokenid, token_hash, token_order, max(detokenid) AS detokenid FROM {_RESOLVED} GROUP BY tokenid, token_hash, token_order")
def r10_mapping(spark, sf_dir):
    return identity.new_mapping(resolved(spark, sf_dir))


@query(f"SELECT DISTINCT detokenid, token_hash, token_order FROM {_RESOLVED} WHERE detokenid IS NOT NULL")
def r11_hashes(spark, sf_dir):
    mapping = identity.new_mapping(resolved(spark, sf_dir))
    old = mapping.where("detokenid is not null and token_order = 1").select("detokenid", "token_hash", "token_order").distinct()
    return identity.upsert_hashes(old, mapping)


_NEW_PAIRS = f"SELECT DISTINCT r.tokenid, r.detokenid, TIMESTAMP '{NOW}' AS startdate, CAST(NULL AS TIMESTAMP) AS enddate FROM {_RESOLVED} r WHERE r.detokenid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_CROSS} c WHERE c.tokenid = r.tokenid AND c.detokenid = r.detokenid)"


@query(f"SELECT tokenid, detokenid, startdate, enddate FROM {_CROSS} UNION ALL {_NEW_PAIRS}")
def r12_tokens(spark, sf_dir):
    return identity.upsert_tokens(token_intervals(spark, sf_dir), identity.new_mapping(resolved(spark, sf_dir)), now())


_CLOSED = f"(SELECT tokenid, detokenid, startdate, CASE WHEN enddate IS NULL AND row_number() OVER (PARTITION BY tokenid ORDER BY startdate DESC, detokenid DESC) > 1 THEN TIMESTAMP '{NOW}' ELSE enddate END AS enddate FROM (SELECT * FROM {_CROSS} UNION ALL {_NEW_PAIRS}))"


def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.close_intervals(r12_tokens(spark, sf_dir), now())


@query(f"SELECT tokenid, detokenid, startdate, enddate FROM {_CLOSED}")
def r14_intervals(spark, sf_dir):
    return closed(spark, sf_dir)


@query(f"SELECT e.tokenid, e.detokenid AS old_detokenid, c.detokenid AS new_detokenid, e.enddate AS merge_dt FROM {_CLOSED} e LEFT JOIN (SELECT tokenid, detokenid FROM {_CLOSED} WHERE enddate IS NULL) c ON c.tokenid = e.tokenid WHERE e.enddate IS NOT NULL")
def r15_history(spark, sf_dir):
    empty = spark.createDataFrame([], "tokenid string, old_detokenid string, new_detokenid string, merge_dt timestamp")
    return identity.merge_history(empty, closed(spark, sf_dir))


@query(
    f"""SELECT detokenid, CAST(row_number() OVER (ORDER BY detokenid) AS BIGINT) AS id FROM (SELECT DISTINCT detokenid FROM {_CLOSED} WHERE detokenid LIKE 'D1%')
    UNION ALL SELECT detokenid, (SELECT count(DISTINCT detokenid) FROM {_CLOSED} WHERE detokenid LIKE 'D1%') + row_number() OVER (ORDER BY first, detokenid) FROM (SELECT detokenid, min(startdate) AS first FROM {_CLOSED} WHERE detokenid NOT LIKE 'D1%' GROUP BY detokenid)"""
)
def r16_person_ids(spark, sf_dir):
    with_checkpoints(spark)
    rows = closed(spark, sf_dir).checkpoint()
    final = numbered(rows.where("detokenid like 'D1%'").select("detokenid").distinct(), F.col("detokenid"), into="id")
    return identity.person_ids(final, rows)


def _load_sql(n: int, load: str, now: str) -> str:
    """The state tables of number n, made of those of number n - 1 by a load of tokens."""
    p = n - 1
    valid = "token_hash IS NOT NULL AND lower(token_hash) <> 'missing token'"
    return f"""clean_{n} AS (SELECT tokenid, token_order, CASE WHEN upper(token_hash) NOT LIKE '%XXX%' THEN token_hash END AS token_hash, coalesce(startdate, TIMESTAMP '{now}') AS create_date
        FROM (SELECT * FROM {_ORDERED} WHERE {load}) LEFT JOIN (SELECT tokenid, max(startdate) AS startdate FROM tokens_{p} GROUP BY tokenid) USING (tokenid) WHERE tokenid NOT IN (SELECT tokenid FROM unmergeable)),
    alt_{n} AS (SELECT c.*, CASE WHEN first_id <> tokenid AND first_order IS NOT DISTINCT FROM token_order AND {valid.replace("token_hash", "c.token_hash")} THEN first_id END AS alt_tokenid FROM clean_{n} c
        LEFT JOIN (SELECT token_hash, tokenid AS first_id, token_order AS first_order FROM (SELECT *, row_number() OVER (PARTITION BY token_hash ORDER BY create_date, tokenid DESC) AS i FROM clean_{n} WHERE {valid}) WHERE i = 1) f ON c.token_hash = f.token_hash),
    known_{n} AS (SELECT tokenid, arg_max(detokenid, startdate) AS detokenid FROM tokens_{p} WHERE enddate IS NULL GROUP BY tokenid),
    step_{n} AS (SELECT b.*, coalesce(a.detokenid, o.detokenid, CASE WHEN b.alt_tokenid IS NULL THEN 'N{n}' || b.tokenid END) AS detokenid FROM alt_{n} b LEFT JOIN known_{n} a ON a.tokenid = b.alt_tokenid LEFT JOIN known_{n} o ON o.tokenid = b.tokenid),
    found_{n} AS MATERIALIZED (SELECT s.tokenid, s.token_hash, s.token_order, coalesce(s.detokenid, t.detokenid) AS detokenid FROM step_{n} s LEFT JOIN step_{n} t ON t.tokenid = s.alt_tokenid),
    missing_{n} AS (SELECT tokenid, 'M{n}' || tokenid AS detokenid FROM unmergeable WHERE tokenid NOT IN (SELECT tokenid FROM tokens_{p})),
    pairs_{n} AS (SELECT DISTINCT tokenid, detokenid FROM found_{n} WHERE detokenid IS NOT NULL AND (tokenid, detokenid) NOT IN (SELECT (tokenid, detokenid) FROM tokens_{p}) UNION ALL SELECT * FROM missing_{n}),
    open_{n} AS (SELECT * FROM tokens_{p} UNION ALL SELECT *, TIMESTAMP '{now}', NULL FROM pairs_{n}),
    tokens_{n} AS MATERIALIZED (SELECT tokenid, detokenid, startdate, CASE WHEN enddate IS NULL AND row_number() OVER (PARTITION BY tokenid ORDER BY startdate DESC, detokenid DESC) > 1 THEN TIMESTAMP '{now}' ELSE enddate END AS enddate FROM open_{n}),
    hashes_{n} AS MATERIALIZED (SELECT * FROM hashes_{p} UNION ALL (SELECT detokenid, token_hash, token_order FROM found_{n} WHERE detokenid IS NOT NULL UNION SELECT detokenid, NULL, NULL FROM missing_{n} EXCEPT SELECT * FROM hashes_{p})),
    ended_{n} AS (SELECT tokenid, old_detokenid, new_detokenid, merge_dt FROM history_{p} UNION ALL SELECT tokenid, detokenid, NULL, enddate FROM tokens_{n} WHERE enddate IS NOT NULL AND (tokenid, detokenid) NOT IN (SELECT (tokenid, old_detokenid) FROM history_{p})),
    history_{n} AS MATERIALIZED (SELECT e.tokenid, e.old_detokenid, coalesce(c.detokenid, e.new_detokenid) AS new_detokenid, e.merge_dt FROM ended_{n} e LEFT JOIN (SELECT tokenid, detokenid FROM tokens_{n} WHERE enddate IS NULL) c USING (tokenid)),
    persons_{n} AS MATERIALIZED (SELECT * FROM persons_{p} UNION ALL SELECT detokenid, (SELECT coalesce(max(id), 0) FROM persons_{p}) + row_number() OVER (ORDER BY first NULLS LAST, detokenid) FROM (SELECT detokenid, min(startdate) AS first FROM tokens_{n} GROUP BY detokenid) WHERE detokenid NOT IN (SELECT detokenid FROM persons_{p}))"""


_LOADS = [("CAST(substr(tokenid, 2) AS INT) % 2 = 0", "2024-01-01 00:00:00"), ("true", NOW)]
_STATE_OF = " UNION ALL ".join(
    f"""SELECT {v} AS version, 'tokens' AS part, tokenid, detokenid, NULL::VARCHAR AS other, startdate AS began, enddate AS ended, NULL::BIGINT AS number FROM tokens_{v}
    UNION ALL SELECT {v}, 'history', tokenid, old_detokenid, new_detokenid, merge_dt, NULL, NULL FROM history_{v} UNION ALL SELECT {v}, 'persons', NULL, detokenid, NULL, NULL, NULL, id FROM persons_{v} UNION ALL SELECT {v}, 'hashes', NULL, detokenid, token_hash, NULL, NULL, token_order FROM hashes_{v}"""
    for v in range(1, len(_LOADS) + 2)
)


@query(
    f"""WITH unmergeable AS (SELECT 'T' || c_custkey AS tokenid FROM customer WHERE c_custkey % 29 = 0), tokens_1 AS (SELECT * FROM {_CROSS}),
    hashes_1 AS (SELECT NULL::VARCHAR AS detokenid, NULL::VARCHAR AS token_hash, NULL::INT AS token_order WHERE false), history_1 AS (SELECT NULL::VARCHAR AS tokenid, NULL::VARCHAR AS old_detokenid, NULL::VARCHAR AS new_detokenid, NULL::TIMESTAMP AS merge_dt WHERE false), persons_1 AS (SELECT NULL::VARCHAR AS detokenid, NULL::BIGINT AS id WHERE false),
    {", ".join(_load_sql(n, *load) for n, load in enumerate(_LOADS, 2))} {_STATE_OF}"""
)
def detoken_runs(spark, sf_dir):
    """Two loads of tokens over an old crosswalk, the second with more tokens, each kept as a version of all state
    tables; what each version holds."""
    store = versions.SnapshotSet(spark, folder(spark, "detoken"))
    store.write([(name, lambda _, name=name, columns=columns: token_intervals(spark, sf_dir) if name == "token_crosswalk" else spark.createDataFrame([], columns)) for name, columns in identity.STATE.items()])
    for n, (load, at) in enumerate(_LOADS, 2):
        tokens = token_facts(spark, sf_dir).where(load)
        identity.load(store, tokens, unmergeable(spark, sf_dir), F.lit(at).cast("timestamp"), F.concat(F.lit(f"N{n}"), "tokenid"), F.concat(F.lit(f"M{n}"), "tokenid"))
    out = None
    for v in store.versions():
        none = lambda kind: F.lit(None).cast(kind)
        parts = {
            "tokens": ("token_crosswalk", "tokenid", "detokenid", none("string"), "startdate", "enddate", none("long")),
            "history": ("merge_history", "tokenid", "old_detokenid", "new_detokenid", "merge_dt", none("timestamp"), none("long")),
            "persons": ("final_crosswalk", none("string"), "detokenid", none("string"), none("timestamp"), none("timestamp"), "id"),
            "hashes": ("detoken_crosswalk", none("string"), "detokenid", "token_hash", none("timestamp"), none("timestamp"), F.col("token_order").cast("long")),
        }
        for part, (name, *columns) in parts.items():
            rows = store.read(name, v).select(F.lit(v).alias("version"), F.lit(part).alias("part"), *[(F.col(c) if isinstance(c, str) else c).alias(a) for c, a in zip(columns, ("tokenid", "detokenid", "other", "began", "ended", "number"), strict=True)])
            out = rows if out is None else out.union(rows)
    return out


# masking and text
_SECRET = "'user=u' || c_custkey || ';Password=p' || c_custkey || ';db=x'"


@query(f"SELECT c_custkey, 'user=u' || c_custkey || ';Password=****;db=x' AS masked FROM customer")
def mask_kv(spark, sf_dir):
    raw = F.concat(F.lit("user=u"), F.col("c_custkey").cast("string"), F.lit(";Password=p"), F.col("c_custkey").cast("string"), F.lit(";db=x"))
    return table(spark, sf_dir, "customer").select("c_custkey", security.masked(raw).alias("masked"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'postgres://u:****@h:5432/db?x=1' ELSE 'postgres://h/db' END AS masked FROM customer")
def mask_url(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("postgres://u:"), F.col("c_name"), F.lit("@h:5432/db?x=1"))).otherwise("postgres://h/db")
    return table(spark, sf_dir, "customer").select("c_custkey", security.masked(raw).alias("masked"))


@query("""SELECT doc_id, regexp_replace(text, '(?i)\\b(token|secret|api_?key|access_?key)(\\s*[:=]\\s*)("?)([^\\s";&,]+)("?)', '\\1\\2\\3****\\5', 'g') AS masked FROM documents WHERE regexp_matches(text, '(?i)\\b(token|secret|api_?key|access_?key)(\\s*[:=]\\s*)("?)([^\\s";&,]+)("?)')""")
def mask_text(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", security.masked_text(F.col("text"), security.ASSIGNED).alias("masked"))
    return found.where("masked is not null")


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.without_fragment(F.col("url")).alias("url"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query FROM pages")
def url_parts(spark, sf_dir):
    p = text.url_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", p["scheme"].alias("scheme"), p["host"].alias("host"), p["path"].alias("path"), p["query"].alias("query"))


@query("SELECT page_id, regexp_matches(html, '<[a-zA-Z!/][^>]*>') AS is_html FROM pages")
def is_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.is_html(F.col("html")).alias("is_html"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower('  ' || p_type || ',  ' || p_name), '\\s+', ' ', 'g'), '[^\\w\\s]', '', 'g')) AS norm FROM part")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalized(F.concat(F.lit("  "), "p_type", F.lit(",  "), "p_name")).alias("norm"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\b(?:the|and)\\b') THEN 'english' WHEN regexp_matches(text, '(?i)\\b(?:der|und)\\b') THEN 'german' ELSE 'other' END AS provider FROM conversations")
def prompt_routing(spark, sf_dir):
    rules = [("english", ["the", "and"]), ("german", ["der", "und"])]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.routed(F.col("text"), rules, "other").alias("provider"))


@query("SELECT o_orderkey, count(d) AS weekdays FROM (SELECT o_orderkey, unnest(generate_series(CAST(o_orderdate AS DATE) + 1, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT), INTERVAL 1 DAY)) AS d FROM orders) WHERE isodow(d) < 6 GROUP BY o_orderkey")
def weekdays(spark, sf_dir):
    day = F.to_date("o_orderdate")
    found = F.size(text.weekdays_after(day, F.date_add(day, (F.col("o_orderkey") % 30).cast("int"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", found.cast("long").alias("weekdays")).where("weekdays > 0")


@query("SELECT c_custkey, 'file_' || c_custkey || '_conflict_20240101' || CASE WHEN c_custkey % 2 = 0 THEN '.txt' ELSE '' END AS name FROM customer")
def conflict_names(spark, sf_dir):
    name = F.concat(F.lit("file_"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".txt").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", text.conflict_name(name, F.lit("20240101")).alias("name"))


@query("SELECT l_orderkey, l_linenumber, abs(l_extendedprice * (1 - l_discount) - l_extendedprice + l_extendedprice * l_discount) <= greatest(1e-9 * greatest(abs(l_extendedprice * (1 - l_discount)), abs(l_extendedprice - l_extendedprice * l_discount)), 0.001) AS same, l_tax BETWEEN 0.02 AND 0.05 AS in_range FROM lineitem")
def numeric_checks(spark, sf_dir):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", assertions.equal(price * (1 - discount), price - price * discount, 0.001).alias("same"), assertions.in_range(F.col("l_tax"), 0.02, 0.05).alias("in_range"))


@query("SELECT p_partkey, lower(p_brand) = lower(p_brand) AS same, contains(lower(p_type), 'steel') AS steel FROM part")
def text_checks(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", assertions.same_text(F.col("p_brand"), F.upper("p_brand")).alias("same"), assertions.contains(F.col("p_type"), F.lit("STEEL")).alias("steel"))


_PAIRS = "(SELECT p_partkey, lower(p_type) AS a, lower(p_brand || ' ' || p_name) AS b FROM part)"


@query(
    f"""WITH RECURSIVE pairs AS (SELECT DISTINCT a, b FROM {_PAIRS}), rows AS (
    SELECT a, b, 0 AS i, (1::HUGEINT << len(a)) - 1 AS r FROM pairs UNION ALL
    SELECT a, b, i + 1, ((r + u) | (r - u)) & ((1::HUGEINT << len(a)) - 1) FROM (SELECT *, r & coalesce(list_sum([1::HUGEINT << (k - 1) FOR k IN range(1, len(a) + 1) IF a[k] = b[i + 1]])::HUGEINT, 0::HUGEINT) AS u FROM rows WHERE i < len(b))
) SELECT p_partkey, 2 * (len(a) - bit_count(r)) / CAST(len(a) + len(b) AS DOUBLE) AS ratio FROM {_PAIRS} JOIN rows USING (a, b) WHERE i = len(b)"""
)
def text_similarity(spark, sf_dir):
    other = F.lower(F.concat("p_brand", F.lit(" "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", assertions.similarity(F.lower("p_type"), other).alias("ratio"))


@query("SELECT vec_id, CASE WHEN list_max([abs(x) FOR x IN embedding]) > 0.98 THEN 'clipped' WHEN sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding]) / len(embedding)) < 0.01 THEN 'too_quiet' ELSE 'ok' END AS quality FROM embeddings")
def audio_quality(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", assertions.audio_quality(F.col("embedding"), 16).alias("quality"))


# reshaping
@query("SELECT vec_id, CAST(position AS INT) AS position, component, doubled FROM (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS position, unnest(embedding) AS component, unnest([x * 2 FOR x IN embedding]) AS doubled FROM embeddings)")
def columns_to_rows(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("component"), F.transform("embedding", lambda x: (x * 2).cast("float")).alias("doubled"))
    return reshape.columns_to_rows(df, ["component", "doubled"])


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys, list(coalesce(nullif(o_orderstatus, 'F'), '?') ORDER BY o_orderkey) AS states FROM orders GROUP BY o_custkey")
def rows_to_columns(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("states"), F.col("o_orderkey").cast("string").alias("keys"))
    out = reshape.rows_to_columns(df, ["o_custkey"], "o_orderkey", ["keys", "states"], "?")
    return out.withColumn("keys", F.transform("keys", lambda k: k.cast("long")))


@query("SELECT field, max(CASE WHEN s = 'F' THEN v END) AS f, max(CASE WHEN s = 'O' THEN v END) AS o FROM (SELECT 'orders' AS field, o_orderstatus AS s, count(*) AS v FROM orders GROUP BY 2 UNION ALL SELECT 'customers', o_orderstatus, count(DISTINCT o_custkey) FROM orders GROUP BY 2) GROUP BY field")
def transpose(spark, sf_dir):
    df = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"))
    return reshape.transpose_table(df, "o_orderstatus", ["F", "O"]).select("field", F.col("F").alias("f"), F.col("O").alias("o"))


@query("SELECT c AS \"column\", count(*) AS rows, 0 AS nulls, true AS near, true AS low, true AS middle FROM lineitem, (VALUES ('l_orderkey'), ('l_extendedprice'), ('l_partkey')) v(c) GROUP BY c")
def merged_profile(spark, sf_dir):
    """Sketches by return flag, merged, held against exact counts and ranks."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_extendedprice", "l_partkey")
    found = reshape.described(reshape.merged(reshape.sketches(li, ["l_returnflag"])))
    exact = reshape.profile(li.drop("l_returnflag"), exact=True).select("column", F.col("distinct").alias("true_distinct"))
    columns = ("l_orderkey", "l_extendedprice", "l_partkey")
    long = li.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])))
    below = long.join(F.broadcast(found.select("column", "quantiles")), "column").groupBy("column").agg(F.avg((F.col("x") <= F.col("quantiles")[1]).cast("double")).alias("rank"), F.min("x").alias("least"))
    rows = found.join(exact, "column").join(below, "column")
    near = F.abs(F.col("distinct") - F.col("true_distinct")) <= 0.05 * F.col("true_distinct")
    return rows.select("column", "rows", "nulls", near.alias("near"), (F.col("quantiles")[0] == F.col("least")).alias("low"), (F.abs(F.col("rank") - 0.5) < 0.05).alias("middle"))


@query("SELECT 'p_brand' AS \"column\", 'string' AS type, count(*) AS rows, count(*) FILTER (p_brand IS NULL) AS nulls, count(DISTINCT p_brand) AS \"distinct\", 'none' AS issue FROM part UNION ALL SELECT 'size', 'int', count(*), count(*) FILTER (p_size = 1), count(DISTINCT nullif(p_size, 1)), CASE WHEN count(*) FILTER (p_size = 1) > 0 THEN 'some null' ELSE 'none' END FROM part")
def table_profile(spark, sf_dir):
    return reshape.profile(table(spark, sf_dir, "part").select("p_brand", F.nullif("p_size", F.lit(1)).alias("size")))


_MARKDOWN = "SELECT c_custkey, unnest([0, 1, 2]) AS position, unnest(['intro of ' || c_name, 'Part A', 'Part A']) AS heading, unnest(['', 'first', 'second']) AS body, unnest(['intro_of_' || lower(replace(c_name, '#', '')) || '.md', 'part_a.md', 'part_a_1.md']) AS file FROM customer"


@query(_MARKDOWN)
def markdown_sections(spark, sf_dir):
    doc = F.concat(F.lit("intro of "), "c_name", F.lit("\n# Part A\nfirst\n# Part A\nsecond"))
    return reshape.markdown_sections(table(spark, sf_dir, "customer").select("c_custkey", doc.alias("text")), "text", "c_custkey")


# roll-ups over events as results
_STATUS = "CASE event_type WHEN 'view' THEN 'passed' WHEN 'click' THEN 'passed' WHEN 'signup' THEN 'skipped' WHEN 'purchase' THEN 'failed' ELSE 'error' END"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"view": "passed", "click": "passed", "signup": "skipped", "purchase": "failed"}
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.lit("error"))
    message = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("ValueError: bad "), "event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("KeyError: x: y "), "event_type"))
    return table(spark, sf_dir, "events").withColumns({"status": status, "message": message})


@query(f"SELECT user_id, count(*) AS total, count(*) FILTER (s = 'passed') AS passed, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'error') AS errored, count(*) FILTER (s = 'skipped') AS skipped, coalesce(count(*) FILTER (s = 'passed') * 100.0::DOUBLE / nullif(count(*) FILTER (s <> 'skipped'), 0), 0.0) AS success_rate FROM (SELECT *, {_STATUS} AS s FROM events) GROUP BY user_id")
def status_rollup(spark, sf_dir):
    return rollups.status_counts(results(spark, sf_dir), "status", ["user_id"])


@query(f"SELECT event_id, failure_class, row_number() OVER (PARTITION BY failure_class ORDER BY event_id) AS number FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'KeyError' ELSE 'Unknown Failure' END AS failure_class FROM (SELECT *, {_STATUS} AS s FROM events) WHERE s IN ('failed', 'error'))")
def failure_groups(spark, sf_dir):
    bad = results(spark, sf_dir).where("status in ('failed', 'error')")
    return rollups.failures_by_class(bad, "message", "event_id").select("event_id", "failure_class", F.col("number").cast("long").alias("number"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN strftime(ts, '%Y%m%d_%H%M%S') || '.' || lpad(CAST(CAST(floor((epoch_us(ts) % 1000000) / 1000) AS BIGINT) AS VARCHAR), 3, '0') || '_' || event_id ELSE 'run' END AS runid FROM events")
def run_id(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("runid", F.when(F.col("event_id") % 4 != 0, "run").when(F.col("event_id") % 8 == 0, " "))
    return rollups.with_run_id(df, "runid", "ts", "event_id").select("event_id", "runid")


@query("SELECT p_name AS name, count(*) AS definitions, list_sort(list(DISTINCT p_brand)) AS modules FROM (SELECT substr(p_name, 1, 6) AS p_name, p_brand FROM part) GROUP BY p_name HAVING count(*) > 1")
def overloads(spark, sf_dir):
    return rollups.overloads(table(spark, sf_dir, "part").select(F.substring("p_name", 1, 6).alias("name"), F.col("p_brand").alias("module")), "name", "module")


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS ok, count(*) FILTER (o_orderstatus = 'F') AS failed, sum(o_orderkey) AS total_ms FROM orders GROUP BY o_orderpriority")
def script_statistics(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("ok", F.col("o_orderstatus") != "F")
    return rollups.script_statistics(df, "ok", "o_orderkey", ["o_orderpriority"])


@query("SELECT o_custkey, count(*) AS tests, count(nullif(o_orderstatus, 'P')) AS ended, count(*) FILTER (o_orderstatus = 'F') AS failed, count(nullif(o_orderstatus, 'P')) = count(*) AS complete FROM orders GROUP BY o_custkey")
def completion(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "passed")
    return rollups.completed(table(spark, sf_dir, "orders").withColumn("status", status), "o_custkey", "status")


# incremental
_LOCAL = "(SELECT 'f' || o_orderkey AS rel_path, o_orderkey % 10 AS mtime, o_orderkey % 4 AS size, 'm' || o_orderkey % 3 AS md5 FROM orders WHERE o_orderkey % 5 <> 0)"
_REMOTE = "(SELECT 'f' || o_orderkey AS rel_path, o_orderkey % 7 AS mtime, o_orderkey % 4 AS size, 'm' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 ELSE 9 END AS md5 FROM orders WHERE o_orderkey % 3 <> 0)"
_ACTION = "CASE WHEN r.rel_path IS NULL THEN CASE WHEN s.rel_path IS NULL THEN 'upload' ELSE 'delete_local' END WHEN l.rel_path IS NULL THEN CASE WHEN s.rel_path IS NULL THEN 'download' ELSE 'delete_remote' END WHEN l.size = r.size AND l.md5 = r.md5 THEN 'refresh' WHEN l.mtime > r.mtime THEN 'remote_conflict' ELSE 'local_conflict' END"
_DIFF = f"SELECT rel_path, {_ACTION} AS action FROM {_LOCAL} l FULL JOIN {_REMOTE} r USING (rel_path) LEFT JOIN (SELECT 'f' || o_orderkey AS rel_path FROM orders WHERE o_orderkey % 11 = 0) s USING (rel_path)"


def index_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("rel_path", F.concat(F.lit("f"), k.cast("string")))
    m = lambda x: F.concat(F.lit("m"), x.cast("string"))
    local = o.where(k % 5 != 0).select("rel_path", (k % 10).alias("mtime"), (k % 4).alias("size"), m(k % 3).alias("md5"))
    remote = o.where(k % 3 != 0).select("rel_path", (k % 7).alias("mtime"), (k % 4).alias("size"), m(F.when(k % 2 == 0, k % 3).otherwise(9)).alias("md5"))
    return sync.index_diff(local, remote, o.where(k % 11 == 0).select("rel_path"))


@query(_DIFF)
def sync_diff(spark, sf_dir):
    return index_actions(spark, sf_dir).select("rel_path", "action")


@query(f"SELECT count(*) FILTER (action = 'upload') AS upload, count(*) FILTER (action = 'download') AS download, count(*) FILTER (action = 'refresh') AS refresh, count(*) FILTER (action = 'local_conflict') AS local_conflict, count(*) FILTER (action = 'remote_conflict') AS remote_conflict FROM ({_DIFF})")
def sync_counts(spark, sf_dir):
    return rollups.action_counts(index_actions(spark, sf_dir), "action", ["upload", "download", "refresh", "local_conflict", "remote_conflict"])


@query(
    """SELECT user_id, arg_max(event_type, ts) AS op, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM (
    SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS starts FROM events)) GROUP BY user_id, burst"""
)
def debounce(spark, sf_dir):
    return sync.debounce(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "2 hours").withColumnRenamed("event_type", "op")


@query("SELECT path, op, count(*) AS n FROM (SELECT 'd' || user_id AS path, 'created' AS op FROM events WHERE event_type = 'click' UNION ALL SELECT 's' || user_id, 'deleted' FROM events WHERE event_type = 'click' UNION ALL SELECT 'd' || user_id, event_type FROM events WHERE event_type <> 'click') GROUP BY path, op")
def split_moves(spark, sf_dir):
    u = F.col("user_id").cast("string")
    df = table(spark, sf_dir, "events").select(F.concat(F.lit("d"), u).alias("path"), F.concat(F.lit("s"), u).alias("src"), F.when(F.col("event_type") == "click", "moved").otherwise(F.col("event_type")).alias("op"), "ts")
    return sync.split_moves(df).groupBy("path", "op").agg(F.count("*").alias("n"))


_HITS = "hits AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


def _fixed_sql(limit: int, columns: str) -> str:
    fresh = "h.t >= r.start + 86400000000"
    return f"""WITH RECURSIVE {_HITS}, runs AS (SELECT user_id, i, event_id, t AS start, 1 AS n FROM hits WHERE i = 1 UNION ALL
    SELECT h.user_id, h.i, h.event_id, CASE WHEN {fresh} THEN h.t ELSE r.start END, CASE WHEN {fresh} THEN 1 ELSE r.n + 1 END FROM runs r JOIN hits h ON h.user_id = r.user_id AND h.i = r.i + 1)
    SELECT event_id, n <= {limit} AS {columns} FROM runs"""


_LOG = "[x FOR x IN r.log IF x > h.t - 86400000000]"


@query(_fixed_sql(2, "allowed, CAST(n AS INT) AS hits"))
def rate_fixed(spark, sf_dir):
    return sync.fixed_window_limit(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 86400, 2).select("event_id", "allowed", "hits")


@query(
    f"""WITH RECURSIVE {_HITS}, runs AS (SELECT user_id, i, event_id, [t] AS log, true AS allowed, 1 AS n FROM hits WHERE i = 1 UNION ALL
    SELECT user_id, i, event_id, CASE WHEN len(log) < 2 THEN list_append(log, t) ELSE log END, len(log) < 2, least(len(log) + 1, 2) FROM (SELECT h.user_id, h.i, h.event_id, h.t, {_LOG} AS log FROM runs r JOIN hits h ON h.user_id = r.user_id AND h.i = r.i + 1))
    SELECT event_id, allowed, CAST(n AS INT) AS hits FROM runs"""
)
def rate_sliding(spark, sf_dir):
    return sync.sliding_log_limit(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 86400, 2).select("event_id", "allowed", "hits")


@query(
    """WITH RECURSIVE hits AS (SELECT l_returnflag AS k, l_orderkey * 10 + l_linenumber AS id, CAST(l_shipdate AS TIMESTAMP) AS t FROM lineitem),
    windows(k, start) AS (SELECT k, min(t) FROM hits GROUP BY k UNION ALL SELECT w.k, min(h.t) FROM windows w JOIN hits h ON h.k = w.k AND h.t >= w.start + INTERVAL 7 DAY GROUP BY w.k, w.start)
    SELECT id, n <= 100 AS allowed, CAST(n AS INT) AS hits FROM (SELECT h.id, row_number() OVER (PARTITION BY h.k, w.start ORDER BY h.t, h.id) AS n FROM hits h ASOF JOIN (SELECT DISTINCT k, start FROM windows) w ON h.k = w.k AND h.t >= w.start)"""
)
def rate_hot_keys(spark, sf_dir):
    """Three keys, of which one has half of all requests; each key's are handled in several parts."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return sync.fixed_window_limit(li, "k", "ts", "id", 7 * 86400, 100, 16).select("id", "allowed", "hits")


@query(_fixed_sql(1, "fresh"))
def idempotency(spark, sf_dir):
    return sync.idempotent(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "fresh")


@query(
    f"""WITH RECURSIVE {_HITS}, kinds AS (SELECT event_id, event_type = 'purchase' AS ended, 'r' || event_id AS response FROM events),
    runs AS (SELECT user_id, i, event_id, CASE WHEN ended THEN 'completed' ELSE 'started' END AS outcome, ended AS done, t + 86400000000 AS until, CASE WHEN ended THEN response END AS answer FROM hits JOIN kinds USING (event_id) WHERE i = 1
    UNION ALL SELECT user_id, i, event_id, CASE WHEN ended THEN 'completed' WHEN t >= until THEN 'started' WHEN done THEN 'answered' ELSE 'refused' END, CASE WHEN ended THEN true WHEN t >= until THEN false ELSE done END,
        CASE WHEN ended OR t >= until THEN t + 86400000000 ELSE until END, CASE WHEN ended THEN response WHEN t >= until THEN NULL ELSE answer END
    FROM (SELECT h.*, k.ended, k.response, r.done, r.until, r.answer FROM runs r JOIN hits h ON h.user_id = r.user_id AND h.i = r.i + 1 JOIN kinds k ON k.event_id = h.event_id))
    SELECT event_id, outcome, answer FROM runs"""
)
def idempotent_answers(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("response"))
    return sync.answered(events, "user_id", "ts", "event_id", "response", F.col("event_type") == "purchase").select("event_id", "outcome", "answer")


@query("SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def first_in_day(spark, sf_dir):
    return sync.first_in_day(table(spark, sf_dir, "events"), F.col("user_id"), "ts", "event_id").select("user_id", F.to_date("ts").alias("day"), "event_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 'changed' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 2 = 0")
def change_feed(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    index = c.where("c_custkey % 3 = 0").select("c_custkey", "c_name")
    every = c.where("c_custkey % 5 = 0")
    changes = every.select("c_custkey", F.lit("older").alias("c_name"), F.lit(False).alias("removed"), F.lit(1).alias("at")).union(every.select("c_custkey", F.lit("changed"), F.col("c_custkey") % 2 == 1, F.lit(2)))
    return sync.apply_changes(index, changes, "c_custkey", "at")


_STRIPPED = "regexp_replace(%s, '#.*$', '')"
_HOST = "regexp_extract(%s, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)"
_LINKS = f"""(SELECT DISTINCT {_STRIPPED % "url"} AS url, {_STRIPPED % "h"} AS href FROM (SELECT url, CASE WHEN regexp_matches(h, '^/([^/]|$)') THEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*') || h WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN h END AS h
    FROM (SELECT url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href=["'']([^"'']*)["'']', 1)) AS h FROM pages)) WHERE lower({_HOST % "url"}) = lower({_HOST % "h"}))"""


@query(f"SELECT url, href FROM {_LINKS}")
def page_links(spark, sf_dir):
    return sync.page_links(table(spark, sf_dir, "pages"))


@query(f"WITH RECURSIVE links AS {_LINKS}, seen(url, depth) AS (SELECT DISTINCT {_STRIPPED % 'url'}, 0 FROM pages UNION SELECT l.href, s.depth + 1 FROM seen s JOIN links l ON l.url = s.url WHERE s.depth < 3) SELECT url, min(depth) AS depth FROM seen GROUP BY url")
def crawl(spark, sf_dir):
    found = table(spark, sf_dir, "pages")
    with_checkpoints(spark)
    return sync.crawl(sync.page_links(found), found, 3)


_ROUTES = "(SELECT c_custkey AS url, c_custkey * 2 AS href FROM customer UNION ALL SELECT c_custkey, c_custkey * 3 FROM customer)"


@query(f"WITH RECURSIVE seen(url, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.href, s.depth + 1 FROM seen s JOIN {_ROUTES} e ON e.url = s.url WHERE s.depth < 4) SELECT 'http://a/' || url AS url, min(depth) AS depth FROM seen GROUP BY url")
def crawl_deep(spark, sf_dir):
    page = lambda k: F.concat(F.lit("http://a/"), k.cast("string"))
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    edges = c.select(F.concat(page(k), F.lit("#x")).alias("url"), page(k * 2).alias("href")).union(c.select(page(k), F.concat(page(k * 3), F.lit("#top")))).union(c.select(page(k), F.concat(F.lit("http://b/"), k.cast("string"))))
    with_checkpoints(spark)
    return sync.crawl(edges, c.where("c_custkey = 1").select(page(k).alias("url")), 4)


@query("SELECT c_custkey, c_nationkey AS page FROM customer WHERE c_nationkey > 10")
def feed_after(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("page"))
    return sync.changes_after(c, c.where("page = 10").select("page").distinct(), "page")[0]


@query("SELECT o_orderkey, n.id FROM orders o LEFT JOIN (SELECT c_acctbal, min(c_custkey) AS id FROM customer GROUP BY c_acctbal) n ON o.o_totalprice = n.c_acctbal")
def reverse_lookup(spark, sf_dir):
    index = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("o_totalprice"))
    return sync.by_value(index, "id", "o_totalprice", table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")).select("o_orderkey", "id")


# generated data
def _unit(key: str, seed: int, number: int | str = 0) -> str:
    return f"((CAST('0x' || substr(md5({key} || '-{seed}-' || {number}), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52):.1f})"


def _of_order(number: int = 0) -> str:
    return _unit("o_orderkey", 7, number)


_NORMAL = f"sqrt(-2 * ln({_of_order()})) * cos(2 * pi() * {_of_order(1)})"
_ERLANG = lambda *numbers: "(0.0" + "".join(f" - ln({_of_order(i)})" for i in numbers) + ")"
_STEPPED = lambda steps: f"CAST(len([s FOR s IN [{', '.join(map(repr, steps))}] IF {_of_order()} > s]) AS DOUBLE)"
_DRAWN = {
    "uniform": f"{_of_order()} * 100.0",
    "normal": _NORMAL,
    "exponential": f"-ln({_of_order()})",
    "poisson": _STEPPED(generate.poisson_steps(5.0)),
    "binomial": _STEPPED(generate.binomial_steps(10, 0.5)),
    "gamma": f"{_ERLANG(0, 1)} * 2.0",
    "beta": f"{_ERLANG(0, 1)} / ({_ERLANG(0, 1)} + {_ERLANG(*range(2, 7))})",
    "pareto": f"pow({_of_order()}, -0.5) - 1",
    "weibull": f"pow(-ln({_of_order()}), 1.0)",
    "lognormal": f"exp({_NORMAL})",
}


def _generated(name: str) -> Run:
    return lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", F.round(generate.distribution(name, 7, "o_orderkey"), 6).alias("x"))


for _name, _sql in _DRAWN.items():
    QUERIES[f"gen_{_name}"] = _generated(_name)
    ORACLES[f"gen_{_name}"] = f"SELECT o_orderkey, round({_sql}, 6) AS x FROM orders"

_PART = lambda seed, number=0: _unit("p_partkey", seed, number)


@query(
    f"""SELECT p_partkey, CAST(trunc({_PART(3)} * 100) AS INT) AS int4_1, CAST(trunc({_PART(4)} * 100) AS INT) AS int4_2, CAST(trunc({_PART(5)} * 100) AS INT) AS int4_3,
    array_to_string([substr('{generate.ALPHABET.replace("'", "''")}', CAST(floor({_PART(6, "i")} * {len(generate.ALPHABET)}) AS INT) + 1, 1) FOR i IN range(1, 11)], '') AS varchar_1,
    DATE '2020-01-01' + CAST(trunc({_PART(7)} * 100) AS INT) AS date_1, regexp_replace(md5(p_partkey || '-8'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS uuid_1 FROM part"""
)
def gen_table(spark, sf_dir):
    made = generate.with_columns(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 6, "int4:2,int4;varchar(10):1;date:1,uuid:1", seed=3)
    return made.withColumnRenamed("varchar(10)_1", "varchar_1")


_CUSTOMER = lambda seed, number=0: _unit("c_custkey", seed, number)


@query(
    f"""SELECT c_custkey, ['Ada', 'Ben', 'Chloe', 'Dan', 'Eve', 'Finn'][CAST(floor({_CUSTOMER(5)} * 6) AS INT) + 1] AS first_name, ['Hill', 'Lake', 'Moor', 'Reed', 'Wood'][CAST(floor({_CUSTOMER(6)} * 5) AS INT) + 1] AS last_name,
    DATE '1940-01-01' + CAST(floor({_CUSTOMER(7)} * (DATE '2005-12-31' - DATE '1940-01-01' + 1)) AS INT) AS birth_date, round({_CUSTOMER(8)} * 60 + 140, 2) AS height_cm, round({_CUSTOMER(9)} * 70 + 45, 2) AS weight_kg,
    {" || ".join("'-'" if c == "-" else f"CAST(floor({_CUSTOMER(10, i)} * 10) AS INT)" for i, c in enumerate("###-###-####"))} AS phone FROM customer"""
)
def gen_profile(spark, sf_dir):
    return generate.with_profile(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "personal", 5)


# functions over columns: text
@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END, '') AS customer FROM orders")
def stringified(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.stringify(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))).alias("customer"))


@query("SELECT p_partkey, lower(trim('  ' || p_type || ' ')) AS name FROM part")
def canonical_identifier(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.canonical(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("name"))


@query("SELECT p_partkey, coalesce(nullif(replace(lower(trim(regexp_replace(t, '[^a-zA-Z0-9_\\- ]', '', 'g'))), ' ', '_'), ''), 'untitled') AS slug FROM (SELECT p_partkey, CASE WHEN p_size < 5 THEN '#!' ELSE p_type || ' (' || p_brand || ')' END AS t FROM part)")
def heading_slug(spark, sf_dir):
    heading = F.when(F.col("p_size") < 5, "#!").otherwise(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")")))
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(heading).alias("slug"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS INT) AS n FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM documents)")
def rough_tokens(spark, sf_dir):
    ascii_ = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(ascii_).cast("int").alias("n"))


@query("SELECT c_custkey, replace(replace('Dear {{name}} of {{region}}, {{name}}!', '{{name}}', c_name), '{{region}}', n_name) AS letter FROM customer JOIN nation ON c_nationkey = n_nationkey")
def filled_template(spark, sf_dir):
    letter = text.fill_template(F.lit("Dear {{name}} of {{region}}, {{name}}!"), {"name": F.col("c_name"), "region": F.col("n_name")})
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", letter.alias("letter"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def fenced_reply(spark, sf_dir):
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("no answer")
    return table(spark, sf_dir, "events").select("event_id", text.fenced_json(reply, "k long")["k"].alias("k"))


@query("SELECT p_partkey, 'libs.' || p_size || '.part' AS module FROM part")
def module_names(spark, sf_dir):
    path = F.concat(F.lit("libs\\"), F.col("p_size").cast("string"), F.lit("/part.py"))
    return table(spark, sf_dir, "part").select("p_partkey", text.module_of(path).alias("module"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['libs.a' || p_size, 'libs.b'] ELSE ['libs.b'] END AS modules FROM part")
def module_imports(spark, sf_dir):
    size = F.col("p_size").cast("string")
    code = F.concat(F.lit("from libs.b import x\nimport os\n  import libs.b\n"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("import libs.a"), size)).otherwise("x = 'import libs.c'"))
    return table(spark, sf_dir, "part").select("p_partkey", text.imported_modules(code, "libs").alias("modules"))


@query("SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 3 = 1 AS plausible FROM customer")
def plausible_connection(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 3 == 0, "host=db;user=me").when(F.col("c_custkey") % 3 == 1, "db://host/x").otherwise("plain words")
    return table(spark, sf_dir, "customer").select("c_custkey", text.looks_like_connection(raw).alias("plausible"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id, NULL::VARCHAR AS secret, 1::INT AS parameters FROM customer")
def safe_parameters(spark, sf_dir):
    params = text.safe_query(F.concat(F.lit("id="), F.col("c_custkey").cast("string"), F.lit("&Password=x&token=y")), security.SENSITIVE)
    return table(spark, sf_dir, "customer").select("c_custkey", params["id"].alias("id"), params["Password"].alias("secret"), F.size(params).alias("parameters"))


@query("SELECT page_id, substr(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[^a-z0-9]+', '-', 'g'), 1, 80) || '-20240601000000-' || substr(sha1(url), 1, 8) || '.md' AS file_name FROM pages")
def page_files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.page_file_name(F.col("url"), now()).alias("file_name"))


@query("SELECT user_id, [user_id || '-Jan', '2-Feb'] AS days, ['New Year - ' || user_id, 'other'] AS names FROM (SELECT DISTINCT user_id FROM events)")
def holiday_names(spark, sf_dir):
    user = F.col("user_id").cast("string")
    entries = F.array(F.concat(user, F.lit("-Jan - New Year - "), user), F.lit("2-Feb - other"), F.lit("no date"))
    named = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("h", text.dated_names(entries))
    return named.select("user_id", F.map_keys("h").alias("days"), F.map_values("h").alias("names"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal / 10000 >= 0.7 THEN 'high' WHEN s_acctbal / 10000 >= 0.4 THEN 'medium' ELSE 'low' END AS badge FROM supplier")
def score_badge(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.badge(F.col("s_acctbal") / 10000).alias("badge"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * 1.5::DOUBLE ELSE -1.0::DOUBLE END AS ms FROM events")
def statement_ms(spark, sf_dir):
    end = F.when(F.col("event_id") % 2 == 0, F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") * 1500))
    return table(spark, sf_dir, "events").select("event_id", text.duration_ms(F.col("ts"), end, F.lit(-1.0)).alias("ms"))


# functions over columns: hashes and encryption
@query("SELECT page_id, sha256(coalesce(html, '')) AS plain, sha1('PATH::' || url || coalesce(html, '')) AS salted, md5(coalesce(html, '')) AS short FROM pages")
def content_hashes(spark, sf_dir):
    html = F.coalesce("html", F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", security.content_hash(html).alias("plain"), security.content_hash(html, F.col("url"), "sha1").alias("salted"), security.content_hash(html, algorithm="md5").alias("short"))


@query("SELECT c_custkey, c_name AS opened, CAST(length(c_name) + 28 AS INT) AS sealed_bytes FROM customer")
def sealed_round_trip(spark, sf_dir):
    key = hashlib.sha256(KEY).digest()
    sealed = table(spark, sf_dir, "customer").select("c_custkey", security.encrypt(F.col("c_name"), key).alias("sealed"))
    return sealed.select("c_custkey", security.decrypt(F.col("sealed"), key).alias("opened"), F.octet_length(F.unbase64(F.translate("sealed", "-_", "+/"))).alias("sealed_bytes"))


# assertions
@query("SELECT c_custkey, c_mktsegment LIKE '%BUILD%' AS has, NOT contains(lower(c_name), '1') AS lacks, true AS lines FROM customer")
def text_predicates(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", assertions.matches(F.col("c_mktsegment"), "build", "i").alias("has"), assertions.not_contains(name, F.lit("1")).alias("lacks"), assertions.same_lines(F.concat(name, F.lit("\n A,b  c")), F.concat(F.lit(" "), F.upper(name), F.lit("\naB  c!"))).alias("lines")
    )


@query("SELECT p_partkey, CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 1.0 ELSE 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) END AS share FROM part")
def edit_share(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", assertions.levenshtein_share(F.col("p_name"), F.col("p_type")).alias("share"))


@query("SELECT o_orderkey, o_totalprice > 100000 AS above, o_totalprice < 100000 AS below, o_totalprice >= 50000 AS least, o_totalprice <= 50000 AS most, abs(o_totalprice - 100000) > greatest(1e-9 * greatest(abs(o_totalprice), 100000), 10) AS other FROM orders")
def number_predicates(spark, sf_dir):
    price, line = F.col("o_totalprice"), F.lit(100000.0)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", assertions.greater(price, line).alias("above"), assertions.less(price, line).alias("below"), assertions.at_least(price, F.lit(50000.0)).alias("least"), assertions.at_most(price, F.lit(50000.0)).alias("most"), assertions.not_equal(price, line, 10.0).alias("other")
    )


# shapes and roll-ups
@query("SELECT o_custkey, [[1, 3], [2, CAST(o_custkey AS BIGINT)]] AS turned FROM (SELECT DISTINCT o_custkey FROM orders)")
def transposed_matrix(spark, sf_dir):
    rows = F.array(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), F.array(F.lit(3).cast("long"), F.col("o_custkey")))
    return table(spark, sf_dir, "orders").select("o_custkey").distinct().select("o_custkey", reshape.transpose_matrix(rows).alias("turned"))


@query("SELECT r_regionkey AS key, r_name AS name, NULL::BIGINT AS suppliers FROM region UNION ALL SELECT n_nationkey, NULL, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) FROM nation")
def ragged_union(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    counted = nations.groupBy(F.col("n_nationkey").alias("key")).agg(F.count("s_suppkey").alias("suppliers"))
    return reshape.ragged_rows([table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), counted])


@query("SELECT failure_class, count(*) AS failures FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'KeyError' ELSE 'Unknown Failure' END AS failure_class FROM events) GROUP BY failure_class")
def failure_counts(spark, sf_dir):
    return rollups.failure_summary(results(spark, sf_dir), "message")


@query("SELECT count(DISTINCT p_brand) AS files, count(DISTINCT (p_brand, p_size)) AS classes, count(p_name) AS tests, (SELECT list_sort(list(DISTINCT w)) FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part)) AS tags FROM part")
def test_catalog(spark, sf_dir):
    return rollups.catalog_summary(table(spark, sf_dir, "part").withColumn("tags", F.split("p_type", " ")), "p_brand", "p_size", "p_name", "tags")


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(p_type, ' '), ['SMALL', 'BRASS'])")
def tests_by_tag(spark, sf_dir):
    return rollups.with_tags(table(spark, sf_dir, "part"), F.split("p_type", " "), ["SMALL", "BRASS"]).select("p_partkey")


@query("SELECT count(*) AS functions, count(DISTINCT p_brand) AS modules FROM part")
def registry_counts(spark, sf_dir):
    return rollups.registry_summary(table(spark, sf_dir, "part"), "p_brand")


@query("SELECT p_partkey, CASE WHEN p_size - 1 > 0 THEN p_size * 100.0::DOUBLE / (p_size - 1) ELSE 0.0 END AS total_coverage FROM part")
def coverage_rates(spark, sf_dir):
    reports = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("covered"), (F.col("p_size") - 1).alias("measured"))
    return rollups.coverage(reports).select("p_partkey", "total_coverage")


@query("SELECT c_custkey, c_name || '(a: int = ' || c_nationkey || ', *b, **c)' AS signature FROM customer")
def usage_signature(spark, sf_dir):
    arg = lambda name, hint, default, kwarg, variadic: F.struct(F.lit(name).alias("name"), F.lit(hint).cast("string").alias("type_hint"), default.cast("string").alias("default"), F.lit(kwarg).alias("is_kwarg"), F.lit(variadic).alias("is_variadic"))
    args = F.array(arg("a", "int", F.col("c_nationkey"), False, False), arg("b", None, F.lit(None), False, True), arg("c", None, F.lit(None), True, True))
    return table(spark, sf_dir, "customer").select("c_custkey", rollups.signature(F.col("c_name"), args).alias("signature"))


@query("SELECT doc_id, sha256(string_agg(coalesce(text, ''), '' ORDER BY doc_id) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) AS contenthash FROM documents")
def method_hashes(spark, sf_dir):
    return rollups.cumulative_hashes(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "doc_id", "text").select("doc_id", "contenthash")


@query(f"SELECT rel_path, action FROM ({_DIFF}) WHERE action IN ('upload', 'update_remote')")
def upload_only(spark, sf_dir):
    return sync.permitted(index_actions(spark, sf_dir), "upload").select("rel_path", "action")


@query(
    """SELECT 'o' || o_orderkey AS id, r_name || '/' || n_name || '/' || c_name || '/' || o_orderkey AS path FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'c' || c_custkey, r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name FROM region"""
)
def tree_paths(spark, sf_dir):
    """Orders below customers below nations below regions."""
    level = lambda tbl, key, name, parent: table(spark, sf_dir, tbl).select(key.alias("id"), F.col(name).cast("string").alias("name"), parent.alias("parent"))
    of = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    roots = level("region", of("r", "r_regionkey"), "r_name", F.lit(None).cast("string"))
    nations = level("nation", of("n", "n_nationkey"), "n_name", of("r", "n_regionkey"))
    customers = level("customer", of("c", "c_custkey"), "c_name", of("n", "c_nationkey"))
    orders = level("orders", of("o", "o_orderkey"), "o_orderkey", of("c", "o_custkey"))
    return sync.paths(roots.union(nations).union(customers).union(orders))


@query("SELECT o_orderkey AS id, min(o_orderkey) OVER () AS root, row_number() OVER (ORDER BY o_orderkey) - 1 AS depth FROM orders")
def chain_depths(spark, sf_dir):
    """One chain of all orders, each below the one before it."""
    rows = numbered(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey"))
    before = rows.select((F.col("number") + 1).alias("number"), F.col("o_orderkey").alias("parent"))
    return sync.depths(rows.join(before, "number", "left").select(F.col("o_orderkey").alias("id"), "parent"))


@query("SELECT 't' || c_custkey AS token_id, c_custkey AS source_id FROM customer")
def first_rows_per_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("token_id"))
    return dml.first_rows(c.union(c.select("source_id", F.lit("later"))), ["source_id"], F.col("token_id") == "later").select("token_id", "source_id")


# small expressions
@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS code FROM documents")
def collapsed_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.collapsed(F.col("text")).alias("code"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') AS suffix FROM orders")
def run_suffix(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.run_suffix(F.col("o_orderdate")).alias("suffix"))


@query("SELECT event_id, printf('%.3fs', event_id / 8.0::DOUBLE) AS elapsed FROM events")
def elapsed_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.elapsed(F.col("event_id") / 8).alias("elapsed"))


@query("SELECT o_orderkey, round(o_orderkey * 12345678 / 1073741824.0::DOUBLE, 2) AS gb, round(o_custkey / nullif(o_orderkey - 1, 0)::DOUBLE * 100, 2) AS share FROM orders")
def disk_usage(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.gigabytes(k * 12345678).alias("gb"), text.percent(F.col("o_custkey"), k - 1).alias("share"))


@query(
    """SELECT o_orderkey, 8 AS hours, CASE WHEN h IS NULL THEN 'task' ELSE 'holiday' END AS activity, CASE WHEN h IS NOT NULL THEN NULL WHEN isodow(d) = 3 THEN 'work from office' ELSE 'work from home' END AS mode, coalesce(h || ' - A Company Holiday', o_orderpriority) AS comment
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, CASE CAST(o_orderdate AS DATE) WHEN DATE '1995-12-25' THEN 'Christmas' WHEN DATE '1996-01-01' THEN 'New Year' END AS h FROM orders)"""
)
def timesheet(spark, sf_dir):
    entry = text.timesheet_entry(F.to_date("o_orderdate"), {"1995-12-25": "Christmas", "1996-01-01": "New Year"}, F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(F.array(entry)))


_RESULTS = f"(SELECT *, {_STATUS} AS s, ts + INTERVAL 3 SECOND AS done, CASE event_id % 3 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'KeyError' END AS type, CASE WHEN event_id % 3 <> 2 THEN repeat('bad ' || event_type || ' ', 15) END AS m FROM events)"


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    type_ = F.when(F.col("event_id") % 3 == 0, "ValueError").when(F.col("event_id") % 3 == 1, "KeyError")
    message = F.repeat(F.concat(F.lit("bad "), "event_type", F.lit(" ")), F.lit(15))
    text_ = lambda c: F.col(c).cast("string")
    return results(spark, sf_dir).select(
        F.concat(F.lit("f"), text_("user_id")).alias("file_path"), (F.col("event_id") % 2 == 0).alias("git_repo"), F.lit("main").alias("branch"), F.concat(F.lit("m"), text_("user_id")).alias("module"), F.col("event_type").alias("class"), F.concat(F.lit("t"), text_("event_id")).alias("test"),
        "status", F.when(type_.isNotNull(), F.struct(type_.alias("type"), message.alias("message"))).alias("exception"), F.col("ts").alias("start_time"), (F.col("ts") + F.expr("INTERVAL 3 SECOND")).alias("end_time"),
    )


@query(f"SELECT 'x86' AS platform, 'custom' AS runner, event_id % 2 = 0 AS git_repo, 'f' || user_id AS filepath, 'main' AS branch, 'm' || user_id AS module, event_type AS classname, 't' || event_id AS testname, s AS result, m AS error, ts AS started, done AS finished, 3.0::DOUBLE AS duration, 'me' AS username, false AS parallely, 1 AS threads, type AS exception FROM {_RESULTS}")
def uploaded_results(spark, sf_dir):
    return rollups.uploaded(run_results(spark, sf_dir), "x86", "me").withColumn("duration", F.round("duration", 6))


@query(f"SELECT 't' || event_id AS name, 'm' || user_id AS module, s AS status, CASE WHEN length(m) > 100 THEN substr(m, 1, 100) || '...' ELSE m END AS message, '3.000s' AS elapsed FROM {_RESULTS}")
def result_summary(spark, sf_dir):
    return rollups.result_summary(run_results(spark, sf_dir)).select("summary.name", "summary.place.module", "summary.status", "summary.message", "summary.elapsed")


@query("SELECT page_id, 'https://' || page_id || '/' AS url FROM pages UNION ALL SELECT page_id, url FROM pages")
def sitemap_urls(spark, sf_dir):
    loc = lambda c: F.concat(F.lit("<url><loc>"), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), loc(F.concat(F.lit("https://"), F.col("page_id").cast("string"), F.lit("/"))), loc(F.col("url")), F.lit("</urlset>"))
    return files.sitemap_locations(table(spark, sf_dir, "pages").withColumn("xml", xml), "xml", "page_id")


@query("SELECT page_id, CASE WHEN lower(url) LIKE '%.txt' THEN 'txt' WHEN lower(url) LIKE '%sitemap.xml' THEN 'sitemap' ELSE 'page' END AS kind FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '/sitemap.xml' ELSE '' END AS url FROM pages)")
def source_kinds(spark, sf_dir):
    ending = F.when(F.col("page_id") % 3 == 0, ".TXT").when(F.col("page_id") % 3 == 1, "/sitemap.xml").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", files.source_kind(F.concat("url", ending)).alias("kind"))


# feeds that are handed out by pages
def _pages(rows: DataFrame, path: str, numbers: range) -> None:
    """rows of each page number to a folder of its own."""
    for n in numbers:
        rows.where(F.col("number") == n).drop("number").write.parquet(f"{path}/{n:08d}")


def _taken(spark: SparkSession, path: str, into: str, checkpoint: str) -> None:
    """Runs a stream of the feed's pages into a table until it has taken all that are there."""
    q = spark.readStream.format("paged").option("path", path).load().writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


@query("SELECT o_orderkey, o_totalprice, printf('%08d', CAST(o_orderkey % 8 AS INT)) AS page FROM orders WHERE o_orderkey % 8 >= 3")
def feed_stream(spark, sf_dir):
    """A stream that first sees a feed of three pages, takes those that come then, stops, and takes the rest later."""
    feed.register(spark)
    at = folder(spark, "feed")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 8).alias("number"))
    _pages(rows, f"{at}/pages", range(0, 3))
    for more in (range(3, 3), range(3, 6), range(6, 8)):
        _pages(rows, f"{at}/pages", more)
        _taken(spark, f"{at}/pages", f"{at}/taken", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/taken")


@query("SELECT c_custkey, c_name, printf('%08d', CAST(c_nationkey % 5 AS INT)) AS page FROM customer")
def paged_listing(spark, sf_dir):
    feed.register(spark)
    at = folder(spark, "listing")
    _pages(table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_nationkey") % 5).alias("number")), at, range(5))
    return spark.read.format("paged").option("path", at).load()


# files: written to the shared folder and read back
def folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder for checkpoints, which the driver and all executors share."""
    with_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(files.removed_quietly, spark, path)
    return path


def customer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.concat(F.lit('q"|'), "c_name", F.lit(", x")).alias("c_name"))


_TEXTS = "(SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, 'q\"|' || c_name || ', x' AS c_name FROM customer)"


@query(f"SELECT c_custkey, segment, c_name FROM {_TEXTS}")
def csv_round_trip(spark, sf_dir):
    path = folder(spark, "csv")
    files.write_text_table(customer_texts(spark, sf_dir), path)
    return files.read_text_table(spark, path)


@query(f"SELECT c_custkey, segment, c_name FROM {_TEXTS}")
def psv_to_parquet(spark, sf_dir):
    path = folder(spark, "convert")
    files.write_text_table(customer_texts(spark, sf_dir), f"{path}/source", "psv")
    tabs = files.convert(spark, f"{path}/source", "tsv", f"{path}/tabs", "psv")
    return spark.read.parquet(files.convert(spark, tabs, "parquet", f"{path}/target", "tsv"))


@query("SELECT c_custkey, c_name, kind FROM customer, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) v(kind)")
def loaded_by_ending(spark, sf_dir):
    """A table written as files of four kinds, each read by the reader of its ending."""
    c, path, out = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), folder(spark, "endings"), None
    files.write_text_table(c, f"{path}/t.csv")
    c.write.json(f"{path}/t.json")
    c.write.orc(f"{path}/t.orc")
    c.write.parquet(f"{path}/t.parquet")
    for kind in ("csv", "json", "orc", "parquet"):
        rows = files.load(spark, f"{path}/t.{kind}").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.lit(kind).alias("kind"))
        out = rows if out is None else out.union(rows)
    return out


@query(f"SELECT c_custkey, segment, 'a' AS part FROM {_TEXTS} UNION ALL SELECT c_custkey, NULL, 'b' FROM {_TEXTS}")
def merged_files(spark, sf_dir):
    """All tables of a folder as one, columns by name."""
    path, df = folder(spark, "merge"), customer_texts(spark, sf_dir)
    files.write_text_table(df.select("segment", "c_custkey", F.lit("a").alias("part")), f"{path}/a")
    files.write_text_table(df.select(F.lit("b").alias("part"), "c_custkey"), f"{path}/b")
    return files.merged_tables(spark, path).select("c_custkey", "segment", "part")


@query("SELECT c_custkey, CAST(c_mktsegment IS NOT NULL AS INT) AS has_segment FROM customer")
def masked_sink(spark, sf_dir):
    """A masked table as it is written, and none of an empty one."""
    path = folder(spark, "masked")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").isNotNull().cast("int").alias("has_segment"))
    if files.write_masked(rows.limit(0), path, "none", "1") is not None:
        raise AssertionError("an empty table was written")
    return files.read_text_table(spark, files.write_masked(rows, path, "phi", "1"), "|").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("has_segment").cast("int").alias("has_segment"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def migrated_table(spark, sf_dir):
    """A table copied into a schema of the catalog, where it has to be made first."""
    name = f"m{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE SCHEMA {name} LOCATION '{folder(spark, name)}'")
    done = tables.migrate(spark, {"orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")}, name, "s__").first()
    if done["action"] != "created":
        raise AssertionError(done["detail"])
    return spark.table(f"{name}.s__orders")


@query(f"SELECT c_custkey, segment, NULL AS more FROM {_TEXTS} UNION ALL SELECT c_custkey, segment, c_name FROM {_TEXTS}")
def directory_union(spark, sf_dir):
    path, df = folder(spark, "union"), customer_texts(spark, sf_dir)
    files.write_text_table(df.select("segment", "c_custkey"), f"{path}/a")
    files.write_text_table(df.select(F.col("c_name").alias("more"), "c_custkey", "segment"), f"{path}/b")
    return files.read_directory(spark, [f"{path}/a", f"{path}/b"], ["c_custkey", "segment"])


@query(f"SELECT c_custkey, segment, c_name AS more, 1 AS batch FROM {_TEXTS} UNION ALL SELECT c_custkey, segment, NULL, 0 FROM {_TEXTS} UNION ALL SELECT NULL, 'lacks the columns [''segment'']', NULL, 0")
def ingested_files(spark, sf_dir):
    """Tables with other orders of columns, a bad one and one with a further column, dropped in turn."""
    path, df, required = folder(spark, "ingest"), customer_texts(spark, sf_dir), ["c_custkey", "segment"]
    files.write_text_table(df.select("segment", "c_custkey"), f"{path}/in/a")
    files.write_text_table(df.limit(1).select("c_custkey", "c_name").coalesce(1), f"{path}/in/bad")
    ingest.ingest(spark, f"{path}/in", f"{path}/out", required, f"{path}/archive")
    files.write_text_table(df.select(F.col("c_name").alias("more"), "c_custkey", "segment"), f"{path}/in/b")
    ingest.ingest(spark, f"{path}/in", f"{path}/out", required, f"{path}/archive")
    rows, apart = ingest.ingested(spark, f"{path}/out", required)
    rows = rows.select(*required, F.get_json_object("rescued", "$.more").alias("more"), "batch")
    return rows.unionByName(apart.select(F.lit(None).cast("string").alias("c_custkey"), F.col("reason").alias("segment"), F.lit(None).cast("string").alias("more"), "batch"))


@query(
    """WITH keys AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders),
    starts AS (SELECT i, CASE WHEN i = 0 THEN (SELECT min(o_orderkey) FROM orders) ELSE (SELECT o_orderkey FROM keys WHERE place = i * n // 12) END AS start FROM range(12) r(i))
    SELECT CAST(i AS INT) AS range, count(o_orderkey) AS rows, true AS same FROM starts JOIN (SELECT o.o_orderkey, max(s.i) AS part FROM orders o JOIN starts s ON o.o_orderkey >= s.start GROUP BY o.o_orderkey) ON part = i GROUP BY i UNION ALL SELECT 12, 0, true"""
)
def transfer_checks(spark, sf_dir):
    """A copy of orders in 12 ranges, cut off in its second job, and gone on with; a check per range."""
    orders, at, asked = table(spark, sf_dir, "orders"), folder(spark, "transfer"), []

    def breaks_off(predicate: str) -> DataFrame:
        asked.append(predicate)
        if len(asked) > 7:
            raise ConnectionError("the source went away")
        return orders.where(predicate)

    copy = transfer.Transfer(spark, at, "o_orderkey", 12, 6, 10_000_000)
    with contextlib.suppress(ConnectionError):
        copy.run(breaks_off)
    copy.run(transfer.of_frame(orders))
    return copy.verify().select("range", "rows", "same")


@query("SELECT DISTINCT c_nationkey AS id, 'M' || c_nationkey AS masked_id FROM customer")
def crosswalk_file(spark, sf_dir):
    path, k = folder(spark, "crosswalk"), F.col("c_nationkey")
    files.write_text_table(table(spark, sf_dir, "customer").select(k.alias("id"), F.lit("odd").alias("more"), F.concat(F.lit("M"), k.cast("string")).alias("masked_id")), path, "psv")
    return files.read_crosswalk(spark, path, spark.createDataFrame([], "id int, masked_id string").schema)


@query(f"SELECT c_custkey AS tokenid, 'a' AS part FROM {_TEXTS} UNION ALL SELECT segment, 'b' FROM {_TEXTS}")
def token_sink(spark, sf_dir):
    df = customer_texts(spark, sf_dir)
    frames = [df.select(F.col(c).cast("string").alias("tokenid"), F.lit(part).alias("part")) for c, part in (("c_custkey", "a"), ("segment", "b"))]
    path = folder(spark, "tokens")
    files.write_tokens(frames, path, "token", "1")
    return files.read_text_table(spark, files.latest_table(spark, path, "token"), "|")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 = 1")
def batch_of_changes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    store = versions.SnapshotSet(spark, folder(spark, "batch"))
    store.write([("t", lambda read: c)])
    odd = Conditions().add(F.expr("c_custkey % 2 = 1"))
    store.write([("new", lambda read: dml.update(read("t"), {"c_name": "new"}, odd).where("c_custkey % 2 = 1")), ("t", lambda read: read("t").where("c_custkey % 2 = 0").union(read("new")))])
    return store.read("t")


@query("SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1 FROM orders")
def snapshot_versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    store = versions.Snapshots(spark, folder(spark, "versions"))
    store.write(o)
    store.write(store.read().withColumn("o_custkey", F.col("o_custkey") + 1))
    return store.read(1).union(store.read())


# other parts of the builder, of changes and of secrets
@query("SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 3")
def table_alias(spark, sf_dir):
    return Query(table(spark, sf_dir, "orders")).alias("o").select("o.o_orderkey", "o.o_totalprice").join(table(spark, sf_dir, "customer").alias("c"), "o.o_custkey = c.c_custkey").where("c.c_nationkey", "=", 3).remove_column("o.o_totalprice").to_df()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def reset_conditions(spark, sf_dir):
    q = Query(table(spark, sf_dir, "orders")).select("o_orderkey", "o_totalprice").where("o_totalprice", ">", 1e9).group_by("o_orderkey")
    return q.reset().where("o_orderstatus", "=", "F").to_df()


@query("SELECT count(*) AS affected FROM orders WHERE o_totalprice > 200000")
def affected_rows(spark, sf_dir):
    n = dml.affected(table(spark, sf_dir, "orders"), Conditions().where("o_totalprice", ">", 200000.0))
    return spark.createDataFrame([(n,)], "affected long")


@query("SELECT c_custkey, c_name FROM customer")
def encrypted_round_trip(spark, sf_dir):
    key = hashlib.sha256(KEY).digest()
    return table(spark, sf_dir, "customer").select("c_custkey", security.encrypt(F.col("c_name"), key).alias("sealed")).select("c_custkey", security.decrypt(F.col("sealed"), key).alias("c_name"))


@query("SELECT c_custkey, c_name FROM customer")
def password_round_trip(spark, sf_dir):
    salt = hashlib.md5(KEY).digest()
    sealed = table(spark, sf_dir, "customer").select("c_custkey", security.encrypt_with_password(F.col("c_name"), "secret", salt).alias("sealed"))
    return sealed.select("c_custkey", security.decrypt_with_password(F.col("sealed"), "secret", salt).alias("c_name"))


@query("SELECT count(*) AS ids, count(*) AS different, true AS upper_case FROM customer")
def new_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(text.new_id().alias("id"))
    return ids.agg(F.count("id").alias("ids"), F.count_distinct("id").alias("different"), F.bool_and(F.col("id").rlike("^[0-9A-F]{8}(-[0-9A-F]{4}){3}-[0-9A-F]{12}$")).alias("upper_case"))


@query("SELECT p_partkey, p_type GLOB '*STEEL' AS steel, p_brand GLOB 'Brand#?1' AS first, regexp_matches(p_brand, '^Brand#[1-3][^1-3]$') AS among FROM part")
def glob_names(spark, sf_dir):
    match = lambda c, pattern: F.col(c).rlike(assertions.glob_regex(pattern))
    return table(spark, sf_dir, "part").select("p_partkey", match("p_type", "*STEEL").alias("steel"), match("p_brand", "Brand#?1").alias("first"), match("p_brand", "Brand#[1-3][!1-3]").alias("among"))


@query(f"SELECT tokenid, detokenid, 'tokens' AS part FROM {_CROSS} UNION ALL SELECT 'T' || c_custkey, 'M' || c_custkey, 'tokens' FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT NULL, 'M' || c_custkey, 'hashes' FROM customer WHERE c_custkey % 3 <> 0")
def r13_missing_rows(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    missing = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("T"), k).alias("tokenid"), F.concat(F.lit("M"), k).alias("detokenid"))
    tokens, hashes = identity.insert_missing(token_intervals(spark, sf_dir), spark.createDataFrame([], "detokenid string, token_hash string, token_order int"), missing, now())
    return tokens.select("tokenid", "detokenid", F.lit("tokens").alias("part")).union(hashes.select(F.lit(None).cast("string"), "detokenid", F.lit("hashes")))


@query("SELECT 'T' || c_custkey AS tokenid, CAST(NULL AS TIMESTAMP) AS create_date, NULL::VARCHAR AS alt_tokenid, NULL::VARCHAR AS detokenid FROM customer")
def r1_columns(spark, sf_dir):
    return identity.token_rows(token_facts(spark, sf_dir)).select("tokenid", "create_date", "alt_tokenid", "detokenid")


@query(
    """SELECT o_orderkey, 0 AS number, 'CREATE TABLE t' || o_orderkey || ' (id INTEGER, ok INTEGER)' AS statement FROM orders UNION ALL SELECT o_orderkey, 1, 'INSERT INTO t' || o_orderkey || ' VALUES (' || o_orderkey || ', 1, ''s.t; TRUE'')' FROM orders
    UNION ALL SELECT o_orderkey, 2, 'SELECT CURRENT_TIMESTAMP FROM t' || o_orderkey FROM orders"""
)
def script_statements(spark, sf_dir):
    """A script per order, split and rewritten for another dialect."""
    script = "CREATE TABLE s.t{k} (id BIGSERIAL, ok BOOLEAN); -- a; comment\nINSERT INTO s.t{k} VALUES ({k}, TRUE, 's.t; TRUE') RETURNING id;;\nSELECT NOW() FROM s.t{k}"
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.replace(F.lit(script), F.lit("{k}"), F.col("o_orderkey").cast("string")).alias("script"))
    return o.select("o_orderkey", F.posexplode(scripts.normalized_statements(F.col("script"), "sqlite")).alias("number", "statement"))


@query("SELECT 's' AS script, number, ok FROM (VALUES (1, true), (2, false), (3, true)) AS v(number, ok)")
def script_runs(spark, sf_dir):
    script = f"SELECT count(*) FROM parquet.`{sf_dir}/nation.parquet`; SELECT raise_error(n_name) FROM parquet.`{sf_dir}/nation.parquet`; SELECT 'a;b'"
    return scripts.run(spark, [("s", script)])[1].select("script", "number", "ok")
