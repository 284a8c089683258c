"""Tables of catalogs and databases: connections, verification and migration."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: How a database's URL is made.
URLS = {"postgres": "jdbc:postgresql://{host}:{port}/{database}", "sqlite": "jdbc:sqlite:{database}"}

#: Columns of the test warehouse.
TESTRUNS = "id long, runid string, filepath string, module string, classname string, testname string, runner string, platform string, started timestamp, finished timestamp, duration double, result string, error string, exception string, username string, parallely boolean, threads int, git_repo boolean, branch string, insertdate timestamp"
TESTCASES = "id long, filepath string, module string, class string, test_case string, setup boolean, setupall boolean, teardown boolean, teardownall boolean, contenthash string, published_date timestamp, published_by string, updated_date timestamp, updated_by string, insertdate timestamp, branch string"


def connection(key: str, config: Mapping[str, Any], env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Options of a JDBC source; the password is that of the environment's {key}_pass, as it is, as it is no part of the
    URL."""
    kind = config["type"]
    if kind not in URLS:
        raise ValueError(f"unsupported database: {kind}")
    options = {"url": URLS[kind].format(**{"host": "localhost", "port": 5432, **config})}
    if kind == "postgres":
        options |= {"user": config["user"], "password": env[f"{key}_pass"]}
    return options


def probe(spark: SparkSession, options: Mapping[str, str]) -> str | None:
    """Asks a database for SELECT 1; what went wrong, or None. SQLite's driver makes a file that isn't there."""
    try:
        spark.read.format("jdbc").options(**options).option("query", "SELECT 1 AS one").load().first()
    except Exception as e:  # noqa: BLE001  told to the caller
        return str(e).splitlines()[0][:500]
    return None


def sanitized(columns: Sequence[Mapping[str, Any]]) -> list[dict[str, Any]]:
    """Columns of a database (name, type, and maybe default, identity, primary_key) as a database without sequences
    takes them: no identity, no default by nextval of a sequence, and integer primary keys count up by themselves."""
    out = []
    for column in columns:
        default = str(column.get("default") or "").lower()
        kept = {k: v for k, v in column.items() if k != "identity" and not (k == "default" and "nextval" in default and "::regclass" in default)}
        if kept.get("primary_key") and re.fullmatch(r"(?i)(small|big)?int(eger)?\d*|(small|big)?serial\d*|long", str(kept["type"])):
            kept["autoincrement"] = True
        out.append(kept)
    return out


def connections(databases: Mapping[str, Mapping[str, Any]], env: Mapping[str, str] = os.environ) -> dict[str, dict[str, str]]:
    return {f"{key}_conn": connection(key, config, env) for key, config in databases.items()}


def ddl(name: str, schema: T.StructType | str) -> str:
    columns = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"


def ensure_table(spark: SparkSession, name: str, schema: T.StructType | str) -> bool:
    """Creates a table that isn't there; whether it did."""
    if spark.catalog.tableExists(name):
        return False
    if "." in name:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name.rpartition('.')[0]}")
    spark.sql(ddl(name, schema))
    return True


def migrate(spark: SparkSession, tables: Mapping[str, DataFrame], schema: str, prefix: str = "", only: Sequence[str] = (), dry_run: bool = False) -> DataFrame:
    """Copies tables into a schema of the catalog, each as prefix + name; one that is there is appended to. A table
    that fails doesn't stop the others. A row per table: name, action, rows or error; a dry run tells the DDL."""
    out: list[tuple[str, str, int | None, str | None]] = []
    if not dry_run:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    for name, df in tables.items():
        if only and name not in only:
            continue
        target = f"{schema}.{prefix}{name}"
        if dry_run:
            out.append((name, "planned", None, ddl(target, df.schema)))
            continue
        try:
            created = ensure_table(spark, target, df.schema)
            df.write.mode("append").format("parquet").saveAsTable(target)
            out.append((name, "created" if created else "appended", spark.table(target).count(), None))
        except Exception as e:  # noqa: BLE001  told in the row
            out.append((name, "failed", None, str(e).splitlines()[0][:500]))
    return spark.createDataFrame(out, "name string, action string, rows long, detail string")


RUNS = "id long, runner string, started_at timestamp, finished_at timestamp, status string, metadata string"
TEST_RESULTS = "id long, run_id long, test_name string, file_path string, line int, outcome string, duration double, details string"
COVERAGE_REPORTS = "id long, run_id long, total_coverage double, covered long, measured long, created_at timestamp, metadata string"
SITE_PAGES = "id long, url string, chunk_number int, title string, summary string, content string, metadata string, embedding array<float>, created_at timestamp"


def reflect(spark: SparkSession, schema: str) -> DataFrame:
    """A row per column of the schema's tables: table, column, type and whether it may be null."""
    rows = [(t.name, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables(schema) for c in spark.catalog.listColumns(f"{schema}.{t.name}")]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean")
