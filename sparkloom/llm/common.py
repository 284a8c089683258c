"""What the operators of this subpackage share: scratch tables, checked broadcasts and text expressions."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
#: Tables up to this many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
ARROW_ROWS = 1000

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "root" not in _own:
        _own["root"] = tempfile.mkdtemp(prefix="sparkloom-")
    return _own["root"]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped
        _delete(spark, folder)


class Scratch:
    """Tables written to the shared folder to cut lineage; drop() removes those that are no longer read, and those
    left go with the driver's process."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        mine = f"{scratch_root(spark)}/sparkloom/{spark.sparkContext.applicationId}"
        if mine not in _own:
            _own[mine] = mine
            atexit.register(_delete_at_exit, spark, mine)
        self.folder = f"{mine}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str, mode: str = "error") -> DataFrame:
        """df as a Parquet table of the shared folder; survives the loss of any executor."""
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").mode(mode).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.folder}/{name}")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ARROW_ROWS rows, as long texts make larger ones heavy for workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def small(table: DataFrame, row_bytes: int = 200, rows: int | None = None) -> DataFrame:
    """table with a broadcast hint if its counted rows stay under BROADCAST_BYTES, else as it is, for a shuffled
    join whose hot keys adaptive execution splits."""
    n = table.count() if rows is None else rows
    return F.broadcast(table) if n * row_bytes <= BROADCAST_BYTES else table


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(column: Column) -> Column:
    """A string that is never null and differs between null and every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the column's text modulo modulus; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
