"""Text tables that are dropped into a folder, each taken once, checked, and archived.

A file stream finds new files and remembers them in its checkpoint. Of each batch the files' header lines are read;
files with the same header are read together, by name of column and not by place. What is required comes first, further
columns are kept as JSON in RESCUED, and lines with another number of fields than the header in CORRUPT. A file that
lacks a column or names one twice is set apart with the reason, and the others go on. A batch writes folders of its
own number, whole, so that one that is run again after a failure replaces what it had written. Spark moves files to
the archive once the batch after theirs has begun. An empty file leaves no row.
"""

from __future__ import annotations

import csv
import io
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from sparkloom.sources.files import check_columns, exists

RESCUED, CORRUPT, FILE = "rescued", "corrupt", "file"


def _headers(lines: DataFrame) -> list[tuple[str, str]]:
    """Path and first line of each file of a batch."""
    place = F.monotonically_increasing_id()
    first = lines.where(F.col("start") == 0).withColumn("place", place).groupBy(FILE).agg(F.min_by("value", "place").alias("header"))
    return [(r[FILE], r["header"]) for r in first.orderBy(FILE).collect()]


def _columns(header: str, sep: str, required: Sequence[str]) -> tuple[list[str], str | None]:
    """The names in a header, and what is wrong with them."""
    names = next(csv.reader(io.StringIO(header.removeprefix("﻿")), delimiter=sep), [])
    if len(set(names)) < len(names):
        return names, "names a column twice"
    try:
        check_columns(names, required)
    except KeyError:
        return names, f"lacks the columns {[c for c in required if c not in names]}"
    return names, None


def _read(spark: SparkSession, paths: list[str], names: list[str], required: Sequence[str], sep: str) -> DataFrame:
    """The rows of files with one header; no name of theirs is taken for one of the result's."""
    own = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*own, CORRUPT]])
    rows = spark.read.schema(schema).options(header=True, sep=sep, nullValue="", multiLine=True, columnNameOfCorruptRecord=CORRUPT).csv(paths)
    of = dict(zip(names, own, strict=True))
    extra = [n for n in names if n not in required]
    rescued = F.to_json(F.struct(*[F.col(of[n]).alias(n) for n in extra])) if extra else F.lit(None).cast("string")
    return rows.select(*[F.col(of[n]).alias(n) for n in required], rescued.alias(RESCUED), CORRUPT, F.col("_metadata.file_path").alias(FILE))


def ingestion(spark: SparkSession, source: str, target: str, required: Sequence[str], archive: str | None = None, suffix: str = "csv", sep: str = ",", files: int = 1000) -> DataStreamWriter:
    """A stream, yet to be started, from the files of source whose names end in suffix to the tables rows and rejected
    under target, at most files in a batch; what is read goes to archive if there is one."""
    if clash := {RESCUED, CORRUPT, FILE} & set(required):
        raise ValueError(f"columns of the result: {sorted(clash)}")
    reader = spark.readStream.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").option("maxFilesPerTrigger", files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    lines = reader.load(source).select("value", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("start"))

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
        refused = []
        for path, header in _headers(batch):
            names, wrong = _columns(header, sep, required)
            if wrong:
                refused.append((path, wrong))
            else:
                groups[tuple(names)].append(path)
        rows = None
        for names, paths in groups.items():
            part = _read(session, paths, list(names), required, sep)
            rows = part if rows is None else rows.unionByName(part)
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        if refused:
            session.createDataFrame(refused, f"{FILE} string, reason string").write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")

    return lines.writeStream.foreachBatch(take).option("checkpointLocation", f"{target}/_checkpoint")


def ingest(spark: SparkSession, source: str, target: str, required: Sequence[str], archive: str | None = None, suffix: str = "csv", sep: str = ",", files: int = 1000) -> None:
    """Takes all files that are there and not yet taken."""
    q = ingestion(spark, source, target, required, archive, suffix, sep, files).trigger(availableNow=True).start()
    q.awaitTermination()


def ingested(spark: SparkSession, target: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows taken so far (required, rescued, corrupt, file, batch), and the files set apart (file, reason, batch)."""
    rows = T.StructType([*[T.StructField(c, T.StringType()) for c in [*required, RESCUED, CORRUPT, FILE]], T.StructField("batch", T.IntegerType())])
    apart = T.StructType.fromDDL(f"{FILE} string, reason string, batch int")
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{target}/{name}") if exists(spark, f"{target}/{name}") else spark.createDataFrame([], schema)
    return read("rows", rows), read("rejected", apart)
