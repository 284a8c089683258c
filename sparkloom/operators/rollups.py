"""Roll-ups of test results, catalog summaries and script statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import elapsed, exception_class
from sparkloom.operators.numbering import numbered


def status_counts(results: DataFrame, status: str, by: Sequence[str] = ()) -> DataFrame:
    """passed, failed, errored, skipped and the rate of success in percent, in which skipped ones have no part."""
    n = lambda s: F.count_if(F.lower(F.col(status)) == s)
    out = results.groupBy(*by).agg(F.count("*").alias("total"), n("passed").alias("passed"), n("failed").alias("failed"), n("error").alias("errored"), n("skipped").alias("skipped"))
    ran = F.col("passed") + F.col("failed") + F.col("errored")
    return out.withColumn("success_rate", F.when(ran > 0, F.col("passed") * 100.0 / ran).otherwise(0.0))


def failures_by_class(results: DataFrame, message: str, order: str, default: str = "Unknown Failure") -> DataFrame:
    """results with the class of their message and their number within it, by order, which should be total. A class
    that has most of the rows is numbered by ranges, in several tasks."""
    classed = results.withColumn("failure_class", exception_class(F.col(message), default))
    ranked = numbered(classed, F.col("failure_class"), F.col(order), into="__number")
    first = ranked.groupBy("failure_class").agg(F.min("__number").alias("__first"))
    return ranked.join(first, "failure_class").withColumn("number", (F.col("__number") - F.col("__first") + 1).cast("int")).select(*results.columns, "failure_class", "number")


def _seconds(start: Column, end: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / 1e6


#: Columns of an uploaded result.
UPLOADED = "platform runner git_repo filepath branch module classname testname result error started finished duration username parallely threads exception".split()


def uploaded(results: DataFrame, platform: str, username: str, runner: str = "custom") -> DataFrame:
    """results (file_path, git_repo, branch, module, class, test, status, exception struct<type, message>, start_time,
    end_time) as rows for the table of runs: UPLOADED, in this order. Durations are in seconds; a result without an
    exception has neither error nor exception."""
    c = F.col
    values = {
        "platform": F.lit(platform), "runner": F.lit(runner), "git_repo": c("git_repo"), "filepath": c("file_path"), "branch": c("branch"), "module": c("module"), "classname": c("class"), "testname": c("test"),
        "result": F.lower("status"), "error": c("exception.message"), "started": c("start_time"), "finished": c("end_time"), "duration": _seconds(c("start_time"), c("end_time")),
        "username": F.lit(username), "parallely": F.lit(False), "threads": F.lit(1), "exception": c("exception.type"),
    }
    return results.select(*[values[name].alias(name) for name in UPLOADED])


def result_summary(results: DataFrame, preview: int = 100) -> DataFrame:
    """results with `summary`, a struct of name, place, outcome and timing; a message longer than preview is cut there
    and ends in three dots."""
    message = F.col("exception.message")
    cut = F.when(F.length(message) > preview, F.concat(F.substring(message, 1, preview), F.lit("..."))).otherwise(message)
    place = F.struct(F.col("module"), F.col("class"), F.col("file_path"))
    return results.withColumn("summary", F.struct(F.col("test").alias("name"), place.alias("place"), F.lower("status").alias("status"), cut.alias("message"), elapsed(_seconds(F.col("start_time"), F.col("end_time"))).alias("elapsed")))


def failure_summary(results: DataFrame, message: str, default: str = "Unknown Failure") -> DataFrame:
    return results.groupBy(exception_class(F.col(message), default).alias("failure_class")).agg(F.count("*").alias("failures"))


def with_run_id(results: DataFrame, run_id: str, ts: str, id_: str) -> DataFrame:
    """results whose blank run id became time_id."""
    made = F.concat_ws("_", F.date_format(ts, "yyyyMMdd_HHmmss.SSS"), F.col(id_).cast("string"))
    return results.withColumn(run_id, F.when(F.trim(F.coalesce(F.col(run_id), F.lit(""))) == "", made).otherwise(F.col(run_id)))


def catalog_summary(tests: DataFrame, file: str, class_: str, method: str, tags: str) -> DataFrame:
    """Counts of files, classes and tests, and the sorted union of tags."""
    one = tests.groupBy(file, class_).agg(F.count(method).alias("tests"))
    of_file = one.groupBy(file).agg(F.count_if(F.col(class_).isNotNull()).alias("classes"), F.sum("tests").alias("tests"))
    counts = of_file.agg(F.count(file).alias("files"), F.coalesce(F.sum(F.when(F.col(file).isNotNull(), F.col("classes"))), F.lit(0)).alias("classes"), F.coalesce(F.sum("tests"), F.lit(0)).alias("tests"))
    names = tests.select(F.explode(tags).alias("tag")).where("tag is not null").distinct().agg(F.array_sort(F.collect_list("tag")).alias("tags"))  # rows meet once they are different tags
    return counts.join(F.broadcast(names))


def with_tags(tests: DataFrame, tags: Column, wanted: Sequence[str]) -> DataFrame:
    """Tests that have one of the tags; all, if none are asked for."""
    return tests.where(F.arrays_overlap(tags, F.array(*map(F.lit, wanted)))) if wanted else tests


def overloads(functions: DataFrame, name: str, module: str) -> DataFrame:
    """Names that are defined more than once, with how often and the sorted modules."""
    return functions.groupBy(name).agg(F.count("*").alias("definitions"), F.array_sort(F.collect_set(module)).alias("modules")).where("definitions > 1")


def registry_summary(functions: DataFrame, module: str) -> DataFrame:
    return functions.agg(F.count("*").alias("functions"), F.count_distinct(module).alias("modules"))


def script_statistics(runs: DataFrame, ok: str, ms: str, by: Sequence[str] = ()) -> DataFrame:
    """Statements, those that went well or failed, and their total duration."""
    return runs.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col(ok)).alias("ok"), F.count_if(~F.col(ok)).alias("failed"), F.sum(ms).alias("total_ms"))


def coverage(reports: DataFrame) -> DataFrame:
    return reports.withColumn("total_coverage", F.when(F.col("measured") > 0, F.col("covered") * 100.0 / F.col("measured")).otherwise(0.0))


def action_counts(rows: DataFrame, action: str, names: Sequence[str]) -> DataFrame:
    """One row with a count per named action."""
    return rows.agg(*[F.count_if(F.col(action) == n).alias(n) for n in names])


def completed(files: DataFrame, file: str, status: str) -> DataFrame:
    """Per file: how many of its tests ended and failed, and whether all ended."""
    ended = F.count_if(F.col(status).isNotNull())
    return files.groupBy(file).agg(F.count("*").alias("tests"), ended.alias("ended"), F.count_if(F.col(status).isin("failed", "error")).alias("failed"), (ended == F.count("*")).alias("complete"))


def signature(name: Column, args: Column) -> Column:
    """name(a: int = 1, **rest) of an array of structs name, type_hint, default, is_kwarg and is_variadic."""
    one = lambda a: F.concat(
        F.when(a["is_variadic"] & a["is_kwarg"], "**").when(a["is_variadic"], "*").otherwise(""),
        a["name"],
        F.coalesce(F.concat(F.lit(": "), a["type_hint"]), F.lit("")),
        F.coalesce(F.concat(F.lit(" = "), a["default"]), F.lit("")),
    )
    return F.concat(name, F.lit("("), F.array_join(F.transform(args, one), ", "), F.lit(")"))


def cumulative_hashes(methods: DataFrame, file: str, order: str, source: str) -> DataFrame:
    """methods with the SHA-256 of all sources of the file up to and with their own; null sources add nothing. A file's
    rows pass a task in order, which holds the hash's state and no rows."""
    columns, keys = methods.columns, key_text(F.col(file))
    rows = methods.withColumn("__file", keys).repartition("__file").sortWithinPartitions("__file", order, source)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = state = None
        for batch in batches:
            found = []
            for f, text in zip(batch.column("__file").to_pylist(), batch.column(source).to_pylist(), strict=True):
                if f != last:
                    last, state = f, hashlib.sha256()
                state.update((text or "").encode())
                found.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(found, pa.string())], [*columns, "contenthash"])

    return rows.mapInArrow(step, T.StructType([*methods.schema.fields, T.StructField("contenthash", T.StringType())]))


def key_text(key: Column) -> Column:
    """A string that differs between null and every value."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
