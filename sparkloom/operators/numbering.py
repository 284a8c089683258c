"""Dense numbers over a whole table without passing it through one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_checkpoints(spark: SparkSession) -> None:
    """Sets the folder for checkpoints if the context has none: that of spark.checkpoint.dir, else, in local mode
    alone, a temporary one."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="sparkloom-checkpoints-")
            atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)


def numbered(df: DataFrame, *order: Column, into: str = "number") -> DataFrame:
    """df with 1, 2, 3, ... in the given order, which should be total. Rows are dealt out by ranges of the order and
    numbered within; only the sizes of the ranges are summed up in one place."""
    with_checkpoints(df.sparkSession)
    ranges = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__before"))  # a row per partition
    place = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return ranges.join(F.broadcast(starts), "__range").withColumn(into, (F.col("__before") + place).cast("long")).drop("__range", "__before")
